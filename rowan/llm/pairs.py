"""Defects of prompt and response pairs.

A response is read once by a pushdown parser: code fences, markup tags, quotations, brackets and list
entries are pushed as they open and popped as they close, in JSON and prose alike, and what is left on the
stack says that the response breaks off. Refusals are recognised by small grammars, copies of the prompt
by greedy string tiling, and answers in another language by script and function words.
"""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from rowan.session import spread


DEFECTS = ("empty", "refusal", "copy", "truncated", "other_language")
INVISIBLE = re.compile("[\u200b\u200c\u200d\u2060\ufeff\xad]")
WORD = re.compile(r"[^\W_]+(?:['’][^\W_]+)*")
BATCH_ROWS = 2000

# ---------------------------------------------------------------- pushdown parser

WRAPPING = re.compile(r"```+|~~~+|(?<!\w)<(?P<close>/?)(?P<name>[A-Za-z][\w-]*)[^<>]*?(?P<alone>/?)>")
INFO = re.compile(r"[^\s{\[`~]*")
PAIRS = {"{": "}", "[": "]", "(": ")", "“": "”", "«": "»", "「": "」", "『": "』", "„": "“", "（": "）", "【": "】"}
CLOSING = {v: k for k, v in PAIRS.items() if k != "„"}
# a mark at the start of a line that opens an entry of a list; brackets and quotations
INNER = re.compile(r"(?P<entry>(?:^|(?<=\n))[ \t]*(?:\d{1,3}[.)]|[-*•–—])(?=\s|$))|[{}\[\]()“”„«»「」『』（）【】\"]")
# Tags that need no end.
LONE_TAGS = set("br hr img input meta link p li td tr th dt dd option body html".split())


def clean(text: str) -> str:
    """Without characters that show nothing."""
    return text if text.isascii() else INVISIBLE.sub("", text)


@dataclass
class Parse:
    """What a response wraps, and how it ends.

    content: the text without fences, markup and invisible characters; value: its JSON value, if it is
    JSON; is_json: it is complete JSON; looks_json: it begins as a JSON object or array; open: what is
    left on the stack at the end, outermost first; an open entry of a list stands as ``entry``.
    """

    content: str
    value: object = None
    is_json: bool = False
    looks_json: bool = False
    open: list[str] = field(default_factory=list)


def parse(text: str) -> Parse:
    """Read a response with a stack of what it opens and does not close."""
    text = clean(text)
    stack: list[str] = []
    content = unwrapped(text, stack) if "`" in text or "~~~" in text or "<" in text else text.strip()
    out = Parse(content, looks_json=content[:1] in ("{", "["))
    if content[:1] in JSON_STARTS:
        try:
            out.value = json.loads(content)
            out.is_json = True
        except (ValueError, RecursionError):
            pass
    if not out.is_json:
        stack += inner_stack(content, out.looks_json)
    out.open = stack
    return out


JSON_STARTS = set('{["-0123456789tfnNI')


def unwrapped(text: str, stack: list[str]) -> str:
    """The text without fences and tags, of which those left open are pushed; a tag counts if nothing stands before it or if another of its name is closed."""
    kept: list[str] = []
    at = 0
    closed = set()
    for m in WRAPPING.finditer(text):
        if m.start() < at:
            continue
        kept += [text[at : m.start()], " "]
        at = m.end()
        if m[0][0] == "<":
            name = m["name"].lower()
            if m["close"]:
                closed.add(name)
                if f"<{name}>" in stack:
                    del stack[len(stack) - 1 - stack[::-1].index(f"<{name}>") :]
            elif not m["alone"] and name not in LONE_TAGS and (name in closed or not any(k.strip() for k in kept)):
                stack.append(f"<{name}>")
            continue
        for _ in range(len(m[0]) // 3):  # six marks in a row open and close
            if "```" in stack:
                del stack[stack.index("```") :]
            else:
                stack.append("```")
        if "```" in stack:  # the word after an opening fence is its language
            at = INFO.match(text, at).end()
    kept.append(text[at:])
    return "".join(kept).strip()


def inner_stack(content: str, strict: bool) -> list[str]:
    """Brackets, quotations and list entries left open at the end.

    strict reads it as JSON. In prose a straight quotation mark opens only where a word may begin, one after a digit measures
    inches, and a quotation that another paragraph follows is closed by it.
    """
    stack: list[str] = []
    quoted = entry = -1
    at = 0
    while m := INNER.search(content, at):
        ch, at = m[0], m.end()
        before = content[m.start() - 1] if m.start() else " "
        if m["entry"] is not None:
            entry = at
        elif ch == '"':
            if strict or "{" in stack or "[" in stack:
                at = _string_end(content, at)
                if at < 0:
                    return [*stack, '"']
            elif '"' in stack:
                del stack[stack.index('"') :]
            elif before.isspace() or before in "([{:,;=—–-/":
                stack.append('"')
                quoted = at
        elif ch == "“" and "„" in stack:
            del stack[len(stack) - 1 - stack[::-1].index("„") :]
        elif ch in PAIRS:
            if not (ch == "(" and before in ":;" and not content[at : at + 1].strip()):  # a face is no bracket
                stack.append(ch)
        elif CLOSING.get(ch) in stack:  # what was opened within it is closed with it
            del stack[len(stack) - 1 - stack[::-1].index(CLOSING[ch]) :]
    if '"' in stack and "\n\n" in content[quoted:]:
        stack.remove('"')
    if entry >= 0 and "\n" in content and not content[entry:].strip():
        stack.append("entry")
    return stack


STRING_STOP = re.compile(r'["\\]')


def _string_end(content: str, at: int) -> int:
    """Index after the end of a JSON string that begins at ``at``, or -1."""
    while m := STRING_STOP.search(content, at):
        if m[0] == '"':
            return m.end()
        at = m.end() + 1
    return -1


def strings(value: object) -> Iterator[str]:
    """All texts, numbers and truth values of a JSON value, without keys, not recursive."""
    todo = [value]
    while todo:
        v = todo.pop()
        if isinstance(v, dict):
            todo.extend(reversed(list(v.values())))
        elif isinstance(v, list):
            todo.extend(reversed(v))
        elif v is not None:
            yield v if isinstance(v, str) else json.dumps(v)


def is_blank(text: str) -> bool:
    """No letter and no digit, or a word for nothing."""
    return not any(c.isalnum() for c in text) or text.strip(" \t\r\n\"'`.").lower() in ("null", "none", "undefined", "nil", "nan")


# ---------------------------------------------------------------- endings

LIST_ENTRY = re.compile(r"^\s*(?:(\d{1,3})[.)]|[-*•–—])(?:\s+(.*))?$")
END = re.compile(r"[.!?。！？…]+[\"'»”’」』)\]*_]*$")
FACE = re.compile(r"\s+[:;]-?[()]$")
PAIRED = re.compile(r":\s*\S")
OPEN_QUOTE = re.compile(r"(?:\w[\"“«„(]|[\s(][\"“«„])$")
JAPANESE = re.compile(r"[぀-ヿ一-鿿]")
SENTENCE = re.compile(r"(?<=[.!?。！？])[\"'»”’」』)]*\s+|\n+")


# Words with which no answer ends.
DANGLING = set(
    "the a an and or but of in on at to by for with from which that because although while whose is was are were be been than as into if so "
    "der die das ein eine und oder aber mit von zu im in auf weil dass obwohl ist war den dem des für als wenn "
    "le la les un une des et ou mais de du à au dans avec pour par que qui parce dont est était ce "
    "el los las una y o pero de del en con por para que porque aunque es fue su".split()
)


# Endings of a Japanese sentence; names of months.
JAPANESE_END = re.compile(r"(?:です|ます|ました|でした|ません|ください|だった|である|した|った|いた|れた|ない|だ)$")
MONTHS = "january february march april june july august september october november december januar februar märz mai juni juli oktober dezember janvier février mars avril juin juillet août septembre octobre novembre décembre enero febrero marzo abril mayo junio julio agosto septiembre octubre noviembre diciembre"


@functools.cache
def _long_words() -> tuple[str, ...]:
    return tuple(sorted({w for ws in WORDS.values() for w in ws.split()} | set(MONTHS.split())))


def is_fragment(word: str, prompt: str) -> bool:
    """The word is the beginning of a longer word of the prompt or of a common one, and not itself one of them."""
    low, known = word.casefold(), set(words_of(prompt))
    if low in known or low.isdigit():
        return False
    longer = (*known, *_long_words())
    return low not in longer and any(w.startswith(low) for w in longer)


def is_complete_clause(text: str, words: list[str], prompt: str) -> bool:
    """One short sentence without its mark that ends where a sentence may: in Japanese with a verb, else with a name, a noun in capitals or a number."""
    if JAPANESE.search(text):
        return bool(JAPANESE_END.search(text))
    last = words[-1]
    return len(words) <= 12 and text.endswith(last) and (last[0].isupper() or last[0].isdigit()) and not is_fragment(last, prompt)


def breaks_off(content: str, prompt: str = "") -> bool:
    """The text ends inside a sentence or an entry of a list.

    A last sentence without its mark counts if it begins like a sentence and goes on in small letters, unless it is
    all there is and a complete clause; a name, a number or a few words are an answer of their own.
    """
    text = FACE.sub("", content.rstrip().rstrip("*_`").rstrip())
    if not text or END.search(text):
        return False
    if text[-1] in ",;:(-–—/&、，：[{" or OPEN_QUOTE.search(text):
        return True
    lines = [x for x in text.splitlines() if x.strip()]
    last = lines[-1]
    entry = LIST_ENTRY.match(last)
    if entry:
        rest = (entry[2] or "").strip()
        before = [m for x in lines[:-1] if (m := LIST_ENTRY.match(x))]
        # entries that pair a name with a value end with the value
        return not rest or bool(before) and all(PAIRED.search(m[2] or "") for m in before) and not PAIRED.search(rest)
    if len(lines) > 1 and LIST_ENTRY.match(lines[-2]) and re.fullmatch(r"\s*\d{1,3}", last):
        return True
    sentences = [x for x in SENTENCE.split(text) if x.strip()]
    segment = sentences[-1].strip()
    if JAPANESE.search(segment):
        if len(sentences) == 1 and JAPANESE_END.search(segment):
            return False
        return len(segment) > 8 and bool(re.search(r"[぀-ゟ]", segment)) and not re.search(r"[一-鿿ァ-ヿ]$", segment) or len(segment) > 15
    words = WORD.findall(segment)
    if not words:
        return False
    if words[-1].lower() in DANGLING and len(words) > 1:
        return True
    small = sum(w[0].islower() for w in words)
    if len(sentences) == 1 and is_complete_clause(text, words, prompt):
        return False
    if words[0][0].isupper():
        return small > 0 and len(words) >= 3
    if words[0][0].isdigit():
        return small >= 3
    earlier = len(segment) < len(text) and END.search(text[: len(text) - len(segment)].rstrip())
    return len(words) > 6 or bool(earlier)


# ---------------------------------------------------------------- refusals

_THING = r"(?:that|this|it|you|your|the|anything|any|questions?|requests?|matters?|such|these|with|on|to|replies|topics|reply|respond|answer)\b"
# Ways to decline, by language; each is searched at the beginning of a sentence.
_I = r"(?:i|we)\s+"
REFUSALS = [
    re.compile(p, re.I)
    for p in (
        _I + r"(?:really\s+|simply\s+)?(?:can\s?not|can['’]t|could\s+not|couldn['’]t|will\s+not|won['’]t|would\s+not|wouldn['’]t|do\s+not|don['’]t|may\s+not|shall\s+not|must\s+not|should\s+not)\s+(?:be\s+)?(?:able\s+to\s+)?"
        r"(?:help|assist|answer\w*|comply|respond\w*|repl\w+|take\s+on|provide|process|handle|deal|discuss|address|support|fulfil\w*|complete|do|continue|engage|work|comment|offer|give|share|feel\s+comfortable|want\s+to|wish\s+to)\b",
        r"(?:i['’]m|i\s+am|we\s+are|we['’]re)\s+(?:not\s+(?:able|allowed|permitted|in\s+a\s+position|comfortable|going|willing|supposed|authori[sz]ed)|unable|declining|forbidden|prohibited|refusing)\b",
        r"(?:i|we)\s+(?:must|have\s+to|need\s+to|would|will|shall|am\s+going\s+to)?\s*(?:respectfully\s+|politely\s+)?(?:decline|refuse|pass\s+on|abstain)\b",
        r"(?:i|we)(?:['’]d|\s+would)\s+(?:rather|prefer)\s+(?:to\s+)?not\b",
        r"(?:i|we)\s+(?:have|was|were|am|are)\s+(?:been\s+)?(?:asked|told|instructed|advised|required)\s+not\s+to\b",
        r"(?:it\s+is|it['’]s|there\s+is|there['’]s)\s+(?:not\s+possible|impossible|no\s+way)\s+for\s+(?:me|us)\b",
        r"(?:request|access|question|query)\s+(?:denied|rejected|refused|declined|blocked)\b",
        r"(?:my|our)\s+(?:instructions?|guidelines?|rules?|polic(?:y|ies)|settings?|programming|terms)\s+(?:do(?:es)?\s*(?:not|n['’]t)|forbids?|prevents?|prohibits?|stops?|keeps?|will\s+not|won['’]t|cannot|can['’]t|tell|say|require)",
        r"(?:not|n['’]t|never)\s+(?:let|allow|permit|enable)\s+(?:me|us)\b|(?:forbid|prevent|prohibit|stop|keep)s?\s+(?:me|us)\s+from\b",
        r"something\s+(?:that\s+)?(?:an?|this)\s+(?:assistant|model|system|ai)\s+(?:should|can|may|must|will|does)\s*(?:not|n['’]t)\b",
        r"(?:outside|beyond|not\s+within|against)\s+(?:of\s+)?(?:what\s+(?:i|we)\s+(?:do|can|may|handle)|my|our)\b",
        r"(?:find|ask|look\s+for|turn\s+to)\s+(?:somebody|someone|something)\s+else\s+(?:for|to\s+do)\b",
        r"(?:i|we)\s+only\s+(?:do|handle|answer|discuss)\s+(?:safe|other|approved)\b",
        r"no\s+(?:answer|reply|response|help)\s+(?:(?:can|will|may)\s+be\s+(?:given|provided|offered)|from\s+(?:me|us))\b",
        r"(?:try|use|ask|contact|consult)\s+(?:a\s+different|another|some\s+other)\s+(?:tool|assistant|model|service|source|person|system|one)\b",
        r"(?:content|topic|question|request)\s+is\s+(?:not\s+(?:suitable|allowed|appropriate|permitted|acceptable)|inappropriate|prohibited)\b",
        r"(?:isn['’]t|is\s+not|not)\s+something\s+(?:that\s+)?(?:i|we)\s+(?:do|can|could|will|would|may|am|are)\b",
        # German
        r"(?:kann|darf|möchte|will|werde|können|dürfen|werden)\s+(?:ich|wir)\b[^.]*\b(?:nicht|keine?n?)\b",
        r"(?:ich|wir)\s+(?:kann|darf|möchte|will|werde|können|dürfen|werden)\b[^.]*\b(?:nicht|keine?n?)\b",
        r"(?:muss|müssen)\s+(?:ich|wir)\b[^.]*\b(?:ablehnen|verweigern|passen)\b|(?:ich|wir)\s+(?:muss|müssen|lehne|lehnen|verweigere)\b[^.]*\b(?:ablehnen|verweigern|ab|passen)\b",
        r"(?:bin|sind)\s+(?:ich|wir)\b[^.]*\b(?:nicht|außerstande)\b|(?:ich|wir)\s+(?:bin|sind)\b[^.]*\b(?:nicht\s+(?:zuständig|befugt|berechtigt|in\s+der\s+lage)|außerstande)\b",
        r"(?:es\s+ist\s+mir|mir\s+ist\s+es)\b[^.]*\b(?:nicht|unmöglich)\b",
        # French
        r"je\s+(?:ne|n['’])\s*(?:peux|puis|suis|veux|souhaite|répond\w*|trait\w*)\b|je\s+suis\s+(?:incapable|dans\s+l['’]impossibilité)|nous\s+ne\s+pouvons\b",
        r"je\s+(?:dois|préfère|me\s+vois)\b[^.]*\b(?:refuser|décliner|ne\s+pas|obligé)\b|je\s+(?:refuse|décline)\b",
        r"il\s+(?:m['’]est|nous\s+est|ne\s+m['’]est\s+pas|n['’]est\s+pas)\s+(?:impossible|possible|permis)\b",
        # Spanish
        r"no\s+(?:puedo|podemos|debo|quiero|deseo|voy\s+a|me\s+es\s+posible|estoy\s+(?:autorizad|en\s+condiciones)\w*|me\s+está\s+permitido|me\s+corresponde)\b",
        r"(?:debo|tengo\s+que|prefiero|me\s+veo)\b[^.]*\b(?:rechazar|declinar|negar\w*|no\s+responder|obligad\w)\b|(?:rechazo|declino)\s+(?:esta|esa|la|su|tu)\b",
        r"me\s+(?:es|resulta)\s+imposible\b",
        # Portuguese, Italian, Dutch
        r"(?:eu\s+)?não\s+(?:posso|podemos|consigo|conseguimos|devo|quero|vou|irei|me\s+é\s+possível|estou\s+autorizad\w+|sou\s+capaz)\b|(?:eu\s+)?(?:recuso|prefiro\s+não)\b|(?:tenho\s+de|devo)\s+recusar\b",
        r"non\s+(?:posso|possiamo|sono\s+(?:in\s+grado|autorizzat\w+)|intendo|voglio|mi\s+è\s+possibile)\b|(?:devo|preferisco)\s+(?:rifiutare|non)\b",
        r"(?:ik|wij|we)\s+(?:kan|kunnen|mag|mogen|wil|willen|zal)\b[^.]*\b(?:niet|geen)\b|(?:ik|wij)\s+(?:weiger|weigeren)\b",
        # Japanese
        r"(?:お答え|回答|対応|応じ|お手伝い|お受け|処理|ご案内)[^。]{0,14}(?:でき(?:ません|ない|かね)|致しかね|いたしかね|しかねます|られません|お断り|控え)",
        r"(?:お断り(?:し|いた|させ|しま)|辞退(?:し|いた|させ)|拒否(?:し|いた))",
    )
]
# What a sentence that one of the patterns finds must hold, pattern by pattern, in small letters.
NEEDED = tuple(
    tuple(x.split("|"))
    for x in (
        "not|n't|n’t", "not |unable|declin|forbid|prohib|refus", "declin|refus|pass|abstain", "not", "not", "possible|no way", "denied|rejected|refused|declined|blocked",
        "my |our ", "let|allow|permit|enable|forbid|prevent|prohibit|stop|keep", "something", "outside|beyond|within|against", "else", "only", "no ", "different|another|some", "suitable|allowed|appropriate|permitted|acceptable|prohibited",
        "something", "nicht|kein", "nicht|kein", "lehn|verweiger|passen|ab", "nicht|außerstande", "mir", "je |nous ", "je ", "il ",
        "no ", "rechaz|declin|neg|no responder|obligad", "imposible", "não|recus|refus", "non|rifiut", "niet|geen|weiger", "でき|かね|られません|断り|控え", "断り|辞退|拒否",
    )
)
GRAMMAR = tuple((frozenset(n), p) for n, p in zip(NEEDED, REFUSALS, strict=True))
LITERALS = sorted(frozenset().union(*NEEDED))
# Denials that decline nothing.
NO_DENIAL = re.compile(r"\b(?:can\s?not|can['’]t|could\s+not|couldn['’]t)\s+help\s+(?:but\b|\w+ing\b)", re.I)
QUOTED = re.compile(r"\"[^\"]*\"|“[^”]*”|«[^»]*»|„[^“]*“|「[^」]*」")
LEAD = re.compile(r"^(?:\W*(?:i['’]?m\s+sorry|i\s+am\s+sorry|sorry|i\s+apologi[sz]e|apologies|unfortunately|thanks\s+for\s+asking|thank\s+you|hmm+|well|as\s+an?\s+[\w ]{2,30}|leider|entschuldigung|es\s+tut\s+mir\s+leid|tut\s+mir\s+leid|malheureusement|désolée?|je\s+suis\s+désolée?|lo\s+siento|lamentablemente|perdón|申し訳(?:ありません|ございません)(?:が)?|すみません(?:が)?|残念ながら|but|aber|mais|pero|that|this|das|dies)\b[\s,.:;–—-]*)*", re.I)


CLAUSE = re.compile(r"[,;:—–]\s*|\b(?:but|and|so|because|as|aber|und|mais|et|pero|y|mas|e)\s", re.I)


def is_refusal(content: str, prompt: str = "") -> bool:
    """A sentence declines, in the writer's own words (what is quoted is not), and what stands before it answers nothing.

    Before a declining clause there may be excuses and courtesies, but no number; among the sentences before it
    there may be three that say anything, or any number that name neither a number nor a name that the prompt lacks.
    """
    low = content.lower()
    have = {x for x in LITERALS if x in low}
    able = [p for needed, p in GRAMMAR if not needed.isdisjoint(have)] if have else []
    if not able:
        return False
    text = QUOTED.sub("«»", content) if '"' in content or not content.isascii() else content
    sentences = [s for s in SENTENCE.split(text) if s.strip()]
    for i, sentence in enumerate(sentences):
        if i >= 3 and _tells(" ".join(sentences[:3]) if i == 3 else sentences[i - 1], prompt):
            return False
        rest = sentence[LEAD.match(sentence).end() :]
        if "help" in rest:
            rest = NO_DENIAL.sub("«»", rest)
        for p in able:
            m = p.search(rest)
            if m and not DIGIT.search(rest, 0, m.start()) and (m.start() <= 40 or CLAUSE.search(rest, 0, m.start() + 1) and not _tells(rest[: m.start()], prompt)):
                return True
    return False


DIGIT = re.compile(r"\d")
NAME = re.compile(r"(?<=[^\W_][,\s]\s)[^\W\d_a-z]\w+|(?<=[^\W_]\s)[^\W\d_a-z]\w+")


def _tells(text: str, prompt: str) -> bool:
    """The text names a number, or a name within a sentence, that the prompt does not have."""
    return any(w not in prompt for w in re.findall(r"\d[\d.,]*\d|\d", text)) or any(w not in prompt for w in NAME.findall(text) if w[0].isupper())


# ---------------------------------------------------------------- copies


MERSENNE, BASE = (1 << 61) - 1, 1_000_003_337


def _prefixes(numbers: list[int]) -> list[int]:
    out = [0]
    for x in numbers:
        out.append((out[-1] * BASE + x) % MERSENNE)
    return out


def tiles(a: list[str], b: list[str], least: int) -> tuple[list[bool], list[bool]]:
    """Greedy string tiling: which words of a and b lie in common runs of at least ``least`` words.

    The longest common runs are taken first and never overlap. The greatest length of a run that is still free in
    both is found by bisection over hashes of all windows, then one pass takes all runs of that length, so texts that repeat
    themselves take no longer than others: each round is linear, and lengths of runs only fall.
    """
    number: dict[str, int] = {}
    ia, ib = ([number.setdefault(w, len(number) + 1) for w in x] for x in (a, b))
    pa, pb = _prefixes(ia), _prefixes(ib)
    free_a, free_b = _free([False] * len(a)), _free([False] * len(b))
    used_a, used_b = [False] * len(a), [False] * len(b)

    def windows(p: list[int], free: list[int], size: int, power: int) -> Iterator[tuple[int, int]]:
        for i in range(len(p) - size):
            if free[i] >= size:
                yield (p[i + size] - p[i] * power) % MERSENNE, i

    def common(size: int) -> bool:
        power = pow(BASE, size, MERSENNE)
        have = {h for h, _ in windows(pb, free_b, size, power)}
        return bool(have) and any(h in have for h, _ in windows(pa, free_a, size, power))

    most = min(len(a), len(b))
    while most >= least and common(least):
        lo, hi = least, most
        while lo < hi:
            mid = (lo + hi + 1) // 2
            lo, hi = (mid, hi) if common(mid) else (lo, mid - 1)
        power = pow(BASE, lo, MERSENNE)
        where: dict[int, list[int]] = {}
        for h, j in windows(pb, free_b, lo, power):
            where.setdefault(h, []).append(j)
        turn = dict.fromkeys(where, 0)
        end_a, ends = 0, used_b
        for h, i in windows(pa, free_a, lo, power):
            if i < end_a or h not in where:
                continue
            places, k = where[h], turn[h]
            while k < len(places) and (ends[places[k]] or ends[places[k] + lo - 1]):
                k += 1
            turn[h] = k + 1
            if k < len(places):
                j = places[k]
                used_a[i : i + lo] = [True] * lo
                used_b[j : j + lo] = [True] * lo
                end_a = i + lo
        free_a, free_b, most = _free(used_a), _free(used_b), lo - 1
    return used_a, used_b


def _free(used: list[bool]) -> list[int]:
    """Number of free words in a row from each on."""
    out = [0] * (len(used) + 1)
    for i in range(len(used) - 1, -1, -1):
        out[i] = 0 if used[i] else out[i + 1] + 1
    return out


QUESTION_FIELD = re.compile(r'"question"\s*:\s*"((?:[^"\\]|\\.)*)"')
QUESTION_LABEL = re.compile(r"(?:question|frage|pregunta|質問)\s*[:：]\s*(.+)", re.I)
SENTENCE_EDGE = re.compile(r"[.!?](?!\d)|[？。！\n¿]")


def question_of(prompt: str) -> str:
    """The question in a prompt: the text of a JSON field, what follows a label, or the last sentence that asks; else all of it."""
    m = QUESTION_FIELD.search(prompt) if '"question"' in prompt else None
    if m:
        try:
            return json.loads(f'"{m[1]}"')
        except ValueError:
            return m[1]
    m = QUESTION_LABEL.search(prompt)
    if m:
        return m[1].strip()
    end = max(prompt.rfind("?"), prompt.rfind("？"))
    if end < 0:
        return prompt
    begin = 0
    for m in SENTENCE_EDGE.finditer(prompt, 0, end):
        begin = m.end()
    return prompt[begin : end + 1].strip()


def words_of(text: str) -> list[str]:
    if not text.isascii() and JAPANESE.search(text):
        return [c for c in text.casefold() if c.isalnum()]
    return WORD.findall(text.casefold())


def is_copy(prompt: str, content: str, question: str | None = None) -> bool:
    """The response is made of the prompt: tiles cover it but for a fifth, and most of the prompt's question.

    The prompt and its question may be given back any number of times.
    """
    a = words_of(content)
    if len(a) < 4:
        return False
    b = words_of(prompt)
    q = words_of(question_of(prompt) if question is None else question)
    known = set(b) | set(q)  # the question is decoded, so its words may not be the prompt's
    if sum(map(known.__contains__, a)) < 0.8 * len(a):
        return False
    # tiles are made of common runs of three words, so what these do not cover no tile does
    runs = {*zip(b, b[1:], b[2:]), *zip(q, q[1:], q[2:])}
    hit = [x in runs for x in zip(a, a[1:], a[2:])]
    if sum(x or y or z for x, y, z in zip([*hit, False, False], [False, *hit, False], [False, False, *hit])) < 0.8 * len(a):
        return False
    source = b + ["\n"] + q + ["\n"] + q + ["\n"]
    once = len(b) + 2 * len(q)
    in_a, _ = tiles(a, source * (1 if len(a) <= once else 1 - (-len(a) // once)), 3)
    if sum(in_a) < 0.8 * len(a):
        return False
    in_q, _ = tiles(q, a, 3)
    covered = sum(in_q) / max(len(q), 1)
    rest = len(a) - (max(i for i, x in enumerate(in_a) if x) + 1)
    if covered >= 0.6:
        return rest <= (2 if covered < 1 else 0)
    # a request that asks no question: one long stretch of the prompt and nothing else
    return all(in_a) and len(a) >= 6 and rest == 0


# ---------------------------------------------------------------- languages

# Function words and other frequent words of each language.
WORDS = {
    "en": "the of and to in is was for it that on as with by at from are this be or an not have has had but they which were one all there when than so no if then only after before because what each same into above below row rows named does how many who whose why where table column year list highest none yes true false both such most first second only fell value printed page footnote number name every place share between difference once",
    "de": "der die das und in den von zu mit ist auf für nicht eine ein einer eines einem im dem des sich als auch es an werden wird wurde aus er hat dass sie nach bei noch wie um am sind so nur aber war waren kein keine keiner welcher welche welches wer wo wann viele einträge nennen zeile zeilen spalte spalten tabelle frage jahr steht name darüber danach bis passt dazu summe seite fußnote oben solche meisten davon lag vorn leider liegt vor punkten wert höchsten liste groß abstand zwischen lies antworte beantworte",
    "fr": "le la les de des et en un une du est que dans pour qui au aux il elle a ne pas par sur plus ce cette avec se son sont mais ou même donc était sans tout été puis après avant c'était qu'il d'une n'est j'ai quelle quel combien lignes ligne citent tenait liste colonne colonnes tableau nom note page dit chose va sens imprimé aucune aucun autre s'en approche dernière dessus du haut réponds lis question différence entre points voit totaux tête jusqu'en nomme revient genre plupart datant ont écartées chiffre",
    "es": "el la los las de y en un una unos que es por con para del se no al lo como más su este esta esa eso ese pero sus le ya o fue entre porque muy sin sobre hay dos todo también son así cada ninguna ninguno filas fila columna columnas tabla lista nombre nota página dice mismo total impreso coincide otra acerca número contado cuál cuántas cuántos quién qué nombran después antes llevaba club tuvo valor alto diferencia responde pregunta lee puntos arriba primero hasta hasta sale tipo mayoría año",
}
LANGUAGE_NAMES = {
    "en": r"english|englisch\w*|anglais\w*|inglés|inglesa|英語",
    "de": r"german|deutsch\w*|allemand\w*|alemán|alemana|ドイツ語",
    "fr": r"french|französisch\w*|français\w*|francés|francesa|フランス語",
    "es": r"spanish|spanisch\w*|espagnol\w*|español\w*|castellano|スペイン語",
    "ja": r"japanese|japanisch\w*|japonais\w*|japonés|japonesa|日本語",
}


KANA, IDEOGRAPH = re.compile(r"[぀-ヿ]"), re.compile(r"[一-鿿]")
ELISIONS = ((re.compile(r"\b[lcdnsj]['’](?=\w)|\bqu['’]", re.I), "fr"),)
ACCENTS = tuple((re.compile(p, re.I), lang) for p, lang in ((r"[äöüß]", "de"), (r"[èêàçùœ]", "fr"), (r"[ñ¿¡ó]", "es")))


@functools.cache
def _weights() -> dict[str, dict[str, float]]:
    out: dict[str, dict[str, float]] = {}
    for lang, words in WORDS.items():
        for w in set(words.split()):
            out.setdefault(w, {})[lang] = 1.0
    return {w: {k: 1.0 / len(v) ** 2 for k in v} for w, v in out.items()}


def language_scores(text: str) -> dict[str, float]:
    """Weight of each language's function words in a text; Japanese by its script."""
    scores = dict.fromkeys(WORDS, 0.0)
    plain = text.isascii()
    kana = 0 if plain else len(KANA.findall(text))
    wide = kana + len(IDEOGRAPH.findall(text)) if kana else 0
    scores["ja"] = float(wide) if kana and wide * 4 >= sum(c.isalpha() for c in text) else 0.0
    table = _weights()
    low = text.lower()
    for w in WORD.findall(low if plain else low.replace("’", "'")):
        found = table.get(w)
        if found:
            for lang, x in found.items():
                scores[lang] += x
    for pattern, lang in (*(ELISIONS if "'" in text or "’" in text else ()), *(() if plain else ACCENTS)):
        scores[lang] += 0.5 * len(pattern.findall(text))
    return scores


def language_of(text: str, least: float = 1.0) -> str | None:
    scores = language_scores(text)
    best = max(scores, key=scores.get)
    rest = max(v for k, v in scores.items() if k != best)
    return best if scores[best] >= least and scores[best] > 1.3 * rest else None


def asked_languages(prompt: str) -> set[str]:
    """Languages that a prompt names."""
    return {lang for lang, p in _asking().items() if p.search(prompt)}


@functools.cache
def _asking() -> dict[str, re.Pattern]:
    return {lang: re.compile(rf"(?<!\w)(?:{p})(?!\w)" if lang != "ja" else p, re.I) for lang, p in LANGUAGE_NAMES.items()}


KEYED = re.compile(r'"[\w-]+"\s*:')
# a word with a digit or underscore; the look-behind keeps the search linear
MARKED = re.compile(r"(?<![A-Za-z_\d])[A-Za-z]*+[_\d][A-Za-z_\d]*+(?:\.[A-Za-z]+)?")


def natural(text: str) -> str:
    """A text without what has no language: identifiers, quoted keys, file names."""
    return MARKED.sub(" ", KEYED.sub(" ", text))


def in_other_language(prompt: str, content: str, question: str | None = None) -> bool:
    answer = language_of(natural(content))
    if answer is None:
        return False
    own = language_of(natural(question_of(prompt) if question is None else question))
    if own == answer:
        return False
    asked = asked_languages(prompt)
    if asked:
        return answer not in asked
    own = own or language_of(natural(prompt))
    return own is not None and answer != own


# ---------------------------------------------------------------- the operator


def defect_of(prompt: str | None, response: str | None) -> str | None:
    """The defect of one pair, or None; a missing prompt has nothing to copy and no language."""
    prompt = prompt or ""
    if response is None:
        return "empty"
    p = parse(response)
    values = [s for s in strings(p.value)] if p.is_json else [p.content]
    if is_blank(p.content) or all(is_blank(clean(v)) for v in values):
        return "empty"
    if p.looks_json and not p.is_json and p.open:
        return "truncated"
    plain = p.content if not p.is_json else " ".join(values) if not isinstance(p.value, str) else p.value
    # of JSON, only a single value can be a refusal or a copy: a task names its question
    single = plain if not p.is_json or len(values) == 1 else ""
    if single and is_refusal(single, prompt):
        return "refusal"
    question = question_of(prompt)
    if is_copy(prompt, single if p.is_json else p.content, question) or p.is_json and _same_json(prompt, p.value):
        return "copy"
    if p.open or not p.is_json and breaks_off(p.content, prompt):
        return "truncated"
    # a value that stands in the prompt says nothing about the answer's language
    told = plain if not p.is_json else " ".join(v for v in values if (" " in v or not v.isascii()) and v not in prompt)
    return "other_language" if told and in_other_language(prompt, told, question) else None


def _same_json(prompt: str, value: object) -> bool:
    """The response is the JSON object that the prompt contains."""
    at = prompt.find("{")
    if at < 0 or not isinstance(value, dict):
        return False
    try:
        return json.JSONDecoder().raw_decode(prompt, at)[0] == value
    except (ValueError, RecursionError):
        return False


def response_defects(pairs: DataFrame, pair_id: str = "result_id", prompt: str = "prompt", response: str = "raw_output") -> DataFrame:
    """One row (pair_id, defect) for each defective pair, with the first that holds of empty, truncated
    JSON, refusal, copy, truncated and other_language.

    empty: NULL, no letter or digit, or only null values, whatever wraps it. A NULL prompt counts as an empty
    one: its responses are never copies or in another language. A row that occurs twice, or in several
    versions, gives one row for each defect found; a NULL pair_id is kept. Very long responses are read
    whole. Other columns are not looked at. Pairs are judged one by one; only the defective ones are
    shuffled to make them distinct.
    """
    schema = f"{pair_id} {dict(pairs.dtypes)[pair_id]}, defect string"

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(at, BATCH_ROWS)
                found = [defect_of(p, r) for p, r in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
                keep = pa.array([i for i, x in enumerate(found) if x is not None], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), pa.array([x for x in found if x is not None], pa.string())], names=[pair_id, "defect"])

    return spread(pairs.select(pair_id, prompt, response)).mapInArrow(run, schema).distinct()


def defect_report(pairs: DataFrame, **names: str) -> DataFrame:
    """Number of defective pairs of each type, zero included."""
    found = response_defects(pairs, **names).groupBy("defect").agg(F.count("*").alias("pairs"))
    every = pairs.sparkSession.createDataFrame([(d,) for d in DEFECTS], "defect string")
    return every.join(found, "defect", "left").select("defect", F.coalesce("pairs", F.lit(0)).alias("pairs"))
