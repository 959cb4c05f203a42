"""Text quality statistics of documents, with lines labelled by a hidden Markov model.

Each line that is not blank is described by a few discrete observations (how it begins and ends, its
share of symbols, digits, cells, common words and so on). A hidden Markov model with the states prose,
list, table and junk reads the lines in order; its most likely path gives each line a label. Shares of
the labels, by characters, give the kind of the document.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rowan.llm._arrays import category_table, code_points, slices, span_hashes, word_spans
from rowan.session import spread

STATES = ("prose", "list", "table", "junk")
BATCH_BYTES = 4 << 20

# Common words of the languages of the corpus.
COMMON = {
    "en": "the of and to in is was for it that on as with by at from are this be or an not have has had but they which were their one all there when than so no if then only after before because what each same into would".split(),
    "de": "der die das und in den von zu mit ist auf für nicht eine ein im dem des sich als auch es an werden aus er hat dass sie nach wird bei noch wie um am sind so nur aber war kein keine was wenn bis vor".split(),
    "fr": "le la les de des et en un une du est que dans pour qui au il a ne pas par sur plus ce avec se son sont cette aux mais ou elle on même donc car était sans tout ont été puis après avant".split(),
    "es": "el la los las de y en un una que es por con para del se no al lo como más su este esta pero sus le ya o fue entre porque muy sin sobre hay dos todo también son así cada donde antes".split(),
}

# classes of code points
LOWER, UPPER, OTHER_LETTER, DIGIT, SPACE, MARK, SYMBOL, CELL, VOWEL, KANA = range(10)
CLASSES = 10


@functools.cache
def char_classes() -> np.ndarray:
    t = category_table((("Ll", LOWER), ("Lu", UPPER), ("Lt", UPPER), ("L", OTHER_LETTER), ("Lo", OTHER_LETTER), ("M", OTHER_LETTER), ("N", DIGIT), ("Z", SPACE), ("Cc", SPACE), ("P", MARK), ("S", SYMBOL)), SYMBOL).copy()
    for c in "aeiouyàáâäåæèéêëìíîïòóôöøùúûüœ":
        t[ord(c)] = VOWEL
    for c in "AEIOUYÀÁÂÄÅÈÉÊËÌÍÎÒÓÔÖÙÚÛÜ":
        t[ord(c)] = VOWEL
    for c in "|│┃║\t;":
        t[ord(c)] = CELL
    for c in "#%&*/@\\_{}[]":
        t[ord(c)] = SYMBOL
    t[0x3041:0x3100] = KANA
    t[0xFFFD] = SYMBOL
    return t


@functools.cache
def common_hashes() -> np.ndarray:
    words = [w for ws in COMMON.values() for w in ws]
    codes, _ = code_points(words)
    s, e = word_spans(codes)
    return np.unique(span_hashes(codes, s, e))


def cut(x: np.ndarray, *edges: float) -> np.ndarray:
    return np.searchsorted(np.asarray(edges), x, side="right")


# The model's fixed values: for each observation, one row for each of its values, with the likelihood of
# the value in the states prose, list, table, junk (up to a factor common to the row).
EMISSIONS: dict[str, list[tuple[float, float, float, float]]] = {
    # line ends in: other, sentence mark, comma or semicolon, colon
    "ending": [(0.35, 0.55, 0.90, 0.85), (0.60, 0.04, 0.02, 0.10), (0.03, 0.35, 0.03, 0.03), (0.04, 0.02, 0.02, 0.02)],
    # begins like an entry: no, with a bullet, number or letter and a mark, or deeply indented
    "opening": [(0.985, 0.25, 0.985, 0.97), (0.015, 0.75, 0.015, 0.03)],
    # words: 0, 1-2, 3-5, 6-9, 10-24, 25 or more
    "words": [(0.01, 0.01, 0.05, 0.40), (0.03, 0.30, 0.12, 0.12), (0.06, 0.45, 0.20, 0.08), (0.15, 0.18, 0.28, 0.08), (0.50, 0.055, 0.30, 0.20), (0.25, 0.005, 0.05, 0.12)],
    # share of common words: none, under 0.12, under 0.25, more
    "common": [(0.03, 0.60, 0.88, 0.92), (0.10, 0.08, 0.06, 0.04), (0.30, 0.22, 0.04, 0.02), (0.57, 0.10, 0.02, 0.02)],
    # share of symbols among characters that are not white space: under 0.06, under 0.15, more
    "symbols": [(0.96, 0.93, 0.80, 0.40), (0.035, 0.06, 0.15, 0.20), (0.005, 0.01, 0.05, 0.40)],
    # separators of cells: none, one, two or more
    "cells": [(0.97, 0.88, 0.10, 0.85), (0.025, 0.11, 0.20, 0.10), (0.005, 0.01, 0.70, 0.05)],
    # share of punctuation and symbols among characters that are not white space: under 0.2, under 0.35, more
    "marks": [(0.985, 0.93, 0.85, 0.60), (0.01, 0.06, 0.12, 0.10), (0.005, 0.01, 0.03, 0.30)],
    # changes between letter and digit or small and capital within words, per character: under 0.05, under 0.15, more
    "scrambled": [(0.985, 0.97, 0.97, 0.45), (0.012, 0.025, 0.027, 0.15), (0.003, 0.005, 0.003, 0.40)],
    # share of digits: under 0.25, under 0.6, more
    "digits": [(0.97, 0.90, 0.55, 0.55), (0.025, 0.08, 0.30, 0.15), (0.005, 0.02, 0.15, 0.30)],
    # vowels among latin letters, in lines of some letters: fine, few, none, no letters
    "vowels": [(0.97, 0.96, 0.70, 0.25), (0.02, 0.03, 0.08, 0.20), (0.005, 0.005, 0.02, 0.30), (0.005, 0.005, 0.20, 0.25)],
    # kana and ideographs: no, yes, with a Japanese full stop
    "japanese": [(0.90, 0.97, 0.97, 0.97), (0.02, 0.03, 0.03, 0.03), (0.08, 0.001, 0.001, 0.001)],
    # times the same line occurs in the document: once, twice, three or more, so often that it makes up a quarter of its lines
    "repeats": [(0.9749, 0.9695, 0.949, 0.40), (0.02, 0.02, 0.03, 0.10), (0.005, 0.01, 0.02, 0.10), (0.0001, 0.0005, 0.001, 0.40)],
    # sentence ends within the line, a small letter at the line's start: neither, one, both
    "running": [(0.35, 0.75, 0.90, 0.85), (0.35, 0.245, 0.09, 0.14), (0.30, 0.005, 0.01, 0.01)],
    # wide gaps between words: none, one, two or more
    "gaps": [(0.98, 0.97, 0.50, 0.80), (0.015, 0.02, 0.10, 0.12), (0.005, 0.01, 0.40, 0.08)],
}
START = np.log(np.array([0.70, 0.12, 0.10, 0.08]))
STAY = 0.90


def _transitions() -> np.ndarray:
    t = np.full((4, 4), (1 - STAY) / 3)
    np.fill_diagonal(t, STAY)
    return np.log(t)


def viterbi(emission: np.ndarray, first: np.ndarray, count: np.ndarray, transition: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Most likely states of the sequences that take emission rows first to first + count; all at once, step by step."""
    order = np.argsort(-count, kind="stable")
    first, count = first[order], count[order]
    path = np.zeros(len(emission), np.int8)
    if not len(count) or not count[0]:
        return path
    back = np.zeros(emission.shape, np.int8)
    live = int(np.searchsorted(-count, 0, "left"))
    score = emission[first[:live]] + start
    ended = np.zeros((len(count), len(start)))
    for step in range(1, int(count[0]) + 1):
        go = int(np.searchsorted(-count, -step, "left"))  # sequences with more than ``step`` lines
        ended[go:live] = score[go:live]
        live = go
        if not live:
            break
        reach = score[:live, :, None] + transition
        best = reach.argmax(1)
        at = first[:live] + step
        back[at] = best
        score = np.take_along_axis(reach, best[:, None, :], 1)[:, 0] + emission[at]
    state = ended.argmax(1)
    for step in range(int(count[0]) - 1, -1, -1):
        go = int(np.searchsorted(-count, -step, "left"))
        at = first[:go] + step
        path[at] = state[:go]
        state[:go] = back[at, state[:go]]
    return path


def line_table(texts: list[str]) -> dict[str, np.ndarray]:
    """Statistics of all lines that are not blank, in order; ``doc`` is the index of the text."""
    codes, offsets = code_points(texts)
    cls = char_classes()[codes]
    is_break = (codes == 10) | (codes == 13) | (codes == 0x2028) | (codes == 0x85)
    line_of = np.cumsum(is_break) - is_break
    lines = int(line_of[-1]) + 1 if len(codes) else 0
    ends = np.flatnonzero(is_break)
    starts = np.concatenate([[0], ends[:-1] + 1])
    counts = np.bincount(line_of * CLASSES + cls, minlength=lines * CLASSES).reshape(lines, CLASSES)
    counts[np.arange(lines), cls[ends]] -= 1
    visible_at = np.flatnonzero((cls != SPACE) & (codes != 9))
    seen = np.unique(line_of[visible_at])
    head = visible_at[np.searchsorted(visible_at, starts[seen])]
    tail = visible_at[np.searchsorted(visible_at, ends[seen]) - 1]
    ws, we = word_spans(codes)
    hashes = _folded_hashes(codes, ws, we)
    table = common_hashes()
    where = np.minimum(np.searchsorted(table, hashes), len(table) - 1)
    word_line = line_of[ws]
    words = np.bincount(word_line, minlength=lines)
    common = np.bincount(word_line[table[where] == hashes], minlength=lines)
    word_chars = np.bincount(word_line, weights=(we - ws), minlength=lines)
    # sentence marks followed by white space within the line
    stop = (codes == 46) | (codes == 33) | (codes == 63) | (codes == 0x2026)
    inner = np.flatnonzero(stop[:-1] & (codes[1:] == 32)) if len(codes) > 1 else np.zeros(0, np.int64)
    inner = np.bincount(line_of[inner], minlength=lines)
    jstop = np.bincount(line_of[(codes == 0x3002) | (codes == 0xFF01) | (codes == 0xFF1F)], minlength=lines)
    # gaps of three or more blanks after something visible
    blank = codes == 32
    gap = np.flatnonzero(blank[3:] & blank[2:-1] & blank[1:-2] & ~blank[:-3]) if len(codes) > 3 else np.zeros(0, np.int64)
    gap = gap[~is_break[gap]]
    gaps = np.bincount(line_of[gap], minlength=lines)
    # a markup tag counts as a separator
    tag = np.flatnonzero((codes[:-1] == 60) & ((codes[1:] == 116) | (codes[1:] == 47))) if len(codes) > 1 else np.zeros(0, np.int64)
    tags = np.bincount(line_of[tag], minlength=lines)
    comma = np.flatnonzero((codes[:-1] == 44) & (codes[1:] != 32)) if len(codes) > 1 else np.zeros(0, np.int64)
    at = lambda k: np.minimum(comma + k, len(codes) - 1)
    thousands = (cls[comma - 1] == DIGIT) & (cls[at(1)] == DIGIT) & (cls[at(2)] == DIGIT) & (cls[at(3)] == DIGIT) & (cls[at(4)] != DIGIT) & (codes[at(4)] != 46)
    comma = comma[~thousands]
    point = np.flatnonzero((codes[1:-1] == 46) & (cls[2:] == DIGIT)) + 1 if len(codes) > 2 else np.zeros(0, np.int64)
    points = np.bincount(line_of[point], minlength=lines)
    commas = np.bincount(line_of[comma], minlength=lines)
    # marks of wrongly decoded text; a letter next to one or to a digit, or a capital after a small letter, in one word
    is_letter, is_small = (cls == LOWER) | (cls == UPPER) | (cls == VOWEL), (codes >= 97) & (codes <= 122)
    is_digit, is_capital = cls == DIGIT, (codes >= 65) & (codes <= 90)
    odd = (codes == 0x20AC) | (codes == 0xA4) | (codes == 0xFFFD) | (codes == 0xBF) & np.concatenate([[False], is_letter[:-1]])
    change = np.flatnonzero(is_letter[:-1] & is_digit[1:] | is_digit[:-1] & is_letter[1:] | is_small[:-1] & is_capital[1:] | is_letter[:-1] & odd[1:] | odd[:-1] & is_letter[1:])
    changes = np.bincount(line_of[change], minlength=lines)
    doc = np.searchsorted(offsets, starts[seen], side="right") - 1
    return {
        "doc": doc, "counts": counts[seen], "words": words[seen], "common": common[seen], "word_chars": word_chars[seen],
        "inner": inner[seen], "jstop": jstop[seen], "gaps": gaps[seen], "tags": tags[seen], "commas": commas[seen], "changes": changes[seen], "points": points[seen],
        "head": codes[head], "second": codes[np.minimum(head + 1, len(codes) - 1)], "third": codes[np.minimum(head + 2, len(codes) - 1)],
        "tail": codes[tail], "head_class": cls[head], "indent": head - starts[seen], "length": tail + 1 - head,
        "hash": span_hashes(codes, head, tail + 1), "before_tail": codes[np.maximum(tail - 1, 0)],
        "fourth": codes[np.minimum(head + 3, len(codes) - 1)],
    }


def _folded_hashes(codes: np.ndarray, ws: np.ndarray, we: np.ndarray) -> np.ndarray:
    low = codes.copy()
    upper = (codes >= 65) & (codes <= 90) | (codes >= 0xC0) & (codes <= 0xDE) & (codes != 0xD7)
    low[upper] += 32
    return span_hashes(low, ws, we)


def _one_of(x: np.ndarray, chars: str) -> np.ndarray:
    return np.isin(x, np.array([ord(c) for c in chars], np.uint32))


def observations(t: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    c = t["counts"].astype(float)
    letters = c[:, LOWER] + c[:, UPPER] + c[:, VOWEL]
    wide = c[:, OTHER_LETTER] + c[:, KANA]
    visible = np.maximum(c.sum(1) - c[:, SPACE], 1)
    sentence = _one_of(t["tail"], ".!?。！？…") | _one_of(t["tail"], "\"'»”’」)") & _one_of(t["before_tail"], ".!?。！？…")
    ending = np.where(sentence, 1, np.where(_one_of(t["tail"], ",;、"), 2, np.where(_one_of(t["tail"], ":："), 3, 0)))
    digit = lambda k: (t[k] >= 48) & (t[k] <= 57)
    small = lambda k: (t[k] >= 97) & (t[k] <= 122)
    close = lambda k: _one_of(t[k], ").:]")
    bullet = _one_of(t["head"], "-*•–—‣◦·+▪●○") & _one_of(t["second"], " \t")
    number = digit("head") & (close("second") | digit("second") & (close("third") | digit("third") & close("fourth")))
    number &= ~((t["second"] == 46) & digit("third")) & ~((t["third"] == 46) & digit("fourth"))
    bullet |= (t["head"] == 91) & _one_of(t["second"], " xX") & (t["third"] == 93)
    letter = (t["head"] == 40) & (small("second") | digit("second")) & ((t["third"] == 41) | (t["fourth"] == 41)) | small("head") & _one_of(t["second"], ").") & (t["third"] == 32)
    pair = t["doc"].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ t["hash"]
    _, back, times = np.unique(pair, return_inverse=True, return_counts=True)
    times = times[back.ravel()]
    much = (times >= 3) & (4 * times >= np.bincount(t["doc"])[t["doc"]])
    cells = c[:, CELL] - np.where(t["tail"] == 59, 1, 0) + t["tags"] + np.where(t["commas"] >= 2, t["commas"], 0)
    symbols = np.maximum(c[:, SYMBOL] - 2.5 * t["tags"], 0)  # angle brackets and slash of tags
    vowel = c[:, VOWEL] / np.maximum(letters, 1)
    running = (t["inner"] > 0).astype(int) + ((t["head_class"] == LOWER) | (t["head_class"] == VOWEL) & (t["head"] >= 97))
    return {
        "ending": ending,
        "opening": (bullet | number | letter).astype(int),
        "words": cut(t["words"], 1, 3, 6, 10, 25),
        "common": cut(t["common"] / np.maximum(t["words"], 1), 1e-9, 0.12, 0.25),
        "symbols": cut(symbols / visible, 0.06, 0.15),
        "marks": cut((symbols + c[:, MARK] - t["points"] - t["commas"]) / visible, 0.2, 0.35),
        "scrambled": cut(t["changes"] / visible, 0.05, 0.15),
        "cells": cut(cells, 1, 2),
        "digits": cut(c[:, DIGIT] / visible, 0.25, 0.6),
        "vowels": np.where(letters + wide < 4, 3, np.where((wide > letters) | (vowel > 0.25), 0, np.where(vowel > 0.16, 1, 2))),
        "japanese": np.where(wide > 0.3 * visible, 1 + (t["jstop"] > 0), 0),
        "repeats": np.where(much, 3, cut(times, 2, 3)),
        "running": running,
        "gaps": cut(t["gaps"], 1, 2),
    }


def emissions(t: dict[str, np.ndarray]) -> np.ndarray:
    """Log likelihood (lines x states); of a line that is repeated over and over nothing else counts."""
    seen = observations(t)
    out = np.zeros((len(t["doc"]), len(STATES)))
    for name, value in seen.items():
        out += np.log(np.array(EMISSIONS[name]))[value]
    return np.where((seen["repeats"] == 3)[:, None], np.log(np.array(EMISSIONS["repeats"]))[3], out)


COLUMNS = (
    "lines bigint, words bigint, mean_word_length double, symbol_ratio double, digit_ratio double, sentence_line_share double, "
    "common_word_share double, prose_share double, list_share double, table_share double, junk_share double, kind string"
)


def measure(texts: list[str], share: float) -> dict[str, np.ndarray]:
    """The statistics of each text, as arrays."""
    t = line_table(texts)
    n = len(texts)
    doc = t["doc"]
    count = np.bincount(doc, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    path = viterbi(emissions(t), first, count, _transitions(), START)
    size = np.bincount(doc * len(STATES) + path, weights=t["length"], minlength=n * len(STATES)).reshape(n, len(STATES))
    shares = size / np.maximum(size.sum(1), 1)[:, None]
    total = lambda x: np.bincount(doc, weights=x, minlength=n)
    words, c = total(t["words"]), t["counts"]
    visible = np.maximum(total(c.sum(1) - c[:, SPACE]), 1)
    top = shares[:, 1:].argmax(1) + 1
    kind = np.where(count == 0, 4, np.where(1 - shares[:, 0] >= share, top, 0))
    return {
        "lines": count, "words": words.astype(np.int64), "mean_word_length": np.where(words > 0, total(t["word_chars"]) / np.maximum(words, 1), 0.0),
        "symbol_ratio": total(c[:, SYMBOL] + c[:, CELL]) / visible, "digit_ratio": total(c[:, DIGIT]) / visible,
        "sentence_line_share": total(observations(t)["ending"] == 1) / np.maximum(count, 1), "common_word_share": total(t["common"]) / np.maximum(words, 1),
        **{f"{s}_share": shares[:, i] for i, s in enumerate(STATES)}, "kind": kind,
    }


def text_quality(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", share: float = 0.4) -> DataFrame:
    """One row for each row of documents, with the statistics of its text and the kind of it.

    kind is ``prose``, or the largest of ``list``, ``table`` and ``junk`` if lines that are not prose make
    up at least ``share`` of the characters, or ``blank`` for a text that is NULL or only white space (its
    counts and ratios are 0). A very long text is read whole; a row that occurs twice gives two rows.
    Other columns are not looked at. Each batch of rows is measured by itself.
    """
    schema = f"{doc_id} {dict(documents.dtypes)[doc_id]}, {COLUMNS}"
    names = np.array([*STATES, "blank"], object)

    def run(batches):
        for whole in batches:
            for batch in slices(whole, text, BATCH_BYTES):
                m = measure([x or "" for x in batch.column(1).to_pylist()], share)
                m["kind"] = names[m["kind"]]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v) for v in m.values())], names=[doc_id, *m])

    return spread(documents.select(doc_id, text)).mapInArrow(run, schema)
