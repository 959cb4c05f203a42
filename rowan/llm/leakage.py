"""Evaluation passages inside a corpus: CGK embedding, bit-sampling LSH over windows, exact verification.

A text is a sequence of words (maximal runs of letters or digits, ignoring case). Items of at least
``window`` words are searched by their windows of that many words, shorter items of at least
``short_window`` words by windows of ``short_window`` words. Each window is embedded by the CGK random
walk: step j emits the word under a pointer and moves the pointer on if bit j of that word's hash is
set. Two windows at a small edit distance yield walks at a small Hamming distance, unless the walks drift
apart at the edit, which another walk with other bits seldom does too; equal windows yield equal walks.
So keys made of sampled steps of several walks always agree for equal windows, and nearly always some
agree for near ones.
Windows of which a key agrees are verified exactly by a banded edit distance over words.

Equal windows are one: those of items are classes, each with the set of items that own it (a passage), and those of a batch of
documents are looked up and verified once. So a passage that thousands of items share with thousands of documents is
one row for each document; items stand in a table of members.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowan.llm._arrays import code_points, mix, powers, slices, span_hashes, word_spans
from rowan.llm.sampling import from_driver
from rowan.session import spread

SEGMENT = 1 << 16
BATCH_BYTES = 8 << 20
CANDIDATES = 1 << 16
PAIRS = 1 << 21


def informative_steps(window: int) -> int:
    return window + window // 2


def walk_coordinates(window: int, sampled: int, repetitions: int, seed: int) -> np.ndarray:
    """Steps of the walk that each repetition samples, sorted.

    The pointer advances every second step on average, so most walks have left the window, and emit
    padding only, long before step 3 x window; steps are sampled from the first 1.5 x window.
    """
    rng = np.random.default_rng([seed, window])
    return np.stack([np.sort(rng.choice(informative_steps(window), sampled, replace=False)) for _ in range(repetitions)])


def walk_keys(words: np.ndarray, bits: list[np.ndarray], starts: np.ndarray, window: int, coordinates: np.ndarray) -> np.ndarray:
    """LSH keys (repetition x window) of the windows that begin at starts.

    words: 32-bit symbols, bits: for each walk 64 bits of each word; every window lies within them. The
    repetitions are dealt out to the walks in turn.
    """
    keys = np.zeros((len(coordinates), len(starts)), np.uint32)
    for g, own in enumerate(bits):
        keys[g :: len(bits)] = _one_walk(words, own, starts, window, coordinates[g :: len(bits)])
    return keys


def _one_walk(words: np.ndarray, bits: np.ndarray, starts: np.ndarray, window: int, coordinates: np.ndarray) -> np.ndarray:
    repetitions, sampled = coordinates.shape
    need: dict[int, list[tuple[int, int]]] = {}
    for r in range(repetitions):
        for k, j in enumerate(coordinates[r]):
            need.setdefault(int(j), []).append((r, k))
    keys = np.zeros((repetitions, len(starts)), np.uint32)
    end = starts + window
    at = starts.copy()
    factor = mix(np.arange(1, repetitions * sampled + 1, dtype=np.uint64)).astype(np.uint32) | np.uint32(1)
    step, pad = np.empty(len(starts), bits.dtype), np.uint32(0x5BD1E995)
    for j in range(int(coordinates.max()) + 1):
        # the pointer has moved j words at most, so it can't have left the window before step ``window``
        inside = at if j < window else np.minimum(at, end - 1)
        if j in need:
            symbol = words.take(inside)
            if j >= window:
                symbol[at >= end] = pad
            for r, k in need[j]:
                keys[r] += symbol * factor[r * sampled + k]
                keys[r] ^= keys[r] >> np.uint32(13)
        bits.take(inside, out=step, mode="clip")
        step >>= bits.dtype.type(j)
        step &= bits.dtype.type(1)
        at += step.astype(at.dtype, copy=False)
    return keys


def banded_distance(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Levenshtein distance of the columns of a and b (words x pairs), most + 1 where it is larger."""
    n, pairs = a.shape
    m = len(b)
    far = np.int8(most + 1)
    row = [np.full(pairs, min(j, most + 1), np.int8) for j in range(m + 1)]
    beyond = np.full(pairs, far)
    for i in range(1, n + 1):
        new = [beyond] * (m + 1)
        if i <= most:
            new[0] = np.full(pairs, i, np.int8)
        for j in range(max(1, i - most), min(m, i + most) + 1):
            new[j] = np.minimum(np.minimum(row[j - 1] + (a[i - 1] != b[j - 1]), np.minimum(row[j], new[j - 1]) + np.int8(1)), far)
        row = new
    return row[m]


def may_be_near(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """False where too few words of a (words x pairs) recur in b within the band for a distance of ``most``."""
    n = len(a)
    equal = np.zeros(a.shape[1], np.int8)
    for i in range(n):
        one = a[i] == b[i]
        for s in range(1, most + 1):
            if i >= s:
                one |= a[i] == b[i - s]
            if i + s < n:
                one |= a[i] == b[i + s]
        equal += one
    return equal >= n - most


def word_arrays(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in case-folded form; index of each text's first word, and the end."""
    codes, offsets = code_points([t.casefold() for t in texts])
    starts, ends = word_spans(codes)
    return span_hashes(codes, starts, ends), np.searchsorted(starts, offsets).astype(np.int64)


def window_hashes(words: np.ndarray, starts: np.ndarray, window: int) -> np.ndarray:
    """A 64-bit hash of the words of each window, the same wherever it stands."""
    up, down = powers(len(words) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * up[: len(words)])])
        return (total[starts + window] - total[starts]) * down[starts]


@dataclass
class _Windows:
    """The distinct windows of one length: where each begins, the passage (set of items) it is of, and what may be near it.

    near: for a window of one item of which another one, at most half a window away, is shared by items, the number of the nearest
    such window plus 1, else 0. first: the window begins some item.
    """

    window: int
    starts: np.ndarray
    passage: np.ndarray
    shared: np.ndarray
    near: np.ndarray
    first: np.ndarray


@dataclass
class _Tables:
    """LSH tables of windows: for each key the sorted values (key, near) and the windows in that order, and a bitmap of leading bits."""

    windows: _Windows
    coordinates: np.ndarray
    keys: list[tuple[np.ndarray, np.ndarray]]
    bitmap: list[np.ndarray]
    shift: np.uint32


class ItemIndex:
    """LSH tables of a block of items, of which those of equal words are one unit.

    short: sampled steps and repetitions of the windows of short_window words, which need other numbers for
    the same recall; by default those of the long ones.
    """

    def __init__(self, texts: list[str], window: int, short_window: int, sampled: int, repetitions: int, seed: int, walks: int = 4, short: tuple[int, int] | None = None):
        self.window, self.short_window = window, short_window
        words, offsets = word_arrays(texts)
        unit: dict[bytes, int] = {}
        self.unit_of = np.array([unit.setdefault(words[i:j].tobytes(), len(unit)) for i, j in zip(offsets, offsets[1:])], np.int64)
        kept = np.unique(self.unit_of, return_index=True)[1]
        self.words = np.concatenate([words[offsets[i] : offsets[i + 1]] for i in kept] or [words[:0]])
        self.offsets = np.concatenate([[0], np.cumsum(np.diff(offsets)[kept])]).astype(np.int64)
        self.keys, self.short_keys = (sampled, repetitions), short or (sampled, repetitions)
        self.seed, self.walks = seed, min(walks, repetitions, self.short_keys[1])

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("windows", "tables", "whole")}

    @functools.cached_property
    def windows(self) -> tuple[list[_Windows], list[np.ndarray]]:
        """The distinct windows, and the units of each passage; passages 0 to units - 1 are those of one unit."""
        lengths = np.diff(self.offsets)
        units = len(lengths)
        out, passages, known = [], [np.array([u]) for u in range(units)], {}
        for size, mine in ((self.window, lengths >= self.window), (self.short_window, (lengths >= self.short_window) & (lengths < self.window))):
            own = np.flatnonzero(mine)
            if not len(own):
                continue
            starts = np.concatenate([np.arange(self.offsets[u], self.offsets[u + 1] - size + 1) for u in own])
            owner = np.repeat(own, lengths[own] - size + 1)
            _, kept, number = np.unique(window_hashes(self.words, starts, size), return_index=True, return_inverse=True)
            span = np.arange(size)
            if any((self.words[starts + k] != self.words[starts[kept][number] + k]).any() for k in span):  # two windows of one hash
                _, kept, number = np.unique(self.words[starts[:, None] + span], axis=0, return_index=True, return_inverse=True)
                number = number.ravel()
            pairs = np.unique(number * units + owner)
            which, unit = np.divmod(pairs, units)
            edge = np.searchsorted(which, np.arange(len(kept) + 1))
            passage = unit[edge[:-1]].copy()
            shared = np.diff(edge) > 1
            for w in np.flatnonzero(shared):
                mine = unit[edge[w] : edge[w + 1]]
                if (k := mine.tobytes()) not in known:
                    known[k] = len(passages)
                    passages.append(mine)
                passage[w] = known[k]
            near = np.zeros(len(kept), np.int64)
            for step in sorted(range(-(size // 2), size // 2 + 1), key=abs, reverse=True)[:-1]:
                other = np.arange(len(starts)) + step
                there = (other >= 0) & (other < len(starts))
                there[there] = owner[other[there]] == owner[there]
                i = np.flatnonzero(there)
                i = i[shared[number[i + step]] & ~shared[number[i]]]
                near[number[i]] = number[i + step] + 1
            first = np.zeros(len(kept), bool)
            first[number[np.isin(starts, self.offsets[:-1])]] = True
            out.append(_Windows(size, starts[kept], passage, shared, near, first))
        return out, passages

    @functools.cached_property
    def tables(self) -> list[_Tables]:
        """Each Python worker builds them once; only the items' words are sent to it."""
        symbols, bits = self.symbols(self.words)
        out = []
        for w in self.windows[0]:
            coordinates = walk_coordinates(w.window, *(self.keys if w.window == self.window else self.short_keys), self.seed)
            tables, bitmaps = [], []
            shift = np.uint32(32 - min(22, max(12, (16 * len(w.starts)).bit_length())))
            for k in walk_keys(symbols, bits, w.starts, w.window, coordinates):
                value = (k.astype(np.uint64) << np.uint64(32)) | w.near.astype(np.uint64)
                order = np.argsort(value, kind="stable")
                tables.append((value[order], order))
                bitmap = np.zeros(1 << (32 - int(shift)), bool)
                bitmap[k >> shift] = True
                bitmaps.append(bitmap)
            out.append(_Tables(w, coordinates, tables, bitmaps, shift))
        return out

    @functools.cached_property
    def whole(self) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Short units by number of words: sorted hashes and the units."""
        lengths, out = np.diff(self.offsets), {}
        for n in range(self.short_window, self.window):
            units = np.flatnonzero(lengths == n)
            if len(units):
                h = window_hashes(self.words, self.offsets[units], n)
                order = np.argsort(h, kind="stable")
                out[n] = h[order], units[order]
        return out

    def symbols(self, words: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        seeds = mix(np.arange(self.walks, dtype=np.uint64) + np.uint64(self.seed))
        bits = [mix(words ^ s) for s in seeds]
        symbols = (words >> np.uint64(32)).astype(np.uint32)
        return symbols, [b.astype(np.uint32) for b in bits] if informative_steps(self.window) <= 32 else bits

    def matches(self, words: np.ndarray, offsets: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, ...]]:
        """(text, passage, word position, distance, exact) of verified windows."""
        symbols, bits = self.symbols(words)
        text_of = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        left = offsets[1:][text_of] - np.arange(len(words))
        for c in self.tables:
            for lo in range(0, len(words), SEGMENT):
                starts = lo + np.flatnonzero(left[lo : lo + SEGMENT] >= c.windows.window)
                if not len(starts):
                    continue
                # a segment's own arrays stay in the processor's cache
                last = int(starts[-1]) + c.windows.window
                keys = walk_keys(symbols[lo:last], [b[lo:last] for b in bits], (starts - lo).astype(np.int32), c.windows.window, c.coordinates)
                for at, passage, distance, is_first in self._segment(c, words[lo:last], text_of[lo:last], starts - lo, keys, most):
                    at = at + lo
                    exact = (distance == 0) & (c.windows.window == self.window)
                    yield text_of[at], passage, at - offsets[text_of[at]], distance, exact
                    if c.windows.window < self.window and is_first.any():
                        yield from self._whole_units(np.unique(at[is_first]), words, offsets, text_of, left)

    def _whole_units(self, at, words, offsets, text_of, left):
        """Short units of which all words stand at these positions."""
        for n, (hashes, units) in self.whole.items():
            here = at[left[at] >= n]
            if not len(here):
                continue
            base = int(here[0])
            h = window_hashes(words[base : int(here[-1]) + n], here - base, n)
            i = np.minimum(np.searchsorted(hashes, h), len(hashes) - 1)
            same = hashes[i] == h
            here, unit = here[same], units[i[same]]
            same = np.ones(len(here), bool)
            for k in range(n):
                same &= words[here + k] == self.words[self.offsets[unit] + k]
            here, unit = here[same], unit[same]
            yield text_of[here], unit, here - offsets[text_of[here]], np.zeros(len(here), np.int8), np.ones(len(here), bool)

    def _segment(self, c: _Tables, words: np.ndarray, texts: np.ndarray, starts: np.ndarray, keys: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, ...]]:
        """(position, passage, distance, whether a window that begins an item is there) of one segment of words.

        Windows of items next to a shared one (near > 0) come last, and not where the document has that shared window itself at hand: its
        items are found by it, word for word.
        """
        met = []
        seen = np.zeros(len(starts), bool)
        for k, (table, _), bitmap in zip(keys, c.keys, c.bitmap):
            on = np.flatnonzero(bitmap[k >> c.shift])
            a = np.searchsorted(table, k[on].astype(np.uint64) << np.uint64(32), "left")
            here = (table[np.minimum(a, len(table) - 1)] >> np.uint64(32)).astype(np.uint32) == k[on]
            here &= a < len(table)
            met.append(on[here])
            seen[on[here]] = True
        hits = np.flatnonzero(seen)
        if not len(hits):
            return
        content = window_hashes(words, starts[hits], c.windows.window)
        _, kept, back = np.unique(content, return_index=True, return_inverse=True)
        reps = hits[kept]
        bounds = [self._bounds(k[reps], table, np.isin(reps, m, assume_unique=True)) for k, (table, _), m in zip(keys, c.keys, met)]
        found = list(self._verified(c, words, starts, reps, [(r, a, m) for r, (a, m, _) in enumerate(bounds)], most))
        if found:
            yield self._placed(c, found, starts[hits], back)
        some = np.zeros(len(reps), bool)
        for _, m, b in bounds:
            some |= b > m
        left = np.flatnonzero(some[back])
        if not len(left):
            return
        name = np.zeros(len(reps), np.int64)
        for rep, w, distance in found:
            shared = (distance == 0) & c.windows.shared[w]
            name[rep[shared]] = w[shared] + 1
        here = name[back]
        shared_at = np.zeros(len(words), np.int64)
        shared_at[starts[hits[here > 0]]] = here[here > 0]
        at = starts[hits[left]]
        skip = np.zeros(len(left), np.int64)
        reach = c.windows.window // 2 + most
        for step in sorted(range(-reach, reach + 1), key=abs, reverse=True):
            other = np.clip(at + step, 0, len(words) - 1)
            skip = np.where((shared_at[other] > 0) & (texts[other] == texts[at]), shared_at[other], skip)
        pair, kept, again = np.unique(back[left] * (len(c.windows.starts) + 1) + skip, return_index=True, return_inverse=True)
        of, skip = back[left][kept], skip[kept].astype(np.uint64)
        ranges = []
        for r, (k, (table, _), (_, m, b)) in enumerate(zip(keys, c.keys, bounds)):
            m, b = m[of], b[of]
            value = k[reps[of]].astype(np.uint64) << np.uint64(32)
            x, y = m.copy(), m.copy()
            on = np.flatnonzero((skip > 0) & (b > m))
            x[on], y[on] = np.searchsorted(table, value[on] | skip[on], "left"), np.searchsorted(table, value[on] | (skip[on] + np.uint64(1)), "left")
            ranges += [(r, m, x), (r, y, b)]
        found = list(self._verified(c, words, starts, reps[of], ranges, most))
        if found:
            yield self._placed(c, found, at, again)

    @staticmethod
    def _bounds(keys: np.ndarray, table: np.ndarray, held: np.ndarray) -> tuple[np.ndarray, ...]:
        """Where the windows of each key begin in a table, where those begin that are near a shared one, and where they end."""
        value, on = keys.astype(np.uint64) << np.uint64(32), np.flatnonzero(held)
        out = tuple(np.zeros(len(keys), np.int64) for _ in range(3))
        for side, more in zip(out, (0, 1, 1 << 32)):
            side[on] = np.searchsorted(table, value[on] + np.uint64(more), "left")
        return out

    def _placed(self, c, found, positions, back):
        """Results of representatives, by passage, at all positions with the same words."""
        rep, w, distance = (np.concatenate(x) for x in zip(*found))
        passages = len(self.windows[1])
        pair, where = np.unique(rep * passages + c.windows.passage[w], return_inverse=True)
        least = np.full(len(pair), 127, np.int8)
        np.minimum.at(least, where, distance)
        first = np.zeros(len(pair), bool)
        np.logical_or.at(first, where, c.windows.first[w] & (distance == 0))
        rep, passage = np.divmod(pair, passages)
        order = np.argsort(back, kind="stable")
        edge = np.searchsorted(back[order], np.arange(int(back.max()) + 2))
        n = edge[rep + 1] - edge[rep]
        take = np.repeat(edge[rep] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        return positions[order[take]], np.repeat(passage, n), np.repeat(least, n), np.repeat(first, n)

    def _verified(self, c: _Tables, words, starts, reps, ranges, most) -> Iterator[tuple[np.ndarray, ...]]:
        """(representative, window, distance) of pairs of a representative and a window in its ranges (key, begin, end) at a distance of at most ``most``."""
        number = np.sum([b - a for _, a, b in ranges], axis=0)
        chunk = np.cumsum(number) // PAIRS  # a bounded number of pairs at a time
        total = len(c.windows.starts)
        for at in np.unique(chunk[number > 0]):
            mine = np.flatnonzero((chunk == at) & (number > 0))
            pairs = []
            for r, a, b in ranges:
                order = c.keys[r][1]
                n = b[mine] - a[mine]
                which = np.repeat(a[mine] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                pairs.append(np.repeat(mine, n) * total + order[which])
            pairs = np.sort(np.concatenate(pairs))
            pairs = pairs[np.concatenate([[True], pairs[1:] != pairs[:-1]])] if len(pairs) else pairs
            span = np.arange(c.windows.window)[:, None]
            for x in range(0, len(pairs), CANDIDATES):
                rep, w = np.divmod(pairs[x : x + CANDIDATES], total)
                a, b = words[starts[reps[rep]] + span], self.words[c.windows.starts[w] + span]
                near = np.flatnonzero(may_be_near(a, b, most))
                distance = banded_distance(a[:, near], b[:, near], most)
                keep = distance <= most
                if keep.any():
                    yield rep[near[keep]], w[near[keep]], distance[keep]


def repetitions_for(recall: float, window: int, sampled: int, hamming: int) -> int:
    """Repetitions with which windows whose walks differ in ``hamming`` steps share a key with that probability."""
    n = informative_steps(window)
    p = math.prod((n - hamming - i) / (n - i) for i in range(sampled))
    return max(1, math.ceil(math.log(1 - recall) / math.log(1 - p)))


@dataclass
class Leaks:
    """What was found: passages in documents, and the items that hold each passage.

    passages: doc_id, passage, items (how many hold it), exact, edits, windows, first_word. members: passage, item_id, item_words.
    """

    passages: DataFrame
    members: DataFrame
    doc_id: str
    item_id: str

    def pairs(self) -> DataFrame:
        """One row for each document and item: doc_id, item_id, item_words, exact, edits, windows, first_word."""
        rows = self.passages.drop("items").join(self.members, "passage")
        return rows.groupBy(self.doc_id, self.item_id).agg(
            F.max("item_words").alias("item_words"), F.max("exact").alias("exact"), F.min("edits").alias("edits"), F.sum("windows").alias("windows"), F.min("first_word").alias("first_word")
        )


def leaked_passages(
    documents: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "item_text",
    window: int = 12,
    short_window: int = 8,
    most_edits: int = 2,
    sampled: int = 5,
    recall: float = 0.98,
    hamming: int = 4,
    walks: int = 5,
    short_sampled: int = 3,
    short_hamming: int = 5,
    seed: int = 20260619,
    block_chars: int = 2_000_000,
) -> Leaks:
    """Passages of items that stand in documents: one row for each document and passage, and the passages' members.

    A passage is a set of items that share windows: most are of one item, or of items of equal text. Columns: exact (the document and
    the items share ``window`` words in a row, or, for an item of fewer words, all of its words in a row), edits (least edit distance in words
    of a window of the items to one of the document, 0 to most_edits), windows (number of windows of the document in which it was
    found), first_word (position in the document of the first).

    Items are the stated query set: they are read on the driver in blocks of block_chars characters, and
    each block's tables are searched by one pass over the documents; nothing of the documents leaves the
    executors. exact has full recall; windows with edits are found with the probability ``recall`` if their
    walks differ in at most ``hamming`` steps (for windows of ``short_window`` words, whose keys have
    short_sampled steps and repetitions of their own, short_hamming). Where a document holds a window that items share word for word, these
    items' windows within half a window of it are not compared with the words there again. A NULL text or item, or one of fewer than ``short_window``
    words, has no rows; equal items are members of the same passages. Rows repeated in the input do not repeat the result,
    an item_id with several texts is one item with all of them. Other columns are not looked at.
    """
    spark = documents.sparkSession
    repetitions = repetitions_for(recall, window, sampled, hamming)
    short = short_sampled, repetitions_for(recall, short_window, short_sampled, short_hamming)
    doc_kind, item_kind = dict(documents.dtypes)[doc_id], dict(items.dtypes)[item_id]
    schema = f"{doc_id} {doc_kind}, passage bigint, exact boolean, edits int, windows bigint, first_word bigint"
    docs = spread(documents.select(doc_id, text).filter(F.col(text).isNotNull()))

    def blocks() -> Iterator[tuple[list, list[str]]]:
        ids: list = []
        texts: list[str] = []
        used = 0
        for r in items.select(item_id, item_text).filter(F.col(item_text).isNotNull()).distinct().orderBy(item_id, item_text).toLocalIterator():
            if texts and used + len(r[1]) > block_chars:
                yield ids, texts
                ids, texts, used = [], [], 0
            ids.append(r[0])
            texts.append(r[1])
            used += len(r[1])
        if texts:
            yield ids, texts

    def search(shared, block: int):
        def run(batches):
            index = shared.value
            passages = len(index.windows[1])
            for whole in batches:
                for batch in slices(whole, text, BATCH_BYTES):
                    words, offsets = word_arrays(batch.column(1).to_pylist())
                    found = list(index.matches(words, offsets, most_edits))
                    if not found:
                        continue
                    doc, passage, at, distance, exact = (np.concatenate(x) for x in zip(*found))
                    pair, where = np.unique(doc * passages + passage, return_inverse=True)
                    edits = np.full(len(pair), most_edits + 1, np.int32)
                    np.minimum.at(edits, where, distance.astype(np.int32))
                    whole_match, first = np.zeros(len(pair), bool), np.full(len(pair), np.iinfo(np.int64).max)
                    np.logical_or.at(whole_match, where, exact)
                    np.minimum.at(first, where, at)
                    d, p = np.divmod(pair, passages)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).take(pa.array(d)), pa.array(p + (block << 32)), pa.array(whole_match), pa.array(edits), pa.array(np.bincount(where, minlength=len(pair)).astype(np.int64)), pa.array(first)],
                        names=[doc_id, "passage", "exact", "edits", "windows", "first_word"],
                    )

        return docs.mapInArrow(run, schema)

    found, members = [], []
    for block, (ids, texts) in enumerate(blocks()):
        index = ItemIndex(texts, window, short_window, sampled, repetitions, seed, walks, short)
        found.append(search(spark.sparkContext.broadcast(index), block))
        lengths = np.diff(index.offsets)
        of_unit: list[list[int]] = [[] for _ in lengths]
        for i, u in enumerate(index.unit_of):
            of_unit[u].append(i)
        passages = index.windows[1]
        rows = [((block << 32) + p, ids[i], int(lengths[u])) for p, units in enumerate(passages) for u in units if lengths[u] >= short_window for i in of_unit[u]]
        members.append(from_driver(items, rows, f"passage bigint, {item_id} {item_kind}, item_words bigint"))
    if not found:
        return Leaks(spark.createDataFrame([], schema.replace("passage bigint", "passage bigint, items bigint")), spark.createDataFrame([], f"passage bigint, {item_id} {item_kind}, item_words bigint"), doc_id, item_id)
    rows = functools.reduce(DataFrame.unionByName, found)
    rows = rows.groupBy(doc_id, "passage").agg(F.max("exact").alias("exact"), F.min("edits").alias("edits"), F.max("windows").alias("windows"), F.min("first_word").alias("first_word"))
    every = functools.reduce(DataFrame.unionByName, members)
    sizes = every.groupBy("passage").agg(F.count_distinct(item_id).alias("items"))
    return Leaks(rows.join(sizes, "passage").select(doc_id, "passage", "items", "exact", "edits", "windows", "first_word"), every, doc_id, item_id)
