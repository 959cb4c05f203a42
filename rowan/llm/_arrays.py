"""Whole batches of texts as numpy arrays: code points, words, word hashes."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_ODD = np.uint64(0x9E3779B97F4A7C15)


@functools.cache
def word_char_table() -> np.ndarray:
    """True for code points that are letters or digits."""
    t = np.zeros(0x110000, bool)
    t[:0x10000] = [chr(i).isalnum() for i in range(0x10000)]
    for lo, hi in ((0x10000, 0x20000), (0x20000, 0x32000)):
        t[lo:hi] = [chr(i).isalnum() for i in range(lo, hi)]
    return t


@functools.cache
def category_table(plan: tuple[tuple[str, int], ...], default: int) -> np.ndarray:
    """Class of each code point of the basic plane by its general category; others by the same rule."""
    by = dict(plan)
    t = np.full(0x110000, default, np.uint8)
    for i in range(0x20000):
        c = unicodedata.category(chr(i))
        t[i] = by.get(c, by.get(c[0], default))
    t[0x20000:0x32000] = by["Lo"]
    return t


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        up = np.full(n, _ODD, np.uint64)
        up[0] = 1
        inverse = pow(int(_ODD), -1, 1 << 64)
        down = np.full(n, np.uint64(inverse), np.uint64)
        down[0] = 1
        return np.cumprod(up), np.cumprod(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """First n powers of an odd number and of its inverse, modulo 2**64."""
    size = 1 << max(16, (n - 1).bit_length())
    up, down = _powers(size)
    return up[:n], down[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64, copy=True)
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(27)
        x *= np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        return x


def code_points(texts: Iterable[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, a line feed after each; offset of each text and the end."""
    joined = "\n".join(texts) + "\n"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])]).astype(np.int64)


def word_spans(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of letters or digits. codes must end in something else."""
    is_word = word_char_table()[codes]
    edge = np.flatnonzero(is_word[1:] != is_word[:-1]) + 1
    if len(is_word) and is_word[0]:
        edge = np.concatenate([[0], edge])
    return edge[0::2], edge[1::2]


def span_hashes(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the code points of each span, the same wherever the span stands."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    up, down = powers(len(codes) + 1)
    with np.errstate(over="ignore"):
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * up[: len(codes)])])
        h = (total[ends] - total[starts]) * down[starts]
        return mix(h + (ends - starts).astype(np.uint64) * _ODD)


def slices(batch: pa.RecordBatch, text: str, most: int) -> Iterator[pa.RecordBatch]:
    """The batch cut into row ranges of at most about ``most`` bytes of text, one row at least."""
    column = batch.column(batch.schema.get_field_index(text))
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0))
    total, begin, used = len(sizes), 0, 0
    for i in range(total):
        if i > begin and used + sizes[i] > most:
            yield batch.slice(begin, i - begin)
            begin, used = i, 0
        used += int(sizes[i])
    if begin < total:
        yield batch.slice(begin)
