"""Splitting oversized texts at natural boundaries."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowan.llm._arrays import slices

BATCH_BYTES = 8 << 20
# Marks at which a sentence may end.
SENTENCE_MARKS = ".!?。！？"
SPACE = re.compile(r"\s")
LEVELS = (
    ("paragraph", re.compile(r"(?:\r\n|\n|\r)[ \t]*(?:\r\n|\n|\r)\s*")),
    ("line", re.compile("(?:\r\n|[\n\r\x0b\x0c\x85\u2028\u2029])")),
    ("sentence", re.compile(r"[.!?]+[\"'»”’)\]]*\s+|[。！？]+[」』）]*\s*")),
    ("word", re.compile(r"\s+")),
    ("mark", re.compile(rf"[\s{SENTENCE_MARKS}]")),
)
TOKEN = re.compile(r"\w+|[^\w\s]+")


def sizes_before(text: str, unit: str) -> np.ndarray:
    """Prefix sums of size: entry i is the size of text[:i], in characters or in tokens begun."""
    if unit == "char":
        return np.arange(len(text) + 1)
    begins = np.zeros(len(text) + 1, np.int64)
    begins[[m.start() + 1 for m in TOKEN.finditer(text)]] = 1
    return np.cumsum(begins)


def boundaries(text: str) -> list[tuple[str, np.ndarray]]:
    """Sorted offsets at which the text may be cut, by level, the best level first.

    The last level has every offset next to white space or a sentence mark, on either side.
    """
    out = []
    for name, pattern in LEVELS[:-1]:
        out.append((name, np.array([m.end() for m in pattern.finditer(text)], np.int64)))
    at = np.array([m.start() for m in LEVELS[-1][1].finditer(text)], np.int64)
    out.append(("mark", np.union1d(at, at + 1)))
    return out


def split_text(text: str, most: int, overlap: int, unit: str = "char") -> list[tuple[int, int, str]]:
    """Pieces (start, end, boundary at the end) of at most ``most`` units that cover the text.

    Each piece begins ``overlap`` units before the end of the one before. It ends at the last boundary of
    the best level within its second half, else at the last boundary of any level beyond what is already
    covered. Where there is none, the piece begins later, with less overlap, if it then reaches one;
    otherwise it is cut hard at the limit. So a hard cut occurs only in a stretch without any boundary that
    is longer than the limit.
    """
    size = sizes_before(text, unit)
    n = len(text)
    if size[n] <= most:
        return [(0, n, "end")]
    levels = boundaries(text)
    every = levels[-1][1]
    pieces: list[tuple[int, int, str]] = []
    start = done = 0

    def reach(s: int) -> int:
        return int(np.searchsorted(size, size[s] + most, "right")) - 1

    def last(points: np.ndarray, limit: int) -> int:
        k = int(np.searchsorted(points, limit, "right")) - 1
        return int(points[k]) if k >= 0 else -1

    while True:
        limit = reach(start)
        if limit >= n:
            pieces.append((start, n, "end"))
            return pieces
        half = max(done, int(np.searchsorted(size, size[start] + most // 2, "left")))
        end, kind = -1, "hard"
        for name, points in levels:
            p = last(points, limit)
            if p > half:
                end, kind = p, name
                break
        if end < 0:
            p = last(every, limit)
            if p > done:
                end, kind = p, "mark"
        if end < 0:
            k = int(np.searchsorted(every, done, "right"))
            ahead = int(every[k]) if k < len(every) else n
            if size[ahead] - size[done] <= most:
                start = max(start, int(np.searchsorted(size, size[ahead] - most, "left")))
                start = min(start, done)
                limit = reach(start)
                end, kind = (n, "end") if limit >= n else (last(every, limit), "mark")
            else:
                end = max(limit, done + 1)
        pieces.append((start, end, kind))
        if end >= n:
            return pieces
        done = end
        start = min(done, max(start + 1, int(np.searchsorted(size, max(0, size[done] - overlap), "right")) - 1)) if overlap else done


RECORD = "chunk_id string, strategy string, unit string, char_start bigint, char_end bigint, char_count bigint, page_start bigint, page_end bigint, page_count bigint"


def split_oversized(states: DataFrame, policies: DataFrame, unit: str = "char") -> DataFrame:
    """Pieces of each state's text under its policy's limit, in order.

    Columns: state_id, piece (from 0), pieces, chunk_text, chunk_record, boundary (paragraph, line, sentence,
    word, mark, hard or end), overlap (units shared with the piece before), cut: ``none`` for a text within the
    limit, which stays one piece, ``hard`` if some piece had to be cut inside a stretch without white space
    or sentence mark, else ``soft``.

    A piece's record has the state's chunk_id with the piece's number, offsets into the same document
    (from the record's char_start, or 0 where it is missing), its true length, and the record's pages. Sizes are in code points
    or, with unit "token", in tokens of the word-and-punctuation tokenizer. A state_id that occurs several
    times is one state, the version that was ingested first. States with a NULL text, an empty one, or without a known policy
    have no rows; a policy without a limit of at least 1 is unknown, an overlap counts as at
    least 0 and less than the limit. policies is a small table.
    """
    rules = policies.select("policy_id", F.col("strategy").alias("_strategy"), F.col("max_chunk_size").alias("_most"), F.greatest(F.lit(0), F.least(F.coalesce("overlap", F.lit(0)), F.col("max_chunk_size") - 1)).alias("_overlap"))
    rules = rules.filter("_most >= 1").dropDuplicates(["policy_id"])
    one = (
        states.filter("chunk_text is not null and chunk_text != '' and policy_id is not null")
        .groupBy("state_id")
        .agg(F.min_by(F.struct("chunk_text", "chunk_record", "policy_id"), F.struct("ingested_at", F.xxhash64("chunk_text", "policy_id"))).alias("s"))
        .select("state_id", "s.*")
    )
    work = one.join(rules, "policy_id").select("state_id", "chunk_text", "_most", "_overlap", F.coalesce("_strategy", "chunk_record.strategy").alias("_strategy"), "chunk_record")
    kind = dict(states.dtypes)["state_id"]
    schema = f"state_id {kind}, piece bigint, pieces bigint, chunk_text string, chunk_record struct<{RECORD.replace(' ', ':').replace(',:', ',')}>, boundary string, overlap bigint, cut string"

    def run(batches):
        for whole in batches:
            for batch in slices(whole, "chunk_text", BATCH_BYTES):
                rows = []
                for sid, text, most, overlap, strategy, record in zip(*(batch.column(i).to_pylist() for i in range(6))):
                    record = record or {}
                    pieces = split_text(text, most, overlap, unit)
                    cut = "none" if len(pieces) == 1 else "hard" if any(k == "hard" for *_, k in pieces) else "soft"
                    base, before = record.get("char_start") or 0, 0
                    for i, (s, e, k) in enumerate(pieces):
                        own = {"chunk_id": f"{record.get('chunk_id') or 'chunk'}_{i}", "strategy": strategy, "unit": unit, "char_start": base + s, "char_end": base + e, "char_count": e - s, "page_start": record.get("page_start"), "page_end": record.get("page_end"), "page_count": record.get("page_count")}
                        rows.append({"state_id": sid, "piece": i, "pieces": len(pieces), "chunk_text": text[s:e], "chunk_record": own, "boundary": k, "overlap": before - s if i else 0, "cut": cut})
                        before = e
                yield pa.RecordBatch.from_pylist(rows, schema=target)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))
    return work.mapInArrow(run, schema)
