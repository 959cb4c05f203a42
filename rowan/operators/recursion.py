"""Recursive union by deltas to a fixed point."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rowan.session import cut_lineage


def repeat_union(seed: DataFrame, step: Callable[[DataFrame], DataFrame], limit: int | None = None, keep_all: bool = False, most: int | None = None) -> DataFrame:
    """Rows of the seed and all rows that the step derives from rows new in the round before.

    With set semantics each round keeps only rows not seen yet (NULLs equal each other), found by an
    anti-join, and ends when there is none; keep_all keeps every row, and ends when a round gives none.
    A ``limit`` that is asked for ends it after so many rounds; without one it goes on to the fixed point. Rows still
    new after ``most`` rounds are an error, never a shorter result (keep_all, which may have no end, has 100 if neither
    is given). Each round's delta is checkpointed in the shared folder, so plans do
    not grow and lost executors do not repeat the rounds.
    """
    seen = [cut_lineage(seed if keep_all else seed.distinct())]
    delta = seen[0]
    if keep_all and limit is None and most is None:
        most = 100
    for done in count():
        if done == limit:
            break
        new = step(delta).toDF(*seed.columns)
        new = new.select(*[F.col(f"`{c}`").cast(seed.schema[c].dataType).alias(c) for c in seed.columns])
        if not keep_all:
            new = new.distinct()
            for old in seen:
                a, b = new.alias("a"), old.alias("b")
                same = reduce(lambda x, y: x & y, [F.col(f"a.`{c}`").eqNullSafe(F.col(f"b.`{c}`")) for c in seed.columns])
                new = a.join(b, same, "left_anti")
        delta = cut_lineage(new)
        if delta.isEmpty():
            break
        if done == most:
            raise RuntimeError(f"recursion still finds rows after {most} rounds")
        seen.append(delta)
        if len(seen) > 8 and not keep_all:  # few tables to compare with, each checked once a round
            seen = [cut_lineage(reduce(DataFrame.union, seen))]
    return reduce(DataFrame.union, seen)
