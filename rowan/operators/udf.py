"""Registered Python functions over tables; text is never executed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

REGISTRY: dict[str, tuple[Callable, str, str]] = {}


def register(name: str, schema: str, kind: str = "table") -> Callable:
    """Decorator. kind ``table``: a function of one batch of rows to rows; ``group``: of one group's rows to rows (also a reduction)."""
    if kind not in ("table", "group"):
        raise ValueError(f"unknown kind: {kind}")

    def keep(f: Callable) -> Callable:
        REGISTRY[name] = (f, schema, kind)
        return f

    return keep


def apply(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """The result of a registered function; columns and types are those it was registered with. Groups are whole, so they must fit a task."""
    if name not in REGISTRY:
        raise ValueError(f"no function is registered as {name!r}")
    f, schema, kind = REGISTRY[name]
    if (kind == "group") != bool(by):
        raise ValueError(f"{name!r} works on {'groups' if kind == 'group' else 'rows, not groups'}")
    if by:
        return df.groupBy(*by).applyInPandas(f, schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield f(b)

    return df.mapInPandas(run, schema)


def same_but_literals(a: object, b: object) -> bool:
    """Two predicates of operator graphs that differ in values of literals only."""
    if isinstance(a, dict) and isinstance(b, dict):
        if a.get("type") == b.get("type") == "literal":
            return True
        return a.keys() == b.keys() and all(same_but_literals(a[k], b[k]) for k in a)
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(same_but_literals, a, b))
    return a == b


def rewritten(original: dict, new: dict) -> dict:
    """The new predicate, if it only changes literals of the original; else an error."""
    if not same_but_literals(original, new):
        raise ValueError("only literals of a predicate may be changed")
    return new
