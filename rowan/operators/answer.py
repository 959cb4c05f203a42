"""Typed answers from result tables."""

from __future__ import annotations

import datetime
import math
import re
from decimal import Decimal

from pyspark.sql import DataFrame

from rowan.functions.coerce import TRUE_WORDS

# Types an answer may have.
ANSWER_TYPES = ("boolean", "category", "date", "list", "list[category]", "list[number]", "list[string]", "number", "string", "table")
MOST_ROWS = 10_000


def scalar(v: object) -> object:
    """A plain value: whole doubles stay doubles, decimals become doubles, dates stay, NaN is nothing."""
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, float) and math.isnan(v):
        return None
    return v


def number(v: object) -> int | float | None:
    """A number, from a text the first one in it; whole ones as int."""
    if v is None or isinstance(v, bool):
        return None if v is None else int(v)
    if isinstance(v, str):
        s = re.sub(r"([+-])\s+(?=[\d.])", r"\1", v.strip().replace(",", "").replace("%", ""))
        m = re.search(r"[+-]?(?:\d+(?:\.\d*)?|\.\d+)", re.sub(r"^[^\d+\-.]+", "", s))
        if m is None:
            return None
        v = float(m[0])
    v = float(v)
    return int(v) if v.is_integer() else v


def boolean(v: object) -> bool:
    return v if isinstance(v, bool) else str(v).strip().lower() in TRUE_WORDS


def _row_text(values: list) -> str:
    return ", ".join(s for v in values if v is not None and (s := str(v).strip()))


def format_answer(df: DataFrame, name: str | None = None, kind: str = "json", most_rows: int = MOST_ROWS) -> object:
    """The answer of a result: {columns, rows} for a table, a list, or one value of the type.

    Of several columns a text answer joins the filled ones of each row; else the column called ``name``, or the
    last one, counts. No row gives an empty list or None. Only answers are read, so df must be small: more than most_rows is an error.
    """
    kind = kind.lower()
    many = kind == "table" or kind.startswith("list")
    rows = df.limit(most_rows + 1 if many else 1).collect()
    if len(rows) > most_rows:
        raise ValueError(f"an answer has more than {most_rows} rows")
    if kind == "table":
        return {"columns": df.columns, "rows": [{c: scalar(v) for c, v in zip(df.columns, r)} for r in rows]}
    if not rows:
        return [] if many else None
    if len(df.columns) > 1 and kind in ("string", "category", "list", "list[string]", "list[category]"):
        texts = [_row_text([scalar(v) for v in r]) for r in rows]
        return texts if many else texts[0]
    at = df.columns.index(name) if name in df.columns else len(df.columns) - 1
    values = [scalar(r[at]) for r in rows]
    if many:
        values = values[0] if len(values) == 1 and isinstance(values[0], list) else values
        return [number(v) for v in values] if kind == "list[number]" else values
    v = values[0]
    if kind == "boolean":
        return boolean(v)
    if kind in ("number", "integer", "int", "float"):
        return number(v)
    if kind in ("string", "category"):
        return None if v is None else str(v)
    if kind == "date" and isinstance(v, (datetime.date, datetime.datetime)):
        return v.isoformat()
    return v


def append_numeric_detail(answer: str, detail: str) -> str:
    """An answer without a number, with a detail that has one appended."""
    if re.search(r"\d", answer) or not re.search(r"\d", detail):
        return answer
    return f"{answer.rstrip().rstrip('.')} ({detail.strip()})"


def accepts(kind: str, value: object) -> bool:
    """Whether a value can stand as an answer of a type."""
    if value is None:
        return False
    if kind == "boolean":
        return isinstance(value, bool)
    if kind in ("number", "integer", "float"):
        return isinstance(value, (int, float)) and not isinstance(value, bool) and math.isfinite(value)
    if kind.startswith("list"):
        inner = kind[5:-1] if kind.endswith("]") else None
        return isinstance(value, list) and bool(value) and (inner is None or all(accepts(inner, v) for v in value))
    if kind == "table":
        return isinstance(value, dict) and {"columns", "rows"} <= value.keys()
    return isinstance(value, str) and bool(value.strip())
