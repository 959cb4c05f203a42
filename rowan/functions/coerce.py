"""Tolerant reading of values in text tables, as column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, NumericType, StringType

NUMBER = r"([+-]?\s*(?:\d+(?:\.\d*)?|\.\d+))"
DATE_SHAPE = r"^\s*(\d{4}[-/.]\d{1,2}[-/.]\d{1,2}|\d{1,2}[-/.]\d{1,2}[-/.]\d{4})(?:[ T].*)?$"
TRUE_WORDS = ("true", "t", "yes", "y", "1")
FALSE_WORDS = ("false", "f", "no", "n", "0")

# strftime directives and the patterns that mean the same here (fixed values)
DATE_PATTERNS = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%y": "yy", "%b": "MMM", "%B": "MMMM", "%j": "DDD", "%p": "a", "%I": "hh", "%f": "SSSSSS", "%a": "EEE", "%A": "EEEE"}


def to_number(c: Column) -> Column:
    """The first number in a text, without thousands separators, percent and leading currency; NULL if there is none.

    A sign may stand apart from its digits. A text of digits only is not searched.
    """
    s = F.translate(F.trim(c.cast("string")), ",%", "")
    digits = (F.translate(s, "0123456789", "") == "") & (s != "")
    first = F.nullif(F.translate(F.regexp_extract(s, NUMBER, 1), " \t\r\n\x0b\f", ""), F.lit(""))  # a cast of what is no number costs an exception
    return F.when(digits, s).otherwise(first).try_cast("double")


def to_bool(c: Column) -> Column:
    """TRUE for true, t, yes, y, 1; FALSE for the opposites; NULL else."""
    s = F.lower(F.trim(c.cast("string")))
    return F.when(s.isin(*TRUE_WORDS), True).when(s.isin(*FALSE_WORDS), False)


def to_timestamp(c: Column) -> Column:
    """A date or time in one of the common shapes; NULL if it has none of them."""
    s = F.trim(c.cast("string"))
    tries = [s.try_cast("timestamp")] + [F.try_to_timestamp(s, F.lit(p)) for p in ("yyyy/M/d", "d/M/yyyy", "d-M-yyyy", "d.M.yyyy", "MMMM d, yyyy", "d MMMM yyyy", "MMM d, yyyy", "MMMM yyyy")]
    return F.coalesce(*tries)


def date_pattern(strftime: str) -> str:
    """A strftime format as a pattern of this engine."""
    return re.sub(r"%.|[A-Za-z']+", lambda m: DATE_PATTERNS.get(m[0], "") if m[0][0] == "%" else "'" + m[0].replace("'", "''") + "'", strftime)


def parse_list(c: Column) -> Column:
    """A text as a list: a literal list, {a,b}, or parts between commas; blanks dropped; NULL and blank give an empty list."""
    s = F.trim(c)
    inner = F.regexp_replace(s, r"^[\[{(]\s*|\s*[\])}]$", "")
    parts = F.transform(F.split(inner, ","), lambda x: F.regexp_replace(F.trim(x), r"^['\"]|['\"]$", ""))
    return F.coalesce(F.filter(parts, lambda x: x != ""), F.array().cast("array<string>"))


def split_list(c: Column, separator: str) -> Column:
    """Parts of a text between separators, trimmed, blanks dropped; a literal list is read as one."""
    plain = F.filter(F.transform(F.split(c, re.escape(separator).replace("\\ ", " ")), F.trim), lambda x: x != "")
    literal = F.trim(c).rlike(r"^[\[{].*[\]}]$")
    return F.when(c.isNull(), F.array().cast("array<string>")).when(literal, parse_list(c)).otherwise(plain)


def is_text(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, StringType)


def is_number(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (NumericType, BooleanType))


def all_numeric(df: DataFrame, names: list[str]) -> dict[str, bool]:
    """For text columns: every value that is not blank reads as a number, and there is one. One aggregation for all of them."""
    if not names:
        return {}
    aggs = []
    for i, n in enumerate(names):
        c = F.col(f"`{n}`")
        filled = F.nullif(F.trim(c), F.lit(""))
        aggs += [F.count(filled).alias(f"f{i}"), F.count(to_number(filled)).alias(f"n{i}")]
    r = df.agg(*aggs).first()
    return {n: r[f"f{i}"] > 0 and r[f"f{i}"] == r[f"n{i}"] for i, n in enumerate(names)}
