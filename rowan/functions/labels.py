"""Column expressions that bring keys and labels to one spelling."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def trimmed(c: Column) -> Column:
    """Surrounding white space of any kind removed (trim() knows only blanks)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def label(c: Column) -> Column:
    """A label: trimmed, lower case, blanks and hyphens as underscores; NULL if nothing is left."""
    s = F.regexp_replace(F.lower(trimmed(c)), "[ -]", "_")
    return F.when(s != "", s)


def key(c: Column) -> Column:
    """A key: trimmed, lower case; NULL if nothing is left."""
    s = F.lower(trimmed(c))
    return F.when(s != "", s)
