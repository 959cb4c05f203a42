"""Helpers for registered Python functions over pandas data (see operators.udf): numbers, times and lists from text."""

from __future__ import annotations

import json

import pandas as pd


def to_number(values: pd.Series) -> pd.Series:
    """Numbers in a column, without currency sign, thousands separators and percent; missing where a value is none."""
    if pd.api.types.is_numeric_dtype(values):
        return values
    return pd.to_numeric(values.astype("string").str.replace(r"[$,%\s]", "", regex=True), errors="coerce")


def to_datetime(values: pd.Series) -> pd.Series:
    """Times in a column; missing where a value is none."""
    return pd.to_datetime(values, errors="coerce", format="mixed")


def parse_list(values: pd.Series) -> pd.Series:
    """Lists in a column: lists as they are, texts that are a list in JSON, also with single quotes, as that list; other values as they are, blank texts as the empty list."""

    def one(v: object) -> object:
        if not isinstance(v, str):
            return v
        text = v.strip()
        for form in (text, text.replace("'", '"')) if text[:1] == "[" else ():
            try:
                return json.loads(form)
            except ValueError:
                continue
        return v if text else []

    return values.map(one)
