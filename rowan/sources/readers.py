"""Sources and sinks: CSV, Parquet, JSON, JSON lines, ORC; marker-row clean-up; CSV dialect sniffing."""

from __future__ import annotations

import csv
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowan.sources.pdf import read_pdf

# The delimiters a CSV source may use.
DELIMITERS = ",\t;|"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table by name."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sniff_delimiter(sample: str) -> str:
    """The delimiter of a CSV sample; a comma if none of the allowed ones fits."""
    try:
        return csv.Sniffer().sniff(sample, delimiters=DELIMITERS).delimiter
    except csv.Error:
        return ","


def _head(spark: SparkSession, path: str, lines: int = 20) -> str:
    if os.path.isfile(path):
        with open(path, encoding="utf-8-sig", errors="replace") as f:
            return "".join(x for _, x in zip(range(lines), f))
    return "\n".join(r.value for r in spark.read.text(path).limit(lines).collect())


def drop_marker_rows(df: DataFrame) -> DataFrame:
    """Without rows that hold a layout marker such as ``align = left|total`` in some cell."""
    text = [c for c, t in df.dtypes if t == "string"]
    if not text:
        return df
    marked = F.exists(F.array(*[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in text]), lambda c: c.rlike(r"(?i)^\s*align\s*=\s*\w+\s*\|"))
    return df.filter(~marked)


def _cells_span_lines(spark: SparkSession, path: str) -> bool:
    """Some line of a CSV has an odd number of quotation marks, so a cell goes on in the next line. One pass over the lines, in splits."""
    lines = spark.read.text(path)
    marks = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return not lines.filter(marks % 2 == 1).isEmpty()


def read_source(spark: SparkSession, path: str, fmt: str | None = None, schema=None, clean_markers: bool = False) -> DataFrame:
    """Read one source. fmt: csv, parquet/pq, json (one array or object), jsonl, orc, text; by default from the suffix.

    A CSV has a header, doubled quotes, cells that may span lines and one of the delimiters , tab ; |. It is read in splits unless some cell
    does span lines. A JSON file is one array or object, read whole; JSON lines are read in splits. A PDF gives its pages.
    clean_markers drops layout marker rows.
    """
    fmt = (fmt or os.path.splitext(path.rstrip("/"))[1].lstrip(".") or "parquet").lower()
    reader = spark.read if schema is None else spark.read.schema(schema)
    if fmt == "csv":
        df = reader.csv(path, header=True, inferSchema=schema is None, multiLine=_cells_span_lines(spark, path), escape='"', sep=sniff_delimiter(_head(spark, path)))
        first = df.columns[0]
        if first.startswith("﻿"):
            df = df.withColumnRenamed(first, first.lstrip("﻿"))
    elif fmt in ("parquet", "pq"):
        df = reader.parquet(path)
    elif fmt in ("json", "jsonl", "ndjson"):
        df = reader.json(path, multiLine=fmt == "json")
    elif fmt == "pdf":
        return read_pdf(spark, path)
    elif fmt in ("orc", "text"):
        df = getattr(reader, fmt)(path)
    else:
        raise ValueError(f"unknown source format: {fmt}")
    return drop_marker_rows(df) if clean_markers else df


def write_source(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "error", partition_by: list[str] | None = None) -> None:
    """Write df; fmt as in read_source, without text."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "csv":
        w.csv(path, header=True, escape='"')
    elif fmt in ("json", "jsonl", "ndjson"):
        w.json(path)
    elif fmt in ("parquet", "pq", "orc"):
        w.format("orc" if fmt == "orc" else "parquet").save(path)
    else:
        raise ValueError(f"unknown sink format: {fmt}")


def prepare(spark: SparkSession, path: str, source_id: str, chunk_size: int = 3000, overlap: int = 20, strategy: str = "sliding_window") -> dict:
    """What a planner is told of a source, and its data: a table (CSV, Parquet, JSON, ORC) with its schema and samples, or a document (PDF) with its chunks."""
    from rowan.operators import documents, profile

    kind = os.path.splitext(path.rstrip("/"))[1].lstrip(".").lower() or "parquet"
    if kind != "pdf":
        df = read_source(spark, path, kind, clean_markers=True)
        return {"kind": "table", "data": df, "about": profile.describe_source(df, source_id)}
    pages = read_source(spark, path, kind)
    chunks = documents.page_chunks(pages) if strategy == "page" else documents.document_chunks(pages, size=chunk_size, overlap=overlap)
    return {"kind": "document", "data": chunks, "about": {"id": source_id, "type": "document", "chunking": {"strategy": strategy, "size": chunk_size, "overlap": overlap}}}
