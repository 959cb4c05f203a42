"""Statistical and correlation evidence about a table."""

from __future__ import annotations

import math
from functools import reduce
from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from rowan.functions.coerce import to_number
from rowan.operators.ranks import average_ranks
from rowan.plans.expr import quoted
from rowan.session import cut_lineage, spread

# Evidence for a planner shows so many columns and pairs; the tables it is made of have all.
SHOWN_COLUMNS = 40
SHOWN_PAIRS = 20
EXTREMA = 3
# Ranks of a column with at most so many values are sent to all executors.
BROADCAST_VALUES = 100_000


def _num(df: DataFrame, c: str):
    return to_number(F.col(quoted(c))) if isinstance(df.schema[c].dataType, StringType) else F.col(quoted(c)).cast("double")


def numeric_columns(df: DataFrame) -> list[str]:
    """Number columns, and text columns in which some value reads as a number; one aggregation."""
    candidates = [c for c in df.columns if isinstance(df.schema[c].dataType, (NumericType, StringType))]
    if not candidates:
        return []
    r = df.agg(*[F.count(_num(df, c)).alias(f"n{i}") for i, c in enumerate(candidates)]).first()
    return [c for i, c in enumerate(candidates) if r[f"n{i}"]]


def statistical_evidence(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """One row for each numeric column: column, n, mean, median, min, max, std (of the sample, 0 of one value).

    One aggregation over all columns, turned into rows.
    """
    columns = columns or numeric_columns(df)
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, n bigint, mean double, median double, min double, max double, std double")
    packed = []
    wide = spread(df.select(*[_num(df, c).alias(f"x{i}") for i, c in enumerate(columns)]))
    for i, c in enumerate(columns):
        x = F.col(f"x{i}")
        std = F.when(F.count(x) > 1, F.stddev_samp(x)).when(F.count(x) == 1, F.lit(0.0))
        packed.append(F.struct(F.lit(c).alias("column"), F.count(x).alias("n"), F.avg(x).alias("mean"), F.median(x).alias("median"), F.min(x).alias("min"), F.max(x).alias("max"), std.alias("std")))
    return wide.agg(F.array(*packed).alias("m")).select(F.inline("m"))


def std_extrema(stats: DataFrame, lowest: bool = True) -> DataFrame:
    """The EXTREMA columns of least or most standard deviation."""
    order = F.col("std").asc_nulls_last() if lowest else F.col("std").desc_nulls_last()
    return stats.filter("std is not null").orderBy(order, "column").limit(EXTREMA)


def row_std_extrema(df: DataFrame, label: str, columns: list[str], lowest: bool = True) -> DataFrame:
    """The EXTREMA rows of least or most standard deviation across columns: label, std."""
    values = F.filter(F.array(*[_num(df, c) for c in columns]), lambda x: x.isNotNull())
    n = F.size(values)
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / n
    squares = F.aggregate(F.transform(values, lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda a, x: a + x)
    std = F.when(n > 1, F.sqrt(squares / (n - 1)))
    out = df.select(F.col(quoted(label)).cast("string").alias("label"), std.alias("std")).filter("std is not null")
    return out.orderBy(F.col("std").asc() if lowest else F.col("std").desc(), "label").limit(EXTREMA)


def correlation_evidence(df: DataFrame, columns: list[str] | None = None, most: int | None = None) -> DataFrame:
    """Pairs of numeric columns with n, pearson and spearman over rows in which both are there, by absolute pearson; ``most`` of them, or all.

    Pearson of all pairs is one aggregation. Ranks (of ties the average) within each pair's complete rows
    are computed for the pairs reported only, split by range of values (see ranks). Ranks of a column of few values are broadcast,
    so its frequent values stay where they are; those of other columns are joined by value.
    """
    columns = columns or numeric_columns(df)
    schema = "left string, right string, n bigint, pearson double, spearman double"
    pairs = list(combinations(columns, 2))
    if not pairs:
        return df.sparkSession.createDataFrame([], schema)
    wide = spread(df.select(*[_num(df, c).alias(f"x{i}") for i, c in enumerate(columns)]))
    at = {c: i for i, c in enumerate(columns)}
    best = _pair_correlations(wide, [(a, b, f"x{at[a]}", f"x{at[b]}") for a, b in pairs]).withColumnRenamed("r", "pearson").filter("n >= 2 and pearson is not null and not isnan(pearson)")
    best = best.orderBy(F.abs("pearson").desc(), "left", "right")
    best = cut_lineage(best if most is None else best.limit(most))
    rows = df.count()
    chosen = [(r.left, r.right, r.n == rows) for r in best.select("left", "right", "n").collect()]
    parts = []
    whole = sorted({c for a, b, complete in chosen if complete for c in (a, b)})
    if whole:  # without NULLs a column's ranks are the same in every pair
        long = wide.select(F.inline(F.array(*[F.struct(F.lit(at[c]).alias("c"), F.col(f"x{at[c]}").alias("v")) for c in whole])))
        ranks = cut_lineage(average_ranks(long, ["c"], "v"))
        values = dict(ranks.groupBy("c").count().collect())
        ranked = wide
        for i in sorted((at[c] for c in whole), key=lambda i: -values.get(i, 0)):
            own = ranks.filter(F.col("c") == i).select(F.col("v").alias(f"x{i}"), F.col("rank").alias(f"r{i}"))
            ranked = ranked.join(F.broadcast(own) if values.get(i, 0) <= BROADCAST_VALUES else own, f"x{i}")
        parts.append(_pair_correlations(ranked, [(a, b, f"r{at[a]}", f"r{at[b]}") for a, b, complete in chosen if complete]))
    gaps = [(a, b) for a, b, complete in chosen if not complete]
    if gaps:
        long = wide.select(F.inline(F.array(*[F.struct(F.lit(a).alias("left"), F.lit(b).alias("right"), F.col(f"x{at[a]}").alias("x"), F.col(f"x{at[b]}").alias("y")) for a, b in gaps]))).filter("x is not null and y is not null")
        both = [average_ranks(long, ["left", "right"], c).withColumnRenamed("rank", f"r{c}") for c in ("x", "y")]
        parts.append(long.join(both[0], ["left", "right", "x"]).join(both[1], ["left", "right", "y"]).groupBy("left", "right").agg(F.corr("rx", "ry").alias("r")))
    if not parts:
        return best.withColumn("spearman", F.lit(None).cast("double"))
    spearman = reduce(DataFrame.union, [p.select("left", "right", F.col("r").alias("spearman")) for p in parts])
    return best.join(spearman, ["left", "right"], "left").orderBy(F.abs("pearson").desc(), "left", "right")


def _pair_correlations(wide: DataFrame, pairs: list[tuple[str, str, str, str]]) -> DataFrame:
    """left, right, n, r of pairs (left, right, column, column) over rows in which both are there.

    Each row gives one row a pair, aggregated where it is, so that any number of pairs keeps to one small compiled aggregate.
    """
    rows = wide.select(F.inline(F.array(*[F.struct(F.lit(i).alias("p"), F.col(x).alias("x"), F.col(y).alias("y")) for i, (*_, x, y) in enumerate(pairs)])))
    out = rows.filter("x is not null and y is not null").groupBy("p").agg(F.count("*").alias("n"), F.corr("x", "y").alias("r"))
    name = lambda side: F.array(*[F.lit(p[side]) for p in pairs])[F.col("p")]
    return out.select(name(0).alias("left"), name(1).alias("right"), "n", "r")


def plain(v: float | int | None) -> float | int | None:
    """A number as evidence shows it: 12 digits, whole ones as int, nothing for what is not finite."""
    if v is None or not math.isfinite(v):
        return None
    v = round(float(v), 12)
    return int(v) if v.is_integer() else v


def evidence(df: DataFrame, kind: str) -> dict:
    """Evidence as a small dict: {kind, rows, cols, metrics, extrema?}."""
    kind = {"stat": "statistical", "stats": "statistical", "statistics": "statistical"}.get(kind.strip().lower(), kind.strip().lower())
    if kind not in ("statistical", "correlation"):
        raise ValueError(f"Unsupported evidence: {kind!r}")
    rows = lambda d: [{k: plain(v) if isinstance(v, (int, float)) else v for k, v in r.asDict().items()} for r in d.collect()]
    out: dict = {"kind": kind, "rows": df.count(), "cols": len(df.columns)}
    if kind == "correlation":
        return out | {"metrics": rows(correlation_evidence(df, most=SHOWN_PAIRS))}
    columns = numeric_columns(df)[:SHOWN_COLUMNS]
    metrics = rows(statistical_evidence(df, columns))
    ranked = sorted((m for m in metrics if m["std"] is not None), key=lambda m: (m["std"], m["column"]))
    out |= {"metrics": metrics, "extrema": {"columns": {"lowest": ranked[:EXTREMA], "highest": ranked[::-1][:EXTREMA]}}}
    labels = [c for c in df.columns if c not in columns]
    if labels and len(columns) > 1:
        out["extrema"]["rows"] = {side: rows(row_std_extrema(df, labels[0], columns, side == "lowest")) for side in ("lowest", "highest")}
    return out
