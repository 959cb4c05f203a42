"""Stratified samples of exact size, and samples that stay as data grow."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rowan.functions.labels import key, label
from rowan.llm._flow import pooled_rounding, shared_amounts
from rowan.session import cut_lineage

BUCKET_BITS = 12
SMALL_ROWS = 1_000_000
BROADCAST_ROWS = 100_000


def collect_small(df: DataFrame, what: str, most: int = SMALL_ROWS) -> list:
    """Rows of a table that must be small; an error if it has more than ``most``."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what} has more than {most} rows")
    return rows


def from_driver(df: DataFrame, rows: list, schema: str) -> DataFrame:
    """Rows of the driver as a table, to be broadcast if there are at most BROADCAST_ROWS of them."""
    made = df.sparkSession.createDataFrame(rows, schema)
    return F.broadcast(made) if len(rows) <= BROADCAST_ROWS else made


def take_ranges(df: DataFrame, groups: list[str], random_key: str, tie: str, ranges: DataFrame) -> DataFrame:
    """Rows of stretches of each group's order by random key, with what their stretch is for.

    ranges: a small table of the groups, ``lo`` and ``hi`` (rows lo to hi - 1 of the order; stretches of a group do not overlap), and
    other columns, which the rows get. Keys are counted in 2**BUCKET_BITS buckets by their leading bits; rows of
    a bucket that lies in one stretch are taken without moving them, and only buckets in which a stretch begins or ends
    are sorted, so a group with most of the rows is still spread over its buckets. Ties of the key are broken by ``tie``.
    """
    more = [c for c in ranges.columns if c not in (*groups, "lo", "hi")]
    rows = df.join(ranges.select(*groups).distinct(), groups).withColumn("_bucket", F.shiftrightunsigned(F.col(random_key), 64 - BUCKET_BITS))
    counts = rows.groupBy(*groups, "_bucket").agg(F.count("*").alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy(*groups).orderBy("_bucket")) - F.col("_rows")
    met = counts.withColumn("_before", before).join(ranges, groups).filter("_before < hi and _before + _rows > lo")
    met = met.withColumn("_whole", F.expr("lo <= _before and _before + _rows <= hi"))
    whole = rows.join(met.filter("_whole").select(*groups, "_bucket", *more), [*groups, "_bucket"])
    at = F.col("_before") + F.row_number().over(Window.partitionBy(*groups, "_bucket").orderBy(random_key, tie)) - 1
    edges = met.filter("not _whole").select(*groups, "_bucket", "_before").distinct()
    split = rows.join(edges, [*groups, "_bucket"]).withColumn("_at", at).join(ranges, groups).filter("lo <= _at and _at < hi")
    return whole.unionByName(split.drop("_before", "_at", "lo", "hi")).drop("_bucket")


def spread(total: int, shares: list[int], lower: list[int], upper: list[int]) -> list[Fraction]:
    """Amounts in proportion to shares, within their bounds, that add up to ``total`` as nearly as the bounds allow."""
    n = len(shares)
    if sum(lower) >= total:
        return [Fraction(x) for x in lower]
    if sum(u for s, u in zip(shares, upper) if s > 0) + sum(lo for s, lo in zip(shares, lower) if s <= 0) <= total:
        return [Fraction(u if s > 0 else lo) for s, lo, u in zip(shares, lower, upper)]
    at = lambda f: [min(max(f * s, Fraction(lo)), Fraction(u)) for s, lo, u in zip(shares, lower, upper)]
    points = sorted({Fraction(x, s) for s, lo, u in zip(shares, lower, upper) if s > 0 for x in (lo, u)} | {Fraction(0)})
    below = max(p for p in points if sum(at(p)) <= total)
    # between two neighbouring points the amounts that lie within their bounds grow in proportion
    free = [i for i in range(n) if shares[i] > 0 and lower[i] <= below * shares[i] < upper[i]]
    slope = sum(shares[i] for i in free)
    return at(below + (Fraction(total) - sum(at(below))) / slope) if slope else at(below)


def required_rows(requested: int, quota: int, all_quotas: int, min_rows: int) -> int:
    return max(min_rows, requested * quota // all_quotas if all_quotas > 0 else 0)


class StratifiedSamples:
    """Samples that match target proportions of a category, for several plans at once.

    cases: rows with a case key, a category and a second margin; the same case may be in many rows.
    plans: plan_id, requested_size, seed. quotas: plan_id, stratum, quota, min_rows.

    Case keys are equal ignoring case and surrounding white space, categories as by ``labels.label``. A case
    of several categories is available in each of them and drawn for one, chosen by flow for each plan so that minimum
    rows and then quotas are met as far as the cases reach; rows
    without key or category are left out; a missing margin is a margin of its own, of several margins a case has the least. For each plan, targets
    in proportion to the quotas, raised to min_rows and lowered to what is there, fill requested_size as far
    as possible; the two-way table of category and margin is rounded so that both margins hold, and each
    cell's number of cases is taken by seeded random keys. Minimum rows win over requested_size. NULL quotas,
    minimums and sizes count as 0, a NULL seed as 0. An empty table gives empty samples and zero counts.
    Plans, quotas and the counts by set of categories and margin are read on the driver; more than SMALL_ROWS rows of one is an error.
    """

    def __init__(
        self,
        cases: DataFrame,
        plans: DataFrame,
        quotas: DataFrame,
        case_id: str = "case_id",
        stratum: str = "stratum",
        margin: str = "split",
    ):
        self.spark = cases.sparkSession
        self.plans = {r[0]: (max(0, int(r[1] or 0)), int(r[2] or 0)) for r in collect_small(plans.select("plan_id", "requested_size", "seed"), "plans")}
        wanted = quotas.select("plan_id", "stratum", "quota", "min_rows", label(F.col("stratum")).alias("label")).distinct()
        self.quotas = [r for r in collect_small(wanted, "quotas") if r.plan_id in self.plans]
        labels = sorted({r.label for r in self.quotas if r.label is not None})
        self.pairs = (
            cases.select(key(F.col(case_id)).alias("case_id"), label(F.col(stratum)).alias("stratum"), F.coalesce(F.col(margin).cast("string"), F.lit("")).alias("margin"))
            .filter("case_id is not null and stratum is not null")
            .join(from_driver(cases, [(x,) for x in labels], "stratum string"), "stratum")
        )

    def available(self) -> dict[str, int]:
        """Distinct cases of each category that some plan asks for."""
        out: dict[str, int] = {}
        for (pattern, _), n in self._cells().items():
            for s in pattern:
                out[s] = out.get(s, 0) + n
        return out

    def _cases(self) -> DataFrame:
        """Each case once, with the set of its categories (the pattern) and its margin."""
        if not hasattr(self, "_once"):
            self._once = self.pairs.groupBy("case_id").agg(F.array_sort(F.collect_set("stratum")).alias("pattern"), F.min("margin").alias("margin"))
        return self._once

    def _cells(self) -> dict[tuple, int]:
        """Cases of each pattern and margin."""
        if not hasattr(self, "_counted"):
            rows = collect_small(self._cases().groupBy("pattern", "margin").count(), "sets of categories and margins")
            self._counted = {(tuple(p), m): n for p, m, n in sorted(rows)}
        return self._counted

    def report(self) -> DataFrame:
        """For each quota: required, available and allotted cases; short where fewer are allotted than required, and why.

        reason: ``scarce`` (too few cases there are), ``shared`` (cases that it shares with other categories are used for them), or
        ``size`` (minimum rows of others use up the requested size).
        """
        have, rows = self.available(), []
        got: dict[tuple, int] = {}
        for (plan, _, _, s), n in self._allotted().items():
            got[plan, s] = got.get((plan, s), 0) + n
        for r in sorted(self.quotas, key=lambda r: (r.plan_id, r.stratum or "")):
            size = self.plans[r.plan_id][0]
            mine = [x for x in self.quotas if x.plan_id == r.plan_id]
            need = required_rows(size, max(0, r.quota or 0), sum(max(0, x.quota or 0) for x in mine), max(0, r.min_rows or 0))
            there, drawn = have.get(r.label, 0), got.get((r.plan_id, r.label), 0)
            filled = sum(n for (p, _), n in got.items() if p == r.plan_id) >= size
            reason = "scarce" if there < need else None if drawn >= need else "size" if filled else "shared"
            rows.append((r.plan_id, r.stratum, need, there, drawn, reason is not None, reason))
        return self.spark.createDataFrame(rows, "plan_id bigint, stratum string, required bigint, available bigint, allotted bigint, short boolean, reason string")

    def _allotted(self) -> dict[tuple, int]:
        """Cases to draw, by plan, pattern, margin and the category they are drawn for."""
        if hasattr(self, "_draws"):
            return self._draws
        self._draws = {}
        cells = self._cells()
        for plan, (size, _) in self.plans.items():
            asked = {r.label for r in self.quotas if r.plan_id == plan and r.label is not None}
            counts: dict[tuple, dict[str, int]] = {}
            for (pattern, m), n in cells.items():
                if asked & set(pattern):
                    counts.setdefault(pattern, {})[m] = n
            labels = sorted(asked & {s for p in counts for s in p})
            if not labels:
                continue
            margins = sorted({m for c in counts.values() for m in c})
            supply = {p: sum(c.values()) for p, c in counts.items()}
            mine = lambda s, f, plan=plan: sum(max(0, getattr(r, f) or 0) for r in self.quotas if (r.plan_id, r.label) == (plan, s))
            serves = {s: {p for p in counts if s in p} for s in labels}
            demand = [(s, serves[s], mine(s, "min_rows"), mine(s, "quota"), sum(supply[p] for p in serves[s])) for s in labels]
            parts = shared_amounts(supply, demand, size, spread)
            table = [[{p: parts[p, s] * counts[p][m] / supply[p] for p in serves[s] if (p, s) in parts and m in counts[p]} for m in margins] for s in labels]
            pools = {(p, j): counts[p].get(m, 0) for p in counts for j, m in enumerate(margins)}
            for s, row in zip(labels, pooled_rounding(table, pools)):
                for m, cell in zip(margins, row):
                    self._draws |= {(plan, p, m, s): n for p, n in cell.items() if n}
        return self._draws

    def draw(self) -> DataFrame:
        """plan_id, stratum, margin, case_id of the cases drawn; a case is drawn once for a plan, for the stratum named."""
        self._once = cut_lineage(self._cases())
        rows, at = [], {}
        for (plan, pattern, m, s), n in sorted(self._allotted().items()):
            lo = at.get((plan, pattern, m), 0)
            at[plan, pattern, m] = lo + n
            rows.append((plan, self.plans[plan][1], list(pattern), m, s, lo, lo + n))
        ranges = from_driver(self.pairs, [(p, c, m, s, lo, hi) for p, _, c, m, s, lo, hi in rows], "plan_id bigint, pattern array<string>, margin string, stratum string, lo bigint, hi bigint")
        wanted = sorted({(p, seed, tuple(c), m) for p, seed, c, m, *_ in rows})
        keyed = self._cases().join(from_driver(self.pairs, [(p, seed, list(c), m) for p, seed, c, m in wanted], "plan_id bigint, seed bigint, pattern array<string>, margin string"), ["pattern", "margin"])
        keyed = keyed.withColumn("_key", F.xxhash64("seed", "case_id"))
        return take_ranges(keyed, ["plan_id", "pattern", "margin"], "_key", "case_id", ranges).select("plan_id", "stratum", "margin", "case_id")


# ---------------------------------------------------------------- samples that stay as data grow


def key_bucket(record_key: Column, buckets: int) -> Column:
    """The bucket of a key, for good: the first 32 bits of its MD5 digest, so that any engine gives the same."""
    return F.conv(F.substring(F.md5(record_key), 1, 8), 16, 10).cast("bigint") % buckets


def bucket_order(seed: Column, bucket: Column) -> Column:
    """A plan's permutation of the buckets is their order by this, the first 60 bits of a digest, and by bucket."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", seed.cast("string"), bucket.cast("string"))), 1, 15), 16, 10).cast("bigint")


class BucketLists:
    """For each plan the buckets whose keys are in its sample: a beginning of the plan's permutation that only grows.

    lengths: how many buckets each list has, in the table at ``path``, to which rows are only ever appended; the greatest
    length written for a plan counts. A list is opened, or made longer, only while the buckets in it hold fewer keys than
    requested; whatever arrives later, in any batch, never makes it shorter, so a key that was chosen stays chosen.
    """

    def __init__(self, plans: DataFrame, buckets: int = 1 << 16, path: str | None = None):
        self.spark, self.buckets, self.path = plans.sparkSession, buckets, path
        sizes = plans.select("plan_id", F.coalesce("requested_size", F.lit(0)).cast("bigint").alias("size"), F.coalesce("seed", F.lit(0)).cast("bigint").alias("seed")).distinct()
        self.plans = sizes.filter("size > 0")

    def written(self) -> DataFrame:
        """plan_id, seed, length of the lists that were written for this number of buckets."""
        schema = "plan_id bigint, seed bigint, buckets bigint, length bigint"
        there = self.path is not None and _exists(self.spark, self.path)
        rows = self.spark.read.schema(schema).parquet(self.path) if there else self.spark.createDataFrame([], schema)
        return rows.filter(F.col("buckets") == self.buckets).groupBy("plan_id", "seed").agg(F.max("length").alias("length"))

    def _permuted(self) -> DataFrame:
        order = Window.partitionBy("plan_id", "seed").orderBy(bucket_order(F.col("seed"), F.col("bucket")), "bucket")
        rows = self.plans.withColumn("bucket", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(self.buckets - 1).cast("bigint"))))
        return rows.withColumn("position", F.row_number().over(order).cast("bigint"))

    def needed(self, keys: DataFrame) -> DataFrame:
        """plan_id, seed, bucket, position of the shortest lists that hold the requested size of the keys (column bucket)."""
        held = keys.groupBy("bucket").agg(F.count("*").alias("held"))
        before = F.sum("held").over(Window.partitionBy("plan_id", "seed").orderBy("position")) - F.col("held")
        rows = self._permuted().join(held, "bucket", "left").fillna(0, ["held"]).withColumn("before", before)
        return rows.filter("before < size").select("plan_id", "seed", "bucket", "position")

    def extended(self, keys: DataFrame) -> DataFrame:
        """plan_id, seed, length: the lists at the path, made long enough for the keys."""
        needed = self.needed(keys).groupBy("plan_id", "seed").agg(F.max("position").alias("needed"))
        both = needed.join(self.written(), ["plan_id", "seed"], "left")
        grown = both.filter("length is null or needed > length").select("plan_id", "seed", F.lit(self.buckets).cast("bigint").alias("buckets"), F.col("needed").alias("length"))
        if rows := collect_small(grown, "plans"):
            self.spark.createDataFrame(rows, grown.schema).coalesce(1).write.mode("append").parquet(self.path)
        return self.written().join(self.plans.select("plan_id", "seed"), ["plan_id", "seed"])

    def listed(self, lengths: DataFrame) -> DataFrame:
        """plan_id, bucket, position of the buckets in the lists."""
        return self._permuted().join(lengths, ["plan_id", "seed"]).filter("position <= length").select("plan_id", "bucket", "position")


def _exists(spark, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


def stable_sample(
    records: DataFrame,
    plans: DataFrame,
    record_key: str = "case_id",
    batch: str = "batch_no",
    buckets: int = 1 << 16,
    lists: str | None = None,
) -> DataFrame:
    """Samples by key that never lose a record as data grow: plan_id, case_id, first_batch, position.

    Each key belongs for good to one of ``buckets`` buckets. A plan's seed fixes an order of the buckets, and
    the plan's list is a beginning of that order. position is the place of the key's bucket in it.

    lists: a table in shared storage that keeps the lists from run to run and is only appended to (see BucketLists). At the first run it
    gets, for each plan, the shortest list that holds requested_size keys; later runs only lengthen it, so what was chosen stays chosen
    whatever rows are added, to any batch. Without it nothing is kept between runs, and the list is the shortest one that holds requested_size keys of
    the earliest batch: then batches later than the earliest never change it, but rows added to the earliest batch, or batches before it, may.
    In both cases the sample grows in proportion to the data.

    The result depends on keys, seeds and lists only, not on the order of rows or on
    partitions. Keys are equal ignoring case and surrounding white space; NULL and blank keys are left out,
    a NULL batch counts as later than any other. An empty table gives an empty sample; where there are fewer keys than requested, every bucket
    is in the list. A plan with another seed has another list.
    """
    last = (1 << 63) - 1
    keys = (
        records.select(key(F.col(record_key)).alias("case_id"), F.coalesce(F.col(batch).cast("bigint"), F.lit(last)).alias("first_batch"))
        .filter("case_id is not null")
        .groupBy("case_id")
        .agg(F.min("first_batch").alias("first_batch"))
        .withColumn("bucket", key_bucket(F.col("case_id"), buckets))
    )
    made = BucketLists(plans, buckets, lists)
    if lists is None:
        earliest = records.filter(key(F.col(record_key)).isNotNull()).agg(F.min(F.col(batch).cast("bigint"))).first()[0]
        listed = made.needed(keys.filter(F.col("first_batch") == F.lit(last if earliest is None else earliest))).drop("seed")
    else:
        listed = made.listed(made.extended(keys))
    chosen = keys.join(listed, "bucket")
    return chosen.select("plan_id", "case_id", F.when(F.col("first_batch") < last, F.col("first_batch")).alias("first_batch"), "position")
