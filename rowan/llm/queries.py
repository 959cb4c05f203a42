"""Registered queries of this package, over whole tables with production parameters, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowan.llm.chunks import split_oversized
from rowan.llm.leakage import Leaks, leaked_passages
from rowan.llm.mixture import Mixture
from rowan.llm.pairs import defect_report, response_defects
from rowan.llm.quality import text_quality
from rowan.llm.sampling import StratifiedSamples, stable_sample
from rowan.session import ensure_checkpoint_dir
from rowan.sources import load

Query = Callable[[SparkSession, str], DataFrame]


def _samples(spark: SparkSession, d: str) -> StratifiedSamples:
    return StratifiedSamples(load(spark, d, "wikitq_cases"), load(spark, d, "sampling_plans"), load(spark, d, "sampling_quotas"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Quotas for which there are too few cases."""
    return _samples(spark, d).report().filter("available < required").select("plan_id", "stratum").distinct()


def p1_quotas(spark: SparkSession, d: str) -> DataFrame:
    """Required and available cases of each quota."""
    return _samples(spark, d).report().select("plan_id", "stratum", "required", "available")


def p1_report(spark: SparkSession, d: str) -> DataFrame:
    """Required, available and allotted cases of each quota, and why one falls short."""
    return _samples(spark, d).report()


def p1_sample(spark: SparkSession, d: str) -> DataFrame:
    """The cases drawn for each plan."""
    return _samples(spark, d).draw()


def p1_totals(spark: SparkSession, d: str) -> DataFrame:
    """Distinct cases drawn for each plan, and how many rows draw them."""
    return p1_sample(spark, d).groupBy("plan_id").agg(F.count_distinct("case_id").alias("cases"), F.count("*").alias("rows"))


def p2_stable_sample(spark: SparkSession, d: str) -> DataFrame:
    """The cases chosen for each plan's seed, the same as batches arrive."""
    return stable_sample(load(spark, d, "wikitq_cases"), load(spark, d, "sampling_plans"))


def p2_kept_lists(spark: SparkSession, d: str) -> DataFrame:
    """Lists opened on the batches up to 4 and kept in a table; the sample of all batches, and whether each case was in that of the opening."""
    cases, plans = load(spark, d, "wikitq_cases"), load(spark, d, "sampling_plans")
    lists = f"{ensure_checkpoint_dir(spark)}/bucket-lists-{uuid.uuid4().hex}"
    opening = stable_sample(cases.filter("batch_no <= 4"), plans, lists=lists).select("plan_id", "case_id", F.lit(True).alias("opening"))
    return stable_sample(cases, plans, lists=lists).join(opening, ["plan_id", "case_id"], "left").fillna(False, ["opening"])


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Texts beyond their limit, and whether they had to be cut hard."""
    return p3_pieces(spark, d).filter("cut != 'none'").select("state_id", "cut").distinct()


def p3_pieces(spark: SparkSession, d: str) -> DataFrame:
    """All pieces with their records."""
    return split_oversized(load(spark, d, "sandbox_states"), load(spark, d, "chunk_policies"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Defective answers and their defects."""
    return response_defects(load(spark, d, "builder_results"))


def p5_report(spark: SparkSession, d: str) -> DataFrame:
    """Number of answers with each defect."""
    return defect_report(load(spark, d, "builder_results"))


def _leaks(spark: SparkSession, d: str) -> Leaks:
    return leaked_passages(load(spark, d, "documents"), load(spark, d, "heldout_items"))


def p6_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Passages of held-out items in documents, also with up to two words changed, and how many items hold each."""
    return _leaks(spark, d).passages


def p6_members(spark: SparkSession, d: str) -> DataFrame:
    """The items that hold each passage that leaked."""
    leaks = _leaks(spark, d)
    return leaks.members.join(leaks.passages.select("passage").distinct(), "passage", "left_semi")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that share a passage with a held-out item word for word."""
    leaks = _leaks(spark, d)
    return leaks.passages.filter("exact").select("doc_id", "passage").join(leaks.members, "passage").select("doc_id", "item_id").distinct()


def p6_items(spark: SparkSession, d: str) -> DataFrame:
    """The items that leaked word for word, and into how many documents."""
    return p6_found(spark, d).groupBy("item_id").agg(F.count("*").alias("documents"))


def _mixture(spark: SparkSession, d: str, **options) -> Mixture:
    return Mixture(load(spark, d, "documents"), load(spark, d, "mixture_targets"), **options)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources too small for their share of a mixture."""
    return _mixture(spark, d).plan().filter("short").select("mixture_id", "source").distinct()


def p7_plan(spark: SparkSession, d: str) -> DataFrame:
    """Tokens that each source has, should give and is allotted."""
    return _mixture(spark, d).plan().withColumn("wanted_tokens", F.round("wanted_tokens", 6))


def p7_selection(spark: SparkSession, d: str) -> DataFrame:
    """The documents of each mixture and how often each is used."""
    return _mixture(spark, d).select()


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares that the selected documents reach."""
    return _mixture(spark, d).shares()


def p7_shares_same_text(spark: SparkSession, d: str) -> DataFrame:
    """Shares reached if documents of equal text are one record that belongs to all their sources."""
    return _mixture(spark, d, same_text=True).shares()


def p8_stats(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of each document's text."""
    return text_quality(load(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that are lists, tables or junk."""
    return p8_stats(spark, d).filter(F.col("kind").isin("list", "table", "junk")).select("doc_id", "kind").distinct()


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        p1_found, p1_report, p1_quotas, p1_sample, p1_totals, p2_stable_sample, p2_kept_lists, p3_found, p3_pieces, p5_found, p5_report,
        p6_found, p6_leaks, p6_members, p6_items, p7_found, p7_plan, p7_selection, p7_shares, p7_shares_same_text, p8_found, p8_stats,
    )
}
