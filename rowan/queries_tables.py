"""Registered queries of evidence, table understanding, documents, scores and checks, and their SQL."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowan.operators import documents as D
from rowan.operators import evidence as V
from rowan.operators import profile as P
from rowan.operators import udf
from rowan.operators.ranks import average_ranks
from rowan.operators.scoring import score_answers
from rowan.operators.verify import agrees, average_of_columns, ranked_target, relative_row
from rowan.session import ensure_checkpoint_dir
from rowan.sources import load, read_source, write_source

# the columns of lineitem in which some value reads as a number, as SQL must name them
NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
MEASURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c, t in df.dtypes if t == "double"})


def evidence_statistical(spark: SparkSession, d: str) -> DataFrame:
    return rounded(V.statistical_evidence(load(spark, d, "lineitem")), 4)


def evidence_correlation(spark: SparkSession, d: str) -> DataFrame:
    return rounded(V.correlation_evidence(load(spark, d, "lineitem")))


def evidence_row_extrema(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "lineitem").withColumn("label", F.concat_ws("-", "l_orderkey", "l_linenumber"))
    return rounded(V.row_std_extrema(df, "label", MEASURES, lowest=False), 4)


def average_rank(spark: SparkSession, d: str) -> DataFrame:
    return average_ranks(load(spark, d, "orders"), ["o_orderpriority"], "o_custkey")


def profile_columns(spark: SparkSession, d: str) -> DataFrame:
    return P.profile_columns(load(spark, d, "orders"))


def join_candidates(spark: SparkSession, d: str) -> DataFrame:
    tables = {t: load(spark, d, t) for t in ("customer", "nation", "region", "orders")}
    rows = P.join_candidates(tables, {"nation": {"n_nationkey"}, "customer": {"c_custkey"}, "region": {"r_regionkey"}})
    return spark.createDataFrame(rows, "left_table string, left_column string, right_table string, right_column string, score double, overlap bigint, left_coverage double, right_coverage double")


def join_paths(spark: SparkSession, d: str) -> DataFrame:
    rows = P.join_paths([r.asDict() for r in join_candidates(spark, d).collect()])
    flat = [(p["from"], p["to"], p["length"], p["score"], " | ".join(f"{j['left_table']}.{j['left_column']}={j['right_table']}.{j['right_column']}" for j in p["joins"])) for p in rows]
    return spark.createDataFrame(flat, "start string, goal string, length bigint, score double, joins string")


def value_grounding(spark: SparkSession, d: str) -> DataFrame:
    out = P.value_grounding({"nation": load(spark, d, "nation"), "customer": load(spark, d, "customer")}, "How many customers of the BUILDING segment live in NATION_3?")
    return out.withColumn("matches", F.array_join("matches", "|"))


def inspect_values(spark: SparkSession, d: str) -> DataFrame:
    return P.inspect(load(spark, d, "orders"), "values", "o_orderpriority")


# ---------------------------------------------------------------- documents


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """Paragraphs of documents as pages."""
    docs = load(spark, d, "documents").filter("text is not null")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n\n")).alias("page_index", "text")).withColumn("page_index", F.col("page_index").cast("bigint"))


def doc_join_pages(spark: SparkSession, d: str) -> DataFrame:
    return D.join_pages(_pages(spark, d)).select("doc_id", "text", F.size("spans").alias("pages"), F.element_at("spans", -1)["char_start"].alias("last_start"))


def doc_chunk_window(spark: SparkSession, d: str) -> DataFrame:
    return D.window_chunks(load(spark, d, "documents"), size=300, overlap=20)


def doc_chunk_span(spark: SparkSession, d: str) -> DataFrame:
    return D.document_chunks(_pages(spark, d), size=400, overlap=40).drop("text")


def doc_chunk_page(spark: SparkSession, d: str) -> DataFrame:
    return D.page_chunks(_pages(spark, d))


def doc_rank_chunks(spark: SparkSession, d: str) -> DataFrame:
    chunks = D.window_chunks(load(spark, d, "documents"), size=300, overlap=20)
    return D.rank_chunks(chunks, "Which plan groups rows by vote share and attendance?", 2).select("doc_id", "chunk_id", "score")


def _first_number(chunk: dict) -> dict:
    """A worker without a model: the first number of a chunk."""
    import re

    m = re.search(r"[0-9]{4}", chunk["text"])
    return {"answer": m[0] if m else None, "citation": None if m is None else chunk["text"][m.start() : m.end()]}


def doc_map_reduce(spark: SparkSession, d: str) -> DataFrame:
    chunks = D.window_chunks(load(spark, d, "documents"), size=300, overlap=20)
    outputs = D.map_reduce(chunks, D.MapReduceSpec([D.MapGroup("year", _first_number, replicas=2)]))
    return D.collect_evidence(outputs)


@udf.register("brand_prices", "p_brand string, parts long, dearest double", kind="group")
def _brand_prices(rows: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"p_brand": [rows.p_brand.iloc[0]], "parts": [len(rows)], "dearest": [rows.p_retailprice.max()]})


def udf_group(spark: SparkSession, d: str) -> DataFrame:
    return udf.apply(load(spark, d, "part").select("p_brand", "p_retailprice"), "brand_prices", by=["p_brand"])


# ---------------------------------------------------------------- scores and checks


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """Question-like pairs made of parts' names: the same in other spelling, or cut."""
    return load(spark, d, "part").select("p_partkey", F.concat("p_name", F.lit(" "), "p_type").alias("expected"), F.when(F.col("p_partkey") % 2 == 0, F.upper(F.concat(F.lit("  "), "p_name", F.lit(" "), "p_type", F.lit(". ")))).otherwise(F.col("p_name")).alias("actual"))


def score_em(spark: SparkSession, d: str) -> DataFrame:
    return score_answers(_answers(spark, d), "EM").select("p_partkey", "score")


def score_rouge(spark: SparkSession, d: str) -> DataFrame:
    return rounded(score_answers(_answers(spark, d), "ROUGE-L").select("p_partkey", "score"))


def score_denotation(spark: SparkSession, d: str) -> DataFrame:
    df = load(spark, d, "part").select("p_partkey", F.concat_ws("; ", "p_brand", F.col("p_size").cast("string")).alias("expected"), F.concat_ws("; ", F.format_string("%d.0", "p_size"), F.when(F.col("p_size") % 3 == 0, F.lower("p_type")).otherwise(F.lower("p_brand"))).alias("actual"))
    return score_answers(df, "denotation_em").select("p_partkey", "score")


def check_relative_row(spark: SparkSession, d: str) -> DataFrame:
    return relative_row(load(spark, d, "orders"), ["o_orderdate", "o_orderkey"], "o_orderpriority", "1-URGENT", "o_orderkey", 1, ["o_custkey"])


def check_relative_row_whole_order(spark: SparkSession, d: str) -> DataFrame:
    """The order after each urgent one, in the order of the whole table."""
    return relative_row(load(spark, d, "orders"), ["o_orderdate", "o_orderkey"], "o_orderpriority", "1-URGENT", "o_orderkey", 1)


def check_ranked_target(spark: SparkSession, d: str) -> DataFrame:
    return rounded(ranked_target(load(spark, d, "part"), "p_partkey", "p_retailprice", "p_size"), 4)


def check_average_columns(spark: SparkSession, d: str) -> DataFrame:
    return rounded(average_of_columns(load(spark, d, "lineitem"), ["l_discount", "l_tax"]))


def check_facts(spark: SparkSession, d: str) -> DataFrame:
    """For each nation, whether its number of customers is the sum of those by segment, and its mean balance what two facts give."""
    c = load(spark, d, "customer")
    parts = c.groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n")).groupBy("c_nationkey").agg(F.sort_array(F.collect_list("n")).alias("parts"), F.sum("n").alias("n"))
    rows = parts.orderBy("c_nationkey").collect()  # one row a nation
    out = [(r.c_nationkey, agrees("number", "sum", r.parts, f"{r.n:,} customers"), agrees("number", "difference", [r.n, r.parts[0]], r.n), agrees("boolean", "ge", [r.n, r.parts[-1]], "yes")) for r in rows]
    return spark.createDataFrame(out, "c_nationkey bigint, total boolean, difference boolean, most boolean")


def _written(spark: SparkSession, df: DataFrame, fmt: str) -> DataFrame:
    """A table written in a format to the shared folder, and read again."""
    path = f"{ensure_checkpoint_dir(spark)}/written-{uuid.uuid4().hex}.{fmt}"
    write_source(df, path, fmt)
    return read_source(spark, path, fmt)


def source_csv(spark: SparkSession, d: str) -> DataFrame:
    return _written(spark, load(spark, d, "customer").select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), "csv")


def source_jsonl(spark: SparkSession, d: str) -> DataFrame:
    return _written(spark, load(spark, d, "part").select("p_partkey", "p_name", "p_type"), "jsonl")


def source_orc(spark: SparkSession, d: str) -> DataFrame:
    return _written(spark, load(spark, d, "nation"), "orc")


QUERIES = {
    f.__name__: f
    for f in (
        evidence_statistical, evidence_correlation, evidence_row_extrema, average_rank, profile_columns, join_candidates, join_paths, value_grounding, inspect_values, doc_join_pages, doc_chunk_window, doc_chunk_span,
        doc_chunk_page, doc_rank_chunks, doc_map_reduce, udf_group, score_em, score_rouge, score_denotation, check_relative_row, check_relative_row_whole_order, check_ranked_target, check_average_columns,
        check_facts, source_csv, source_jsonl, source_orc,
    )
}

_PAGES = """pages AS (SELECT doc_id, CAST(i - 1 AS BIGINT) AS page_index, parts[i] AS text FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS parts FROM documents WHERE text IS NOT NULL))),
bodies AS (SELECT doc_id, page_index, '[Page ' || page_index || ']' || chr(10) || text AS body FROM pages),
placed AS (SELECT *, CAST(sum(length(body) + 2) OVER (PARTITION BY doc_id ORDER BY page_index) - 2 AS INTEGER) AS char_end FROM bodies)"""
_WINDOWS = """chunks AS (SELECT doc_id, 'chunk_' || ((s // 280)) AS chunk_id, 'sliding_window' AS strategy, 'char' AS unit, CAST(s AS INTEGER) AS char_start, CAST(least(s + 300, length(t)) AS INTEGER) AS char_end,
  CAST(least(s + 300, length(t)) - s AS INTEGER) AS char_count, substring(t, s + 1, least(s + 300, length(t)) - s) AS text FROM (SELECT doc_id, t, unnest(range(0, greatest(length(t) - 20 - 1, 0) + 1, 280)) AS s FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)))"""
_PHRASES = f"[{', '.join(repr(p) for p in D.PHRASES)}]"
_STAT = "SELECT '{0}' AS \"column\", count({0}) AS n, round(avg({0}), 4) AS mean, round(median({0}), 4) AS median, round(min({0}), 4) AS min, round(max({0}), 4) AS max, round(stddev_samp({0}), 4) AS std FROM lineitem"
_PAIR = """
SELECT '{0}' AS "left", '{1}' AS "right", count(*) AS n, round(corr(x, y), 6) AS pearson, round(corr(rx, ry), 6) AS spearman FROM (
  SELECT {0} AS x, {1} AS y, rank() OVER (ORDER BY {0}) + (count(*) OVER (PARTITION BY {0}) - 1) / 2.0 AS rx, rank() OVER (ORDER BY {1}) + (count(*) OVER (PARTITION BY {1}) - 1) / 2.0 AS ry FROM lineitem)"""

ORACLES = {
    "evidence_statistical": "\nUNION ALL ".join(_STAT.format(c) for c in NUMBERS),
    "evidence_correlation": "\nUNION ALL ".join(_PAIR.format(a, b) for i, a in enumerate(NUMBERS) for b in NUMBERS[i + 1 :]),
    "evidence_row_extrema": """
SELECT l_orderkey || '-' || l_linenumber AS label, round(list_stddev_samp([l_quantity, l_extendedprice, l_discount, l_tax]), 4) AS std FROM lineitem ORDER BY list_stddev_samp([l_quantity, l_extendedprice, l_discount, l_tax]) DESC, label LIMIT 3""",
    "average_rank": "SELECT DISTINCT o_orderpriority, o_custkey, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_orderpriority, o_custkey) - 1) / 2.0 AS rank FROM orders",
    "profile_columns": """
SELECT 'o_orderkey' AS "column", 'number' AS kind, count(*) AS filled, count(*) AS numbers, min(o_orderkey::VARCHAR) AS low, max(o_orderkey::VARCHAR) AS high FROM orders
UNION ALL SELECT 'o_custkey', 'number', count(*), count(*), min(o_custkey::VARCHAR), max(o_custkey::VARCHAR) FROM orders
UNION ALL SELECT 'o_orderstatus', 'string', count(*), 0, min(o_orderstatus), max(o_orderstatus) FROM orders
UNION ALL SELECT 'o_totalprice', 'number', count(*), count(*), min(o_totalprice::VARCHAR), max(o_totalprice::VARCHAR) FROM orders
UNION ALL SELECT 'o_orderdate', 'string', count(*), 0, min(o_orderdate::VARCHAR), max(o_orderdate::VARCHAR) FROM orders
UNION ALL SELECT 'o_orderpriority', 'string', count(*), 0, min(o_orderpriority), max(o_orderpriority) FROM orders""",
    "inspect_values": "SELECT o_orderpriority AS value, count(*) AS count FROM orders GROUP BY 1",
    "doc_join_pages": f"WITH {_PAGES} SELECT doc_id, string_agg(body, chr(10) || chr(10) ORDER BY page_index) AS text, CAST(count(*) AS INTEGER) AS pages, CAST(max(char_end - length(body)) AS INTEGER) AS last_start FROM placed GROUP BY doc_id",
    "doc_chunk_window": f"WITH {_WINDOWS} SELECT * FROM chunks",
    "doc_chunk_span": f"""
WITH {_PAGES}, joined AS (SELECT doc_id, max(char_end) AS n FROM placed GROUP BY doc_id),
c AS (SELECT doc_id, CAST(s AS INTEGER) AS char_start, CAST(least(s + 400, n) AS INTEGER) AS char_end FROM (SELECT doc_id, n, unnest(range(0, greatest(n - 40 - 1, 0) + 1, 360)) AS s FROM joined))
SELECT c.doc_id, 'chunk_' || (c.char_start // 360) AS chunk_id, 'sliding_window' AS strategy, 'char' AS unit, c.char_start, c.char_end, c.char_end - c.char_start AS char_count,
  min(p.page_index) AS page_start, max(p.page_index) AS page_end, max(p.page_index) - min(p.page_index) + 1 AS page_count
FROM c LEFT JOIN placed p ON p.doc_id = c.doc_id AND p.char_end - length(p.body) < c.char_end AND p.char_end > c.char_start GROUP BY c.doc_id, c.char_start, c.char_end""",
    "doc_chunk_page": f"""
WITH {_PAGES} SELECT doc_id, 'chunk_' || page_index AS chunk_id, 'page' AS strategy, 'page' AS unit, CAST(char_end - length(body) AS INTEGER) AS char_start, char_end, CAST(length(body) AS INTEGER) AS char_count,
  page_index AS page_start, page_index AS page_end, 1 AS page_count, body AS text FROM placed""",
    "doc_rank_chunks": f"""
WITH {_WINDOWS}, s AS (SELECT *, len(list_intersect(list_distinct(regexp_extract_all(lower(text), '[a-z][a-z0-9&%-]{{2,}}')), ['which', 'plan', 'groups', 'rows', 'vote', 'share', 'and', 'attendance'])) + 3 * len(list_filter({_PHRASES}, lambda p: contains(lower(text), p))) AS score FROM chunks),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY char_start) - 1 AS i, count(*) OVER (PARTITION BY doc_id) AS n, max(score) OVER (PARTITION BY doc_id) AS best, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, char_start) AS k FROM s)
SELECT doc_id, chunk_id, CAST(score AS INTEGER) AS score FROM r WHERE n <= 2 OR (best > 0 AND k <= 2) OR (best = 0 AND (i = 0 OR i = n - 1))""",
    "doc_map_reduce": f"""
WITH {_WINDOWS}, a AS (SELECT doc_id, nullif(regexp_extract(text, '[0-9]{{4}}'), '') AS answer FROM chunks)
SELECT 'year' AS task, doc_id, 2 * count(*) AS outputs, 2 * count(answer) AS included, 0 AS failed, coalesce(string_agg(DISTINCT answer, chr(10) ORDER BY answer), '') AS summary FROM a GROUP BY doc_id""",
    "check_facts": """
WITH p AS (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY ALL)
SELECT c_nationkey, true AS total, min(n) = 0 AS difference, sum(n) >= max(n) AS most FROM p GROUP BY c_nationkey""",
    "source_csv": "SELECT c_custkey, c_name, c_acctbal, c_mktsegment FROM customer",
    "source_jsonl": "SELECT p_partkey, p_name, p_type FROM part",
    "source_orc": "SELECT * FROM nation",
    "udf_group": "SELECT p_brand, count(*) AS parts, max(p_retailprice) AS dearest FROM part GROUP BY p_brand",
    "score_em": "SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 1.0 ELSE 0.0 END AS score FROM part",
    "score_denotation": "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 0.0 ELSE 1.0 END AS score FROM part",
    "check_relative_row": "SELECT o_custkey, nxt AS o_orderkey FROM (SELECT o_custkey, o_orderpriority, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS nxt FROM orders) WHERE o_orderpriority = '1-URGENT'",
    "check_relative_row_whole_order": "SELECT nxt AS o_orderkey FROM (SELECT o_orderpriority, lead(o_orderkey) OVER (ORDER BY o_orderdate, o_orderkey) AS nxt FROM orders) WHERE o_orderpriority = '1-URGENT'",
    "check_ranked_target": "SELECT p_partkey, round(p_retailprice / p_size, 4) AS value FROM part WHERE p_size <> 0 ORDER BY p_retailprice / p_size DESC, p_partkey LIMIT 1",
    "check_average_columns": "SELECT round((sum(l_discount) + sum(l_tax)) / (count(l_discount) + count(l_tax)), 6) AS mean FROM lineitem",
}
