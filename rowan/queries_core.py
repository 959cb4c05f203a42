"""Registered queries of the relational core, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowan.plans.dialect import table_names, tokens
from rowan.plans.engine import Engine
from rowan.session import spread
from rowan.sources import load

Query = Callable[[SparkSession, str], DataFrame]
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings wikitq_cases wikitq_tables sandbox_states work_items "
    "execution_results builder_results sampling_plans sampling_quotas chunk_policies mixture_targets heldout_items"
).split()


def engine(spark: SparkSession, d: str, tables: list[str], semantics: str = "ansi", **options) -> Engine:
    e = Engine(spark, semantics, **options)
    for t in tables:
        e.register(t, load(spark, d, t))
    return e


def sql_query(text: str) -> Query:
    """The statement through the engine's SQL."""
    used = [t for t in dict.fromkeys(table_names([x for x in tokens(text) if x[0] not in ("space", "comment")])) if t in TABLES]
    return lambda spark, d: engine(spark, d, used).sql(text)


# ---------------------------------------------------------------- statements that both engines run as they are

SHARED: dict[str, str] = {
    "flagship_revenue": """
SELECT l_returnflag, l_linestatus, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus""",
    "filter_predicates": """
SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders
WHERE (o_totalprice > 100000 OR o_orderstatus = 'F') AND NOT (o_orderpriority = '1-URGENT') AND o_custkey % 7 <> 3 AND o_totalprice IS NOT NULL""",
    "like_ilike": """
SELECT p_partkey, p_name, p_name LIKE '%a_' AS ends, p_type ILIKE '%BRASS%' OR p_type ILIKE '%steel%' AS metal FROM part WHERE p_brand LIKE 'Brand#%' AND p_name NOT LIKE 'zz%'""",
    "in_between_case": """
SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal BETWEEN 0 AND 5000 THEN 'normal' ELSE 'rich' END AS class,
  CASE c_mktsegment WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 0 END AS segment
FROM customer WHERE c_nationkey IN (1, 2, 3, 5, 8, 13, 21)""",
    "is_true_null_logic": """
SELECT c_custkey, (nullif(c_nationkey, 3) = 5) IS TRUE AS a, (nullif(c_nationkey, 3) = 5) IS NOT FALSE AS b, nullif(c_nationkey, 3) IS NULL AS c,
  nullif(c_nationkey, 3) IN (5, 7) AS d, NOT (nullif(c_nationkey, 3) > 5) AS e FROM customer""",
    "project_derive_arith": """
SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) * (1 + l_tax) AS charge, l_extendedprice / l_quantity AS unit, l_orderkey % 5 AS rest, -l_linenumber AS neg, l_partkey + l_suppkey - 1 AS keys
FROM lineitem""",
    "agg_global": """
SELECT count(*) AS n, count(DISTINCT l_partkey) AS parts, round(sum(l_quantity), 2) AS q, round(avg(l_discount), 6) AS d, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship, min(l_returnflag) AS low FROM lineitem""",
    "agg_grouped": """
SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, min(o_totalprice) AS low, max(o_totalprice) AS high FROM orders GROUP BY o_orderpriority, o_orderstatus""",
    "agg_having": "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY o_custkey HAVING count(*) > 8 AND avg(o_totalprice) > 1000",
    "agg_filter_clause": """
SELECT l_returnflag, count(*) FILTER (WHERE l_quantity > 25) AS big, round(sum(l_tax) FILTER (WHERE l_discount > 0.05), 4) AS tax, count(*) AS n FROM lineitem GROUP BY l_returnflag""",
    "agg_distinct": "SELECT l_suppkey, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_returnflag) AS flags, count(l_orderkey) AS n FROM lineitem GROUP BY l_suppkey",
    "agg_stats": """
SELECT l_linestatus, round(stddev_samp(l_quantity), 6) AS sd, round(stddev_pop(l_quantity), 6) AS sdp, round(var_samp(l_tax), 8) AS v, round(var_pop(l_tax), 8) AS vp, round(median(l_extendedprice), 4) AS med FROM lineitem GROUP BY l_linestatus""",
    "agg_percentiles": """
SELECT l_returnflag, round(percentile_cont(0.9) WITHIN GROUP (ORDER BY l_extendedprice), 4) AS p90, percentile_disc(0.25) WITHIN GROUP (ORDER BY l_quantity) AS q25 FROM lineitem GROUP BY l_returnflag""",
    "regr_trend": "SELECT l_suppkey, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS base FROM lineitem GROUP BY l_suppkey",
    "agg_bool": "SELECT user_id, bool_or(value > 90) AS some_high, bool_and(value >= 0) AS none_negative FROM events GROUP BY user_id",
    "agg_hidden_in_expression": "SELECT o_orderstatus, round(100.0 * count(*) / max(o_custkey), 4) AS x, CASE WHEN sum(o_totalprice) > 1000 THEN 'much' ELSE 'little' END AS y FROM orders GROUP BY o_orderstatus",
    "group_by_expression_nulls": "SELECT nullif(o_custkey % 4, 0) AS k, count(*) AS n FROM orders GROUP BY nullif(o_custkey % 4, 0)",
    "grouping_rollup": "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)",
    "sort_nulls_topk": "SELECT o_orderkey, nullif(o_orderpriority, '1-URGENT') AS p FROM orders ORDER BY p DESC NULLS LAST, o_totalprice DESC, o_orderkey LIMIT 25",
    "limit_offset": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 10",
    "distinct_keys": "SELECT DISTINCT c_mktsegment, c_nationkey FROM customer",
    "distinct_of_groups": "SELECT DISTINCT count(*) AS n FROM orders GROUP BY o_custkey",
    "join_inner": """
SELECT n_name, r_name, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name, r_name""",
    "join_left": "SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 200000 GROUP BY c_custkey",
    "join_right": "SELECT s_suppkey, n_name FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey AND s_acctbal > 5000",
    "join_full": "SELECT c_custkey AS c, o_orderkey AS o FROM customer FULL OUTER JOIN orders ON c_custkey = o_custkey AND o_orderstatus = 'F'",
    "join_cross": "SELECT n_name, r_name FROM nation CROSS JOIN region",
    "join_comma_where": "SELECT n_name, count(*) AS n FROM supplier, nation WHERE s_nationkey = n_nationkey GROUP BY n_name",
    "join_theta": "SELECT a.n_nationkey AS x, b.n_nationkey AS y FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey",
    "join_using": "SELECT l_returnflag, count(*) AS n FROM (SELECT l_orderkey AS k, l_returnflag FROM lineitem) a JOIN (SELECT o_orderkey AS k, o_orderstatus FROM orders) b USING (k) WHERE o_orderstatus = 'F' GROUP BY l_returnflag",
    "join_self": "SELECT a.s_suppkey AS x, b.s_suppkey AS y FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey",
    "setop_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "setop_union_all": "SELECT c_nationkey AS k, 'c' AS side FROM customer UNION ALL SELECT s_nationkey, 's' FROM supplier",
    "setop_intersect": "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 5000 INTERSECT SELECT s_nationkey FROM supplier",
    "setop_except": "SELECT c_custkey AS k FROM customer WHERE c_acctbal > 0 EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000",
    "setop_nested_ordered": "SELECT k FROM ((SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier) EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 1) AS x ORDER BY k LIMIT 12",
    "sub_scalar": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)",
    "sub_in": "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)",
    "sub_not_in": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)",
    "sub_exists": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)",
    "sub_not_exists": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)",
    "sub_correlated": "SELECT o_orderkey FROM orders o WHERE o_totalprice = (SELECT max(i.o_totalprice) FROM orders i WHERE i.o_custkey = o.o_custkey)",
    "sub_in_select": "SELECT n_name, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS suppliers FROM nation",
    "sub_derived_table": "SELECT k, max(n) AS most FROM (SELECT o_custkey % 10 AS k, o_custkey, count(*) AS n FROM orders GROUP BY o_custkey % 10, o_custkey) t GROUP BY k",
    "cte_nested": "WITH big AS (SELECT * FROM orders WHERE o_totalprice > 150000), per AS (SELECT o_custkey, count(*) AS n FROM big GROUP BY o_custkey) SELECT n, count(*) AS customers FROM per GROUP BY n",
    "exists_projection": "SELECT EXISTS (SELECT 1 FROM orders WHERE o_totalprice > 400000) AS answer",
    "recursive_chain": "WITH RECURSIVE chain(n, total) AS (SELECT 1, 1 UNION ALL SELECT n + 1, total + n + 1 FROM chain WHERE n < 40) SELECT n, total FROM chain",
    "win_rank_family": """
SELECT o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey) AS rn, rank() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey) AS rk, dense_rank() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey) AS dr,
  round(percent_rank() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey), 8) AS pr FROM orders""",
    "win_cume_ntile": "SELECT event_id, round(cume_dist() OVER (PARTITION BY event_type ORDER BY value), 8) AS cd, ntile(4) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nt FROM events",
    "win_lead_lag": """
SELECT o_orderkey, lag(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before, lead(o_totalprice, 2, 0.0) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS after FROM orders""",
    "win_first_last_nth": """
SELECT o_orderkey, first_value(o_orderkey) OVER w AS f, last_value(o_orderkey) OVER w AS l, nth_value(o_orderkey, 2) OVER w AS second
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
    "win_aggregates_frames": """
SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS moving, count(*) OVER (PARTITION BY event_type) AS n FROM events""",
    "win_qualify": "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1",
    "fn_string": """
SELECT p_partkey, lower(p_name) AS lo, upper(p_type) AS up, length(p_name) AS n, trim(concat('  ', p_brand, ' ')) AS t, replace(p_name, 'a', '#') AS r, substring(p_name, 2, 3) AS s, left(p_type, 4) AS l, right(p_type, 3) AS rt, strpos(p_name, 'e') AS pos,
  p_brand || '-' || p_type AS both, regexp_replace(p_brand, '[0-9]', 'x', 'g') AS rx FROM part""",
    "fn_math": "SELECT l_orderkey, l_linenumber, abs(l_quantity - 25) AS a, ceil(l_extendedprice) AS c, floor(l_extendedprice) AS f, round(l_extendedprice, 1) AS r, coalesce(nullif(l_linenumber, 2), 0) AS z FROM lineitem",
    "fn_date": """
SELECT o_orderkey, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, quarter(o_orderdate) AS q, extract(doy FROM o_orderdate) AS doy, CAST(o_orderdate AS DATE) AS dt, date_part('month', o_orderdate) AS dp FROM orders""",
    "fn_null": "SELECT c_custkey, coalesce(nullif(c_mktsegment, 'BUILDING'), 'none') AS a, nullif(c_nationkey, 4) AS b, ifnull(nullif(c_nationkey, 4), -1) AS c FROM customer",
    "fn_cast": "SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS whole, CAST(o_orderkey AS VARCHAR) AS s, CAST(substring(o_orderpriority, 1, 1) AS INTEGER) AS p, try_cast(o_orderpriority AS INTEGER) AS bad, o_custkey::DOUBLE AS d FROM orders",
}

# ---------------------------------------------------------------- statements of which the SQL differs a little

_OWN: dict[str, tuple[str, str]] = {
    "join_semi": (
        "SELECT c_custkey FROM customer LEFT SEMI JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P'",
        "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
    ),
    "join_anti": (
        "SELECT c_custkey FROM customer LEFT ANTI JOIN orders ON o_custkey = c_custkey AND o_orderstatus = 'P'",
        "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')",
    ),
    "agg_list_ordered": (
        "SELECT o_custkey, array_join(transform(array_agg(o_orderkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 3), x -> string(x)), '|') AS top3 FROM orders GROUP BY o_custkey",
        "SELECT o_custkey, array_to_string(list_slice(array_agg(o_orderkey ORDER BY o_totalprice DESC, o_orderkey), 1, 3), '|') AS top3 FROM orders GROUP BY o_custkey",
    ),
    "agg_list_keeps_nulls": (
        "SELECT o_custkey, size(array_agg(nullif(o_orderstatus, 'F') ORDER BY o_orderkey)) AS n FROM orders GROUP BY o_custkey",
        "SELECT o_custkey, CAST(count(*) AS INTEGER) AS n FROM orders GROUP BY o_custkey",
    ),
    "agg_string": (
        "SELECT o_custkey, listagg(o_orderstatus, '/') WITHIN GROUP (ORDER BY o_orderkey) AS statuses FROM orders GROUP BY o_custkey",
        "SELECT o_custkey, string_agg(o_orderstatus, '/' ORDER BY o_orderkey) AS statuses FROM orders GROUP BY o_custkey",
    ),
    "fn_split_array": (
        "SELECT p_partkey, split_part(p_type, ' ', 1) AS a, array_length(string_to_array(p_type, ' ')) AS n, array_join(regexp_split_to_array(p_name, '[aeiou]'), '.') AS v FROM part",
        "SELECT p_partkey, split_part(p_type, ' ', 1) AS a, CAST(len(string_split(p_type, ' ')) AS INTEGER) AS n, array_to_string(string_split_regex(p_name, '[aeiou]'), '.') AS v FROM part",
    ),
    "fn_age": (
        "SELECT o_orderkey, a.years AS y, a.months AS m, a.days AS d FROM (SELECT o_orderkey, age(o_orderdate, DATE '1994-03-31') AS a FROM orders)",
        """
WITH x AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS e, DATE '1994-03-31' AS s FROM orders),
y AS (SELECT *, least(e, s) AS a, greatest(e, s) AS b, CASE WHEN e < s THEN -1 ELSE 1 END AS sign FROM x),
z AS (SELECT *, 12 * (year(b) - year(a)) + month(b) - month(a) - CASE WHEN day(b) < day(a) THEN 1 ELSE 0 END AS months FROM y)
SELECT o_orderkey, CAST(sign * (months // 12) AS INTEGER) AS y, CAST(sign * (months % 12) AS INTEGER) AS m, CAST(sign * (b - CAST(a + to_months(CAST(months AS INTEGER)) AS DATE)) AS INTEGER) AS d FROM z""",
    ),
    "fn_strptime": (
        "SELECT o_orderkey, strptime(date_format(o_orderdate, 'dd.MM.yyyy'), '%d.%m.%Y') AS t FROM orders",
        "SELECT o_orderkey, strptime(strftime(o_orderdate, '%d.%m.%Y'), '%d.%m.%Y') AS t FROM orders",
    ),
    "unnest_explode": (
        "SELECT word, count(*) AS n FROM documents, UNNEST(split(lower(text), ' ')) AS t(word) GROUP BY word",
        "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(lower(text), ' ')) AS word FROM documents) GROUP BY word",
    ),
    "unnest_embeddings": (
        "SELECT label, pos, round(avg(x), 4) AS mean FROM (SELECT label, posexplode(embedding) AS (pos, x) FROM embeddings) GROUP BY label, pos",
        "SELECT label, CAST(pos - 1 AS INTEGER) AS pos, round(avg(CAST(x AS DOUBLE)), 4) AS mean FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings) GROUP BY label, pos",
    ),
}


# ---------------------------------------------------------------- operator graphs


def col(name: str, table: str | None = None) -> dict:
    return {"type": "column", "name": name} | ({"table": table} if table else {})


def lit(value: object) -> dict:
    return {"type": "literal", "value": value}


def op(o: str, a: dict, b: dict) -> dict:
    return {"type": "binary_op", "op": o, "left": a, "right": b}


def call(function: str, *args: dict) -> dict:
    return {"type": "function_call", "function": function, "args": list(args)}


def agg(function: str, alias: str, argument: dict | None = None, **more) -> dict:
    return {"function": function, "argument": argument or {"type": "wildcard"}, "alias": alias} | more


def chain(source: str, *steps: tuple[str, dict]) -> dict:
    """A graph of steps one after the other; the last output is T<n>."""
    nodes = [{"id": "N0", "op": "Scan", "dependency": [], "input": [source], "params": {"source": source}, "output": "T0"}]
    for i, (name, params) in enumerate(steps, 1):
        nodes.append({"id": f"N{i}", "op": name, "dependency": [f"T{i - 1}"], "input": [], "params": params, "output": f"T{i}"})
    return {"task_type": "table_reasoning.query", "nodes": nodes}


def last(e: Engine, plan: dict) -> DataFrame:
    return e.run_plan(plan)[plan["nodes"][-1]["output"]]


def dag_flagship(spark: SparkSession, d: str) -> DataFrame:
    revenue = op("*", col("l_extendedprice"), op("-", lit(1), col("l_discount")))
    plan = chain(
        "lineitem",
        ("Filter", {"predicate": op("<=", col("l_shipdate"), {"type": "cast", "expr": lit("1998-09-02"), "to": "timestamp"})}),
        ("Derive", {"expressions": [{"expr": revenue, "alias": "part"}]}),
        ("Group", {"keys": [col("l_returnflag"), col("l_linestatus")]}),
        ("Aggregate", {"grouped": True, "aggregations": [agg("SUM", "total", col("part")), agg("COUNT", "n")]}),
        ("Sort", {"keys": [{"expr": col("total"), "direction": "DESC"}]}),
        ("Project", {"expressions": [{"expr": col("l_returnflag")}, {"expr": col("l_linestatus")}, {"expr": call("ROUND", col("total"), lit(2)), "alias": "revenue"}, {"expr": col("n")}]}),
    )
    return last(engine(spark, d, ["lineitem"]), plan)


def dag_aggregates(spark: SparkSession, d: str) -> DataFrame:
    """All aggregates of the graph's kernel over one table."""
    x, y = col("l_extendedprice"), col("l_quantity")
    half = {"parameters": [lit(0.5)]}
    plan = chain(
        "lineitem",
        ("Group", {"keys": [col("l_suppkey")]}),
        (
            "Aggregate",
            {
                "grouped": True,
                "aggregations": [
                    agg("COUNT", "n"), agg("COUNT", "parts", col("l_partkey"), distinct=True), agg("SUM", "s", y), agg("AVG", "m", y), agg("MIN", "lo", x), agg("MAX", "hi", x), agg("MEDIAN", "med", y),
                    agg("PERCENTILE_CONT", "pc", x, **half), agg("PERCENTILE_DISC", "pd", x, **half), agg("STDDEV", "sd", y), agg("STDDEV_POP", "sdp", y), agg("VARIANCE", "v", y), agg("VAR_POP", "vp", y),
                    agg("REGR_SLOPE", "slope", x, parameters=[y]), agg("REGR_INTERCEPT", "base", x, parameters=[y]), agg("BOOL_OR", "some", op(">", y, lit(49))), agg("EVERY", "all_over", op(">", y, lit(1))),
                    agg("STRING_AGG", "flags", col("l_returnflag"), order=[{"expr": col("l_orderkey")}, {"expr": col("l_linenumber")}, {"expr": col("l_returnflag")}], limit=4), agg("SUM", "late", col("l_tax"), filter=op("=", col("l_linestatus"), lit("O"))),
                ],
            },
        ),
        ("Project", {"expressions": [{"expr": col(c)} for c in ("l_suppkey", "n", "parts", "some", "all_over", "flags", "lo", "hi", "pd", "med")] + [{"expr": call("ROUND", col(c), lit(4)), "alias": c} for c in ("s", "m", "pc", "sd", "sdp", "v", "vp", "slope", "base", "late")]}),
    )
    return last(engine(spark, d, ["lineitem"]), plan)


def dag_joins(spark: SparkSession, d: str) -> DataFrame:
    plan = chain(
        "supplier",
        ("Join", {"joins": [{"kind": "LEFT", "source": "nation", "alias": "n", "on": op("=", col("s_nationkey"), col("n_nationkey", "n"))}, {"kind": "INNER", "source": "supplier", "alias": "b", "on": {"type": "logical_op", "op": "AND", "operands": [op("=", col("s_nationkey"), col("s_nationkey", "b")), op("<", col("s_suppkey"), col("s_suppkey", "b"))]}}]}),
        ("Project", {"expressions": [{"expr": col("s_suppkey"), "alias": "x"}, {"expr": col("s_suppkey", "b"), "alias": "y"}, {"expr": col("n_name"), "alias": "n_name"}]}),
    )
    return last(engine(spark, d, ["supplier", "nation"]), plan)


def dag_subqueries(spark: SparkSession, d: str) -> DataFrame:
    """A scalar reference, a membership in another node's result, and a set operation."""
    nodes = [
        {"id": "A", "op": "Scan", "input": ["orders"], "params": {"source": "orders"}, "output": "o"},
        {"id": "B", "op": "Aggregate", "dependency": ["o"], "params": {"aggregations": [agg("AVG", "mean", col("o_totalprice"))]}, "output": "mean"},
        {"id": "C", "op": "Scan", "input": ["customer"], "params": {"source": "customer"}, "output": "c"},
        {"id": "D", "op": "Filter", "dependency": ["c"], "params": {"predicate": op("=", col("c_mktsegment"), lit("BUILDING"))}, "output": "built"},
        {"id": "E", "op": "Filter", "dependency": ["o", "mean", "built"], "params": {"predicate": {"type": "logical_op", "op": "AND", "operands": [op(">", col("o_totalprice"), {"type": "scalar_ref", "source": "mean", "name": "mean"}), {"type": "in_subquery", "expr": col("o_custkey"), "query": {"type": "set_ref", "source": "built", "name": "c_custkey"}}]}}, "output": "f"},
        {"id": "F", "op": "Project", "dependency": ["f"], "params": {"expressions": [{"expr": col("o_custkey"), "alias": "k"}]}, "output": "left"},
        {"id": "G", "op": "Project", "dependency": ["built"], "params": {"expressions": [{"expr": col("c_custkey"), "alias": "k"}]}, "output": "right"},
        {"id": "H", "op": "SetOp", "dependency": ["right", "left"], "params": {"operator": "EXCEPT"}, "output": "answer_table"},
    ]
    return engine(spark, d, ["orders", "customer"]).run_plan({"nodes": nodes})["answer_table"]


def dag_windows_distinct(spark: SparkSession, d: str) -> DataFrame:
    def w(function: str, *args: dict) -> dict:
        return {"type": "window_function", "function": {"function": function, "args": list(args)}, "partition_by": [col("o_custkey")], "order": [{"expr": col("o_totalprice")}, {"expr": col("o_orderkey")}]}

    plan = chain(
        "orders",
        ("Derive", {"expressions": [{"expr": w("ROW_NUMBER"), "alias": "rn"}, {"expr": w("LAG", col("o_orderkey"), lit(1)), "alias": "before"}, {"expr": w("LAST_VALUE", col("o_orderkey")), "alias": "top"}, {"expr": w("NTILE", lit(3)), "alias": "third"}]}),
        ("Filter", {"predicate": op("<=", col("rn"), lit(2))}),
        ("Project", {"expressions": [{"expr": col(c)} for c in ("o_custkey", "o_orderkey", "rn", "before", "top", "third")]}),
        ("Distinct", {"on": [col("o_custkey"), col("rn")]}),
    )
    return last(engine(spark, d, ["orders"]), plan)


def dag_functions(spark: SparkSession, d: str) -> DataFrame:
    name, kind, when = col("p_name"), col("p_type"), call("STRPTIME", lit("2020-02-29"), lit("%Y-%m-%d"))
    exprs = {
        "p_partkey": col("p_partkey"), "up": call("UPPER", name), "n": call("LENGTH", name), "pos": call("STR_POSITION", name, lit("e")), "sub": call("SUBSTR", name, lit(-3)), "lr": call("CONCAT", call("LEFT", name, lit(2)), call("RIGHT", kind, lit(2))),
        "rep": call("REPLACE", name, lit("a"), lit("#")), "rx": call("REGEXP_REPLACE", kind, lit("[AEIOU]"), lit("")), "part2": call("SPLIT_PART", kind, lit(" "), lit(2)), "parts": call("ARRAY_LENGTH", call("STRING_TO_ARRAY", kind, lit(" "))),
        "size": call("CEIL", op("/", col("p_size"), lit(7))), "bit": op("%", col("p_size"), lit(5)), "y": call("EXTRACT", lit("year"), when), "months": call("EXTRACT", lit("month"), call("AGE", when, call("DATE", lit("2019-10-15")))),
        "none": call("NULLIF", col("p_brand"), lit("Brand#13")), "class": {"type": "case", "ifs": [{"condition": op(">", col("p_size"), lit(30)), "value": lit("large")}, {"condition": {"type": "in", "expr": col("p_size"), "values": [lit(1), lit(2)]}, "value": lit("tiny")}], "default": lit("other")},
        "like": {"type": "like", "expr": name, "pattern": lit("%a%"), "case_sensitive": False}, "num": {"type": "cast", "expr": call("RIGHT", col("p_brand"), lit(2)), "to": "INTEGER"},
    }
    plan = chain("part", ("Project", {"expressions": [{"expr": e, "alias": a} for a, e in exprs.items()]}))
    return last(engine(spark, d, ["part"]), plan)


def recursive_set(spark: SparkSession, d: str) -> DataFrame:
    """Customers reached from customer 1 by orders that lead from one to another: set semantics, by deltas. Every customer is a node."""
    customers = load(spark, d, "customer").agg(F.count("*").alias("n"))
    edges = load(spark, d, "orders").crossJoin(customers).select(F.col("o_custkey").alias("a"), ((F.col("o_orderkey") * 7) % F.col("n") + 1).alias("b")).distinct()
    scan = {"id": "S", "op": "Scan", "params": {"source": "edges"}, "input": ["edges"], "output": "e"}
    seed = {"nodes": [scan, {"id": "F", "op": "Filter", "dependency": ["e"], "params": {"predicate": op("=", col("a"), lit(1))}, "output": "f"}, {"id": "P", "op": "Project", "dependency": ["f"], "params": {"expressions": [{"expr": col("b"), "alias": "node"}]}, "output": "p"}], "output": "p"}
    step = {
        "nodes": [
            {"id": "D", "op": "Scan", "params": {"source": "reached", "source_type": "transient", "read": "delta"}, "output": "d"},
            {"id": "J", "op": "Join", "dependency": ["d"], "params": {"joins": [{"kind": "INNER", "source": "edges", "alias": "x", "on": op("=", col("node"), col("a", "x"))}]}, "output": "j"},
            {"id": "P", "op": "Project", "dependency": ["j"], "params": {"expressions": [{"expr": col("b"), "alias": "node"}]}, "output": "p"},
        ],
        "output": "p",
    }
    e = Engine(spark).register("edges", edges)
    plan = {"nodes": [{"id": "R", "op": "RepeatUnion", "dependency": [], "params": {"transient_table": "reached", "seed_plan": seed, "recursive_plan": step, "iteration_limit": -1}, "output": "answer_table"}]}
    return e.run_plan(plan)["answer_table"]


def batch_shared_subplan(spark: SparkSession, d: str) -> DataFrame:
    """Two answers of one batch that share their scan, filter and group."""
    steps = (("Filter", {"predicate": op(">", col("l_quantity"), lit(20))}), ("Group", {"keys": [col("l_returnflag")]}))
    one = chain("lineitem", *steps, ("Aggregate", {"grouped": True, "aggregations": [agg("COUNT", "v")]}))
    two = chain("lineitem", *steps, ("Aggregate", {"grouped": True, "aggregations": [agg("MAX", "v", col("l_linenumber"))]}))
    runner = engine(spark, d, ["lineitem"]).runner()
    out = runner.run({"query_plans": [{"nodes": p["nodes"], "answer": {"name": n}, "output": "T3"} for n, p in (("count", one), ("line", two))]})
    assert runner.shared == 3
    return out["count"].select(F.lit("count").alias("answer"), "l_returnflag", "v").union(out["line"].select(F.lit("line"), "l_returnflag", F.col("v").cast("bigint")))


def _text_lineitem(lines: DataFrame) -> DataFrame:
    """Formatted text made of numbers, as found in text tables."""
    return lines.select("l_orderkey", F.concat(F.lit("$"), F.format_number("l_extendedprice", 2), F.lit(" (est)")).alias("price"), F.concat(F.format_number(F.col("l_discount") * 100, 1), F.lit(" %")).alias("share"), F.when(F.col("l_quantity") > 40, F.lit("unknown")).otherwise(F.concat(F.lit("- "), F.col("l_quantity").cast("int").cast("string"))).alias("change"))


def coerce_numeric_text(spark: SparkSession, d: str) -> DataFrame:
    plan = chain(
        "prices",
        ("Filter", {"predicate": op(">", col("PRICE"), lit(20000))}),
        ("Aggregate", {"aggregations": [agg("COUNT", "n"), agg("SUM", "total", col("price")), agg("AVG", "share", col("share")), agg("SUM", "change", col("Change")), agg("MAX", "top", col("price"))]}),
        ("Project", {"expressions": [{"expr": col("n")}] + [{"expr": call("ROUND", col(c), lit(2)), "alias": c} for c in ("total", "share", "change")] + [{"expr": {"type": "cast", "expr": col("top"), "to": "double"}, "alias": "top"}]}),
    )
    e = Engine(spark, "lenient").register("prices", _text_lineitem(spread(load(spark, d, "lineitem"))))
    return last(e, plan)


def filter_repair(spark: SparkSession, d: str) -> DataFrame:
    """A literal in other case and spacing than the data finds its rows."""
    plan = chain("customer", ("Filter", {"predicate": {"type": "logical_op", "op": "AND", "operands": [op("=", col("c_mktsegment"), lit(" building ")), op(">", col("c_acctbal"), lit(0))]}}), ("Project", {"expressions": [{"expr": col("c_custkey")}, {"expr": col("c_mktsegment")}]}))
    return last(engine(spark, d, ["customer"], "lenient"), plan)


def lenient_setops_sort(spark: SparkSession, d: str) -> DataFrame:
    """By-name union of text tables (orders not open, and those not finished, which share the orders in progress), ordered by the number in the text, first rows."""
    o = load(spark, d, "orders")
    a, b = o.filter("o_orderstatus IS DISTINCT FROM 'O'"), o.filter("o_orderstatus IS DISTINCT FROM 'F'")
    nodes = [
        {"id": "A", "op": "Scan", "params": {"source": "a"}, "output": "a"},
        {"id": "B", "op": "Scan", "params": {"source": "b"}, "output": "b"},
        {"id": "U", "op": "SetOp", "dependency": ["a", "b"], "params": {"operator": "UNION"}, "output": "u"},
        {"id": "S", "op": "Sort", "dependency": ["u"], "params": {"keys": [{"expr": col("amount"), "direction": "DESC"}, {"expr": col("k")}]}, "output": "s"},
        {"id": "L", "op": "Limit", "dependency": ["s"], "params": {"count": 30, "offset": 5}, "output": "l"},
    ]
    text = F.concat(F.format_number("o_totalprice", 0), F.lit(" lb"))
    e = Engine(spark, "lenient").register("a", a.select(F.col("o_orderkey").alias("k"), text.alias("amount"))).register("b", b.select(text.alias("amount"), F.col("o_orderkey").alias("k")))
    return e.run_plan({"nodes": nodes})["l"]


def lenient_join_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys that are text on one side meet numbers on the other, and missing keys meet each other."""
    key = F.when(F.col("s_nationkey") != 3, F.concat(F.lit(" "), F.col("s_nationkey").cast("string"), F.lit(".0")))
    left = load(spark, d, "supplier").select("s_suppkey", key.alias("nation"))
    right = load(spark, d, "nation").select(F.when(F.col("n_nationkey") != 3, F.col("n_nationkey")).alias("n_key"), "n_name")
    plan = chain("suppliers", ("Join", {"joins": [{"kind": "INNER", "source": "nations", "alias": "n", "on": op("=", col("nation"), col("n_key", "n"))}]}), ("Project", {"expressions": [{"expr": col("s_suppkey")}, {"expr": col("n_name")}]}))
    return last(Engine(spark, "lenient").register("suppliers", left).register("nations", right), plan)


def answers_typed(spark: SparkSession, d: str) -> DataFrame:
    """Answers of all kinds from results of statements, as text."""
    e = engine(spark, d, ["nation", "region", "orders"])
    asked = {
        "number": "SELECT count(*) AS n FROM orders", "boolean": "SELECT max(o_totalprice) > 1000 AS b FROM orders", "string": "SELECT n_name, n_regionkey FROM nation ORDER BY n_nationkey LIMIT 1",
        "list[string]": "SELECT r_name FROM region ORDER BY r_name", "list[number]": "SELECT r_regionkey FROM region ORDER BY 1", "date": "SELECT CAST(min(o_orderdate) AS DATE) AS day FROM orders", "list": "SELECT n_name FROM nation WHERE n_nationkey < 0",
    }
    rows = [(kind, "|".join(map(str, v)) if isinstance(v := e.answer(text, None, kind), list) else str(v)) for kind, text in asked.items()]
    return spark.createDataFrame(rows, "kind string, value string")


GRAPHS: dict[str, tuple[Query, str]] = {
    "lenient_join_keys": (lenient_join_keys, "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey"),
    "answers_typed": (
        answers_typed,
        """
SELECT 'number' AS kind, count(*)::VARCHAR AS value FROM orders UNION ALL SELECT 'boolean', CASE WHEN max(o_totalprice) > 1000 THEN 'True' ELSE 'False' END FROM orders
UNION ALL SELECT 'string', n_name || ', ' || n_regionkey FROM nation WHERE n_nationkey = (SELECT min(n_nationkey) FROM nation)
UNION ALL SELECT 'list[string]', string_agg(r_name, '|' ORDER BY r_name) FROM region UNION ALL SELECT 'list[number]', string_agg(r_regionkey::VARCHAR, '|' ORDER BY r_regionkey) FROM region
UNION ALL SELECT 'date', CAST(CAST(min(o_orderdate) AS DATE) AS VARCHAR) FROM orders UNION ALL SELECT 'list', ''""",
    ),
    "dag_flagship": (dag_flagship, SHARED["flagship_revenue"]),
    "dag_aggregates": (
        dag_aggregates,
        """
WITH f AS (SELECT l_suppkey, string_agg(l_returnflag, ',' ORDER BY l_orderkey, l_linenumber, l_returnflag) AS flags FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_returnflag) AS rn FROM lineitem) WHERE rn <= 4 GROUP BY l_suppkey)
SELECT l_suppkey, count(*) AS n, count(DISTINCT l_partkey) AS parts, bool_or(l_quantity > 49) AS some, bool_and(l_quantity > 1) AS all_over, any_value(f.flags) AS flags, min(l_extendedprice) AS lo, max(l_extendedprice) AS hi,
  percentile_disc(0.5) WITHIN GROUP (ORDER BY l_extendedprice) AS pd, median(l_quantity) AS med, round(sum(l_quantity), 4) AS s, round(avg(l_quantity), 4) AS m, round(percentile_cont(0.5) WITHIN GROUP (ORDER BY l_extendedprice), 4) AS pc,
  round(stddev_samp(l_quantity), 4) AS sd, round(stddev_pop(l_quantity), 4) AS sdp, round(var_samp(l_quantity), 4) AS v, round(var_pop(l_quantity), 4) AS vp, round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS base,
  round(sum(l_tax) FILTER (WHERE l_linestatus = 'O'), 4) AS late
FROM lineitem JOIN f USING (l_suppkey) GROUP BY l_suppkey""",
    ),
    "dag_joins": (dag_joins, "SELECT a.s_suppkey AS x, b.s_suppkey AS y, n_name FROM supplier a LEFT JOIN nation ON a.s_nationkey = n_nationkey JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey"),
    "dag_subqueries": (dag_subqueries, "SELECT c_custkey AS k FROM customer WHERE c_mktsegment = 'BUILDING' EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)"),
    "dag_windows_distinct": (
        dag_windows_distinct,
        """
SELECT o_custkey, o_orderkey, rn, before, top, third FROM (SELECT *, row_number() OVER w AS rn, lag(o_orderkey) OVER w AS before, last_value(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS top, ntile(3) OVER w AS third
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)) WHERE rn <= 2""",
    ),
    "dag_functions": (
        dag_functions,
        """
SELECT p_partkey, upper(p_name) AS up, length(p_name) AS n, strpos(p_name, 'e') AS pos, substring(p_name, -3) AS sub, left(p_name, 2) || right(p_type, 2) AS lr, replace(p_name, 'a', '#') AS rep, regexp_replace(p_type, '[AEIOU]', '', 'g') AS rx,
  nullif(split_part(p_type, ' ', 2), '') AS part2, len(string_split(p_type, ' ')) AS parts, CAST(ceil(p_size / 7) AS BIGINT) AS size, p_size % 5 AS bit, 2020 AS y, 4 AS months, nullif(p_brand, 'Brand#13') AS none,
  CASE WHEN p_size > 30 THEN 'large' WHEN p_size IN (1, 2) THEN 'tiny' ELSE 'other' END AS class, p_name ILIKE '%a%' AS "like", try_cast(right(p_brand, 2) AS BIGINT) AS num FROM part""",
    ),
    "recursive_set": (
        recursive_set,
        "WITH RECURSIVE e AS (SELECT DISTINCT o_custkey AS a, (o_orderkey * 7) % (SELECT count(*) FROM customer) + 1 AS b FROM orders), r(node) AS (SELECT b FROM e WHERE a = 1 UNION SELECT e.b FROM r JOIN e ON e.a = r.node) SELECT node FROM r",
    ),
    "batch_shared_subplan": (
        batch_shared_subplan,
        "SELECT 'count' AS answer, l_returnflag, count(*) AS v FROM lineitem WHERE l_quantity > 20 GROUP BY l_returnflag UNION ALL SELECT 'line', l_returnflag, max(l_linenumber) FROM lineitem WHERE l_quantity > 20 GROUP BY l_returnflag",
    ),
    "coerce_numeric_text": (
        coerce_numeric_text,
        """
WITH t AS (SELECT round(l_extendedprice, 2) AS price, round(l_discount * 100, 1) AS share, CASE WHEN l_quantity > 40 THEN NULL ELSE -floor(l_quantity) END AS change FROM lineitem)
SELECT count(*) AS n, round(sum(price), 2) AS total, round(avg(share), 2) AS share, round(sum(change), 2) AS change, max(price) AS top FROM t WHERE price > 20000""",
    ),
    "filter_repair": (filter_repair, "SELECT c_custkey, c_mktsegment FROM customer WHERE lower(trim(c_mktsegment)) = 'building' AND c_acctbal > 0"),
    "lenient_setops_sort": (
        lenient_setops_sort,
        "SELECT o_orderkey AS k, format('{:,}', CAST(round_even(o_totalprice, 0) AS BIGINT)) || ' lb' AS amount FROM orders ORDER BY round_even(o_totalprice, 0) DESC, o_orderkey LIMIT 30 OFFSET 5",
    ),
}

QUERIES: dict[str, Query] = {n: sql_query(t) for n, t in SHARED.items()} | {n: sql_query(t) for n, (t, _) in _OWN.items()} | {n: q for n, (q, _) in GRAPHS.items()}
ORACLES: dict[str, str] = SHARED | {n: t for n, (_, t) in _OWN.items()} | {n: t for n, (_, t) in GRAPHS.items()}
