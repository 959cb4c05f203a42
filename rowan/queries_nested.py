"""Registered queries over nested records, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rowan.operators.nested import first_delivery, json_table, nested_tables, object_links
from rowan.sources import load


def _results(spark: SparkSession, d: str) -> DataFrame:
    return first_delivery(load(spark, d, "execution_results"), "result_id", ["traces", "failing_node"])


def _items(spark: SparkSession, d: str) -> DataFrame:
    return first_delivery(load(spark, d, "work_items"), "item_id", ["logic_dag"])


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Every nested object with its parent."""
    results = object_links(_results(spark, d), "result_id", typed=("traces",), single=("failing_node",))
    return object_links(_items(spark, d), "item_id", json=("logic_dag",)).unionByName(results)


def p4_trace_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Traces, one row each."""
    return nested_tables(_results(spark, d), "result_id", "traces")["traces"].withColumns({c: F.array_join(c, "|") for c in ("dependency", "input", "error_traceback_tail")})


def p4_trace_steps(spark: SparkSession, d: str) -> DataFrame:
    """Steps of the agent loops of traces, one row each."""
    return nested_tables(_results(spark, d), "result_id", "traces")["traces_agent_loop_steps"]


def p4_trace_details(spark: SparkSession, d: str) -> DataFrame:
    """Details of the observations of steps, one row each."""
    return nested_tables(_results(spark, d), "result_id", "traces")["traces_agent_loop_steps_observation_details"]


def p4_failing_nodes(spark: SparkSession, d: str) -> DataFrame:
    """The failing node of each result, with the trace of the same node where there is one."""
    results = _results(spark, d)
    failing = results.filter("failing_node is not null").select(F.col("result_id").alias("record_id"), F.col("failing_node.id").alias("node_id"), F.col("failing_node.op").alias("op"), F.col("failing_node.output").alias("output"))
    traces = nested_tables(results, "result_id", "traces")["traces"].groupBy("record_id", "node_id").agg(F.min_by("path", "position").alias("trace_path"))
    return failing.join(traces, ["record_id", "node_id"], "left").select("record_id", "node_id", "op", "output", "trace_path")


def p4_dag_objects(spark: SparkSession, d: str) -> DataFrame:
    """Objects in arrays of logic_dag, one row each."""
    return json_table(_items(spark, d), "item_id", "logic_dag", {"id": "string", "op": "string", "output": "string", "type": "string", "name": "string"}).drop("object")


QUERIES = {f.__name__: f for f in (p4_found, p4_trace_nodes, p4_trace_steps, p4_trace_details, p4_failing_nodes, p4_dag_objects)}

_OBJECTS = """
WITH j AS (
  SELECT DISTINCT item_id AS rid, 'logic_dag' AS col, CAST(logic_dag AS JSON) AS v FROM work_items WHERE json_valid(logic_dag)
  UNION SELECT DISTINCT result_id, 'traces', to_json(traces) FROM execution_results WHERE traces IS NOT NULL
), e AS (
  SELECT j.rid, j.col, t.fullkey, t.value FROM j, json_tree(j.v) t WHERE t.type = 'OBJECT' AND t.fullkey LIKE '%]'
), r AS (
  SELECT rid, col || replace(replace(substr(fullkey, 2), ']', ''), '[', '.') AS child_path, fullkey, col, value FROM e
), p AS (
  SELECT c.rid, c.child_path, c.value, c.col, max_by(p.child_path, length(p.fullkey)) AS parent_path
  FROM r c LEFT JOIN r p ON p.rid = c.rid AND p.col = c.col AND p.fullkey <> c.fullkey AND starts_with(c.fullkey, p.fullkey)
  GROUP BY ALL
)"""

ORACLES = {
    "p4_found": _OBJECTS
    + """
SELECT rid AS record_id, child_path, coalesce(parent_path, '') AS parent_path FROM p
UNION SELECT result_id, 'failing_node', '' FROM execution_results WHERE failing_node IS NOT NULL""",
    "p4_trace_details": _OBJECTS
    + """
SELECT rid AS record_id, child_path AS path, parent_path, CAST(regexp_extract(child_path, '([0-9]+)$', 1) AS BIGINT) AS position, value->>'name' AS name, value->>'value' AS value
FROM p WHERE col = 'traces' AND child_path LIKE '%details.%'""",
    "p4_trace_steps": _OBJECTS
    + """
SELECT rid AS record_id, child_path AS path, parent_path, CAST(regexp_extract(child_path, '([0-9]+)$', 1) AS BIGINT) AS position, value->>'action' AS action,
  CAST(value->>'tokens' AS BIGINT) AS tokens, value->'observation'->>'kind' AS observation_kind, CAST(value->'observation'->>'ok' AS BOOLEAN) AS observation_ok
FROM p WHERE col = 'traces' AND regexp_matches(child_path, 'steps\\.[0-9]+$')""",
    "p4_dag_objects": _OBJECTS
    + """
SELECT rid AS record_id, child_path AS path, coalesce(parent_path, '') AS parent_path, CAST(regexp_extract(child_path, '([0-9]+)$', 1) AS BIGINT) AS position,
  value->>'id' AS id, value->>'op' AS op, value->>'output' AS output, value->>'type' AS type, value->>'name' AS name
FROM p WHERE col = 'logic_dag'""",
    "p4_failing_nodes": """
SELECT DISTINCT result_id AS record_id, failing_node.id AS node_id, failing_node.op AS op, failing_node.output AS output,
  'traces.' || (list_position(list_transform(traces, lambda t: t.node_id), failing_node.id) - 1) AS trace_path
FROM execution_results WHERE failing_node IS NOT NULL""",
    "p4_trace_nodes": """
WITH t AS (
  SELECT DISTINCT result_id, traces FROM execution_results
), n AS (
  SELECT result_id, traces[k] AS x, k - 1 AS k FROM (SELECT result_id, traces, unnest(range(1, len(traces) + 1)) AS k FROM t)
)
SELECT result_id AS record_id, 'traces.' || k AS path, '' AS parent_path, CAST(k AS BIGINT) AS position, x.node_id, x.node_index, x.op, x.output,
  array_to_string(x.dependency, '|') AS dependency, array_to_string(x.input, '|') AS input, x.execution_path, x.fast_path_hit, x.status, x.elapsed_ms, x.soft_failure,
  x.error.type AS error_type, x.error.message AS error_message, array_to_string(x.error.traceback_tail, '|') AS error_traceback_tail,
  x.agent_loop.sequence_id AS agent_loop_sequence_id, x.agent_loop.iterations AS agent_loop_iterations
FROM n WHERE x IS NOT NULL""",
}
