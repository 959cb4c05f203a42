"""Operator graphs: validation, and folding of their nodes into lazy DataFrames."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, NumericType, StringType, TimestampType

from rowan.functions import coerce
from rowan.operators.answer import format_answer
from rowan.operators.evidence import evidence
from rowan.operators.recursion import repeat_union
from rowan.operators.repair import repair_filter, why_empty
from rowan.plans.expr import PlanError, Scope, aggregate, prepare, quoted, sort_key

OPS = ("Scan", "Filter", "Project", "Derive", "Group", "Aggregate", "Sort", "Limit", "Distinct", "Join", "SetOp", "RepeatUnion", "FormatAnswer", "AnalyzeEvidence")
# Aggregates that hold many values.
HELD = ("MEDIAN", "PERCENTILE_CONT", "PERCENTILE_DISC", "ARRAY_AGG", "LIST", "STRING_AGG", "GROUP_CONCAT", "LISTAGG")
JOINS = {
    "": "inner", "INNER": "inner", "CROSS": "cross", "LEFT": "left", "LEFT OUTER": "left", "RIGHT": "right", "RIGHT OUTER": "right",
    "FULL": "full", "FULL OUTER": "full", "OUTER": "full", "SEMI": "left_semi", "LEFT SEMI": "left_semi", "ANTI": "left_anti", "LEFT ANTI": "left_anti",
}


@dataclass
class Table:
    """A lazy result, the keys of a pending Group, and the order that a Sort gave it (keys, and columns ordered by the number in their text)."""

    df: DataFrame
    keys: list[dict] | None = None
    order: tuple[list[dict], dict[str, bool]] | None = None


@dataclass
class Node:
    id: str
    op: str
    dependency: list[str] = field(default_factory=list)
    input: list[str] = field(default_factory=list)
    params: dict = field(default_factory=dict)
    output: str = ""

    @staticmethod
    def of(d: dict) -> Node:
        return Node(str(d.get("id")), str(d.get("op")), list(d.get("dependency") or []), list(d.get("input") or []), dict(d.get("params") or {}), str(d.get("output") or ""))


def validate(nodes: list[Node], sources: set[str]) -> None:
    """An error unless each node has a known op, an output of its own, known inputs and dependencies produced before it."""
    made: set[str] = set()
    for n in nodes:
        if n.op not in OPS:
            raise PlanError(f"node {n.id}: unknown op {n.op!r}")
        if not n.output or n.output in made:
            raise PlanError(f"node {n.id}: output {n.output!r} is missing or taken")
        for d in n.dependency:
            if d not in made:
                raise PlanError(f"node {n.id}: {d!r} has not been produced")
        for s in n.input:
            if s not in sources:
                raise PlanError(f"node {n.id}: unknown source {s!r}")
        made.add(n.output)


class Runner:
    """Runs operator graphs over named sources.

    lenient reads text tables tolerantly. max_rows makes joins, set operations and recursion check, by a job of their
    own, that they do not exceed that many rows; recursion goes on to its fixed point or its own limit, and is an error if
    it still finds rows after max_rounds; without max_rows nothing is run before the result is asked for,
    but for sorts of texts in lenient mode, recursion, answers and evidence. Equal subplans, also of several plans, are
    built once.
    """

    def __init__(self, spark: SparkSession, sources: dict[str, DataFrame], lenient: bool = False, max_rows: int | None = None, max_rounds: int | None = None, repair: bool | None = None):
        self.spark, self.sources, self.lenient, self.max_rows, self.max_rounds = spark, sources, lenient, max_rows, max_rounds
        self.repair = lenient if repair is None else repair
        self.transient: dict[str, DataFrame] = {}
        self.memo: dict[str, object] = {}
        self.shared = 0
        self.repairs: list[dict] = []

    # ------------------------------------------------------------ plans

    def run(self, plan: dict) -> dict[str, object]:
        """Outputs of a plan by name: DataFrames, and plain values of FormatAnswer and AnalyzeEvidence."""
        if "query_plans" in plan and not plan.get("nodes"):
            out = {}
            for i, q in enumerate(plan["query_plans"]):
                name = (q.get("answer") or {}).get("name")
                if not name or name in out:
                    raise PlanError(f"query plan {i}: answer name {name!r} is missing or taken")
                made = self.run({"nodes": q.get("nodes", [])})
                chosen = "answer" if "answer" in made else q.get("output") or name
                out[name] = made[chosen if chosen in made else q["nodes"][-1]["output"]]
            return out
        nodes = [Node.of(d) for d in plan.get("nodes", []) if d]
        validate(nodes, set(self.sources) | set(self.transient))
        made: dict[str, object] = {}
        keys: dict[str, str] = {}
        for n in nodes:
            key = json.dumps([n.op, n.input, [keys[d] for d in n.dependency], self._canonical(n, keys)], sort_keys=True, default=str)
            if n.op != "FormatAnswer" and not self.transient and key in self.memo:
                self.shared += 1
                made[n.output] = self.memo[key]
            else:
                made[n.output] = self.memo[key] = getattr(self, "_" + n.op)(n, made)
            keys[n.output] = key
        return {k: v.df if isinstance(v, Table) else v for k, v in made.items()}

    def first_emptying(self, plan: dict) -> dict | None:
        """The first node of a plan that makes an empty table of tables that have rows: {node, op, output, literals}; None if there is none.

        Nodes after it can't bring back what it removed. For a Filter, literals says of each text literal why it finds nothing. Each table
        is asked for one row, in the order of the plan, up to the node found.
        """
        out = self.run(plan)
        empty: dict[str, bool] = {}
        for n in (Node.of(d) for d in plan.get("nodes", []) if d):
            df = out.get(n.output)
            if not isinstance(df, DataFrame):
                continue
            empty[n.output] = df.isEmpty()
            tables = [d for d in n.dependency if d in empty]
            if empty[n.output] and not any(empty[d] for d in tables):
                found = {"node": n.id, "op": n.op, "output": n.output, "literals": []}
                if n.op == "Filter" and tables:
                    found["literals"] = why_empty(Scope(out[tables[0]], self.lenient), n.params["predicate"])
                return found
        return None

    def _canonical(self, n: Node, keys: dict[str, str]) -> object:
        """Parameters with names of outputs replaced by what made them."""

        def walk(v: object) -> object:
            if isinstance(v, dict):
                return {k: keys.get(x, x) if k in ("source", "source_ref") and isinstance(x, str) else walk(x) for k, x in v.items()}
            return [walk(x) for x in v] if isinstance(v, list) else v

        return walk(n.params)

    def _scope(self, df: DataFrame, made: dict[str, object]) -> Scope:
        return Scope(df, self.lenient, {k: v.df for k, v in made.items() if isinstance(v, Table)})

    def _first(self, n: Node, made: dict[str, object], needed: bool = True) -> Table | None:
        for d in n.dependency:
            if isinstance(made[d], Table):
                return made[d]
        if needed:
            raise PlanError(f"node {n.id}: {n.op} needs a table")
        return None

    def _checked(self, df: DataFrame, op: str) -> DataFrame:
        if self.max_rows is not None and df.limit(self.max_rows + 1).count() > self.max_rows:
            raise PlanError(f"{op} gives more than {self.max_rows} rows")
        return df

    # ------------------------------------------------------------ operators

    def _Scan(self, n: Node, _: dict) -> Table:  # noqa: N802
        name = n.params.get("source")
        if not name:
            names = n.params.get("sources") or n.input or list(self.sources)
            if len(names) != 1:
                raise PlanError(f"Scan needs one source, not {names}")
            name = names[0]
        table = self.transient if n.params.get("source_type") == "transient" else self.sources
        if name not in table:
            raise PlanError(f"Unknown source: {name}")
        return Table(table[name])

    def _Filter(self, n: Node, made: dict) -> Table:  # noqa: N802
        df = self._first(n, made).df
        scope = self._scope(df, made)
        if self.repair and not scope.outputs.keys() - set(n.dependency):
            out, repairs = repair_filter(df, n.params["predicate"], self.lenient) if not _refers(n.params["predicate"]) else (df.filter(scope.truth(n.params["predicate"])), [])
            self.repairs += repairs
            return Table(out, order=self._first(n, made).order)
        return Table(df.filter(scope.truth(n.params["predicate"])), order=self._first(n, made).order)

    def _items(self, items: list[dict]) -> list[tuple[str, dict]]:
        out = []
        for i, item in enumerate(items):
            e = item.get("expr", item)
            out.append((item.get("alias") or (str(e.get("name")) if e.get("type") in ("column", "identifier") else f"_expr_{i}"), e))
        return out

    def _Project(self, n: Node, made: dict) -> Table:  # noqa: N802
        table = self._first(n, made, needed=False)
        df = table.df if table else self.spark.range(1).select()
        scope = self._scope(df, made)
        columns: dict[str, object] = {}
        for alias, e in self._items(n.params.get("expressions", [])):
            if e.get("type") == "wildcard":
                columns |= {c: F.col(quoted(c)) for c in df.columns}
            else:
                columns[alias] = scope.eval(e)
        return Table(df.select(*[c.alias(a) for a, c in columns.items()]))

    def _Derive(self, n: Node, made: dict) -> Table:  # noqa: N802
        table = self._first(n, made, needed=False)
        df = table.df if table else self.spark.range(1).select()
        for alias, e in self._items(n.params.get("expressions", [])):
            df = df.withColumn(alias, self._scope(df, made).eval(e))
        return Table(df, table.keys if table else None, table.order if table else None)

    def _Group(self, n: Node, made: dict) -> Table:  # noqa: N802
        table = self._first(n, made)
        return Table(table.df, list(n.params.get("keys", [])), table.order)

    def _Aggregate(self, n: Node, made: dict) -> Table:  # noqa: N802
        table = self._first(n, made)
        scope, wanted = prepare(self._scope(table.df, made), n.params.get("aggregations", []))
        aggs = [aggregate(scope, a).alias(a["alias"]) for a in wanted]
        if not n.params.get("grouped") and table.keys is None:
            return Table(scope.df.agg(*aggs))
        keys = []
        for i, k in enumerate(table.keys or []):
            name = scope.name_of(k) if k.get("type") == "column" else None
            keys.append(scope.eval(k).alias(name or k.get("alias") or f"_group_{i}"))
        if self.lenient:  # other columns keep a value of the group's rows
            taken = {a["alias"] for a in n.params.get("aggregations", [])} | {scope.name_of(k) for k in table.keys or [] if k.get("type") == "column"}
            carried = [c for c in table.df.columns if c not in taken]
            aggs += [self._least(scope, table, carried)[c].alias(c) for c in carried]
        apart = [i for i, a in enumerate(wanted) if a.get("distinct") and str(a.get("function", "")).upper() in ("COUNT", "SUM", "AVG")]
        if keys and apart and len(apart) < len(wanted) and any(str(a.get("function", "")).upper() in HELD for a in wanted):
            # DISTINCT would make the other aggregates keep a state for each distinct value, so it is aggregated by itself
            one = scope.df.groupBy(*[k.alias(f"_k{i}") for i, k in enumerate(keys)]).agg(*[aggs[i] for i in apart])
            rest = scope.df.groupBy(*keys).agg(*[a for i, a in enumerate(aggs) if i not in apart])
            names = rest.columns[: len(keys)]
            same = [F.col(quoted(n)).eqNullSafe(F.col(f"_k{i}")) for i, n in enumerate(names)]
            return Table(rest.join(one, reduce(lambda x, y: x & y, same)).select(*[quoted(c) for c in [*names, *[a["alias"] for a in wanted], *[c for c in rest.columns[len(keys):] if c not in {a["alias"] for a in wanted}]]]))
        return Table(scope.df.groupBy(*keys).agg(*(aggs or [F.count(F.lit(1)).alias("_rows")])))

    def _Sort(self, n: Node, made: dict) -> Table:  # noqa: N802
        df = self._first(n, made).df
        scope = self._scope(df, made)
        keys = n.params.get("keys", [])
        numeric: dict[str, bool] = {}
        if self.lenient:
            names = {scope.name_of(k["expr"]) for k in keys if k["expr"].get("type") == "column"} - {None}
            text = [c for c in names if isinstance(df.schema[c].dataType, StringType) and not any(w in c.lower() for w in ("date", "time", "day", "month"))]
            numeric = coerce.all_numeric(df, text)
        return Table(df.orderBy(*[sort_key(scope, k, numeric.get(scope.name_of(k["expr"]) if k["expr"].get("type") == "column" else "", False)) for k in keys]), order=(keys, numeric))

    def _least(self, scope: Scope, table: Table, columns: list[str]) -> object:
        """The columns of a group's first row, as a struct: first in the order that a Sort gave, and of equal rows, or without an order, the least.

        A row order that no Sort gave does not exist here, so the least row stands for it in any partitioning. Partial aggregates keep one row.
        """
        by = []
        for k in (table.order or ([], {}))[0]:
            c, down = scope.eval(k["expr"]), str(k.get("direction", "ASC")).upper() == "DESC"
            if table.order[1].get(scope.name_of(k["expr"]) if k["expr"].get("type") == "column" else ""):
                c = coerce.to_number(c)
            kind = scope.kind(c)
            if down and not isinstance(kind, (NumericType, DateType, TimestampType)):
                by = []  # no order that a minimum can follow
                break
            if down:
                c = -(c if isinstance(kind, NumericType) else F.unix_date(c) if isinstance(kind, DateType) else F.unix_micros(c))
            by += [c.isNull() if str(k.get("nulls") or "LAST").upper() != "FIRST" else c.isNotNull(), c]
        names = [F.col(quoted(c)).alias(c) for c in columns]
        orderable = [F.col(quoted(c)) for c in columns if "map<" not in scope.df.schema[c].dataType.simpleString() and "variant" not in scope.df.schema[c].dataType.simpleString()]
        return F.min_by(F.struct(*names), F.struct(*[c.alias(f"_{i}") for i, c in enumerate([*by, *orderable] or [F.lit(0)])]))

    def _Limit(self, n: Node, made: dict) -> Table:  # noqa: N802
        df = self._first(n, made).df
        offset = int(n.params.get("offset") or 0)
        df = df.offset(offset) if offset else df
        return Table(df.limit(int(n.params.get("count") or 0)), order=self._first(n, made).order)

    def _Distinct(self, n: Node, made: dict) -> Table:  # noqa: N802
        df = self._first(n, made).df
        on = n.params.get("on") or []
        if not on:
            return Table(df.distinct())
        scope = self._scope(df, made)
        names, extra = [], {}
        for i, e in enumerate(on):
            name = scope.name_of(e) if e.get("type") == "column" else None
            if name is None:
                name = f"_distinct_{i}"
                extra[name] = scope.eval(e)
            names.append(name)
        table = self._first(n, made)
        keyed = df.withColumns(extra) if extra else df
        rest = [c for c in df.columns if c not in names]
        if not rest:
            return Table(keyed.select(*[quoted(c) for c in names]).distinct().select(*[quoted(c) for c in df.columns]), order=table.order)
        kept = keyed.groupBy(*[F.col(quoted(c)) for c in names]).agg(self._least(scope, table, rest).alias("_kept"))
        return Table(kept.select(*[F.col(quoted(c)) if c in names else F.col("_kept")[c].alias(c) for c in df.columns]), order=table.order)

    def _Join(self, n: Node, made: dict) -> Table:  # noqa: N802
        left = self._first(n, made).df
        for j in n.params.get("joins", []):
            source = j.get("source")
            if isinstance(source, dict) and source.get("type") == "table_function":
                args = source.get("args") or [source.get("argument")]
                alias = j.get("alias") or source.get("alias") or "unnest"
                name = (source.get("columns") or [alias])[0] if not isinstance(source.get("columns"), str) else source["columns"]
                left = left.withColumn(name, self._scope(left, made).eval({"type": "function_call", "function": "EXPLODE", "args": args[:1]}))
                continue
            if j.get("source_ref"):
                right = made[j["source_ref"]].df
            elif source in self.sources:
                right = self.sources[source]
            else:
                raise PlanError(f"Unknown join source: {source}")
            kind = str(j.get("kind") or "").upper()
            kind = f"{str(j['side']).upper()} {kind}".strip() if j.get("side") else kind
            kind = kind.replace(" INNER", "")
            if kind not in JOINS:
                raise PlanError(f"Unsupported join: {kind}")
            left = self._checked(self._joined(left, right, JOINS[kind], j, made), "Join")
        return Table(left)

    def _joined(self, left: DataFrame, right: DataFrame, how: str, j: dict, made: dict) -> DataFrame:
        """Columns of the right side that the left has too get the suffix ``__alias``, keys included."""
        suffix = j.get("alias") or "right"
        taken = {c.lower() for c in left.columns}
        right = right.select(*[F.col(quoted(c)).alias(f"{c}__{suffix}" if c.lower() in taken else c) for c in right.columns])
        left = left.select(*[F.col(quoted(c)).alias(c) for c in left.columns])
        if how == "cross" or j.get("on") is None:
            if how not in ("cross", "inner"):
                raise PlanError(f"a {how} join needs a condition")
            return left.crossJoin(right)
        both = left.crossJoin(right)  # only for its columns
        scope = self._scope(both, made)
        return left.join(right, self._condition(scope, j["on"]), how)

    def _condition(self, scope: Scope, on: dict) -> object:
        """ANSI as written; lenient: equal keys of different types meet as numbers, or as texts, and NULLs meet."""
        if not self.lenient or on.get("type") not in ("logical_op", "binary_op"):
            return scope.truth(on)
        if on["type"] == "logical_op" and on.get("op") == "AND":
            parts = [self._condition(scope, x) for x in on["operands"]]
            out = parts[0]
            for p in parts[1:]:
                out = out & p
            return out
        if on.get("op") != "=":
            return scope.truth(on)
        a, b = scope.eval(on["left"]), scope.eval(on["right"])
        ka, kb = scope.kind(a), scope.kind(b)
        if ka != kb:
            number = isinstance(ka, NumericType) or isinstance(kb, NumericType)
            a, b = (coerce.to_number(a), coerce.to_number(b)) if number else (a.cast("string"), b.cast("string"))
        return a.eqNullSafe(b)

    def _SetOp(self, n: Node, made: dict) -> Table:  # noqa: N802
        tables = [made[d].df for d in n.dependency if isinstance(made[d], Table)]
        if not tables:
            raise PlanError("SetOp needs a table")
        if len(tables) == 1:
            return Table(tables[0])
        op = str(n.params.get("operator", "UNION")).upper()
        out = tables[0]
        for right in tables[1:]:
            out = self._checked(self._combined(out, right, op), "SetOp")
        return Table(out)

    def _combined(self, left: DataFrame, right: DataFrame, op: str) -> DataFrame:
        if self.lenient:  # by name
            if op in ("UNION", "UNION ALL"):
                both = left.unionByName(right, allowMissingColumns=True)
                return both if op == "UNION ALL" else both.distinct()
            shared = [c for c in left.columns if c in right.columns]
            if op in ("INTERSECT", "EXCEPT"):
                a, b = left.alias("a"), right.select(*[quoted(c) for c in shared]).distinct().alias("b")
                cond = F.lit(True)
                for c in shared:
                    cond = cond & F.col(f"a.{quoted(c)}").eqNullSafe(F.col(f"b.{quoted(c)}"))
                return a.join(b, cond, "left_semi" if op == "INTERSECT" else "left_anti")
        by_position: dict[str, Callable] = {
            "UNION": lambda: left.union(right).distinct(), "UNION ALL": lambda: left.union(right),
            "INTERSECT": lambda: left.intersect(right), "INTERSECT ALL": lambda: left.intersectAll(right),
            "EXCEPT": lambda: left.subtract(right), "EXCEPT ALL": lambda: left.exceptAll(right),
        }
        if op not in by_position:
            raise PlanError(f"Unsupported set operation: {op}")
        return by_position[op]()

    def _RepeatUnion(self, n: Node, made: dict) -> Table:  # noqa: N802
        p = n.params
        limit = int(p.get("iteration_limit", -1))
        seed = self._subplan(p["seed_plan"], {})
        out = repeat_union(seed, lambda delta: self._subplan(p["recursive_plan"], {p["transient_table"]: delta}), limit if limit >= 0 else None, most=self.max_rounds)
        return Table(self._checked(out, "RepeatUnion"))

    def _subplan(self, plan: dict, transient: dict[str, DataFrame]) -> DataFrame:
        inner = Runner(self.spark, self.sources, self.lenient, self.max_rows, self.max_rounds, repair=False)
        inner.transient = self.transient | transient
        return inner.run({"nodes": plan.get("nodes", [])})[plan["output"]]

    def _FormatAnswer(self, n: Node, made: dict) -> object:  # noqa: N802
        answer = n.params.get("answer") or {}
        return format_answer(self._first(n, made).df, answer.get("name"), str(answer.get("type", "json")))

    def _AnalyzeEvidence(self, n: Node, made: dict) -> dict:  # noqa: N802
        return evidence(self._first(n, made).df, str(n.params.get("kind") or ""))


def _refers(e: object) -> bool:
    """The expression uses another node's result."""
    if isinstance(e, dict):
        return e.get("type") in ("scalar_ref", "set_ref", "in_subquery") or any(map(_refers, e.values()))
    return isinstance(e, list) and any(map(_refers, e))
