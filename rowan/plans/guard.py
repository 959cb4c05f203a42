"""What a statement may do: checked on the parser's plan, not on its text."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession

from rowan.plans.expr import PlanError

# Nodes of a parsed plan that only read what they are given.
NODES = set(
    "Aggregate Deduplicate Distinct Except Filter Generate GlobalLimit Intersect Join LateralJoin LocalLimit LocalRelation Offset OneRowRelation Pivot Project Range ResolvedInlineTable Sample Sort SubqueryAlias Tail Union UnionLoop Unpivot "
    "UnresolvedHaving UnresolvedHint UnresolvedInlineTable UnresolvedPivot UnresolvedRelation UnresolvedSubqueryColumnAliases UnresolvedTVFAliases UnresolvedTableValuedFunction UnresolvedUnpivot UnresolvedWith Window WithWindowDefinition".split()
)
# Functions of the engine that reach beyond the data, and the table functions that are allowed.
DENIED = set("reflect java_method try_reflect input_file_name input_file_block_start input_file_block_length".split())
TABLE_FUNCTIONS = set("range explode explode_outer inline inline_outer posexplode posexplode_outer stack json_tuple variant_explode variant_explode_outer".split())


def _items(seq) -> list:
    return [seq.apply(i) for i in range(seq.size())]


def _kind(x) -> str:
    return x.getClass().getSimpleName().rstrip("$")


def _parts(seq) -> list[str]:
    return [str(p) for p in _items(seq)]


def _expressions(plan) -> Iterator:
    todo = _items(plan.expressions())
    while todo:
        e = todo.pop()
        yield e
        todo += _items(e.children())


def known_functions(spark: SparkSession) -> set[str]:
    names = spark._jvm.org.apache.spark.sql.catalyst.analysis.FunctionRegistry.functionSet().iterator()
    out = set()
    while names.hasNext():
        out.add(names.next().funcName().lower())
    return out - DENIED


def check_plan(spark: SparkSession, statement: str, sources: set[str]) -> None:
    """An error unless the statement is a query over the named sources, its own CTEs and values, with functions of the engine that stay within the data."""
    allowed = {s.lower() for s in sources}
    functions: set[str] = set()

    def visit(plan, names: set[str]) -> None:
        kind = _kind(plan)
        if kind not in NODES:
            raise PlanError(f"only queries are allowed, not {kind}")
        if kind == "UnresolvedWith":
            names = set(names)
            ctes = _items(plan.cteRelations())
            names |= {str(c._1()).lower() for c in ctes}
            for c in ctes:
                visit(c._2(), names)
        elif kind == "UnresolvedRelation":
            parts = _parts(plan.multipartIdentifier())
            if len(parts) != 1 or parts[0].lower() not in names:
                raise PlanError(f"Unknown source: {'.'.join(parts)}")
        elif kind == "UnresolvedTableValuedFunction":
            name = ".".join(_parts(plan.name())).lower()
            if name not in TABLE_FUNCTIONS:
                raise PlanError(f"Unsupported table function: {name}")
        for e in _expressions(plan):
            what = _kind(e)
            if what == "UnresolvedFunction":
                functions.add(".".join(_parts(e.nameParts())).lower())
            elif what == "UnresolvedGenerator":
                functions.add(e.name().funcName().lower())
            elif what in ("ScalarSubquery", "Exists", "ListQuery", "LateralSubquery"):
                visit(e.plan(), names)
        for child in _items(plan.children()):
            visit(child, names)

    visit(spark._jsparkSession.sessionState().sqlParser().parsePlan(statement), allowed)
    if unknown := sorted(functions - known_functions(spark)):
        raise PlanError(f"Unsupported function: {', '.join(unknown)}")
