"""Expressions of operator graphs as columns.

An expression is a dict with a ``type``. ``Scope`` turns it into a Column over a DataFrame under one of two
semantics: ansi (three-valued logic, typed comparison) or lenient (values in text tables read
tolerantly, two-valued logic).
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, NumericType, StringType, StructType

from rowan.functions import coerce


class PlanError(ValueError):
    """A plan or expression that cannot be run."""


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def normal_name(name: str) -> str:
    """A column name without type suffix, line breaks, case and anything but letters and digits."""
    base = str(name).split("<gx:", 1)[0]
    for mark in ("\\n", "\\r", "\\t"):
        base = base.replace(mark, " ")
    return re.sub(r"[^a-z0-9]+", "", base.lower())


@dataclass
class Scope:
    """Columns that an expression may name, and the results of other nodes that it may refer to."""

    df: DataFrame
    lenient: bool = False
    outputs: dict[str, DataFrame] = field(default_factory=dict)
    _kinds: dict = field(default_factory=dict, repr=False)

    # ------------------------------------------------------------ names

    def name_of(self, expr: dict) -> str | None:
        """The column an expression names: with table suffix, exact, ignoring case, or by normal name; else None."""
        name, table, columns = str(expr.get("name")), expr.get("table"), self.df.columns
        if table and f"{name}__{table}" in columns:
            return f"{name}__{table}"
        if name in columns:
            return name
        for same in (lambda c: c.lower() == name.lower(), lambda c: normal_name(c) == normal_name(name) != ""):
            found = [c for c in columns if same(c)]
            if len(found) == 1:
                return found[0]
        return None

    def column(self, expr: dict) -> Column:
        name = self.name_of(expr)
        if name is not None:
            return F.col(quoted(name))
        if expr.get("table") is None and expr.get("name") and normal_name(expr["name"]) == "":
            return F.lit(str(expr["name"]))  # a quoted text without letters or digits is a literal
        raise PlanError(f"Unknown column: {expr.get('name')}; there are {self.df.columns}")

    def kind(self, c: Column):
        """The type of a column expression."""
        key = c._jc.toString()
        if key not in self._kinds:
            self._kinds[key] = self.df.select(c.alias("x")).schema["x"].dataType
        return self._kinds[key]

    # ------------------------------------------------------------ expressions

    def eval(self, expr: dict | None) -> Column:
        if expr is None:
            return F.lit(None)
        handler = getattr(self, "_" + str(expr.get("type")), None)
        if handler is None:
            raise PlanError(f"Unsupported expression: {expr.get('type')!r}")
        return handler(expr)

    def truth(self, expr: dict) -> Column:
        """A condition; in lenient mode never NULL."""
        c = self.eval(expr)
        return F.coalesce(c.cast("boolean"), F.lit(False)) if self.lenient else c

    def number(self, c: Column) -> Column:
        """An operand of arithmetic."""
        if isinstance(self.kind(c), StringType):
            return coerce.to_number(c) if self.lenient else c.cast("double")
        return c

    def _column(self, e: dict) -> Column:
        return self.column(e)

    def _identifier(self, e: dict) -> Column:
        return F.col(quoted(e["name"])) if e.get("name") in self.df.columns else F.lit(e.get("name"))

    def _literal(self, e: dict) -> Column:
        return F.lit(e.get("value"))

    def _null(self, _: dict) -> Column:
        return F.lit(None)

    _placeholder = _null

    def _tuple(self, e: dict) -> Column:
        return F.struct(*[self.eval(x).alias(f"_{i}") for i, x in enumerate(e.get("items", []))])

    def _referred(self, e: dict) -> DataFrame:
        """The one column of another node's result that is meant: the one named, else the first."""
        if e.get("source") not in self.outputs:
            raise PlanError(f"Unknown output: {e.get('source')}")
        df = self.outputs[e["source"]]
        return df.select(F.col(quoted(e["name"] if e.get("name") in df.columns else df.columns[0])))

    def _scalar_ref(self, e: dict) -> Column:
        """First value of a one-column result, NULL if it is empty."""
        return self._referred(e).limit(1).scalar()

    _set_ref = _scalar_ref

    def _compared(self, a: dict, b: dict) -> tuple[Column, Column]:
        x, y = self.eval(a), self.eval(b)
        if self.lenient:
            kx, ky = self.kind(x), self.kind(y)
            looks = lambda e: e.get("type") == "literal" and isinstance(e.get("value"), str) and re.fullmatch(r"\s*[+-]?[\d,]*\.?\d+%?\s*", e["value"])
            if isinstance(kx, StringType) and (isinstance(ky, NumericType) or looks(b)) or isinstance(ky, StringType) and (isinstance(kx, NumericType) or looks(a)):
                return coerce.to_number(x), coerce.to_number(y)
        return x, y

    def _binary_op(self, e: dict) -> Column:
        op = e["op"]
        if op in ("=", "!=", "<>", ">", ">=", "<", "<="):
            if op in ("=", "!=", "<>") and e["right"].get("type") == "set_ref":
                inside = self._in_subquery({"expr": e["left"], "query": e["right"]})
                return inside if op == "=" else ~inside
            x, y = self._compared(e["left"], e["right"])
            if isinstance(self.kind(x), ArrayType) and op in ("=", "!=", "<>"):
                c = F.array_contains(x, y)
                return c if op == "=" else ~c
            if op == "=":
                return x == y
            if op in ("!=", "<>"):
                return ~x.eqNullSafe(y) if self.lenient else x != y
            return {">": x > y, ">=": x >= y, "<": x < y, "<=": x <= y}[op]
        x, y = self.number(self.eval(e["left"])), self.number(self.eval(e["right"]))
        if op in ("+", "-", "*"):
            return {"+": x + y, "-": x - y, "*": x * y}[op]
        if op == "/":
            return F.try_divide(x.cast("double"), y.cast("double"))
        if op == "%":
            return F.when(y != 0, F.pmod(x, y)) if not self.lenient else F.when(y != 0, x - F.floor(x / y) * y)
        raise PlanError(f"Unsupported operator: {op}")

    def _logical_op(self, e: dict) -> Column:
        parts = [self.truth(x) for x in e.get("operands", [])]
        if not parts:
            return F.lit(True)
        if e.get("op") not in ("AND", "OR"):
            raise PlanError(f"Unsupported logical operator: {e.get('op')}")
        out = parts[0]
        for p in parts[1:]:
            out = out & p if e["op"] == "AND" else out | p
        return out

    def _not(self, e: dict) -> Column:
        return ~self.truth(e["expr"])

    def _is_null(self, e: dict) -> Column:
        return self.eval(e["expr"]).isNull()

    def _is_not_null(self, e: dict) -> Column:
        return self.eval(e["expr"]).isNotNull()

    def _between(self, e: dict) -> Column:
        return self.eval(e["expr"]).between(self.eval(e["low"]), self.eval(e["high"]))

    def _in(self, e: dict) -> Column:
        c = self.eval(e["expr"]).isin(*[self.eval(v) for v in e.get("values", [])])
        return F.coalesce(c, F.lit(False)) if self.lenient else c

    def _in_subquery(self, e: dict) -> Column:
        """Membership in another node's result, as a predicate subquery, so that it becomes a semi join."""
        return self.eval(e["expr"]).isin(self._referred(e["query"]))

    def _like(self, e: dict) -> Column:
        c, pattern = self.eval(e["expr"]).cast("string"), self.eval(e["pattern"])
        out = c.like(e["pattern"]["value"]) if e.get("case_sensitive", True) and e["pattern"].get("type") == "literal" else F.call_function("like" if e.get("case_sensitive", True) else "ilike", c, pattern)
        return F.coalesce(out, F.lit(False)) if self.lenient else out

    def _cast(self, e: dict) -> Column:
        c, to = self.eval(e["expr"]), str(e.get("to", "")).lower()
        text = isinstance(self.kind(c), StringType)
        if "int" in to:
            if text:
                c = coerce.to_number(c) if self.lenient else c.try_cast("double")
            return c.try_cast("bigint")
        if re.search("double|float|real|decimal|numeric", to):
            return (coerce.to_number(c) if text and self.lenient else c).try_cast("double")
        if re.search("char|text|string", to):
            return c.cast("string")
        if "bool" in to:
            return coerce.to_bool(c) if text else c.cast("boolean")
        if re.search("date|time", to):
            out = coerce.to_timestamp(c) if text else c.try_cast("timestamp")
            return out.cast("date") if to == "date" and not self.lenient else out
        return c

    def _case(self, e: dict) -> Column:
        out = None
        operand = e.get("operand")
        for b in e.get("ifs", []):
            cond = self.truth(b["condition"]) if operand is None else self.eval(operand) == self.eval(b["condition"])
            out = (F if out is None else out).when(cond, self.eval(b["value"]))
        default = self.eval(e.get("default"))
        return default if out is None else out.otherwise(default)

    def _filtered_expr(self, e: dict) -> Column:
        return F.when(self.truth(e["filter"]), self.eval(e["expr"]))

    def _aggregate_call(self, e: dict) -> Column:
        return aggregate(self, e)

    def _window_function(self, e: dict) -> Column:
        return window(self, e)

    def _function_call(self, e: dict) -> Column:
        name = str(e.get("function", "")).upper()
        args = list(e.get("args", []))
        if name in ("DATE_PART", "DATEPART", "AGE") and args and str(args[0].get("value", args[0].get("name"))).upper() == name:
            args = args[1:]
        if name in FUNCTIONS:
            return FUNCTIONS[name](self, args)
        if name in AGGREGATES or name in ("EVERY", "BOOL_OR", "LOGICAL_OR", "LOGICALOR"):
            return aggregate(self, {"function": name, "argument": args[0] if args else {"type": "wildcard"}})
        raise PlanError(f"Unsupported function: {name}")


# ---------------------------------------------------------------- sort keys


def sort_key(scope: Scope, key: dict, numeric: bool = False) -> Column:
    """A key of an order, NULLs last unless said otherwise; numeric: order a text by the number in it."""
    c = scope.eval(key["expr"])
    if numeric:
        c = coerce.to_number(c)
    down = str(key.get("direction", "ASC")).upper() == "DESC"
    first = str(key.get("nulls") or "LAST").upper() == "FIRST"
    if down:
        return c.desc_nulls_first() if first else c.desc_nulls_last()
    return c.asc_nulls_first() if first else c.asc_nulls_last()


# ---------------------------------------------------------------- aggregates


def _ordered_values(scope: Scope, a: dict, value: Column, cond: Column | None) -> Column:
    """Values of a group as an array that keeps NULLs, in the order and up to the limit asked for."""
    keys = a.get("order") or []
    fields, ranks, natural = [], [], True
    for i, k in enumerate(keys):
        c, down, nulls_first = scope.eval(k["expr"]), str(k.get("direction", "ASC")).upper() == "DESC", str(k.get("nulls") or "LAST").upper() == "FIRST"
        if down and isinstance(scope.kind(c), NumericType):
            c, down = -c, False
        fields += [(c.isNotNull() if nulls_first else c.isNull()).alias(f"n{i}"), c.alias(f"k{i}")]
        ranks.append((f"n{i}", f"k{i}", down))
        natural = natural and not down
    item = F.struct(*fields, value.alias("v"))
    rows = F.collect_list(item if cond is None else F.when(cond, item))
    if a.get("distinct"):
        rows = F.array_distinct(rows)
    if ranks and natural and not isinstance(scope.kind(value), (ArrayType, StructType)):
        rows = F.sort_array(rows)  # fields in order: NULL or not, key, and last the value
    elif ranks:

        def compare(x: Column, y: Column) -> Column:
            out = F.lit(0)
            for null, name, down in reversed(ranks):
                less, more = (F.lit(1), F.lit(-1)) if down else (F.lit(-1), F.lit(1))
                out = F.when(x[null] != y[null], F.when(x[null], F.lit(1)).otherwise(F.lit(-1))).when(x[name] < y[name], less).when(x[name] > y[name], more).otherwise(out)
            return out

        rows = F.array_sort(rows, compare)
    if a.get("limit") is not None:
        rows = F.slice(rows, 1, int(a["limit"]))
    return F.transform(rows, lambda r: r["v"])


def aggregate(scope: Scope, a: dict) -> Column:
    """An aggregate: {function, argument, distinct, filter, order, limit, parameters}."""
    name = str(a.get("function", "")).upper()
    argument = a.get("argument") or {"type": "wildcard"}
    cond = scope.truth(a["filter"]) if a.get("filter") is not None else None
    only = (lambda c: c) if cond is None else (lambda c: F.when(cond, c))
    if argument.get("type") == "wildcard":
        return F.count(only(F.lit(1)))
    value = scope.eval(argument)
    if name in ("ARRAY_AGG", "LIST"):
        return _ordered_values(scope, a, value, cond)
    if name in ("STRING_AGG", "GROUP_CONCAT", "LISTAGG"):
        separator = (a.get("parameters") or [{}])[0].get("value", ",")
        values = F.filter(_ordered_values(scope, a, value.cast("string"), cond), lambda v: v.isNotNull())
        return F.when(F.size(values) > 0, F.array_join(values, separator))
    if name in ("REGR_SLOPE", "REGR_INTERCEPT"):
        x = scope.number(scope.eval((a.get("parameters") or [None])[0]))
        y = scope.number(value)
        function = F.regr_slope if name == "REGR_SLOPE" else F.regr_intercept
        return function(only(y), only(x))
    if name not in AGGREGATES:
        raise PlanError(f"Unsupported aggregate: {name}")
    if a.get("number") and name not in ("MIN", "MAX"):
        value = F.col(quoted(a["number"]))
    return AGGREGATES[name](scope, a | ({"number": only(F.col(quoted(a["number"])))} if a.get("number") else {}), only(value))


def _numeric(f: Callable[[Column], Column], empty: object = None) -> Callable:
    def run(scope: Scope, a: dict, c: Column) -> Column:
        c = scope.number(c)
        if a.get("distinct"):
            if f in (F.sum, F.avg):
                out = F.sum_distinct(c) if f is F.sum else F.sum_distinct(c) / F.count_distinct(c)
            else:
                raise PlanError("DISTINCT is not supported by this aggregate")
        else:
            out = f(c)
        return F.coalesce(out, F.lit(empty)) if scope.lenient and empty is not None else out

    return run


def _extreme(least: bool) -> Callable:
    plain, by = (F.min, F.min_by) if least else (F.max, F.max_by)

    def run(scope: Scope, a: dict, c: Column) -> Column:
        if not scope.lenient or not isinstance(scope.kind(c), StringType):
            return plain(c)
        filled = F.nullif(F.trim(c), F.lit(""))
        n = F.count(filled)
        time = F.when(filled.rlike(coerce.DATE_SHAPE), coerce.to_timestamp(filled))
        number = a["number"] if a.get("number") is not None else coerce.to_number(filled)
        return F.when(n == F.count(time), by(filled, time)).when(n == F.count(number), by(filled, number)).otherwise(plain(filled))

    return run


def _share(a: dict, scope: Scope) -> float:
    value = (a.get("parameters") or [{}])[0].get("value")
    return max(0.0, min(1.0, float(value if value is not None else 0.5)))


def _percentile(name: str) -> Callable:
    def run(scope: Scope, a: dict, c: Column) -> Column:
        c = scope.number(c)
        if name == "cont":
            return F.percentile(c, F.lit(_share(a, scope)))
        # the element at position ceil(share x number of values)
        if a.get("prepared"):  # a column of the values, with which the parser's form can be used
            return F.expr(f"percentile_disc({_share(a, scope)!r}D) WITHIN GROUP (ORDER BY {quoted(a['prepared'])})")
        values = F.array_sort(F.collect_list(c))
        at = F.greatest(F.lit(1), F.ceil(F.lit(_share(a, scope)) * F.size(values))).cast("int")
        return F.try_element_at(values, at)

    return run


def _flag(f: Callable[[Column], Column], empty: bool) -> Callable:
    def run(scope: Scope, a: dict, c: Column) -> Column:
        c = coerce.to_bool(c) if isinstance(scope.kind(c), StringType) else c.cast("boolean")
        return F.coalesce(f(c), F.lit(empty)) if scope.lenient else f(c)

    return run


def _count(scope: Scope, a: dict, c: Column) -> Column:
    return F.count_distinct(c) if a.get("distinct") else F.count(c)


# Aggregates that read numbers in text.
NUMERIC = set("MIN MAX SUM TOTAL AVG MEAN MEDIAN STDDEV STDDEV_SAMP STDEV STDDEV_POP VARIANCE VAR_SAMP VAR_POP PERCENTILE_CONT".split())

AGGREGATES: dict[str, Callable] = {
    "COUNT": _count,
    "MIN": _extreme(True),
    "MAX": _extreme(False),
    "MEDIAN": _numeric(F.median),
    "PERCENTILE_CONT": _percentile("cont"),
    "PERCENTILE_DISC": _percentile("disc"),
    **dict.fromkeys(("SUM", "TOTAL"), _numeric(F.sum, 0.0)),
    **dict.fromkeys(("AVG", "MEAN"), _numeric(F.avg)),
    **dict.fromkeys(("STDDEV", "STDDEV_SAMP", "STDEV"), _numeric(F.stddev_samp)),
    **dict.fromkeys(("VARIANCE", "VAR_SAMP"), _numeric(F.var_samp)),
    "STDDEV_POP": _numeric(F.stddev_pop),
    "VAR_POP": _numeric(F.var_pop),
    **dict.fromkeys(("BOOL_OR", "LOGICAL_OR", "LOGICALOR"), _flag(F.bool_or, False)),
    **dict.fromkeys(("BOOL_AND", "EVERY", "LOGICAL_AND", "LOGICALAND"), _flag(F.bool_and, True)),
}

def prepare(scope: Scope, aggregations: list[dict]) -> tuple[Scope, list[dict]]:
    """Aggregations of which the engine's function takes columns only, and those that read numbers in text, get their values as columns of a new scope.

    So a text is read once, however many aggregates need its number.
    """
    extra, out = {}, []
    read: dict[str, str] = {}
    for i, a in enumerate(aggregations):
        name = str(a.get("function", "")).upper()
        if scope.lenient and name in NUMERIC and (a.get("argument") or {}).get("type") not in (None, "wildcard"):
            c = scope.eval(a["argument"])
            if isinstance(scope.kind(c), StringType):
                key = c._jc.toString()
                if key not in read:
                    read[key] = f"_number_{len(read)}"
                    extra[read[key]] = coerce.to_number(c)
                a = a | {"number": read[key]}
        if str(a.get("function", "")).upper() == "PERCENTILE_DISC":
            c = scope.number(scope.eval(a["argument"]))
            extra[f"_values_{i}"] = c if a.get("filter") is None else F.when(scope.truth(a["filter"]), c)
            a = a | {"prepared": f"_values_{i}"}
        out.append(a)
    return (Scope(scope.df.withColumns(extra), scope.lenient, scope.outputs), out) if extra else (scope, out)


# ---------------------------------------------------------------- window functions


def window(scope: Scope, e: dict) -> Column:
    """{function: {function, args}, partition_by: [expr], order: [key], frame?: {type, start, end}}; also any aggregate.

    A frame is of ROWS (default) or RANGE; an end that is not given is open. FIRST_VALUE, LAST_VALUE and NTH_VALUE without a frame see the whole partition.
    """
    call = e.get("function", {})
    name, args = str(call.get("function", "")).upper(), list(call.get("args", []))
    w = Window.partitionBy(*[scope.eval(p) for p in e.get("partition_by", [])]) if e.get("partition_by") else Window.partitionBy(F.lit(0))
    keys = [sort_key(scope, k) for k in e.get("order", [])]
    ordered = w.orderBy(*keys) if keys else w.orderBy(F.lit(0))
    whole = (ordered if keys else w).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    frame = e.get("frame")
    if frame:
        bound = lambda v, edge: edge if v is None else int(v)
        limits = bound(frame.get("start"), Window.unboundedPreceding), bound(frame.get("end"), Window.unboundedFollowing)
        kind = str(frame.get("type") or "ROWS").upper()
        if kind not in ("ROWS", "RANGE"):
            raise PlanError(f"Unsupported frame: {kind}")
        framed = ordered.rowsBetween(*limits) if kind == "ROWS" else ordered.rangeBetween(*limits)
        whole = framed
    literal = lambda i, default: args[i].get("value", default) if len(args) > i else default
    ranks = {"ROW_NUMBER": F.row_number, "RANK": F.rank, "DENSE_RANK": F.dense_rank, "PERCENT_RANK": F.percent_rank, "CUME_DIST": F.cume_dist}
    if name in ranks:
        return ranks[name]().over(ordered)
    if name == "NTILE":
        return F.ntile(int(literal(0, 1))).over(ordered)
    if name in ("LEAD", "LAG"):
        f = F.lead if name == "LEAD" else F.lag
        return f(scope.eval(args[0]), int(literal(1, 1)), literal(2, None)).over(ordered)
    if name in ("FIRST_VALUE", "LAST_VALUE"):
        return (F.first if name == "FIRST_VALUE" else F.last)(scope.eval(args[0])).over(whole)
    if name == "NTH_VALUE":
        return F.nth_value(scope.eval(args[0]), int(literal(1, 1))).over(whole)
    over = framed if frame else ordered if keys else w
    return aggregate(scope, {**call, "argument": call.get("argument") or (args[0] if args else {"type": "wildcard"})}).over(over)


# ---------------------------------------------------------------- scalar functions


def _text(s: Scope, e: dict) -> Column:
    return s.eval(e).cast("string")


def _value(e: dict, default: object = None) -> object:
    if e.get("type") not in ("literal", "identifier", "column", None):
        raise PlanError("a literal is needed here")
    return e.get("value", e.get("name", default))


def _time(s: Scope, e: dict) -> Column:
    c = s.eval(e)
    return coerce.to_timestamp(c) if isinstance(s.kind(c), StringType) else c


def _part(s: Scope, part: dict, source: dict) -> Column:
    name = str(_value(part)).lower()
    c = s.eval(source)
    if isinstance(s.kind(c), StructType):
        if name not in ("year", "month", "day"):
            raise PlanError(f"an interval has no {name}")
        return c[name + "s"]
    t = _time(s, source)
    parts = {"year": F.year, "month": F.month, "day": F.dayofmonth, "quarter": F.quarter, "doy": F.dayofyear, "dayofyear": F.dayofyear, "hour": F.hour, "minute": F.minute}
    if name in ("dow", "dayofweek"):
        return F.weekday(t) if s.lenient else F.dayofweek(t) - 1  # from Monday, or from Sunday as 0
    if name not in parts:
        raise PlanError(f"Unsupported part: {name}")
    return parts[name](t)


def age(end: Column, start: Column) -> Column:
    """Years, months and days between two dates by the calendar; negative if end is before start."""
    a, b = F.least(end, start).cast("date"), F.greatest(end, start).cast("date")
    months = 12 * (F.year(b) - F.year(a)) + F.month(b) - F.month(a) - F.when(F.dayofmonth(b) < F.dayofmonth(a), 1).otherwise(0)
    days = F.datediff(b, F.add_months(a, months))
    sign = F.when(end.cast("date") < start.cast("date"), -1).otherwise(1)
    out = F.struct((sign * F.floor(months / 12)).cast("int").alias("years"), (sign * (months % 12)).cast("int").alias("months"), (sign * days).cast("int").alias("days"))
    return F.when(end.isNotNull() & start.isNotNull(), out)


def _substring(s: Scope, args: list[dict]) -> Column:
    c, start = _text(s, args[0]), s.eval(args[1]) if len(args) > 1 else F.lit(1)
    n = F.length(c)
    begin = F.when(start > 0, start).when(start == 0, 1).otherwise(F.greatest(n + start + 1, F.lit(1)))
    if len(args) < 3:
        return F.substring(c, begin.cast("int"), n)
    return F.substring(c, begin.cast("int"), F.greatest(s.eval(args[2]), F.lit(0)).cast("int"))


def _position(s: Scope, args: list[dict]) -> Column:
    """Place of one text in another; a column in first place is searched in, as is the first of two other values."""
    hay, needle = (args[0], args[1]) if args[0].get("type") != "literal" else (args[1], args[0])
    return F.call_function("locate", _text(s, needle), _text(s, hay))


def _split_part(s: Scope, args: list[dict]) -> Column:
    parts = F.split(_text(s, args[0]), re.escape(str(_value(args[1], ","))).replace("\\ ", " "))
    return F.try_element_at(parts, F.lit(int(_value(args[2], 1) if len(args) > 2 else 1)))


def _list(s: Scope, e: dict) -> Column:
    c = s.eval(e)
    return c if isinstance(s.kind(c), ArrayType) else coerce.parse_list(c.cast("string"))


FUNCTIONS: dict[str, Callable[[Scope, list[dict]], Column]] = {
    "LOWER": lambda s, a: F.lower(_text(s, a[0])),
    "UPPER": lambda s, a: F.upper(_text(s, a[0])),
    "TRIM": lambda s, a: F.regexp_replace(_text(s, a[0]), r"(?U)^\s+|\s+$", ""),
    "LTRIM": lambda s, a: F.regexp_replace(_text(s, a[0]), r"(?U)^\s+", ""),
    "RTRIM": lambda s, a: F.regexp_replace(_text(s, a[0]), r"(?U)\s+$", ""),
    **dict.fromkeys(("LENGTH", "LEN"), lambda s, a: F.length(_text(s, a[0]))),
    **dict.fromkeys(("STR_POSITION", "STRPOS", "INSTR", "LOCATE", "POSITION"), _position),
    "ABS": lambda s, a: F.abs(s.number(s.eval(a[0]))),
    "ROUND": lambda s, a: (F.bround if s.lenient else F.round)(s.number(s.eval(a[0])), int(_value(a[1], 0)) if len(a) > 1 else 0),
    **dict.fromkeys(("CEIL", "CEILING"), lambda s, a: F.ceil(s.number(s.eval(a[0])))),
    "FLOOR": lambda s, a: F.floor(s.number(s.eval(a[0]))),
    **dict.fromkeys(("COALESCE", "IFNULL"), lambda s, a: F.coalesce(*map(s.eval, a))),
    "NULLIF": lambda s, a: F.when(~F.coalesce(s._binary_op({"op": "=", "left": a[0], "right": a[1]}), F.lit(False)), s.eval(a[0])),
    "CONCAT": lambda s, a: F.concat_ws("", *[_text(s, x) for x in a]),
    **dict.fromkeys(("SUBSTRING", "SUBSTR"), _substring),
    "LEFT": lambda s, a: F.left(_text(s, a[0]), s.eval(a[1])),
    "RIGHT": lambda s, a: F.right(_text(s, a[0]), s.eval(a[1])),
    "REPLACE": lambda s, a: F.replace(_text(s, a[0]), s.eval(a[1]), s.eval(a[2]) if len(a) > 2 else F.lit("")),
    "REGEXP_REPLACE": lambda s, a: F.regexp_replace(_text(s, a[0]), str(_value(a[1])), re.sub(r"\\(\d)", r"$\1", str(_value(a[2], ""))) if len(a) > 2 else ""),
    "SPLIT_PART": _split_part,
    **dict.fromkeys(("SPLIT", "STRING_TO_ARRAY"), lambda s, a: coerce.split_list(_text(s, a[0]), str(_value(a[1], ",")) if len(a) > 1 else ",")),
    "REGEXP_SPLIT_TO_ARRAY": lambda s, a: F.split(_text(s, a[0]), str(_value(a[1]))),
    **dict.fromkeys(("ARRAY_SIZE", "ARRAY_LENGTH", "CARDINALITY"), lambda s, a: F.size(_list(s, a[0]))),
    "EXPLODE": lambda s, a: F.explode_outer(_list(s, a[0])),
    **dict.fromkeys(("DATE_PART", "DATEPART", "EXTRACT"), lambda s, a: _part(s, a[0], a[1])),
    **{p: lambda s, a, p=p: _part(s, {"type": "literal", "value": p}, a[0]) for p in ("YEAR", "MONTH", "DAY", "QUARTER")},
    "AGE": lambda s, a: age(_time(s, a[0]), _time(s, a[1]) if len(a) > 1 else F.current_date()),
    **dict.fromkeys(("STR_TO_TIME", "STRPTIME"), lambda s, a: F.try_to_timestamp(_text(s, a[0]), F.lit(coerce.date_pattern(str(_value(a[1]))))) if len(a) > 1 else _time(s, a[0])),
    "DATE": lambda s, a: _time(s, a[0]).cast("date"),
    "CURRENT_DATE": lambda s, a: F.current_date(),
}
