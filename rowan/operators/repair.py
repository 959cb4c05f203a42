"""Repair of literals in a filter that finds nothing, and why it found nothing."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rowan.plans.expr import Scope, quoted


def _plain(c: Column) -> Column:
    """A text as literals are compared: trimmed, small, single blanks."""
    return F.regexp_replace(F.lower(F.regexp_replace(c.cast("string"), r"(?U)^\s+|\s+$", "")), r"(?U)\s+", " ")


def _plain_text(s: str) -> str:
    return " ".join(s.casefold().split())


def _leaves(e: dict) -> Iterator[dict]:
    """Conditions of a predicate below AND and OR, from left to right."""
    if e.get("type") == "logical_op":
        for x in e.get("operands", []):
            yield from _leaves(x)
    else:
        yield e


def _about(scope: Scope, e: dict) -> tuple[str, list[str]] | None:
    """The column and the text literals of a condition with = or IN that could be repaired."""
    if e.get("type") == "in":
        column, values = e["expr"], e.get("values", [])
    elif e.get("type") == "binary_op" and e.get("op") == "=":
        column, values = (e["left"], [e["right"]]) if e["left"].get("type") == "column" else (e["right"], [e["left"]])
    else:
        return None
    texts = [v.get("value") if v.get("type") == "literal" else None for v in values]
    name = scope.name_of(column) if column.get("type") == "column" else None
    usable = name is not None and bool(texts) and all(isinstance(x, str) and _plain_text(x) for x in texts)
    return (name, texts) if usable else None


def _tolerant(scope: Scope, leaves: list[dict]) -> dict[int, tuple[Column, dict]]:
    """Tolerant forms of the leaves that have one: LIKE without case; = and IN by plain text, if each literal stands for exactly one value of its column.

    One aggregation over all leaves: a literal stands for one value if the least and the greatest value of its plain form are the same.
    """
    out: dict[int, tuple[Column, dict]] = {}
    asked: dict[tuple[int, str], tuple[Column, Column]] = {}
    for i, e in enumerate(leaves):
        if e.get("type") == "like" and e["expr"].get("type") == "column" and isinstance(e["pattern"].get("value"), str):
            name = scope.name_of(e["expr"])
            if name is not None:
                out[i] = F.col(quoted(name)).cast("string").ilike(e["pattern"]["value"]), {"op": "LIKE", "column": name, "value": e["pattern"]["value"]}
        elif about := _about(scope, e):
            c = F.col(quoted(about[0]))
            for w in {_plain_text(x) for x in about[1]}:
                same = F.when(_plain(c) == w, c.cast("string"))
                asked[i, w] = F.min(same), F.max(same)
    if asked:
        row = scope.df.agg(*[f.alias(f"{side}{k}") for k, pair in enumerate(asked.values()) for side, f in zip(("low", "high"), pair)]).first()
        one = {key: row[f"low{k}"] is not None and row[f"low{k}"] == row[f"high{k}"] for k, key in enumerate(asked)}
        for i in {i for i, _ in asked}:
            name, texts = _about(scope, leaves[i])
            wanted = sorted({_plain_text(x) for x in texts})
            if all(one[i, w] for w in wanted):
                out[i] = _plain(F.col(quoted(name))).isin(wanted), {"op": "IN" if leaves[i]["type"] == "in" else "=", "column": name, "values": texts}
    return out


def _holds(e: dict, bits: Iterator[bool]) -> bool:
    """The truth of a predicate by the truth of its leaves, from left to right."""
    if e.get("type") != "logical_op":
        return next(bits)
    parts = [_holds(x, bits) for x in e.get("operands", [])]
    return all(parts) if e.get("op") == "AND" else any(parts)


def repair_filter(df: DataFrame, predicate: dict, lenient: bool = True) -> tuple[DataFrame, list[dict]]:
    """The filtered rows; if there is none though df has rows, those of the repaired filter, and what was repaired.

    A literal is repaired to the one value that equals it ignoring case and white space; with several such values it
    stays. A tolerant condition holds wherever the condition as written does, so the more conditions are repaired the more rows
    there are. From left to right a condition stays as written if the filter still finds a row with all those after it repaired;
    so no condition is repaired without need, and the last of several alternatives is. However many conditions there are, this takes
    three small jobs: whether the filter is empty, what the literals stand for, and which sets of conditions hold together
    in some row. Lazy plans do not use it unless asked to.
    """
    scope = Scope(df, lenient)
    written = df.filter(scope.truth(predicate))
    if not written.isEmpty() or df.isEmpty():
        return written, []
    leaves = list(_leaves(predicate))
    tolerant = _tolerant(scope, leaves)
    if not tolerant:
        return written, []
    exact = [F.coalesce(scope.eval(e).cast("boolean"), F.lit(False)) for e in leaves]
    loose = [F.coalesce(tolerant[i][0], F.lit(False)) | exact[i] if i in tolerant else exact[i] for i in range(len(leaves))]
    digit = lambda i: F.when(exact[i], "2").when(loose[i], "1").otherwise("0")
    seen = [r.held for r in df.select(F.concat(*[digit(i) for i in range(len(leaves))]).alias("held")).distinct().collect()]
    holds = lambda repaired: any(_holds(predicate, iter([x == "2" or x == "1" and i in repaired for i, x in enumerate(h)])) for h in seen)
    repaired = set(tolerant)
    if not holds(repaired):
        return written, []
    for i in sorted(tolerant):
        if holds(repaired - {i}):
            repaired.discard(i)
    columns = iter([loose[i] if i in repaired else exact[i] for i in range(len(leaves))])

    def rebuilt(e: dict) -> Column:
        if e.get("type") != "logical_op":
            return next(columns)
        out = None
        for x in e.get("operands", []):
            c = rebuilt(x)
            out = c if out is None else out & c if e["op"] == "AND" else out | c
        return F.lit(True) if out is None else out

    return df.filter(rebuilt(predicate)), [tolerant[i][1] for i in sorted(repaired)]


def classify_empty_filter(df: DataFrame, column: str, literal: str) -> dict:
    """Why a literal finds nothing in a column: quoting, format, wrong_column, not_found, or system_bug if it is there; with columns that hold it."""
    plain = _plain_text(literal)
    bare = plain.strip("'\"` ")
    squeezed = "".join(ch for ch in bare if ch.isalnum())
    text = [c for c, t in df.dtypes if t == "string"]
    squeeze = lambda c: F.regexp_replace(F.lower(F.col(quoted(c)).cast("string")), r"[^\p{L}\p{N}]", "")
    aggs = []
    for i, c in enumerate(dict.fromkeys([column, *text])):
        aggs += [
            F.max((F.col(quoted(c)).cast("string") == literal).cast("int")).alias(f"same{i}"),
            F.max((_plain(F.col(quoted(c))) == bare).cast("int")).alias(f"bare{i}"),
            F.max((squeeze(c) == squeezed).cast("int")).alias(f"loose{i}"),
        ]
    r = df.agg(*aggs).first()
    names = list(dict.fromkeys([column, *text]))
    others = [c for i, c in enumerate(names) if i and (r[f"same{i}"] or r[f"bare{i}"])]
    if r["same0"]:
        reason = "system_bug"
    elif r["bare0"]:
        reason = "quoting" if bare != plain else "format"
    elif squeezed and r["loose0"]:
        reason = "format"
    else:
        reason = "wrong_column" if others else "not_found"
    return {"reason": reason, "column": column, "literal": literal, "candidate_columns": others}


def why_empty(scope: Scope, predicate: dict) -> list[dict]:
    """classify_empty_filter for each text literal of a predicate's conditions with = or IN."""
    return [classify_empty_filter(scope.df, about[0], x) for e in _leaves(predicate) if (about := _about(scope, e)) for x in about[1]]
