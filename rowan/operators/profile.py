"""Understanding tables: profiles, samples, join discovery, grounding of questions."""

from __future__ import annotations

import re
from collections import deque
from difflib import SequenceMatcher
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, IntegralType, NumericType

from rowan.functions.coerce import to_number
from rowan.plans.expr import quoted
from rowan.session import cut_lineage

# Columns that one aggregation takes; wider tables take several.
MOST_COLUMNS = 48
# Limits and weights of scores of join candidates.
LEAST_OVERLAP = 2
LEAST_SCORE = 0.5
COVERAGE_WEIGHT, NAME_WEIGHT, KEY_WEIGHT, OTHER_ENTITY = 0.80, 0.18, 0.02, 0.35
VALUES_A_COLUMN = 3
# Texts that stand for nothing, and words of questions that name nothing.
NOTHING = ("", "none", "null", "nan", "na", "n/a")
QUESTION_WORDS = set("a an and are as at by did do does for from had has have how in is it its list many much name names of on or show than that the their there these this those to was were what when where which who whose why with".split())


def blocks(columns: list[str]) -> list[list[str]]:
    """The columns in blocks of MOST_COLUMNS, each of which is read at once."""
    return [columns[i : i + MOST_COLUMNS] for i in range(0, len(columns), MOST_COLUMNS)]


def profile_columns(df: DataFrame) -> DataFrame:
    """One row for each column: column, kind (empty, number, mixed, string), filled, numbers, low, high; one aggregation for each MOST_COLUMNS columns.

    low and high are the least and the greatest value as text.
    """
    return reduce(DataFrame.union, [_profiles(df, block) for block in blocks(df.columns)])


def _profiles(df: DataFrame, columns: list[str]) -> DataFrame:
    packed = []
    for c in columns:
        kind = df.schema[c].dataType.simpleString()
        text = F.col(quoted(c)).cast("string") if not kind.startswith(("array", "map", "struct", "binary")) else F.to_json(F.struct(F.col(quoted(c))))
        filled = F.when(~F.lower(F.trim(text)).isin(*NOTHING), text)
        packed.append(F.struct(F.lit(c).alias("column"), F.count(filled).alias("filled"), F.count(to_number(F.when(filled.rlike(r"^\s*[-+$]?\s*[\d,]*\.?\d+\s*%?\s*$"), filled))).alias("numbers"), F.min(filled).alias("low"), F.max(filled).alias("high")))
    out = df.agg(F.array(*packed).alias("m")).select(F.inline("m"))
    kind = F.when(F.col("filled") == 0, "empty").when(F.col("numbers") == F.col("filled"), "number").when(F.col("numbers") > 0, "mixed").otherwise("string")
    return out.select("column", kind.alias("kind"), "filled", "numbers", "low", "high")


def describe_source(df: DataFrame, source_id: str, rows: int = 18, head: int = 5, tail: int = 2, width: int = 80) -> dict:
    """Shape, columns and samples of a source, without its place: the least distinct values of each column, the greatest ones, and some rows.

    Two jobs, however many columns there are: one for the rows shown, one that keeps the first and last few values of each column and bucket of values, and
    of these the first and last few.
    """
    cut = lambda v: str(v)[:width]
    parts = [df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("c"), F.col(quoted(c)).cast("string").alias("v")) for c in block]))) for block in blocks(df.columns) if block]
    samples: dict[str, list[str]] = {c: [] for c in df.columns}
    total = 0
    if parts:
        long = reduce(DataFrame.union, parts).withColumn("b", F.pmod(F.xxhash64("v"), F.lit(64)))
        filled = F.when(F.trim("v") != "", F.col("v"))
        # each bucket keeps its least and greatest values only
        kept = long.groupBy("c", "b", "v").agg(F.count("*").alias("n"))
        few = [F.row_number().over(Window.partitionBy("c", "b").orderBy(o)) for o in (F.col("v").asc_nulls_last(), F.col("v").desc_nulls_last())]
        counts = kept.groupBy("c").agg(F.sum("n").alias("rows"))
        near = kept.withColumn("v", filled).filter("v is not null").withColumns({"up": few[0], "down": few[1]}).filter((F.col("up") <= head) | (F.col("down") <= tail))
        ends = near.groupBy("c").agg(F.array_sort(F.collect_set("v")).alias("vs"))
        for r in counts.join(ends, "c", "left").collect():
            total = r.rows
            values = r.vs or []
            samples[r.c] = [cut(v) for v in dict.fromkeys([*values[:head], *values[max(head, len(values) - tail) :]])]
    shown = [{k: None if v is None else cut(v) for k, v in r.asDict().items()} for r in df.limit(rows).collect()]
    return {"id": source_id, "type": "table", "schema": {"columns": df.columns, "shape": [total, len(df.columns)], "samples": samples, "rows": shown}}


def inspect(df: DataFrame, what: str, column: str | None = None, n: int | None = None) -> DataFrame:
    """schema, sample (at most 10 rows), values (the most frequent, at most 30), or describe (numbers of a column)."""
    if what == "schema":
        return df.sparkSession.createDataFrame(df.dtypes, "column string, type string")
    if what == "sample":
        return df.limit(min(n or 10, 10))
    if what == "values":
        return df.groupBy(F.col(quoted(column)).cast("string").alias("value")).count().orderBy(F.col("count").desc(), "value").limit(min(n or 30, 30))
    if what == "describe":
        x = to_number(F.col(quoted(column)).cast("string"))
        return df.agg(F.count(F.lit(1)).alias("rows"), F.count(x).alias("numbers"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"))
    raise ValueError(f"nothing to inspect: {what}")


# ---------------------------------------------------------------- join discovery


def join_value(c: Column, kind: DataType | None = None) -> Column:
    """A value as join keys compare: numbers in one form, texts trimmed, small, single blanks; NULL for what stands for nothing.

    With the column's type, whole numbers and dates are taken as they are.
    """
    if isinstance(kind, (IntegralType, DateType)):
        return c.cast("string")
    s = F.trim(c.cast("string"))
    low = F.lower(s)
    plain = F.replace(s, F.lit(","), F.lit(""))
    digits = F.translate(plain, "0123456789.+-", "") == ""
    number = c.cast("double") if isinstance(kind, NumericType) else F.when(digits & plain.rlike(r"^[-+]?(\d+(\.\d*)?|\.\d+)$"), plain.try_cast("double"))
    whole = F.when((number == F.floor(number)) & (F.abs(number) < 1e15), number.cast("bigint").cast("string"))
    text = F.when(low.rlike(r"(?U)\s\s|[\s&&[^ ]]"), F.regexp_replace(low, r"(?U)\s+", " ")).otherwise(low)
    return F.when(~low.isin(*NOTHING), F.coalesce(whole, number.cast("string"), text))


def _plain_name(name: str) -> str:
    return re.sub(r"[^a-z0-9]+", "", name.lower())


def name_similarity(a: str, b: str) -> float:
    a, b = _plain_name(a), _plain_name(b)
    if not a or not b:
        return 0.0
    return 1.0 if a == b else SequenceMatcher(None, a, b).ratio()


def _other_entity(a: str, b: str) -> bool:
    """Both are ids, of entities with different names."""
    ma, mb = (re.fullmatch(r"(.*?)_?id", x.lower()) for x in (a, b))
    return bool(ma and mb and ma[1].strip("_") != mb[1].strip("_") and ma[1].strip("_") and mb[1].strip("_"))


def join_candidates(tables: dict[str, DataFrame], keys: dict[str, set[str]] | None = None, most: int | None = None) -> list[dict]:
    """Pairs of columns of different tables that hold the same values, best first; all of them, or the ``most`` best.

    All values count. Each table is read once (for each MOST_COLUMNS columns) into (value, column); one shuffle by value makes
    of a value's columns a set of bits, values of equal sets are counted together, and pairs of columns come from these few sets, so no table is joined
    with another and no value leaves the executors.
    score = 0.80 x mean coverage + 0.18 x likeness of names + 0.02 x key hint, and 0.35 of that for ids of different
    entities. keys: columns known as keys, by table. Pairs that can't reach LEAST_SCORE are dropped before the driver sees them.
    """
    index: list[tuple[str, str]] = []
    parts: list[DataFrame] = []
    for name, df in tables.items():
        for block in blocks([c for c in df.columns if not df.schema[c].dataType.simpleString().startswith(("array", "map", "struct", "binary"))]):
            values = [F.struct(F.lit(len(index) + i).alias("c"), join_value(F.col(quoted(c)), df.schema[c].dataType).alias("v")) for i, c in enumerate(block)]
            index += [(name, c) for c in block]
            parts.append(df.select(F.inline(F.array(*values))).filter("v is not null"))
    if not parts:
        return []
    words = range((len(index) + 62) // 63)
    bit = lambda w: F.when(F.floor(F.col("c") / 63) == w, F.call_function("shiftleft", F.lit(1).cast("bigint"), (F.col("c") % 63).cast("int"))).otherwise(F.lit(0).cast("bigint"))
    sets = reduce(DataFrame.union, parts).groupBy("v").agg(*[F.bit_or(bit(w)).alias(f"w{w}") for w in words])
    counted = sets.groupBy(*[f"w{w}" for w in words]).agg(F.count("*").alias("n"))
    has = lambda i: F.col(f"w{i // 63}").bitwiseAND(F.lit(1 << i % 63)) != 0
    columns = F.filter(F.array(*[F.when(has(i), F.lit(i)) for i in range(len(index))]), lambda c: c.isNotNull())
    held = cut_lineage(counted.select("n", columns.alias("cs")))
    sizes = {r.a: r.n for r in held.select(F.explode("cs").alias("a"), "n").groupBy("a").agg(F.sum("n").alias("n")).collect()}
    pair = F.flatten(F.transform("cs", lambda a: F.transform(F.filter("cs", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    overlaps = held.select(F.inline(F.transform(pair, lambda p: F.struct(p["a"].alias("a"), p["b"].alias("b"), F.col("n").alias("n"))))).groupBy("a", "b").agg(F.sum("n").alias("n"))
    small = tables[index[0][0]].sparkSession.createDataFrame([(i, n) for i, n in sizes.items()], "c int, size bigint")
    both = overlaps.join(F.broadcast(small.select(F.col("c").alias("a"), F.col("size").alias("sa"))), "a").join(F.broadcast(small.select(F.col("c").alias("b"), F.col("size").alias("sb"))), "b")
    worth = both.filter((F.col("n") >= LEAST_OVERLAP) & (COVERAGE_WEIGHT * (F.col("n") / F.col("sa") + F.col("n") / F.col("sb")) / 2 + NAME_WEIGHT + KEY_WEIGHT >= LEAST_SCORE))
    out = []
    for a, b, overlap in worth.select("a", "b", "n").collect():
        (ta, ca), (tb, cb) = index[a], index[b]
        if ta == tb:
            continue
        coverage = overlap / sizes[a], overlap / sizes[b]
        hint = float(bool(keys and (ca in keys.get(ta, ()) or cb in keys.get(tb, ()))))
        score = COVERAGE_WEIGHT * sum(coverage) / 2 + NAME_WEIGHT * name_similarity(ca, cb) + KEY_WEIGHT * hint
        if _other_entity(ca, cb):
            score *= OTHER_ENTITY
        if score >= LEAST_SCORE:
            out.append({"left_table": ta, "left_column": ca, "right_table": tb, "right_column": cb, "score": round(score, 3), "overlap": overlap, "left_coverage": round(coverage[0], 3), "right_coverage": round(coverage[1], 3)})
    out.sort(key=lambda x: (-x["score"], -x["overlap"], x["left_table"], x["left_column"], x["right_table"], x["right_column"]))
    return out[:most]


def join_paths(candidates: list[dict], most: int | None = None) -> list[dict]:
    """Shortest chains of candidate joins between tables; of equal length the one of the highest mean score."""
    near: dict[str, list[tuple[str, dict]]] = {}
    for c in candidates:
        near.setdefault(c["left_table"], []).append((c["right_table"], c))
        near.setdefault(c["right_table"], []).append((c["left_table"], c))
    out = []
    for start in sorted(near):
        best: dict[str, tuple[int, float, list[dict]]] = {start: (0, 0.0, [])}
        queue = deque([start])
        while queue:
            t = queue.popleft()
            length, total, path = best[t]
            for other, c in near[t]:
                new = (length + 1, total + c["score"], [*path, c])
                if other not in best:
                    best[other] = new
                    queue.append(other)
                elif best[other][0] == new[0] and new[1] > best[other][1]:
                    best[other] = new
        out += [{"from": start, "to": t, "length": n, "score": round(s / n, 3), "joins": p} for t, (n, s, p) in best.items() if t > start]
    return sorted(out, key=lambda p: (p["length"], -p["score"], p["from"], p["to"]))[:most]


# ---------------------------------------------------------------- grounding


def question_words(text: str) -> set[str]:
    return {w for w in re.findall(r"[a-z0-9]+", text.casefold()) if w not in QUESTION_WORDS and (len(w) > 1 or w.isdigit())}


def value_grounding(tables: dict[str, DataFrame], question: str, most: int | None = None, values: int = VALUES_A_COLUMN) -> DataFrame:
    """Values of text columns that a question mentions: table, column, score, and the ``values`` best of each column; all columns, or the ``most`` best.

    1 if the whole value stands in the question; 0.78 if it is one word of at least 4 letters that does; else 0.55 + 0.40 x the share
    of its words, of which two must be there, at most 0.95.
    """
    spark = next(iter(tables.values())).sparkSession
    words = sorted(question_words(question))
    norm = " " + re.sub(r"[^a-z0-9]+", " ", question.casefold()).strip() + " "
    out = None
    for name, df in tables.items():
        text = [c for c, t in df.dtypes if t == "string"]
        if not text or not words:
            continue
        parts = [df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.trim(quoted(c)).alias("value")) for c in block]))) for block in blocks(text)]
        long = reduce(DataFrame.union, parts).filter("value is not null and value != ''").distinct()
        plain = F.trim(F.regexp_replace(F.lower("value"), "[^a-z0-9]+", " "))
        mine = F.array_distinct(F.filter(F.split(plain, " "), lambda w: (w != "") & ~w.isin(*sorted(QUESTION_WORDS)) & ((F.length(w) > 1) | w.rlike("^[0-9]$"))))
        common = F.size(F.array_intersect("words", F.array(*map(F.lit, words))))
        score = (
            F.when(F.length("plain") < 3, 0.0).when(F.instr(F.lit(norm), F.concat(F.lit(" "), F.col("plain"), F.lit(" "))) > 0, 1.0)
            .when(F.size("words") == 1, F.when((common == 1) & (F.length(F.try_element_at("words", F.lit(1))) >= 4), 0.78).otherwise(0.0))
            .when(common >= 2, F.least(F.lit(0.95), 0.55 + 0.40 * common / F.size("words"))).otherwise(0.0)
        )
        rows = long.withColumn("plain", plain).withColumn("words", mine).select(F.lit(name).alias("table"), "column", "value", score.alias("score")).filter("score > 0")
        out = rows if out is None else out.union(rows)
    if out is None:
        return spark.createDataFrame([], "table string, column string, score double, matches array<string>")
    # of a column's values the best few are kept in each of many buckets first, so no task gathers them all
    first = Window.partitionBy("table", "column", F.pmod(F.xxhash64("value"), F.lit(64))).orderBy(F.col("score").desc(), "value")
    out = out.withColumn("_at", F.row_number().over(first)).filter(F.col("_at") <= values)
    kept = F.transform(F.array_sort(F.collect_set(F.struct((-F.col("score")).alias("s"), "value"))), lambda x: x["value"])
    out = out.groupBy("table", "column").agg(F.max("score").alias("score"), F.slice(kept, 1, values).alias("matches")).orderBy(F.col("score").desc(), F.size("matches").desc(), "table", "column")
    return out if most is None else out.limit(most)


def column_grounding(tables: dict[str, list[str]], question: str, most: int | None = None) -> list[dict]:
    """Columns of which at least half the words, without those of table names, stand in a question."""
    words = question_words(question)
    names = {w for t in tables for w in question_words(t)}
    names |= {w + "s" for w in names} | {w[:-1] for w in names if w.endswith("s") and len(w) > 3}
    out = []
    for t, columns in tables.items():
        for c in columns:
            mine = question_words(c.replace("_", " ")) - names
            common = sorted(mine & words)
            if mine and len(common) / len(mine) >= 0.5:
                out.append({"table": t, "column": c, "score": round(len(common) / len(mine), 3), "matched_terms": common[:4]})
    return sorted(out, key=lambda x: (-x["score"], -len(x["matched_terms"]), x["table"], x["column"]))[:most]


def build_task(question: str, tables: dict[str, DataFrame]) -> dict:
    """A task for a planner from a question: type of the answer, columns it names, sources without places."""
    q = question.strip().lower()
    if re.match(r"(is|are|was|were|did|does|do|has|have|can)\b", q):
        kind = "boolean"
    elif re.search(r"\b(how many|how much|number of|total|average|sum|difference|percentage)\b", q):
        kind = "number"
    elif re.match(r"(list|name|which .*s\b|what are)", q):
        kind = "list[string]"
    else:
        kind = "string"
    columns = {t: df.columns for t, df in tables.items()}
    return {
        "task_type": "table_reasoning.query", "question": question, "answer": {"name": "answer", "type": kind}, "target_columns": column_grounding(columns, question),
        "sources": [{"id": t, "type": "table", "schema": {"columns": c}} for t, c in columns.items()],
    }
