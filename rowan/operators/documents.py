"""Documents: joining pages, chunking, choosing chunks, mapping and reducing them."""

from __future__ import annotations

import ast
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CHUNK_SIZE = 3000
OVERLAP = 20
# Words without weight in ranking chunks.
STOPWORDS = set(
    "about above after answer based between calculate chunk company defined document extract facts financial following from information line local metric "
    "numerical only provided question ratio relevant return round statement statements task this using value what when where with within year".split()
)
# Phrases for which a chunk gets PHRASE_SCORE more.
PHRASES = (
    "consolidated balance sheets",
    "consolidated statement of income",
    "consolidated statements of income",
    "consolidated statements of operations",
    "consolidated statements of cash flows",
    "statement of financial position",
    "total net revenues",
    "property and equipment",
    "cash provided by operating activities",
    "capital expenditures",
)
PHRASE_SCORE = 3
# Names of topics, and the words that weigh TOPIC_WEIGHT more if a question names one.
TOPICS = {
    "operations revenue revenues income expense expenses": ("income statement", "statement of income"),
    "assets liabilities equity property equipment inventory receivable payable": ("balance sheet", "financial position"),
    "cash flows operating investing financing capital expenditures capex": ("cash flow",),
}
TOPIC_WEIGHT = 2
WORD = r"([a-z][a-z0-9&%-]{2,})"


def join_pages(pages: DataFrame, doc: str = "doc_id", page: str = "page_index", text: str = "text") -> DataFrame:
    """One text for each document, its pages in order under ``[Page n]`` headers, and where each page begins and ends."""
    body = F.concat(F.lit("[Page "), F.col(page).cast("string"), F.lit("]\n"), F.coalesce(text, F.lit("")))
    joined = pages.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct(F.col(page).alias("page"), body.alias("body")))).alias("_pages"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<page:bigint,char_start:int,char_end:int>>").alias("spans"))

    def add(acc: Column, p: Column) -> Column:
        end = acc["at"] + F.length(p["body"])
        span = F.struct(p["page"].cast("bigint").alias("page"), acc["at"].alias("char_start"), end.alias("char_end"))
        return F.struct((end + 2).alias("at"), F.concat(acc["spans"], F.array(span)).alias("spans"))

    return joined.select(doc, F.array_join(F.transform("_pages", lambda p: p["body"]), "\n\n").alias("text"), F.aggregate("_pages", start, add)["spans"].alias("spans"))


def window_chunks(docs: DataFrame, doc: str = "doc_id", text: str = "text", size: int = CHUNK_SIZE, overlap: int = OVERLAP, keep: tuple[str, ...] = ()) -> DataFrame:
    """Sliding windows: doc, chunk_id, strategy, unit, char_start, char_end, char_count, text; an empty or NULL text gives one empty chunk.

    Windows begin every size - overlap characters until one reaches the end.
    """
    if not 0 <= overlap < size:
        raise ValueError("the overlap must be less than the size")
    whole = F.coalesce(F.col(text), F.lit(""))
    starts = F.sequence(F.lit(0), F.greatest(F.length("_text") - overlap - 1, F.lit(0)), F.lit(size - overlap))
    rows = docs.select(doc, *keep, whole.alias("_text")).select(doc, *keep, "_text", F.posexplode(starts).alias("_i", "char_start"))
    end = F.least(F.col("char_start") + size, F.length("_text"))
    return rows.select(
        doc, *keep, F.concat(F.lit("chunk_"), F.col("_i").cast("string")).alias("chunk_id"), F.lit("sliding_window").alias("strategy"), F.lit("char").alias("unit"),
        F.col("char_start"), end.alias("char_end"), (end - F.col("char_start")).alias("char_count"), F.substring("_text", F.col("char_start") + 1, end - F.col("char_start")).alias("text"),
    )


def page_span(spans: Column, start: Column, end: Column) -> Column:
    """First and last page that overlap [start, end), and their number."""
    hit = F.transform(F.filter(spans, lambda p: (p["char_start"] < F.greatest(end, start + 1)) & (p["char_end"] > start)), lambda p: p["page"])
    return F.struct(F.array_min(hit).alias("page_start"), F.array_max(hit).alias("page_end"), (F.array_max(hit) - F.array_min(hit) + 1).alias("page_count"))


def document_chunks(pages: DataFrame, doc: str = "doc_id", size: int = CHUNK_SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Sliding windows over joined pages, with the pages each overlaps."""
    chunks = window_chunks(join_pages(pages, doc), doc, "text", size, overlap, ("spans",))
    return chunks.withColumn("_p", page_span(F.col("spans"), F.col("char_start"), F.col("char_end"))).select("*", "_p.*").drop("spans", "_p")


def page_chunks(pages: DataFrame, doc: str = "doc_id", page: str = "page_index", text: str = "text") -> DataFrame:
    """One chunk for each page, with its place in the joined document."""
    body = F.concat(F.lit("[Page "), F.col(page).cast("string"), F.lit("]\n"), F.coalesce(text, F.lit("")))
    w = Window.partitionBy(doc).orderBy(page)
    end = F.sum(F.length("_body") + 2).over(w) - 2
    out = pages.withColumn("_body", body).withColumn("char_end", end.cast("int")).withColumn("_n", F.row_number().over(w) - 1)
    return out.select(
        doc, F.concat(F.lit("chunk_"), F.col("_n").cast("string")).alias("chunk_id"), F.lit("page").alias("strategy"), F.lit("page").alias("unit"), (F.col("char_end") - F.length("_body")).alias("char_start"), "char_end",
        F.length("_body").alias("char_count"), F.col(page).alias("page_start"), F.col(page).alias("page_end"), F.lit(1).alias("page_count"), F.col("_body").alias("text"),
    )


def select_chunks(chunks: DataFrame, ids: list[str] | None = None) -> DataFrame:
    """All chunks, or those of the given ids; an id that no document has is an error."""
    if ids is None:
        return chunks
    known = {r[0] for r in chunks.select("chunk_id").filter(F.col("chunk_id").isin(*ids)).distinct().collect()}
    if missing := sorted(set(ids) - known):
        raise ValueError(f"unknown chunks: {missing}")
    return chunks.filter(F.col("chunk_id").isin(*ids))


def query_weights(hint: str) -> dict[str, int]:
    """Weight of each word to look for: how often a question has it, and TOPIC_WEIGHT more for the words of each topic that it names."""
    low = hint.lower()
    named = [words.split() for words, names in TOPICS.items() if any(map(low.__contains__, names))]
    asked = Counter(re.findall(WORD, low))
    return {w: (0 if w in STOPWORDS else asked[w]) + TOPIC_WEIGHT * sum(w in words for words in named) for w in dict.fromkeys([*asked, *(w for words in named for w in words)]) if w not in STOPWORDS or any(w in words for words in named)}


def chunk_score(text: Column, weights: dict[str, int]) -> Column:
    """Weight of the query's words that a text has, and PHRASE_SCORE for each known phrase in it."""
    low = F.lower(F.coalesce(text, F.lit("")))
    score = sum((F.contains(low, F.lit(p)).cast("int") * PHRASE_SCORE for p in PHRASES), F.lit(0))
    if not weights:
        return score
    words = F.array_distinct(F.regexp_extract_all(low, F.lit(WORD), F.lit(1)))
    # words of one weight are counted together
    for n in sorted(set(weights.values())):
        score = score + F.size(F.array_intersect(words, F.array(*[F.lit(w) for w in sorted(weights) if weights[w] == n]))) * n
    return score


def rank_chunks(chunks: DataFrame, hint: str, most: int, doc: str = "doc_id", order: str = "char_start") -> DataFrame:
    """The ``most`` chunks of each document that fit a hint best, in their order; evenly spread ones where the hint has no words or nothing fits.

    Ties go to the earlier chunk.
    """
    weights = query_weights(hint)
    if most < 1:
        raise ValueError("at least one chunk must be chosen")
    whole = Window.partitionBy(doc)
    rows = chunks.withColumn("score", chunk_score(F.col("text"), weights) if weights else F.lit(0)).withColumn("_i", F.row_number().over(whole.orderBy(order)) - 1).withColumn("_n", F.count("*").over(whole))
    rows = rows.withColumn("_best", F.max("score").over(whole)).withColumn("_rank", F.row_number().over(whole.orderBy(F.col("score").desc(), order)))
    if most == 1:
        even = F.col("_i") == 0
    else:
        spots = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda k: F.bround(k * (F.col("_n") - 1) / (most - 1)).cast("int"))
        even = F.array_contains(spots, F.col("_i").cast("int"))
    chosen = F.when(F.col("_n") <= most, True).when(F.col("_best") > 0, F.col("_rank") <= most).otherwise(even)
    return rows.filter(chosen).drop("_i", "_n", "_best", "_rank")


# ---------------------------------------------------------------- map and reduce

Worker = Callable[[dict], dict]
OUTPUT = "answer string, citation string, explanation string"


@dataclass
class MapGroup:
    """One task: an instruction, the worker that carries it out on a chunk, how often each chunk is worked on, which chunks, and what a failure means.

    failure: ``soft`` (a unit that fails is a row with its error and empty outputs, and the others go on) or ``hard`` (it ends the query).
    """

    task: str
    worker: Worker
    instruction: str = ""
    replicas: int = 1
    chunks: list[str] | None = None
    failure: str = "soft"


@dataclass
class MapReduceSpec:
    """Map groups over chunks, and a reduction of a task's outputs to rows."""

    groups: list[MapGroup] = field(default_factory=list)
    reduce: Callable[[pd.DataFrame], pd.DataFrame] | None = None
    reduce_schema: str = ""


def _output(v: object) -> str | None:
    """An output of a worker as text: none, null and blank are nothing, parts of a list stand on lines."""
    if isinstance(v, (list, tuple)):
        v = "\n".join(x for p in v if (x := _output(p)) is not None)
    s = "" if v is None else str(v).strip()
    return None if s.lower() in ("", "none", "null") else s


def map_chunks(chunks: DataFrame, group: MapGroup, doc: str = "doc_id") -> DataFrame:
    """Outputs of a group's worker: task, doc, chunk_id, sample, answer, citation, explanation, error.

    The worker gets a chunk as dict with its instruction and sample number. If it fails, its row has the
    error and no outputs, and the others go on, unless failures of the group are hard.
    """
    kind = dict(chunks.dtypes)[doc]
    units = select_chunks(chunks, group.chunks).withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(group.replicas - 1))))
    names = units.columns
    worker, instruction, task, hard = group.worker, group.instruction, group.task, group.failure == "hard"
    if group.failure not in ("soft", "hard"):
        raise ValueError(f"unknown failure policy: {group.failure}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for values in batch.itertuples(index=False):
                unit = dict(zip(names, values))
                row = {"task": task, doc: unit[doc], "chunk_id": unit["chunk_id"], "sample": unit["sample"], "answer": None, "citation": None, "explanation": None, "error": None}
                try:
                    out = worker(unit | {"instruction": instruction}) or {}
                    row |= {k: _output(out.get(k)) for k in ("answer", "citation", "explanation")}
                except Exception as e:  # noqa: BLE001
                    if hard:
                        raise
                    row["error"] = f"{type(e).__name__}: {e}"
                rows.append(row)
            yield pd.DataFrame(rows, columns=["task", doc, "chunk_id", "sample", "answer", "citation", "explanation", "error"])

    return units.mapInPandas(run, f"task string, {doc} {kind}, chunk_id string, sample int, {OUTPUT}, error string")


def map_reduce(chunks: DataFrame, spec: MapReduceSpec, doc: str = "doc_id") -> DataFrame:
    """All groups' outputs; reduced by the given function for each task and document, if there is one."""
    out = None
    for g in spec.groups:
        mapped = map_chunks(chunks, g, doc)
        out = mapped if out is None else out.unionByName(mapped)
    if out is None:
        raise ValueError("there are no map groups")
    return out if spec.reduce is None else out.groupBy("task", doc).applyInPandas(spec.reduce, spec.reduce_schema)


def collect_evidence(outputs: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Per task and document: outputs, those with an answer or citation, failures, and the distinct answers in order, one a line."""
    has = F.col("answer").isNotNull() | F.col("citation").isNotNull()
    answers = F.array_sort(F.collect_set(F.when(has, F.col("answer"))))
    return outputs.groupBy("task", doc).agg(F.count("*").alias("outputs"), F.count(F.when(has, 1)).alias("included"), F.count("error").alias("failed"), F.array_join(answers, "\n").alias("summary"))


# ---------------------------------------------------------------- programs

# Names by which programs call the ways to chunk.
CHUNKERS = {"chunk_by_page": "page", "chunk_on_pages": "page", "chunk_by_section": "sliding_window", "chunk_on_sections": "sliding_window"}


def program_groups(code: str, workers: dict[str, Worker] | Worker) -> tuple[list[MapGroup], set[str]]:
    """Map groups that a Python program describes in ``prepare_jobs``, and the ways to chunk that it names; the program is read, never run.

    Each value that is put into a list (by append, extend, a list or a comprehension) or returned in one is a job if it is a call or
    dict with a ``task`` or ``instruction`` (local_instruction, advice); ``[job] * n`` and loops over range(n) repeat it, and so are replicas. Loops over literal
    lists are followed value by value, loops over chunks stand for all chunks; ``chunk_ids`` names some. workers: by task, or one for all.
    """
    tree = ast.parse(code)
    body = next((f for f in tree.body if isinstance(f, ast.FunctionDef) and f.name == "prepare_jobs"), None)
    if body is None:
        raise ValueError("the program has no function prepare_jobs")
    jobs: dict[tuple, int] = {}

    def value(e: ast.expr, names: dict) -> object:
        if isinstance(e, ast.Constant):
            return e.value
        if isinstance(e, ast.Name):
            return names.get(e.id)
        if isinstance(e, (ast.List, ast.Tuple)):
            return [value(x, names) for x in e.elts]
        if isinstance(e, ast.JoinedStr):
            return "".join(str(value(x.value if isinstance(x, ast.FormattedValue) else x, names)) for x in e.values)
        if isinstance(e, ast.BinOp) and isinstance(e.op, ast.Add):
            a, b = value(e.left, names), value(e.right, names)
            return a + b if type(a) is type(b) and a is not None else None
        return None

    def fields(e: ast.expr, names: dict) -> dict | None:
        if isinstance(e, ast.Call):
            found = {k.arg: value(k.value, names) for k in e.keywords if k.arg}
        elif isinstance(e, ast.Dict):
            found = {k.value: value(v, names) for k, v in zip(e.keys, e.values) if isinstance(k, ast.Constant)}
        else:
            return None
        return found if found.keys() & {"task", "instruction", "local_instruction", "task_id"} else None

    def put(e: ast.expr, names: dict, times: int) -> None:
        """A value that is put into a list of jobs."""
        if isinstance(e, ast.BinOp) and isinstance(e.op, ast.Mult):
            n, of = value(e.right, names), e.left
            if not isinstance(n, int):
                n, of = value(e.left, names), e.right
            put(of, names, times * (n if isinstance(n, int) else 1))
        elif isinstance(e, ast.BinOp) and isinstance(e.op, ast.Add):
            put(e.left, names, times)
            put(e.right, names, times)
        elif isinstance(e, (ast.List, ast.Tuple)):
            for x in e.elts:
                put(x, names, times)
        elif isinstance(e, (ast.ListComp, ast.GeneratorExp)):
            follow([(g.target, g.iter) for g in e.generators], names, times, lambda n, t: put(e.elt, n, t))
        elif (f := fields(e, names)) is not None:
            ids = f.get("chunk_ids")
            task = str(f.get("task") or f.get("task_id") or f"task_{len(jobs)}")
            key = task, str(f.get("instruction") or f.get("local_instruction") or ""), tuple(map(str, ids)) if isinstance(ids, list) else None
            jobs[key] = jobs.get(key, 0) + times

    def follow(loops: list[tuple[ast.expr, ast.expr]], names: dict, times: int, then: Callable[[dict, int], None]) -> None:
        if not loops:
            then(names, times)
            return
        (target, source), *rest = loops
        if isinstance(source, ast.Call) and isinstance(source.func, ast.Name) and source.func.id == "range":
            bounds = [value(x, names) for x in source.args]
            if all(isinstance(b, int) for b in bounds):
                follow(rest, names, times * len(range(*bounds)), then)
                return
        values = value(source, names)
        if isinstance(values, list):
            for v in values:
                follow(rest, names | bound(target, v), times, then)
        else:  # chunks, or what the program computes: once for all of them
            follow(rest, names | bound(target, None), times, then)

    def bound(target: ast.expr, v: object) -> dict:
        if isinstance(target, ast.Name):
            return {target.id: v}
        parts = target.elts if isinstance(target, (ast.Tuple, ast.List)) else []
        given = v if isinstance(v, list) and len(v) == len(parts) else [None] * len(parts)
        return {k: x for t, y in zip(parts, given) for k, x in bound(t, y).items()}

    def walk(statements: list[ast.stmt], names: dict, times: int) -> None:
        for s in statements:
            if isinstance(s, ast.Assign) and len(s.targets) == 1:
                names |= bound(s.targets[0], value(s.value, names))
                if not isinstance(s.value, (ast.Call, ast.Dict)):
                    put(s.value, names, times)
            elif isinstance(s, ast.For):
                follow([(s.target, s.iter)], names, times, lambda n, t, s=s: walk(s.body, n, t))
            elif isinstance(s, ast.Expr) and isinstance(s.value, ast.Call) and isinstance(s.value.func, ast.Attribute) and s.value.func.attr in ("append", "extend"):
                for x in s.value.args:
                    put(x, names, times)
            elif isinstance(s, ast.AugAssign) or isinstance(s, ast.Return) and s.value is not None and not isinstance(s.value, ast.Name):
                put(s.value, names, times)
            elif isinstance(s, (ast.If, ast.With)):
                walk(s.body, names, times)

    walk(body.body, {}, 1)
    if not jobs:
        raise ValueError("the program prepares no jobs")
    called = {n.func.attr if isinstance(n.func, ast.Attribute) else getattr(n.func, "id", "") for n in ast.walk(tree) if isinstance(n, ast.Call)}
    worker = workers.__getitem__ if isinstance(workers, dict) else lambda _: workers
    groups = [MapGroup(task, worker(task), instruction, n, list(ids) if ids is not None else None) for (task, instruction, ids), n in jobs.items()]
    return groups, {CHUNKERS[c] for c in called & CHUNKERS.keys()}
