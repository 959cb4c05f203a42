"""The engine: sources, SQL, operator graphs, typed answers."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rowan.operators.answer import format_answer
from rowan.operators.evidence import evidence
from rowan.plans.dag import Runner
from rowan.plans.dialect import extract_sql, guard, normalise, shape_answer
from rowan.plans.expr import PlanError
from rowan.plans.guard import check_plan
from rowan.session import cut_lineage
from rowan.sources import read_source

# Fixed value: likeness of two questions from which on they may share one SQL statement.
SAME_QUESTION = 0.74


class Engine:
    """Answers SQL queries and operator graphs over named sources.

    semantics: ``ansi`` (default), or ``lenient`` for operator graphs over text tables. Sources are DataFrames,
    or paths with an optional format. SQL sees the sources as temporary views of their ids.
    """

    def __init__(self, spark: SparkSession, semantics: str = "ansi", max_rows: int | None = None):
        if semantics not in ("ansi", "lenient"):
            raise PlanError(f"unknown semantics: {semantics}")
        self.spark, self.lenient, self.max_rows = spark, semantics == "lenient", max_rows
        self.sources: dict[str, DataFrame] = {}
        self._seen: dict[tuple, DataFrame] = {}
        self._sql: dict[str, DataFrame] = {}
        self._kept: dict[str, DataFrame] = {}

    def register(self, source_id: str, source: DataFrame | str, fmt: str | None = None, clean_markers: bool | None = None) -> Engine:
        """Add a source; a path is read once, however often it is registered."""
        if isinstance(source, str):
            key = (source, fmt, clean_markers)
            if key not in self._seen:
                self._seen[key] = read_source(self.spark, source, fmt, clean_markers=self.lenient if clean_markers is None else clean_markers)
            source = self._seen[key]
        self.sources[source_id] = source
        source.createOrReplaceTempView(source_id)
        self._sql, self._kept = {}, {}
        return self

    def register_all(self, sources: list[dict]) -> Engine:
        """Sources as {id, path, format}."""
        for s in sources:
            self.register(s["id"], s["path"], s.get("format"))
        return self

    def close(self) -> None:
        """Drop the views."""
        for s in self.sources:
            self.spark.catalog.dropTempView(s)
        self.sources.clear()

    def sql(self, text: str) -> DataFrame:
        """The lazy result of one read-only statement, taken from plain text, a fenced block or JSON. Equal statements give the same result object."""
        statement = extract_sql(text)
        guard(statement)
        ready = normalise(statement)
        if ready not in self._sql:
            check_plan(self.spark, ready, set(self.sources))
            self._sql[ready] = self.spark.sql(ready)
        return self._sql[ready]

    def result(self, text: str) -> DataFrame:
        """The result of a statement, computed once and kept in the checkpoint folder; the same statement again reads what was kept."""
        ready = normalise(extract_sql(text))
        if ready not in self._kept:
            self._kept[ready] = cut_lineage(self.sql(text))
        return self._kept[ready]

    def register_result(self, source_id: str, text: str) -> Engine:
        """The kept result of an earlier statement as a source of operator graphs and further statements."""
        df, kept = self.result(text), self._kept
        self.register(source_id, df)
        self._kept = kept  # results of before are still those of the sources they were made of
        return self

    def run_plan(self, plan: dict) -> dict[str, object]:
        """Outputs of an operator graph, or answers of a batch of query plans."""
        return self.runner().run(plan)

    def runner(self, **options) -> Runner:
        return Runner(self.spark, self.sources, self.lenient, self.max_rows, **options)

    def answer(self, text: str, name: str | None = None, kind: str = "json") -> object:
        """The typed answer of a statement."""
        return format_answer(self.sql(text), name, kind)

    def analyze(self, text: str, kind: str) -> dict:
        """Evidence about the result of a statement."""
        return evidence(self.sql(text), kind)

    def answers(self, questions: list[dict], planner: Callable[[dict], str | None]) -> dict[str, object]:
        """Answers of several questions {question, answer: {name, type}}; the planner gives the SQL of a question.

        Each question has its own statement, but that questions that are equal ignoring case and white space share the first one's. A planner that
        gives one statement for two questions returns None for the second; they share it if there are just these two, with answers of one
        type, the same numbers and quoted texts, and nearly the same words; else that is an error.
        """
        known: dict[str, str] = {}
        out: dict[str, object] = {}
        for q in questions:
            name, kind = q["answer"]["name"], q["answer"].get("type", "json")
            if name in out:
                raise PlanError(f"answer name {name!r} is taken")
            plain = " ".join(q["question"].casefold().split())
            if plain not in known:
                text = planner({**q, "sources": self.describe()})
                if text is None:
                    first = next(iter(known), None)
                    if first is None or len(questions) != 2 or not _one_statement(*questions):
                        raise PlanError(f"no statement for {name!r}")
                    text = known[first]
                known[plain] = text
            out[name] = self.answer(shape_answer(extract_sql(known[plain]), name, kind), name, kind)
        return out

    def describe(self) -> list[dict]:
        """Ids and columns of the sources, without paths."""
        return [{"id": k, "type": "table", "schema": {"columns": df.columns}} for k, df in self.sources.items()]

    def explain_ops(self, text: str) -> list[str]:
        """Operators of the analysed plan of a statement, from the result to the sources."""
        plan = self.sql(text)._jdf.queryExecution().analyzed().toString()
        return [m[1] for m in re.finditer(r"(?m)^[\s:+-]*([A-Z]\w+)", plan)]


def _one_statement(a: dict, b: dict) -> bool:
    """Two questions that mean the same: one type of answer, the same literals, words nearly the same."""
    if a["answer"].get("type") != b["answer"].get("type"):
        return False
    literals = lambda q: sorted(re.findall(r"\d+(?:[.,]\d+)*|\"[^\"]*\"|'[^']*'", q["question"]))
    words = [set(re.findall(r"\w+", q["question"].lower())) for q in (a, b)]
    return literals(a) == literals(b) and all(words) and len(words[0] & words[1]) >= SAME_QUESTION * len(words[0] | words[1])
