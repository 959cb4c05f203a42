"""Mixing sources to target weights."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rowan.functions.labels import label
from rowan.llm._flow import MinCostFlow
from rowan.llm.sampling import collect_small, from_driver
from rowan.session import cut_lineage

# Fixed value: a token is a run of letters, digits and underscores, or of other characters that are not white space.
TOKEN = r"(?U)[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+"
BUCKET_BITS = 12
BROADCAST_TOTALS = 1 << 19


def token_count(text) -> F.Column:
    """Tokens of the word-and-punctuation tokenizer; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)).cast("bigint"), F.lit(0).cast("bigint"))


class Mixture:
    """Documents combined by source to target shares of a token budget, for several mixtures at once.

    documents: id, text, source. targets: mixture_id, source, weight, max_repeats, budget_tokens; a mixture's
    budget is the largest that its rows name. Sources are equal as by ``labels.label``; documents without a
    source or without tokens are in no mixture. NULL or negative weights, repeats and budgets count as 0.

    With ``same_text`` documents of equal text are one record that belongs to all their sources; else each
    document is a record of its one source. Records are counted by membership pattern (the set of a record's
    sources); a minimum-cost flow for each mixture sends the patterns' tokens to the sources' quotas, where
    the k-th use of a record costs k, so that nothing is repeated while something is unused; then records
    are taken in a seeded order, in stretches of that order that make up the tokens each pattern sends.
    """

    def __init__(
        self,
        documents: DataFrame,
        targets: DataFrame,
        doc_id: str = "doc_id",
        text: str = "text",
        source: str = "source",
        same_text: bool = False,
        seed: int = 20260619,
    ):
        self.spark = documents.sparkSession
        self.doc_id, self.seed = doc_id, seed
        wanted = targets.select("mixture_id", "source", "weight", "max_repeats", "budget_tokens", label(F.col("source")).alias("label")).distinct()
        self.targets = collect_small(wanted, "targets")
        names = self.spark.createDataFrame([(x,) for x in sorted({r.label for r in self.targets if r.label})], "label string")
        docs = documents.select(F.col(doc_id), F.col(text).alias("_text"), label(F.col(source)).alias("label")).join(F.broadcast(names), "label")
        if same_text:
            # one record for each text: the first id, all sources
            self.records = (
                docs.withColumn("_same", F.sha2("_text", 256))
                .groupBy("_same")
                .agg(F.min(doc_id).alias(doc_id), F.max(token_count(F.col("_text"))).alias("tokens"), F.array_sort(F.collect_set("label")).alias("pattern"))
                .select(doc_id, "tokens", "pattern")
            )
        else:
            self.records = docs.select(doc_id, token_count(F.col("_text")).alias("tokens"), F.array("label").alias("pattern"))
        self.records = self.records.filter("tokens > 0")
        self._patterns: list | None = None

    def patterns(self) -> list:
        """Tokens and number of the records of each pattern."""
        if self._patterns is None:
            counted = self.records.groupBy("pattern").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("records"))
            self._patterns = sorted(collect_small(counted, "sets of sources", 100_000), key=lambda r: r.pattern)
        return self._patterns

    def _rows(self) -> dict:
        """Per mixture: budget and its sources (label, weight, repeats)."""
        out: dict = {}
        for r in sorted(self.targets, key=lambda r: (r.mixture_id or 0, r.source or "")):
            m = out.setdefault(r.mixture_id, {"budget": 0, "weights": 0.0, "sources": {}})
            m["budget"] = max(m["budget"], r.budget_tokens or 0)
            m["weights"] += max(0.0, r.weight or 0.0)
            if r.label is not None:
                w, k = m["sources"].get(r.label, (0.0, 0))
                m["sources"][r.label] = (w + max(0.0, r.weight or 0.0), max(k, r.max_repeats or 0))
        return out

    def flows(self) -> dict[tuple, int]:
        """Tokens that a pattern sends to a source, by (mixture, index of the pattern, source)."""
        out: dict[tuple, int] = {}
        for mixture, m in self._rows().items():
            sources = sorted(m["sources"])
            known = [(i, p) for i, p in enumerate(self.patterns()) if set(p.pattern) & m["sources"].keys()]
            if not known or m["weights"] <= 0:
                continue
            s, t = len(known) + len(sources), len(known) + len(sources) + 1
            net = MinCostFlow(t + 1)
            sent = {}
            for k, (i, p) in enumerate(known):
                mine = [x for x in p.pattern if x in m["sources"]]
                for n in range(1, max(m["sources"][x][1] for x in mine) + 1):
                    net.arc(s, k, int(p.tokens), n)
                for x in mine:
                    sent[mixture, i, x] = net.arc(k, len(known) + sources.index(x), int(p.tokens) * m["sources"][x][1], 0)
            for j, x in enumerate(sources):
                net.arc(len(known) + j, t, math.floor(m["sources"][x][0] / m["weights"] * m["budget"] + 0.5), 0)
            net.run(s, t)
            out |= {k: net.flow(e) for k, e in sent.items() if net.flow(e)}
        return out

    def plan(self) -> DataFrame:
        """For each target: size of the source, tokens wanted, tokens it can give and tokens allotted; short where it can't reach its share."""
        size: dict[str, int] = {}
        for p in self.patterns():
            for x in p.pattern:
                size[x] = size.get(x, 0) + int(p.tokens)
        flows, mixtures, rows = self.flows(), self._rows(), []
        for r in sorted(self.targets, key=lambda r: (r.mixture_id or 0, r.source or "")):
            m = mixtures[r.mixture_id]
            there = size.get(r.label, 0)
            wanted = max(0.0, r.weight or 0.0) / m["weights"] * m["budget"] if m["weights"] > 0 else 0.0
            most = max(0, r.max_repeats or 0) * there
            sent = sum(n for (k, _, x), n in flows.items() if (k, x) == (r.mixture_id, r.label))
            rows.append((r.mixture_id, r.source, there, float(wanted), most, sent, most < wanted))
        return self.spark.createDataFrame(rows, "mixture_id bigint, source string, size_tokens bigint, wanted_tokens double, most_tokens bigint, allotted_tokens bigint, short boolean")

    def select(self) -> DataFrame:
        """mixture_id, source, the record's id, tokens and repeats (how often it is used there).

        Records of a pattern are ordered by a seeded key, the MD5 digest of seed and id, the same in any engine. Each source takes every record as often as its
        tokens cover the pattern whole, and the records in whose middle its stretch of the order lies once
        more; stretches of several sources follow each other, so uses spread evenly. What a source gets
        differs from its tokens by less than one record at each end of its stretch. Only buckets of the order
        in which a stretch begins or ends are sorted.
        """
        patterns = self.patterns()
        at, parts = {}, []
        for (mixture, i, x), n in sorted(self.flows().items()):
            size = int(patterns[i].tokens)
            begin = at.get((mixture, i), 0)
            whole, rest = divmod(n, size)
            at[mixture, i] = (begin + rest) % size
            first = min(rest, size - begin)
            parts.append((mixture, i, x, whole, begin, begin + first, rest - first))
        plan = from_driver(self.records, parts, "mixture_id bigint, p int, source string, whole bigint, begin bigint, end bigint, wrapped bigint")
        numbers = from_driver(self.records, [(i, list(p.pattern)) for i, p in enumerate(patterns)], "p int, pattern array<string>")
        named = self.records.join(numbers, "pattern").withColumn("key", F.md5(F.concat_ws(":", F.lit(str(self.seed)), F.col(self.doc_id).cast("string"))))
        rows = cut_lineage(named.select(self.doc_id, "tokens", "p", "key", F.conv(F.substring("key", 1, BUCKET_BITS // 4), 16, 10).cast("int").alias("bucket")))
        totals = rows.groupBy("p", "bucket").agg(F.sum("tokens").alias("sum"))
        before = F.sum("sum").over(Window.partitionBy("p").orderBy("bucket")) - F.col("sum")
        totals = cut_lineage(totals.withColumn("before", before))
        edges = plan.select("p", F.explode(F.array("begin", "end", "wrapped")).alias("edge")).distinct()
        inner = totals.join(edges, "p").filter("before < edge and edge < before + sum").select("p", "bucket").distinct()
        marked = totals.join(inner.withColumn("split", F.lit(True)), ["p", "bucket"], "left")
        if len(patterns) << BUCKET_BITS <= BROADCAST_TOTALS:  # at most so many rows
            marked = F.broadcast(marked)
        both = rows.join(marked, ["p", "bucket"])
        inside = F.sum("tokens").over(Window.partitionBy("p", "bucket").orderBy("key", self.doc_id)) - F.col("tokens")
        fine = both.filter("split").withColumn("middle", F.col("before") + inside + F.col("tokens") / 2)
        coarse = both.filter("split is null").withColumn("middle", F.col("before") + F.col("sum") / 2)
        columns = [self.doc_id, "tokens", "p", "middle"]
        placed = fine.select(*columns).unionByName(coarse.select(*columns)).join(plan, "p")
        extra = ((F.col("middle") >= F.col("begin")) & (F.col("middle") < F.col("end")) | (F.col("middle") < F.col("wrapped"))).cast("bigint")
        return placed.withColumn("repeats", F.col("whole") + extra).filter("repeats > 0").select("mixture_id", "source", self.doc_id, "tokens", "repeats")

    def shares(self) -> DataFrame:
        """mixture_id, source, target share, tokens selected and share reached, from the records selected."""
        got = self.select().groupBy("mixture_id", "source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("records"))
        rows = [(m, x, w / v["weights"] if v["weights"] > 0 else 0.0) for m, v in self._rows().items() for x, (w, _) in sorted(v["sources"].items())]
        wanted = self.spark.createDataFrame(rows, "mixture_id bigint, source string, target_share double")
        out = wanted.join(got, ["mixture_id", "source"], "left").fillna(0, ["tokens", "records"])
        total = F.sum("tokens").over(Window.partitionBy("mixture_id"))
        return out.withColumn("share", F.when(total > 0, F.col("tokens") / total).otherwise(F.lit(0.0)))
