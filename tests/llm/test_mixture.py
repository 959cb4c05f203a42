import re
from collections import Counter

from rowan.llm.mixture import Mixture, token_count

DOCS = "doc_id bigint, text string, source string, key bigint, bucket string"
TARGETS = "mixture_id bigint, source string, weight double, max_repeats int, budget_tokens bigint"


def tables(spark):
    rows = [(i, "word, " * (i % 7 + 1), ["a", " A ", "b b", "B-b", None][i % 5], i, "x") for i in range(300)]
    rows += [(1000, None, "a", 1, None), (1001, " \n", "a", 1, None), (1002, "tiny", "c", 1, None), (1003, "word, ", "c", 1, None), (None, "no id", "d", 1, None)]
    targets = [(1, "a", 2.0, 1, 300), (1, "b_b", 1.0, 2, 300), (1, "c", 1.0, 3, 300), (2, "C", 1.0, 50, 90), (2, "none", 1.0, 9, 90), (3, "a", None, None, None), (4, None, 1.0, 1, 10)]
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(targets, TARGETS)


def test_plan_and_selection(spark):
    docs, targets = tables(spark)
    m = Mixture(docs, targets)
    size = Counter()
    for r in docs.collect():
        if r.source:
            size[re.sub("[ -]", "_", r.source.strip().lower())] += len(re.findall(r"\w+|[^\w\s]+", r.text or ""))
    plan = {(r.mixture_id, r.source): r for r in m.plan().collect()}
    weights = {1: 4.0, 2: 2.0}
    for (k, s), r in plan.items():
        if k in weights:
            assert r.size_tokens == size[re.sub("[ -]", "_", s.strip().lower())]
            assert r.short == (r.most_tokens < r.wanted_tokens)
            assert r.allotted_tokens == min(r.most_tokens, int(r.wanted_tokens + 0.5))
    rows = m.select().collect()
    used = Counter((r.mixture_id, r.doc_id) for r in rows)
    assert max(used.values()) == 1
    most = {(1, "a"): 1, (1, "b_b"): 2, (1, "c"): 3, (2, "c"): 50}
    got = Counter()
    for r in rows:
        assert 1 <= r.repeats <= most[r.mixture_id, r.source]
        got[r.mixture_id, r.source] += r.repeats * r.tokens
    for (k, s), r in plan.items():
        if k in weights and s != "none":
            assert abs(got[k, s.lower()] - r.allotted_tokens) <= 14
    assert {tuple(r) for r in rows} == {tuple(r) for r in Mixture(docs.repartition(5), targets).select().collect()}
    shares = {(r.mixture_id, r.source): r for r in m.shares().collect()}
    assert abs(sum(r.share for (k, _), r in shares.items() if k == 1) - 1) < 1e-9
    assert shares[3, "a"].tokens == 0 and shares[2, "none"].tokens == 0


def test_equal_texts_belong_to_all_their_sources(spark):
    docs = spark.createDataFrame([(1, "one two three four", "a"), (2, "one two three four", "b"), (3, "five six seven eight", "b")], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([(1, "a", 1.0, 1, 8), (1, "b", 1.0, 1, 8)], TARGETS)
    m = Mixture(docs, targets, same_text=True)
    assert [(list(p.pattern), p.tokens) for p in m.patterns()] == [(["a", "b"], 4), (["b"], 4)]
    assert sorted((r.source, r.doc_id, r.repeats) for r in m.select().collect()) == [("a", 1, 1), ("b", 3, 1)]


def test_empty_tables(spark):
    docs, targets = tables(spark)
    assert {r.size_tokens for r in Mixture(docs.limit(0), targets).plan().collect()} == {0}
    assert Mixture(docs.limit(0), targets).select().count() == 0
    assert Mixture(docs, targets.limit(0)).plan().count() == 0
    assert Mixture(docs, targets.limit(0)).shares().count() == 0


def test_tokens(spark):
    texts = ["", None, "a_b c!!?", "naïve 表の10行。", "it's so --x", "x" * 100000]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(token_count("t")).collect()]
    assert got == [0, 0, 3, 3, 6, 1]
