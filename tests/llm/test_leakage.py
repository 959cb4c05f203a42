import random

import numpy as np

from rowan.llm.leakage import ItemIndex, banded_distance, leaked_passages, may_be_near, repetitions_for, word_arrays

VOCABULARY = [f"w{i}" for i in range(900)]


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j - 1] + (x != y), old[j] + 1, row[-1] + 1))
    return row[-1]


def test_banded_distance():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 3, (9, 300)), rng.integers(0, 3, (9, 300))
    b[:, :150] = a[:, :150]
    b[4, :100] = 7
    b[1:, 50:100] = b[:-1, 50:100]
    for most in (0, 1, 2, 3):
        want = np.array([min(levenshtein(a[:, i].tolist(), b[:, i].tolist()), most + 1) for i in range(300)])
        assert (banded_distance(a, b, most) == want).all()
        assert may_be_near(a, b, most)[want <= most].all()


def run_of(a, b, n):
    grams = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)}
    return any(tuple(a[i : i + n]) in grams for i in range(len(a) - n + 1))


def test_exact_leaks_against_brute_force(spark):
    rng = random.Random(5)
    items = [[rng.choice(VOCABULARY) for _ in range(rng.choice([5, 7, 8, 9, 11, 12, 13, 40]))] for _ in range(40)]
    items += [items[0], items[20][:30]]
    docs = []
    for i in range(150):
        words = [rng.choice(VOCABULARY) for _ in range(rng.randint(0, 120))]
        if i % 2:
            x = rng.choice(items)
            n = rng.choice([8, 11, 12, 13, len(x)])
            s = rng.randrange(max(1, len(x) - n + 1))
            words[3:3] = x[s : s + n]
        docs.append(words)
    style = lambda ws: rng.choice([" ".join, ", ".join, "_".join, "\n".join])(rng.choice([w, w.upper()]) for w in ws)
    d = spark.createDataFrame([(i, style(w), "x", i) for i, w in enumerate(docs)] + [(900, None, "x", 1), (901, "", None, 1), (0, "", "x", 0)], "doc_id bigint, text string, item_text string, item bigint")
    q = spark.createDataFrame([(i, style(w)) for i, w in enumerate(items)] + [(77, None), (78, " ")], "item_id bigint, item_text string")
    want = {(i, j) for i, a in enumerate(docs) for j, b in enumerate(items) if len(b) >= 8 and run_of(a, b, min(12, len(b)))}
    got = {(r.doc_id, r.item_id) for r in leaked_passages(d, q).pairs().filter("exact").collect()}
    assert want and got == want
    blocks = {(r.doc_id, r.item_id) for r in leaked_passages(d.union(d), q, block_chars=300).pairs().filter("exact").collect()}
    assert blocks == want
    for none in (leaked_passages(d.limit(0), q), leaked_passages(d, q.limit(0))):
        assert none.passages.count() == none.pairs().count() == 0


def test_recall_of_changed_passages():
    rng = random.Random(8)
    items = [[rng.choice(VOCABULARY) for _ in range(40)] for _ in range(60)]
    texts, truth = [], []
    for i, x in enumerate(items * 4):
        words = x[10:30]
        for _ in range(2):
            k = rng.randrange(len(words))
            words = words[:k] + rng.choice([[], ["new"], [words[k], "more"]]) + words[k + 1 :]
        texts.append(" ".join(rng.choice(VOCABULARY) for _ in range(50)) + " " + " ".join(words) + " end")
        truth.append(i % 60)
    index = ItemIndex([" ".join(x) for x in items], 12, 8, 5, repetitions_for(0.98, 12, 5, 4), 1)
    words, offsets = word_arrays(texts)
    found = {(int(t), int(i)) for m in index.matches(words, offsets, 2) for t, p in zip(m[0], m[1]) for i in index.windows[1][p]}
    recall = sum((t, i) in found for t, i in enumerate(truth)) / len(truth)
    assert recall >= 0.95


def test_recall_of_short_items(spark):
    rng = random.Random(3)
    for size in (8, 9):
        items = [[rng.choice(VOCABULARY) for _ in range(size)] for _ in range(400)]
        docs = []
        for x in items:
            words = list(x)
            for k in rng.sample(range(size), 2):
                words[k] = "new"
            docs.append([rng.choice(VOCABULARY) for _ in range(20)] + words + [rng.choice(VOCABULARY) for _ in range(20)])
        d = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id bigint, text string")
        q = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id bigint, item_text string")
        got = {(r.doc_id, r.item_id): r.edits for r in leaked_passages(d, q).pairs().collect()}
        # brute force over every pair of windows of each document and its item
        parts = lambda w: [w[i : i + 8] for i in range(len(w) - 7)]
        near = [min(levenshtein(a, b) for a in parts(docs[i]) for b in parts(x)) for i, x in enumerate(items)]
        truth = [i for i, n in enumerate(near) if n <= 2]
        assert len(truth) == 400 and all(got[i, i] >= near[i] for i in truth if (i, i) in got)
        assert sum((i, i) in got for i in truth) >= 0.9 * len(truth)


def test_passages_that_many_items_share(spark):
    rng = random.Random(9)
    shared, other = ([rng.choice(VOCABULARY) for _ in range(n)] for n in (12, 15))
    fresh = lambda n: [f"u{rng.getrandbits(40)}" for _ in range(n)]
    items = [fresh(6) + shared + fresh(6) for _ in range(120)] + [other[:9] + fresh(1) for _ in range(40)] + [other[:8] + fresh(3) for _ in range(40)] + [shared + other]
    docs = [fresh(9) + shared + fresh(9) for _ in range(100)] + [fresh(3) + items[k] + fresh(3) for k in (3, 130, 170)] + [shared[:6] + ["new"] + shared[6:]]
    d = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(docs)], "doc_id bigint, text string")
    q = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id bigint, item_text string")
    leaks = leaked_passages(d, q)
    rows = leaks.passages.collect()
    hot = [r for r in rows if r.doc_id < 100]
    assert len(hot) == 100 and {(r.items, r.exact, r.edits) for r in hot} == {(121, True, 0)}
    want = {(i, j) for i, a in enumerate(docs) for j, b in enumerate(items) if run_of(a, b, min(12, len(b)))}
    assert {(r.doc_id, r.item_id) for r in leaks.pairs().filter("exact").collect()} == want
    near = {r.item_id: r.edits for r in leaks.pairs().filter("doc_id = 103").collect()}
    assert len([j for j in near if near[j] in (1, 2)]) >= 0.9 * 121
    # a shared passage at the end of one document says nothing about the next one
    ends = [" ".join(fresh(5) + shared), " ".join(shared[:3] + ["new"] + shared[4:] + fresh(5))] * 2
    d = spark.createDataFrame(list(enumerate(ends)), "doc_id bigint, text string").coalesce(1)
    got = leaked_passages(d, q).pairs().filter("doc_id in (1, 3)").groupBy("doc_id").count().collect()
    assert len(got) == 2 and all(r["count"] >= 0.9 * 121 for r in got)
