import pandas as pd
import pytest
from pyspark.sql import functions as F

from rowan.operators import documents as D
from rowan.operators import evidence as V
from rowan.operators import profile as P
from rowan.operators import scoring as S
from rowan.operators import udf
from rowan.operators.ranks import average_ranks
from rowan.operators.verify import agrees, boolean_operation, numeric_operation, text_operation
from rowan.sources import read_source, sniff_delimiter, write_source


def test_evidence(spark):
    df = spark.createDataFrame([("alpha", 1, 1, 1), ("beta", 0, 50, 100), ("mid", 2, 3, 4)], "name string, a int, b int, c int")
    e = V.evidence(df, "stats")
    assert (e["rows"], e["cols"]) == (3, 4) and [m["column"] for m in e["metrics"]] == ["a", "b", "c"]
    assert e["extrema"]["rows"]["lowest"][0]["label"] == "alpha" and e["extrema"]["rows"]["highest"][0]["label"] == "beta"
    xy = spark.createDataFrame([(1, 2, None), (2, 4, 1), (3, 6, None)], "x int, y int, z int")
    c = V.evidence(xy, "correlation")["metrics"]
    assert c == [{"left": "x", "right": "y", "n": 3, "pearson": 1, "spearman": 1}]
    assert V.evidence(df.limit(0), "statistical")["rows"] == 0
    with pytest.raises(ValueError):
        V.evidence(df, "mood")


def test_average_ranks_against_pandas(spark):
    pdf = pd.DataFrame({"g": [i % 3 for i in range(200)], "v": [float((i * 37) % 23) for i in range(200)]})
    pdf.loc[5, "v"] = None
    got = average_ranks(spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v"))), ["g"], "v").toPandas()
    pdf["rank"] = pdf.groupby("g").v.rank()
    want = pdf.dropna().drop_duplicates(["g", "v"])
    assert {tuple(r) for r in got.itertuples(index=False)} == {tuple(r) for r in want[["g", "v", "rank"]].itertuples(index=False)}


def test_join_discovery(spark):
    party = spark.createDataFrame([(1, "Amsterdam"), (2, "Paris"), (3, "Rome")], "Party_ID int, Location string")
    host = spark.createDataFrame([("1", 30), ("2", 40), ("3", 50)], "Host_ID string, Age int")
    both = spark.createDataFrame([(1, 3), (2, 1), (3, 2)], "Party_ID int, Host_ID int")
    tables = {"party": party, "host": host, "party_host": both}
    found = P.join_candidates(tables)
    assert {(c["left_table"], c["left_column"], c["right_table"], c["right_column"]) for c in found} == {("party", "Party_ID", "party_host", "Party_ID"), ("host", "Host_ID", "party_host", "Host_ID")}
    path = next(p for p in P.join_paths(found) if {p["from"], p["to"]} == {"host", "party"})
    assert path["length"] == 2
    ground = P.value_grounding(tables, "What age were the hosts of the party in Amsterdam?").collect()
    assert [(r.table, r.column, r.matches) for r in ground] == [("party", "Location", ["Amsterdam"])]
    assert [c["column"] for c in P.column_grounding({t: d.columns for t, d in tables.items()}, "What age were the hosts?")] == ["Age"]
    county = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "County_Id int, County_name string")
    election = spark.createDataFrame([(2, "x"), (3, "y")], "District int, Committee string")
    assert P.join_candidates({"county": county, "election": election}, {"county": {"County_Id"}})[0]["right_column"] == "District"
    assert P.build_task("How many hosts are older than 30?", tables)["answer"]["type"] == "number"
    assert P.join_candidates({}) == []


def test_profiles(spark):
    df = spark.createDataFrame([("1,200", "x", None, [1]), ("7", "5", "", None), ("8 %", None, "n/a", [2])], "n string, m string, e string, a array<int>")
    assert {r.column: r.kind for r in P.profile_columns(df).collect()} == {"n": "number", "m": "mixed", "e": "empty", "a": "string"}
    d = P.describe_source(df.select("n", "m"), "t")
    assert d["schema"]["shape"] == [3, 2] and "path" not in d and d["schema"]["samples"]["m"] == ["5", "x"]
    assert P.inspect(df, "schema").count() == 4 and P.inspect(df, "sample").count() == 3 and P.inspect(df, "describe", "n").first().numbers == 3


def test_documents(spark):
    pages = spark.createDataFrame([(1, 1, "bbb"), (1, 0, "aaaa"), (2, 0, None)], "doc_id int, page_index int, text string")
    whole = {r.doc_id: r for r in D.join_pages(pages).collect()}
    assert whole[1].text == "[Page 0]\naaaa\n\n[Page 1]\nbbb" and [tuple(s) for s in whole[1].spans] == [(0, 0, 13), (1, 15, 27)]
    docs = spark.createDataFrame([(i, "x" * i) for i in range(0, 130)] + [(999, None)], "doc_id int, text string")
    got = {}
    for r in D.window_chunks(docs, size=30, overlap=4).collect():
        got.setdefault(r.doc_id, []).append((r.char_start, r.char_end, len(r.text)))
    for n in range(130):
        want, s = [], 0
        while True:
            want.append((s, min(s + 30, n), min(s + 30, n) - s))
            if s + 30 >= n:
                break
            s += 26
        assert sorted(got[n]) == want
    assert got[999] == [(0, 0, 0)]
    spans = D.document_chunks(pages.filter("doc_id = 1"), size=16, overlap=2).orderBy("char_start").collect()
    assert [(r.page_start, r.page_end, r.page_count) for r in spans] == [(0, 1, 2), (0, 1, 2)] or spans[0].page_start == 0
    chunks = D.window_chunks(spark.createDataFrame([(1, "a plain text. " * 20 + "the cash flow statement")], "doc_id int, text string"), size=50, overlap=5)
    best = D.rank_chunks(chunks, "cash flow", 1).collect()
    assert len(best) == 1 and "cash" in best[0].text
    n = chunks.count()
    assert [r.chunk_id for r in D.rank_chunks(chunks, "zzz", 2).orderBy("char_start").collect()][0] == "chunk_0" and D.rank_chunks(chunks, "the", n + 1).count() == n
    with pytest.raises(ValueError):
        D.select_chunks(chunks, ["chunk_99"])


def test_map_reduce_goes_on_after_failures(spark):
    chunks = D.window_chunks(spark.createDataFrame([(1, "one"), (2, "bad"), (3, "three")], "doc_id int, text string"))

    def worker(chunk):
        if chunk["text"] == "bad":
            raise RuntimeError("no")
        return {"answer": [chunk["text"], "null", None], "citation": "None"}

    out = D.map_reduce(chunks, D.MapReduceSpec([D.MapGroup("t", worker, replicas=2)]))
    assert sorted((r.doc_id, r.sample, r.answer or "", r.error or "") for r in out.collect()) == [(1, 0, "one", ""), (1, 1, "one", ""), (2, 0, "", "RuntimeError: no"), (2, 1, "", "RuntimeError: no"), (3, 0, "three", ""), (3, 1, "three", "")]
    evidence = {r.doc_id: (r.outputs, r.included, r.failed, r.summary) for r in D.collect_evidence(out).collect()}
    assert evidence == {1: (2, 2, 0, "one"), 2: (2, 0, 2, ""), 3: (2, 2, 0, "three")}


def test_scores(spark):
    assert S.denotation_match(["1,000", "Paris"], "paris; 1000.0") and not S.denotation_match(["a", "b"], ["a"])
    assert S.denotation_match("2004-xx-xx", "2004") and S.denotation_match('"Café" [1]', "cafe")
    assert S.multi_table_match("Last, First", "First Last") and S.multi_table_match(["a and b"], ["a & b"])
    assert S.exact_match("Yes", "true") and S.exact_match("a, b", "b, a") and not S.exact_match("a, b", "b, a", ordered=True) and S.exact_match("5.0%", "5%")
    assert S.near_match("100", "109") and not S.near_match("100", "111")
    assert S.rouge_l("the cat sat", "the cat ran") == pytest.approx(2 / 3) and S.rouge_l("", "x") == 0.0
    assert S.metric_of("DataAnalysis", "TrendForecasting") == "EM_with_error_10"
    df = spark.createDataFrame([("a", "A."), (None, "x"), ("b", None)], "expected string, actual string")
    assert [r.score for r in S.score_answers(df, "EM").collect()] == [1.0, 0.0, 0.0]


def test_checks():
    assert numeric_operation("sum", ["1,000", "2 kg"]) == 1002 and numeric_operation("difference", [5]) is None and numeric_operation("ratio", [1, 0]) is None and numeric_operation("count", ["a", None]) == 2
    assert boolean_operation("gt", ["10", "9"]) and boolean_operation("eq", ["A ", "a"]) and boolean_operation("and", ["yes", "maybe"]) is None
    assert text_operation("strip_label", "Name: Ada") == "Ada" and text_operation("strip_parenthetical", "Ada (UK)") == "Ada" and text_operation("strip_quotes", "“x”") == "x"
    assert agrees("number", "average", [1, 2], "1.5") and not agrees("number", "sum", [], 0) and agrees("list[string]", "identity", ["a", "b"], ["b", "a"])


def test_registered_functions(spark):
    @udf.register("twice", "a long")
    def twice(rows):
        return pd.DataFrame({"a": rows.a * 2})

    df = spark.createDataFrame([(1,), (2,)], "a long")
    assert sorted(r.a for r in udf.apply(df, "twice").collect()) == [2, 4]
    with pytest.raises(ValueError):
        udf.apply(df, "nope")
    with pytest.raises(ValueError):
        udf.apply(df, "twice", by=["a"])
    p = {"type": "binary_op", "op": "=", "left": {"type": "column", "name": "a"}, "right": {"type": "literal", "value": 1}}
    assert udf.rewritten(p, {**p, "right": {"type": "literal", "value": 2}})
    with pytest.raises(ValueError):
        udf.rewritten(p, {**p, "op": ">"})


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b"\nc'), (2, None)], "k int, v string")
    for fmt in ("csv", "json", "parquet", "orc"):
        write_source(df, str(tmp_path / fmt), fmt)
        back = read_source(spark, str(tmp_path / fmt), "jsonl" if fmt == "json" else fmt)
        assert sorted((int(r.k), r.v) for r in back.collect()) == [(1, 'a "b"\nc'), (2, None)]
    (tmp_path / "x.csv").write_text("﻿a;b\n1;2\n", encoding="utf-8")
    assert read_source(spark, str(tmp_path / "x.csv")).columns == ["a", "b"]
    (tmp_path / "y.json").write_text('[{"a": 1}, {"a": 2}]')
    assert read_source(spark, str(tmp_path / "y.json")).count() == 2
    assert sniff_delimiter("a|b|c\n1|2|3\n") == "|" and sniff_delimiter("abc") == ","
    with pytest.raises(ValueError):
        read_source(spark, "x", "exe")


def test_wide_tables(spark):
    wide = spark.createDataFrame([tuple(f"v{i} {j}" for i in range(60)) for j in range(3)], [f"c{i}" for i in range(60)])
    assert [r.column for r in P.profile_columns(wide).collect()] == wide.columns
    other = wide.select(F.col("c59").alias("last"))
    assert {(x["left_column"], x["right_column"]) for x in P.join_candidates({"wide": wide, "other": other})} == {("c59", "last")}
    assert [tuple(r)[:2] for r in P.value_grounding({"wide": wide}, "Where is v59 2?").filter("score = 1").collect()] == [("wide", "c59")]
