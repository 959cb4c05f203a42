import zlib

import pandas as pd
import pytest
from pyspark.sql import functions as F

from rowan.functions import helpers
from rowan.operators import documents as D
from rowan.operators.verify import finalise
from rowan.sources import read_source
from rowan.sources.derived import DerivedTables
from rowan.sources.pdf import pdf_pages
from rowan.sources.readers import prepare


def pdf(*pages: bytes, packed: bool = True) -> bytes:
    """A PDF of pages with these contents; the second font maps codes to characters."""
    cmap = b"beginbfchar <01> <0041> <02> <00E9> endbfchar beginbfrange <10> <12> <0061> endbfrange"
    stream = lambda x: (b"<< /Filter /FlateDecode /Length %d >>\nstream\n" % len(zlib.compress(x)) + zlib.compress(x) if packed else b"<< /Length %d >>\nstream\n" % len(x) + x) + b"\nendstream"
    bodies = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Resources << /Font << /F1 3 0 R /F2 4 0 R >> >> /Kids [" + b" ".join(b"%d 0 R" % (6 + 2 * i) for i in range(len(pages))) + b"] >>", b"<< /Type /Font >>", b"<< /Type /Font /ToUnicode 5 0 R >>", stream(cmap)]
    for i, p in enumerate(pages):
        bodies += [b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (7 + 2 * i), stream(p)]
    return b"%PDF-1.5\n" + b"\n".join(b"%d 0 obj\n" % (i + 1) + b + b"\nendobj" for i, b in enumerate(bodies)) + b"\n%%EOF"


ONE = rb"BT /F1 12 Tf 72 700 Td (Net \(loss\) of 5) Tj 0 -14 Td [(in) -250 (20) 10 (04)] TJ ET"
TWO = rb"BT /F2 12 Tf <01 02 10 11 12> Tj T* /F1 9 Tf (caf\351) Tj ET"


@pytest.mark.parametrize("packed", [True, False])
def test_pages_of_pdf(packed):
    assert pdf_pages(pdf(ONE, TWO, b"", packed=packed)) == [(0, "Net (loss) of 5\nin 2004", None), (1, "Aéabc\ncafé", None), (2, "", None)]
    assert pdf_pages(b"no file") == [] and pdf_pages(b"x trailer << /Encrypt 9 0 R >>")[0][2].startswith("ValueError")


def test_documents_from_pdf(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(pdf(ONE, TWO))
    (tmp_path / "b.pdf").write_bytes(pdf(TWO))
    pages = read_source(spark, str(tmp_path), "pdf")
    assert sorted((r.doc_id[-5:], r.page_index, r.text[:3]) for r in pages.collect()) == [("a.pdf", 0, "Net"), ("a.pdf", 1, "Aéa"), ("b.pdf", 0, "Aéa")]
    out = prepare(spark, str(tmp_path / "a.pdf"), "report")
    chunk = out["data"].first()
    assert out["kind"] == "document" and chunk.text.startswith("[Page 0]\nNet (loss) of 5") and (chunk.page_start, chunk.page_end) == (0, 1)
    assert prepare(spark, str(tmp_path / "a.pdf"), "report", strategy="page")["data"].count() == 2


def test_csv_is_split_unless_cells_span_lines(spark, tmp_path):
    (tmp_path / "plain.csv").write_text('a;b\n1;"x ""y"""\n2;z\n')
    (tmp_path / "long.csv").write_text('a,b\n1,"x\ny"\n2,z\n')
    assert [tuple(r) for r in read_source(spark, str(tmp_path / "plain.csv")).collect()] == [(1, 'x "y"'), (2, "z")]
    assert [tuple(r) for r in read_source(spark, str(tmp_path / "long.csv")).collect()] == [(1, "x\ny"), (2, "z")]
    out = prepare(spark, str(tmp_path / "plain.csv"), "t")
    assert out["kind"] == "table" and out["about"]["schema"]["shape"] == [2, 2] and out["about"]["schema"]["samples"]["a"] == ["1", "2"]


def test_derived_tables_are_built_once(spark, tmp_path):
    built = []

    def build(n):
        built.append(n)
        return spark.range(n)

    tables = DerivedTables(spark, str(tmp_path / "derived"))
    assert tables.get({"n": 3}, lambda: build(3)).count() == tables.get({"n": 3}, lambda: build(3)).count() == 3 and built == [3]
    assert tables.get({"n": 4}, lambda: build(4)).count() == 4 and built == [3, 4]
    (tmp_path / "x.csv").write_text("a\n1\n")
    assert len(tables.files(str(tmp_path / "x.csv"))) == 1 and tables.files(str(tmp_path / "none")) == []
    small = DerivedTables(spark, str(tmp_path / "derived"), most_bytes=1)
    assert small.get({"n": 5}, lambda: build(5)).count() == 5
    assert len([p for p in (tmp_path / "derived").iterdir() if p.name[0] != "."]) == 1


def test_helpers():
    assert helpers.to_number(pd.Series(["$1,200", "5 %", "x", None])).tolist()[:2] == [1200, 5] and helpers.to_number(pd.Series([1, 2])).tolist() == [1, 2]
    assert helpers.to_datetime(pd.Series(["2020-01-02", "no"])).isna().tolist() == [False, True]
    assert helpers.parse_list(pd.Series(["[1, 2]", "['a']", "x", " ", ["b"]])).tolist() == [[1, 2], ["a"], "x", [], ["b"]]


def test_finaliser():
    facts = [{"answer": "7", "operation": "sum", "cited": ["2", "4"]}, {"answer": "6 kg", "operation": "sum", "cited": ["2 kg", "4 kg"]}]
    assert finalise("number", facts) == 6 and finalise("number", facts[:1]) is None
    assert finalise("boolean", [{"answer": "yes", "operation": "gt", "cited": [5, 3]}]) is True
    assert finalise("list[string]", [{"answer": ["b", "a"], "cited": ["a", "b"]}]) == ["b", "a"]
    assert finalise("string", [{"answer": "Lisbon", "operation": "nonsense", "cited": ["Lisbon"]}, {"answer": "Lisbon", "operation": "strip_label", "cited": ["City: Lisbon"]}]) == "Lisbon"
    assert finalise("number", [{"answer": 30, "operation": "count", "cited": list(range(30))}]) == 30


PROGRAM = '''
def prepare_jobs(context):
    jobs = []
    chunks = chunk_by_page(context)
    for task, what in [("income", "net income"), ("cash", "cash flow")]:
        for chunk in chunks:
            for _ in range(2):
                jobs.append(JobManifest(chunk=chunk, task=task, instruction=f"Find the {what}."))
    jobs.extend([JobManifest(task="total", instruction="Find the total.", chunk_ids=["chunk_0"])] * 3)
    jobs += [JobManifest(task="year", instruction="Find " + "the year.") for chunk in chunks]
    return jobs

def transform_outputs(jobs):
    raise SystemExit
'''


def test_programs_are_read_not_run(spark):
    groups, ways = D.program_groups(PROGRAM, lambda chunk: {"answer": chunk["instruction"]})
    assert ways == {"page"}
    assert [(g.task, g.instruction, g.replicas, g.chunks) for g in groups] == [("income", "Find the net income.", 2, None), ("cash", "Find the cash flow.", 2, None), ("total", "Find the total.", 3, ["chunk_0"]), ("year", "Find the year.", 1, None)]
    chunks = D.page_chunks(spark.createDataFrame([(1, 0, "a"), (1, 1, "b")], "doc_id int, page_index int, text string"))
    out = D.map_reduce(chunks, D.MapReduceSpec(groups)).groupBy("task").count().collect()
    assert {r.task: r["count"] for r in out} == {"income": 4, "cash": 4, "total": 3, "year": 2}
    for bad in ("x = 1", "def prepare_jobs(c):\n    return []"):
        with pytest.raises(ValueError):
            D.program_groups(bad, lambda c: {})


def test_failures_are_soft_or_hard(spark):
    chunks = D.window_chunks(spark.createDataFrame([(1, "good"), (2, "bad")], "doc_id int, text string"))

    def worker(chunk):
        if chunk["text"] == "bad":
            raise ValueError("no")
        return {"answer": "yes"}

    soft = D.map_chunks(chunks, D.MapGroup("t", worker))
    assert {(r.answer, r.error) for r in soft.collect()} == {("yes", None), (None, "ValueError: no")}
    with pytest.raises(Exception, match="ValueError"):
        D.map_chunks(chunks, D.MapGroup("t", worker, failure="hard")).select(F.count("*")).collect()
    with pytest.raises(ValueError):
        D.map_chunks(chunks, D.MapGroup("t", worker, failure="other"))
