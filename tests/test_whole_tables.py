"""Queries over whole tables read every row of them."""

from pyspark.sql import functions as F

from rowan.queries_core import QUERIES
from rowan.sources import load


def test_whole_tables(spark, sf):
    lines, customers, orders, documents = (load(spark, sf, t) for t in ("lineitem", "customer", "orders", "documents"))
    for name in ("fn_math", "project_derive_arith"):
        assert QUERIES[name](spark, sf).count() == lines.count()
    both = QUERIES["join_full"](spark, sf)
    assert both.select("c").distinct().filter("c IS NOT NULL").count() == customers.count()
    assert both.filter("o IS NOT NULL").count() == orders.count()
    assert both.filter("c IS NULL").count() and both.filter("o IS NULL").count()
    words = documents.filter("text IS NOT NULL").agg(F.sum(F.size(F.split(F.lower("text"), " "))).alias("n"))
    assert QUERIES["unnest_explode"](spark, sf).agg(F.sum("n")).first()[0] == words.first().n
    assert QUERIES["coerce_numeric_text"](spark, sf).first().n == lines.filter("round(l_extendedprice, 2) > 20000").count()
    top = orders.orderBy(F.bround("o_totalprice", 0).desc(), "o_orderkey").limit(35).collect()[5:]
    assert [r.k for r in QUERIES["lenient_setops_sort"](spark, sf).collect()] == [r.o_orderkey for r in top]
