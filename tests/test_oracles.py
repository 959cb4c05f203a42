"""Every registered query against its SQL on the smallest tables."""

import pytest

import __spark_entry__ as entry
from rowan.compare import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, name):
    found = compare(spark, SF, [name])[name]
    assert found.startswith(("ok", "no SQL")), found


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["l_returnflag", "l_linestatus", "revenue", "n"] and df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
