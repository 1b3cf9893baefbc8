"""Registered corpus queries against their SQL on the smallest data set."""

import os

import pytest

import __spark_entry__ as entry
from signalspark.llm.oracle import LLM_SQL
from signalspark.llm.queries import LLM_QUERIES

DATA = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
@pytest.mark.parametrize("name", sorted(LLM_SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    want = con.execute(LLM_SQL[name])
    columns = [c[0] for c in want.description]
    got = LLM_QUERIES[name](spark, DATA)
    assert sorted(got.columns) == sorted(columns)
    shown = lambda rows: sorted(tuple(f"{v:.5f}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    assert shown(got.select(columns).collect()) == shown(want.fetchall())


def test_registered_names():
    names = entry.queries()
    assert "pipeline" in names
    assert [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 14)] == [1] * 13
    native = ("line_dedup", "sharding", "mixing", "components")
    for module in native:  # no Python in tasks
        with open(os.path.join(os.path.dirname(entry.__file__), "signalspark", "llm", f"{module}.py")) as f:
            text = f.read()
        assert "mapIn" not in text and "udf" not in text and "pandas" not in text and ".rdd" not in text
