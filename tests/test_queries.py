"""Registered queries against SQL on the smallest data set."""

import math
import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
duckdb = pytest.importorskip("duckdb")
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")
# Enough to cover every operator family; the comparison of all queries is the driver's.
CHECKED = ("market_bars", "news_dedup", "score_increment", "tag_entity", "tag_dictionary", "clean_text",
           "score_lexicon", "align_forward", "decay_linear", "decay_variance", "half_life_memory",
           "technical_features", "features_flat", "features_decay", "fold_standardize",
           "rule_comparison", "drawdown", "sweep_features", "best_config", "importance_compare",
           "score_boxplot", "score_histogram", "cv_logistic_keys", "logistic_gradient", "score_model_totals")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{DATA}/{name}'")
    return con


def cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return ""
    return f"{v:.6f}" if isinstance(v, float) else str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, sql, name):
    got = entry.queries()[name](spark, DATA)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan and "PythonUDF" not in plan
    want = sql.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows_of(got.columns, got.collect()) == rows_of(columns, want.fetchall())


def test_scan_reads_only_the_columns_it_needs(spark):
    got = entry.queries()["decay_exponential"](spark, DATA)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<ts:timestamp_ntz,event_type:string,value:double>" in plan
    assert plan.count("Exchange hashpartitioning") == 1  # the daily aggregate; news is not shuffled


def test_every_sql_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry is not None


def test_entry(spark):
    assert entry.entry(spark).count() > 0
