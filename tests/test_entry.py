"""Every registered query against its SQL on the smallest tables; plans without cross joins."""

import math
import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def _plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    return f"{float(v):.6g}" if type(v).__name__ == "Decimal" else str(v)


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.execute(f"create view {f.split('.')[0]} as select * from '{DATA}/{f}'")
    return con


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_sql_has_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    cursor = duck.execute(entry.oracle_sql()[name])
    named = [x[0] for x in cursor.description]
    assert sorted(named) == columns
    at = [named.index(c) for c in columns]
    wanted = sorted(tuple(_plain(r[i]) for i in at) for r in cursor.fetchall())
    assert sorted(tuple(_plain(x) for x in r) for r in df.select(*columns).collect()) == wanted


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    df = entry.queries()[name](spark, DATA)
    assert len(set(df.columns)) == len(df.columns)
    df.write.format("noop").mode("overwrite").save()


@pytest.mark.parametrize("name", ["ner_relaxed_by_label", "gold_best_jaccard", "spans_on_pages", "gazetteer_candidates", "spans_snapped_to_tokens"])
def test_no_cross_joins(spark, name):
    plan = entry.queries()[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
