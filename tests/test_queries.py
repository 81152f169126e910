"""Every query with SQL against that SQL, on the smallest tables."""

from __future__ import annotations

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
ROAD = sorted(q for q in entry.oracle_sql() if not q.startswith("op"))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in os.listdir(SF):
        c.sql(f"create view {t.split('.')[0]} as select * from '{SF}/{t}'")
    return c


def rows(pdf):
    cell = lambda v: None if v is None or v != v else round(v, 7) + 0.0 if isinstance(v, float) else v.item() if hasattr(v, "item") else v
    return sorted(repr([cell(v) for v in r]) for r in pdf[sorted(pdf.columns)].astype(object).values.tolist())


@pytest.mark.parametrize("name", ROAD)
def test_against_sql(spark, con, name):
    got, want = entry.queries()[name](spark, SF).toPandas(), con.sql(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_reset_pose_sends_no_table_to_the_driver(spark):
    """Its plan reads stored results; the estimates of small tables don't make it broadcast what comes of them."""
    assert "Broadcast" not in entry.queries()["reset_pose"](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_reset_pose_has_the_driver_plan_few_queries(spark):
    """The driver's memory holds plans and their code: four stages take a query for each table that is read twice, one for each result, and one to see whether any point is left."""
    store = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    before = store.executionsCount()
    assert entry.queries()["reset_pose"](spark, SF).count() > 0
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert store.executionsCount() - before <= 18
