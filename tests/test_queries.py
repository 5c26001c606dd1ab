"""Every registered query with a SQL counterpart against DuckDB, and properties of the plans."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from sigspark.harness.registry import ORACLES, QUERIES
from tests.conftest import DATA

SLOW = {"banded_alignment", "read_calibration", "methylation_calls", "event_realignment", "event_realignment_summary", "resquiggle_reads"}
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{DATA}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def rows(frame):
    columns = sorted(frame.columns)
    text = lambda x: "NULL" if x is None or x != x else f"{float(x):.9g}" if isinstance(x, (int, float)) and not isinstance(x, bool) else str(x)
    return columns, sorted(tuple(map(text, r)) for r in frame[columns].astype(object).where(frame[columns].notna(), None).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(duck.execute(ORACLES[name]).df())


def test_entry_and_registry(spark):
    assert entry.entry(spark).limit(1).count() == 1
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())
    assert set(QUERIES) - set(ORACLES) == SLOW


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(QUERIES) - SLOW))
def test_no_pairwise_products(spark, name):
    text = plan(entry.queries()[name](spark, DATA))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scans_are_pruned_and_filtered(spark):
    text = plan(entry.queries()["mapped_quality_filter"](spark, DATA))
    assert "o_totalprice" not in text and "o_orderdate" not in text
    text = plan(entry.queries()["meth_freq"](spark, DATA))
    assert "l_extendedprice" not in text and "l_shipdate" not in text


def test_detect_events_covers_every_sample(spark):
    from pyspark.sql import functions as F
    events = entry.queries()["detect_events"](spark, DATA)
    per_read = events.groupBy("read_id").agg(F.sum("length").alias("n"), F.min("start").alias("a"))
    assert per_read.where("n != 100 OR a != 0").count() == 0
