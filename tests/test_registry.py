"""Registered queries against their checking SQL on the small tables, and the shape of some plans."""

import duckdb
import pytest

import __spark_entry__ as entry
from flowlens import adapters as A
from flowlens.operators import reports
from flowlens.plans.registry import as_of
from tools.check import TABLES, rows_of

SMALL = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
FAST = [n for n in ORACLES if not n.startswith(("stream_", "read_", "export_batch"))]


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    return connection


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, duck, name):
    df = QUERIES[name](spark, SMALL)
    cursor = duck.execute(ORACLES[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(columns)
    text = plan(df)  # nothing may pair everything with everything
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert rows_of(df.columns, df.collect()) == rows_of(columns, cursor.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_sql_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_report_reads_only_its_columns_and_pushes_the_time(spark):
    text = plan(reports.daily_summary(A.logs(spark, SMALL), as_of()))
    assert "user_id" not in text.split("ReadSchema")[1] and "props" not in text.split("ReadSchema")[1]
    assert "partial_" in text


def test_top_k_does_not_sort_everything(spark):
    text = plan(reports.top_by_bytes(A.logs(spark, SMALL), "src_ip"))
    assert "TakeOrderedAndProject" in text and "rangepartitioning" not in text


def test_list_reports_leave_the_logs_where_they_are(spark):
    """Also with broadcasting by size switched off: only the rows of a page are looked up and moved."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        listed, threats = plan(QUERIES["alerts_listed"](spark, SMALL)), plan(QUERIES["report_threats"](spark, SMALL))
    finally:
        spark.conf.set(key, before)
    semi = [line for line in listed.splitlines() if "LeftSemi" in line]
    assert len(semi) == 2 and all("BroadcastHashJoin" in line for line in semi)
    assert "BroadcastHashJoin" in threats and "SortMergeJoin" not in threats and "hashpartitioning" not in threats
