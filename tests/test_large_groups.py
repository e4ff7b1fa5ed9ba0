"""Groups above the limit are divided over tasks and give the same rows."""

import pytest
from pyspark.sql import functions as F

from checks import adapters as A
from checks.change_queries import _safe_scans, _starting
from seclake.operators import lifecycle, ordered, reports, risk, views


@pytest.fixture(scope="module")
def history(spark):
    """One scan holds a third of all rows; times repeat, ids decide."""
    return spark.range(3000).select(
        "id",
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 200)).alias("scan_id"),
        (F.col("id") * 37 % 101).cast("int").alias("score"),
        F.when(F.col("id") % 7 == 0, None).otherwise(F.lit("Safe")).alias("lifecycle_status"),
        F.lit("r").alias("reason"),
        F.timestamp_seconds((F.col("id") * 7919 % 500)).cast("timestamp_ntz").alias("timestamp")).cache()


def same(a, b):
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    assert a.select(columns).exceptAll(b.select(columns)).count() == 0
    assert a.count() == b.count() > 0


@pytest.mark.parametrize("limit", [20, 300])
def test_positions(history, limit):
    order = [F.col("timestamp").desc(), F.col("id")]
    same(ordered.positions(history, ["scan_id"], order, limit=limit),
         ordered.positions(history, ["scan_id"], order, limit=None))


def test_positions_when_all_groups_are_large(history, monkeypatch):
    monkeypatch.setattr(ordered, "MAX_HOT_GROUPS", 3)
    order = [F.col("timestamp"), F.col("id")]
    same(ordered.positions(history, ["scan_id"], order, limit=5),
         ordered.positions(history, ["scan_id"], order, limit=None))


def test_a_divided_group_spreads_over_tasks(history):
    rows, divided = ordered.in_pieces(history, ["scan_id"], [F.col("timestamp"), F.col("id")], 100)
    assert divided
    sizes = rows.filter("scan_id = 'hot'").groupBy(ordered.PIECE).count()
    assert sizes.count() >= 10 and sizes.agg(F.max("count")).first()[0] <= 100


def test_running_sums(history):
    order = [F.col("timestamp"), F.col("id")]
    sums = {"so_far": "score", "ids": "id"}
    same(ordered.running_sums(history, ["scan_id"], order, sums, limit=50),
         ordered.running_sums(history, ["scan_id"], order, sums, limit=None))


def test_previous(history):
    values = {"old_score": "score", "old_status": "lifecycle_status"}
    same(ordered.previous(history, ["scan_id"], ["timestamp", "id"], values, limit=30),
         ordered.previous(history, ["scan_id"], ["timestamp", "id"], values, limit=None))


def test_null_keys(spark, history):
    odd = history.withColumn("scan_id", F.when(F.col("scan_id") != "hot", F.col("scan_id")))
    order = [F.col("timestamp"), F.col("id")]
    same(ordered.positions(odd, ["scan_id"], order, limit=100),
         ordered.positions(odd, ["scan_id"], order, limit=None))


def test_deep_page(history, monkeypatch):
    order = [F.col("timestamp").desc(), F.col("id")]
    plain = views.rows_of_page(history, order, 1234, 50)
    expected = [r.id for r in plain.collect()]
    monkeypatch.setattr(views, "DEEP_PAGE_ROWS", 100)
    assert [r.id for r in views.rows_of_page(history, order, 1234, 50).collect()] == expected
    assert views.rows_of_page(history, order, 5000, 50).count() == 0


def test_status_replay(spark, sf):
    changes = A.status_changes(spark, sf)
    found = _starting(changes)
    same(lifecycle.replay_status_changes(changes, found, limit=40),
         lifecycle.replay_status_changes(changes, found))


@pytest.mark.parametrize("limit", [3, 40])
def test_lifecycle_with_large_scans(spark, sf, limit):
    requests = A.transition_requests(spark, sf).withColumn(
        "scan_id", F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("scan_id")))
    scans = _safe_scans(requests).filter("id <> '7'")
    same(lifecycle.run_lifecycle(requests, scans, limit=limit),
         lifecycle.run_lifecycle(requests, scans))


def test_lifecycle_of_one_scan(spark):
    targets = ["Warning", "Critical", "Vulnerable", "Critical", "Bogus", "Resolved", "Safe"] * 30
    rows = [(i, "only", t) for i, t in enumerate(targets)]
    requests = spark.createDataFrame(rows, "id BIGINT, scan_id STRING, target STRING").withColumn(
        "timestamp", F.lit("2026-01-01").cast("timestamp_ntz"))
    scans = spark.createDataFrame([("only", "Safe", 30)], "id STRING, lifecycle_status STRING, risk_score INT")
    plain = lifecycle.run_lifecycle(requests, scans)
    same(lifecycle.run_lifecycle(requests, scans, limit=10), plain)
    got = plain.orderBy("id").limit(8).collect()
    assert [r.accepted for r in got] == [True, False, True, True, False, True, False, False]
    assert got[5].new_score == 0 and got[5].old_score == 30
    assert got[6].reason == "Transition from 'Resolved' to 'Safe' is not allowed"


def test_large_ids_are_kept(spark):
    ids = [2**60 + 1, 2**60 + 3, 2**53 + 1]
    requests = spark.createDataFrame([(i, "x", "Warning") for i in ids],
                                     "id BIGINT, scan_id STRING, target STRING").withColumn(
        "timestamp", F.lit("2026-01-01").cast("timestamp_ntz"))
    scans = spark.createDataFrame([("x", "Safe", 1), ("y", "Safe", None)],
                                  "id STRING, lifecycle_status STRING, risk_score INT")
    for limit in (1, 100):
        got = lifecycle.run_lifecycle(requests, scans, limit=limit).collect()
        assert sorted(r.id for r in got) == sorted(ids)


def test_unknown_scan_is_rejected(spark):
    requests = spark.sql(
        "SELECT CAST(1 AS BIGINT) id, 'x' scan_id, 'Warning' target, TIMESTAMP_NTZ '2026-01-01' timestamp")
    scans = spark.createDataFrame([("y", "Safe", 1)], "id STRING, lifecycle_status STRING, risk_score INT")
    row = lifecycle.run_lifecycle(requests, scans).collect()
    assert [(r.accepted, r.reason, r.new_status) for r in row] == [(False, "Scan x not found", None)]


def test_breakdown_and_change_log(spark, sf):
    found = A.vulnerabilities(spark, sf).withColumn(
        "scan_id", F.when(F.col("line_number") <= 2, F.lit("hot")).otherwise(F.col("scan_id")))
    same(risk.breakdown_rows(found, ["scan_id"], ["created_at", "id"], limit=20),
         risk.breakdown_rows(found, ["scan_id"], ["created_at", "id"]))
    order = [F.col("created_at"), F.col("id")]
    same(reports.change_log(found, ["scan_id"], order, limit=20),
         reports.change_log(found, ["scan_id"], order))


def test_scan_details_of_a_large_scan(spark, sf):
    found = A.vulnerabilities(spark, sf).withColumn(
        "scan_id", F.when(F.col("line_number") <= 2, F.lit("1")).otherwise(F.col("scan_id")))
    scans = A.scans(spark, sf)
    same(views.scan_details(scans, found, limit=50), views.scan_details(scans, found))
    large = views.nested_details(views.scan_details(scans, found, limit=50), ["1"]).first()
    ids = [f.id for f in large.vulnerabilities]
    assert ids == sorted(ids) and len(ids) == found.filter("scan_id = '1'").count() > 100
