"""Lists and dashboard numbers at their edges."""

import pytest
from pyspark.sql import functions as F

from checks import adapters as A
from seclake.operators import maintain, ordered, risk, views
from seclake.plans.dashboard import dashboard


def test_empty_tables(spark, sf):
    scans = A.scans(spark, sf).limit(0)
    found = A.vulnerabilities(spark, sf).limit(0)
    assert tuple(views.dashboard_totals(scans).first()) == (0, 0, 0, 0)
    assert {(r["lifecycle_status"], r["count"]) for r in views.scans_by_status(scans).collect()} == {
        (s, 0) for s in ("Safe", "Warning", "Vulnerable", "Critical", "Resolved")}
    assert {r["count"] for r in views.findings_by_severity(found).collect()} == {0}
    counters = views.scan_page_counters(scans).first()
    assert (counters.total_items, counters.total_pages, counters.has_next, counters.has_previous) == (
        0, 1, False, False)
    assert views.audit_page_counters(A.audit_logs(spark, sf).limit(0)).first().total_pages == 1
    details = views.scan_details(A.scans(spark, sf), found)
    assert details.filter("position IS NOT NULL").count() == 0
    first = A.scans(spark, sf).first().id
    assert [r.vulnerabilities for r in views.nested_details(details, [first]).collect()] == [[]]


def test_unknown_values(spark):
    scans = spark.createDataFrame([("Odd",), ("Safe",)], "lifecycle_status STRING")
    got = {(r.place, r.lifecycle_status): r["count"] for r in views.scans_by_status(scans).collect()}
    assert got[(5, "Odd")] == 1 and got[(0, "Safe")] == 1 and got[(4, "Resolved")] == 0
    found = spark.createDataFrame([("Info",), (None,), ("Low",)], "severity STRING")
    assert {r.severity: r["count"] for r in views.findings_by_severity(found).collect()} == {
        "Critical": 0, "High": 0, "Medium": 0, "Low": 1}
    counts = risk.severity_counts(found.withColumn("k", F.lit(1)), ["k"]).first()
    assert counts.total == 1


def test_pages(spark, sf):
    scans = A.scans(spark, sf)
    first = [r.scanId for r in views.page_of_scans(scans, 1, 20).collect()]
    assert [r.scanId for r in views.page_of_scans(scans, 0, 20).collect()] == first
    assert len(first) == 20 and views.page_of_scans(scans, 1, 500).count() == 100
    assert views.page_of_scans(scans, 10_000, 20).count() == 0
    counters = views.scan_page_counters(scans, 0, 20).first()
    assert counters.page == 0 and counters.has_next and not counters.has_previous
    audit, users = A.audit_logs(spark, sf), A.users(spark, sf)
    assert views.page_of_audit(audit, users, 1, 500).count() == 500
    for size in (0, -1):
        with pytest.raises(ValueError):
            views.page_of_audit(audit, users, 1, size)
        with pytest.raises(ValueError):
            views.scan_page_counters(scans, 1, size)


def test_visible_rows(spark, sf):
    scans = A.scans(spark, sf)
    owner = scans.first().user_id
    mine = scans.filter(F.col("user_id") == owner).count()
    assert views.visible_to(scans, "user_id", owner, "user").count() == mine
    assert views.visible_to(scans, "user_id", owner, "user", wanted="9").count() == mine
    assert views.visible_to(scans, "user_id", "x", "admin").count() == scans.count()
    assert views.visible_to(scans, "user_id", "x", "admin", wanted=owner).count() == mine
    assert views.by_id(scans, scans.first().id).count() == 1


def test_dashboard_of_one_user(spark, sf):
    scans, found = A.scans(spark, sf), A.vulnerabilities(spark, sf)
    owner = scans.first().user_id
    own = dashboard(scans, found, owner)
    assert own["totals"].first().total_scans == scans.filter(F.col("user_id") == owner).count()
    per_user = views.severities_by_user(found, scans).filter(F.col("user_id") == owner)
    assert {r.severity: r.findings for r in per_user.collect()} == {
        r.severity: r["count"] for r in own["severities"].collect()}
    assert own["recent"].count() <= 10


def test_open_scores_when_all_is_closed(spark):
    scans = spark.createDataFrame([("a", "x"), ("b", "y")], "id STRING, risk_level STRING")
    found = spark.createDataFrame(
        [("a", "Critical", "fixed"), ("a", "High", "accepted"), ("b", "Info", "open")],
        "scan_id STRING, severity STRING, status STRING")
    got = {r.id: (r.open_score, r.open_lifecycle) for r in risk.open_scores(scans, found).collect()}
    assert got == {"a": (0, "Resolved"), "b": (13, "Safe")}


def test_repo_ties_go_to_the_greatest_path(spark):
    rows = spark.createDataFrame(
        [("r", "a.py", 50, "High"), ("r", "b.py", 50, "Other"), ("r", "c.txt", 99, "Critical"),
         ("s", "x.txt", 1, "Low")],
        "repo STRING, file_path STRING, risk_score INT, risk_level STRING")
    got = risk.repo_rollup(rows, ["repo"]).collect()
    assert [(r.repo, r.risk_score, r.risk_level, r.top_file, r.files_scanned) for r in got] == [
        ("r", 50, "Other", "b.py", 2)]


def test_first_finding_wins(spark):
    from seclake.operators.scanning import distinct_findings
    rows = spark.createDataFrame([(1, "A", 2, "x"), (0, "A", 2, "y"), (2, "A", 3, "z")],
                                 "source_order INT, vuln_id STRING, line_number INT, kept STRING")
    got = distinct_findings(rows, [F.col("source_order")], ["vuln_id", "line_number"])
    assert sorted(r.kept for r in got.collect()) == ["y", "z"]


def test_updates_and_deletes(spark):
    table = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "id STRING, n INT, t STRING")
    new = spark.createDataFrame([("a", 9, None), ("c", 5, "z")], "id STRING, n INT, t STRING")
    assert sorted(map(tuple, maintain.updated(table, new).collect())) == [("a", 9, "x"), ("b", 2, "y")]
    child = spark.createDataFrame([("1", "a"), ("2", "q"), ("3", None)], "id STRING, scan_id STRING")
    assert [r.id for r in maintain.orphans(child, table, "scan_id").collect()] == ["2"]
    assert maintain.repeated_keys(child.union(child), "id").count() == 3
    gone = spark.createDataFrame([("a",), ("a",)], "scan_id STRING")
    left = maintain.without_scans({"scans": table, "vulnerabilities": child}, gone)
    assert [r.id for r in left["scans"].collect()] == ["b"]
    assert sorted(r.id for r in left["vulnerabilities"].collect()) == ["2", "3"]
    audit = maintain.deletion_audit(gone, "1", F.lit("2026-01-01").cast("timestamp_ntz")).collect()
    assert [(r.action, r.details) for r in audit] == [("scan_deleted", "Scan a deleted by admin")]
    assert audit[0].id is not None
    twice = spark.createDataFrame([("a", 9, "q"), ("a", 9, None)], "id STRING, n INT, t STRING")
    assert sorted(map(tuple, maintain.updated(table, twice).collect())) == [("a", 9, "q"), ("b", 2, "y")]


def test_overrides_build_on_each_other(spark):
    from seclake.operators.lifecycle import score_overrides
    scans = spark.createDataFrame([("s", 80, "Critical")], "id STRING, risk_score INT, lifecycle_status STRING")
    asked = spark.sql("""SELECT * FROM VALUES (1L, 's', 10, TIMESTAMP_NTZ '2026-01-01'),
        (2L, 's', 30, TIMESTAMP_NTZ '2026-01-01') AS t(id, scan_id, score, timestamp)""")
    done = score_overrides(scans, asked)
    assert sorted((r.id, r.old_score, r.old_status, r.new_score, r.new_status) for r in done.collect()) == [
        (1, 80, "Critical", 10, "Warning"), (2, 10, "Warning", 30, "Vulnerable")]
    assert maintain.override_history(done, "1").filter("id IS NOT NULL").select("id").distinct().count() == 2
    like = asked.union(asked.selectExpr("id + 2", "scan_id", "score", "timestamp"))
    rows = maintain.override_audit(score_overrides(scans, like), "1")
    assert rows.select("id").distinct().count() == 4


def test_ids_tell_keys_apart(spark):
    from seclake.functions.texts import stable_id
    rows = spark.createDataFrame([("a#b", "c"), ("a", "b#c"), (None, "a"), ("a", None)], "x STRING, y STRING")
    assert rows.select(stable_id(F.col("x"), F.col("y"))).distinct().count() == 4


def test_score_history_edges(spark):
    rows = spark.sql("""SELECT * FROM VALUES
        (2L, 's', 80, NULL, NULL, TIMESTAMP_NTZ '2026-01-01'), (1L, 's', 10, '', 'first', TIMESTAMP_NTZ '2026-01-01')
        AS t(id, scan_id, score, lifecycle_status, reason, timestamp)""")
    spots = views.progression(rows).orderBy("x").collect()
    assert [(s.x, s.y, s.label, s.status) for s in spots] == [
        (0, 10, "first", "Safe"), (1, 80, "", "Critical")]
    meta = views.progression_metadata(rows).first()
    assert (meta.current_score, meta.current_status, meta.min_score, meta.max_score) == (80, "Critical", 10, 80)
    assert ordered.latest(rows, ["scan_id"], [F.col("timestamp").desc(), F.col("id").desc()]).first().id == 2


def test_checked_requests(spark):
    rows = spark.createDataFrame(
        [(0, "paste", "open"), (100, "github", "fixed"), (101, "paste", "open"), (None, "paste", "open"),
         (5, "mail", "open"), (5, "paste", "done")], "score INT, mode STRING, status STRING")
    got = [(r.valid, r.reason is None) for r in views.checked(rows).collect()]
    assert got == [(True, True), (True, True)] + [(False, False)] * 4


def test_line_changes(spark):
    from seclake.operators.reports import line_changes, line_counts
    schema = "file_path STRING, text STRING"
    before = spark.createDataFrame(
        [("a", "x\ny\ny\nz"), ("same", "q\n"), ("gone", "1\n1"), ("empty", "")], schema)
    after = spark.createDataFrame(
        [("a", "x\ny\nw\nz\n"), ("same", "q\n"), ("new", "n"), ("empty", None)], schema)
    got = sorted(map(tuple, line_changes(before, after).collect()))
    twice = spark.createDataFrame([("p", "1"), ("p", "2")], schema)
    once = spark.createDataFrame([("p", "2")], schema)
    assert list(map(tuple, line_changes(twice, once).collect())) == [("p", "-", "1", 1)]
    assert got == [("a", "+", "w", 1), ("a", "-", "y", 1), ("gone", "-", "1", 2), ("new", "+", "n", 1)]
    counts = {r.file_path: (r.line_count_original, r.line_count_secure)
              for r in line_counts(before, after.filter("text is not null")).collect()}
    assert counts == {"a": (4, 4), "same": (1, 1), "gone": (2, 0), "new": (0, 1), "empty": (0, 0)}
