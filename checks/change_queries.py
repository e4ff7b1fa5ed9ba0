"""Lifecycle, deletes, updates, checks, appended rows, answers and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import adapters as A
from checks.pieces import WEIGHT_ALL, lifecycle_sql, score_sql
from checks.registry import given, query
from seclake import schemas
from seclake.functions import scores
from seclake.operators import answers, lifecycle, maintain, reports, views
from seclake.operators.ordered import latest
from seclake.plans import changes
from seclake.plans.answered_scans import answered_profiles
from seclake.plans.logs import append_log
from seclake.session import new_folder
from seclake.sources.bucketed import BucketedTable
from seclake.sources.tables import append, read_answers, read_table, write_reports
from seclake.streaming.feed import event_feed, run_to_end
from seclake.streaming.lifecycle import run_lifecycle_stream
from seclake.streaming.scores import run_live_scores

_MOVES = """(VALUES ('Safe', 'Warning'), ('Safe', 'Resolved'), ('Warning', 'Safe'), ('Warning', 'Vulnerable'),
    ('Warning', 'Resolved'), ('Vulnerable', 'Warning'), ('Vulnerable', 'Critical'), ('Vulnerable', 'Resolved'),
    ('Critical', 'Vulnerable'), ('Critical', 'Resolved')) m(source, goal)"""


@query("f22_allowed_moves", given("transition_requests", "scans") + f"""
SELECT r.id, s.lifecycle_status AS current, r.target, m.source IS NOT NULL AS allowed
FROM transition_requests r LEFT JOIN scans s ON r.scan_id = s.id
LEFT JOIN {_MOVES} ON m.source = s.lifecycle_status AND m.goal = r.target""")
def f22(spark, sf):
    asked, scans = A.transition_requests(spark, sf), A.scans(spark, sf)
    joined = asked.join(
        scans.select(F.col("id").alias("_scan"), F.col("lifecycle_status").alias("current")),
        F.col("scan_id") == F.col("_scan"), "left")
    return joined.select("id", "current", "target", scores.may_move(
        F.col("current"), F.col("target")).alias("allowed"))


@query("w5_score_changes", given("score_history") + """
SELECT id, scan_id, lag(score) OVER w AS old_score, score AS new_score,
    lag(lifecycle_status) OVER w AS old_status, lifecycle_status AS new_status
FROM score_history WINDOW w AS (PARTITION BY scan_id ORDER BY timestamp, id)""")
def w5(spark, sf):
    return lifecycle.score_changes(A.score_history(spark, sf)).select(
        "id", "scan_id", "old_score", "new_score", "old_status", "new_status")


_REPLAY = given("status_changes") + f"""
, found AS (SELECT DISTINCT vuln_id, scan_id, severity FROM status_changes),
starting AS (SELECT scan_id, sum({WEIGHT_ALL}) AS weight,
    count(*) FILTER (WHERE severity = 'Critical') AS critical FROM found GROUP BY scan_id),
steps AS (SELECT *, COALESCE(lag(status) OVER (PARTITION BY scan_id, vuln_id ORDER BY timestamp, id), 'open')
    AS old_status, {WEIGHT_ALL} AS weight FROM status_changes),
deltas AS (SELECT *, CASE WHEN status IN ('fixed', 'accepted') THEN 0 ELSE 1 END
    - CASE WHEN old_status IN ('fixed', 'accepted') THEN 0 ELSE 1 END AS step FROM steps),
sums AS (SELECT d.*, s.weight + sum(step * d.weight) OVER w AS raw,
    s.critical + sum(CASE WHEN severity = 'Critical' THEN step ELSE 0 END) OVER w AS critical
    FROM deltas d JOIN starting s ON d.scan_id = s.scan_id
    WINDOW w AS (PARTITION BY d.scan_id ORDER BY timestamp, id ROWS UNBOUNDED PRECEDING)),
scored AS (SELECT *, {score_sql('raw', 'critical')} AS score FROM sums)
"""
_REPLAYED = _REPLAY + f"""SELECT id, scan_id, vuln_id, old_status, status, score,
    CASE WHEN score = 0 THEN 'Resolved' ELSE {lifecycle_sql('score')} END AS lifecycle_status FROM scored"""
_REPLAY_COLUMNS = ["id", "scan_id", "vuln_id", "old_status", "status", "score", "lifecycle_status"]


def _starting(changes):
    return changes.select("vuln_id", "scan_id", "severity").distinct().withColumn(
        "status", F.lit("open"))


@query("w6_status_replay", _REPLAYED)
def w6(spark, sf):
    asked = A.status_changes(spark, sf)
    return lifecycle.replay_status_changes(asked, _starting(asked)).select(*_REPLAY_COLUMNS)


@query("t4_live_scores", _REPLAYED)
def t4(spark, sf):
    arriving = A.stream(spark, sf, "events", A._STATUS_CHANGES)
    findings = _starting(A.status_changes(spark, sf))
    return run_live_scores(arriving, findings, new_folder(spark, "scores")).select(
        *_REPLAY_COLUMNS)


_MACHINE = given("transition_requests") + f"""
, moves AS (SELECT * FROM {_MOVES}),
asked AS (SELECT *, row_number() OVER (PARTITION BY scan_id ORDER BY timestamp, id) AS n
    FROM transition_requests),
walk AS (
    WITH RECURSIVE walk AS (
        SELECT scan_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS id, CAST(NULL AS VARCHAR) AS target,
            false AS accepted, CAST(NULL AS VARCHAR) AS old_status, 'Safe' AS new_status,
            CAST(NULL AS INT) AS old_score, 20 AS new_score
        FROM (SELECT DISTINCT scan_id FROM asked)
        UNION ALL
        SELECT a.scan_id, a.n, a.id, a.target, m.source IS NOT NULL, w.new_status,
            CASE WHEN m.source IS NOT NULL THEN a.target ELSE w.new_status END, w.new_score,
            CASE WHEN m.source IS NOT NULL AND a.target = 'Resolved' THEN 0 ELSE w.new_score END
        FROM walk w JOIN asked a ON a.scan_id = w.scan_id AND a.n = w.n + 1
        LEFT JOIN moves m ON m.source = w.new_status AND m.goal = a.target)
    SELECT * FROM walk WHERE n > 0)
"""
_STEPS = _MACHINE + """SELECT id, scan_id, target, accepted, old_status, new_status, old_score, new_score,
    CASE WHEN NOT accepted THEN CONCAT('Transition from ''', old_status, ''' to ''', target,
        ''' is not allowed') END AS reason FROM walk"""
_MACHINE_COLUMNS = ["id", "scan_id", "target", "accepted", "old_status", "new_status",
                    "old_score", "new_score", "reason"]


def _safe_scans(requests):
    return requests.select(F.col("scan_id").alias("id")).distinct().select(
        "id", F.lit("Safe").alias("lifecycle_status"), F.lit(20).alias("risk_score"))


@query("t2_lifecycle_batch", _STEPS)
def t2_batch(spark, sf):
    requests = A.transition_requests(spark, sf)
    return lifecycle.run_lifecycle(requests, _safe_scans(requests)).select(*_MACHINE_COLUMNS)


@query("t2_lifecycle_stream", _STEPS)
def t2_stream(spark, sf):
    return run_lifecycle_stream(
        A.stream(spark, sf, "events", A._TRANSITION_REQUESTS),
        _safe_scans(A.transition_requests(spark, sf)), new_folder(spark, "lifecycle")).select(
        *_MACHINE_COLUMNS)


_FEED = given("audit_logs") + """
, events_of AS (SELECT *, CASE action WHEN 'scan_created' THEN 'scan_completed'
    WHEN 'lifecycle_transition' THEN 'lifecycle_changed' WHEN 'manual_score_override' THEN 'score_updated'
    WHEN 'vulnerability_status_changed' THEN 'vulnerability_status_changed' END AS event FROM audit_logs),
named AS (SELECT *, 'audit_log_created' AS event_name FROM events_of
    UNION ALL SELECT *, event FROM events_of WHERE event IS NOT NULL)
SELECT id AS audit_id, event_name, CONCAT('{"id":', id, ',"scanId":"', scan_id, '","action":"', action,
    '","performedBy":"', performed_by, '"}') AS payload FROM named"""


@query("t1_event_feed", _FEED)
def t1(spark, sf):
    folder = new_folder(spark, "feed")
    run_to_end(
        event_feed(A.stream(spark, sf, "events", A._AUDIT_LOGS)), f"{folder}/events",
        f"{folder}/state", form="json")
    schema = "audit_id BIGINT, event_name STRING, payload STRING, timestamp TIMESTAMP_NTZ"
    return spark.read.schema(schema).json(f"{folder}/events").select(
        "audit_id", "event_name", "payload")


# ---- deletes, updates, checks ----------------------------------------------------------

_FOUR = ("scans", "vulnerabilities", "score_history", "audit_logs")


def _four(spark, sf):
    return {name: getattr(A, name)(spark, sf) for name in _FOUR}


@query("j5_cascade_delete", given(*_FOUR) + """
, gone AS (SELECT id FROM scans WHERE lifecycle_status = 'Resolved')
SELECT 'scans' AS part, id FROM scans WHERE id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'vulnerabilities', id FROM vulnerabilities WHERE scan_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'score_history', CAST(id AS VARCHAR) FROM score_history
    WHERE scan_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'audit_logs', CAST(id AS VARCHAR) FROM audit_logs WHERE scan_id NOT IN (SELECT id FROM gone)
UNION ALL SELECT 'new audit', CONCAT('Scan ', id, ' deleted by admin') FROM gone""")
def j5(spark, sf):
    tables = _four(spark, sf)
    ids = tables["scans"].filter("lifecycle_status = 'Resolved'").select(F.col("id").alias("scan_id"))
    at = F.lit("2026-01-02 03:04:05").cast("timestamp_ntz")
    audit = maintain.deletion_audit(ids, "1", at).filter("id IS NOT NULL").select(
        F.lit("new audit").alias("part"), F.col("details").alias("id"))
    for name, rest in maintain.without_scans(tables, ids).items():
        audit = audit.unionByName(
            rest.select(F.lit(name).alias("part"), F.col("id").cast("string").alias("id")))
    return audit


@query("j6_orphans", given(*_FOUR, "users") + """
, people AS (SELECT id FROM users WHERE role <> 'admin'),
active AS (SELECT id FROM scans WHERE lifecycle_status <> 'Resolved')
SELECT 'scans' AS child, id, user_id AS missing FROM scans WHERE user_id NOT IN (SELECT id FROM people)
UNION ALL SELECT 'vulnerabilities', id, scan_id FROM vulnerabilities WHERE scan_id NOT IN (SELECT id FROM active)
UNION ALL SELECT 'score_history', CAST(id AS VARCHAR), scan_id FROM score_history
    WHERE scan_id NOT IN (SELECT id FROM active)""")
def j6(spark, sf):
    """What a delete of admins and of resolved scans would leave without a parent."""
    t, users = _four(spark, sf), A.users(spark, sf).filter("role <> 'admin'")
    active = t["scans"].filter("lifecycle_status <> 'Resolved'")
    found = None
    for name, parent, key in (("scans", users, "user_id"), ("vulnerabilities", active, "scan_id"),
                              ("score_history", active, "scan_id")):
        rows = maintain.orphans(t[name], parent, key).select(
            F.lit(name).alias("child"), F.col("id").cast("string").alias("id"),
            F.col(key).alias("missing"))
        found = rows if found is None else found.unionByName(rows)
    return found


@query("j6_repeated_keys", given("users", "vulnerabilities", "scans") + """
SELECT 'users.username' AS key_of, username AS value, count(*) AS rows FROM users GROUP BY username
HAVING count(*) > 1
UNION ALL SELECT 'vulnerabilities.id', id, count(*) FROM vulnerabilities GROUP BY id HAVING count(*) > 1
UNION ALL SELECT 'scans.user_id', user_id, count(*) FROM scans GROUP BY user_id HAVING count(*) > 1""")
def j6_keys(spark, sf):
    names = maintain.repeated_keys(A.users(spark, sf), "username").select(
        F.lit("users.username").alias("key_of"), F.col("username").alias("value"), "rows")
    ids = maintain.repeated_keys(A.vulnerabilities(spark, sf), "id").select(
        F.lit("vulnerabilities.id").alias("key_of"), F.col("id").alias("value"), "rows")
    owners = maintain.repeated_keys(A.scans(spark, sf), "user_id").select(
        F.lit("scans.user_id").alias("key_of"), F.col("user_id").alias("value"), "rows")
    return names.unionByName(ids).unionByName(owners)


_NEWS = given("scans", "score_history") + """
, news AS (SELECT scan_id, arg_max(score, (timestamp, id)) AS score, max(timestamp) AS at
    FROM score_history GROUP BY scan_id)
SELECT s.id, s.file_path, COALESCE(n.score, s.risk_score) AS risk_score, COALESCE(n.at, s.updated_at) AS updated_at
FROM scans s LEFT JOIN news n ON s.id = n.scan_id"""


def _news(spark, sf):
    return latest(
        A.score_history(spark, sf), ["scan_id"], [F.col("timestamp").desc(), F.col("id").desc()]
    ).select(F.col("scan_id").alias("id"), F.col("score").alias("risk_score"),
             F.col("timestamp").alias("updated_at"))


@query("j7_keyed_update", _NEWS)
def j7(spark, sf):
    return maintain.updated(A.scans(spark, sf), _news(spark, sf)).select(
        "id", "file_path", "risk_score", "updated_at")


@query("j7_merge_buckets", _NEWS)
def j7_buckets(spark, sf):
    table = BucketedTable(spark, new_folder(spark, "merged"), "id", schemas.SCANS)
    table.create(maintain.fitted(A.scans(spark, sf), schemas.SCANS), buckets=16)
    table.merge(_news(spark, sf), "news")
    return table.rows().select("id", "file_path", "risk_score", "updated_at")


@query("j5_delete_buckets", given("scans", "vulnerabilities") + """
, gone AS (SELECT id FROM scans WHERE lifecycle_status = 'Resolved')
SELECT id, scan_id, category FROM vulnerabilities WHERE scan_id NOT IN (SELECT id FROM gone)""")
def j5_buckets(spark, sf):
    tables = _four(spark, sf)
    table = BucketedTable(
        spark, new_folder(spark, "deleted"), "scan_id", schemas.VULNERABILITIES)
    table.create(maintain.fitted(tables["vulnerabilities"], schemas.VULNERABILITIES), buckets=16)
    table.delete(tables["scans"].filter("lifecycle_status = 'Resolved'").select(
        F.col("id").alias("scan_id")), "resolved")
    return table.rows().select("id", "scan_id", "category")


# ---- stored tables ---------------------------------------------------------------------

@query("s3_read_tables", given(*_FOUR, "users") + """
SELECT 'users' AS part, id, username AS content FROM users
UNION ALL SELECT 'scans', id, file_path FROM scans
UNION ALL SELECT 'vulnerabilities', id, category FROM vulnerabilities
UNION ALL SELECT 'score_history', CAST(id AS VARCHAR), reason FROM score_history
UNION ALL SELECT 'audit_logs', CAST(id AS VARCHAR), action FROM audit_logs""")
def s3(spark, sf):
    folder = new_folder(spark, "tables")
    tables = {**_four(spark, sf), "users": A.users(spark, sf)}
    content = {"users": "username", "scans": "file_path", "vulnerabilities": "category",
               "score_history": "reason", "audit_logs": "action"}
    parts = None
    for name, df in tables.items():
        append(maintain.fitted(df, schemas.TABLES[name]), folder, name, "first")
        rows = read_table(spark, folder, name).select(
            F.lit(name).alias("part"), F.col("id").cast("string").alias("id"),
            F.col(content[name]).alias("content"))
        parts = rows if parts is None else parts.unionByName(rows)
    return parts


@query("s5_audit_of_status_changes", _REPLAY + """
SELECT *, row_number() OVER (ORDER BY timestamp, scan_id, old_status, new_status, severity_level,
    details) AS id
FROM (SELECT scan_id, old_status, status AS new_status, severity AS severity_level,
    'vulnerability_status_changed' AS action, 'admin' AS role,
    CONCAT('Vulnerability ', vuln_id, ' changed from ''', old_status, ''' to ''', status,
    '''. Scan score recalculated to ', score, '.') AS details, timestamp FROM scored)""")
def s5(spark, sf):
    changes = A.status_changes(spark, sf)
    replayed = lifecycle.replay_status_changes(changes, _starting(changes))
    folder = new_folder(spark, "audit")
    append_log(maintain.status_audit(replayed, "1"), folder, "audit_logs", "first")
    return read_table(spark, folder, "audit_logs").select(
        "id", "scan_id", "old_status", "new_status", "severity_level", "action", "role", "details",
        "timestamp")


@query("s6_history_of_moves", _MACHINE + """
SELECT *, row_number() OVER (ORDER BY timestamp, scan_id, score, lifecycle_status, reason) AS id
FROM (SELECT w.scan_id, new_score AS score, new_status AS lifecycle_status, 'admin' AS changed_by,
    CONCAT('Transition from ', old_status, ' to ', new_status) AS reason, r.timestamp
    FROM walk w JOIN transition_requests r ON r.id = w.id WHERE accepted)""")
def s6(spark, sf):
    requests = A.transition_requests(spark, sf)
    steps = lifecycle.run_lifecycle(requests, _safe_scans(requests))
    folder = new_folder(spark, "history")
    append_log(maintain.move_history(steps, "admin"), folder, "score_history", "first")
    return read_table(spark, folder, "score_history").select(*schemas.SCORE_HISTORY.names)


@query("f20_running_numbers", given("score_history") + """
, halves AS (SELECT *, id % 2 AS half FROM score_history)
SELECT row_number() OVER (PARTITION BY half ORDER BY timestamp NULLS FIRST, scan_id NULLS FIRST,
        score NULLS FIRST, id)
    + half * (SELECT count(*) FROM halves WHERE half = 0) AS id,
    scan_id, score, timestamp FROM halves""")
def f20_numbers(spark, sf):
    """Two parts; the first is written again after the second."""
    folder = new_folder(spark, "numbers")
    given_rows = A.score_history(spark, sf).select("id", "scan_id", "score", "timestamp")
    rows = maintain.fitted(given_rows, schemas.SCORE_HISTORY)
    for half in (0, 1, 0):
        append_log(rows.filter(F.col("id") % 2 == half), folder, "score_history", f"half{half}")
    return read_table(spark, folder, "score_history").select("id", "scan_id", "score", "timestamp")


@query("s6_manual_overrides", given("scans", "score_history") + """
SELECT h.scan_id, h.score, CASE WHEN h.score = 0 THEN 'Resolved' WHEN h.score <= 24 THEN 'Warning'
    WHEN h.score <= 49 THEN 'Vulnerable' ELSE 'Critical' END AS lifecycle_status,
    CONCAT('Score manually changed from ', COALESCE(lag(h.score) OVER (PARTITION BY h.scan_id
        ORDER BY h.timestamp, h.id), s.risk_score), ' to ', h.score) AS details, h.timestamp
FROM score_history h JOIN scans s ON h.scan_id = s.id""")
def s6_overrides(spark, sf):
    asked = A.score_history(spark, sf).select("id", "scan_id", "score", "timestamp")
    done = lifecycle.score_overrides(A.scans(spark, sf), asked)
    return maintain.override_audit(done, "1").select(
        "scan_id", F.col("new_score").alias("score"), F.col("new_status").alias("lifecycle_status"),
        "details", "timestamp")


# ---- whole jobs --------------------------------------------------------------------------

def _parts(frames, content):
    """part, key and content of every changed table."""
    parts = [frames[name].select(
        F.lit(name).alias("part"), F.col(key).cast("string").alias("key"),
        F.concat_ws("|", *[F.col(c).cast("string") for c in columns]).alias("content"))
        for name, (key, columns) in content.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


@query("s6_override_job", given("scans", "score_history") + """
, done AS (SELECT h.id, h.scan_id, h.score, h.timestamp, CASE WHEN h.score = 0 THEN 'Resolved'
        WHEN h.score <= 24 THEN 'Warning' WHEN h.score <= 49 THEN 'Vulnerable' ELSE 'Critical' END AS status,
    COALESCE(lag(h.score) OVER w, s.risk_score) AS old_score, s.lifecycle_status
    FROM score_history h JOIN scans s ON h.scan_id = s.id
    WINDOW w AS (PARTITION BY h.scan_id ORDER BY h.timestamp, h.id)),
chained AS (SELECT *, COALESCE(lag(status) OVER (PARTITION BY scan_id ORDER BY timestamp, id),
    lifecycle_status) AS old_status FROM done),
last AS (SELECT scan_id, arg_max(score, (timestamp, id)) AS score, arg_max(status, (timestamp, id)) AS status
    FROM done GROUP BY scan_id)
SELECT 'scans' AS part, s.id AS key, CONCAT_WS('|', file_path, COALESCE(l.score, risk_score),
    COALESCE(l.status, lifecycle_status)) AS content FROM scans s LEFT JOIN last l ON l.scan_id = s.id
UNION ALL SELECT 'score_history', scan_id, CONCAT_WS('|', score, status, '1', 'Manual score override') FROM done
UNION ALL SELECT 'audit_logs', scan_id, CONCAT_WS('|', 'manual_score_override', 'admin', old_score, score,
    old_status, status, CONCAT('Score manually changed from ', old_score, ' to ', score)) FROM chained""")
def s6_job(spark, sf):
    asked = A.score_history(spark, sf).select("id", "scan_id", "score", "timestamp")
    return _parts(changes.override_scores(A.scans(spark, sf), asked, "1"), {
        "scans": ("id", ["file_path", "risk_score", "lifecycle_status"]),
        "score_history": ("scan_id", ["score", "lifecycle_status", "changed_by", "reason"]),
        "audit_logs": ("scan_id", ["action", "role", "old_score", "new_score", "old_status",
                                   "new_status", "details"])})


@query("t2_move_job", _MACHINE + """
, last AS (SELECT scan_id, arg_max(new_status, n) AS status, arg_max(new_score, n) AS score
    FROM walk WHERE accepted GROUP BY scan_id),
all_scans AS (SELECT DISTINCT scan_id FROM transition_requests)
SELECT 'scans' AS part, a.scan_id AS key, CONCAT_WS('|', COALESCE(score, 20), COALESCE(status, 'Safe')) AS content
FROM all_scans a LEFT JOIN last l ON l.scan_id = a.scan_id
UNION ALL SELECT 'score_history', scan_id, CONCAT_WS('|', new_score, new_status, 'admin',
    CONCAT('Transition from ', old_status, ' to ', new_status)) FROM walk WHERE accepted
UNION ALL SELECT 'audit_logs', scan_id, CONCAT_WS('|', 'lifecycle_transition', 'admin', old_score, new_score,
    old_status, new_status) FROM walk WHERE accepted""")
def t2_job(spark, sf):
    requests = A.transition_requests(spark, sf)
    scans = _safe_scans(requests).withColumn("updated_at", F.lit(None).cast("timestamp_ntz"))
    return _parts(changes.move_scans(scans, requests, "admin", "admin"), {
        "scans": ("id", ["risk_score", "lifecycle_status"]),
        "score_history": ("scan_id", ["score", "lifecycle_status", "changed_by", "reason"]),
        "audit_logs": ("scan_id", ["action", "role", "old_score", "new_score", "old_status",
                                   "new_status"])})


@query("w6_status_job", _REPLAY + f"""
, replayed AS (SELECT *, CASE WHEN score = 0 THEN 'Resolved' ELSE {lifecycle_sql('score')} END AS lifecycle
    FROM scored),
last_scan AS (SELECT scan_id, arg_max(score, (timestamp, id)) AS score,
    arg_max(lifecycle, (timestamp, id)) AS lifecycle FROM replayed GROUP BY scan_id),
last_finding AS (SELECT vuln_id, scan_id, arg_max(status, (timestamp, id)) AS status
    FROM status_changes GROUP BY vuln_id, scan_id)
SELECT 'scans' AS part, scan_id AS key, CONCAT_WS('|', score, lifecycle) AS content FROM last_scan
UNION ALL SELECT 'vulnerabilities', vuln_id, status FROM last_finding
UNION ALL SELECT 'score_history', scan_id, CONCAT_WS('|', score, lifecycle, '1', CONCAT('Vulnerability ', vuln_id,
    ' status changed: ', old_status, ' → ', status)) FROM replayed
UNION ALL SELECT 'audit_logs', scan_id, CONCAT_WS('|', 'vulnerability_status_changed', 'admin', old_status,
    status, status, severity) FROM replayed""")
def w6_job(spark, sf):
    asked = A.status_changes(spark, sf)
    findings = _starting(asked).withColumnRenamed("vuln_id", "id")
    scans = asked.select(F.col("scan_id").alias("id")).distinct().select(
        "id", F.lit("Safe").alias("lifecycle_status"), F.lit(0).alias("risk_score"))
    return _parts(changes.change_finding_statuses(scans, findings, asked, "1"), {
        "scans": ("id", ["risk_score", "lifecycle_status"]),
        "vulnerabilities": ("id", ["status"]),
        "score_history": ("scan_id", ["score", "lifecycle_status", "changed_by", "reason"]),
        "audit_logs": ("scan_id", ["action", "role", "old_status", "new_status",
                                   "vulnerability_status", "severity_level"])})


@query("s8_report_tables", given("scans") + """
SELECT id, CONCAT('security_report_', replace(split_part(file_path, '/', 2), '.', '_'), '_',
    strftime(created_at, '%Y%m%d_%H%M%S')) AS report_key, CAST(created_at AS DATE) AS report_date,
    CAST(date_trunc('month', created_at) AS DATE) AS report_month FROM scans""")
def s8(spark, sf):
    folder = new_folder(spark, "reports")
    rows = reports.report_rows(A.scans(spark, sf), F.col("created_at"))
    monthly = rows.withColumn("report_month", F.trunc("report_date", "month"))
    for _ in range(2):  # a run that is started again leaves no copies
        write_reports(monthly, folder, "first", "report_month")
    return spark.read.parquet(folder).select("id", "report_key", "report_date", "report_month")


# ---- answers ---------------------------------------------------------------------------

@query("f13_json_of_answers", given("llm_responses") + """
, blocks AS (SELECT file_id, regexp_extract(raw, '(?s)\\{.*\\}', 0) AS block FROM llm_responses)
SELECT file_id, block, json_extract_string(NULLIF(block, ''), '$.overall_risk_level') AS level
FROM blocks""")
def f13(spark, sf):
    parsed = answers.parsed_answers(A.llm_responses(spark, sf))
    return parsed.select(
        "file_id", answers.json_block(F.col("raw")).alias("block"),
        F.col("answer.overall_risk_level").alias("level"))


@query("f14_answers_with_defaults", given("llm_responses") + """
, read AS (SELECT file_id, raw LIKE '%{%' AS good,
    NULLIF(regexp_extract(raw, '(?s)\\{.*\\}', 0), '') AS block FROM llm_responses)
SELECT file_id, NOT good AS analysis_failed, CAST(CASE WHEN good THEN 70 ELSE 50 END AS INT) AS overall_risk_score,
    CASE WHEN good THEN json_extract_string(block, '$.overall_risk_level') ELSE 'Warning' END AS overall_risk_level,
    CASE WHEN good THEN 'Audit finished.' ELSE 'Analysis Error: AI response contained no valid JSON block.' END
        AS executive_summary,
    json_extract_string(block, '$.analyzed_vulnerabilities[0].category') AS category,
    CAST(json_extract_string(block, '$.analyzed_vulnerabilities[0].line_number') AS INT) AS line_number,
    CASE WHEN good THEN 'Review code' END AS line_content, CASE WHEN good THEN 'High' END AS severity,
    CASE WHEN good THEN 'AI-VULN' END AS vuln_id FROM read""")
def f14(spark, sf):
    full = answers.answers_with_defaults(A.llm_responses(spark, sf))
    first = F.get("findings", F.lit(0))
    return full.select(
        "file_id", "analysis_failed", "overall_risk_score", "overall_risk_level",
        "executive_summary", *[first[c].alias(c) for c in (
            "category", "line_number", "line_content", "severity", "vuln_id")])


@query("f14_answer_findings", given("llm_responses") + """
SELECT file_id, 0 AS source_order, event_category AS category FROM (
    SELECT file_id, json_extract_string(NULLIF(regexp_extract(raw, '(?s)\\{.*\\}', 0), ''),
        '$.analyzed_vulnerabilities[0].category') AS event_category FROM llm_responses)
WHERE event_category IS NOT NULL""")
def f14_rows(spark, sf):
    full = answers.answers_with_defaults(A.llm_responses(spark, sf))
    return answers.answer_findings(full, "file_id").select("file_id", "source_order", "category")


@query("a5_answered_profiles", given("llm_responses") + """
SELECT file_id, raw NOT LIKE '%{%' AS analysis_failed, CASE WHEN raw LIKE '%{%' THEN 1 ELSE 0 END AS high,
    CASE WHEN raw LIKE '%{%' THEN 41 ELSE 0 END AS risk_score,
    CASE WHEN raw LIKE '%{%' THEN 'Medium' ELSE 'Low' END AS risk_level,
    CASE WHEN raw LIKE '%{%' THEN 'Warning' ELSE 'Safe' END AS lifecycle_status FROM llm_responses""")
def a5_answered(spark, sf):
    return answered_profiles(A.llm_responses(spark, sf), "file_id").select(
        "file_id", "analysis_failed", "high", "risk_score", "risk_level", "lifecycle_status")


@query("s7_read_answers", given("llm_responses") + """
SELECT raw, count(*) AS answers FROM llm_responses GROUP BY raw""")
def s7(spark, sf):
    folder = new_folder(spark, "answers")
    A.llm_responses(spark, sf).select(F.col("raw").alias("value")).write.text(folder)
    lines = read_answers(spark, folder).select(F.explode(F.split("raw", "\n")).alias("raw"))
    return lines.filter("raw <> ''").groupBy("raw").agg(F.count("*").alias("answers"))
