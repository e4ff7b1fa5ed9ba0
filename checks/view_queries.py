"""Projections, filters, joins, dashboard, pages and series."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import adapters as A
from checks.pieces import lifecycle_sql
from checks.registry import given, query
from seclake.functions import texts
from seclake.operators import views
from seclake.plans.stored_dashboard import stored_dashboard
from seclake.session import new_folder
from seclake.sources.tables import append

_SCAN_COLUMNS = """id AS "scanId", file_path AS "filePath", language, mode, risk_score AS "riskScore",
    risk_level AS "riskLevel", lifecycle_status AS "lifecycleStatus", created_at AS "createdAt",
    updated_at AS "updatedAt", user_id AS "userId",
    replace(COALESCE(report_path, ''), chr(92), '/') AS "reportPath", executive_summary AS "executiveSummary" """


@query("p1_camel_case_scans", given("scans") + f"SELECT {_SCAN_COLUMNS} FROM scans")
def p1(spark, sf):
    return views.scan_view(A.scans(spark, sf))


@query("p2_users_without_secrets", given("users") + "SELECT id, username, role FROM users")
def p2(spark, sf):
    return views.without_secrets(A.users(spark, sf))


@query("p3_lookup_by_id", given("scans", "audit_logs") + """
SELECT a.id AS asked_id, s.id IS NOT NULL AS found, s.file_path, s.risk_score
FROM (SELECT DISTINCT scan_id AS id FROM audit_logs) a LEFT JOIN scans s ON a.id = s.id""")
def p3(spark, sf):
    asked = A.audit_logs(spark, sf).select(F.col("scan_id").alias("id"))
    return views.by_ids(A.scans(spark, sf), asked).select(
        "asked_id", "found", "file_path", "risk_score")


@query("p4_optional_filters", given("audit_logs") + """
SELECT id, scan_id, action, performed_by FROM audit_logs
WHERE action = 'scan_created' AND performed_by = 'system'""")
def p4(spark, sf):
    return views.matching(
        A.audit_logs(spark, sf), scan_id=None, action="scan_created", performed_by="system"
    ).select("id", "scan_id", "action", "performed_by")


@query("p5_visible_rows", given("scans", "users") + """
SELECT u.id AS viewer_id, s.id AS scan_id FROM users u JOIN scans s ON s.user_id = u.id
WHERE u.role <> 'admin'""")
def p5(spark, sf):
    return views.own_rows(A.scans(spark, sf), "user_id", A.users(spark, sf)).select(
        "viewer_id", F.col("id").alias("scan_id"))


@query("p5_one_viewer", given("scans") + """
SELECT 'admin' AS viewer, id FROM scans UNION ALL SELECT 'admin, user 7', id FROM scans WHERE user_id = '7'
UNION ALL SELECT 'user 7', id FROM scans WHERE user_id = '7'""")
def p5_viewer(spark, sf):
    scans = A.scans(spark, sf)
    seen = [("admin", "1", "admin", None), ("admin, user 7", "1", "admin", "7"),
            ("user 7", "7", "user", "8")]
    parts = [views.visible_to(scans, "user_id", user, role, wanted).select(
        F.lit(name).alias("viewer"), "id") for name, user, role, wanted in seen]
    return parts[0].union(parts[1]).union(parts[2])


@query("p7_open_findings", given("vulnerabilities") + """
SELECT id, status FROM vulnerabilities WHERE status NOT IN ('fixed', 'accepted')""")
def p7(spark, sf):
    return views.open_findings(A.vulnerabilities(spark, sf)).select("id", "status")


@query("p8_scanned_paths", given("scans") + """
SELECT id, file_path FROM scans
WHERE suffix(file_path, '.py') OR suffix(file_path, '.js') OR suffix(file_path, '.cpp')""")
def p8(spark, sf):
    return A.scans(spark, sf).filter(texts.is_scanned_path(F.col("file_path"))).select("id", "file_path")


@query("p10_checked_requests", given("transition_requests") + """
SELECT id, target IN ('Safe', 'Warning', 'Vulnerable', 'Critical', 'Resolved') AS valid,
    CASE WHEN target NOT IN ('Safe', 'Warning', 'Vulnerable', 'Critical', 'Resolved') THEN
    'Invalid status. Must be one of: Safe, Warning, Vulnerable, Critical, Resolved' END AS reason
FROM transition_requests""")
def p10(spark, sf):
    asked = A.transition_requests(spark, sf).withColumnRenamed("target", "lifecycle_status")
    return views.checked(asked).select("id", "valid", "reason")


@query("p10_checked_modes", given("scans", "vulnerabilities") + """
, asked AS (SELECT 'mode' AS field, id, mode AS value FROM scans
    UNION ALL SELECT 'mode', id, lifecycle_status FROM scans
    UNION ALL SELECT 'status', id, status FROM vulnerabilities
    UNION ALL SELECT 'status', id, severity FROM vulnerabilities)
SELECT field, id, value, CASE WHEN field = 'mode' THEN coalesce(value IN ('paste', 'upload', 'github'), false)
    ELSE coalesce(value IN ('open', 'mitigated', 'resolved', 'fixed', 'accepted'), false) END AS valid
FROM asked""")
def p10_modes(spark, sf):
    scans, found = A.scans(spark, sf), A.vulnerabilities(spark, sf)

    def rows(df, field, value):
        return views.checked(df.select(F.col("id").cast("string").alias("id"), F.col(value).alias(
            field))).select(F.lit(field).alias("field"), "id", F.col(field).alias("value"), "valid")

    return rows(scans, "mode", "mode").union(rows(scans, "mode", "lifecycle_status")).union(
        rows(found, "status", "status")).union(rows(found, "status", "severity"))


@query("p10_checked_scores", """
SELECT event_id AS id, CAST(floor(value) AS INT) AS score, floor(value) BETWEEN 0 AND 100 AS valid
FROM events""")
def p10_scores(spark, sf):
    asked = A.read(spark, sf, "events").select(
        F.col("event_id").alias("id"), F.floor("value").cast("int").alias("score"))
    return views.checked(asked).select("id", "score", "valid")


@query("j2_audit_with_performer", given("audit_logs", "users") + """
SELECT a.id, a.action, a.performed_by, u.username AS performer_name
FROM audit_logs a LEFT JOIN users u ON a.performed_by = u.id""")
def j2(spark, sf):
    return views.with_performer(A.audit_logs(spark, sf), A.users(spark, sf)).select(
        "id", "action", "performed_by", "performer_name")


@query("j3_severities_by_user", given("scans", "vulnerabilities") + """
, per_user AS (SELECT s.user_id, v.severity, count(*) AS n FROM vulnerabilities v
    JOIN scans s ON v.scan_id = s.id GROUP BY s.user_id, v.severity)
SELECT u.user_id, l.severity, COALESCE(p.n, 0) AS findings
FROM (SELECT DISTINCT user_id FROM per_user) u
CROSS JOIN (VALUES ('Critical'), ('High'), ('Medium'), ('Low')) l(severity)
LEFT JOIN per_user p ON p.user_id = u.user_id AND p.severity = l.severity""")
def j3(spark, sf):
    return views.severities_by_user(A.vulnerabilities(spark, sf), A.scans(spark, sf))


@query("j4_scan_details", given("scans", "vulnerabilities") + """
SELECT s.id, s.risk_score, CASE WHEN v.id IS NOT NULL THEN row_number() OVER (PARTITION BY s.id
    ORDER BY v.id, v.severity) - 1 END AS position, v.id AS finding, v.severity
FROM scans s LEFT JOIN vulnerabilities v ON v.scan_id = s.id""")
def j4(spark, sf):
    found = A.vulnerabilities(spark, sf)
    details = views.scan_details(A.scans(spark, sf), found)
    return details.select("id", "risk_score", "position", F.col("finding.id").alias("finding"),
                          F.col("finding.severity").alias("severity"))


# ---- dashboard -------------------------------------------------------------------------

@query("a6_dashboard_totals", given("scans") + """
SELECT count(*) AS total_scans, count(*) FILTER (WHERE lifecycle_status <> 'Resolved') AS active_scans,
    count(*) FILTER (WHERE lifecycle_status = 'Resolved') AS resolved_scans,
    CAST(floor(avg(risk_score)) AS INT) AS average_score FROM scans""")
def a6(spark, sf):
    return views.dashboard_totals(A.scans(spark, sf))


@query("a7_scans_by_status", given("scans") + """
SELECT l.place, l.lifecycle_status, count(s.id) AS count
FROM (VALUES (0, 'Safe'), (1, 'Warning'), (2, 'Vulnerable'), (3, 'Critical'), (4, 'Resolved'))
    l(place, lifecycle_status)
LEFT JOIN scans s ON s.lifecycle_status = l.lifecycle_status GROUP BY ALL""")
def a7(spark, sf):
    return views.scans_by_status(A.scans(spark, sf))


@query("a8_findings_by_severity", given("vulnerabilities") + """
SELECT l.severity, count(v.id) AS count FROM (VALUES ('Critical'), ('High'), ('Medium'), ('Low')) l(severity)
LEFT JOIN vulnerabilities v ON v.severity = l.severity GROUP BY l.severity""")
def a8(spark, sf):
    return views.findings_by_severity(A.vulnerabilities(spark, sf))


@query("a6_dashboard_of_parts", given("scans", "vulnerabilities") + """
SELECT 'totals' AS section, 'total_scans' AS name, count(*) AS count FROM scans
UNION ALL SELECT 'totals', 'active_scans', count(*) FROM scans WHERE lifecycle_status <> 'Resolved'
UNION ALL SELECT 'totals', 'resolved_scans', count(*) FROM scans WHERE lifecycle_status = 'Resolved'
UNION ALL SELECT 'totals', 'average_score', CAST(floor(avg(risk_score)) AS BIGINT) FROM scans
UNION ALL SELECT 'statuses', l.lifecycle_status, count(s.id)
FROM (VALUES ('Safe'), ('Warning'), ('Vulnerable'), ('Critical'), ('Resolved')) l(lifecycle_status)
LEFT JOIN scans s ON s.lifecycle_status = l.lifecycle_status GROUP BY ALL
UNION ALL SELECT 'severities', l.severity, count(v.id)
FROM (VALUES ('Critical'), ('High'), ('Medium'), ('Low')) l(severity)
LEFT JOIN vulnerabilities v ON v.severity = l.severity GROUP BY ALL
UNION ALL SELECT 'recent', id, CAST(risk_score AS BIGINT) FROM
    (SELECT * FROM scans ORDER BY created_at DESC, id LIMIT 10)""")
def a6_parts(spark, sf):
    """Parts by user; one is first stored without its resolved scans and counted so."""
    folder = new_folder(spark, "dashboard")
    scans, found = A.scans(spark, sf), A.vulnerabilities(spark, sf)
    part = F.pmod(F.xxhash64("user_id"), F.lit(3))
    append(scans.filter((part == 0) & (F.col("lifecycle_status") != "Resolved")), folder, "scans", "a")
    append(found, folder, "vulnerabilities", "a")
    stored_dashboard(spark, folder)
    for i, run in enumerate(("a", "b 1+2 %", "1")):
        append(scans.filter(part == i), folder, "scans", run)
    got = stored_dashboard(spark, folder)
    totals = got["totals"].select(F.lit("totals").alias("section"), F.posexplode(F.array(
        *[F.col(c).cast("long") for c in got["totals"].columns])).alias("at", "count")).select(
        "section", F.element_at(F.array(*[F.lit(c) for c in got["totals"].columns]),
                                F.col("at") + 1).alias("name"), "count")
    return totals.unionByName(got["statuses"].select(
        F.lit("statuses").alias("section"), F.col("lifecycle_status").alias("name"), "count")).unionByName(
        got["severities"].select(
            F.lit("severities").alias("section"), F.col("severity").alias("name"), "count")).unionByName(
        got["recent"].select(F.lit("recent").alias("section"), F.col("id").alias("name"),
                             F.col("riskScore").cast("long").alias("count")))


@query("a14_row_counts", given("scans", "audit_logs") + """
SELECT 'scans' AS rows_of, count(*) AS n FROM scans
UNION ALL SELECT 'audit_logs', count(*) FROM audit_logs WHERE action = 'scan_created'""")
def a14(spark, sf):
    audit = views.matching(A.audit_logs(spark, sf), action="scan_created")
    return A.scans(spark, sf).agg(F.lit("scans").alias("rows_of"), F.count("*").alias("n")).unionByName(
        audit.agg(F.lit("audit_logs").alias("rows_of"), F.count("*").alias("n")))


@query("o1_recent_scans", given("scans") + """
SELECT id, file_path AS "filePath", risk_score AS "riskScore", lifecycle_status AS "lifecycleStatus",
    created_at AS "createdAt" FROM scans ORDER BY created_at DESC, id LIMIT 10""")
def o1(spark, sf):
    return views.recent_scans(A.scans(spark, sf))


@query("o2_scan_page", given("scans") +
       f"SELECT {_SCAN_COLUMNS} FROM scans ORDER BY created_at DESC, id LIMIT 100 OFFSET 200")
def o2(spark, sf):
    return views.page_of_scans(A.scans(spark, sf), page=3, per_page=500)


@query("o2_scan_page_counters", given("scans") + """
SELECT 3 AS page, 100 AS per_page, count(*) AS total_items,
    CAST(greatest(1, ceil(count(*) / 100.0)) AS BIGINT) AS total_pages,
    3 < greatest(1, ceil(count(*) / 100.0)) AS has_next, true AS has_previous FROM scans""")
def o2_counters(spark, sf):
    return views.scan_page_counters(A.scans(spark, sf), page=3, per_page=500)


@query("o3_audit_page", given("audit_logs", "users") + """
SELECT a.id, a.scan_id AS "scanId", a.action, a.performed_by AS "performedBy", a.timestamp,
    u.username AS "performerName"
FROM (SELECT * FROM audit_logs ORDER BY timestamp DESC, id LIMIT 250 OFFSET 250) a
LEFT JOIN users u ON a.performed_by = u.id""")
def o3(spark, sf):
    return views.page_of_audit(A.audit_logs(spark, sf), A.users(spark, sf), page=2, per_page=250)


@query("o3_audit_page_counters", given("audit_logs") + """
SELECT count(*) AS total, 2 AS page, 250 AS per_page,
    CAST(greatest(1, ceil(count(*) / 250.0)) AS BIGINT) AS total_pages FROM audit_logs""")
def o3_counters(spark, sf):
    return views.audit_page_counters(A.audit_logs(spark, sf), page=2, per_page=250)


@query("o4_history_in_order", given("score_history") + """
SELECT scan_id, id, score, row_number() OVER (PARTITION BY scan_id ORDER BY timestamp, id) - 1 AS position
FROM score_history""")
def o4(spark, sf):
    return views.history_in_order(A.score_history(spark, sf)).select("scan_id", "id", "score", "position")


@query("o4_scan_logs_in_order", given("audit_logs") + """
SELECT scan_id, id, action, row_number() OVER (PARTITION BY scan_id ORDER BY timestamp, id) - 1 AS position
FROM audit_logs""")
def o4_logs(spark, sf):
    return views.history_in_order(A.audit_logs(spark, sf)).select("scan_id", "id", "action", "position")


@query("o5_findings_by_severity_text", given("vulnerabilities") + """
SELECT scan_id, id, severity,
    row_number() OVER (PARTITION BY scan_id ORDER BY severity, created_at, id) - 1 AS position
FROM vulnerabilities""")
def o5(spark, sf):
    return views.findings_by_severity_text(A.vulnerabilities(spark, sf)).select(
        "scan_id", "id", "severity", "position")


# ---- series ----------------------------------------------------------------------------

_STATUS = f"COALESCE(lifecycle_status, {lifecycle_sql('score')})"


@query("w1_score_progression", given("score_history") + f"""
SELECT scan_id, row_number() OVER (PARTITION BY scan_id ORDER BY timestamp, id) - 1 AS x, score AS y,
    COALESCE(reason, '') AS label, {_STATUS} AS status, timestamp FROM score_history""")
def w1(spark, sf):
    return views.progression(A.score_history(spark, sf))


@query("w4_latest_state", given("score_history") + """
SELECT scan_id, arg_max(id, (timestamp, id)) AS id, arg_max(score, (timestamp, id)) AS score
FROM score_history GROUP BY scan_id""")
def w4(spark, sf):
    return views.latest_state(A.score_history(spark, sf)).select("scan_id", "id", "score")


@query("a9_progression_metadata", given("score_history", "scans") + f"""
, rolled AS (SELECT scan_id, count(*) AS points, min(score) AS least, max(score) AS most,
    arg_max(score, (timestamp, id)) AS score, arg_max(COALESCE(lifecycle_status, ''), (timestamp, id)) AS last
    FROM score_history GROUP BY scan_id)
SELECT s.id AS scan_id, COALESCE(points, 0) AS total_data_points, COALESCE(least, 0) AS min_score,
    COALESCE(most, 0) AS max_score, COALESCE(score, 0) AS current_score,
    CASE WHEN points IS NULL THEN 'Safe' WHEN last <> '' THEN last ELSE {lifecycle_sql('score')} END
        AS current_status
FROM scans s LEFT JOIN rolled r ON s.id = r.scan_id""")
def a9(spark, sf):
    return views.progression_metadata(A.score_history(spark, sf), A.scans(spark, sf))


# ---- text functions ----------------------------------------------------------------------

@query("f8_owasp_prefix", given("vulnerabilities") + """
SELECT id, split_part(owasp_category, ' - ', 1) AS owasp FROM vulnerabilities""")
def f8(spark, sf):
    return A.vulnerabilities(spark, sf).select(
        "id", texts.owasp_prefix(F.col("owasp_category")).alias("owasp"))


@query("f9_prefixed_category", given("scans") + """
SELECT id, CONCAT('[', split_part(file_path, '/', 2), '] ', executive_summary) AS category FROM scans""")
def f9(spark, sf):
    return A.scans(spark, sf).select("id", texts.prefixed_category(
        F.col("file_path"), F.col("executive_summary")).alias("category"))


@query("f10_normal_paths", given("scans") + """
SELECT id, replace(COALESCE(report_path, ''), chr(92), '/') AS path FROM scans""")
def f10(spark, sf):
    return A.scans(spark, sf).select("id", texts.normal_path(F.col("report_path")).alias("path"))


@query("f11_report_keys", given("scans") + """
SELECT id, regexp_extract(file_path, '(\\.[^./]*)$', 1) AS extension,
    regexp_replace(split_part(file_path, '/', 2), '(\\.[^./]*)$', '_secure\\1') AS secure_name,
    CONCAT('security_report_', replace(split_part(file_path, '/', 2), '.', '_'), '_',
        strftime(created_at, '%Y%m%d_%H%M%S')) AS report_key FROM scans""")
def f11(spark, sf):
    path = F.col("file_path")
    return A.scans(spark, sf).select(
        "id", texts.extension(path).alias("extension"), texts.secure_name(path).alias("secure_name"),
        texts.report_key(path, F.col("created_at")).alias("report_key"))


@query("f16_messages", given("scans") + """
SELECT id, CONCAT('Scan completed — score ', risk_score, ' (', risk_level, ')') AS details,
    CONCAT('Transition from ', lifecycle_status, ' to Resolved') AS reason FROM scans""")
def f16(spark, sf):
    from seclake.fixed_values import MOVE_REASON, SCAN_DETAILS
    return A.scans(spark, sf).select(
        "id",
        texts.message(SCAN_DETAILS, F.col("risk_score"), F.col("risk_level")).alias("details"),
        texts.message(MOVE_REASON, F.col("lifecycle_status"), F.lit("Resolved")).alias("reason"))


@query("f19_iso_times", """
SELECT event_id AS id, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS iso, epoch_us(ts) AS micros,
    epoch_us(ts) AS micros_of_offset FROM events""")
def f19(spark, sf):
    events = A.read(spark, sf, "events").withColumn("iso", texts.iso_text(F.col("ts")))
    offset = F.concat(F.substring("iso", F.lit(1), F.length("iso") - 1), F.lit("+00:00"))
    return events.select(
        F.col("event_id").alias("id"), "iso", texts.micros_of_iso(F.col("iso")).alias("micros"),
        texts.micros_of_iso(offset).alias("micros_of_offset"))


@query("f20_stable_ids", given("scans") + """
SELECT id, sha256(CAST(to_json([file_path, user_id]) AS VARCHAR)) AS stable_id FROM scans""")
def f20(spark, sf):
    return A.scans(spark, sf).select(
        "id", texts.stable_id(F.col("file_path"), F.col("user_id")).alias("stable_id"))
