"""Counts, scores, profiles, rollups and their orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import adapters as A
from checks.pieces import (
    COUNTS, LINES, RAW, SCAN, TREND, WEIGHT_ALL, level_sql, lifecycle_sql, lines_sql, score_sql)
from checks.registry import given, query
from seclake.functions import scores
from seclake.operators import reports, risk, scanning, views
from seclake.plans.file_scan import files_by_risk, repositories_by_risk

_CONFIRMED = "false_positive_likelihood IS DISTINCT FROM 'HIGH'"
_NUMBERS = ["critical", "high", "medium", "low", "total"]
_SCORED = f"""
SELECT *, {level_sql('risk_score')} AS risk_level FROM (
    SELECT *, critical + high + medium + low AS total, {score_sql(RAW, 'critical')} AS risk_score FROM counts)"""


@query("p6_confirmed_findings", given("vulnerabilities") +
       f"SELECT id, false_positive_likelihood FROM vulnerabilities WHERE {_CONFIRMED}")
def p6(spark, sf):
    return risk.confirmed(A.vulnerabilities(spark, sf)).select("id", "false_positive_likelihood")


@query("p9_severity_lists", given("vulnerabilities") + """
SELECT scan_id, CONCAT(lower(severity), '_findings') AS severity_list, id FROM vulnerabilities
WHERE severity IN ('Critical', 'High', 'Medium', 'Low')""")
def p9(spark, sf):
    return risk.with_severity_list(A.vulnerabilities(spark, sf)).select("scan_id", "severity_list", "id")


@query("j8_severity_attributes", given("vulnerabilities") + """
SELECT id, severity,
    CASE severity WHEN 'Critical' THEN 10 WHEN 'High' THEN 7 WHEN 'Medium' THEN 4 WHEN 'Low' THEN 1 END AS weight,
    CASE severity WHEN 'Critical' THEN 0 WHEN 'High' THEN 1 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 3 ELSE 4 END
        AS severity_rank FROM vulnerabilities""")
def j8(spark, sf):
    return risk.with_severity_attributes(A.vulnerabilities(spark, sf)).select(
        "id", "severity", "weight", "severity_rank")


@query("a1_severity_counts", given("vulnerabilities") + f"""
SELECT *, critical + high + medium + low AS total FROM
    (SELECT scan_id, {COUNTS} FROM vulnerabilities GROUP BY scan_id)""")
def a1(spark, sf):
    return risk.severity_counts(A.vulnerabilities(spark, sf), ["scan_id"])


@query("a2_category_counts", given("vulnerabilities") + """
SELECT scan_id, category, count(*) AS findings FROM vulnerabilities GROUP BY scan_id, category""")
def a2(spark, sf):
    return risk.category_counts(A.vulnerabilities(spark, sf), ["scan_id"])


@query("a3_owasp_counts", given("vulnerabilities") + """
SELECT scan_id, split_part(owasp_category, ' - ', 1) AS owasp, count(*) AS findings
FROM vulnerabilities GROUP BY scan_id, owasp""")
def a3(spark, sf):
    return risk.owasp_counts(A.vulnerabilities(spark, sf), ["scan_id"])


@query("a4_risk_score", given("vulnerabilities") + f"""
, counts AS (SELECT scan_id, {COUNTS} FROM vulnerabilities GROUP BY scan_id)
SELECT scan_id, {score_sql(RAW, 'critical')} AS risk_score FROM counts""".lstrip())
def a4(spark, sf):
    counts = risk.severity_counts(A.vulnerabilities(spark, sf), ["scan_id"])
    return risk.with_score(counts).select("scan_id", "risk_score")


@query("a5_risk_profile", given("vulnerabilities") + f"""
, counts AS (SELECT scan_id, {COUNTS} FROM vulnerabilities WHERE {_CONFIRMED} GROUP BY scan_id)
SELECT scan_id, critical, high, medium, low, total, risk_score, risk_level,
    {TREND.format('risk_level')} AS risk_trend FROM ({_SCORED})""".lstrip())
def a5(spark, sf):
    return risk.risk_profile(A.vulnerabilities(spark, sf), ["scan_id"]).select(
        "scan_id", *_NUMBERS, "risk_score", "risk_level", "risk_trend")


_FILE_COUNTS = SCAN + """, counts AS (
    SELECT s.file_path, s.repo, s.language,
        count(*) FILTER (WHERE raw_severity = 'Critical') AS critical,
        count(*) FILTER (WHERE raw_severity = 'High') AS high,
        count(*) FILTER (WHERE raw_severity = 'Medium') AS medium,
        count(*) FILTER (WHERE raw_severity = 'Low') AS low
    FROM source_files s LEFT JOIN findings f ON s.file_path = f.file_path
    GROUP BY s.file_path, s.repo, s.language)"""


def _shown(column):
    entries = F.transform(F.map_entries(column), lambda e: F.concat(
        e["key"], F.lit("="), e["value"].cast("string")))
    return F.array_join(F.array_sort(entries), ";")


@query("a5_file_profiles", _FILE_COUNTS + f""",
categories AS (SELECT file_path, string_agg(CONCAT(category, '=', n), ';' ORDER BY CONCAT(category, '=', n)) AS shown
    FROM (SELECT file_path, category, count(*) AS n FROM findings GROUP BY ALL) GROUP BY file_path),
owasps AS (SELECT file_path, string_agg(CONCAT(owasp, '=', n), ';' ORDER BY CONCAT(owasp, '=', n)) AS shown
    FROM (SELECT file_path, split_part(owasp_category, ' - ', 1) AS owasp, count(*) AS n
          FROM findings GROUP BY ALL) GROUP BY file_path)
SELECT p.file_path, p.language, p.critical, p.high, p.medium, p.low, p.total, p.risk_score, p.risk_level,
    COALESCE(c.shown, '') AS categories, COALESCE(o.shown, '') AS owasp
FROM ({_SCORED}) p LEFT JOIN categories c USING (file_path) LEFT JOIN owasps o USING (file_path)""")
def a5_files(spark, sf):
    profiles = risk.file_profiles(scanning.scan_files(A.source_files(spark, sf)))
    return profiles.select(
        "file_path", "language", *[F.col(c).cast("bigint").alias(c) for c in _NUMBERS],
        "risk_score", "risk_level", _shown(F.col("category_breakdown")).alias("categories"),
        _shown(F.col("owasp_breakdown")).alias("owasp"))


@query("files_by_risk", _FILE_COUNTS + f"""
SELECT file_path, language, total, risk_score, risk_level FROM ({_SCORED})""")
def by_risk(spark, sf):
    return files_by_risk(A.source_files(spark, sf)).select(
        "file_path", "language", F.col("total").cast("bigint").alias("total"),
        "risk_score", "risk_level")


_ROLLUP = f"""
SELECT repo, max(risk_score) AS risk_score, arg_max(risk_level, (risk_score, file_path)) AS risk_level,
    arg_max(file_path, (risk_score, file_path)) AS top_file, count(*) AS files_scanned,
    {lifecycle_sql('max(risk_score)')} AS lifecycle_status,
    CONCAT('Repository scan completed. Scanned ', count(*), ' files.') AS executive_summary
FROM profiles WHERE suffix(file_path, '.py') OR suffix(file_path, '.js') OR suffix(file_path, '.cpp')
GROUP BY repo"""


@query("a10_repo_rollup", given("scans") +
       ", profiles AS (SELECT split_part(file_path, '/', 1) AS repo, file_path, risk_score, risk_level "
       "FROM scans)" + _ROLLUP)
def a10(spark, sf):
    profiles = A.scans(spark, sf).withColumn("repo", F.substring_index("file_path", "/", 1))
    return risk.repo_rollup(profiles, ["repo"])


@query("a10_scanned_repositories",
       _FILE_COUNTS + f", profiles AS ({_SCORED})" + _ROLLUP)
def a10_files(spark, sf):
    return repositories_by_risk(A.source_files(spark, sf))


@query("a11_open_scores", given("scans", "vulnerabilities") + f"""
, sums AS (SELECT scan_id, sum({WEIGHT_ALL}) AS raw, count(*) FILTER (WHERE severity = 'Critical') AS critical
    FROM vulnerabilities WHERE status NOT IN ('fixed', 'accepted') GROUP BY scan_id),
scored AS (SELECT s.id, s.risk_level, {score_sql('COALESCE(raw, 0)', 'COALESCE(critical, 0)')} AS open_score
    FROM scans s LEFT JOIN sums ON s.id = sums.scan_id)
SELECT id, risk_level, open_score, CASE WHEN open_score = 0 THEN 'Resolved'
    ELSE {lifecycle_sql('open_score')} END AS open_lifecycle FROM scored""".lstrip())
def a11(spark, sf):
    return risk.open_scores(A.scans(spark, sf), A.vulnerabilities(spark, sf)).select(
        "id", "risk_level", "open_score", "open_lifecycle")


@query("a13_static_only_score", SCAN + """
SELECT file_path, count(*) AS findings, CAST(least(100, count(*) * 10) AS INT) AS overall_risk_score,
    'High' AS overall_risk_level FROM findings GROUP BY file_path
UNION ALL SELECT file_path, 0, 0, 'Low' FROM source_files
WHERE file_path NOT IN (SELECT file_path FROM findings)""")
def a13(spark, sf):
    scanned = scanning.scan_files(A.source_files(spark, sf))
    counts = scanned.select("file_path", F.size("hits").cast("bigint").alias("findings"))
    return risk.static_only_scores(counts)


_BARS = given("vulnerabilities") + f"""
, counts AS (
    SELECT scan_id, 'category' AS kind, category AS name, count(*) AS findings, min((created_at, id)) AS first_at
    FROM vulnerabilities WHERE {_CONFIRMED} GROUP BY scan_id, category
    UNION ALL
    SELECT scan_id, 'owasp', split_part(owasp_category, ' - ', 1) AS owasp, count(*), min((created_at, id))
    FROM vulnerabilities WHERE {_CONFIRMED} GROUP BY scan_id, owasp),
bars AS (SELECT scan_id, kind, name, findings,
    CAST(floor(findings * 100 / max(findings) OVER (PARTITION BY scan_id, kind)) AS INT) AS share,
    row_number() OVER (PARTITION BY scan_id, kind ORDER BY findings DESC, first_at, name) - 1 AS rank
    FROM counts) """.lstrip()


def _bars(spark, sf):
    return risk.breakdown_rows(A.vulnerabilities(spark, sf), ["scan_id"], ["created_at", "id"])


@query("a15_bar_shares", _BARS + "SELECT scan_id, kind, name, findings, share FROM bars")
def a15(spark, sf):
    return _bars(spark, sf).select("scan_id", "kind", "name", "findings", "share")


@query("w7_category_ranks", _BARS + "SELECT scan_id, name, rank FROM bars WHERE kind = 'category'")
def w7(spark, sf):
    return _bars(spark, sf).filter("kind = 'category'").select("scan_id", "name", "rank")


@query("o7_breakdown_order", _BARS + "SELECT scan_id, kind, rank, name, findings FROM bars")
def o7(spark, sf):
    return _bars(spark, sf).select("scan_id", "kind", "rank", "name", "findings")


@query("a16_change_log", given("vulnerabilities") + """
SELECT scan_id, row_number() OVER (PARTITION BY scan_id ORDER BY created_at, id) - 1 AS change_number,
    CONCAT(CASE severity WHEN 'Critical' THEN '🔴' WHEN 'High' THEN '🟠' WHEN 'Medium' THEN '🟡'
        WHEN 'Low' THEN '🟢' ELSE '•' END, ' [', severity, '] ', category, ' (line ', line_number, '): ',
        recommendation) AS change FROM vulnerabilities""")
def a16(spark, sf):
    return reports.change_log(
        A.vulnerabilities(spark, sf), ["scan_id"], [F.col("created_at"), F.col("id")])


@query("f15_change_lines", SCAN + """
SELECT file_path, source_order, CONCAT(CASE raw_severity WHEN 'Critical' THEN '🔴' WHEN 'High' THEN '🟠'
    WHEN 'Medium' THEN '🟡' WHEN 'Low' THEN '🟢' ELSE '•' END, ' [', raw_severity, '] ', category, ' (line ',
    line_number, '): Review the flagged line and apply secure coding best practices.') AS change
FROM findings""")
def f15(spark, sf):
    from seclake.functions.texts import change_line
    found = scanning.analyzed_of(scanning.findings_of(scanning.scan_files(A.source_files(spark, sf))))
    return found.select("file_path", "source_order", change_line(
        F.col("severity"), F.col("category"), F.col("line_number"), F.col("recommendation")).alias("change"))


@query("o6_findings_by_rank", given("vulnerabilities") + """
SELECT scan_id, id, row_number() OVER (PARTITION BY scan_id ORDER BY CASE severity WHEN 'Critical' THEN 0
    WHEN 'High' THEN 1 WHEN 'Medium' THEN 2 WHEN 'Low' THEN 3 ELSE 4 END, created_at, id) - 1 AS position
FROM vulnerabilities""")
def o6(spark, sf):
    return views.findings_by_rank(
        A.vulnerabilities(spark, sf), ["scan_id"], [F.col("created_at"), F.col("id")]
    ).select("scan_id", "id", "position")


@query("u1_analyzed_and_additional", given("vulnerabilities") + """
SELECT id, severity, 'analyzed' AS origin FROM vulnerabilities WHERE status = 'open'
UNION ALL SELECT id, severity, 'additional' FROM vulnerabilities WHERE severity = 'Info'""")
def u1(spark, sf):
    found = A.vulnerabilities(spark, sf).select("id", "severity", "status")
    return risk.all_findings(
        found.filter("status = 'open'").withColumn("origin", F.lit("analyzed")),
        found.filter("severity = 'Info'").withColumn("origin", F.lit("additional")),
    ).select("id", "severity", "origin")


@query("u3_repo_findings", SCAN + """
SELECT repo, file_path, source_order, CONCAT('[', split_part(file_path, '/', 2), '] ', category) AS category
FROM findings WHERE suffix(file_path, '.py') OR suffix(file_path, '.js') OR suffix(file_path, '.cpp')""")
def u3(spark, sf):
    found = scanning.findings_of(scanning.scan_files(A.source_files(spark, sf)))
    return risk.repo_findings(found).select("repo", "file_path", "source_order", "category")


@query("u4_line_changes", LINES + """,
secure_files AS (""" + A.SQL["secure_files"] + "), " +
       lines_sql("secure_files", "after") + """,
net AS (SELECT file_path, line, sum(step) AS net FROM (
    SELECT file_path, line, 1 AS step FROM lines UNION ALL SELECT file_path, line, -1 FROM after)
    GROUP BY file_path, line)
SELECT file_path, CASE WHEN net > 0 THEN '-' ELSE '+' END AS sign, line, CAST(abs(net) AS BIGINT) AS copies
FROM net WHERE net <> 0""")
def u4(spark, sf):
    return reports.line_changes(A.source_files(spark, sf), A.secure_files(spark, sf))


@query("u4_line_counts", LINES + """,
secure_files AS (""" + A.SQL["secure_files"] + "), " +
       lines_sql("secure_files", "after") + """
SELECT b.file_path, regexp_replace(split_part(b.file_path, '/', 2), '(\\.[^.]*)$', '_secure\\1') AS secure_file,
    CAST(len(b.p) AS INT) AS line_count_original, CAST(len(a.p) AS INT) AS line_count_secure
FROM lines_parts b JOIN after_parts a ON a.file_path = b.file_path""")
def u4_counts(spark, sf):
    return reports.line_counts(A.source_files(spark, sf), A.secure_files(spark, sf))


_SCORES = given("scans")


@query("f3_levels", _SCORES + f"SELECT id, {level_sql('risk_score')} AS risk_level FROM scans")
def f3(spark, sf):
    return A.scans(spark, sf).select("id", scores.level_of(F.col("risk_score")).alias("risk_level"))


@query("f4_trends", _SCORES + f"SELECT id, {TREND.format('risk_level')} AS risk_trend FROM scans")
def f4(spark, sf):
    return A.scans(spark, sf).select("id", scores.trend_of(F.col("risk_level")).alias("risk_trend"))


@query("f5_lifecycle_at_transition", _SCORES + """
SELECT id, CASE WHEN risk_score <= 0 THEN 'Safe' WHEN risk_score <= 24 THEN 'Warning'
    WHEN risk_score <= 49 THEN 'Vulnerable' ELSE 'Critical' END AS status FROM scans""")
def f5(spark, sf):
    return A.scans(spark, sf).select(
        "id", scores.lifecycle_at_transition(F.col("risk_score")).alias("status"))


@query("f6_lifecycle_at_override", _SCORES + """
SELECT id, CASE WHEN risk_score = 0 THEN 'Resolved' WHEN risk_score <= 24 THEN 'Warning'
    WHEN risk_score <= 49 THEN 'Vulnerable' ELSE 'Critical' END AS status FROM scans""")
def f6(spark, sf):
    return A.scans(spark, sf).select(
        "id", scores.lifecycle_at_override(F.col("risk_score")).alias("status"))


@query("f7_lifecycle_at_scan", _SCORES + f"SELECT id, {lifecycle_sql('risk_score')} AS status FROM scans")
def f7(spark, sf):
    return A.scans(spark, sf).select(
        "id", scores.lifecycle_at_scan(F.col("risk_score")).alias("status"))


@query("f18_math", given("vulnerabilities") + """
SELECT scan_id, CAST(sum(line_number) AS BIGINT) AS lines,
    CAST(floor(least(100.0, 20 * ln(1 + sum(line_number)))) AS INT) AS smooth,
    CAST(greatest(1, ceil(count(*) / 3.0)) AS BIGINT) AS pages FROM vulnerabilities GROUP BY scan_id""")
def f18(spark, sf):
    sums = A.vulnerabilities(spark, sf).groupBy("scan_id").agg(
        F.sum("line_number").alias("lines"), F.count("*").alias("n"))
    return sums.select(
        "scan_id", "lines",
        F.floor(F.least(F.lit(100.0), 20 * F.log1p("lines"))).cast("int").alias("smooth"),
        F.greatest(F.lit(1), F.ceil(F.col("n") / 3)).cast("bigint").alias("pages"))
