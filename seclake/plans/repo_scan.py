"""Scan of whole repositories: one stored scan per repository."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from seclake.fixed_values import REPO_DETAILS, REPO_REASON, RULES
from seclake.functions.texts import message, report_key, stable_id
from seclake.operators.maintain import audit_rows, fitted, fixed_time, history_rows
from seclake.operators.risk import file_profiles, repo_findings, repo_rollup
from seclake.operators.scanning import analyzed_of, findings_of, scan_files
from seclake.schemas import SCANS, VULNERABILITIES
from seclake.plans.logs import append_log
from seclake.session import cut
from seclake.sources.tables import append


def repo_scan_rows(rollup: DataFrame, user_id: str, run: str, at: Column) -> DataFrame:
    """Rows for ``scans`` from repository rollups."""
    when = at.cast("timestamp_ntz")
    report = F.concat(F.lit("reports/"), report_key(F.col("top_file"), when), F.lit(".html"))
    return fitted(
        rollup, SCANS,
        id=stable_id(F.lit(run), F.col("repo"), when), file_path=F.col("repo"), language=F.lit("multi"),
        mode=F.lit("github"), user_id=F.lit(user_id), report_path=report,
        created_at=when, updated_at=when)


def scan_repositories_and_store(
    files: DataFrame, folder: str, run: str, at: Column, user_id: str = "system", rules=RULES,
) -> None:
    """Scan the supported files of each repository and append to the four tables.

    ``files`` has repo, file_path, text and language. A repository without a supported file
    gives no rows.
    """
    when = fixed_time(files.sparkSession, at)
    scanned = cut(scan_files(files, rules).select("repo", "file_path", "language", "hits"))
    rollup = cut(repo_rollup(file_profiles(scanned, rules), ["repo"]))
    scans = repo_scan_rows(rollup, user_id, run, when)
    append(scans, folder, "scans", run)
    found = repo_findings(analyzed_of(findings_of(scanned, rules)))
    append(fitted(
        found, VULNERABILITIES,
        id=stable_id(F.lit(run), F.col("repo"), when, F.col("file_path"), F.col("vuln_id"),
                     F.col("line_number")),
        scan_id=stable_id(F.lit(run), F.col("repo"), when), status=F.lit("open"), created_at=when,
    ), folder, "vulnerabilities", run)
    changes = rollup.select(
        stable_id(F.lit(run), F.col("repo"), when).alias("scan_id"), "risk_score", "lifecycle_status",
        "risk_level", "files_scanned", F.lit(user_id).alias("user_id"), when.alias("timestamp"))
    append_log(history_rows(changes.select(
        "scan_id", F.col("risk_score").alias("score"), "lifecycle_status",
        F.col("user_id").alias("changed_by"), F.lit(REPO_REASON).alias("reason"), "timestamp",
    )), folder, "score_history", run)
    details = message(REPO_DETAILS, F.col("files_scanned"), F.col("risk_score"))
    append_log(audit_rows(changes.select(
        "scan_id", F.lit("scan_created").alias("action"), F.col("user_id").alias("performed_by"),
        F.lit("user").alias("role"), F.col("risk_score").alias("new_score"),
        F.col("lifecycle_status").alias("new_status"), F.col("risk_level").alias("severity_level"),
        details.alias("details"), "timestamp")), folder, "audit_logs", run)
