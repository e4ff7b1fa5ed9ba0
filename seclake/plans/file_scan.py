"""Whole jobs over source files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from seclake.fixed_values import STATIC_SUMMARY
from seclake.functions.texts import language_by_content
from seclake.operators.maintain import (
    first_history_rows,
    fixed_time,
    scan_audit,
    scan_rows,
    vulnerability_rows,
)
from seclake.operators.risk import file_profiles, repo_rollup
from seclake.operators.scanning import analyzed_of, findings_of, scan_files
from seclake.plans.logs import append_log
from seclake.session import cut
from seclake.sources.tables import append


def files_by_risk(files: DataFrame) -> DataFrame:
    """Scanned files, riskiest first.

    Spark samples the input of a global sort first. The profiles are shuffled before, so
    that the sample reads them back and does not scan all text a second time.
    """
    profiles = file_profiles(scan_files(files)).repartition("file_path")
    return profiles.orderBy(F.col("risk_score").desc(), "file_path")


def repositories_by_risk(files: DataFrame) -> DataFrame:
    """Repositories, riskiest first, from their source files (A10)."""
    profiles = file_profiles(scan_files(files))
    return repo_rollup(profiles, ["repo"]).orderBy(F.col("risk_score").desc(), "repo")


def scan_and_store(
    files: DataFrame, folder: str, run: str, at: Column, mode: str = "upload",
    user_id: str = "system",
) -> None:
    """Scan files and append to the four tables.

    The hits are written out once and all four tables are made from them, with one time for
    all. ``files`` needs file_path and text; a missing language is told from the content.
    """
    at = fixed_time(files.sparkSession, at)
    if "language" not in files.columns:
        files = files.withColumn("language", language_by_content(F.col("text")))
    scanned = cut(scan_files(files).select("file_path", "language", "hits"))
    profiles = file_profiles(scanned).withColumn("executive_summary", F.lit(STATIC_SUMMARY))
    scans = scan_rows(profiles, mode, user_id, run, at)
    append(scans, folder, "scans", run)
    findings = analyzed_of(findings_of(scanned))
    append(vulnerability_rows(findings, run, at), folder, "vulnerabilities", run)
    append_log(first_history_rows(scans), folder, "score_history", run)
    append_log(scan_audit(scans), folder, "audit_logs", run)
