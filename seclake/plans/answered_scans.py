"""Risk profiles and stored scans from model answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from seclake.fixed_values import SEVERITIES
from seclake.functions.scores import lifecycle_at_scan
from seclake.functions.texts import stable_id
from seclake.operators.answers import answer_findings, answers_with_defaults
from seclake.operators.maintain import (
    first_history_rows,
    fitted,
    fixed_time,
    scan_audit,
    scan_rows,
)
from seclake.operators.risk import COUNTS, with_score, with_total
from seclake.schemas import VULNERABILITIES
from seclake.plans.logs import append_log
from seclake.session import cut
from seclake.sources.tables import append


def profiles_of(analyses: DataFrame, *keys: str) -> DataFrame:
    """Counts, score, level and lifecycle of each analysis, inside its row (A5).

    Findings marked as likely false positives are left out, as for any profile. A failed
    answer has no findings, so it scores 0; ``analysis_failed`` tells it from a clean file.
    The score an answer states for itself is not used.
    """
    counts = analyses.select(
        *keys, "analysis_failed", "executive_summary",
        *[F.expr(f"size(filter(findings, f -> f.severity = '{severity}' "
                 "AND f.false_positive_likelihood <> 'HIGH'))").alias(name)
          for severity, name in zip(SEVERITIES, COUNTS)])
    return with_score(with_total(counts)).withColumn(
        "lifecycle_status", lifecycle_at_scan(F.col("risk_score")))


def answered_profiles(answers: DataFrame, key: str) -> DataFrame:
    """Profiles of raw answers (A5)."""
    return profiles_of(answers_with_defaults(answers), key)


def store_answered_scans(
    answers: DataFrame, folder: str, run: str, at: Column, mode: str = "upload",
    user_id: str = "system",
) -> None:
    """Scans, findings, history and audit rows from answers, appended to the tables.

    ``answers`` has file_path, language and raw, one row per scanned file. Every finding of an
    answer is stored, false positives too; a failed answer gives a scan without findings that
    holds the problem as its summary.
    """
    when = fixed_time(answers.sparkSession, at)
    analyses = cut(answers_with_defaults(answers.select("file_path", "language", "raw")))
    scans = scan_rows(profiles_of(analyses, "file_path", "language"), mode, user_id, run, when)
    append(scans, folder, "scans", run)
    # One answer may name a line twice, so the place in the answer is part of the id.
    place = [F.lit(run), F.col("file_path"), when]
    append(fitted(
        answer_findings(analyses, "file_path"), VULNERABILITIES,
        id=stable_id(*place, F.col("vuln_id"), F.col("line_number"), F.col("source_order")),
        scan_id=stable_id(*place), status=F.lit("open"), created_at=when,
    ), folder, "vulnerabilities", run)
    append_log(first_history_rows(scans), folder, "score_history", run)
    append_log(scan_audit(scans), folder, "audit_logs", run)
