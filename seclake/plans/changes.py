"""Changes to stored scans as whole jobs: each gives every table it changes.

Of the current-state tables (scans, vulnerabilities) all rows come back, changed or not; of
the two logs only the rows to append, but for deletes. ``write_version`` stores them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from seclake.operators import maintain
from seclake.operators.lifecycle import replay_status_changes, run_lifecycle, score_overrides
from seclake.operators.ordered import latest
from seclake.plans.logs import append_log
from seclake.session import cut
from seclake.sources.tables import append

LOGS = ("score_history", "audit_logs")


def _last_of(changes: DataFrame, keys: list[str]) -> DataFrame:
    return latest(changes, keys, [F.col("timestamp").desc(), F.col("id").desc()])


def _scans_after(scans: DataFrame, last: DataFrame, score: str, status: str,
                 stamped: bool = True) -> DataFrame:
    when = [F.col("timestamp").alias("updated_at")] if stamped else []
    return maintain.updated(scans, last.select(
        F.col("scan_id").alias("id"), F.col(score).cast("int").alias("risk_score"),
        F.col(status).alias("lifecycle_status"), *when))


def override_scores(
    scans: DataFrame, overrides: DataFrame, performed_by: str,
) -> dict[str, DataFrame]:
    """Manual scores (id, scan_id, score, timestamp) on the scans they name."""
    done = cut(score_overrides(scans, overrides))
    return {
        "scans": _scans_after(scans, _last_of(done, ["scan_id"]), "new_score", "new_status"),
        "score_history": maintain.override_history(done, performed_by),
        "audit_logs": maintain.override_audit(done, performed_by)}


def move_scans(
    scans: DataFrame, requests: DataFrame, performed_by: str, role: str,
) -> dict[str, DataFrame]:
    """Transition requests (id, scan_id, target, timestamp); rejected ones change nothing
    (T2, S5, S6, J7)."""
    steps = cut(run_lifecycle(requests, scans.select("id", "lifecycle_status", "risk_score")))
    last = _last_of(steps.filter("accepted"), ["scan_id"])
    return {
        "scans": _scans_after(scans, last, "new_score", "new_status"),
        "score_history": maintain.move_history(steps, performed_by),
        "audit_logs": maintain.move_audit(steps, performed_by, role)}


def change_finding_statuses(
    scans: DataFrame, findings: DataFrame, changes: DataFrame, performed_by: str,
) -> dict[str, DataFrame]:
    """Status changes (id, vuln_id, scan_id, severity, status, timestamp) of findings, where
    vuln_id is the finding's id. Every change scores its scan anew; the scan's time stays
    (W6, S5, S6, J7)."""
    start = findings.select(F.col("id").alias("vuln_id"), "scan_id", "severity", "status")
    done = cut(replay_status_changes(changes, start))
    last = _last_of(done, ["vuln_id"]).select(F.col("vuln_id").alias("id"), "status")
    return {
        "vulnerabilities": maintain.updated(findings, last),
        "scans": _scans_after(
            scans, _last_of(done, ["scan_id"]), "score", "lifecycle_status", stamped=False),
        "score_history": maintain.status_history(done, performed_by),
        "audit_logs": maintain.status_audit(done, performed_by)}


def delete_scans(
    tables: dict[str, DataFrame], ids: DataFrame, performed_by: str, at: Column,
) -> dict[str, DataFrame]:
    """The four tables without the scans (scan_id), and the audit rows that say so."""
    when = maintain.fixed_time(ids.sparkSession, at)
    left = maintain.without_scans(tables, ids)
    last = tables["audit_logs"].agg(F.max("id")).first()[0] or 0
    said = maintain.numbered(maintain.deletion_audit(ids, performed_by, when), last)
    return {**left, "audit_logs": left["audit_logs"].unionByName(said, allowMissingColumns=True)}


def write_version(
    frames: dict[str, DataFrame], folder: str, run: str, logs: tuple[str, ...] = LOGS,
) -> None:
    """Store what a job gives as the part ``run`` of tables in ``folder``; a repeated run
    replaces its own part. The rows of ``logs`` are new ones and get running ids; leave a log
    out that is given whole, as by ``delete_scans``."""
    for name, rows in frames.items():
        (append_log if name in logs else append)(rows, folder, name, run)
