"""Changes to the stored tables: deletes, updates, key checks, and rows to append."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from seclake.fixed_values import (
    DELETE_DETAILS,
    MOVE_DETAILS,
    MOVE_REASON,
    OVERRIDE_DETAILS,
    OVERRIDE_REASON,
    SCAN_DETAILS,
    SCAN_REASON,
    STATUS_DETAILS,
    STATUS_REASON,
)
from seclake.functions.scores import lifecycle_at_scan
from seclake.functions.texts import message, report_key, stable_id
from seclake.operators.ordered import positions
from seclake.schemas import AUDIT_LOGS, SCANS, SCORE_HISTORY, VULNERABILITIES

SCAN_KEY = {
    "vulnerabilities": "scan_id", "score_history": "scan_id", "audit_logs": "scan_id",
    "scans": "id",
}


def fitted(df: DataFrame, schema, **missing: Column) -> DataFrame:
    """Columns of a table schema in order; absent ones from ``missing``, else null."""
    columns = []
    for field in schema.fields:
        if field.name in missing:
            value = missing[field.name]
        elif field.name in df.columns:
            value = F.col(field.name)
        else:
            value = F.lit(None)
        columns.append(value.cast(field.dataType).alias(field.name))
    return df.select(columns)


# ---- delete, update, checks ------------------------------------------------------------

def without_scans(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """The four tables without the rows of the given scans (J5). ``ids`` has scan_id."""
    gone = ids.select(F.col("scan_id").alias("_gone")).distinct()
    return {
        name: df.join(gone, df[SCAN_KEY[name]] == F.col("_gone"), "left_anti")
        for name, df in tables.items()}


def deletion_audit(ids: DataFrame, performed_by: str, at: Column) -> DataFrame:
    """One audit row per deleted scan."""
    return audit_rows(ids.select("scan_id").distinct().select(
        "scan_id", F.lit("scan_deleted").alias("action"),
        F.lit(performed_by).alias("performed_by"), F.lit("admin").alias("role"),
        message(DELETE_DETAILS, F.col("scan_id")).alias("details"), at.alias("timestamp")))


def orphans(child: DataFrame, parent: DataFrame, key: str, parent_key: str = "id") -> DataFrame:
    """Rows whose parent is missing; a null key has no parent to miss."""
    known = parent.select(F.col(parent_key).alias("_parent")).distinct()
    return child.filter(F.col(key).isNotNull()).join(
        known, F.col(key) == F.col("_parent"), "left_anti")


def repeated_keys(table: DataFrame, key: str) -> DataFrame:
    """Key values held by more than one row."""
    return table.groupBy(key).agg(F.count("*").alias("rows")).filter("rows > 1")


def updated(table: DataFrame, updates: DataFrame, key: str = "id", small: bool = False) -> DataFrame:
    """New values for rows whose key is in ``updates``; null keeps the old value.

    Of a repeated key one update counts, the greatest by its columns; ``ordered.latest``
    picks by time. ``small`` updates are sent to the rows of the table.
    """
    changed = [c for c in updates.columns if c != key]
    updates = updates.groupBy(key).agg(F.max(F.struct(*changed)).alias("_")).select(key, "_.*")
    new = updates.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_new_{c}") for c in changed])
    joined = table.join(F.broadcast(new) if small else new, table[key] == F.col("_key"), "left")
    return joined.select([
        F.coalesce(F.col(f"_new_{c}"), table[c]).alias(c) if c in changed else table[c]
        for c in table.columns])


# ---- rows to append --------------------------------------------------------------------

def fixed_time(spark: SparkSession, at: Column) -> Column:
    """The time as a value. A column such as the current time would be another in each write."""
    return F.lit(spark.range(1).select(at.cast("timestamp_ntz")).first()[0]).cast("timestamp_ntz")


def scan_rows(profiles: DataFrame, mode: str, user_id: str, run: str, at: Column) -> DataFrame:
    """Rows for ``scans`` from file profiles (S4). Same run, file and time give the same id."""
    when = at.cast("timestamp_ntz")
    path = F.col("file_path")
    return fitted(
        profiles, SCANS,
        id=stable_id(F.lit(run), path, when), mode=F.lit(mode), user_id=F.lit(user_id),
        lifecycle_status=lifecycle_at_scan(F.col("risk_score")),
        report_path=F.concat(F.lit("reports/"), report_key(path, when), F.lit(".html")),
        created_at=when, updated_at=when)


def vulnerability_rows(analyzed: DataFrame, run: str, at: Column) -> DataFrame:
    """Rows for ``vulnerabilities``: every analyzed finding, false positives too."""
    when = at.cast("timestamp_ntz")
    scan_id = stable_id(F.lit(run), F.col("file_path"), when)
    return fitted(
        analyzed, VULNERABILITIES,
        id=stable_id(F.lit(run), F.col("file_path"), when, F.col("vuln_id"),
                     F.col("line_number")),
        scan_id=scan_id, status=F.lit("open"), created_at=when)


def first_history_rows(scans: DataFrame) -> DataFrame:
    """First score-history row of each new scan."""
    return history_rows(scans.select(
        F.col("id").alias("scan_id"), F.col("risk_score").alias("score"), "lifecycle_status",
        F.col("user_id").alias("changed_by"), F.lit(SCAN_REASON).alias("reason"),
        F.col("created_at").alias("timestamp")))


def history_rows(changes: DataFrame) -> DataFrame:
    """Rows for ``score_history``.

    The id comes from what the row says and, where ``change_id`` is given, from the change
    that made it: two like changes at one time are two rows with two ids.
    """
    keys = ["scan_id", "timestamp", "score", "lifecycle_status", "reason"]
    return fitted(changes, SCORE_HISTORY, id=_row_id(changes, keys))


def _row_id(changes: DataFrame, keys: list[str]) -> Column:
    own = [c for c in ("change_id",) if c in changes.columns]
    return F.xxhash64(stable_id(*[F.col(c) for c in keys + own]))


def audit_rows(changes: DataFrame) -> DataFrame:
    """Rows for ``audit_logs`` (S5); the role is system unless given, the rest null."""
    keys = ["scan_id", "action", "timestamp", "details"]
    role = F.coalesce("role", F.lit("system")) if "role" in changes.columns else F.lit("system")
    return fitted(changes, AUDIT_LOGS, id=_row_id(changes, keys), role=role)


def numbered(rows: DataFrame, after: int) -> DataFrame:
    """Log rows with running ids from ``after`` + 1 on, without gaps.

    In the order of time, then of what the rows say. Each task numbers its range of the order;
    the ranges' sizes are added up before.
    """
    said = [c for c in rows.columns if c not in ("id", "timestamp")]
    order = [F.col(c).asc_nulls_first() for c in ("timestamp", *said, "id")]
    return positions(rows, [], order, "_at").withColumn(
        "id", F.col("_at") + F.lit(after + 1)).drop("_at")


def change_of(changes: DataFrame) -> list[Column]:
    """The id of the change, where the rows have one."""
    return [F.col("id").alias("change_id")] if "id" in changes.columns else []


def scan_audit(scans: DataFrame) -> DataFrame:
    """Audit rows of new scans."""
    return audit_rows(scans.select(
        F.col("id").alias("scan_id"), F.lit("scan_created").alias("action"),
        F.col("user_id").alias("performed_by"), F.lit("user").alias("role"),
        F.col("risk_score").alias("new_score"), F.col("lifecycle_status").alias("new_status"),
        F.col("risk_level").alias("severity_level"),
        message(SCAN_DETAILS, F.col("risk_score"), F.col("risk_level")).alias("details"),
        F.col("created_at").alias("timestamp")))


def move_history(steps: DataFrame, performed_by: str) -> DataFrame:
    """History rows of accepted lifecycle transitions."""
    return history_rows(steps.filter("accepted").select(
        *change_of(steps), "scan_id", F.col("new_score").alias("score"),
        F.col("new_status").alias("lifecycle_status"), F.lit(performed_by).alias("changed_by"),
        message(MOVE_REASON, F.col("old_status"), F.col("new_status")).alias("reason"),
        "timestamp"))


def move_audit(steps: DataFrame, performed_by: str, role: str) -> DataFrame:
    """Audit rows of accepted lifecycle transitions."""
    return audit_rows(steps.filter("accepted").select(
        *change_of(steps), "scan_id", F.lit("lifecycle_transition").alias("action"),
        F.lit(performed_by).alias("performed_by"), F.lit(role).alias("role"),
        "old_score", "new_score", "old_status", "new_status",
        F.col("new_status").alias("vulnerability_status"),
        F.col("new_status").alias("severity_level"),
        message(MOVE_DETAILS, F.col("old_status"), F.col("new_status")).alias("details"),
        "timestamp"))


def override_history(overrides: DataFrame, performed_by: str) -> DataFrame:
    """History rows of manual scores."""
    return history_rows(overrides.select(
        *change_of(overrides), "scan_id", F.col("new_score").alias("score"),
        F.col("new_status").alias("lifecycle_status"), F.lit(performed_by).alias("changed_by"),
        F.lit(OVERRIDE_REASON).alias("reason"), "timestamp"))


def override_audit(overrides: DataFrame, performed_by: str) -> DataFrame:
    """Audit rows of manual scores."""
    return audit_rows(overrides.select(
        *change_of(overrides), "scan_id", F.lit("manual_score_override").alias("action"),
        F.lit(performed_by).alias("performed_by"), F.lit("admin").alias("role"),
        "old_score", "new_score", "old_status", "new_status",
        message(OVERRIDE_DETAILS, F.col("old_score"), F.col("new_score")).alias("details"),
        "timestamp"))


def status_history(replayed: DataFrame, performed_by: str) -> DataFrame:
    """History rows of finding-status changes, from the replay."""
    reason = message(STATUS_REASON, F.col("vuln_id"), F.col("old_status"), F.col("status"))
    return history_rows(replayed.select(
        *change_of(replayed), "scan_id", "score", "lifecycle_status", F.lit(performed_by).alias("changed_by"),
        reason.alias("reason"), "timestamp"))


def status_audit(replayed: DataFrame, performed_by: str) -> DataFrame:
    """Audit rows of finding-status changes, from the replay."""
    details = message(
        STATUS_DETAILS, F.col("vuln_id"), F.col("old_status"), F.col("status"), F.col("score"))
    return audit_rows(replayed.select(
        *change_of(replayed), "scan_id", F.lit("vulnerability_status_changed").alias("action"),
        F.lit(performed_by).alias("performed_by"), F.lit("admin").alias("role"),
        "old_status", F.col("status").alias("new_status"),
        F.col("status").alias("vulnerability_status"), F.col("severity").alias("severity_level"),
        details.alias("details"), "timestamp"))
