"""Fixed table schemas. Timestamps carry no zone: every stored time is UTC."""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    DataType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampNTZType,
)

_TYPES = {
    "STRING": StringType(), "INT": IntegerType(), "BIGINT": LongType(),
    "TIMESTAMP_NTZ": TimestampNTZType(), "STRINGS": ArrayType(StringType()),
}
_T = "TIMESTAMP_NTZ"


def _schema(columns: str, **nested: DataType) -> StructType:
    """Schema from ``name TYPE`` pairs. Needs no session, unlike parsing DDL."""
    pairs = [column.split() for column in columns.split(",")]
    fields = [StructField(name, _TYPES[kind]) for name, kind in pairs]
    return StructType([StructField(n, t) for n, t in nested.items()] + fields)


USERS = _schema(
    f"id STRING, username STRING, password_hash STRING, role STRING, created_at {_T}")
SCANS = _schema(
    "id STRING, file_path STRING, language STRING, mode STRING, risk_score INT, "
    f"risk_level STRING, lifecycle_status STRING, created_at {_T}, updated_at {_T}, "
    "user_id STRING, report_path STRING, executive_summary STRING")
VULNERABILITIES = _schema(
    "id STRING, scan_id STRING, vuln_id STRING, category STRING, severity STRING, "
    "line_number INT, line_content STRING, status STRING, cwe_id STRING, "
    f"owasp_category STRING, recommendation STRING, ai_explanation STRING, created_at {_T}")
SCORE_HISTORY = _schema(
    "id BIGINT, scan_id STRING, score INT, lifecycle_status STRING, changed_by STRING, "
    f"reason STRING, timestamp {_T}")
AUDIT_LOGS = _schema(
    "id BIGINT, scan_id STRING, action STRING, performed_by STRING, role STRING, "
    "old_score INT, new_score INT, old_status STRING, new_status STRING, "
    f"vulnerability_status STRING, severity_level STRING, details STRING, timestamp {_T}")
TRANSITION_REQUESTS = _schema(f"id BIGINT, scan_id STRING, target STRING, timestamp {_T}")
STATUS_CHANGES = _schema(
    f"id BIGINT, vuln_id STRING, scan_id STRING, severity STRING, status STRING, timestamp {_T}")
LLM_RESPONSES = _schema("file_id BIGINT, raw STRING")
RULES = _schema(
    "vuln_id STRING, language STRING, category STRING, pattern STRING, description STRING, "
    "cwe_id STRING, owasp_category STRING, confidence STRING, severity STRING")

TABLES = {
    "users": USERS,
    "scans": SCANS,
    "vulnerabilities": VULNERABILITIES,
    "score_history": SCORE_HISTORY,
    "audit_logs": AUDIT_LOGS,
}

_ANSWER_FINDING = _schema(
    "category STRING, line_number STRING, line_content STRING, severity STRING, "
    "explanation STRING, recommendation STRING")
ANSWER = _schema(
    "overall_risk_score STRING, overall_risk_level STRING, executive_summary STRING, "
    "top_priority_fixes STRINGS, secure_code STRING",
    analyzed_vulnerabilities=ArrayType(_ANSWER_FINDING))
