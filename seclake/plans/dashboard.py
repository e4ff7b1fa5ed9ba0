"""The dashboard: four small frames over the same scans."""

from __future__ import annotations

from pyspark.sql import DataFrame

from seclake.operators import views


def dashboard(
    scans: DataFrame, findings: DataFrame, user_id: str | None = None
) -> dict[str, DataFrame]:
    """Totals, status counts, severity counts and newest scans, of one user or of all."""
    own = views.matching(scans, user_id=user_id)
    if user_id is not None:
        ids = own.select("id").withColumnRenamed("id", "_scan")
        findings = findings.join(ids, findings["scan_id"] == ids["_scan"], "left_semi")
    return {
        "totals": views.dashboard_totals(own),
        "statuses": views.scans_by_status(own),
        "severities": views.findings_by_severity(findings),
        "recent": views.recent_scans(own),
    }
