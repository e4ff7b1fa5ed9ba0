"""Scores, levels and lifecycle statuses."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from seclake.fixed_values import (
    ALLOWED_MOVES,
    CLOSED_STATUSES,
    OTHER_SEVERITY_RANK,
    OTHER_SEVERITY_WEIGHT_OPEN,
    RISK_TREND,
    SEVERITY_RANK,
    SEVERITY_WEIGHT,
)
from seclake.functions.lookup import literal_map, look_up


def weight(severity: Column) -> Column:
    """Weight of a severity; null when unknown."""
    return look_up(SEVERITY_WEIGHT, severity)


def open_weight(severity: Column) -> Column:
    """Weight used for open findings, where an unknown severity still counts."""
    return look_up(SEVERITY_WEIGHT, severity, OTHER_SEVERITY_WEIGHT_OPEN)


def severity_rank(severity: Column) -> Column:
    """Critical first, unknown last."""
    return look_up(SEVERITY_RANK, severity, OTHER_SEVERITY_RANK)


def score_of(raw: Column, critical: Column) -> Column:
    """Score 0-100 from the weighted sum and the number of critical findings (A4).

    A logarithm keeps many low findings below one critical; a critical finding
    lifts the score to at least 65.
    """
    smooth = F.floor(F.least(F.lit(100.0), F.lit(20.0) * F.log1p(raw.cast("double"))))
    lifted = F.when(critical > 0, F.lit(60) + F.least(F.lit(40), critical * 5)).otherwise(0)
    return (
        F.when(raw == 0, F.lit(0))
        .otherwise(F.least(F.lit(100), F.greatest(smooth, lifted)))
        .cast("int")
    )


def raw_of(critical: Column, high: Column, medium: Column, low: Column) -> Column:
    w = SEVERITY_WEIGHT
    return (
        critical * w["Critical"] + high * w["High"] + medium * w["Medium"] + low * w["Low"]
    )


def level_of(score: Column) -> Column:
    """Risk level."""
    return (
        F.when(score >= 75, "Critical").when(score >= 50, "High")
        .when(score >= 25, "Medium").otherwise("Low")
    )


def trend_of(level: Column) -> Column:
    """Trend text of a level."""
    return look_up(RISK_TREND, level, "")


def lifecycle_at_transition(score: Column) -> Column:
    """Lifecycle by the transition rule."""
    return (
        F.when(score <= 0, "Safe").when(score <= 24, "Warning")
        .when(score <= 49, "Vulnerable").otherwise("Critical")
    )


def lifecycle_at_override(score: Column) -> Column:
    """Lifecycle by the override rule."""
    return (
        F.when(score == 0, "Resolved").when(score <= 24, "Warning")
        .when(score <= 49, "Vulnerable").otherwise("Critical")
    )


def lifecycle_at_scan(score: Column) -> Column:
    """Lifecycle by the scan rule."""
    return (
        F.when(score >= 75, "Critical").when(score >= 50, "Vulnerable")
        .when(score >= 25, "Warning").otherwise("Safe")
    )


def lifecycle_of_open(score: Column) -> Column:
    """Lifecycle after findings changed status: score 0 is Resolved."""
    return F.when(score == 0, "Resolved").otherwise(lifecycle_at_scan(score))


def is_open(status: Column) -> Column:
    """Neither fixed nor accepted."""
    return ~status.isin(*CLOSED_STATUSES)


def may_move(current: Column, target: Column) -> Column:
    """May a scan go from ``current`` to ``target``? Unknown current says no."""
    allowed = F.try_element_at(literal_map(ALLOWED_MOVES), current)
    return F.coalesce(F.array_contains(allowed, target), F.lit(False))
