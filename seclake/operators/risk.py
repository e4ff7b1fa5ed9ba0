"""Severity counts, risk scores, profiles and rollups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from seclake.fixed_values import REPO_SUMMARY, RULES, Rule, SEVERITIES, STRUCTURAL_RULES
from seclake.functions.lookup import map_text, quoted
from seclake.functions.scores import (
    level_of,
    lifecycle_at_scan,
    lifecycle_of_open,
    is_open,
    open_weight,
    raw_of,
    score_of,
    severity_rank,
    trend_of,
    weight,
)
from seclake.functions.texts import base_name, is_scanned_path, message, owasp_prefix
from seclake.operators.ordered import ROWS_PER_PIECE, any_large_group, positions

COUNTS = [s.lower() for s in SEVERITIES]


def with_severity_attributes(findings: DataFrame) -> DataFrame:
    """Weight and sort rank of each finding's severity."""
    return findings.withColumn("weight", weight(F.col("severity"))).withColumn(
        "severity_rank", severity_rank(F.col("severity")))


def confirmed(findings: DataFrame) -> DataFrame:
    """Without likely false positives; an unknown likelihood stays."""
    return findings.filter(~F.col("false_positive_likelihood").eqNullSafe("HIGH"))


def all_findings(analyzed: DataFrame, additional: DataFrame) -> DataFrame:
    """Analyzed and additional findings together, repeats kept."""
    return analyzed.unionByName(additional, allowMissingColumns=True)


def with_severity_list(findings: DataFrame) -> DataFrame:
    """Name the list each finding belongs to; unknown severities are in none."""
    return findings.filter(F.col("severity").isin(*SEVERITIES)).withColumn(
        "severity_list", F.concat(F.lower("severity"), F.lit("_findings")))


def _severity_counts() -> list[Column]:
    return [F.count_if(F.col("severity") == s).alias(n) for s, n in zip(SEVERITIES, COUNTS)]


def with_total(counts: DataFrame) -> DataFrame:
    return counts.withColumn("total", sum((F.col(n) for n in COUNTS[1:]), F.col(COUNTS[0])))


def with_score(counts: DataFrame) -> DataFrame:
    """Score, level and trend from the four counts."""
    raw = raw_of(*[F.col(n) for n in COUNTS])
    return (
        counts.withColumn("risk_score", score_of(raw, F.col("critical")))
        .withColumn("risk_level", level_of(F.col("risk_score")))
        .withColumn("risk_trend", trend_of(F.col("risk_level")))
    )


def severity_counts(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Four counts and their total; other severities are not counted (A1)."""
    return with_total(findings.groupBy(*keys).agg(*_severity_counts()))


def severity_map() -> Column:
    """The four counts as a map (A1)."""
    pairs = []
    for severity, name in zip(SEVERITIES, COUNTS):
        pairs += [F.lit(severity), F.col(name)]
    return F.create_map(*pairs)


def category_counts(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Findings per category (A2)."""
    return findings.groupBy(*keys, "category").agg(F.count("*").alias("findings"))


def owasp_counts(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Findings per OWASP prefix (A3)."""
    prefix = owasp_prefix(F.col("owasp_category")).alias("owasp")
    return findings.groupBy(*keys, prefix).agg(F.count("*").alias("findings"))


def risk_profile(findings: DataFrame, keys: list[str]) -> DataFrame:
    """Counts, score, level and trend per key from finding rows, in one pass (A5)."""
    return with_score(severity_counts(confirmed(findings), keys))


def breakdown_rows(
    findings: DataFrame, keys: list[str], order: list[str], limit: int = ROWS_PER_PIECE
) -> DataFrame:
    """Category and OWASP counts per key with bar share and rank.

    One shuffle of partial counts serves both breakdowns. ``order`` names the columns
    that say which finding came first; ties in the count go to the earlier one.
    """
    kinds = F.inline(F.array(
        F.struct(F.lit("category").alias("kind"), F.col("category").alias("name")),
        F.struct(F.lit("owasp").alias("kind"), owasp_prefix(F.col("owasp_category")).alias("name")),
    ))
    counts = (
        confirmed(findings).select(*keys, *order, kinds)
        .groupBy(*keys, "kind", "name")
        .agg(F.count("*").alias("findings"), F.min(F.struct(*order)).alias("_first"))
    )
    ranked = [F.col("findings").desc(), F.col("_first").asc(), F.col("name").asc()]
    group = [*keys, "kind"]
    # A key has no more names than findings, and those are cheaper to count.
    if not any_large_group(findings, keys, limit):
        window = Window.partitionBy(*group).orderBy(*ranked)
        placed = counts.withColumn("rank", (F.row_number().over(window) - 1).cast("bigint"))
        most = F.first("findings").over(window)
        return placed.withColumn("share", _share(most)).drop("_first")
    placed = positions(counts, group, ranked, "rank", limit)
    top = placed.filter("rank = 0").select(
        *[F.col(k).alias(f"_k_{k}") for k in group], F.col("findings").alias("_most"))
    same = F.lit(True)
    for k in group:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return placed.join(top, same).withColumn("share", _share(F.col("_most"))).drop(
        "_first", "_most", *[f"_k_{k}" for k in group])


def _share(most: Column) -> Column:
    return F.floor(F.col("findings") * 100 / most).cast("int")


def file_profiles(scanned: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """Risk profile of each scanned file from its ``hits``, inside the row (A5).

    No shuffle: a file's findings are already together. The maps hold at most one entry
    per category of the rule table.
    """
    known = [*rules, *[r for r in STRUCTURAL_RULES if r not in rules]]
    severity = {r.vuln_id: r.severity for r in known}
    category = {r.vuln_id: r.category for r in known}
    owasp = {r.vuln_id: r.owasp_category.split(" - ")[0] for r in known}

    def counted(names: dict[str, str]) -> Column:
        of_hits = f"transform(hits, h -> try_element_at({map_text(names)}, h.vuln_id))"
        return F.expr(
            f"aggregate({of_hits}, cast(map() as map<string, int>), (seen, name) -> map_concat("
            "map_filter(seen, (k, n) -> k <> name), "
            "map(name, coalesce(try_element_at(seen, name), 0) + 1)))")

    def of_severity(s: str) -> Column:
        ids = ", ".join(quoted(i) for i, found in severity.items() if found == s) or "NULL"
        return F.expr(f"size(filter(hits, h -> h.vuln_id IN ({ids})))")

    kept = [c for c in scanned.columns if c not in ("text", "hits")]
    counts = scanned.select(
        *kept,
        *[of_severity(s).alias(n) for s, n in zip(SEVERITIES, COUNTS)],
        counted(category).alias("category_breakdown"),
        counted(owasp).alias("owasp_breakdown"),
    )
    return with_score(with_total(counts))


def repo_rollup(profiles: DataFrame, keys: list[str]) -> DataFrame:
    """One row per repository from its file profiles (A10).

    The score is the highest file score; level and report are those of that file, the
    greatest path winning ties. Repositories without a scanned file give no row.
    """
    top = F.struct("risk_score", "file_path")
    rolled = (
        profiles.filter(is_scanned_path(F.col("file_path")))
        .groupBy(*keys)
        .agg(
            F.max("risk_score").alias("risk_score"),
            F.max_by("risk_level", top).alias("risk_level"),
            F.max_by("file_path", top).alias("top_file"),
            F.count("*").alias("files_scanned"),
        )
    )
    return rolled.withColumn(
        "lifecycle_status", lifecycle_at_scan(F.col("risk_score"))
    ).withColumn("executive_summary", message(REPO_SUMMARY, F.col("files_scanned")))


def open_scores(scans: DataFrame, findings: DataFrame) -> DataFrame:
    """Score and lifecycle of every scan from its open findings.

    A scan without open findings scores 0 and is Resolved. Likely false positives are
    not left out here, and an unknown severity weighs 1.
    """
    sums = findings.filter(is_open(F.col("status"))).groupBy("scan_id").agg(
        F.sum(open_weight(F.col("severity"))).alias("_raw"),
        F.count_if(F.col("severity") == "Critical").alias("_critical"))
    joined = scans.join(sums, scans["id"] == sums["scan_id"], "left")
    score = score_of(F.coalesce("_raw", F.lit(0)), F.coalesce("_critical", F.lit(0)))
    return joined.select(*[scans[c] for c in scans.columns], score.alias("open_score")).withColumn(
        "open_lifecycle", lifecycle_of_open(F.col("open_score")))


def static_only_scores(counts: DataFrame) -> DataFrame:
    """Ten points per finding up to 100; High when there is any."""
    return counts.withColumn(
        "overall_risk_score", F.least(F.lit(100), F.col("findings") * 10).cast("int")
    ).withColumn("overall_risk_level", F.when(F.col("findings") > 0, "High").otherwise("Low"))


def repo_findings(findings: DataFrame) -> DataFrame:
    """Findings of all scanned files with ``[file] category``."""
    return findings.filter(is_scanned_path(F.col("file_path"))).withColumn(
        "category", F.concat(F.lit("["), base_name(F.col("file_path")), F.lit("] "), F.col("category")))
