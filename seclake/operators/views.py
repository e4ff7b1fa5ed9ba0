"""Lists, pages, details and dashboard numbers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from seclake.fixed_values import (
    FINDING_STATUSES,
    LIFECYCLE,
    MODES,
    RECENT_SCANS,
    SCANS_PER_PAGE_MAX,
    SEVERITIES,
)
from seclake.functions.scores import is_open, lifecycle_at_scan, severity_rank
from seclake.functions.texts import camel_case, normal_path
from seclake.operators.ordered import ROWS_PER_PIECE, latest, positions

# A page that ends beyond this row is found by position instead of by one sorted top list.
DEEP_PAGE_ROWS = 100_000
# Findings in one nested list of a scan; a scan with more gives several parts.


# ---- projections and filters ---------------------------------------------------------

def scan_view(scans: DataFrame) -> DataFrame:
    """Scan rows with camelCase names, scanId and normal report path."""
    tidy = scans.withColumn("report_path", normal_path(F.col("report_path")))
    return camel_case(tidy, {"id": "scanId"})


def without_secrets(users: DataFrame) -> DataFrame:
    """User rows without the password hash."""
    return users.drop("password_hash")


def by_ids(rows: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """Look up every asked id; ids without a row come back with ``found`` false."""
    asked = ids.select(F.col(key).alias("_asked")).distinct()
    found = rows.withColumn("_found", F.lit(True))
    return asked.join(found, F.col("_asked") == found[key], "left").select(
        F.col("_asked").alias("asked_id"), F.coalesce("_found", F.lit(False)).alias("found"),
        *[rows[c] for c in rows.columns])


def by_id(rows: DataFrame, value: str, key: str = "id") -> DataFrame:
    """Point lookup."""
    return rows.filter(F.col(key) == value)


def matching(rows: DataFrame, **given) -> DataFrame:
    """Keep rows equal to every value that is given; None filters nothing."""
    tests = [F.col(name) == value for name, value in given.items() if value is not None]
    return reduce(lambda df, test: df.filter(test), tests, rows)


def visible_to(rows: DataFrame, owner: str, user_id: str, role: str,
               wanted: str | None = None) -> DataFrame:
    """Rows one user may see: an admin all (or those of ``wanted``), others their own (P5)."""
    return matching(rows, **{owner: wanted if role == "admin" else user_id})


def own_rows(rows: DataFrame, owner: str, users: DataFrame) -> DataFrame:
    """Rows each non-admin user sees (P5, all users at once).

    An admin sees the whole table, which is not repeated per admin here.
    """
    viewers = users.filter("role <> 'admin'").select(F.col("id").alias("viewer_id"))
    return viewers.join(rows, F.col("viewer_id") == rows[owner])


def open_findings(findings: DataFrame) -> DataFrame:
    """Findings neither fixed nor accepted."""
    return findings.filter(is_open(F.col("status")))


def checked(requests: DataFrame) -> DataFrame:
    """Mark each request valid or not, with the reason (P10).

    Looks at the columns present among score, lifecycle_status, status and mode.
    """
    rules: list[tuple[str, Column, str]] = [
        ("score", F.col("score").between(0, 100), "Score must be an integer between 0 and 100"),
        ("lifecycle_status", F.col("lifecycle_status").isin(*LIFECYCLE),
         "Invalid status. Must be one of: " + ", ".join(LIFECYCLE)),
        ("status", F.col("status").isin(*FINDING_STATUSES),
         "Invalid status. Must be one of: " + ", ".join(FINDING_STATUSES)),
        ("mode", F.col("mode").isin(*MODES), "Invalid mode. Must be one of: " + ", ".join(MODES)),
    ]
    problems = [
        F.when(~F.coalesce(ok, F.lit(False)), F.lit(text))
        for name, ok, text in rules if name in requests.columns]
    return requests.withColumn("reason", F.coalesce(*problems, F.lit(None).cast("string"))) \
        .withColumn("valid", F.col("reason").isNull())


# ---- joins ----------------------------------------------------------------------------

def with_performer(audit: DataFrame, users: DataFrame) -> DataFrame:
    """Add the performer's name; null for one who is no user.

    No broadcast hint: users grow, so Spark decides from their size.
    """
    names = users.select(F.col("id").alias("_user"), F.col("username").alias("performer_name"))
    return audit.join(names, F.col("performed_by") == F.col("_user"), "left").drop("_user")


def severities_by_user(findings: DataFrame, scans: DataFrame) -> DataFrame:
    """Findings per user and severity.

    Findings are counted per scan before the join, so a scan is one row there.
    """
    counts = [F.count_if(F.col("severity") == s).alias(s) for s in SEVERITIES]
    per_scan = findings.groupBy("scan_id").agg(*counts)
    owners = scans.select(F.col("id").alias("_scan"), "user_id")
    per_user = per_scan.join(owners, F.col("scan_id") == F.col("_scan")).groupBy("user_id").agg(
        *[F.sum(s).alias(s) for s in SEVERITIES])
    return per_user.unpivot("user_id", list(SEVERITIES), "severity", "findings")


def scan_details(
    scans: DataFrame, findings: DataFrame, limit: int = ROWS_PER_PIECE
) -> DataFrame:
    """A row per finding of each scan, from position 0 in order of id, severity and the other
    columns; a scan without findings has one row with null position and finding (J4).

    The shape is the same for scans of any size; ``nested_details`` makes lists for some.
    """
    order = ["id", "severity", *[c for c in findings.columns
                                 if c not in ("scan_id", "id", "severity")]]
    placed = positions(
        findings, ["scan_id"], [F.col(c) for c in order], "position", limit).select(
        F.col("scan_id").alias("_scan"), "position",
        F.struct(*[c for c in findings.columns if c != "scan_id"]).alias("finding"))
    return scans.join(placed, scans["id"] == F.col("_scan"), "left").drop("_scan")


def nested_details(details: DataFrame, ids: list[str]) -> DataFrame:
    """The asked scans, each with the list of its findings, empty when there are none."""
    own = [c for c in details.columns if c not in ("position", "finding")]
    listed = F.transform(
        F.array_sort(F.collect_list(F.when(F.col("position").isNotNull(), F.struct(
            "position", "finding")))), lambda f: f["finding"])
    return details.filter(F.col("id").isin(ids)).groupBy(own).agg(
        listed.alias("vulnerabilities"))


# ---- dashboard -----------------------------------------------------------------------

def dashboard_totals(scans: DataFrame) -> DataFrame:
    """Scans, active, resolved and truncated mean score; zeros when empty."""
    return scans.agg(
        F.count("*").alias("total_scans"),
        F.count_if(F.col("lifecycle_status") != "Resolved").alias("active_scans"),
        F.count_if(F.col("lifecycle_status") == "Resolved").alias("resolved_scans"),
        F.coalesce(F.avg("risk_score").cast("int"), F.lit(0)).alias("average_score"))


def _with_zeros(rows: DataFrame, column: str, names: tuple[str, ...],
                n: Column | None = None) -> DataFrame:
    """Count rows per value, with a zero row for every name that may be missing.

    ``n`` counts rows that stand for several.
    """
    spark = rows.sparkSession
    zeros = spark.range(1).select(
        F.explode(F.array(*[F.lit(n) for n in names])).alias(column),
        F.lit(0).cast("bigint").alias("n"))
    count = F.count("*") if n is None else n
    counted = rows.groupBy(column).agg(count.alias("n")).unionByName(zeros)
    return counted.groupBy(column).agg(F.sum("n").alias("count"))


def scans_by_status(scans: DataFrame, n: Column | None = None) -> DataFrame:
    """Scans per lifecycle status in fixed order, unknown statuses after."""
    place = F.array_position(F.array(*[F.lit(s) for s in LIFECYCLE]), F.col("lifecycle_status"))
    counted = _with_zeros(scans, "lifecycle_status", LIFECYCLE, n)
    return counted.withColumn(
        "place", F.when(place > 0, place - 1).otherwise(len(LIFECYCLE)).cast("int"))


def findings_by_severity(findings: DataFrame, n: Column | None = None) -> DataFrame:
    """Findings per severity with zeros, unknown severities dropped."""
    known = findings.filter(F.col("severity").isin(*SEVERITIES))
    return _with_zeros(known, "severity", SEVERITIES, n)


def recent_scans(scans: DataFrame) -> DataFrame:
    """The ten newest scans (O1)."""
    newest = scans.orderBy(F.col("created_at").desc(), "id").limit(RECENT_SCANS)
    return camel_case(newest.select(
        "id", "file_path", "risk_score", "lifecycle_status", "created_at"))


# ---- score history -------------------------------------------------------------------

def _status_of(row_status: Column, score: Column) -> Column:
    return F.coalesce(F.nullif(row_status, F.lit("")), lifecycle_at_scan(score))


def progression(history: DataFrame, limit: int = ROWS_PER_PIECE) -> DataFrame:
    """Line-chart spots of every scan: x is the position in time."""
    placed = positions(
        history, ["scan_id"], [F.col("timestamp"), F.col("id")], "x", limit)
    return placed.select(
        "scan_id", "x", F.col("score").alias("y"),
        F.coalesce("reason", F.lit("")).alias("label"),
        _status_of(F.col("lifecycle_status"), F.col("score")).alias("status"),
        "timestamp")


def progression_metadata(history: DataFrame, scans: DataFrame | None = None) -> DataFrame:
    """Points, least, greatest and current score per scan.

    With ``scans``, those without history get zeros and Safe.
    """
    now = F.struct("timestamp", "id")
    rolled = history.groupBy("scan_id").agg(
        F.count("*").alias("total_data_points"),
        F.min("score").alias("min_score"),
        F.max("score").alias("max_score"),
        F.max_by(F.struct("score", "lifecycle_status"), now).alias("_now"))
    rolled = rolled.select(
        "scan_id", "total_data_points", "min_score", "max_score",
        F.col("_now.score").alias("current_score"),
        _status_of(F.col("_now.lifecycle_status"), F.col("_now.score")).alias("current_status"))
    if scans is None:
        return rolled
    every = scans.select(F.col("id").alias("_scan")).join(
        rolled, F.col("_scan") == F.col("scan_id"), "left")
    numbers = ["total_data_points", "min_score", "max_score", "current_score"]
    return every.select(
        F.col("_scan").alias("scan_id"),
        *[F.coalesce(n, F.lit(0)).alias(n) for n in numbers],
        F.coalesce("current_status", F.lit("Safe")).alias("current_status"))


def latest_state(history: DataFrame) -> DataFrame:
    """Last history row per scan."""
    return latest(history, ["scan_id"], [F.col("timestamp").desc(), F.col("id").desc()])


# ---- sorts and pages -----------------------------------------------------------------

def history_in_order(history: DataFrame, limit: int = ROWS_PER_PIECE) -> DataFrame:
    """Log rows of each scan, oldest first, with their position."""
    return positions(history, ["scan_id"], [F.col("timestamp"), F.col("id")], "position", limit)


def findings_by_severity_text(findings: DataFrame, limit: int = ROWS_PER_PIECE) -> DataFrame:
    """Findings of each scan by severity text, then time."""
    order = [F.col("severity"), F.col("created_at"), F.col("id")]
    return positions(findings, ["scan_id"], order, "position", limit)


def findings_by_rank(
    findings: DataFrame, keys: list[str], order: list[Column], limit: int = ROWS_PER_PIECE
) -> DataFrame:
    """Findings by severity rank, ties in input order."""
    ranked = findings.withColumn("severity_rank", severity_rank(F.col("severity")))
    return positions(ranked, keys, [F.col("severity_rank"), *order], "position", limit)


def rows_of_page(rows: DataFrame, order: list[Column], offset: int, size: int) -> DataFrame:
    """``size`` rows after ``offset`` in the given order.

    Spark's top list keeps offset + size rows in one place, so a deep page is found by
    the position of the rows instead.
    """
    if offset + size <= DEEP_PAGE_ROWS:
        return rows.orderBy(*order).offset(offset).limit(size)
    placed = positions(rows, [], order, "_position")
    inside = F.col("_position").between(offset, offset + size - 1)
    return placed.filter(inside).orderBy("_position").drop("_position")


def page_of_scans(scans: DataFrame, page: int = 1, per_page: int = 20) -> DataFrame:
    """One page of scans, newest first (O2). A page holds at most 100."""
    size = min(per_page, SCANS_PER_PAGE_MAX)
    order = [F.col("created_at").desc(), F.col("id")]
    return scan_view(rows_of_page(scans, order, (max(page, 1) - 1) * size, size))


def scan_page_counters(scans: DataFrame, page: int = 1, per_page: int = 20) -> DataFrame:
    """Counters that go with a page of scans."""
    size = min(per_page, SCANS_PER_PAGE_MAX)
    if size < 1:
        raise ValueError("per_page must be at least 1")
    pages = F.greatest(F.lit(1), F.ceil(F.col("total_items") / size)).cast("bigint")
    return scans.agg(F.count("*").alias("total_items")).select(
        F.lit(page).alias("page"), F.lit(size).alias("per_page"), "total_items",
        pages.alias("total_pages")
    ).withColumn("has_next", F.col("page") < F.col("total_pages")).withColumn(
        "has_previous", F.col("page") > 1)


def page_of_audit(
    audit: DataFrame, users: DataFrame, page: int = 1, per_page: int = 20, **given
) -> DataFrame:
    """One page of audit rows, newest first, with performer names (O3).

    The page is cut before the join: only its rows need a name.
    """
    if per_page < 1:
        raise ValueError("per_page must be at least 1")
    order = [F.col("timestamp").desc(), F.col("id")]
    rows = rows_of_page(matching(audit, **given), order, (max(page, 1) - 1) * per_page, per_page)
    return camel_case(with_performer(rows, users))


def audit_page_counters(audit: DataFrame, page: int = 1, per_page: int = 20, **given) -> DataFrame:
    """Total, page and pages of an audit list."""
    if per_page < 1:
        raise ValueError("per_page must be at least 1")
    pages = F.greatest(F.lit(1), F.ceil(F.col("total") / per_page)).cast("bigint")
    return matching(audit, **given).agg(F.count("*").alias("total")).select(
        "total", F.lit(page).alias("page"), F.lit(per_page).alias("per_page"),
        pages.alias("total_pages"))
