"""The dashboard of stored scans, from counts that are kept for each part."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from seclake.fixed_values import RECENT_SCANS
from seclake.operators import views
from seclake.schemas import TABLES
from seclake.session import cut
from seclake.sources.tree import list_tree

_OF = "files BIGINT, mark BIGINT, part STRING"
_KEPT = {
    "scans_by_status": (
        "scans", f"lifecycle_status STRING, n BIGINT, scored BIGINT, score BIGINT, {_OF}"),
    "scans_newest": (
        "scans", "id STRING, file_path STRING, risk_score INT, lifecycle_status STRING, "
                 f"created_at TIMESTAMP_NTZ, {_OF}"),
    "vulnerabilities_by_severity": ("vulnerabilities", f"severity STRING, n BIGINT, {_OF}"),
}


def stored_parts(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """part (its folder's name), files and mark of each part of a table.

    The mark is of names, lengths and times of change, so a part that is written again has
    another one. Tasks list the folders.
    """
    files = list_tree(spark, f"{folder}/{name}").filter(
        ~F.col("relative_path").rlike("(^|/)[_.]") & F.col("relative_path").startswith("run="))
    return cut(files.groupBy(F.substring_index("relative_path", "/", 1).alias("part")).agg(
        F.count("*").alias("files"),
        F.bit_xor(F.xxhash64("relative_path", "length", "modified")).alias("mark")))


def _noted(spark: SparkSession, folder: str, kept: str) -> DataFrame:
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{kept}")
    schema = _KEPT[kept][1]
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{folder}/{kept}")


def _summed(rows: DataFrame, kept: str) -> DataFrame:
    """What is kept of a part's rows."""
    if kept == "scans_by_status":
        return rows.groupBy("part", "lifecycle_status").agg(
            F.count("*").alias("n"), F.count("risk_score").alias("scored"),
            F.sum(F.col("risk_score").cast("long")).alias("score"))
    if kept == "vulnerabilities_by_severity":
        return rows.groupBy("part", "severity").agg(F.count("*").alias("n"))
    newest = Window.partitionBy("part").orderBy(F.col("created_at").desc(), "id")
    return rows.select(
        "part", "id", "file_path", "risk_score", "lifecycle_status", "created_at").withColumn(
        "_place", F.row_number().over(newest)).filter(F.col("_place") <= RECENT_SCANS).drop("_place")


def kept_counts(
    spark: SparkSession, folder: str, kept: str, parts: DataFrame,
) -> tuple[DataFrame, list[str]]:
    """What is kept of each of the ``parts``, and those that had to be counted for it.

    Only parts that were added or written again since are read, as many names as these come to
    the driver. What is kept of a part is replaced as a whole and names the files it is of, so
    a job that died, or that met a part just being replaced, leaves nothing that counts.
    """
    table, schema = _KEPT[kept]
    new = parts.join(_noted(spark, folder, kept).select("part", "files", "mark").distinct(),
                     ["part", "files", "mark"], "left_anti").collect()
    if new:
        # The path of a row's file comes with escapes.
        path = F.url_decode(F.replace("_metadata.file_path", F.lit("+"), F.lit("%2B")))
        rows = spark.read.schema(TABLES[table]).parquet(
            *[f"{folder}/{table}/{r['part']}" for r in new]).withColumn(
            "part", F.element_at(F.split(path, "/"), -2))
        of = parts.select("part", "files", "mark")
        _summed(rows, kept).join(of, "part").write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{folder}/{kept}")
    now = _noted(spark, folder, kept).join(
        parts.select("part", "files", "mark"), ["part", "files", "mark"], "left_semi")
    return now, sorted(r["part"] for r in new)


def stored_dashboard(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """Totals, status counts, severity counts and newest scans of all stored parts.

    The same as ``dashboard`` of the whole tables; the work is that of the parts that are new.
    """
    scans = stored_parts(spark, folder, "scans")
    found = stored_parts(spark, folder, "vulnerabilities")
    by_status, _ = kept_counts(spark, folder, "scans_by_status", scans)
    newest, _ = kept_counts(spark, folder, "scans_newest", scans)
    by_severity, _ = kept_counts(spark, folder, "vulnerabilities_by_severity", found)
    resolved = F.col("lifecycle_status") == "Resolved"
    totals = by_status.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("total_scans"),
        F.coalesce(F.sum(F.when(~resolved, F.col("n"))), F.lit(0)).alias("active_scans"),
        F.coalesce(F.sum(F.when(resolved, F.col("n"))), F.lit(0)).alias("resolved_scans"),
        F.coalesce(F.try_divide(F.sum("score"), F.sum("scored")).cast("int"), F.lit(0)).alias(
            "average_score"))
    return {
        "totals": totals,
        "statuses": views.scans_by_status(by_status, F.sum("n")),
        "severities": views.findings_by_severity(by_severity, F.sum("n")),
        "recent": views.recent_scans(newest),
    }
