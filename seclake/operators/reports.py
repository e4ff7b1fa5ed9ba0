"""Change logs, report rows and snapshot differences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from seclake.functions.texts import (
    change_line,
    lines_text,
    report_key,
    secure_name,
    split_lines,
)
from seclake.operators.ordered import ROWS_PER_PIECE, positions


def change_log(
    findings: DataFrame, keys: list[str], order: list[Column], limit: int = ROWS_PER_PIECE
) -> DataFrame:
    """One text line per finding, numbered in finding order."""
    placed = positions(findings, keys, order, "change_number", limit)
    return placed.select(*keys, "change_number", change_line(
        F.col("severity"), F.col("category"), F.col("line_number"), F.col("recommendation"),
    ).alias("change"))


def line_changes(original: DataFrame, secure: DataFrame) -> DataFrame:
    """Lines removed (``-``) and added (``+``) per file, with how many times (U4).

    A path may be there more than once on either side, all its texts count. First only paths
    and hashes of the texts are matched; texts on both sides cancel out. The others are
    fetched once each and split; a line before counts +1 and a line after -1 for each time,
    and what does not cancel out is a change.
    """
    sides = original.select("file_path", "text", F.lit(1).alias("step")).unionByName(
        secure.select("file_path", "text", F.lit(-1).alias("step"))).filter(
        "text IS NOT NULL").withColumn("_hash", F.sha2("text", 256))
    changed = sides.groupBy("file_path", "_hash").agg(
        F.sum("step").alias("_times")).filter("_times <> 0")
    texts = sides.select("file_path", "_hash", "text").join(
        changed, ["file_path", "_hash"]).dropDuplicates(["file_path", "_hash"])
    # As in the scanner, a generator keeps the split from being copied into filters.
    steps = texts.selectExpr(
        "file_path", "_times", f"explode(array({lines_text('text')})) AS lines").selectExpr(
        "file_path", "_times", "explode(lines) AS line")
    net = steps.groupBy("file_path", "line").agg(F.sum("_times").alias("net"))
    return net.filter("net <> 0").select(
        "file_path", F.when(F.col("net") > 0, "-").otherwise("+").alias("sign"), "line",
        F.abs("net").alias("copies"))


def line_counts(original: DataFrame, secure: DataFrame) -> DataFrame:
    """Number of lines of each file in both snapshots (U4)."""
    before = original.select(
        "file_path", F.size(split_lines("text")).alias("before"), F.lit(0).alias("after"))
    after = secure.select(
        "file_path", F.lit(0).alias("before"), F.size(split_lines("text")).alias("after"))
    return before.unionByName(after).groupBy("file_path").agg(
        F.sum("before").cast("int").alias("line_count_original"),
        F.sum("after").cast("int").alias("line_count_secure"),
    ).withColumn("secure_file", secure_name(F.col("file_path")))


def report_rows(profiles: DataFrame, at: Column) -> DataFrame:
    """One report row per file, keyed by name and time."""
    return profiles.withColumn("report_key", report_key(F.col("file_path"), at)).withColumn(
        "report_date", at.cast("date"))
