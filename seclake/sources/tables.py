"""Stored tables and model answers: readers with fixed schemas, and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from seclake.schemas import TABLES


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """One of the five tables with its fixed schema (S3)."""
    return spark.read.schema(TABLES[name]).parquet(f"{folder}/{name}")


def read_tables(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    return {name: read_table(spark, folder, name) for name in TABLES}


def read_answers(spark: SparkSession, folder: str) -> DataFrame:
    """Raw model answers, one file each."""
    return spark.read.option("recursiveFileLookup", "true").text(folder, wholetext=True).select(
        F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("raw"))


def append(rows: DataFrame, folder: str, name: str, run: str) -> None:
    """Append rows as the part ``run`` of a table.

    A part is replaced as a whole, so a job that is started again leaves no copies.
    """
    rows.write.mode("overwrite").parquet(f"{folder}/{name}/run={run}")


def write_reports(
    reports: DataFrame, folder: str, run: str, by: str = "report_date",
) -> None:
    """Append report rows as the part ``run``, in one folder per date.

    A part is replaced as a whole, so a job that is started again leaves no copies.
    Rebalancing gives each date few files and splits a date that holds most of the rows.
    """
    reports.hint("rebalance", F.col(by)).write.partitionBy(by).mode(
        "overwrite").parquet(f"{folder}/run={run}")
