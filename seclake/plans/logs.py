"""Running numbers of the two logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from seclake.operators.maintain import numbered
from seclake.session import cut
from seclake.sources.tables import append

_NUMBERS = "first long, rows long, run string"


def append_log(rows: DataFrame, folder: str, name: str, run: str) -> None:
    """Append rows of a log as the part ``run``, with ids that go on from those given so far
    (S5, S6, F20).

    Rows are numbered by time, then by what they say. The numbers a part takes are noted
    beside the table before it is written, so a repeated run, after a crash too, gives its rows
    the same ids. A run that is repeated with more or fewer rows takes new numbers, so no id is
    ever another row's. One job appends at a time.
    """
    placed = cut(numbered(rows, 0))
    count = placed.count()
    first = _taken(rows.sparkSession, f"{folder}/{name}_numbers", run, count)
    append(placed.withColumn("id", F.col("id") + first - 1), folder, name, run)


def _taken(spark: SparkSession, folder: str, run: str, count: int) -> int:
    """The first number of the run's part, noted in the folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    first = 1
    if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        own = F.col("run") == run
        given = spark.read.schema(_NUMBERS).parquet(folder).agg(
            F.max(F.when(own & (F.col("rows") == count), F.col("first"))).alias("same"),
            F.max(F.col("first") + F.col("rows")).alias("next")).first()
        if given["same"] is not None:
            return given["same"]
        first = given["next"] or 1
    spark.range(1).select(F.lit(first).cast("long").alias("first"),
                          F.lit(count).cast("long").alias("rows")).write.mode(
        "overwrite").parquet(f"{folder}/run={run}")
    return first
