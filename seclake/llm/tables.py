"""Intermediate tables in the folder that all machines share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seclake.session import new_folder


def stored(df: DataFrame, name: str) -> DataFrame:
    """The rows as a written table, computed once; a lost executor loses none of them.

    The folder goes when the driver ends.
    """
    spark = df.sparkSession
    folder = new_folder(spark, name)
    df.write.parquet(folder)
    _at_end(spark, folder)
    return spark.read.schema(df.schema).parquet(folder)


def _at_end(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)


class Scratch:
    """Written tables that are removed as soon as no later step reads them.

    Removing them also lets Spark's cleaner see that the shuffles behind them are done.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.folders = spark, []

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        folder = new_folder(self.spark, name)
        df.write.parquet(folder)
        _at_end(self.spark, folder)
        self.folders.append(folder)
        return self.spark.read.schema(df.schema).parquet(folder)

    def drop(self) -> None:
        for folder in self.folders:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
        self.folders = []
        # Shuffle files go when the driver collects the plans that made them.
        self.spark._jvm.System.gc()
