"""Rows by key that a stream keeps in files between its micro-batches."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

BUCKETS = 64
MERGE_EVERY = 16


class StateTable:
    """The latest row of each key, as of any recent micro-batch.

    Micro-batch n reads what came before it and writes the rows it changes as one delta, so a
    repeated micro-batch finds and leaves the same. Rows lie in folders by a hash of their
    whole key: a reader opens only the buckets of the keys it asks for, and no key prefix makes
    one of them large. Every MERGE_EVERY micro-batches a whole table is written anew,
    and what only older micro-batches need is removed.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], schema: StructType,
                 buckets: int = BUCKETS, merge_every: int = MERGE_EVERY):
        self.spark, self.folder, self.keys = spark, folder, keys
        self.schema = schema
        self.buckets, self.merge_every = buckets, merge_every
        self.values = [c for c in schema.fieldNames() if c not in keys]

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _path(self, name: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}")
        return path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _complete(self, name: str) -> bool:
        path, system = self._path(f"{name}/_SUCCESS")
        return system.exists(path)

    def _remove(self, name: str) -> None:
        path, system = self._path(name)
        system.delete(path, True)

    def _write(self, rows: DataFrame, name: str) -> None:
        rows.select(*self.schema.fieldNames(), self._bucket().alias("bucket")).hint(
            "rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(
            f"{self.folder}/{name}")

    def _read(self, name: str, version: int) -> DataFrame:
        stored = StructType([*self.schema.fields, StructField("bucket", IntegerType())])
        return self.spark.read.schema(stored).parquet(f"{self.folder}/{name}").withColumn("_version", F.lit(version))

    def start(self, rows: DataFrame) -> None:
        """What the table holds before the first micro-batch; written once, one row per key."""
        if not self._complete("whole-0"):
            self._write(rows, "whole-0")

    def _merged(self, batch_id: int, whole: int, touched: list[int] | None) -> DataFrame:
        parts = [self._read(f"whole-{whole}", -1)] + [
            self._read(f"delta-{n}", n) for n in range(whole, batch_id)
            if self._complete(f"delta-{n}")]
        rows = reduce(DataFrame.unionByName, parts)
        if touched is not None:
            rows = rows.filter(F.col("bucket").isin(touched))
        return rows.groupBy(*self.keys).agg(F.max_by(
            F.struct(*self.values), "_version").alias("_last")).select(*self.keys, "_last.*")

    def rows_for(self, batch_id: int, wanted: DataFrame) -> DataFrame:
        """The rows of the wanted keys as micro-batch ``batch_id`` found them."""
        whole = batch_id // self.merge_every * self.merge_every
        if whole and not self._complete(f"whole-{whole}"):
            self._write(self._merged(whole, whole - self.merge_every, None), f"whole-{whole}")
            for n in range(max(0, whole - 2 * self.merge_every), whole - self.merge_every):
                self._remove(f"delta-{n}")
            if whole > self.merge_every:
                self._remove(f"whole-{whole - 2 * self.merge_every}")
        keys = wanted.select(*self.keys).distinct()
        touched = [r[0] for r in keys.select(self._bucket()).distinct().collect()]
        return self._merged(batch_id, whole, touched).join(keys, self.keys, "left_semi")

    def put(self, batch_id: int, rows: DataFrame) -> None:
        """The rows that micro-batch ``batch_id`` changed, one per key."""
        self._write(rows, f"delta-{batch_id}")
