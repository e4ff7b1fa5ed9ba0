"""Current-state tables of which a change rewrites only the buckets it touches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from seclake.operators.maintain import updated

BUCKETS = 1024
_MANIFEST = "bucket int, held int, run string"
# A change of up to this size, as text and 64 bytes a row, is sent to every task.
SENT_BYTES = 64 << 20


class BucketedTable:
    """Rows in folders by a hash of the column ``by``, with versions.

    A version holds the buckets that its change rewrote; a manifest, one row per bucket, names
    the version that holds each. Files are never changed: readers see the old version until the
    new manifest is complete, and a job that died before that is simply run again. A run that
    is done already does nothing. Files of untouched buckets stay as they are.

    A bucket with most of the rows is written in many files. Rows with a null in ``by`` are
    kept in one bucket and no change finds them. One job changes a table at a time.

    Rows are shuffled once, when the table is made. A change whose keys or new values take up
    to ``SENT_BYTES`` goes to the rows, whose tasks write them back to their buckets; only a
    larger one is joined by a shuffle of the rows it touches.
    """

    def __init__(self, spark: SparkSession, folder: str, by: str, schema: StructType):
        self.spark, self.folder, self.by, self.schema = spark, folder, by, schema

    def create(self, rows: DataFrame, buckets: int = BUCKETS) -> None:
        """Version 0, written once."""
        if self.version() is None:
            self._store(0, rows, {b: 0 for b in range(buckets)}, set(range(buckets)), "created")

    def version(self) -> int | None:
        """The last complete version."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifest")
        system = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not system.exists(path):
            return None
        done = [int(status.getPath().getName().split("=")[1]) for status in system.listStatus(path)
                if system.exists(self.spark._jvm.org.apache.hadoop.fs.Path(
                    status.getPath(), "_SUCCESS"))]
        return max(done, default=None)

    def rows(self, version: int | None = None) -> DataFrame:
        """The table as of a version, the last if none is named."""
        version = self.version() if version is None else version
        return self._read(self._held(version))

    def delete(self, keys: DataFrame, run: str) -> list[int]:
        """Without the rows whose ``by`` is in ``keys`` (J5). Gives the buckets rewritten."""
        gone = keys.select(F.col(self.by)).filter(F.col(self.by).isNotNull()).distinct()

        def change(rows: DataFrame, small: bool) -> DataFrame:
            named = gone.select(F.col(self.by).alias("_gone"))
            named = F.broadcast(named) if small else named
            return rows.join(named, rows[self.by] == F.col("_gone"), "left_anti")

        return self._change(gone, change, run)

    def merge(self, updates: DataFrame, run: str, key: str | None = None) -> list[int]:
        """New values for rows whose ``key`` is in ``updates``, as ``updated`` gives them.

        ``updates`` has ``by`` too, where that is not the key. Gives the buckets rewritten.
        """
        key = key or self.by
        news = updates.drop(*{self.by} - {key})
        return self._change(updates, lambda rows, small: updated(rows, news, key, small), run)

    def _bucket(self, count: int) -> Column:
        return F.pmod(F.xxhash64(self.by), F.lit(count)).cast("int")

    def _held(self, version: int) -> dict[int, int]:
        """The version that holds each bucket; -1 for an empty one. As many rows as buckets."""
        return {r["bucket"]: r["held"] for r in self.spark.read.schema(_MANIFEST).parquet(
            f"{self.folder}/manifest/version={version}").collect()}

    def _read(self, held: dict[int, int]) -> DataFrame:
        paths = [f"{self.folder}/data/version={v}/bucket={b}" for b, v in sorted(held.items()) if v >= 0]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def _change(self, touching: DataFrame, change: Callable[[DataFrame, bool], DataFrame],
                run: str) -> list[int]:
        before = self.version()
        runs = self.spark.read.schema(_MANIFEST).parquet(*[
            f"{self.folder}/manifest/version={v}" for v in range(before + 1)])
        if runs.filter(F.col("run") == run).limit(1).count():
            return []
        held = self._held(before)
        text = F.concat_ws("", *[F.col(c).cast("string") for c in touching.columns])
        bucket = F.when(F.col(self.by).isNotNull(), self._bucket(len(held)))
        found = {r[0]: r[1] for r in touching.groupBy(bucket).agg(
            F.sum(F.octet_length(text) + 64)).collect()}
        open_ = {b: v for b, v in held.items() if b in found and v >= 0}
        small = sum(found.values()) <= SENT_BYTES
        self._store(before + 1, change(self._read(open_), small), held, set(open_), run,
                    in_place=small)
        return sorted(open_)

    def _store(self, version: int, rows: DataFrame, held: dict[int, int], touched: set[int],
               run: str, in_place: bool = False) -> None:
        """Write the touched buckets; rows that come bucket by bucket stay ``in_place``."""
        folder = f"{self.folder}/data/version={version}"
        rows = rows.select(*self.schema.names, self._bucket(len(held)).alias("bucket"))
        rows = rows if in_place else rows.hint("rebalance", "bucket")
        rows.write.mode("overwrite").partitionBy("bucket").parquet(folder)
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        written = {int(status.getPath().getName().split("=")[1]) for status in path.getFileSystem(
            self.spark._jsc.hadoopConfiguration()).listStatus(path) if status.isDirectory()}
        now = [(b, (version if b in written else -1) if b in touched else v, run)
               for b, v in held.items()]
        self.spark.createDataFrame(now, _MANIFEST).coalesce(1).write.mode("overwrite").parquet(
            f"{self.folder}/manifest/version={version}")
