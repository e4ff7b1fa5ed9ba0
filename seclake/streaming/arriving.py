"""Scan of arriving files, from any stream of texts or from a tree that grows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession

from seclake.fixed_values import SCANNED_EXTENSIONS
from seclake.plans.file_scan import scan_and_store
from seclake.session import spread
from seclake.sources.tree import list_tree, read_files, with_suffix
from seclake.streaming.feed import finish


def scan_arriving(
    files: DataFrame, folder: str, checkpoint: str, at: Column, mode: str = "upload",
    user_id: str = "system", timeout: int = 3600,
) -> None:
    """Scan each new file and append to the tables, one part per micro-batch.

    A repeated micro-batch replaces its own part, so the tables hold each file once.
    """
    def store(batch: DataFrame, batch_id: int) -> None:
        scan_and_store(spread(batch, "file_path"), folder, f"batch-{batch_id}", at, mode, user_id)

    query = (
        files.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start())
    finish(query, timeout)


_LIST = "path STRING, relative_path STRING, length BIGINT, modified BIGINT"
FILES_PER_LIST = 100_000
LISTS_PER_TRIGGER = 8


def note_new_files(
    spark: SparkSession, root: str, lists: str, suffixes: tuple[str, ...] = SCANNED_EXTENSIONS,
    files_per_list: int = FILES_PER_LIST,
) -> None:
    """Append what is new below ``root`` to the lists of files, or has changed since it was listed.

    Tasks list the tree and compare it with the lists; the driver sees no file. Names that start
    with ``_`` or ``.`` count. A list holds at most ``files_per_list`` files.
    """
    now = with_suffix(list_tree(spark, root), suffixes)
    spark.createDataFrame([], _LIST).write.mode("append").parquet(lists)
    seen = spark.read.schema(_LIST).parquet(lists)
    new = now.join(seen, ["relative_path", "length", "modified"], "left_anti").select(
        "path", "relative_path", "length", "modified")
    if new.limit(1).count():
        new.write.mode("append").option("maxRecordsPerFile", files_per_list).parquet(lists)


def scan_growing_tree(
    spark: SparkSession, root: str, folder: str, state: str, at: Column, mode: str = "upload",
    user_id: str = "system", suffixes: tuple[str, ...] = SCANNED_EXTENSIONS,
    files_per_list: int = FILES_PER_LIST, lists_per_trigger: int = LISTS_PER_TRIGGER,
    timeout: int = 3600,
) -> None:
    """Scan the files that came or changed since the last call, one part per micro-batch.

    ``state`` holds the lists of files and how far the stream has read them. A micro-batch takes
    ``lists_per_trigger`` lists; its files are read by tasks of about equal bytes.
    The language is told from the content. A run that was broken off goes on with the
    lists it had noted, and a repeated micro-batch replaces its own part, so each version of
    a file is stored once. A changed file gets a new scan.
    """
    note_new_files(spark, root, f"{state}/lists", suffixes, files_per_list)

    def store(batch: DataFrame, batch_id: int) -> None:
        scan_and_store(read_files(batch), folder, f"batch-{batch_id}", at, mode, user_id)

    noted = spark.readStream.schema(_LIST).option(
        "maxFilesPerTrigger", lists_per_trigger).parquet(f"{state}/lists")
    finish(noted.writeStream.foreachBatch(store).option(
        "checkpointLocation", f"{state}/progress").trigger(availableNow=True).start(), timeout)
