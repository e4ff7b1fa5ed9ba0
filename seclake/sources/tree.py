"""Source trees on a shared file system."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import reduce
from itertools import chain, islice

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from seclake.fixed_values import SCANNED_EXTENSIONS
from seclake.session import cut

_LISTED = (
    "path STRING, is_folder BOOLEAN, length BIGINT, modified BIGINT, part INT, "
    "names ARRAY<STRING>")
_COLUMNS = ["path", "is_folder", "length", "modified", "part", "names"]
_LEVEL = "path STRING, part INT, names ARRAY<STRING>"
_ROWS = 5_000
NAMES_PER_TASK = 10_000
BYTES_PER_TASK = 128 << 20
_READ_BYTES = 32 * 1024 * 1024


def _file_system(folder: str):
    """File system, path inside it, and what comes before that path."""
    from pyarrow import fs
    system, inside = fs.FileSystem.from_uri(folder)
    return system, inside, folder[: len(folder) - len(inside)]


def _names(folder: str) -> Iterator[str]:
    """Names in a folder, one by one where the file system allows it."""
    from pyarrow import fs
    system, inside, _ = _file_system(folder)
    if isinstance(system, fs.LocalFileSystem):
        with os.scandir(inside) as entries:
            for entry in entries:
                yield entry.name
    else:
        for entry in system.get_file_info(fs.FileSelector(inside)):
            yield entry.base_name


def _list_folders(names_per_task: int):
    """List folders, or some names of a large one.

    A folder with more names than a task should look up is read once and handed back in parts,
    each with its names.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        def frame(rows: list) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=_COLUMNS).astype({
                "path": "object", "is_folder": "bool", "length": "Int64", "modified": "Int64",
                "part": "int32", "names": "object"})

        def parts(folder: str, names: Iterator[str]) -> Iterator[pd.DataFrame]:
            pieces = iter(lambda: list(islice(names, names_per_task)), [])
            numbered = ((folder, True, None, None, k, piece) for k, piece in enumerate(pieces))
            for rows in iter(lambda: list(islice(numbered, max(1, _ROWS // names_per_task))), []):
                yield frame(rows)

        for batch in batches:
            for folder, own in zip(batch["path"], batch["names"]):
                if own is None:
                    names = _names(folder)
                    own = list(islice(names, names_per_task + 1))
                    if len(own) > names_per_task:
                        yield from parts(folder, chain(own, names))
                        continue
                system, inside, prefix = _file_system(folder)
                own = [f"{inside.rstrip('/')}/{name}" for name in own]
                for lo in range(0, len(own), _ROWS):
                    yield frame([
                        (prefix + e.path, e.type == fs.FileType.Directory, e.size, e.mtime_ns, 0, None)
                        for e in system.get_file_info(own[lo:lo + _ROWS])
                        if e.type != fs.FileType.NotFound])

    return run


def _plain_root(root: str) -> str:
    return re.sub(r"^file:/+", "/", root).rstrip("/")


def list_tree(spark: SparkSession, root: str, names_per_task: int = NAMES_PER_TASK) -> DataFrame:
    """Every file below ``root``: path, path relative to root, length, time of change.

    Folders are listed by tasks, one level of the tree at a time. The names of a folder with more
    than ``names_per_task`` are read once, by one task, and dealt out in parts of that many, which
    tasks look up side by side. Unlike Spark's own listing this also sees names that start with
    ``_`` or ``.``, such as ``__init__.py``. A file that goes while it runs may be left out.
    """
    root = _plain_root(root)
    level = spark.createDataFrame([(root, 0, None)], _LEVEL)
    levels = []
    while True:
        listed = cut(level.mapInPandas(_list_folders(names_per_task), _LISTED))
        levels.append(listed.filter("not is_folder"))
        folders = listed.filter("is_folder").select("path", "part", "names")
        named = F.sum(F.coalesce(F.size("names"), F.lit(1)))
        left = folders.agg(F.coalesce(named, F.lit(0))).first()[0]
        if left == 0:
            break
        tasks = max(listed.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism,
                    -(-left // NAMES_PER_TASK))
        level = folders.repartition(tasks, "path", "part")
    files = reduce(DataFrame.unionByName, levels)
    return files.select(
        "path", F.substring("path", F.lit(len(root) + 2), F.length("path")).alias("relative_path"),
        "length", "modified")


def tree_total(files: DataFrame) -> DataFrame:
    """Number of files and their bytes."""
    return files.agg(
        F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))


def _read_whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names, texts, held = [], [], 0
    for batch in batches:
        for path, name in zip(batch["path"], batch["relative_path"]):
            system, inside, _ = _file_system(path)
            with system.open_input_stream(inside) as stream:
                text = stream.read().decode("utf-8", errors="replace")
            names.append(name)
            texts.append(text)
            held += len(text)
            if held > _READ_BYTES:
                yield pd.DataFrame({"file_path": names, "text": texts})
                names, texts, held = [], [], 0
    if names:
        yield pd.DataFrame({"file_path": names, "text": texts})


def read_files(files: DataFrame, bytes_per_task: int = BYTES_PER_TASK) -> DataFrame:
    """Relative path (as file_path) and whole text of listed files.

    Tasks get about as many bytes each; their number follows from the bytes in the list.
    """
    total, n = files.agg(F.coalesce(F.sum(F.col("length") + 4096), F.lit(0)), F.count("*")).first()
    cores = files.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(n, max(cores, -(-total // bytes_per_task))))
    return files.select("path", "relative_path").repartition(
        tasks, F.xxhash64("path")).mapInPandas(_read_whole, "file_path STRING, text STRING")


def with_suffix(files: DataFrame, suffixes: tuple[str, ...]) -> DataFrame:
    return files.filter(reduce(
        lambda a, b: a | b, [F.col("relative_path").endswith(s) for s in suffixes]))


def read_tree(
    spark: SparkSession, root: str, suffixes: tuple[str, ...] = SCANNED_EXTENSIONS
) -> DataFrame:
    """Files below ``root`` with one of the suffixes: file_path and whole text.

    Tasks list the tree and tasks read it; the driver holds no list of files.
    """
    return read_files(with_suffix(list_tree(spark, root), suffixes))
