"""Hard negatives by threshold joins over an inverted index with norm bounds (13)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from seclake.llm.blocks import small_batches
from seclake.llm.tables import stored

ANCHORS_AT_ONCE = 4096
ROWS_PER_BLOCK = 4096
ROWS_PER_TASK = 50_000
PANEL = 16
PAIRS_AT_ONCE = 50_000
# Of the largest score an anchor could have; the last round has no threshold.
POSITIVE_ROUNDS = (0.5, 0.25, 0.1, None)
# Of the positive's score; the last round goes down to the window's lower end.
NEGATIVE_ROUNDS = (80, 60, None)
_SLACK = 1e-6


def whole_numbers(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("double"))


def usable(vector: Column) -> Column:
    """A vector whose components are all there and finite."""
    return vector.isNotNull() & F.forall(
        vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < float("inf")))


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    """Vectors as rows; shorter ones end in zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    if len(sizes) and (sizes == dims).all():
        return flat.reshape(len(sizes), dims)
    out = np.zeros((len(sizes), dims))
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _rest_norms(matrix: np.ndarray) -> np.ndarray:
    """Norm of each row from every panel on; the last column is 0."""
    panels = -(-matrix.shape[1] // PANEL)
    out = np.zeros((len(matrix), panels + 1))
    for p in range(panels - 1, -1, -1):
        part = matrix[:, p * PANEL:(p + 1) * PANEL]
        out[:, p] = out[:, p + 1] + np.einsum("ij,ij->i", part, part)
    return np.sqrt(out)


class Index:
    """Inverted index of a block of rows: by panel of dimensions, the values of rows listed there.

    A row is not listed in the dimensions from ``upto`` on if their norm alone can't bring any
    anchor to its threshold. Rows are held with the most listed ones first, so that a panel's
    list is a prefix of the block.
    """

    def __init__(self, matrix: np.ndarray, weight: np.ndarray | None):
        """weight: per panel, the greatest of the anchors' norms from there on by threshold."""
        norms = _rest_norms(matrix)
        if weight is None:
            upto = np.full(len(matrix), norms.shape[1] - 1)
        else:
            covered = norms * weight[None, :] < 1 - _SLACK
            upto = np.argmax(covered, axis=1)  # the last panel is always covered
        self.order = np.argsort(-upto, kind="stable")
        self.matrix, self.norms = matrix[self.order], norms[self.order]
        self.upto = upto[self.order]
        self.lists = [int(np.searchsorted(-self.upto, -p, "left")) for p in range(norms.shape[1] - 1)]

    def search(self, anchors: np.ndarray, rest: np.ndarray, least: np.ndarray) -> Iterator[tuple]:
        """Anchor, row of the block and score of every pair that reaches the anchor's threshold.

        Scores are added up panel by panel. A row goes no further once no anchor can reach its
        threshold with what the remaining norms allow.
        """
        rows = np.arange(len(self.matrix))
        sums = np.zeros((len(anchors), len(rows)))
        slack = _SLACK * (1 + np.abs(np.where(np.isfinite(least), least, 0)))
        floor = least - slack
        for p, listed in enumerate(self.lists):
            live = int(np.searchsorted(rows, listed))
            if not live:
                break
            cut = slice(p * PANEL, (p + 1) * PANEL)
            sums[:, :live] += anchors[:, cut] @ self.matrix[rows[:live], cut].T
            bound = sums + rest[:, p + 1][:, None] * self.norms[rows, p + 1][None, :]
            # A row listed no further keeps its bound from where its list ends.
            keep = (bound >= floor[:, None]).any(axis=0) | (self.upto[rows] <= p)
            if not keep.all():
                rows, sums = rows[keep], sums[:, keep]
        end = self.upto[rows]
        bound = sums + rest[:, end] * self.norms[rows, end][None, :]
        a, at = np.nonzero(bound >= floor[:, None])
        for lo in range(0, len(a), PAIRS_AT_ONCE):
            x, y = a[lo:lo + PAIRS_AT_ONCE], rows[at[lo:lo + PAIRS_AT_ONCE]]
            score = np.einsum("ij,ij->i", anchors[x], self.matrix[y])
            fits = score >= least[x]
            yield x[fits], self.order[y[fits]], score[fits]


def _best(group: np.ndarray, score: np.ndarray, row_id: np.ndarray, most: int) -> np.ndarray:
    """Places of the first ``most`` of each group, by score from the top, ties by id."""
    by = np.lexsort((row_id, -score, group))
    sorted_group = group[by]
    first = np.flatnonzero(np.r_[True, sorted_group[1:] != sorted_group[:-1]]) if len(by) else by
    rank = np.arange(len(by)) - np.repeat(first, np.diff(np.append(first, len(by))))
    return by[rank < most]


def _joined(rows: DataFrame, anchors: pa.Table, dims: np.ndarray, windows: int, most: int,
            same_label: bool) -> DataFrame:
    """slot, row_id, score: per window the best rows of each task, at most ``most``.

    anchors: aid, anchor_id, label, vector, and for each of its windows the least and greatest
    score wanted (``low``, ``high``; empty windows have low above high). slot is
    windows * place of the anchor + window.
    """
    matrix = _matrix(anchors.column("vector"), len(dims))[:, dims]
    rest = _rest_norms(matrix)
    low = np.array(anchors.column("low").to_pylist(), np.float64).reshape(len(matrix), windows)
    high = np.array(anchors.column("high").to_pylist(), np.float64).reshape(len(matrix), windows)
    label, own = anchors.column("label").to_numpy(), anchors.column("anchor_id").to_numpy()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = low.copy()  # rises as windows fill
        held = [np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64)]

        def block(parts: list[pa.RecordBatch]) -> None:
            nonlocal held, wanted
            table = pa.Table.from_batches(parts)
            ids, labels = table.column("row_id").to_numpy(), table.column("label").to_numpy()
            least = np.where(low <= high, wanted, np.inf).min(axis=1)
            live = np.flatnonzero(least < np.inf)
            if not len(live):
                return
            weight = None
            if (least[live] > 0).all():
                weight = (rest[live] / least[live][:, None]).max(axis=0)
            index = Index(_matrix(table.column("vector"), len(dims))[:, dims], weight)
            found = [held]
            for a, y, score in index.search(matrix[live], rest[live], least[live]):
                a = live[a]
                fits = (label[a] == labels[y]) if same_label else (label[a] != labels[y])
                fits &= own[a] != ids[y]
                a, y, score = a[fits], y[fits], score[fits]
                for w in range(windows):
                    inside = (score >= wanted[a, w]) & (score <= high[a, w])
                    found.append([a[inside] * windows + w, score[inside], ids[y[inside]]])
            slot, score, row_id = (np.concatenate(x) for x in zip(*found))
            best = _best(slot, score, row_id, most)
            held = [slot[best], score[best], row_id[best]]
            last = np.bincount(held[0], minlength=wanted.size) >= most
            if last.any():
                lowest = np.full(wanted.size, np.inf)
                np.minimum.at(lowest, held[0], held[1])
                wanted = np.where(last, lowest, wanted.ravel()).reshape(wanted.shape)

        parts, n = [], 0
        for batch in batches:
            parts.append(batch)
            n += batch.num_rows
            if n >= ROWS_PER_BLOCK:
                block(parts)
                parts, n = [], 0
        if n:
            block(parts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(held[0]), pa.array(held[2]), pa.array(held[1].astype(np.int64))],
            ["slot", "row_id", "score"])

    return rows.select("row_id", "label", "vector").mapInArrow(
        run, "slot long, row_id long, score long")


def _round(rows: DataFrame, anchors: DataFrame, dims: np.ndarray, windows: int, most: int,
           same_label: bool) -> DataFrame:
    """aid, window, row_id, score, rank: the best rows of each window, at most ``most``."""
    chunks = [r[0] for r in anchors.select("chunk").distinct().collect()]
    parts = []
    for chunk in sorted(chunks):
        # A chunk has ANCHORS_AT_ONCE rows at most; each task gets it with its code.
        few = anchors.filter(F.col("chunk") == chunk).drop("chunk").orderBy("aid").toArrow()
        found = _joined(rows, few, dims, windows, most, same_label)
        names = rows.sparkSession.createDataFrame(
            [(i, a) for i, a in enumerate(few.column("aid").to_pylist())], "place long, aid long")
        best = Window.partitionBy("slot").orderBy(F.desc("score"), "row_id")
        top = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= most)
        parts.append(top.join(
            F.broadcast(names), F.floor(F.col("slot") / windows) == F.col("place")).select(
            "aid", (F.col("slot") % windows).cast("int").alias("window"), "row_id", "score", "rank"))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return stored(out, "found")


def _energy(rows: DataFrame) -> tuple[np.ndarray, float]:
    """Dimensions, those with the most in them first, and the greatest norm of a row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, norm = np.zeros(0), 0.0
        for batch in batches:
            column = batch.column(0)
            size = int(np.diff(column.offsets.to_numpy()).max(initial=0))
            matrix = _matrix(column, size)
            total = np.pad(total, (0, max(0, size - len(total))))
            total[:size] += np.einsum("ij,ij->j", matrix, matrix)
            norm = max(norm, float(_rest_norms(matrix)[:, 0].max(initial=0)) if size else 0.0)
        yield pa.RecordBatch.from_arrays(
            [pa.array([total.tolist()], pa.list_(pa.float64())), pa.array([norm])],
            ["total", "norm"])

    told = rows.select("vector").mapInArrow(run, "total array<double>, norm double")
    sums = told.select(F.posexplode("total"), "norm").groupBy("pos").agg(
        F.sum("col").alias("total"), F.max("norm").alias("norm")).collect()
    order = sorted(sums, key=lambda r: (-r["total"], r["pos"]))
    return np.array([r["pos"] for r in order], np.int64), max((r["norm"] for r in sums), default=0.0)


def _in_few(rows: DataFrame, n: int, cores: int) -> DataFrame:
    """Fewer partitions, without a shuffle: each task hands on its best rows for every anchor."""
    return rows.coalesce(max(cores, math.ceil(n / ROWS_PER_TASK)))


def _thresholds(anchors: DataFrame, low: Column, high: Column) -> DataFrame:
    return anchors.withColumns({
        "low": F.array(low.cast("double")), "high": F.array(high.cast("double"))})


def hard_negatives(
    rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10,
    low_percent: int = 30, high_percent: int = 90,
) -> DataFrame:
    """For each anchor and positive, the nearest rows of other labels in a band of scores.

    ``rows`` has row_id (long), label and vector (array of double, whole numbers: scores are
    exact up to 2^53). The positives of an anchor are the first rows of its label by inner
    product, ties by id; its own id is not one. The negatives of a positive are the first rows
    of other labels with low_percent * positive <= 100 * score <= high_percent * positive.
    Gives anchor_id, positive_id, rank (from 1), negative_id, positive_score, negative_score.

    Anchors are taken in chunks of ANCHORS_AT_ONCE, against all rows in blocks. Rounds begin
    with a high threshold, where the index leaves out most dimensions and most rows are
    pruned; anchors whose windows are not full then go on with a lower one, at last with none.
    A chunk's answer has positives * negatives rows per anchor and task.

    Rows with a null id, label or vector, or a component that is null or not finite, take no
    part. A vector that is shorter than others ends in zeros. Repeated rows count each, also
    as anchors. An anchor without positives, or with empty bands, gives no rows, as does an
    empty table. Other columns are not read.
    """
    spark = rows.sparkSession
    small_batches(spark)
    ready = rows.select(
        F.col("row_id").cast("long").alias("row_id"), F.col("label").cast("long").alias("label"),
        F.col("vector"), is_anchor.alias("is_anchor")).filter(
        F.col("row_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector")))
    ready = stored(ready, "vectors")
    n, n_anchors = ready.agg(F.count("*"), F.count_if("is_anchor")).first()
    result = "anchor_id long, positive_id long, rank int, negative_id long, " \
             "positive_score long, negative_score long"
    if not n_anchors:
        return spark.createDataFrame([], result)
    dims, greatest = _energy(ready)
    few = _in_few(ready, n, spark.sparkContext.defaultParallelism)
    chunks = math.ceil(n_anchors / ANCHORS_AT_ONCE)
    anchors = stored(ready.filter("is_anchor").repartition(chunks).select(
        F.monotonically_increasing_id().alias("aid"), F.spark_partition_id().alias("part"),
        F.col("row_id").alias("anchor_id"), "label", "vector").withColumn(
        "chunk", F.col("part") * 1_000_000 + F.floor(
            F.col("aid").bitwiseAND(F.lit((1 << 33) - 1)) / ANCHORS_AT_ONCE)).drop("part"), "anchors")

    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x))
    best, left = None, anchors
    for share in POSITIVE_ROUNDS:
        low = norm * (share * greatest) if share is not None else F.lit(float("-inf"))
        found = _round(few, _thresholds(left, low, F.lit(float("inf"))), dims, 1, positives, True)
        if share is None:
            best = found if best is None else best.unionByName(found)
            break
        full = found.groupBy("aid").count().filter(F.col("count") >= positives).select("aid")
        done = found.join(full, "aid", "left_semi")
        best = done if best is None else best.unionByName(done)
        left = stored(left.join(full, "aid", "left_anti"), "left")
        if not left.limit(1).count():
            break
    tops = stored(best.groupBy("aid").agg(F.sort_array(F.collect_list(F.struct(
        "rank", F.col("row_id").alias("positive_id"), F.col("score").alias("positive_score")
    ))).alias("tops")), "positives")  # at most ``positives`` in a list

    # A window per positive; one that is full or empty gets a low above its high.
    windows = anchors.join(tops, "aid").withColumn(
        "tops", F.concat("tops", F.array_repeat(
            F.lit(None).cast("struct<rank:int,positive_id:bigint,positive_score:bigint>"),
            F.lit(positives) - F.size("tops"))))
    closed = F.struct(F.lit(float("inf")).alias("low"), F.lit(float("-inf")).alias("high"))

    def band(top: Column, at: Column, percent: int | None) -> Column:
        s = top["positive_score"]
        low = F.ceil(F.lit(percent or low_percent) * s / 100)
        open_ = F.struct(F.greatest(low, F.ceil(F.lit(low_percent) * s / 100)).cast("double").alias("low"),
                         F.floor(F.lit(high_percent) * s / 100).cast("double").alias("high"))
        return F.when(s.isNull() | F.array_contains(F.col("full"), at), closed).otherwise(open_)

    left = windows.withColumn("full", F.array().cast("array<int>"))
    gathered = None
    for percent in NEGATIVE_ROUNDS:
        bands = F.transform("tops", lambda top, at: band(top, at, percent))
        asked = left.withColumn("bands", bands).select(
            "aid", "anchor_id", "label", "vector", "chunk",
            F.col("bands.low").alias("low"), F.col("bands.high").alias("high"))
        asked = stored(asked.filter(F.exists(
            F.arrays_zip("low", "high"), lambda b: b["low"] <= b["high"])), "asked")
        if not asked.limit(1).count():
            break
        found = _round(few, asked, dims, positives, negatives, False)
        last = percent is None
        filled = found.groupBy("aid", "window").count().filter(F.col("count") >= negatives)
        done = found if last else found.join(filled.drop("count"), ["aid", "window"], "left_semi")
        gathered = done if gathered is None else gathered.unionByName(done)
        if last:
            break
        newly = filled.groupBy("aid").agg(F.collect_list("window").alias("newly"))
        left = stored(left.join(newly, "aid", "left").withColumn("full", F.array_union(
            "full", F.coalesce("newly", F.array().cast("array<int>")))).drop("newly"), "left")
    if gathered is None:
        return spark.createDataFrame([], result)
    pairs = tops.join(anchors.select("aid", "anchor_id"), "aid").select(
        "aid", "anchor_id", F.posexplode("tops").alias("window", "top"))
    return gathered.join(pairs, ["aid", "window"]).select(
        "anchor_id", F.col("top.positive_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"),
        F.col("row_id").alias("negative_id"), F.col("top.positive_score").alias("positive_score"),
        F.col("score").alias("negative_score"))
