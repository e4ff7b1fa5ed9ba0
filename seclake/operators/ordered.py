"""Row order inside a group, for groups of any size.

A plain window sends a whole group to one task. These functions first look for groups
with more than ``limit`` rows. Rows of such groups are range-partitioned by group and
order, cut into pieces of at most ``limit`` rows, and worked on piece by piece; one
small row per piece carries counts, sums or last values over to the next piece. With no
such group the plan is the plain window.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from seclake.session import cut

ROWS_PER_PIECE = 5_000_000
MAX_HOT_GROUPS = 10_000
PIECE = "_piece"


def large_groups(df: DataFrame, keys: list[str], limit: int) -> tuple[list, DataFrame]:
    """Keys with more than ``limit`` rows, at most MAX_HOT_GROUPS + 1 of them."""
    large = df.groupBy(*keys).count().filter(F.col("count") > limit).drop("count")
    return large.limit(MAX_HOT_GROUPS + 1).collect(), large


def any_large_group(df: DataFrame, keys: list[str], limit: int) -> bool:
    return bool(df.groupBy(*keys).count().filter(F.col("count") > limit).limit(1).count())


def in_pieces(
    df: DataFrame, keys: list[str], order: list, limit: int | None,
    counted: DataFrame | None = None,
) -> tuple[DataFrame, bool]:
    """Add the piece number, rising with the order; tell whether any group was divided.

    ``counted`` may name a cheaper frame with at least as many rows per key, to look for
    large groups in. ``limit`` None says that the groups are known to be small.
    """
    if not keys:
        return _ranged(df, keys, order, limit or ROWS_PER_PIECE), True
    if limit is None:
        return df.withColumn(PIECE, F.lit(0).cast("bigint")), False
    found, hot = large_groups(df if counted is None else counted, keys, limit)
    if not found:
        return df.withColumn(PIECE, F.lit(0).cast("bigint")), False
    if len(found) > MAX_HOT_GROUPS:
        return _ranged(df, keys, order, limit), True
    # At most MAX_HOT_GROUPS keys were found, so this side is small enough to broadcast.
    names = [f"_hot_{k}" for k in keys]
    small = df.sparkSession.createDataFrame(found, hot.schema).toDF(*names)
    same = F.lit(True)
    for key, name in zip(keys, names):
        same = same & df[key].eqNullSafe(F.col(name))
    few = df.join(F.broadcast(small), same, "left_anti")
    many = df.join(F.broadcast(small), same, "left_semi")
    return few.withColumn(PIECE, F.lit(0).cast("bigint")).unionByName(
        _ranged(many, keys, order, limit)), True


def _ranged(df: DataFrame, keys: list[str], order: list, limit: int) -> DataFrame:
    by = [F.col(k) for k in keys] + list(order)
    spread = df.repartitionByRange(*by).sortWithinPartitions(*by)
    # Upper bits of the id are the partition, lower 33 bits the row in it.
    at = F.monotonically_increasing_id()
    row = at.bitwiseAND(F.lit((1 << 33) - 1))
    piece = F.shiftleft(F.shiftright(at, 33), 33) + F.floor(row / F.lit(limit)).cast("bigint")
    return cut(spread.withColumn(PIECE, piece))


def _attach(rows: DataFrame, carried: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    group = keys + [PIECE]
    other = carried.select(
        *[F.col(c).alias(f"_c_{c}") for c in group], *names)
    same = F.lit(True)
    for c in group:
        same = same & rows[c].eqNullSafe(F.col(f"_c_{c}"))
    return rows.join(other, same, "left").drop(*[f"_c_{c}" for c in group])


def _before(keys: list[str]):
    return Window.partitionBy(*keys).orderBy(PIECE).rowsBetween(Window.unboundedPreceding, -1)


def positions(
    df: DataFrame, keys: list[str], order: list[Column], name: str = "position",
    limit: int | None = ROWS_PER_PIECE, counted: DataFrame | None = None,
) -> DataFrame:
    """0-based position of each row in its group."""
    rows, divided = in_pieces(df, keys, order, limit, counted)
    group = keys + [PIECE] if divided else keys
    local = rows.withColumn(
        name, (F.row_number().over(Window.partitionBy(*group).orderBy(*order)) - 1).cast("bigint"))
    if not divided:
        return local.drop(PIECE)
    sizes = rows.groupBy(*group).agg(F.count("*").alias("_n"))
    carried = sizes.withColumn("_ahead", F.sum("_n").over(_before(keys)))
    return _attach(local, carried, keys, ["_ahead"]).withColumn(
        name, F.col(name) + F.coalesce("_ahead", F.lit(0))).drop("_ahead", PIECE)


def running_sums(
    df: DataFrame, keys: list[str], order: list[Column], sums: dict[str, str],
    limit: int | None = ROWS_PER_PIECE, counted: DataFrame | None = None,
) -> DataFrame:
    """For each ``new: column``, the sum over the group up to and including the row."""
    rows, divided = in_pieces(df, keys, order, limit, counted)
    group = keys + [PIECE] if divided else keys
    upto = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = rows.select("*", *[F.sum(c).over(upto).alias(new) for new, c in sums.items()])
    if not divided:
        return local.drop(PIECE)
    ahead = {new: f"_ahead_{new}" for new in sums}
    totals = rows.groupBy(*group).agg(*[F.sum(c).alias(ahead[new]) for new, c in sums.items()])
    carried = totals.select(
        *group, *[F.sum(a).over(_before(keys)).alias(a) for a in ahead.values()])
    joined = _attach(local, carried, keys, list(ahead.values()))
    for new, a in ahead.items():
        joined = joined.withColumn(new, F.col(new) + F.coalesce(a, F.lit(0)))
    return joined.drop(PIECE, *ahead.values())


def previous(
    df: DataFrame, keys: list[str], order: list[str], values: dict[str, str],
    limit: int | None = ROWS_PER_PIECE, counted: DataFrame | None = None,
) -> DataFrame:
    """For each ``new: column``, the value of the row before; null in the first row.

    ``order`` holds column names, all ascending.
    """
    by = [F.col(c) for c in order]
    rows, divided = in_pieces(df, keys, by, limit, counted)
    group = keys + [PIECE] if divided else keys
    window = Window.partitionBy(*group).orderBy(*by)
    local = rows.select("*", *[F.lag(c).over(window).alias(new) for new, c in values.items()])
    if not divided:
        return local.drop(PIECE)
    local = local.withColumn("_at", F.row_number().over(window))
    carry = {new: f"_carry_{new}" for new in values}
    last = rows.groupBy(*group).agg(F.max_by(
        F.struct(*[F.col(c).alias(carry[new]) for new, c in values.items()]),
        F.struct(*order)).alias("_last"))
    one_back = Window.partitionBy(*keys).orderBy(PIECE)
    carried = last.withColumn("_last", F.lag("_last").over(one_back)).select(*group, "_last.*")
    joined = _attach(local, carried, keys, list(carry.values()))
    for new, c in carry.items():
        joined = joined.withColumn(new, F.when(F.col("_at") == 1, F.col(c)).otherwise(F.col(new)))
    return joined.drop(PIECE, "_at", *carry.values())


def latest(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each group in the given (usually descending) order.

    Spark keeps one row per group and task before the shuffle, whatever the group's size.
    """
    first = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn")
