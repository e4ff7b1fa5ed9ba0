"""Suffix ranks of many strings by the difference cover {1, 2} modulo 3, as Spark jobs.

A string is a row (sid, names): names are numbers, compared as such. The suffixes at places 1
and 2 modulo 3 are sorted by their first names, WIDE at most; where some that go on have the same,
the ranks are the names of shorter strings, whose suffixes are ranked in the same way, until all
that differ are told apart. A rank that is there once settles what comes before it, so a shorter
string has the ranks that are there several times and the one behind each run of them. The other
suffixes are put between them by their first name, or two, and the rank of what follows.
Nothing but a row per partition goes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from seclake.llm.blocks import released
from seclake.llm.tables import Scratch

# Smaller than any name: stands behind the end of a string.
END = -(1 << 63)
# Names of a sampled suffix that one sort compares, more than 3; shorter strings are made for more.
WIDE = 9


def _samples(strings: DataFrame, width: int) -> DataFrame:
    """sid, at, kind and the next names (n0, n1, ...) from each place that is not 0 modulo 3."""
    names = ["sid", "at", "kind", *[f"n{i}" for i in range(width)]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sid, at, cut = _flat(batch.column(0), batch.column(1))
            value = batch.column(1).flatten().to_numpy()
            sampled = np.flatnonzero(at % 3 != 0)
            for lo in range(0, len(sampled), 50_000):
                pick = sampled[lo:lo + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (
                    sid[pick], at[pick], np.zeros(len(pick), np.int32),
                    value[pick], *_following(value, cut, width - 1, here=pick))], names)

    return strings.select("sid", "names").mapInArrow(released(run), ", ".join(
        ["sid long, at int, kind int", *[f"n{i} long" for i in range(width)]]))


def _flat(sids: pa.Array, lists: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each element of the lists: its sid, its place, and the place behind its list."""
    size = np.diff(lists.offsets.to_numpy())
    end = np.cumsum(size)
    sid = np.repeat(sids.to_numpy(), size)
    at = (np.arange(int(size.sum())) - np.repeat(end - size, size)).astype(np.int32)
    return sid, at, np.repeat(end, size)


def _following(value: np.ndarray, cut: np.ndarray, steps: int, pad: int = END,
               here: np.ndarray | None = None) -> list[np.ndarray]:
    """The values 1, 2, ... places on in the same list, ``pad`` behind its end; of all places, or
    those ``here``."""
    out, here = [], np.arange(len(value)) if here is None else here
    cut = cut[here]
    for k in range(1, steps + 1):
        inside = here + k < cut
        out.append(np.where(inside, value[np.minimum(here + k, max(len(value) - 1, 0))], pad))
    return out


def _with_next(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.RecordBatch | None]]:
    """Each batch with rows, and the one after it."""
    held = None
    for batch in batches:
        if batch.num_rows:
            if held is not None:
                yield held, batch
            held = batch
    if held is not None:
        yield held, None


def ranked(rows: DataFrame, keys: list[str], counted: list[list[int]], name: str,
           scratch: Scratch, taken: list[list[int]] | None = None) -> tuple[DataFrame, bool]:
    """sid, at, kind, ``less``: how many rows sort before by the keys, and ``open``: whether another
    row has the same keys, none of them END; and whether any row is open.

    Only rows of the kinds ``counted[kind]`` are counted for a row of a kind; those of the kinds
    ``taken[kind]`` that have a smaller first key are taken off. Rows are sorted by
    ranges, streamed once and written with their number inside the partition; partitions
    then get their start from a small table of one row each. A range may end between equal
    rows, so no key is too common for it.
    """
    kinds, n_keys = len(counted), len(keys)
    # What is counted before the rows with the same keys, and before those with the same first key.
    grains = [(n_keys, _weights(counted, 1))]
    if taken:
        grains.append((1, _weights(taken, -1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(kinds, np.int64)   # rows so far, by kind
        before = [total] * len(grains)      # rows before the last group of equals
        groups = [0] * len(grains)
        first = last = None
        part, opened = 0, False
        for batch, following in _with_next(batches):
            n = batch.num_rows
            part = batch.column(0)[0].as_py()
            kind = batch.column(3).to_numpy()
            key = np.stack([batch.column(4 + i).to_numpy() for i in range(n_keys)])
            one = np.zeros((n + 1, kinds), np.int64)
            one[np.arange(1, n + 1), kind] = 1
            sums = np.cumsum(one, axis=0) + total
            less, head = np.zeros(n, np.int64), np.zeros(n, np.int32)
            state = np.zeros(n, np.int32)
            for grain, (width, weights) in enumerate(grains):
                new = np.ones(n, bool)
                new[1:] = (key[:width, 1:] != key[:width, :-1]).any(axis=0)
                if last is not None:
                    new[0] = bool((key[:width, 0] != last[:width]).any())
                start = np.maximum.accumulate(np.where(new, np.arange(n), -1))
                at_start = np.where(
                    (start >= 0)[:, None], sums[np.maximum(start, 0)], before[grain][None, :])
                less += (at_start * weights[kind]).sum(axis=1)
                groups_here = groups[grain] + np.cumsum(new)
                head |= (groups_here == 1).astype(np.int32) << grain
                groups[grain], before[grain] = int(groups_here[-1]), at_start[-1]
                if not grain:  # 1: open, 2 and 4: so if the partition before or behind goes on with it
                    then = following is None or any(
                        following.column(4 + i)[0].as_py() != key[i, -1] for i in range(n_keys))
                    state[:] = ~(new & np.append(new[1:], then))
            if first is None:
                first = key[:, 0].copy()
                state[0] |= 2
            if following is None:
                state[-1] |= 4
            state[(key == END).any(axis=0)] = 0
            opened |= bool((state & 1).any())
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), batch.column(3), batch.column(2),
                pa.array(less), pa.array(head), pa.array(state),
                pa.array([None] * n, pa.list_(pa.int64()))], out)
            total, last = sums[-1], key[:, -1].copy()
        if last is not None:
            told = [*first, *last, *total]
            for n_groups, counts in zip(groups, before):
                told += [n_groups, *counts]
            yield pa.RecordBatch.from_arrays([
                pa.array([part], pa.int32()), pa.array([None], pa.int64()), pa.array([-1], pa.int32()),
                pa.array([None], pa.int32()), pa.array([int(opened)], pa.int64()),
                pa.array([0], pa.int32()), pa.array([0], pa.int32()),
                pa.array([told], pa.list_(pa.int64()))], out)

    out = ["part", "sid", "kind", "at", "less", "head", "state", "edge"]
    ordered = rows.repartitionByRange(*keys, "sid").sortWithinPartitions(*keys).select(
        F.spark_partition_id().alias("part"), "sid", "at", "kind", *keys)
    told = scratch.stored(ordered.mapInArrow(released(run), (
        "part int, sid long, kind int, at int, less long, head int, state int, edge array<long>")), name)
    edges = {r["part"]: r for r in told.filter("kind < 0").select("part", "less", "edge").collect()}
    starts, masks, any_open = [], {}, False
    done = np.zeros(kinds, np.int64)  # rows so far
    group = [done] * len(grains)      # rows before the last group of equals
    last = before = None
    for part in sorted(edges):
        edge = edges[part]["edge"]
        head, tail, more = edge[:n_keys], edge[n_keys:2 * n_keys], edge[2 * n_keys + kinds:]
        goes_on = [last is not None and head[:width] == last[:width] for width, _ in grains]
        any_open |= bool(edges[part]["less"]) or (goes_on[0] and END not in head)
        masks[part] = 1 + 2 * goes_on[0]
        if goes_on[0]:
            masks[before] += 4
        begin = [group[grain] if goes_on[grain] else done for grain in range(len(grains))]
        for kind in range(kinds):
            starts.append([part, kind, *[int((counts * weights[kind]).sum()) for grain, (_, weights)
                                         in enumerate(grains) for counts in (done, begin[grain])]])
        for grain in range(len(grains)):
            n_groups, *inside = more[grain * (kinds + 1):(grain + 1) * (kinds + 1)]
            if not (goes_on[grain] and n_groups == 1):
                group[grain] = done + np.array(inside)
        done, last, before = done + np.array(edge[2 * n_keys:2 * n_keys + kinds]), tail, part
    numbers = [f"{which}{grain}" for grain in range(len(grains)) for which in ("base", "first")]
    base = rows.sparkSession.createDataFrame(
        [(*start, masks[start[0]]) for start in starts] or [(0,) * (len(numbers) + 3)],
        ", ".join(["part int, kind int", *[f"{number} long" for number in numbers], "mask int"]))
    less = F.col("less")
    for grain in range(len(grains)):
        less += F.when(F.col("head").bitwiseAND(1 << grain) != 0, F.col(f"first{grain}")).otherwise(
            F.col(f"base{grain}"))
    result = told.filter("kind >= 0").join(F.broadcast(base), ["part", "kind"]).select(
        "sid", "at", "kind", less.alias("less"),
        (F.col("state").bitwiseAND(F.col("mask")) != 0).alias("open"))
    return result, any_open


def _weights(lists: list[list[int]], weight: int) -> np.ndarray:
    out = np.zeros((len(lists), len(lists)), np.int64)
    for kind, others in enumerate(lists):
        out[kind, others] = weight
    return out


def _lists(rows: DataFrame) -> DataFrame:
    """sid and ``found``: (at, less) of the rows of a string."""
    return rows.groupBy("sid").agg(F.collect_list(F.struct("at", "less")).alias("found"))


def _found(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """List sizes, and at and less of all entries."""
    parts = column.flatten()
    return (np.diff(column.offsets.to_numpy()), *[
        parts.field(i).to_numpy(zero_copy_only=False) for i in range(2)])


def _in_order(found: DataFrame) -> DataFrame:
    """sid and ``sample``: less of the rows of a string in order of place (1, 2, 4, 5, ...)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, at, less = _found(batch.column(1))
            by = np.lexsort((at, np.repeat(np.arange(len(size)), size)))
            ends = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(less[by]))],
                ["sid", "sample"])

    return found.mapInArrow(released(run), "sid long, sample array<long>")


class _Kept:
    """Which of the sampled suffixes shorter strings take: open ones (told as -1 - rank) and what
    follows each.

    In a shorter string those at 1 modulo 3 come first, then an END, then those at 2. What follows
    an open suffix there is open too, or differs from all others, or has the end of its string in
    its names, so what is put together behind it decides between no suffixes that differ.
    """

    def __init__(self, sample: pa.Array):
        size = np.diff(sample.offsets.to_numpy())
        self.rank = sample.flatten().to_numpy()
        row = np.repeat(np.arange(len(size)), size)
        place = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        take = self.rank < 0
        take[2:] |= (self.rank[:-2] < 0) & (row[2:] == row[:-2])
        take = np.flatnonzero(take)
        self.take = take[np.lexsort((place[take] % 2, row[take]))]  # numbers of the kept ones
        count = np.bincount(row[take], minlength=len(size))
        ones = np.bincount(row[take[place[take] % 2 == 0]], minlength=len(size))
        self.rows = np.flatnonzero(count)  # numbers of the strings that go on
        self.size = count[self.rows]
        self.ones = (np.cumsum(count) - count + ones)[self.rows]  # kept ones before each END


def _shorter(sampled: DataFrame) -> DataFrame:
    """The strings of the ranks that are not settled."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _Kept(batch.column(1))
            rank = own.rank[own.take]
            values = np.insert(np.where(rank < 0, -1 - rank, rank), own.ones, END)
            ends = np.concatenate(([0], np.cumsum(own.size + 1))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(own.rows)),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(values))], ["sid", "names"])

    return sampled.select("sid", "sample").mapInArrow(released(run), "sid long, names array<long>")


def _settled(joined: DataFrame) -> DataFrame:
    """sid, names and sample, with what shorter strings tell of their places (``inner``) added to
    the open ranks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _Kept(batch.column(2))
            inner = np.delete(batch.column(3).flatten().to_numpy(), own.ones + np.arange(len(own.ones)))
            rank = own.rank[own.take]
            sample = own.rank.copy()
            sample[own.take] = np.where(rank < 0, -1 - rank + inner, rank)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1),
                 pa.ListArray.from_arrays(batch.column(2).offsets, pa.array(sample))],
                ["sid", "names", "sample"])

    return joined.select("sid", "names", "sample", _or_empty("inner")).mapInArrow(
        released(run), "sid long, names array<long>, sample array<long>")


def _or_empty(column: str) -> Column:
    return F.coalesce(column, F.array().cast("array<long>")).alias(column)


def _both(sids: pa.Array, names: pa.Array, sample: pa.Array):
    """sid, place, name of all places, and the rank of each sampled one (-1: another, or none)."""
    sid, at, cut = _flat(sids, names)
    value = names.flatten().to_numpy()
    rank = np.full(len(value), -1, np.int64)
    rank[at % 3 != 0] = sample.flatten().to_numpy()
    return sid, at, cut, value, rank


def _merge_rows(joined: DataFrame) -> DataFrame:
    """The rows that put the suffixes at 0 modulo 3 between the others.

    Kinds 0 and 1 are the suffixes at 0 and 1, by their name and the rank after it; kinds 2 and
    3 those at 0 and 2, by two names and the rank after them. ``which`` keeps the two apart.
    """
    names = ["sid", "at", "kind", "which", "a", "b", "c"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sid, at, cut, value, rank = _both(batch.column(0), batch.column(1), batch.column(2))
            name1, = _following(value, cut, 1)
            rank1, rank2 = _following(rank, cut, 2, -1)
            for kind, mod in ((0, 0), (1, 1), (2, 0), (3, 2)):
                pick = at % 3 == mod
                n = int(pick.sum())
                first = kind < 2
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (
                    sid[pick], at[pick], np.full(n, kind, np.int32),
                    np.full(n, 0 if first else 1, np.int32), value[pick],
                    (rank1 if first else name1)[pick],
                    np.zeros(n, np.int64) if first else rank2[pick])], names)

    return joined.select("sid", "names", "sample").mapInArrow(
        released(run), "sid long, at int, kind int, which int, a long, b long, c long")


def _final_ranks(joined: DataFrame) -> DataFrame:
    """Ranks of all suffixes: what sorts before among the sampled and among the others."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, at, _, _, rank = _both(batch.column(0), batch.column(1), batch.column(2))
            total = np.maximum(rank, 0)
            size, place, less = _found(batch.column(3))
            start = np.cumsum(np.diff(batch.column(1).offsets.to_numpy()))
            start = np.concatenate(([0], start[:-1])) if len(start) else start
            np.add.at(total, np.repeat(start, size) + place, less)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(
                batch.column(1).offsets, pa.array(total))], ["sid", "ranks"])

    return joined.select("sid", "names", "sample", "found").mapInArrow(
        released(run), "sid long, ranks array<long>")


def suffix_ranks(strings: DataFrame, depth: int | None, scratch: Scratch,
                 inside: bool = False) -> DataFrame:
    """sid and ``ranks``: for each place a number that orders the suffixes of all strings.

    ``strings`` (sid, names) is a written table with a row per string, none empty, sid unique.
    A suffix that sorts before another has the smaller rank; equal ones are ordered in any way and
    may share a rank. With a ``depth`` so are those with the same first ``depth`` names. END may
    stand in a string and ends the suffixes before it. With ``inside`` only suffixes with the same
    first name are put in order.
    An empty table gives no rows. What the result is read from is in ``scratch``.
    """
    early, own = Scratch(strings.sparkSession), Scratch(strings.sparkSession)
    width = WIDE if depth is None else min(max(depth, 3), WIDE)
    found, any_open = ranked(
        _samples(strings, width), [f"n{i}" for i in range(width)], [[0]], "samples", early)
    deeper = any_open and (depth is None or depth > width)
    if deeper:
        found = found.withColumn("less", F.when(F.col("open"), -1 - F.col("less")).otherwise(F.col("less")))
    sample = _in_order(_lists(found))
    if deeper:
        sample = own.stored(sample, "ordered")
        early.drop()
        inner = suffix_ranks(own.stored(_shorter(sample), "shorter"),
                             None if depth is None else 1 - (width - depth) // 3, own, True)
    # A string of one name has no sampled place, one that is settled no shorter string.
    joined = strings.join(sample, "sid", "left").select("sid", "names", _or_empty("sample"))
    if deeper:
        joined = _settled(joined.join(inner.withColumnRenamed("ranks", "inner"), "sid", "left"))
    joined = scratch.stored(joined, "sampled")
    early.drop()
    own.drop()
    # Rows are counted by kind, so ``which`` need not come first; names cut into more ranges.
    # Each place is one row of the kinds 0, 1 and 3.
    merged, _ = ranked(
        _merge_rows(joined), ["a", "which", "b", "c"], [[0, 1], [0], [3], [2]], "merged", scratch,
        [[0, 1, 3], [0, 1, 3], [], [0, 1, 3]] if inside else None)
    return _final_ranks(joined.join(_lists(merged), "sid"))
