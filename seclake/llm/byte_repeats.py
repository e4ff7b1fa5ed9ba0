"""Removing repeated byte strings with suffix ranks by difference cover (11).

The suffixes that are ranked start at anchors: places whose next GRAM bytes have the least value
of some SPAN bytes in a row, so equal texts have them at the same places. A name stands for
the bytes from an anchor to behind the next one. Of all places between, the suffix is the bytes
up to the next anchor and that anchor's suffix.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seclake.llm import difference_cover
from seclake.llm.blocks import (
    id_key, mix, released, small_batches, span_hashes, text_bytes, text_key,
)
from seclake.llm.tables import Scratch, stored
from seclake.session import spread

WINDOW = 200
GRAM = 32
# Windows in a row that are looked for as one before each is looked for on its own.
GROUP = 8
TOGETHER = 1 << 16
SLICE_BYTES = 4 << 20
_MOST = np.uint32(0xFFFFFFFF)
_BYTE_ORDER = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)
_FACTORS = (0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F, 0x165667B1)
_OTHER_BYTES = ((np.arange(256) * 167 + 13) & 255).astype(np.uint8)


class Shape:
    """Lengths that follow from the window's. Any two equal windows have an anchor in common.

    span: bytes whose least gram is an anchor. seen: bytes from an anchor that every window with
    it has. name: bytes that an anchor's name stands for, which settle where the next one is.
    deep: bytes that settle whether all windows up to the next anchor are there again.
    """

    def __init__(self, window: int):
        self.window = window
        self.span = window * 17 // 25
        self.runs = self.span - GRAM + 1
        self.seen = window - self.runs + 1
        self.name = self.span + 2
        self.deep = window + self.runs


def _gram_values(data: np.ndarray) -> np.ndarray:
    """A number, not 0, of each GRAM bytes in a row. It only puts grams in order: equal numbers of
    different grams make both anchors."""
    out, width = _BYTE_ORDER[data], 1
    for factor in _FACTORS:
        out = out[:-width] * np.uint32(factor) + out[width:]
        width *= 2
    return out | np.uint32(1)


def _sliding(values: np.ndarray, width: int, best) -> np.ndarray:
    """The least (or greatest) of every ``width`` values in a row."""
    out, have = values, 1
    while have < width and len(out):
        step = min(have, width - have)
        out = best(out[:-step], out[step:])
        have += step
    return out


class Text:
    """One text's bytes with its anchors, and what was asked for of the bytes behind them."""

    def __init__(self, data: np.ndarray, shape: Shape, values: np.ndarray, least: np.ndarray,
                 anchors: np.ndarray, spans: np.ndarray | None):
        self.data, self.shape = data, shape
        self.values, self.least, self.anchors = values, least, anchors
        self.spans = spans
        self.windows = max(0, len(data) - shape.window + 1)

    def seen(self) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of the anchors that a window can have, and the value of the bytes they share."""
        fits = np.flatnonzero(self.anchors + self.shape.seen <= len(self.data))
        return fits, self.spans[fits]

    def named(self) -> np.ndarray:
        """The number of bytes that the name of each anchor stands for."""
        return np.minimum(self.shape.name, len(self.data) - self.anchors)

    def names(self) -> tuple[np.ndarray, np.ndarray]:
        """Name of each anchor, and the number of bytes it stands for."""
        at = self.anchors
        gap = np.diff(at, append=at[-1:]).astype(np.uint64)
        return mix(self.spans + gap).view(np.int64) | 1, self.named()

    def first_least(self, p: np.ndarray) -> np.ndarray:
        """Number of the anchor with the least value of each of these windows, the first of equals."""
        number, least = np.searchsorted(self.anchors, p), self.least[p]
        # Windows in a row with the same next anchor and least value have the same one.
        new = np.ones(len(p), bool)
        new[1:] = (number[1:] != number[:-1]) | (least[1:] != least[:-1])
        new = np.flatnonzero(new)
        number, least, size = number[new], least[new], np.diff(np.append(new, len(p)))
        open_ = np.arange(len(new))
        while len(open_):
            open_ = open_[self.values[self.anchors[number[open_]]] != least[open_]]
            number[open_] += 1
        return np.repeat(number, size)

    def possible(self, good: np.ndarray) -> np.ndarray:
        """Whether each window has an anchor among the ones of these numbers."""
        only = np.full(len(self.values), _MOST, np.uint32)
        at = self.anchors[good]
        only[at] = self.values[at]
        return _sliding(only, self.shape.runs, np.minimum)[:self.windows] == self.least[:self.windows]


def _texts(column: pa.Array) -> Iterator[np.ndarray]:
    at, raw = text_bytes(column)
    for lo, hi in zip(at[:-1], at[1:]):
        yield raw[lo:hi]


def _slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Parts of a batch whose texts have SLICE_BYTES together, or one text alone."""
    at, _ = text_bytes(column)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + SLICE_BYTES, "right")) - 1)
        yield lo, hi
        lo = hi


def _found(column: Iterator[np.ndarray], shape: Shape, length: int | None = None) -> Iterator[Text]:
    """The texts with their anchors, worked out for some TOGETHER bytes of short texts at once.

    ``length``: of how many bytes from each anchor, or to the end of its text, to tell a value; as
    many as a name stands for if not given.
    """
    length = shape.name if length is None else length
    held, size = [], 0
    for data in column:
        held.append(data)
        size += len(data)
        if size >= TOGETHER:
            yield from _block(held, shape, length)
            held, size = [], 0
    if held:
        yield from _block(held, shape, length)


def _block(texts: list[np.ndarray], shape: Shape, length: int) -> Iterator[Text]:
    ends = np.cumsum([len(data) for data in texts]).tolist()
    data, starts = np.concatenate(texts), [0, *ends[:-1]]
    none = np.zeros(0, np.uint32)
    if max(map(len, texts)) < shape.window:
        values = least = none
        anchors, cuts = np.zeros(0, np.int64), [0] * (len(texts) + 1)
    else:
        values = _gram_values(data)
        least = _sliding(values, shape.runs, np.minimum)
        # Runs of grams that lie in one text; the others count as no run.
        inside = np.zeros(len(least) + 2 * (shape.runs - 1), np.uint32)
        for lo, hi in zip(starts, ends):
            if hi - lo >= shape.window:
                inside[shape.runs - 1 + lo:shape.runs + hi - shape.span] = least[lo:hi - shape.span + 1]
        reach = _sliding(inside, shape.runs, np.maximum)
        anchors = np.flatnonzero(reach == values)
        cuts = np.searchsorted(anchors, [*starts, len(data)]).tolist()
    spans = None
    if length:
        upto = np.repeat(ends, np.diff(cuts))
        spans = span_hashes(data, anchors, np.minimum(anchors + length, upto))
    for i, (lo, hi) in enumerate(zip(starts, ends)):
        whole = hi - lo >= shape.window
        yield Text(texts[i], shape, values[lo:hi - GRAM + 1] if whole else none,
                   least[lo:hi - shape.span + 1] if whole else none,
                   anchors[cuts[i]:cuts[i + 1]] - lo,
                   spans[cuts[i]:cuts[i + 1]] if length else None)


def _lists(parts: list[np.ndarray], kind) -> pa.Array:
    ends = np.concatenate(([0], np.cumsum([len(p) for p in parts]))).astype(np.int32)
    return pa.ListArray.from_arrays(
        pa.array(ends), pa.array(np.concatenate([np.zeros(0, kind), *parts]).astype(kind)))


def _each(column: pa.Array) -> Iterator[np.ndarray]:
    """The lists of a column without nulls."""
    ends, values = column.offsets.to_numpy(), column.values.to_numpy()
    for lo, hi in zip(ends[:-1], ends[1:]):
        yield values[lo:hi]


def _together(batches: Iterator[pa.RecordBatch], rows: int = 50_000) -> Iterator[pa.RecordBatch]:
    """The same rows in fewer batches: each one costs a message."""
    held, size = [], 0
    for batch in batches:
        held.append(batch)
        size += batch.num_rows
        if size >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held, size = [], 0
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(
        docs[doc_id].alias("doc_id"), docs[text].alias("text"), id_key(docs[doc_id]).alias("i"),
        F.xxhash64(F.lit("text"), docs[text]).alias("k"), text_key(docs[text]).alias("t"))


def _index(rows: DataFrame, shape: Shape) -> DataFrame:
    """i, k, t, n_bytes, and per anchor a window can have its number and the value shared."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers, values, size = [], [], []
            for found in _found(_texts(batch.column(3)), shape, shape.seen):
                number, value = found.seen() if found.windows else (np.zeros(0), np.zeros(0, np.uint64))
                numbers.append(number)
                values.append(value.view(np.int64))
                size.append(len(found.data))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(size, pa.int32()), _lists(numbers, np.int32),
                 _lists(values, np.int64)], ["i", "k", "t", "n_bytes", "numbers", "seen"])

    return rows.select("i", "k", "t", "text").mapInArrow(
        released(run), "i long, k long, t long, n_bytes int, numbers array<int>, seen array<long>")


def _strings(joined: DataFrame, shape: Shape) -> DataFrame:
    """For each text with windows that may repeat: its names, in order, with their anchors' numbers.

    Only anchors within reach of such windows are in; where some are left out, a name that is
    nowhere else (number -1) stands between. ``needs`` tells how many names ``deep`` bytes take.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in _slices(batch.column(0)):
                piece = batch.slice(lo, hi - lo)
                all_names, all_numbers, all_needs, rows = [], [], [], []
                found = _found(_texts(piece.column(0)), shape)
                for row, (text, good) in enumerate(zip(found, _each(piece.column(3)))):
                    data = text.data
                    windows = text.possible(good)
                    near = np.zeros(len(data) + 1, np.int64)
                    p = np.flatnonzero(windows)
                    if not len(p):
                        continue
                    np.add.at(near, np.maximum(p - shape.runs, 0), 1)
                    np.add.at(near, np.minimum(p + shape.deep, len(data)), -1)
                    use = np.flatnonzero((np.cumsum(near) > 0)[text.anchors])
                    names, size = text.names()
                    at = text.anchors
                    reach = np.searchsorted(at + size, at[use] + shape.deep, "left")
                    needs = np.minimum(reach, len(at) - 1) - use + 1
                    gaps = np.flatnonzero(np.diff(use) > 1) + 1
                    lone = mix(np.full(len(gaps), piece.column(1)[row].as_py(), np.int64).astype(np.uint64)
                               * np.uint64(0x9E3779B97F4A7C15) + use[gaps].astype(np.uint64))
                    all_names.append(np.insert(names[use], gaps, lone.view(np.int64) & ~np.int64(1)))
                    all_numbers.append(np.insert(use, gaps, -1))
                    all_needs.append(np.insert(needs, gaps, 0))
                    rows.append(row)
                if rows:
                    some = piece.take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays(
                        [some.column(1), some.column(2), some.column(0), some.column(3),
                         _lists(all_names, np.int64), _lists(all_numbers, np.int32),
                         _lists(all_needs, np.int32)],
                        ["sid", "copies", "text", "good", "names", "numbers", "needs"])

    return joined.select("text", "did", "copies", "good").mapInArrow(released(run), (
        "sid long, copies int, text string, good array<int>, names array<long>, "
        "numbers array<int>, needs array<int>"))


def _prefixes(joined: DataFrame) -> DataFrame:
    """sid, number, rank and the first names of each ranked suffix, as many as it needs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = np.diff(batch.column(1).offsets.to_numpy())
            names = batch.column(1).flatten().to_numpy()
            cut = np.repeat(np.cumsum(size), size)
            here = np.arange(len(names))
            number = batch.column(2).flatten().to_numpy()
            needs = batch.column(4).flatten().to_numpy()
            for lo in range(0, len(names), 20_000):
                pick = here[lo:lo + 20_000]
                pick = pick[number[pick] >= 0]
                length = np.minimum(cut[pick] - pick, needs[pick])
                ends = np.concatenate(([0], np.cumsum(length)))
                flat = np.arange(int(ends[-1])) - np.repeat(ends[:-1], length) + np.repeat(pick, length)
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat(batch.column(0).to_numpy(), size)[pick]), pa.array(number[pick]),
                    batch.column(3).flatten().take(pa.array(pick)),
                    pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(names[flat]))],
                    ["sid", "number", "rank", "prefix"])

    return joined.select("sid", "names", "numbers", "ranks", "needs").mapInArrow(
        released(run), "sid long, number int, rank long, prefix array<long>")


def _neighbours(prefixes: DataFrame) -> DataFrame:
    """sid, number, and how many names each suffix shares with the one before and after it.

    Compares adjacent suffixes of a range of ranks. Next to another range -1 is told: not known.
    """
    def shared(lists: pa.Array) -> np.ndarray:
        """Names shared by each list and the next one."""
        offset = lists.offsets.to_numpy()
        value = lists.values.to_numpy()
        size = np.diff(offset)
        least = np.minimum(size[:-1], size[1:])
        out = np.zeros(len(least), np.int32)
        live, k = np.flatnonzero(least > 0), 0
        while len(live):
            live = live[value[offset[live] + k] == value[offset[live + 1] + k]]
            k += 1
            out[live] = k
            live = live[least[live] > k]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, before = None, -1
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = pa.Table.from_batches([held, batch] if held is not None else [batch]).combine_chunks()
            same = shared(rows.column("prefix").chunk(0))
            n = rows.num_rows - 1  # the last waits for the next batch
            if n:
                yield pa.RecordBatch.from_arrays([
                    rows.column("sid").chunk(0).slice(0, n), rows.column("number").chunk(0).slice(0, n),
                    pa.array(np.concatenate(([before], same[:-1])).astype(np.int32)), pa.array(same)],
                    ["sid", "number", "before", "after"])
                before = int(same[-1])
            held = rows.slice(n).to_batches()[0]
        if held is not None:
            yield pa.RecordBatch.from_arrays(
                [held.column(0), held.column(1), pa.array([before], pa.int32()), pa.array([-1], pa.int32())],
                ["sid", "number", "before", "after"])

    ordered = prefixes.repartitionByRange("rank", "sid", "number").sortWithinPartitions(
        "rank", "sid", "number").select("sid", "number", "prefix")
    return ordered.mapInArrow(released(run), "sid long, number int, before int, after int")


def _marks(joined: DataFrame, shape: Shape) -> DataFrame:
    """What is known of the windows of each text.

    Windows that a neighbour's suffix shares are told as runs: sid, start, length. The others, up
    to GROUP in a row, are told with the value (w1, w2) of the bytes that all windows of their
    group have, and the bytes before (left) and behind (right) that theirs have too; ``j`` is how
    many the first has before. A window's j follows from where its least gram is, so equal
    windows have equal values. The first of suffixes that share a window is told so too, without
    a place, so that others can find it. No other suffix shares a name more than the neighbours do,
    which rules out windows that would.
    """
    names = ["sid", "start", "length", "w1", "w2", "left", "right", "j"]
    steps = np.arange(GROUP - 1)

    def aside(data: np.ndarray, places: np.ndarray, count: np.ndarray) -> np.ndarray:
        """The first ``count`` bytes at these places as a number."""
        out = np.zeros((len(places), 8), np.uint8)
        out[:, :GROUP - 1] = data[np.clip(places, 0, len(data) - 1)] * (steps < count[:, None])
        return out.view(np.int64)[:, 0]

    def solve(text, good, known, copies):
        data = text.data
        p = np.flatnonzero(text.possible(good))
        at = text.anchors
        size = text.named()
        cover = np.zeros((2, len(at)), np.int64)  # bytes shared with the neighbours before, after
        number = known["number"]
        for side, told in enumerate(("before", "after")):
            n = known[told]
            some = n > 0
            last = number[some] + n[some] - 1
            cover[side, number[some]] = at[last] - at[number[some]] + size[last]
        # Bytes that no other suffix shares, where the ranks settle it.
        shares = np.maximum(known["before"], known["after"])
        settled = (known["before"] >= 0) & (known["after"] >= 0)
        settled &= size[np.minimum(number + shares, len(at) - 1)] == shape.name  # a whole name
        settled &= number + shares < len(at)
        never = np.full(len(at), len(data) + 1, np.int64)
        last = (number + shares)[settled]
        never[number[settled]] = at[last] - at[number[settled]] + size[last]
        first = text.first_least(p)
        ahead = at[first] - p
        some = never[first] > shape.window - ahead
        p, ahead = p[some], ahead[some]
        last = np.searchsorted(at, p, "right") - 1  # the anchor at or before
        need = shape.window + p - at[np.maximum(last, 0)]
        has = last >= 0
        before = has & (cover[0, np.maximum(last, 0)] >= need)
        after = has & (cover[1, np.maximum(last, 0)] >= need)
        sure = p[before | after]
        new = np.flatnonzero(np.diff(sure, prepend=-2) != 1)
        runs = sure[new], np.diff(np.append(new, len(sure)))
        told = ~before
        q, j = p[told], ahead[told] % GROUP
        alone = ~after[told] & (copies == 1)
        shared = q + j  # where the bytes start that all windows of a group have
        new = np.ones(len(q), bool)
        new[1:] = (np.diff(q) != 1) | (np.diff(shared) != 0) | (alone[1:] != alone[:-1])
        new = np.flatnonzero(new)
        length = np.diff(np.append(new, len(q)))
        q, j, shared, alone = q[new], j[new], shared[new], alone[new]
        by = np.argsort(shared, kind="stable")
        lo = shared[by]
        values = []
        for raw in (data, _OTHER_BYTES[data]):
            value = np.zeros(len(q), np.int64)
            if len(q):
                value[by] = span_hashes(raw, lo, lo + shape.window - GROUP + 1).view(np.int64)
            values.append(value)
        values[1] = (values[1] >> 48).astype(np.int16)
        end = shared + shape.window - GROUP + 1
        values += [aside(data, shared[:, None] - 1 - steps, j),
                   aside(data, end[:, None] + steps, GROUP - 2 - j + length), j.astype(np.int32)]
        return runs, q, length, alone, values

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in _slices(batch.column(1)):
                piece = batch.slice(lo, hi - lo)
                sids, copies = piece.column(0).to_numpy(), piece.column(4).to_numpy()
                found = _found(_texts(piece.column(1)), shape, 0)
                parts = []
                for row, (text, good) in enumerate(zip(found, _each(piece.column(2)))):
                    own = piece.column(3)[row].values
                    known = {c: own.field(i).to_numpy() for i, c in enumerate(("number", "before", "after"))}
                    runs, q, length, alone, values = solve(text, good, known, copies[row])
                    n, m = len(runs[0]), len(q)
                    none = np.zeros(n, bool)
                    parts.append((
                        np.full(n + m, sids[row]), np.concatenate((none, ~alone)),
                        np.arange(n + m) < n, np.concatenate((runs[0], q)).astype(np.int32),
                        np.concatenate((runs[1], length)).astype(np.int32),
                        *[np.concatenate((np.zeros(n, v.dtype), v)) for v in values]))
                sid, nameless, is_run, start, length, *values = map(np.concatenate, zip(*parts))
                yield pa.RecordBatch.from_arrays([
                    pa.array(sid, mask=nameless), pa.array(start), pa.array(length),
                    *[pa.array(v, mask=is_run) for v in values]], names)

    return joined.select("sid", "text", "good", "known", "copies").mapInArrow(
        released(lambda batches: _together(run(batches))),
        "sid long, start int, length int, w1 long, w2 short, left long, right long, j int")


def _met_groups(groups: DataFrame, scratch: Scratch) -> DataFrame:
    """The groups whose value another one has too, and whether all with it are ``alike``: the
    same windows with the same bytes."""
    own = F.xxhash64("left", "right", "j", "length")
    several = groups.groupBy("w1", "w2").agg(
        F.count("*").alias("n"), (F.min(own) == F.max(own)).alias("alike")).filter("n > 1")
    return scratch.stored(groups.join(several.drop("n"), ["w1", "w2"]), "groups")


def _windows(groups: DataFrame) -> DataFrame:
    """sid, start and value (w1, w2) of each window of the groups."""
    rows = groups.select("sid", "start", "w1", "w2", "left", "right", "j", F.explode(
        F.expr("sequence(0, length - 1)")).alias("on")).withColumn("j", F.expr("j - on"))
    return rows.select(
        "sid", (F.col("start") + F.col("on")).alias("start"),
        F.xxhash64("w1", "j", F.expr("left & (shiftleft(1L, 8 * j) - 1)"), F.expr(
            f"right & (shiftleft(1L, 8 * ({GROUP - 1} - j)) - 1)")).alias("w1"), "w2")


def _met_again(values: DataFrame) -> DataFrame:
    """sid and start of the windows whose value another row has too.

    Rows are sorted by value in ranges and each is compared with its neighbours; a range may
    end between equal rows, so no value is too common. Of each range the first and last row are
    compared with those of the ranges around.
    """
    names = ["part", "edge", "sid", "start", "w1", "w2"]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int16()]

    def one(*row) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, first, held, told = 0, None, None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(0)[0].as_py()
            w1, w2 = batch.column(3).to_numpy(), batch.column(4).to_numpy()
            same = (w1[1:] == w1[:-1]) & (w2[1:] == w2[:-1])
            meets = np.zeros(len(w1), bool)
            meets[1:] |= same
            meets[:-1] |= same
            if held is None:
                first = [batch.column(c)[0].as_py() for c in range(1, 5)]
            elif held[2:] == [int(w1[0]), int(w2[0])]:
                meets[0] = True
                if not told and held[0] is not None:
                    yield one(part, 0, *held)
            pick = pa.array(np.flatnonzero(meets & batch.column(1).is_valid().to_numpy(zero_copy_only=False)))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(pick), pa.array(np.zeros(len(pick), np.int32)),
                *[batch.column(c).take(pick) for c in range(1, 5)]], names)
            held, told = [batch.column(c)[-1].as_py() for c in range(1, 5)], bool(meets[-1])
        if held is not None:
            yield one(part, 1, *first)
            yield one(part, 2, *held)

    ordered = values.repartitionByRange("w1", "w2", "sid", "start").sortWithinPartitions(
        "w1", "w2").select(F.spark_partition_id().alias("part"), "sid", "start", "w1", "w2")
    told = stored(ordered.mapInArrow(
        released(run), "part int, edge int, sid long, start int, w1 long, w2 short"), "met")
    met, last = [], None
    for r in sorted(told.filter("edge > 0").collect(), key=lambda r: (r["part"], r["edge"])):
        if r["edge"] == 1 and last is not None and (last["w1"], last["w2"]) == (r["w1"], r["w2"]):
            met += [last, r]
        last = r
    more = values.sparkSession.createDataFrame(
        [(r["sid"], r["start"]) for r in met if r["sid"] is not None], "sid long, start int")
    return told.filter("edge = 0").select("sid", "start").unionByName(more)


def _without(joined: DataFrame, window: int) -> DataFrame:
    kind = joined.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in _slices(batch.column(1)):
                piece = batch.slice(lo, hi - lo)
                size, removed, n_spans, kept = [], [], [], []
                for row, data in enumerate(_texts(piece.column(1))):
                    gone = np.zeros(len(data) + 1, np.int64)
                    spans = piece.column(2)[row]
                    if spans.is_valid:
                        start, length = (spans.values.field(i).to_numpy() for i in range(2))
                        np.add.at(gone, start, 1)
                        np.add.at(gone, start + length + window - 1, -1)
                    gone = np.cumsum(gone)[:-1] > 0
                    size.append(len(data))
                    removed.append(int(gone.sum()))
                    n_spans.append(int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1)))
                    kept.append(data[~gone].tobytes())
                yield pa.RecordBatch.from_arrays([
                    piece.column(0), pa.array(size, pa.int64()), pa.array(removed, pa.int64()),
                    pa.array(n_spans, pa.int64()), pa.array(kept, pa.binary())],
                    ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return joined.select("doc_id", "text", "spans").mapInArrow(
        released(run), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def without_repeated_bytes(
    docs: DataFrame, window: int = WINDOW, text: str = "text", doc_id: str = "doc_id",
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept (the bytes left) of each row.

    A byte of a text in UTF-8 goes if a string of ``window`` bytes (64 or more) covers it that also
    starts anywhere else in the table, the same text included. All repeats go, the first too.

    An anchor whose shared bytes are there once can't be in a repeat: those go no further, and
    one of equal whole texts stands for all. The names of the others are strings whose
    suffixes are ranked by difference cover; suffixes next to each other in rank are compared. That
    tells the inside of repeats. At their edges, where the anchor before a window lies outside,
    windows are compared by an 80-bit value: first GROUP in a row by the bytes they all have, then,
    where that is there again, with the rest of their own.

    Null and empty texts have no bytes. Rows with the same id and text are separate places.
    Null ids are fine; an empty table gives no rows. Other columns are not read. Memory follows
    the longest text, some 60 bytes for each of its bytes.
    """
    spark = docs.sparkSession
    small_batches(spark)
    # Most rows here are a few numbers; batches of texts end by their bytes.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    shape, early, late = Shape(window), Scratch(spark), Scratch(spark)
    rows = _keyed(spread(docs.select(docs[doc_id], docs[text])), doc_id, text)
    index = early.stored(_index(rows, shape).filter(F.col("n_bytes") >= window).withColumn(
        "did", F.monotonically_increasing_id()), "anchors")
    once = stored(index.groupBy("k", "t").agg(
        F.min(F.struct("i", "did")).alias("one"), F.count("*").cast("int").alias("copies"),
        F.first("n_bytes").alias("n_bytes")).select("k", "t", "one.*", "copies", "n_bytes"), "texts")
    several = early.stored(index.select(F.explode("seen").alias("seen")).groupBy("seen").agg(
        F.count("*").alias("members")).filter("members > 1"), "several")
    places = index.select("did", F.explode(F.arrays_zip("seen", "numbers")).alias("p")).select(
        "did", F.col("p.seen").alias("seen"), F.col("p.numbers").alias("number"))
    wanted = places.join(several, "seen").groupBy("did").agg(
        F.collect_list(F.struct("number", "members")).alias("at"))
    # An anchor that only copies of the whole text have tells nothing: all their windows repeat.
    wanted = early.stored(once.join(wanted, "did").withColumn("good", F.transform(
        F.filter("at", lambda p: p.members > F.col("copies")), lambda p: p.number)).filter(
        "size(good) > 0").select("i", "k", "t", "did", "copies", "good"), "wanted")
    texts = rows.select("i", "k", "t", "text")
    if rows.groupBy("i", "k", "t").count().filter("count > 1").limit(1).count():
        texts = texts.dropDuplicates(["i", "k", "t"])
    strings = late.stored(_strings(texts.join(wanted, ["i", "k", "t"]), shape), "strings")
    early.drop()
    spans = once.filter("copies > 1").select(
        "did", F.lit(0).alias("start"), (F.col("n_bytes") - (window - 1)).alias("length"))
    if strings.limit(1).count():
        ranks = difference_cover.suffix_ranks(strings.select("sid", "names"), None, late)
        known = late.stored(_neighbours(late.stored(_prefixes(
            strings.select("sid", "names", "numbers", "needs").join(ranks, "sid")), "prefixes")),
            "known").groupBy("sid").agg(
            F.collect_list(F.struct("number", "before", "after")).alias("known"))
        marked = strings.select("sid", "text", "good", "copies").join(known, "sid", "left").withColumn(
            "known", F.coalesce("known", F.array().cast(
                "array<struct<number:int,before:int,after:int>>")))
        marks = early.stored(_marks(marked, shape), "marks")
        late.drop()
        met = _met_groups(marks.filter("w1 IS NOT NULL"), early)
        spans = spans.unionByName(marks.filter("w1 IS NULL").unionByName(
            met.filter("alike AND sid IS NOT NULL").drop("alike")).select(
            F.col("sid").alias("did"), "start", "length")).unionByName(
            _met_again(_windows(met.filter("NOT alike"))).select(
                F.col("sid").alias("did"), "start", F.lit(1).alias("length")))
    spans = once.select("k", "t", "did").join(spans.groupBy("did").agg(
        F.collect_list(F.struct("start", "length")).alias("spans")), "did").drop("did")
    spans = stored(spans, "spans")
    early.drop()
    return _without(rows.select("k", "t", "doc_id", "text").join(spans, ["k", "t"], "left"), window)
