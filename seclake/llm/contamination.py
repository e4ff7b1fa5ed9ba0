"""Benchmark decontamination by q-gram counts in diagonal bands (8)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from seclake.llm.blocks import mix, small_batches, text_bytes
from seclake.session import spread

CHUNK_CHARS = 8_000_000  # characters of items that one pass over the documents looks for
_BLOCK = 1 << 20
_BITS = 22
_BASE = np.uint64(0x9E3779B97F4A7C15)
_PLACES = 2_000_000  # places of q-grams that are listed at once
_CELLS = 1_000_000  # cells of alignments that are filled at once
MANY_JOBS = 256  # alignments of a block of texts beyond which costs are worked out side by side


@dataclass(frozen=True)
class MatchRule:
    """Items of ``least_chars`` or more are found with up to ``edits`` of their characters put
    in, left out or replaced; fewer where an item is so short that matches would not need to
    share a run of ``q`` characters. Shorter items are found as they are, not inside a word."""

    q: int = 10
    edits: float = 0.08
    least_chars: int = 32

    def budget(self, length: int) -> int:
        if length < max(self.least_chars, self.q):
            return 0
        return max(0, min(int(self.edits * length), (length - self.q) // self.q))

    def shared(self, length: int) -> int:
        """q-grams that a match within the budget has in common with the item."""
        return length - self.q + 1 - self.q * self.budget(length)


def normal(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return _normal(points, np.zeros(1, np.int64))[0]


def _normal(points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A-Z lowered, each run of white space one space, and where each character was."""
    space = (points == 32) | ((points >= 9) & (points <= 13))
    keep = np.ones(len(points), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    keep[starts[starts < len(points)]] = True
    at = np.flatnonzero(keep)
    out = points[at].copy()
    out[space[at]] = 32
    capital = (out >= 65) & (out <= 90)
    out[capital] += 32
    return out, at


def _grams(points: np.ndarray, q: int) -> np.ndarray:
    count = len(points) - q + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(count, np.uint64)
    wide = points.astype(np.uint64)
    for k in range(q):
        out *= _BASE
        out += wide[k:k + count]
    return mix(out)


def _places(many: np.ndarray) -> np.ndarray:
    """0, 1, ... for each number anew."""
    return np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)


def _runs(turn: np.ndarray) -> Iterator[tuple[int, int]]:
    """First and last place, exclusive, of each run of equal numbers."""
    cuts = np.flatnonzero(turn[1:] != turn[:-1]) + 1
    yield from zip([0, *cuts.tolist()], [*cuts.tolist(), len(turn)])


class ItemIndex:
    """The q-grams of a chunk of benchmark items, by value."""

    def __init__(self, items: list[tuple[int, np.ndarray]], rule: MatchRule):
        self.rule, self.items = rule, items
        length = np.array([len(x) for _, x in items], np.int64)
        self.length = length
        self.budget = np.array([rule.budget(n) for n in length], np.int64)
        self.shared = np.array([rule.shared(n) for n in length], np.int64)
        self.letters = np.concatenate([x for _, x in items]) if items else np.zeros(0, np.uint32)
        self.begin = np.cumsum(length) - length
        # Short items are looked for as a whole, by length.
        small = self.length < max(rule.least_chars, rule.q)
        self.short = {}
        for n in np.unique(self.length[small]):
            own = np.flatnonzero(self.length == n)
            whole = np.concatenate([_grams(items[i][1], int(n)) for i in own])
            order = np.argsort(whole, kind="stable")
            self.short[int(n)] = whole[order], own[order]
        grams = [_grams(x if not few else x[:0], rule.q) for (_, x), few in zip(items, small)]
        values = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        owner = np.repeat(np.arange(len(items)), [len(g) for g in grams])
        place = np.concatenate([np.arange(len(g)) for g in grams]) if grams else owner
        order = np.argsort(values, kind="stable")
        values, self.owner, self.place = values[order], owner[order], place[order]
        self.values, self.first = np.unique(values, return_index=True)
        self.first = np.append(self.first, len(values))
        self.filter = np.zeros(1 << _BITS, bool)
        self.filter[(values >> np.uint64(64 - _BITS)).astype(np.int64)] = True

    def candidates(self, points: np.ndarray) -> list[tuple[int, int, int]]:
        """item, first and last diagonal of bands with enough q-grams in common.

        A diagonal is a place in the text less the place in the item. A match with e edits
        keeps to e + 1 diagonals, so bands of 2 (e + 1) that overlap by half miss none. Places of
        common q-grams are counted per band in turns, never listed all at once.
        """
        grams = _grams(points, self.rule.q)
        at = np.flatnonzero(self.filter[(grams >> np.uint64(64 - _BITS)).astype(np.int64)])
        if not len(at) or not len(self.values):
            return []
        slot = np.minimum(np.searchsorted(self.values, grams[at]), len(self.values) - 1)
        hit = self.values[slot] == grams[at]
        at, slot = at[hit], slot[hit]
        many = self.first[slot + 1] - self.first[slot]
        wide = len(points) + int(self.length.max()) + 3
        keys, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        turn = (np.cumsum(many) - many) // _PLACES
        for lo, hi in _runs(turn):
            which = np.repeat(self.first[slot[lo:hi]], many[lo:hi]) + _places(many[lo:hi])
            item = self.owner[which]
            diagonal = np.repeat(at[lo:hi], many[lo:hi]) - self.place[which]
            half = self.budget[item] + 1
            band = (diagonal + self.length[item] + half) // half  # from 1 on
            new, times = np.unique(item * wide + band, return_counts=True)
            keys, inverse = np.unique(np.concatenate((keys, new)), return_inverse=True)
            count = np.bincount(inverse, np.concatenate((count, times)), len(keys)).astype(np.int64)
        item, band = keys // wide, keys % wide
        both, before = count.copy(), count.copy()
        near = keys[1:] == keys[:-1] + 1
        both[:-1][near] += count[1:][near]
        before[1:][near] += count[:-1][near]
        enough = np.maximum(both, before) >= self.shared[item]
        item, band = item[enough], band[enough]
        if not len(item):
            return []
        apart = np.ones(len(item), bool)  # bands of one item that touch are one
        apart[1:] = (item[1:] != item[:-1]) | (band[1:] > band[:-1] + 3)
        a = np.flatnonzero(apart)
        b = np.append(a[1:], len(item)) - 1
        item, half = item[a], self.budget[item[a]] + 1
        return list(zip(item.tolist(), ((band[a] - 2) * half - self.length[item]).tolist(),
                        ((band[b] + 1) * half - 1 - self.length[item]).tolist()))

    def short_matches(self, points: np.ndarray, first: np.ndarray) -> Iterator[tuple]:
        """text number, item, start and end in ``points`` of short items, found as they are.

        A match does not begin or end inside a word of the text: characters beyond ASCII,
        letters, digits and _ make up words.
        """
        if not self.short:
            return
        word = (points >= 128) | (points == 95) | ((points >= 48) & (points <= 57)) | (
            (points >= 97) & (points <= 122))
        inside = np.zeros(len(points) + 1, bool)  # a word goes on over this place
        inside[1:-1] = word[1:] & word[:-1]
        inside[first] = False
        text = np.zeros(len(points) + 1, np.int64)
        np.add.at(text, first[1:-1], 1)
        text = np.cumsum(text)
        wide, grams = points.astype(np.uint64), np.zeros(len(points), np.uint64)
        for n in range(1, max(self.short) + 1):
            grams = grams[:max(0, len(points) - n + 1)] * _BASE + wide[n - 1:]
            if n not in self.short or not len(grams):
                continue
            values, owner = self.short[n]
            hashed = mix(grams)
            lo, hi = np.searchsorted(values, hashed), np.searchsorted(values, hashed, "right")
            at = np.flatnonzero((hi > lo) & ~inside[:len(grams)] & ~inside[n:]
                                & (text[:len(grams)] == text[n - 1:-1]))
            ends: dict[int, int] = {}
            for p in at.tolist():
                for i in owner[lo[p]:hi[p]].tolist():
                    if ends.get(i, 0) <= p and np.array_equal(self.items[i][1], points[p:p + n]):
                        ends[i] = p + n
                        yield int(text[p]), i, p, p + n

    def near_enough(self, points: np.ndarray, jobs: list[tuple]) -> np.ndarray:
        """For each job (text number, item, lo, hi, x, y: the text is points[x:y]) whether an
        alignment in its band keeps to the budget. Many jobs are filled in side by side."""
        item = np.array([j[1] for j in jobs], np.int64)
        length, budget = self.length[item], self.budget[item]
        lo, hi, x, y = (np.array([j[k] for j in jobs], np.int64) for k in (2, 3, 4, 5))
        lo, width = lo - budget, hi - lo + 2 * budget + 1
        out = np.zeros(len(jobs), bool)
        order = np.lexsort((-length, width))
        a = 0
        while a < len(order):
            b = a + 1
            while b < len(order) and (b + 1 - a) * (int(width[order[b]]) + 1) <= _CELLS // 8:
                b += 1
            own = order[a:b][np.argsort(-length[order[a:b]], kind="stable")]
            out[own] = self._costs(points, item[own], lo[own], width[own], x[own], y[own]) <= budget[own]
            a = b
        return out

    def _costs(self, points, item, lo, width, x, y) -> np.ndarray:
        """Least edits of each job; the longest items come first."""
        n, w = self.length[item], int(width.max())
        far = int(n[0]) + 1
        steps = np.arange(w)
        column = lo[:, None] + steps  # place in the text of the band's column in the row at hand
        off = steps >= width[:, None]
        text = y - x
        cost = np.where(off | (column < 0) | (column > text[:, None]), far, 0)
        begin = self.begin[item]
        least = np.full(len(item), far)
        active = len(item)
        for i in range(far - 1):
            while n[active - 1] <= i:
                active -= 1
            at = column[:active] + i
            real = (at >= 0) & (at < text[:active, None])
            char = points[np.where(real, at + x[:active, None], 0)]
            best = cost[:active] + np.where(real, char != self.letters[begin[:active] + i][:, None], far)
            best[:, :-1] = np.minimum(best[:, :-1], cost[:active, 1:] + 1)
            best = np.minimum.accumulate(best - steps, axis=1) + steps
            best[off[:active] | (at + 1 < 0) | (at + 1 > text[:active, None])] = far
            cost[:active] = np.minimum(best, far)
            done = np.flatnonzero(n[:active] == i + 1)
            least[done] = cost[done].min(axis=1)
        return least

    def align(self, item: int, points: np.ndarray, lo: int, hi: int) -> list[tuple[int, int, int]]:
        """start, end and edits of matches whose diagonals are from lo to hi, apart.

        Alignment of the whole item with any part of the text, inside the band. Row by row
        over the item; column d is diagonal lo + d.
        """
        x, budget = self.items[item][1], int(self.budget[item])
        lo, width = lo - budget, hi - lo + 2 * budget + 1
        if width < len(x):  # other matches in the band would overlap one without edits
            a = max(0, lo)
            spot = points[a:max(a, lo + width + len(x))].tobytes().find(x.tobytes())
            if spot >= 0 and spot % 4 == 0:
                return [(a + spot // 4, a + spot // 4 + len(x), 0)]
        far, size = len(x) + 1, len(x) + width
        a, b = min(max(0, lo), len(points)), min(max(0, lo + size), len(points))
        text = np.full(size, 0xFFFFFFFF, np.uint32)  # no character, outside the text
        text[a - lo:b - lo] = points[a:b]
        outside = np.full(size, far, np.int64)
        outside[a - lo:b - lo] = 0
        ends = np.full(size + 1, far, np.int64)
        ends[a - lo:b - lo + 1] = 0
        steps = np.arange(width)
        cost, start = ends[:width].copy(), np.clip(lo + steps, 0, len(points))
        up, origin_up = np.full(width, far, np.int64), np.zeros(width, np.int64)
        for i, char in enumerate(x):
            best = cost + (text[i:i + width] != char) + outside[i:i + width]
            up[:-1] = cost[1:] + 1  # the item's character left out
            origin_up[:-1] = start[1:]
            origin = np.where(up < best, origin_up, start)
            best = np.minimum(best, up) - steps
            reach = np.minimum.accumulate(best)  # text characters put in
            source = np.maximum.accumulate(np.where(best == reach, steps, 0))
            start = origin[source]
            cost = np.minimum(reach + steps + ends[i + 1:i + 1 + width], far)
        end = lo + len(x) + steps
        good = np.flatnonzero((cost <= budget) & (end <= len(points)) & (end > start))
        found: list[tuple[int, int, int]] = []
        for d in good[np.lexsort((end[good], cost[good]))]:
            s, e = int(start[d]), int(end[d])
            if all(e <= a or s >= b for a, b, _ in found):
                found.append((s, e, int(cost[d])))
        return found


def _matches(index: ItemIndex, offsets: np.ndarray, raw: np.ndarray) -> Iterator[tuple]:
    """text number, item number, start, end (code points of the text) and edits."""
    lead = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    starts = lead[offsets]
    points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
    flat, at = _normal(points, starts[:-1])
    first = np.searchsorted(at, starts)
    for text, item, start, end in index.short_matches(flat, first):
        yield (text, item, int(at[start] - starts[text]), int(at[end - 1] + 1 - starts[text]), 0)
    found: dict[tuple[int, int], list[tuple[int, int, int]]] = {}
    jobs = []
    for item, lo, hi in index.candidates(flat):
        length = int(index.length[item])
        a = int(np.searchsorted(first, max(0, lo), "right")) - 1
        b = int(np.searchsorted(first, min(len(flat), hi + 2 * length), "left"))
        for text in range(max(0, a), min(b, len(first) - 1)):
            x, y = int(first[text]), int(first[text + 1])
            if y > x:
                jobs.append((text, item, lo - x, hi - x, x, y))
    if len(jobs) > MANY_JOBS:
        jobs = [job for job, good in zip(jobs, index.near_enough(flat, jobs)) if good]
    for text, item, lo, hi, x, y in jobs:
        found.setdefault((text, item), []).extend(index.align(item, flat[x:y], lo, hi))
    for (text, item), spans in found.items():
        x, taken = int(first[text]), []
        for s, e, edits in sorted(spans, key=lambda m: (m[2], m[0], m[1])):
            if all(e <= a or s >= b for a, b in taken):
                taken.append((s, e))
                yield (text, item, int(at[x + s] - starts[text]),
                       int(at[x + e - 1] + 1 - starts[text]), edits)


def _item_chunks(benchmark: DataFrame) -> Iterator[list[tuple[int, np.ndarray]]]:
    """Items with a text, CHUNK_CHARS at a time."""
    chunk, chars = [], 0
    rows = benchmark.select("item_id", "text").filter("text IS NOT NULL")
    for row in rows.distinct().sort("item_id", "text").toLocalIterator():
        points = normal(row["text"].strip(" \t\n\x0b\x0c\r"))
        if not len(points):
            continue
        if chars and chars + len(points) > CHUNK_CHARS:
            yield chunk
            chunk, chars = [], 0
        chunk.append((row["item_id"], points))
        chars += len(points)
    if chunk:
        yield chunk


def benchmark_matches(
    docs: DataFrame, benchmark: DataFrame, rule: MatchRule = MatchRule(),
    columns: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """The columns with item_id, start, end and edits: where a text holds a benchmark item.

    Letters A-Z are compared in lower case and white space as one space. Matches of one item
    don't overlap; the one with fewest edits, then the first, is given. start and end are
    code points of the text, end exclusive.

    The benchmark is looked for in chunks of bounded size, each sent to all tasks and searched
    for in every text; a larger benchmark means more passes, not more memory. No shuffle.

    Null and empty texts hold nothing, and items without text or of white space alone are in no
    text. Items with less than ``rule.least_chars`` characters are found without edits and not
    inside a word. Items without id are found with a null item_id; equal items are all found,
    those with the same id once. Repeated rows and null ids are searched each for itself.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = spread(docs.select(*columns, "text"))
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns)
    id_kind = benchmark.schema["item_id"].dataType.simpleString()
    id_type = to_arrow_type(benchmark.schema["item_id"].dataType)
    schema = f"{kinds}, item_id {id_kind}, start long, end long, edits long"
    width = len(columns)

    def search(chunk):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(chunk.value, rule)
            for batch in batches:
                offsets, raw = text_bytes(batch.column(width))
                lo = 0
                while lo < batch.num_rows:
                    hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + _BLOCK, "right")) - 1)
                    got = list(_matches(index, offsets[lo:hi + 1] - offsets[lo],
                                        raw[offsets[lo]:offsets[hi]]))
                    if got:
                        text, item, start, end, edits = zip(*got)
                        rows_ = pa.array([lo + t for t in text])
                        yield pa.RecordBatch.from_arrays(
                            [*[batch.column(i).take(rows_) for i in range(width)],
                             pa.array([index.items[i][0] for i in item], id_type),
                             *[pa.array(v, pa.int64()) for v in (start, end, edits)]],
                            [*columns, "item_id", "start", "end", "edits"])
                    lo = hi
        return run

    out = None
    for chunk in _item_chunks(benchmark):
        # At most CHUNK_CHARS characters.
        found = rows.mapInArrow(search(spark.sparkContext.broadcast(chunk)), schema)
        out = found if out is None else out.union(found)
    if out is None:
        return rows.limit(0).select(
            *columns, F.lit(None).cast(id_kind).alias("item_id"),
            *[F.lit(None).cast("long").alias(c) for c in ("start", "end", "edits")])
    return out


def without_matches(
    docs: DataFrame, benchmark: DataFrame, rule: MatchRule = MatchRule(),
) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no benchmark item, with id or without. No
    shuffle. Rows with a null or empty text stay."""
    spark = docs.sparkSession
    small_batches(spark)

    def search(chunk):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            index = ItemIndex(chunk.value, rule)
            for batch in batches:
                offsets, raw = text_bytes(batch.column(1))
                clean = np.ones(batch.num_rows, bool)
                lo = 0
                while lo < batch.num_rows:
                    hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + _BLOCK, "right")) - 1)
                    for match in _matches(index, offsets[lo:hi + 1] - offsets[lo],
                                          raw[offsets[lo]:offsets[hi]]):
                        clean[lo + match[0]] = False
                    lo = hi
                yield batch.filter(pa.array(clean))
        return run

    rows = spread(docs.select(
        F.struct(*[docs[c] for c in docs.columns if c != "text"]).alias("row"), "text"))
    schema = rows.schema
    texts = benchmark.select(F.lit(0).alias("item_id"), "text")
    for chunk in _item_chunks(texts):
        rows = rows.mapInArrow(search(spark.sparkContext.broadcast(chunk)), schema)
    return rows.select(*[F.col("text") if c == "text" else F.col(f"row.`{c}`").alias(c)
                         for c in docs.columns])
