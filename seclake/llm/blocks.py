"""Words of many texts at once, as numpy arrays over the UTF-8 bytes of an Arrow column.

A word is ``[^\\x20\\x09-\\x0D]+``. A block holds whole texts of a few MB together (one text
alone when it is longer), so memory follows the longest text and not the batch.
"""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BLOCK_BYTES = 1 << 20
_SEGMENT = 1 << 19
_RELEASE_BYTES = 4 << 20
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all others."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_BASE = np.uint64(0xD6E8FEB86659FD93)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64))
_tables: dict[str, np.ndarray] = {}


def _table(name: str, n: int) -> np.ndarray:
    if name not in _tables or len(_tables[name]) < n:
        _tables[name] = _powers(_BASE if name == "up" else _INVERSE, max(n, _SEGMENT + 1))
    return _tables[name]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A 64-bit value of each byte span; equal spans have equal values. Spans rise, apart."""
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        base = start[at]
        upto = max(at + 1, int(np.searchsorted(end, base + _SEGMENT, "right")))
        size = int(end[upto - 1] - base)
        sums = np.zeros(size + 1, np.uint64)
        np.cumsum(_BYTE_VALUES[data[base:base + size]] * _table("up", size + 1)[:size],
                  out=sums[1:])
        s, e = start[at:upto] - base, end[at:upto] - base
        out[at:upto] = mix((sums[e] - sums[s]) * _table("down", size + 1)[s]
                           + (e - s).astype(np.uint64) * _ODD)
        at = upto
    return out


def ngram_hashes(values: np.ndarray, n: int) -> np.ndarray:
    """A value of every n values in a row, len(values) - n + 1 of them."""
    count = len(values) - n + 1
    if count <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(count, np.uint64)
    for k in range(n):
        out *= _ODD
        out += values[k:k + count]
    return mix(out)


class Block:
    """Texts ``lo`` to ``hi`` of a column, with their words.

    data: bytes; doc_start: byte offset of each text, one more at the end; word_start and
    word_end: byte offsets; first_word: number of words before each text, one more at the end.
    """

    def __init__(self, lo: int, data: np.ndarray, doc_start: np.ndarray, lower: bool):
        self.lo, self.data, self.doc_start = lo, _LOWER[data] if lower else data, doc_start
        self.texts = len(doc_start) - 1
        size = len(data)
        word = ~_SPACE[data]
        cut = np.zeros(size + 1, bool)
        cut[doc_start] = True
        before = np.ones(size, bool)
        before[1:] = ~word[:-1]
        before |= cut[:-1]
        self.word_start = np.flatnonzero(word & before)
        after = np.ones(size, bool)
        after[:-1] = ~word[1:]
        after |= cut[1:]
        self.word_end = np.flatnonzero(word & after) + 1
        self.first_word = np.searchsorted(self.word_start, doc_start)

    @property
    def word_doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.texts), np.diff(self.first_word))

    def word_hashes(self) -> np.ndarray:
        return span_hashes(self.data, self.word_start, self.word_end)

    def word_bytes(self, at: int) -> bytes:
        return self.data[self.word_start[at]:self.word_end[at]].tobytes()


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (from 0) and bytes of a text column; a null is an empty text."""
    column = column.cast(pa.large_string()).fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] \
        if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None and at[-1] > at[0] \
        else np.zeros(0, np.uint8)
    return at - at[0], raw


def blocks(column: pa.Array, lower: bool = False, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut a text column into blocks. ``lower`` turns A-Z into a-z."""
    at, raw = text_bytes(column)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        yield Block(lo, raw[at[lo]:at[hi]], at[lo:hi + 1] - at[lo], lower)
        lo = hi


def released(run):
    """The same function of Arrow batches, which gives memory back to the system as it goes.

    Workers live on from task to task; what their allocators keep would add up over a job's stages.
    """
    def tidy(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            trim = ctypes.CDLL(None).malloc_trim
        except (AttributeError, OSError):  # another C library than glibc
            trim = None
        held = 0
        for out in run(batches):
            held += out.nbytes
            yield out
            if held > _RELEASE_BYTES:
                held = 0
                pa.default_memory_pool().release_unused()
                if trim:
                    trim(0)
        pa.default_memory_pool().release_unused()
        if trim:
            trim(0)

    return tidy


def small_batches(spark: SparkSession) -> None:
    """Hand rows to Python in batches of bounded size: long texts make them shorter."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(8 << 20))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


class Sequences:
    """Values of word sequences of a list of word values, also with one word left out."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        self.up, self.down = _table("up", n + 1), _table("down", n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * self.up[:n], out=self.sums[1:])

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (self.sums[b] - self.sums[a]) * self.down[a]

    def without(self, a: np.ndarray, b: np.ndarray, p: np.ndarray) -> np.ndarray:
        return self.of(a, p) + self.of(p + 1, b) * self.up[p - a]


def packed(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The columns, and ``text`` compressed as ``packed``: less to shuffle."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, raw = text_bytes(batch.column(batch.num_columns - 1))
            raw = raw.tobytes()
            small = [zlib.compress(raw[lo:hi], 1) for lo, hi in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(small, pa.binary())], [*columns, "packed"])

    kinds = [f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in columns]
    return rows.select(*columns, "text").mapInArrow(released(run), ", ".join([*kinds, "packed binary"]))


def unpacked(column: pa.Array) -> pa.Array:
    return pa.array([zlib.decompress(x.as_py()) for x in column], pa.binary()).cast(pa.string())


def slices(column: pa.Array, most: int = 2 << 20) -> Iterator[tuple[int, int]]:
    """Parts of a batch whose compressed texts have a bounded number of bytes together."""
    sizes = np.cumsum([len(x.as_py()) for x in column])
    lo = 0
    while lo < len(column):
        base = sizes[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(sizes, base + most, "right")))
        yield lo, hi
        lo = hi


def id_key(doc_id: Column) -> Column:
    """A number for a row's id, null too."""
    return F.xxhash64(F.lit("id"), doc_id.cast("string"))


def text_key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))
