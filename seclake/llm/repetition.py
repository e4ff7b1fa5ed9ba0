"""Quality rules with suffix-array repetition (6)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from seclake.llm.blocks import Block, blocks, small_batches, span_hashes
from seclake.llm.suffixes import SuffixArray
from seclake.session import spread

_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True


@dataclass(frozen=True)
class RepetitionLimits:
    """A text is kept when both hold. Repeats shorter than ``least`` words don't count."""

    least: int = 8
    covered_percent: int = 30
    longest: int = 100


def longest_shared(names: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """For each position, the most words that start there and also elsewhere in its text.

    The LCP intervals of the suffix array are its maximal repeats. The deepest interval a
    position lies in is as deep as the larger of its two neighbours' common prefixes.
    """
    best = np.zeros(len(names), np.int64)
    if len(names) < 2:
        return best
    array = SuffixArray(names, doc, np.searchsorted(doc, doc, "right"))
    order = array.sorted(np.arange(len(names)))
    left, right = order[:-1], order[1:]
    same = doc[left] == doc[right]
    left, right = left[same], right[same]
    shared = array.shared(left, right)
    best[left] = shared
    np.maximum.at(best, right, shared)
    return best


def _covered(starts: np.ndarray, lengths: np.ndarray, n: int) -> np.ndarray:
    """Which of n positions lie in one of the spans."""
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + lengths, -1)
    return np.cumsum(edges)[:-1] > 0


def _per_text(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return sums[first[1:]] - sums[first[:-1]]


def _repeated_lines(block: Block) -> np.ndarray:
    """Lines with a word that equal an earlier line of their text, per text."""
    breaks = np.flatnonzero(block.data == 10)
    starts = np.union1d(block.doc_start[:-1], breaks + 1)
    starts = starts[starts < len(block.data)]
    ends = np.minimum(
        np.append(starts[1:], len(block.data)),
        np.append(breaks, len(block.data))[np.searchsorted(breaks, starts)])
    words = np.searchsorted(block.word_start, ends) - np.searchsorted(block.word_start, starts)
    starts, ends = starts[words > 0], ends[words > 0]
    doc = np.searchsorted(block.doc_start, starts, "right") - 1
    lines = span_hashes(block.data, starts, ends)
    order = np.lexsort((lines, doc))
    again = np.zeros(len(starts), bool)
    again[1:] = (lines[order][1:] == lines[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    return np.bincount(doc[order][again], minlength=block.texts)


def measures(block: Block, least: int) -> dict[str, np.ndarray]:
    first, n = block.first_word, len(block.word_start)
    shared = longest_shared(block.word_hashes(), block.word_doc)
    letters = (block.data & 0xC0) != 0x80
    points = np.concatenate(([0], np.cumsum(letters)))
    triple, long = np.flatnonzero(shared >= 3), np.flatnonzero(shared >= least)
    longest = np.zeros(block.texts, np.int64)
    if n:
        np.maximum.at(longest, block.word_doc, shared)
    return {
        "n_words": np.diff(first),
        "word_chars": _per_text(points[block.word_end] - points[block.word_start], first),
        "n_symbols": _per_text(_SYMBOLS[block.data], block.doc_start),
        "n_dup_lines": _repeated_lines(block),
        "n_repeat_words": _per_text(_covered(triple, np.full(len(triple), 3), n), first),
        "n_covered_words": _per_text(_covered(long, shared[long], n), first),
        "longest_repeat": longest,
    }


def quality_rules(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id",
    limits: RepetitionLimits = RepetitionLimits(),
) -> DataFrame:
    """Word, symbol, line and repetition counts of each text and whether it is kept.

    Base rule: a text fails with fewer than 50 words or when over half of its words lie in
    repeated 3-word windows. Repetition rule: maximal repeats of ``limits.least`` words or
    more, overlapping ones too, may cover ``covered_percent`` of the words at most, and none
    may be longer than ``longest`` words.

    One row for each input row. A null or empty text has no words, so it fails. Repeated rows
    and null ids are judged each for itself; other columns are not read. No shuffle.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                got = measures(block, limits.least)
                words, repeats = got["n_words"], got["n_repeat_words"]
                failed = (words < 50) | (100 * repeats > 50 * words)
                fine = (100 * got["n_covered_words"] <= limits.covered_percent * words) & (
                    got["longest_repeat"] <= limits.longest)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.lo, block.texts),
                     *[pa.array(v.astype(np.int64)) for v in got.values()],
                     pa.array(failed), pa.array(fine & ~failed)],
                    ["doc_id", *got, "base_failed", "kept"])

    small_batches(docs.sparkSession)
    narrow = spread(docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, (
        f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
        "n_repeat_words long, n_covered_words long, longest_repeat long, base_failed boolean, "
        "kept boolean"))
