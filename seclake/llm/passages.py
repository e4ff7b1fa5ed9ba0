"""Removing repeated passages with prefix-partitioned suffix trees (7)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seclake.llm.blocks import (
    Block, blocks, id_key, mix, ngram_hashes, packed, released, slices, small_batches, text_bytes,
    text_key, unpacked,
)
from seclake.llm.suffixes import SuffixArray
from seclake.llm.tables import stored
from seclake.session import spread

WINDOW = 35
PREFIX = 8
GROUP_MEMBERS = 512
TREE_WORDS = 200_000


def window_anchors(block: Block, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of all windows, the anchor of each, and the value of every PREFIX words.

    A window's anchor is the place of the least value among its PREFIX-word runs, the first of
    equals. It follows from the window's words alone, so equal windows have it at the same
    distance, and it never moves back from one window to the next.
    """
    values = ngram_hashes(block.word_hashes(), PREFIX)
    least, width, runs = np.arange(len(values)), 1, window - PREFIX + 1
    while width < runs and len(least):
        step = min(width, runs - width)
        a, b = least[:-step], least[step:]
        least = np.where(values[b] < values[a], b, a)
        width += step
    starts = np.arange(max(0, len(block.word_start) - window + 1))
    doc = block.word_doc
    starts = starts[doc[starts] == doc[starts + window - 1]]
    return starts, least[starts], values


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, text, a number for the id (i) and two that name the text (k, t)."""
    return docs.select(
        docs[doc_id].alias("doc_id"), docs[text].alias("text"), id_key(docs[doc_id]).alias("i"),
        F.xxhash64(F.lit("text"), docs[text]).alias("k"), text_key(docs[text]).alias("t"))


def _index(rows: DataFrame, window: int) -> DataFrame:
    """i, k, t, n_words, anchors (values) and places (word numbers) of each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(3)):
                _, anchors, values = window_anchors(block, window)
                anchors = np.unique(anchors)
                doc = block.word_doc[anchors]
                ends = pa.array(np.searchsorted(doc, np.arange(block.texts + 1)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    *[batch.column(i).slice(block.lo, block.texts) for i in range(3)],
                    pa.array(np.diff(block.first_word).astype(np.int32)),
                    pa.ListArray.from_arrays(ends, pa.array(values[anchors].view(np.int64))),
                    pa.ListArray.from_arrays(
                        ends, pa.array((anchors - block.first_word[doc]).astype(np.int32)))],
                    ["i", "k", "t", "n_words", "anchors", "places"])

    return rows.select("i", "k", "t", "text").mapInArrow(
        released(run), "i long, k long, t long, n_words int, anchors array<long>, places array<int>")


def _contexts(joined: DataFrame, window: int) -> DataFrame:
    """For each wanted anchor of a text (packed, did, copies, at): its windows' words.

    ``anchor`` and ``part`` name the group, ``start`` the first window, ``owned`` how many
    windows in a row have this anchor, and ``words`` the text from the first to the end of the
    last. The groups of an anchor with many members are that many parts.
    """
    names = ["anchor", "part", "parts", "did", "start", "owned", "copies", "words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column(0)):
                piece = batch.slice(lo, hi - lo)
                texts = unpacked(piece.column(0))
                dids, copies = piece.column(1).to_numpy(), piece.column(2).to_numpy()
                wanted = piece.column(3).to_pylist()
                for block in blocks(texts):
                    starts, anchors, values = window_anchors(block, window)
                    own = [(i, w["place"] + block.first_word[i], w["parts"])
                           for i in range(block.texts) for w in wanted[block.lo + i]]
                    if not own:
                        continue
                    doc, place, parts = (np.array(x, np.int64) for x in zip(*own))
                    first = np.searchsorted(anchors, place, "left")
                    count = np.searchsorted(anchors, place, "right") - first
                    start = starts[first]
                    a = block.word_start[start]
                    b = block.word_end[start + count + window - 2]
                    raw = block.data.tobytes()
                    did = dids[block.lo + doc]
                    spread_ = mix(did.astype(np.uint64) * np.uint64(1_000_003)
                                  + place.astype(np.uint64)) % parts.astype(np.uint64)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(values[place].view(np.int64)),
                        pa.array(spread_.astype(np.int32)), pa.array(parts.astype(np.int32)),
                        pa.array(did), pa.array((start - block.first_word[doc]).astype(np.int32)),
                        pa.array(count.astype(np.int32)),
                        pa.array(copies[block.lo + doc].astype(np.int32)),
                        pa.array([raw[x:y] for x, y in zip(a, b)], pa.binary()).cast(pa.string())],
                        names)

    return joined.select("packed", "did", "copies", "at").mapInArrow(released(run), (
        "anchor long, part int, parts int, did long, start int, owned int, copies int, "
        "words string"))


def _trees(contexts: DataFrame, window: int) -> DataFrame:
    """Repeated windows of each group: did, start and how many in a row.

    A group's suffixes are its windows. A node of its suffix tree at the depth of a window or
    deeper has repeated windows as its leaves; in the sorted suffixes such a node is a run of
    neighbours that share so many words. Windows of a group in several parts that are alone
    in theirs, and one of each node, are handed on with the window's 128-bit value (w1, w2)
    and number (times), to be matched over the parts.
    """
    names = ["did", "start", "length", "w1", "w2", "times"]

    def solve(table: pa.Table) -> pa.RecordBatch:
        column = {c: table.column(c).to_numpy() for c in
                  ("anchor", "part", "parts", "did", "start", "owned", "copies")}
        offsets, raw = text_bytes(table.column("words"))
        block = Block(0, raw, offsets, False)
        new = np.ones(len(offsets) - 1, bool)
        new[1:] = (column["anchor"][1:] != column["anchor"][:-1]) | (
            column["part"][1:] != column["part"][:-1])
        group = np.cumsum(new)
        member = block.word_doc
        values = block.word_hashes()
        array = SuffixArray(values, group[member], block.first_word[member + 1], window)
        owner = np.repeat(np.arange(len(group)), column["owned"])
        inside = np.arange(len(owner)) - np.repeat(
            np.cumsum(column["owned"]) - column["owned"], column["owned"])
        at = block.first_word[owner] + inside
        order = np.argsort(array.ranks[-1][at], kind="stable")
        at, owner, inside = at[order], owner[order], inside[order]
        deep = np.zeros(len(at), bool)
        near = group[owner][1:] == group[owner][:-1]
        deep[1:][near] = array.shared(at[:-1][near], at[1:][near]) >= window
        node = np.cumsum(~deep) - 1
        times = np.bincount(node, weights=column["copies"][owner]).astype(np.int64)
        again = times[node] > 1
        # Windows next to each other, of one member.
        who, where = owner[again], inside[again]
        by = np.lexsort((where, who))
        who, where = who[by], where[by]
        fresh = np.ones(len(who), bool)
        fresh[1:] = (who[1:] != who[:-1]) | (where[1:] != where[:-1] + 1)
        runs = np.flatnonzero(fresh)
        did, start = column["did"][who[runs]], column["start"][who[runs]] + where[runs]
        length = np.diff(np.append(runs, len(who)))
        # For other parts: each node once, single windows with their place.
        tell = np.flatnonzero(~deep & (column["parts"][owner] > 1))
        alone = ~again[tell]
        w1 = w2 = np.zeros(0, np.uint64)
        if len(tell):
            w1 = ngram_hashes(values, window)[at[tell]]
            w2 = ngram_hashes(mix(values ^ np.uint64(0xA0761D6478BD642F)), window)[at[tell]]
        n, m = len(did), len(tell)
        return pa.RecordBatch.from_arrays([
            pa.array(np.concatenate((did, column["did"][owner[tell]])).astype(np.int64),
                     mask=np.concatenate((np.zeros(n, bool), ~alone))),
            pa.array(np.concatenate((start, column["start"][owner[tell]] + inside[tell])
                                    ).astype(np.int32)),
            pa.array(np.concatenate((length, np.ones(m))).astype(np.int32)),
            *[pa.array(np.concatenate((np.zeros(n, np.int64), w.view(np.int64))),
                       mask=np.concatenate((np.ones(n, bool), np.zeros(m, bool))))
              for w in (w1, w2)],
            pa.array(np.concatenate((np.full(n, 2), times[node[tell]])).astype(np.int64))], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        words = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            anchor, part = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            size = np.cumsum(batch.column(5).to_numpy() + window - 1)
            changes = np.flatnonzero((anchor[1:] != anchor[:-1]) | (part[1:] != part[:-1])) + 1
            if held:
                last = held[-1]
                if (last.column(0)[-1].as_py(), last.column(1)[-1].as_py()) != (
                        anchor[0], part[0]):
                    changes = np.concatenate(([0], changes))
            lo = 0
            for cut in changes:
                if words + size[cut - 1] * (cut > 0) - (size[lo - 1] if lo else 0) < TREE_WORDS:
                    continue
                held.append(batch.slice(lo, cut - lo))
                yield solve(pa.Table.from_batches(held))
                held, words, lo = [], 0, cut
            held.append(batch.slice(lo))
            words += int(size[-1] - (size[lo - 1] if lo else 0))
        if held:
            yield solve(pa.Table.from_batches(held))

    grouped = contexts.repartition("anchor", "part").sortWithinPartitions("anchor", "part")
    return grouped.mapInArrow(
        released(run), "did long, start int, length int, w1 long, w2 long, times long")


def _without(joined: DataFrame, window: int) -> DataFrame:
    """doc_id, n_words, n_removed, kept of rows with doc_id, packed and spans of windows."""
    kind = joined.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                piece = batch.slice(lo, hi - lo)
                spans = piece.column(2).to_pylist()
                for block in blocks(unpacked(piece.column(1))):
                    gone = np.zeros(len(block.word_start) + 1, np.int64)
                    for i in range(block.texts):
                        for s in spans[block.lo + i] or ():
                            first = block.first_word[i] + s["start"]
                            gone[first] += 1
                            gone[first + s["length"] + window - 1] -= 1
                    gone = np.cumsum(gone)[:-1] > 0
                    raw = block.data.tobytes()
                    left = [b" ".join([raw[block.word_start[w]:block.word_end[w]] for w in
                                       range(a, b) if not gone[w]])
                            for a, b in zip(block.first_word[:-1], block.first_word[1:])]
                    total = np.concatenate(([0], np.cumsum(gone)))
                    yield pa.RecordBatch.from_arrays([
                        piece.column(0).slice(block.lo, block.texts),
                        pa.array(np.diff(block.first_word).astype(np.int64)),
                        pa.array(np.diff(total[block.first_word]).astype(np.int64)),
                        pa.array(left, pa.binary()).cast(pa.string())],
                        ["doc_id", "n_words", "n_removed", "kept"])

    return joined.select("doc_id", "packed", "spans").mapInArrow(
        released(run), f"doc_id {kind}, n_words long, n_removed long, kept string")


def without_repeats(
    docs: DataFrame, window: int = WINDOW, text: str = "text", doc_id: str = "doc_id",
) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words left, joined by a space) of each row.

    A word goes if a window of ``window`` words of its text covers it whose words also start
    anywhere else in the table, the same text included. All repeats go, the first one too.

    Suffixes are grouped by prefix: the PREFIX words at a window's anchor. Most anchors
    occur once; their windows can't repeat and go no further. Texts that are there as a whole
    more than once lose all that windows cover, and one of them stands for all in the search. A prefix with more than
    GROUP_MEMBERS places is split in parts by place, since more of it would not split equal
    windows; the parts then compare their windows by value. Each group's suffix tree
    is built in memory, many groups at a time.

    Null and empty texts have no words. Rows with the same id and text are separate places.
    Null ids are fine; an empty table gives no rows. Other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = _keyed(spread(docs.select(docs[doc_id], docs[text])), doc_id, text)
    index = stored(_index(rows, window).filter("size(anchors) > 0").withColumn(
        "did", F.monotonically_increasing_id()), "anchors")
    # One row stands for all with its text.
    once = stored(index.groupBy("k", "t").agg(
        F.min(F.struct("i", "did")).alias("one"), F.count("*").cast("int").alias("copies"),
        F.first("n_words").alias("n_words")).select(
        "k", "t", "one.*", "copies", "n_words"), "texts")
    # Written, so that the join below can split an anchor that very many places have.
    several = stored(index.select(F.explode("anchors").alias("anchor")).groupBy("anchor").agg(
        F.count("*").alias("members")).filter("members > 1").select(
        "anchor", "members", F.ceil(F.col("members") / GROUP_MEMBERS).cast("int").alias("parts")),
        "several")
    places = index.select("did", F.explode(F.arrays_zip("anchors", "places")).alias("p")).select(
        "did", F.col("p.anchors").alias("anchor"), F.col("p.places").alias("place"))
    wanted = places.join(several, "anchor").groupBy("did").agg(
        F.collect_list(F.struct("place", "parts", "members")).alias("at"))
    # An anchor that only copies of the whole text have tells nothing: all their windows repeat.
    wanted = once.join(wanted, "did").withColumn(
        "at", F.filter("at", lambda p: p.members > F.col("copies"))).filter("size(at) > 0")
    texts = packed(rows, ["i", "k", "t"])
    if rows.groupBy("i", "k", "t").count().filter("count > 1").limit(1).count():
        texts = texts.dropDuplicates(["i", "k", "t"])
    found = stored(_trees(_contexts(texts.join(wanted, ["i", "k", "t"]), window), window), "windows")
    over_parts = found.filter("w1 IS NOT NULL")
    again = over_parts.groupBy("w1", "w2").agg(F.sum("times").alias("n")).filter("n > 1")
    singles = over_parts.filter("did IS NOT NULL").join(again, ["w1", "w2"])
    spans = found.filter("w1 IS NULL").select("did", "start", "length").union(
        singles.select("did", "start", "length")).union(
        once.filter("copies > 1").select("did", F.lit(0), F.col("n_words") - (window - 1))
    ).groupBy("did").agg(
        F.collect_list(F.struct("start", "length")).alias("spans"))
    spans = once.select("k", "t", "did").join(spans, "did").drop("did")
    return _without(packed(rows, ["k", "t", "doc_id"]).join(spans, ["k", "t"], "left"), window)
