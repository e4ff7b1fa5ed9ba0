"""Line dedup by deletion neighbourhoods (1)."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from seclake.llm.blocks import (
    Sequences, blocks, id_key, mix, packed, released, slices, small_batches, text_key, unpacked,
)
from seclake.llm.tables import stored
from seclake.session import spread

LEAST_WORDS = 8  # lines of fewer words are compared by characters
CHARS_AN_EDIT = 20  # characters that a line of few words has for an edit of one
LONG_WORDS = 16
BLOCKS = 8
MOST_SENT = 300_000  # wanted lines sent to every executor at most; beyond that texts are shuffled
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SECOND = np.uint64(0xA0761D6478BD642F)
_ODD = np.uint64(0x9E3779B97F4A7C15)
ORDER = ("late", "doc_id", "t", "line")


def within_one(a: list[str], b: list[str]) -> bool:
    """Whether one word put in, left out or replaced, or none, makes a into b."""
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    j = 0
    while j < min(len(a), len(b)) - i and a[-1 - j] == b[-1 - j]:
        j += 1
    return max(len(a), len(b)) - i - j <= 1


def _lines(rows: DataFrame) -> DataFrame:
    """A row for each line with words: w1, w2 (128-bit value of its words), place, ends.

    ``ends`` are values of the line's first and its last words, 4 of each or from LONG_WORDS
    words on 8 (lines of exactly LONG_WORDS have both). Two lines one word apart
    have the one or the other in common. ``s`` is a line of fewer than LEAST_WORDS words and
    CHARS_AN_EDIT characters or more, its words parted by one space.
    """
    kind = rows.schema["doc_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(2)):
                start = block.word_start
                if not len(start):
                    continue
                breaks = np.concatenate(([0], np.cumsum(block.data == 10)))
                row, doc = breaks[start], block.word_doc
                new = np.ones(len(start), bool)
                new[1:] = (row[1:] != row[:-1]) | (doc[1:] != doc[:-1])
                a = np.flatnonzero(new)
                b = np.append(a[1:], len(start))
                n, doc = b - a, doc[a]
                line = row[a] - breaks[block.doc_start[doc]]
                values = block.word_hashes()
                one, two = Sequences(values), Sequences(mix(values ^ _SECOND))
                length = n.astype(np.uint64) * _ODD
                keys, owner = [], []
                for words, wanted in ((4, (n >= LEAST_WORDS) & (n <= LONG_WORDS)),
                                      (8, n >= LONG_WORDS)):
                    own = np.flatnonzero(wanted)
                    for side, lo in ((0, a[own]), (1, b[own] - words)):
                        keys.append(mix(one.of(lo, lo + words) + np.uint64(2 * words + side)))
                        owner.append(own)
                keys, owner = np.concatenate(keys), np.concatenate(owner)
                order = np.argsort(owner, kind="stable")
                ends = np.searchsorted(owner[order], np.arange(len(n) + 1)).astype(np.int32)
                lo, hi, raw = start[a], block.word_end[b - 1], block.data.tobytes()
                short = [None] * len(n)
                for i in np.flatnonzero((n < LEAST_WORDS) & (hi - lo >= CHARS_AN_EDIT)).tolist():
                    words = b" ".join(raw[lo[i]:hi[i]].split()).decode()
                    if len(words) >= CHARS_AN_EDIT:
                        short[i] = words
                at = pa.array(block.lo + doc)
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(at), batch.column(1).take(at),
                    pa.array(line.astype(np.int32)), pa.array(n.astype(np.int32)),
                    pa.array(mix(one.of(a, b) + length).view(np.int64)),
                    pa.array(mix(two.of(a, b) + length).view(np.int64)),
                    pa.ListArray.from_arrays(
                        pa.array(ends), pa.array(keys[order].view(np.int64))),
                    pa.array(short, pa.string())],
                    ["doc_id", "t", "line", "n", "w1", "w2", "ends", "s"])

    return rows.select("doc_id", "t", "text").mapInArrow(
        released(run), f"doc_id {kind.simpleString()}, t long, line int, n int, w1 long, w2 long, "
             "ends array<long>, s string")


def _candidates(texts: DataFrame) -> DataFrame:
    """The words of the wanted lines (own: cid and line) of each text, plain or packed."""
    plain = "text" in texts.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in [(0, batch.num_rows)] if plain else slices(batch.column(0)):
                piece = batch.slice(lo, hi - lo)
                cids, words = [], []
                column = piece.column(0) if plain else unpacked(piece.column(0))
                for text, own in zip(column, piece.column(1).to_pylist()):
                    lines = text.as_py().split("\n")
                    for one in own:
                        cids.append(one["cid"])
                        words.append(" ".join(_WORD.findall(lines[one["line"]])))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cids, pa.int64()), pa.array(words, pa.string())], ["cid", "words"])

    return texts.select("text" if plain else "packed", "own").mapInArrow(
        released(run), "cid long, words string")


def _block_keys(lines: DataFrame) -> DataFrame:
    """128-bit keys h1, h2 of each line less one of its BLOCKS parts, with cid and block.

    A line of n words has the keys of its own length (block from 0) and, as the longer one,
    those of n - 1 (block from BLOCKS). Two lines one word apart share the key of the part
    that the word is in.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                values = block.word_hashes()
                first, end = block.first_word[:-1], block.first_word[1:]
                out = ([], [])
                for h, seq in zip(out, (Sequences(values), Sequences(mix(values ^ _SECOND)))):
                    for longer in (0, 1):
                        own = end - first - longer
                        for part in range(BLOCKS):
                            lo, hi = part_of(own, part)
                            h.append(mix(
                                mix(seq.of(first, first + lo) + own.astype(np.uint64) * _ODD)
                                + mix(seq.of(first + hi + longer, end) + np.uint64(part))
                                * _ODD))
                cid = batch.column(0).slice(block.lo, block.texts).to_numpy()
                yield pa.RecordBatch.from_arrays(
                    [*[pa.array(np.concatenate(h).view(np.int64)) for h in out],
                     pa.array(np.tile(cid, 2 * BLOCKS)),
                     pa.array(np.repeat(np.arange(2 * BLOCKS, dtype=np.int32), len(cid)))],
                    ["h1", "h2", "cid", "block"])

    return lines.select("cid", "words").mapInArrow(released(run), "h1 long, h2 long, cid long, block int")


def part_of(words, part):
    """First word of a part, and the first after it."""
    return words * part // BLOCKS, words * (part + 1) // BLOCKS


SAME_LENGTH, WHOLE, SHORTENED = 0, 1, 2


def _variants(lines: DataFrame) -> DataFrame:
    """Each line's neighbourhood as 128-bit keys h1, h2 with their role.

    SAME_LENGTH: the line without one word, and that word's place; lines that share such a key
    differ in that word. SHORTENED: the line without one word; WHOLE: the line itself;
    a line that shares a key of these kinds with the other kind is one word shorter. Words are
    left out in the parts (``parts``) that set the line apart from another.
    """
    place = ["cid", *ORDER]
    kinds = ", ".join(f"{c} {lines.schema[c].dataType.simpleString()}" for c in place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column(1).to_pylist()
            for block in blocks(batch.column(0), limit=1 << 18):
                values, first = block.word_hashes(), block.first_word
                spots = [(i, lo, hi, role) for i in range(block.texts)
                         for p in parts[block.lo + i]
                         for role, n in ((SAME_LENGTH if p < BLOCKS else SHORTENED,
                                          int(first[i + 1] - first[i]) - (p >= BLOCKS)),)
                         for lo, hi in (part_of(n, p % BLOCKS),)]
                own, lo, hi, role = (np.array(x, np.int64) for x in zip(*spots)) if spots \
                    else (np.zeros(0, np.int64),) * 4
                many = hi - lo + (role == SHORTENED)
                at = np.repeat(first[own] + lo, many) + (
                    np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many))
                own, role = np.repeat(own, many), np.repeat(role, many)
                a, b = first[own], first[own + 1]
                n = np.diff(first).astype(np.uint64)
                h = ([], [])
                for out, seq in zip(h, (Sequences(values), Sequences(mix(values ^ _SECOND)))):
                    short = mix(seq.without(a, b, at) + (n[own] - np.uint64(1)) * _ODD)
                    spot = (at - a).astype(np.uint64) + np.uint64(1)
                    out += [np.where(role == SAME_LENGTH, mix(short + spot * _SECOND), short),
                            mix(seq.of(first[:-1], first[1:]) + n * _ODD)]
                rows = pa.array(block.lo + np.concatenate((own, np.arange(block.texts))))
                yield pa.RecordBatch.from_arrays([
                    *[pa.array(np.concatenate(x).view(np.int64)) for x in h],
                    pa.array(np.concatenate((role, np.full(block.texts, WHOLE))).astype(np.int32)),
                    *[batch.column(i + 2).take(rows) for i in range(len(place))]],
                    ["h1", "h2", "role", *place])

    return lines.select("words", "parts", *place).mapInArrow(
        released(run), f"h1 long, h2 long, role int, {kinds}")


def _short_variants(lines: DataFrame) -> DataFrame:
    """The neighbourhood of lines of few words (s), as _variants gives it, a character left out."""
    size = F.length("s")

    def key(*of):
        return F.xxhash64(*of).alias("h1"), F.xxhash64(F.lit("2"), *of).alias("h2")

    less = F.transform(F.sequence(F.lit(1), size), lambda i: F.struct(
        F.concat(F.substring("s", F.lit(1), i - 1), F.substring("s", i + 1, size)).alias("v"),
        i.alias("at")))
    return lines.select("cid", *ORDER, "s", F.explode(less).alias("less")).select(
        "cid", *ORDER, F.explode(F.array(
            F.struct(*key("less.v", "less.at"), F.lit(SAME_LENGTH).alias("role")),
            F.struct(*key("less.v"), F.lit(SHORTENED).alias("role")))).alias("key")).union(
        lines.select("cid", *ORDER, F.struct(*key("s"), F.lit(WHOLE).alias("role")))).select(
        "key.*", "cid", *ORDER)


def _earlier(variants: DataFrame) -> DataFrame:
    """cid and other, the earliest line that shares a variant, where it is earlier."""
    earliest = variants.groupBy("h1", "h2", "role").agg(
        F.min(F.struct(*ORDER, "cid")).alias("first"), F.count("*").alias("lines")).filter(
        f"role <> {SAME_LENGTH} OR lines > 1")
    role = F.element_at(F.array(F.lit(SAME_LENGTH), F.lit(SHORTENED), F.lit(WHOLE)),
                        F.col("role") + 1)
    meets = stored(earliest.select("h1", "h2", role.alias("role"), "first"), "earliest")
    return variants.join(meets, ["h1", "h2", "role"]).filter(
        F.col("first") < F.struct(*ORDER, "cid")).select(
        "cid", F.col("first.cid").alias("other")).filter("cid <> other").distinct()


def _short_near(firsts: DataFrame) -> DataFrame:
    """cid of lines of few words that are one character from an earlier one.

    Such two lines have the first or the last CHARS_AN_EDIT / 2 characters in common.
    """
    short, half = firsts.filter("s IS NOT NULL").select("cid", *ORDER, "s"), CHARS_AN_EDIT // 2
    ends = short.select("cid", F.explode(F.array(
        F.xxhash64(F.lit("first"), F.left("s", F.lit(half))),
        F.xxhash64(F.lit("last"), F.right("s", F.lit(half))))).alias("end"))
    shared = stored(ends.groupBy("end").agg(F.count("*").alias("lines")).filter(
        "lines > 1").select("end"), "ends")
    lines = stored(short.join(ends.join(shared, "end").select("cid").distinct(), "cid"), "short")
    words = lines.select("cid", "s")
    both = _earlier(_short_variants(lines)).join(words, "cid").join(
        words.select(F.col("cid").alias("other"), F.col("s").alias("before")), "other")
    return both.filter(F.levenshtein("s", "before") <= 1).select("cid").distinct()


def _verified(pairs: DataFrame, lines: DataFrame) -> DataFrame:
    """cid of each pair (cid, other) whose words are within one edit."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = [within_one(x.as_py().split(" "), y.as_py().split(" "))
                    for x, y in zip(batch.column(1), batch.column(2))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(pa.array(good, pa.bool_()))], ["cid"])

    words = lines.select("cid", "words")
    both = pairs.join(words, "cid").join(
        words.select(F.col("cid").alias("other"), F.col("words").alias("before")), "other")
    return both.select("cid", "words", "before").mapInArrow(released(run), "cid long").distinct()


def _kept(joined: DataFrame) -> DataFrame:
    """row with n_lines, n_removed and kept, the text left."""
    kind = joined.schema["row"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                piece = batch.slice(lo, hi - lo)
                total, removed, left = [], [], []
                for text, own in zip(unpacked(piece.column(1)), piece.column(2).to_pylist()):
                    lines = text.as_py().split("\n")
                    stay = set(own or ())
                    worded = [bool(_WORD.search(line)) for line in lines]
                    total.append(sum(worded))
                    removed.append(total[-1] - len(stay))
                    left.append("" if total[-1] and not stay else "\n".join(
                        line for i, line in enumerate(lines) if i in stay or not worded[i]))
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), pa.array(total, pa.int64()),
                     pa.array(removed, pa.int64()), pa.array(left, pa.string())],
                    ["row", "n_lines", "n_removed", "kept"])

    return joined.select("row", "packed", "stay").mapInArrow(
        released(run), f"row {kind}, n_lines long, n_removed long, kept string")


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """row (all columns of ``docs`` but text), n_lines, n_removed and kept for each row.

    A line with words goes if an earlier line of the table, by id and place, has the same
    words, or is one word put in, left out or replaced away while both have LEAST_WORDS words
    or more, or is one character away while both have fewer words and CHARS_AN_EDIT characters
    or more, spaces between words counted as one. Earlier lines count whether they stay or not. ``kept`` is what is left of the
    text, "" if every line with words goes. Lines without words stay beside others.

    First of each set of equal lines stand for all. Of these, only lines whose first or last
    words another has too can be one word from another, and of those only lines that equal
    another but for one of BLOCKS parts; for them the variants with a word of that part left out
    are made, equal variants are joined by taking the earliest line of each, and words are
    compared.

    Null ids come after all others; with one id, texts are in order of a hash. Of rows with the
    same id and text the first keeps its lines and the others, which repeat it, none. A null
    text is an empty one. An empty table gives no rows.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = spread(docs.select(
        F.struct(*[docs[c] for c in docs.columns if c != "text"]).alias("row"), docs["doc_id"],
        docs["text"], id_key(docs["doc_id"]).alias("k"), text_key(docs["text"]).alias("t")))
    late = F.col("doc_id").isNull().alias("late")
    firsts = stored(_lines(rows).groupBy("w1", "w2").agg(F.min(F.struct(
        late, "doc_id", "t", "line", "n", "ends", "s")).alias("first")).select("first.*").withColumn(
        "cid", F.monotonically_increasing_id()), "lines")

    ends = firsts.select("cid", F.explode("ends").alias("end"))
    # Counts are written, so that the joins below can split a key that very many lines have.
    shared = stored(ends.groupBy("end").agg(F.count("*").alias("lines")).filter(
        "lines > 1").select("end"), "ends")
    likely = ends.join(shared, "end").select("cid").distinct()
    likely = stored(firsts.drop("ends", "s").join(likely, "cid"), "likely")
    wanted = likely.groupBy(id_key(F.col("doc_id")).alias("k"), "t").agg(
        F.collect_list(F.struct("cid", "line")).alias("own"))
    few = likely.count() <= MOST_SENT
    texts = rows.join(F.broadcast(wanted), ["k", "t"]).select("k", "t", "text", "own") if few \
        else packed(rows, ["k", "t"]).join(wanted, ["k", "t"])
    words = stored(_candidates(texts).dropDuplicates(["cid"]), "words")
    keys = _block_keys(words)
    alike = stored(keys.groupBy("h1", "h2").agg(F.count("*").alias("lines")).filter(
        "lines > 1").select("h1", "h2"), "alike")
    parts = keys.join(alike, ["h1", "h2"]).groupBy("cid").agg(
        F.collect_set("block").alias("parts"))
    lines = stored(likely.join(words, "cid").join(parts, "cid"), "words")

    gone = stored(_verified(_earlier(_variants(lines)), lines).union(_short_near(firsts)), "near")

    stay = firsts.join(gone, "cid", "left_anti").groupBy(
        id_key(F.col("doc_id")).alias("k"), "t").agg(F.collect_list("line").alias("stay"))
    copies = rows.groupBy("k", "t").agg(F.count("*").alias("copies")).filter("copies > 1")
    texts = packed(rows, ["k", "t", "row"])
    if copies.limit(1).count():
        order = Window.partitionBy("k", "t").orderBy(F.lit(0))
        texts = texts.withColumn("_copy", F.row_number().over(order))
        joined = texts.join(stay, ["k", "t"], "left").withColumn(
            "stay", F.when(F.col("_copy") == 1, F.col("stay")))
    else:
        joined = texts.join(stay, ["k", "t"], "left")
    return _kept(joined)


def with_kept_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with repeated lines out of their texts; n_chars, if there, follows.

    A row whose lines with words have all gone, as they are all elsewhere, goes as well.
    """
    left = without_repeated_lines(docs).filter("n_lines = 0 OR n_removed < n_lines")
    kind = docs.schema["n_chars"].dataType if "n_chars" in docs.columns else None
    return left.select(*[
        F.col("kept").alias("text") if c == "text" else F.length("kept").cast(kind).alias(c) if c == "n_chars"
        else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
