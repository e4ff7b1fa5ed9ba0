"""Near-duplicate documents from bottom-k sketches (10)."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from seclake.llm.blocks import blocks, id_key, mix, ngram_hashes, released, small_batches, text_key
from seclake.llm.components import components
from seclake.llm.tables import stored
from seclake.session import spread

SHINGLE_WORDS = 5
RETAINED = 48
MISS = 1e-9
MOST_SENT = 200_000  # ids sent to every executor at most; beyond that they are joined
LEVEL_BITS = 3
ROUND_PAIRS = 50_000_000


def least_shared(percent: int, of: int = RETAINED, miss: float = MISS) -> int:
    """Of the ``of`` least values of a union, how many both sets hold at the least, but for a
    chance of ``miss``, when they share ``percent`` of the union."""
    p, total = percent / 100, 0.0
    for c in range(of + 1):
        total += math.comb(of, c) * p ** c * (1 - p) ** (of - c)
        if total > miss:
            return c
    return of


def shingle_sets(column: pa.Array, words: int = SHINGLE_WORDS) -> Iterator[np.ndarray]:
    """For each text, the sorted values of its distinct shingles; ASCII capitals are lowered.

    A text with fewer words has its whole sequence as one shingle, one without words none.
    """
    for block in blocks(column, lower=True):
        values = block.word_hashes()
        grams = ngram_hashes(values, words)
        for lo, hi in zip(block.first_word[:-1], block.first_word[1:]):
            if hi - lo >= words:
                own = np.sort(grams[lo:hi - words + 1])
                new = np.ones(len(own), bool)
                new[1:] = own[1:] != own[:-1]
                yield own[new]
            elif hi > lo:
                yield mix(ngram_hashes(values[lo:hi], int(hi - lo)) + np.uint64(hi - lo))
            else:
                yield np.zeros(0, np.uint64)


def _marks(own: np.ndarray) -> tuple[int, int]:
    """128 bits that tell sets apart."""
    one = np.add.reduce(mix(own ^ np.uint64(0x5851F42D4C957F2D)))
    two = np.add.reduce(mix(own + np.uint64(0x14057B7EF767814F)))
    return int(one.view(np.int64)), int(two.view(np.int64))


def _sketches(docs: DataFrame, retained: int | None) -> DataFrame:
    """doc_id, t, d1, d2, n and the ``retained`` least shingle values, all of them for None."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lo = 0
            ones, twos, sizes, lists, held = [], [], [], [], 0
            for i, own in enumerate(shingle_sets(batch.column(2))):
                d1, d2 = _marks(own) if len(own) else (0, 0)
                ones.append(d1), twos.append(d2), sizes.append(len(own))
                lists.append(own[:retained].view(np.int64))
                held += len(lists[-1])
                if held > 500_000 or i == batch.num_rows - 1:
                    ends = np.concatenate(([0], np.cumsum([len(x) for x in lists])))
                    yield pa.RecordBatch.from_arrays([
                        batch.column(0).slice(lo, i + 1 - lo),
                        batch.column(1).slice(lo, i + 1 - lo), pa.array(ones, pa.int64()),
                        pa.array(twos, pa.int64()), pa.array(sizes, pa.int64()),
                        pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)),
                                                 pa.array(np.concatenate(lists)))],
                        ["doc_id", "t", "d1", "d2", "n", "least"])
                    lo, ones, twos, sizes, lists, held = i + 1, [], [], [], [], 0

    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "t", "text").mapInArrow(
        released(run), f"doc_id {kind}, t long, d1 long, d2 long, n long, least array<long>")


def _prefixes(classes: DataFrame, percent: int) -> DataFrame:
    """value, cid, n, values: the inverted lists that can hold a link, and all the lists (in
    the same order for all sets) that a set is in.

    Two sets that are alike enough share at least ``needed`` retained values. With values put
    in order of how many sets retain them, rarest first, each set's first
    retained - needed + 1 values must meet the other's. Values of one set alone come first and
    have no list, so a text of its own has none at all, and common passages rarely count.
    """
    t = percent / 100
    entries = classes.filter("n > 0").select("cid", "n", F.explode("least").alias("value"))
    # Written, so that the join below can split a value that very many sets have.
    often = stored(entries.groupBy("value").agg(F.count("*").alias("often")).filter("often > 1"),
                   "often")
    size = F.least(F.col("n"), F.lit(RETAINED))
    needed = F.when(F.col("n") > RETAINED, F.lit(least_shared(percent))).otherwise(
        F.greatest(F.lit(1), F.floor(F.col("n") * (2 - 1 / t)).cast("int")))
    own = entries.join(often, "value").groupBy("cid", "n").agg(
        F.sort_array(F.collect_list(F.struct("often", "value"))).alias("shared"))
    first = size - needed + 1 - (size - F.size("shared"))
    return own.withColumn("_first", first.cast("int")).filter("_first > 0").select(
        "cid", "n", F.slice("shared", F.lit(1), F.col("_first"))["value"].alias("values")).select(
        F.explode("values").alias("value"), "cid", "n", "values")


def _full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """cid, n and whole shingle set (own) of each row of a wanted class (cid, rep, at, d1, d2, n).

    A class without an id is found by its text's value, and read from one of its rows. ``wanted``
    is read several times and should be a written table.
    """
    def texts(of: DataFrame, key: str) -> DataFrame:
        few = of.limit(MOST_SENT + 1).count() <= MOST_SENT
        return docs.join(F.broadcast(of) if few else of, key, "left_semi")

    out = _sketches(texts(wanted.filter("rep IS NOT NULL").select(
        F.col("rep").alias("doc_id")).distinct(), "doc_id"), None).drop("t").withColumnRenamed(
        "doc_id", "rep").join(wanted, ["rep", "d1", "d2", "n"]).select(
        "cid", "n", F.col("least").alias("own"))
    lone = wanted.filter("rep IS NULL").select(F.col("at").alias("t")).distinct()
    if not lone.limit(1).count():
        return out
    one = texts(lone, "t").filter("doc_id IS NULL").groupBy("t").agg(
        F.first("doc_id").alias("doc_id"), F.first("text").alias("text"))
    return out.union(_sketches(one.select("doc_id", "t", "text"), None).withColumnRenamed(
        "t", "at").drop("doc_id").join(
        wanted.filter("rep IS NULL"), ["at", "d1", "d2", "n"]).select(
        "cid", "n", F.col("least").alias("own")))


def _own_shingles(docs: DataFrame, classes: DataFrame, lists: DataFrame) -> DataFrame:
    """cid and u, how many shingles no other class in the lists has.

    Exact, from whole sets. A copy with many edits has many shingles of its own, and the lists
    of its group would pair it with all others in vain.
    """
    wanted = stored(classes.join(lists.select("cid").distinct(), "cid").drop("least"), "wanted")
    values = _full_sets(docs, wanted.select("cid", "rep", "at", "d1", "d2", "n")).select(
        "cid", F.explode("own").alias("value"))
    own = values.groupBy("value").agg(F.min("cid").alias("cid"), F.max("cid").alias("_hi")).filter(
        "cid = _hi").groupBy("cid").agg(F.count("*").alias("u"))
    return wanted.select("cid").join(own, "cid", "left").select(
        "cid", F.coalesce("u", F.lit(0)).alias("u"))


def _ties(
    docs: DataFrame, classes: DataFrame, given: DataFrame, percent: int,
) -> DataFrame | None:
    """node, root over all classes that links, or the links ``given``, tie to another.

    Pairs come from the inverted lists, by pivots instead of all with all. First each list's
    member with the least share of shingles of its own is compared with its others. Then classes tied by the links found are taken as
    one, lists whose members all are go, and the rest is compared with more pivots: members
    get a level by a hash, an eighth as many from level to level, and each round takes the
    levels down to the lowest at which pairs of pivots and members not yet tied stay within a
    few times the lists' rows. The last round ends at level 0, so every pair of a list is compared or already tied.

    A pair is dropped if its sizes, the shingles that either has alone, what each shares with
    the first pivot of the list, or the least values of its union say it can't be a link;
    whole shingle sets decide on the others. So a copy with many edits of its own is compared
    with the pivot, and not with all other copies in vain.
    """
    level = 10 - F.floor(F.log2(F.pmod(F.xxhash64("cid"), F.lit(1 << 30)) + 1) / LEVEL_BITS)
    sketched = stored(_prefixes(classes, percent), "lists")
    lists = stored(sketched.join(_own_shingles(docs, classes, sketched), "cid").filter(
        F.col("u") * percent <= (F.col("n") - F.col("u")) * (100 - percent)).withColumn(
        "level", level.cast("int")), "lists")
    tops = stored(lists.groupBy("value").agg(
        F.max(F.struct((-F.col("u") / F.col("n")).alias("share"), "level", "cid", "n", "u")
              ).alias("top"), F.count("*").alias("_m")).filter("_m > 1").select("value", "top"), "tops")
    rows = stored(lists.join(tops, "value"), "members")
    tied = None
    if given.limit(1).count():
        tied = stored(components(given), "tied")
    first, done = True, 11
    while done > 0:
        member = rows.withColumn("root", F.col("cid")) if tied is None else rows.join(
            tied.withColumnRenamed("node", "cid"), "cid", "left").withColumn(
            "root", F.coalesce("root", "cid"))
        # Pairs not tied yet are those of members of different components.
        several = stored(member.groupBy("value", "root").agg(F.count("*").alias("_c")).groupBy(
            "value").agg(F.sum("_c").alias("_m"), F.sum(F.col("_c") * F.col("_c")).alias("_q"),
                         F.count("*").alias("_roots")).filter("_roots > 1"), "open")
        count, apart = several.agg(
            F.sum("_m"), F.sum(F.col("_m") * F.col("_m") - F.col("_q")) / 2).first()
        if not count:
            break
        member = member.join(several.select("value"), "value")
        # Neither's own shingles are shared; the rest of both can be, at the most.
        most = F.least(F.col("n") - F.col("u"), F.col("p_n") - F.col("p_u"))
        if first:
            could = (F.col("u") + F.col("p_u")) * percent <= most * (100 - percent)
            pivots = several.join(tops, "value").select(
                "value", *[F.col(f"top.{c}").alias(f"p_{c}") for c in ("cid", "n", "u")])
        else:
            lowest = 0
            while lowest < done - 1 and apart / 8 ** max(0, lowest - 1) > ROUND_PAIRS + 4 * count:
                lowest += 1
            pivots = member.filter(
                (F.col("level") >= lowest) & (F.col("level") < done)
                & (F.col("cid") != F.col("top.cid"))).select(
                "value", *[F.col(c).alias(f"p_{c}") for c in
                           ("level", "cid", "n", "u", "kept", "more", "root", "values")])
            done = lowest
            # Nor can more of the first pivot's shingles be than the one with fewer has.
            most = F.least(F.least("kept", "p_kept") + F.least("more", "p_more"), most)
            could = ((F.col("u") + F.col("p_u")) * percent <= most * (100 - percent)) & (
                most * 100 >= (F.col("n") + F.col("p_n") - most) * percent)
        could &= F.least("n", "p_n") * 100 >= F.greatest("n", "p_n") * percent
        pairs = member.join(pivots, "value").filter(could).filter(
            "cid <> p_cid" if first else
            "root <> p_root AND (level < p_level OR level = p_level AND cid < p_cid) "
            # Once for a pair: in the first list that both are in.
            "AND value = element_at(array_intersect(values, p_values), 1)")
        pairs = stored(pairs.select(F.col("p_cid").alias("a"), F.col("cid").alias("b")).distinct(),
                       "pairs")
        if not first and not pairs.limit(1).count():
            continue
        seen = stored(_compared(docs, classes, pairs, percent), "compared")
        if first:
            first, rows = False, stored(_with_kept(rows, seen), "members")
        new = seen.filter("link").select("a", "b")
        if new.limit(1).count():
            # What is tied already is a star, which takes fewer steps than its links.
            links = new if tied is None else tied.select(
                F.col("root").alias("a"), F.col("node").alias("b")).union(new)
            tied = stored(components(links), "tied")
    return tied


def _with_kept(rows: DataFrame, seen: DataFrame) -> DataFrame:
    """``rows`` with kept and more: how many shingles of its list's first pivot a member has, and
    how many others that are not its own. Both are the most they can be where ``seen`` has no count.
    """
    rest = F.col("n") - F.col("u")
    counts = seen.select(F.col("a").alias("_top"), F.col("b").alias("cid"), "shared")
    return rows.withColumn("_top", F.col("top.cid")).join(counts, ["_top", "cid"], "left").withColumn(
        "kept", F.coalesce("shared", rest)).withColumn(
        "more", F.when(F.col("cid") == F.col("_top"), F.lit(0)).otherwise(
            F.coalesce(rest - F.col("shared"), rest))).drop("_top", "shared")


def _compared(
    docs: DataFrame, classes: DataFrame, pairs: DataFrame, percent: int,
) -> DataFrame:
    """a, b, shared (the shingles both have) and link of the pairs whose sketches don't rule one out."""
    sketch = classes.select("cid", F.col("least"))
    ab = pairs.join(sketch.toDF("a", "la"), "a").join(sketch.toDF("b", "lb"), "b")
    union = F.slice(F.array_sort(F.transform(F.array_union("la", "lb"), _unsigned)), 1, RETAINED)
    both = F.transform(F.array_intersect("la", "lb"), _unsigned)
    least = F.array(*[F.lit(least_shared(percent, c) if c else 0) for c in range(RETAINED + 1)])
    likely = ab.withColumn("_union", union).filter(
        F.size(F.array_intersect("_union", both)) >= F.element_at(least, F.size("_union") + 1))
    likely = stored(likely.select("a", "b"), "likely")
    ids = likely.select(F.col("a").alias("cid")).union(likely.select("b")).distinct()
    wanted = stored(classes.join(ids, "cid").select("cid", "rep", "at", "d1", "d2", "n"), "wanted")
    full = stored(_full_sets(docs, wanted).groupBy("cid", "n").agg(
        F.first("own").alias("own")), "sets")
    whole = likely.join(full.toDF("a", "na", "oa"), "a").join(full.toDF("b", "nb", "ob"), "b")
    shared = F.size(F.array_intersect("oa", "ob"))
    return whole.select("a", "b", "na", "nb", shared.alias("shared")).select(
        "a", "b", "shared",
        (F.col("shared") * 100 >= (F.col("na") + F.col("nb") - F.col("shared")) * percent).alias("link"))


def _unsigned(value):
    """Values are ordered as unsigned numbers in the sketches."""
    return value.bitwiseXOR(F.lit(-(1 << 63)).cast("long"))


def near_copies(
    docs: DataFrame, percent: int = 80, text: str = "text", doc_id: str = "doc_id",
) -> DataFrame:
    """doc_id, t (a value of the text), n_shingles, component_id, kept for each row of ``docs``.

    Texts whose sets of 5-word shingles share at least ``percent`` of their union are linked;
    component_id is the least id that can be reached over links. Texts with equal sets are one
    class, found by a 128-bit mark, and only one of each class takes part in the search.

    Null and empty texts have no shingles and are linked with nothing. Rows with the same id
    count as one document: what is linked with one is linked with all. A row without an id
    takes part by its text: it gets the least id that it reaches, and ties what it links.
    Where a whole group has no id, component_id is null and the rows of one of its texts are
    kept. An empty table gives no rows. Other columns are not read.
    """
    narrow = spread(docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text"),
                                text_key(docs[text]).alias("t")))
    rows = stored(_sketches(narrow, RETAINED), "sketches")
    classes = stored(rows.filter("n > 0").groupBy("d1", "d2", "n").agg(
        F.min("doc_id").alias("rep"), F.min("t").alias("at"), F.first("least").alias("least")
        ).withColumn("cid", F.monotonically_increasing_id()), "classes")
    placed = stored(rows.drop("least").join(classes.select("d1", "d2", "n", "cid"),
                                            ["d1", "d2", "n"], "left").drop("d1", "d2"), "placed")
    again = placed.filter("cid IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.min("cid").alias("a"), F.max("cid").alias("b")).filter("a <> b")
    same_id = placed.join(again.select("doc_id", "a"), "doc_id").select(
        "a", F.col("cid").alias("b")).filter("a <> b")
    tied = _ties(narrow, classes, same_id, percent)
    if tied is None:
        tied = classes.select(F.col("cid").alias("node"), F.col("cid").alias("root")).limit(0)
    named = tied.join(classes.select(F.col("cid").alias("node"), "rep", "at"), "node")
    least = named.groupBy("root").agg(F.min("rep").alias("_least"), F.min("at").alias("_at"))
    names = named.join(least, "root").select(F.col("node").alias("cid"), "_least", "_at").union(
        classes.join(tied, classes["cid"] == tied["node"], "left_anti").select("cid", "rep", "at"))
    out = placed.join(names, "cid", "left").withColumn(
        "component_id", F.coalesce("_least", "doc_id"))
    return out.select(
        "doc_id", "t", F.col("n").alias("n_shingles"), "component_id",
        F.when(F.col("component_id").isNotNull(), F.col("doc_id").eqNullSafe(F.col("component_id")))
        .otherwise(F.coalesce(F.col("t").eqNullSafe(F.col("_at")) | F.col("_at").isNull(),
                              F.lit(True))).alias("kept"))


def one_of_each(docs: DataFrame, percent: int = 80) -> DataFrame:
    """The rows of ``docs``, all columns, that near copies leave: one document of each group.

    Of rows with the same id and text one stays.
    """
    stay = near_copies(docs, percent).filter("kept").select(
        id_key(F.col("doc_id")).alias("k"), "t").distinct()
    rows = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"),
                       id_key(docs["doc_id"]).alias("k"), text_key(docs["text"]).alias("t"))
    again = rows.groupBy("k", "t").agg(F.count("*").alias("n")).filter("n > 1")
    left = rows.join(stay, ["k", "t"], "left_semi")
    if again.limit(1).count():
        left = left.dropDuplicates(["k", "t"])
    return left.select("row.*")
