"""Mixing sources to target weights with Pareto order sampling (2)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from seclake.operators.ordered import positions
from seclake.session import cut

BUCKETS = 65_536
MOST_SENT = 20_000  # sources sent to every executor at most; beyond that they are joined
CLOSING_STEPS = 2
_ROOM = float(1 << 52)


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _draw(seed: str, doc_id: Column, text: Column) -> Column:
    """A number between 0 and 1 that follows from the row alone."""
    own = F.concat_ws(":", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("")),
                      F.md5(F.coalesce(text, F.lit(""))))
    return (F.conv(F.substring(F.md5(own), 1, 13), 16, 10).cast("double") + 0.5) / _ROOM


def source_targets(
    sizes: DataFrame, weights: Sequence[float], total: float, repeats: float,
) -> DataFrame:
    """source, source_size, target: words for each source.

    Sources in order of their name (null last) get the weights in turn. They share ``total``
    times all words; a target stops at ``repeats`` times its source's words, and what is left
    over goes to the others by weight, until none is above. One number, the words per weight,
    rises from round to round.
    """
    sources = cut(sizes.groupBy("source").agg(F.sum("size").alias("source_size")))
    placed = positions(sources, [], [F.col("source").asc_nulls_last()], "_place")
    table = cut(placed.withColumn("_weight", F.element_at(
        F.array(*[F.lit(float(w)) for w in weights]),
        (F.col("_place") % len(weights) + 1).cast("int"))))
    most = F.lit(repeats) * F.col("source_size")
    whole = total * (table.agg(F.sum("source_size")).first()[0] or 0)
    each = 0.0
    while True:
        full = most <= F.col("_weight") * F.lit(each)
        at_most, weight = table.agg(
            F.sum(F.when(full, most)), F.sum(F.when(~full, F.col("_weight")))).first()
        higher = (whole - (at_most or 0.0)) / weight if weight else each
        if higher <= each:
            break
        each = higher
    wanted = F.col("_weight") * F.lit(each)
    return table.select("source", "source_size", F.least(most, wanted).alias("target"))


def _with_source(rows: DataFrame, table: DataFrame, few: bool) -> DataFrame:
    names = [c for c in table.columns if c != "source"]
    other = table.select(F.col("source").alias("_s"), *names)
    other = F.broadcast(other) if few else other
    return rows.join(other, rows["source"].eqNullSafe(F.col("_s")), "left").drop("_s")


def mix(
    docs: DataFrame, weights: Sequence[float] = (3, 1, 2), total: float = 1.5,
    repeats: float = 2.0, seed: str = "mix", text: str = "text", doc_id: str = "doc_id",
    source: str = "source",
) -> tuple[DataFrame, DataFrame]:
    """What the mix takes of each row, and the targets of the sources.

    The first frame has doc_id, source, size (words) and the row's random number; the second
    what ``with_copies`` needs to know of each source.

    Every row is expected target / source_size times. The whole part is certain. For the rest,
    rows are ranked by random odds over inclusion odds, u/(1-u) over p/(1-p), and the sample is
    the start of that order whose words come nearest to what the source still needs. Then up
    to CLOSING_STEPS further rows per source fill the gap: the longest that fit it.
    The random number follows from seed, id and text, so reruns agree.

    Ranks are cut by a histogram of 65,536 buckets per source; only the rows of the bucket
    that holds the cut are put in order, so a source with a third of all rows is no burden.
    """
    rows = cut(docs.select(
        docs[doc_id].alias("doc_id"), docs[source].cast("string").alias("source"),
        word_count(docs[text]).alias("size"), _draw(seed, docs[doc_id], docs[text]).alias("_u")))
    targets = cut(source_targets(rows, weights, total, repeats))
    few = targets.limit(MOST_SENT + 1).count() <= MOST_SENT

    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = targets.select(
        "*", F.floor(ratio).alias("_whole"), (ratio - F.floor(ratio)).alias("_p")).withColumn(
        "_need", F.col("target") - F.col("_whole") * F.col("source_size"))
    odds = (F.col("_u") / (1 - F.col("_u"))) / (F.col("_p") / (1 - F.col("_p")))
    ranked = _with_source(rows, plan, few).withColumn(
        "_rank", F.when(F.col("_p") > 0, odds / (1 + odds)).otherwise(1.0)).withColumn(
        "_bucket", F.floor(F.col("_rank") * BUCKETS)).withColumn(
        "_key", F.struct("_rank", "_u", "doc_id", "size"))
    ranked = cut(ranked.filter((F.col("_p") > 0) & (F.col("size") > 0)).select(
        "source", "_need", "_bucket", "_key"))

    upto = Window.partitionBy("source").orderBy("_bucket").rowsBetween(
        Window.unboundedPreceding, 0)
    sums = ranked.groupBy("source", "_need", "_bucket").agg(F.sum("_key.size").alias("_words"))
    cuts = sums.withColumn("_upto", F.sum("_words").over(upto)).filter(
        F.col("_upto") >= F.col("_need")).groupBy("source").agg(
        F.min_by(F.struct(F.col("_bucket").alias("_cut"),
                          (F.col("_upto") - F.col("_words")).alias("_ahead")),
                 "_bucket").alias("_at")).select("source", "_at.*")
    cuts = cut(cuts)
    inside = _with_source(ranked, cuts, few).filter(F.col("_bucket") == F.col("_cut"))
    # Rows alike in source, id, size and number come in or stay out together.
    units = inside.groupBy("source", "_need", "_ahead", "_key").agg(
        F.sum("_key.size").alias("_words"))
    order = Window.partitionBy("source").orderBy("_key").rowsBetween(
        Window.unboundedPreceding, 0)
    ends = units.withColumn("_end", F.col("_ahead") + F.sum("_words").over(order)).select(
        "source", "_need", F.col("_key").alias("_last"), F.col("_end").cast("double"))
    before = inside.groupBy("source", "_need").agg(F.first("_ahead").alias("_end")).select(
        "source", "_need", F.lit(None).cast(ends.schema["_last"].dataType).alias("_last"),
        F.col("_end").cast("double"))
    nearest = ends.unionByName(before).groupBy("source", "_need").agg(F.min_by(
        F.struct("_last", "_end"), F.struct(F.abs(F.col("_end") - F.col("_need")), "_end")
    ).alias("_best"))
    state = cut(_with_source(nearest.select("source", "_need", "_best.*"), cuts, few).select(
        "source", "_cut", "_last", (F.col("_need") - F.col("_end")).alias("_gap"),
        F.array().cast(f"array<{ends.schema['_last'].dataType.simpleString()}>").alias("_extra")))
    for _ in range(CLOSING_STEPS):
        out = _with_source(ranked.drop("_need"), state, few).filter(
            ~picked() & (F.col("_key.size") <= F.col("_gap")))
        units = out.groupBy("source", "_key").agg(F.sum("_key.size").alias("_words"))
        # Of equal lengths the one first in rank order.
        best = _with_source(units, state.select("source", "_gap"), few).filter(
            F.col("_words") <= F.col("_gap")).groupBy("source").agg(F.max_by(
                F.struct("_key", "_words"),
                F.struct("_words", -F.col("_key._rank"), -F.col("_key._u"))).alias("_next"))
        state = cut(_with_source(state, best, few).select(
            "source", "_cut", "_last",
            (F.col("_gap") - F.coalesce("_next._words", F.lit(0))).alias("_gap"),
            F.when(F.col("_next").isNull(), F.col("_extra")).otherwise(
                F.array_append("_extra", F.col("_next._key"))).alias("_extra")))
    taking = plan.select("source", "source_size", "target", "_whole", "_p")
    return rows, cut(_with_source(taking, state.drop("_gap"), few))


def picked() -> Column:
    """Whether a row's ``_key`` is in its source's sample."""
    before = F.col("_bucket") < F.col("_cut")
    at = (F.col("_bucket") == F.col("_cut")) & F.coalesce(
        F.col("_key") <= F.col("_last"), F.lit(False))
    return F.coalesce(before | at | F.array_contains("_extra", F.col("_key")), F.lit(False))


def with_copies(rows: DataFrame, state: DataFrame) -> DataFrame:
    """Rows with doc_id, source, size, _u joined to their source's targets and ``copies``."""
    few = state.limit(MOST_SENT + 1).count() <= MOST_SENT
    odds = (F.col("_u") / (1 - F.col("_u"))) / (F.col("_p") / (1 - F.col("_p")))
    found = _with_source(rows, state, few).withColumn(
        "_rank", F.when(F.col("_p") > 0, odds / (1 + odds)).otherwise(1.0)).withColumn(
        "_bucket", F.floor(F.col("_rank") * BUCKETS)).withColumn(
        "_key", F.struct("_rank", "_u", "doc_id", "size"))
    sampled = (F.col("_p") > 0) & (F.col("size") > 0) & picked()
    return found.withColumn("copies", F.col("_whole") + sampled.cast("long")).drop(
        "_u", "_whole", "_p", "_cut", "_last", "_extra", "_rank", "_bucket", "_key")


def mix_report(docs: DataFrame, **options) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for each row of ``docs``.

    Null and empty texts have size 0 and take no words. A null source is a source of its own,
    the last. Rows alike in id, text and source are taken alike. An empty table gives no rows.
    Other columns are not read.
    """
    return with_copies(*mix(docs, **options)).withColumn("taken", F.col("copies") * F.col("size"))


def mixed_documents(docs: DataFrame, seed: str = "mix", **options) -> DataFrame:
    """The rows the mix takes, with all their columns and ``copies``, how often each is taken,
    and ``n_words``, the words of one. Columns of these names are replaced."""
    _, state = mix(docs, seed=seed, **options)
    rows = docs.withColumns({
        "_u": _draw(seed, docs["doc_id"], docs["text"]), "_words": word_count(docs["text"])})
    plain = rows.select(
        "doc_id", F.col("source").cast("string").alias("source"),
        F.col("_words").alias("size"), "_u",
        F.struct(*[docs[c] for c in docs.columns if c not in ("copies", "n_words")]).alias("_row"))
    taken = with_copies(plain, state).filter("copies > 0 AND size > 0")
    return taken.select("_row.*", F.col("copies"), F.col("size").alias("n_words"))
