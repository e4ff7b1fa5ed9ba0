"""Toxicity: gradient-boosted trees over dense features, calibrated (5)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, functions as F

from seclake.llm.blocks import mix, released, small_batches, span_hashes, text_bytes
from seclake.session import cut, spread

# Word lists of this model; what the labels teach comes on top of them (learn_lexicons).
INSULTS = """
    airhead arse arsehole asshole bastard bitch bonehead brainless bullshit buffoon clown cretin
    crap crybaby cunt damn degenerate deranged dick dickhead dimwit dipshit douche douchebag
    dumb dumbass dumbo dunce failure fatso filth filthy fool foolish freak freakshow fuck fucker
    fucking garbage ghoul goon halfwit hypocrite idiot idiotic idiots ignorant imbecile incel
    jackass jerk kys lame leech liar loser losers lowlife lunatic maggot maniac moron moronic
    morons motherfucker nitwit numbskull nutcase oaf parasite pathetic peasant pig pigs pinhead
    prick psycho pussy rat retard retarded rubbish savage scoundrel scum scumbag shameful shit
    shithead shitty sicko simpleton skank slob slut snowflake spineless stupid stupidity subhuman
    sucker swine thug trash trashy twat twit ugly useless vermin vile waste weirdo whore wimp
    worm worthless wretch
""".split()
HOSTILE = """
    abomination contempt despicable despise detest disgrace disgraceful disgust disgusting
    disgusts hate hated hateful hates horrible insane inferior laughable miserable nasty
    repulsive revolting ridiculous rotten sick sickening toxic unbearable vulgar
""".split()
THREATS = """
    attack beat bleed burn choke crush destroy die dies dying exterminate hang hurt kill killed
    murder punch rape shoot slap slaughter smash stab strangle suffer suicide torture
""".split()
SECOND_PERSON = """
    you your yours yourself u ur ya youre
    du dich dir dein deine deinen deinem deiner ihr euch euer eure
    tu te toi ton ta tes vous votre vos
    tú ti usted ustedes vosotros vuestro vuestra tus contigo
""".split()

NEAR_WORDS = 6
FEATURES = (
    "insults", "hostile", "threats", "insult_share", "hostile_share", "threat_share",
    "kinds_of_insult", "insults_near_person", "hostile_near_person", "second_person",
    "capital_letters", "shouted_words", "shouted_insults", "exclamations", "questions",
    "punctuation", "repeated_marks", "disguised_insults", "disguised_share",
    "letters_with_digits", "words",
    "learnt", "learnt_share", "learnt_weight", "greatest_weight", "learnt_near_person",
    "learnt_disguised")
BEGINNINGS = (4, 5, 6, 7)
LEXICON = 5_000
FOLDS = 3

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256), *b"@$!*"]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_PLAIN = _LOWER.copy()  # digits and signs that stand for letters
_PLAIN[list(b"0134578@$!")] = np.frombuffer(b"oieastbasi", np.uint8)
_UPPER, _DIGIT, _LETTER = np.zeros(256, bool), np.zeros(256, bool), np.zeros(256, bool)
_UPPER[65:91] = _DIGIT[48:58] = True
_LETTER[[*range(65, 91), *range(97, 123)]] = True
_MARKS = np.zeros(256, bool)
_MARKS[list(b"!?.,;:\"'()-#*$%&|<>")] = True


def _hashed(words: list[str]) -> np.ndarray:
    raw = [w.encode() for w in words]
    ends = np.cumsum([len(r) for r in raw])
    return np.unique(span_hashes(
        np.frombuffer(b"".join(raw), np.uint8), np.concatenate(([0], ends[:-1])), ends))


_LISTS = [_hashed(words) for words in (INSULTS, HOSTILE, THREATS, SECOND_PERSON)]


def _tokens(offsets: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word. Marks at its end are punctuation, not letters in disguise."""
    size = len(raw)
    inside = _WORD[raw]
    edge = np.zeros(size + 1, bool)
    edge[offsets] = True
    before, after = np.ones(size, bool), np.ones(size, bool)
    before[1:], after[:-1] = ~inside[:-1], ~inside[1:]
    start = np.flatnonzero(inside & (before | edge[:-1]))
    end = np.flatnonzero(inside & (after | edge[1:])) + 1
    for _ in range(3):
        shorter = (end - start > 1) & np.isin(raw[end - 1], list(b"!*$@"))
        end = end - shorter
    return start, end


def _units(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple]:
    """What a lexicon is made of: words without disguise, and their beginnings.

    Gives numbers of words and the value of each one's unit.
    """
    plain = _PLAIN[raw]
    yield np.arange(len(start)), span_hashes(plain, start, end)
    for n in BEGINNINGS:
        some = np.flatnonzero(end - start > n)
        yield some, mix(span_hashes(plain, start[some], start[some] + n) + np.uint64(n))


class Lexicon:
    """Values of units and how much likelier each is in toxic texts (log of the ratio)."""

    def __init__(self, values=(), weights=()):
        order = np.argsort(np.array(values, np.uint64))
        self.values = np.array(values, np.uint64)[order]
        self.weights = np.array(weights, np.float64)[order]

    def of(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Weight of each word: that of its heaviest unit, 0 without one."""
        out = np.zeros(len(start))
        if not len(self.values):
            return out
        for some, values in _units(raw, start, end):
            at = np.minimum(np.searchsorted(self.values, values), len(self.values) - 1)
            out[some] = np.maximum(out[some], np.where(self.values[at] == values, self.weights[at], 0))
        return out


def _in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
    return known[at] == values


def _total(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return sums[end] - sums[start]


def features(offsets: np.ndarray, raw: np.ndarray, lexicon: Lexicon) -> np.ndarray:
    """One row of FEATURES for each text."""
    texts, size = len(offsets) - 1, len(raw)
    out = np.zeros((texts, len(FEATURES)))
    if not size:
        return out
    edge = np.zeros(size + 1, bool)
    edge[offsets] = True
    start, end = _tokens(offsets, raw)
    first = np.searchsorted(start, offsets)
    n = np.diff(first)
    plain = span_hashes(_LOWER[raw], start, end)
    disguised = span_hashes(_PLAIN[raw], start, end)
    insult, hostile, threat, person = (_in(plain, known) for known in _LISTS)
    hidden = (plain != disguised) & _in(disguised, _LISTS[0]) & ~insult

    # Words up to NEAR_WORDS away in the same text.
    doc = np.repeat(np.arange(texts), n)
    at = np.arange(len(start))
    lo = np.maximum(at - NEAR_WORDS, first[doc])
    hi = np.minimum(at + NEAR_WORDS + 1, first[doc + 1])
    close = _total(person, lo, hi) > 0

    letters = _total(_LETTER[raw], start, end)
    shouted = (_total(_UPPER[raw], start, end) == end - start) & (end - start > 2)
    mixed = (_total(_DIGIT[raw], start, end) > 0) & (letters > 0)
    bad = insult | hidden
    kinds = np.unique(np.stack([doc[bad].astype(np.uint64), mix(disguised[bad])], 1), axis=0) \
        if bad.any() else np.zeros((0, 2), np.uint64)
    weight = lexicon.of(raw, start, end)
    learnt = weight > 0
    greatest = np.zeros(texts)
    np.maximum.at(greatest, doc, weight)
    mark = _MARKS[raw]
    again = np.zeros(size, bool)
    again[1:] = mark[1:] & (raw[1:] == raw[:-1]) & ~edge[1:-1]

    def words(flags):
        return _total(flags, first[:-1], first[1:])

    def chars(flags):
        return _total(flags, offsets[:-1], offsets[1:])

    many, long = np.maximum(n, 1), np.maximum(np.diff(offsets), 1)
    counts = [words(x) for x in (insult, hostile, threat)]
    columns = [
        *counts, *[100 * c / many for c in counts],
        np.bincount(kinds[:, 0].astype(np.int64), minlength=texts),
        words(bad & close), words(hostile & close), 100 * words(person) / many,
        chars(_UPPER[raw]) / np.maximum(chars(_LETTER[raw]), 1), words(shouted) / many,
        words(shouted & bad), 100 * chars(raw == 33) / long, 100 * chars(raw == 63) / long,
        100 * chars(mark) / long, 100 * chars(again) / long,
        words(hidden), 100 * words(hidden) / many, words(mixed) / many, np.log1p(n),
        words(learnt), 100 * words(learnt) / many,
        np.bincount(doc, weights=weight, minlength=texts), greatest, words(learnt & close),
        words(learnt & (plain != disguised))]
    out[:] = np.stack(columns, 1)
    return out


def with_features(
    docs: DataFrame, lexicons: list[Lexicon], carry: Column | None = None, fold: Column | None = None,
) -> DataFrame:
    """``carry`` (as a column of its alias; doc_id without) and features, an array of doubles,
    of each row. ``fold`` tells which of the lexicons is a row's own; the last one without."""
    width = len(FEATURES)
    narrow = spread(docs.select(
        F.col("doc_id") if carry is None else carry,
        (F.lit(len(lexicons) - 1) if fold is None else fold).cast("int").alias("_fold"), docs["text"]))
    name, kind = narrow.columns[0], narrow.schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, raw = text_bytes(batch.column(2))
            own = batch.column(1).to_numpy()
            lo = 0
            while lo < batch.num_rows:
                hi = max(lo + 1, int(np.searchsorted(at, at[lo] + (1 << 20), "right")) - 1)
                got = np.zeros((hi - lo, width))
                for k in np.unique(own[lo:hi]):
                    some = own[lo:hi] == k
                    got[some] = features(at[lo:hi + 1] - at[lo], raw[at[lo]:at[hi]], lexicons[k])[some]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo),
                    pa.ListArray.from_arrays(
                        pa.array(np.arange(hi - lo + 1, dtype=np.int32) * width),
                        pa.array(got.ravel()))], [name, "features"])
                lo = hi

    small_batches(docs.sparkSession)
    return narrow.mapInArrow(released(run), f"{name} {kind}, features array<double>")


def learn_lexicons(
    labelled: DataFrame, folds: int = FOLDS, most: int = LEXICON, least_ratio: float = 3.0,
    least_share: float = 0.005,
) -> list[Lexicon]:
    """A lexicon without the texts of each fold, and at last one of all texts.

    ``labelled`` has text, label and fold. A unit counts once per text. It is in if at least
    ``least_share`` of the toxic texts hold it, three at least, and they do so e^least_ratio
    times as often as the others; of more than ``most`` units those in the most toxic texts
    stay. So every language is learnt that the labels hold, and none that they don't.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: dict[int, list] = {}
        for batch in batches:
            at, raw = text_bytes(batch.column(0))
            group = batch.column(1).to_numpy() * 2 + batch.column(2).to_numpy().astype(np.int64)
            for i in range(batch.num_rows):
                own = raw[at[i]:at[i + 1]]
                if len(own):
                    start, end = _tokens(np.array([0, len(own)]), own)
                    units = [values for _, values in _units(own, start, end)]
                    told.setdefault(int(group[i]), []).append(np.unique(np.concatenate(units)))
        for key, parts in told.items():
            values, times = np.unique(np.concatenate(parts), return_counts=True)
            yield pa.RecordBatch.from_arrays([
                pa.array(values.view(np.int64)), pa.array(np.full(len(values), key, np.int32)),
                pa.array(times.astype(np.int64))], ["unit", "part", "times"])

    small_batches(labelled.sparkSession)
    sizes = {r["part"]: r["count"] for r in labelled.groupBy(
        (F.col("fold") * 2 + F.col("label")).cast("int").alias("part")).count().collect()}
    # Rare units of toxic texts can't get in; of the rest there are no more than those texts have.
    counted = labelled.select("text", F.col("fold").cast("long").alias("fold"), "label").mapInArrow(
        released(run), "unit long, part int, times long").groupBy("unit").agg(*[
            F.sum(F.when(F.col("part") == part, F.col("times")).otherwise(0)).alias(f"n{part}")
            for part in range(2 * folds)])
    toxic = sum((F.col(f"n{2 * k + 1}") for k in range(folds)), F.lit(0))
    counted = cut(counted.filter(toxic >= 3))
    out = []
    for left_out in [*range(folds), None]:
        used = [k for k in range(folds) if k != left_out]
        bad, good = (sum((F.col(f"n{2 * k + y}") for k in used), F.lit(0)) for y in (1, 0))
        n_bad, n_good = (sum(sizes.get(2 * k + y, 0) for k in used) for y in (1, 0))
        weight = F.log((bad + 0.5) / (n_bad + 1)) - F.log((good + 0.5) / (n_good + 1))
        rows = counted.select("unit", bad.alias("bad"), weight.alias("weight")).filter(
            (F.col("bad") >= max(3, least_share * n_bad)) & (F.col("weight") > least_ratio)).orderBy(
            F.desc("bad"), F.desc("weight"), "unit").limit(most).collect()
        out.append(Lexicon(np.array([r["unit"] for r in rows], np.int64).view(np.uint64),
                           [r["weight"] for r in rows]))
    return out


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo ``by``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % by


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, may_train: Column, rows: int,
) -> tuple[DataFrame, DataFrame]:
    """About ``rows`` labelled ids at most, and the documents they are of.

    The sample is by a hash of the id, so both sides are filtered before anything is joined.
    ``may_train`` is an expression over doc_id. A repeated id counts as 1 if any label is.
    """
    known = labels.filter(F.col(label).isNotNull() & may_train).groupBy("doc_id").agg(
        F.max(label).cast("double").alias("label"))
    share = min(1.0, rows / max(1, known.count()))
    draw = F.pmod(F.xxhash64(F.lit("sample"), F.col("doc_id").cast("string")), F.lit(1 << 20))
    inside = draw < F.lit(int(share * (1 << 20)))
    return known.filter(inside), docs.filter(inside & may_train)


class ToxicityModel:
    """Trees and calibration, or one constant score when labels show no two classes."""

    def __init__(self, trees=None, calibration=None, constant: float = 0.0, lexicon=None):
        self.trees, self.calibration, self.constant = trees, calibration, constant
        self.lexicon = lexicon or Lexicon()

    def scored(self, featured: DataFrame) -> DataFrame:
        """Adds score, from 0 to 1."""
        if self.trees is None:
            return featured.withColumn("score", F.lit(self.constant))
        vectors = featured.withColumn("_x", array_to_vector("features"))
        raw = self.trees.transform(vectors).withColumn(
            "_p", vector_to_array("_probability")[1])
        out = self.calibration.transform(raw)
        return out.select(*featured.columns, F.greatest(
            F.lit(0.0), F.least(F.lit(1.0), F.col("_score"))).alias("score"))


def train(
    docs: DataFrame, labels: DataFrame, may_train: Column, rows: int = 20_000,
    trees: int = 16, depth: int = 3, seed: int = 7,
) -> ToxicityModel:
    """Trees on three quarters of a sample of at most about ``rows`` labelled texts; the
    isotonic map from their probability to the share of toxic texts on the other quarter.

    The lexicon is learnt from the same texts, but the features of a text come from one that
    has not seen its fold; only texts that are scored later get the one of all folds.
    """
    known, texts = labelled_sample(docs, labels, "toxic", may_train, rows)
    data = texts.select("doc_id", "text").join(known, "doc_id").withColumn(
        "fold", F.pmod(F.xxhash64(F.lit("lexicon"), F.col("doc_id").cast("string")), F.lit(FOLDS)))
    data = cut(data)
    lexicons = learn_lexicons(data)
    rows_ = with_features(
        data, lexicons, F.struct("doc_id", "label").alias("row"), F.col("fold")).select("row.*", "features")
    data = cut(rows_.select(
        "doc_id", array_to_vector("features").alias("_x"), "label",
        (F.pmod(F.xxhash64(F.lit("fold"), F.col("doc_id").cast("string")), F.lit(4)) == 0
         ).alias("_later")))
    seen = {(r["_later"], r["label"]): r["count"]
            for r in data.groupBy("_later", "label").count().collect()}
    positive = sum(n for (_, y), n in seen.items() if y == 1.0)
    everything = sum(seen.values())
    if len(seen) < 4:
        return ToxicityModel(constant=positive / everything if everything else 0.0)
    trees_ = GBTClassifier(
        featuresCol="_x", labelCol="label", predictionCol="_class", maxIter=trees, maxDepth=depth,
        stepSize=0.3, minInstancesPerNode=10, seed=seed, checkpointInterval=-1)
    model = trees_.setProbabilityCol("_probability").setRawPredictionCol("_raw").fit(
        data.filter(~F.col("_later")).coalesce(4))
    later = model.transform(data.filter("_later")).withColumn(
        "_p", vector_to_array("_probability")[1])
    calibration = IsotonicRegression(
        featuresCol="_p", labelCol="label", predictionCol="_score").fit(later)
    return ToxicityModel(model, calibration, lexicon=lexicons[-1])


def toxicity(
    docs: DataFrame, labels: DataFrame, may_train: Column | None = None, **options,
) -> DataFrame:
    """doc_id, features and score of each row of ``docs``.

    Learns from ``labels`` (doc_id, toxic) where ``may_train``, an expression over doc_id,
    holds. Null and empty texts have features of 0 and are scored like any other. Repeated
    rows and null ids are scored each for itself; null labels teach nothing. Without labels
    of both classes every score is the share of toxic ones, 0 without any. Only doc_id and
    text are read.
    """
    model = train(docs, labels, F.lit(True) if may_train is None else may_train, **options)
    return model.scored(with_features(docs, [model.lexicon]))


def without_toxic(
    docs: DataFrame, labels: DataFrame, reject_from: float, may_train: Column | None = None,
    **options,
) -> DataFrame:
    """The rows of ``docs``, all columns, whose score is below ``reject_from``."""
    model = train(docs, labels, F.lit(True) if may_train is None else may_train, **options)
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    return model.scored(with_features(docs, [model.lexicon], row)).filter(
        F.col("score") < reject_from).select("row.*")
