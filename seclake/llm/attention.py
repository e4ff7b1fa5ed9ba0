"""Quality classifier: attention-based multiple-instance learning over passages (9)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from seclake.llm.blocks import Block, blocks, small_batches, span_hashes
from seclake.llm.toxicity import labelled_sample
from seclake.session import spread

PASSAGE_WORDS = 200  # longer lines are cut into passages of so many words
FEATURES = (
    "words", "word_length", "symbols", "marks", "bars", "capitals", "shouted_words", "digits",
    "distinct_words", "same_as_last", "distinct_pairs", "ends_in_mark", "exclamations",
    "longest_word", "short_words", "non_ascii")


def _flags(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL, _MARK, _BAR = _flags(b"#*$%&<>=+^~@{}[]\\/_"), _flags(b".,;:!?'\"()-"), _flags(b"|")
_CAPITAL, _DIGIT = _flags(bytes(range(65, 91))), _flags(bytes(range(48, 58)))
_SMALL, _STOP = _flags(bytes(range(97, 123))), _flags(b".!?")
_HIGH = np.arange(256) >= 0xC0


def _total(values: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return sums[end] - sums[start]


def _distinct(group: np.ndarray, values: np.ndarray, groups: int) -> np.ndarray:
    order = np.lexsort((values, group))
    new = np.ones(len(values), bool)
    new[1:] = (values[order][1:] != values[order][:-1]) | (
        group[order][1:] != group[order][:-1])
    return np.bincount(group[order][new], minlength=groups)


def passages(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """Number of passages of each text and FEATURES of each passage.

    A passage is a line with words, cut after every PASSAGE_WORDS words. A text without words
    has none.
    """
    data, start, end = block.data, block.word_start, block.word_end
    n = len(start)
    if not n:
        return np.zeros(block.texts, np.int64), np.zeros((0, len(FEATURES)), np.float32)
    breaks = np.concatenate(([0], np.cumsum(data == 10)))
    line, doc = breaks[start], block.word_doc
    new = np.ones(n, bool)
    new[1:] = (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])
    at = np.arange(n)
    inside = at - np.maximum.accumulate(np.where(new, at, 0))
    new |= inside % PASSAGE_WORDS == 0
    first = np.append(np.flatnonzero(new), n)
    lo, hi = start[first[:-1]], end[first[1:] - 1]
    passage = np.cumsum(new) - 1
    count = len(lo)
    hashes = span_hashes(data, start, end)
    again = np.zeros(n, bool)
    again[1:] = (hashes[1:] == hashes[:-1]) & ~new[1:]
    pair = hashes.copy()
    pair[:-1] = pair[:-1] * np.uint64(0x9E3779B97F4A7C15) + hashes[1:]
    length = end - start
    capitals = _total(_CAPITAL[data], start, end)
    shouted = (capitals > 1) & (_total(_SMALL[data], start, end) == 0)
    words, chars = np.diff(first), np.maximum(hi - lo, 1)

    def per_word(flags):
        return _total(flags, first[:-1], first[1:]) / words

    columns = [
        np.log1p(words), per_word(length), _total(_SYMBOL[data], lo, hi) / words,
        _total(_MARK[data], lo, hi) / words, _total(_BAR[data], lo, hi) / words,
        _total(_CAPITAL[data], lo, hi) / chars, per_word(shouted),
        _total(_DIGIT[data], lo, hi) / chars, _distinct(passage, hashes, count) / words,
        per_word(again), _distinct(passage, pair, count) / words,
        _STOP[data[hi - 1]].astype(float), _total(data == 33, lo, hi) / words,
        np.log1p(np.maximum.reduceat(length, first[:-1])), per_word(length <= 3),
        _total(_HIGH[data], lo, hi) / chars]
    return np.bincount(doc[first[:-1]], minlength=block.texts), np.stack(columns, 1).astype(
        np.float32)


class AttentionModel:
    """Encoder, gated attention and output layer.

    h = tanh(E x); a = softmax over a text's passages of w (tanh(V h) * sigmoid(U h));
    z = sum of a h; score = sigmoid(c z + d). A text without passages has z = 0.
    """

    def __init__(self, parts: dict[str, np.ndarray], mean: np.ndarray, scale: np.ndarray):
        self.parts, self.mean, self.scale = parts, mean, scale

    @classmethod
    def fresh(cls, mean, scale, hidden: int = 16, gates: int = 8, seed: int = 7):
        rng = np.random.default_rng(seed)
        width = len(mean)

        def some(*shape):
            return rng.normal(0, 1 / np.sqrt(shape[0]), shape)

        return cls({"E": some(width, hidden), "e": np.zeros(hidden), "V": some(hidden, gates),
                    "U": some(hidden, gates), "w": some(gates), "c": some(hidden),
                    "d": np.zeros(1)}, mean, scale)

    def forward(self, x: np.ndarray, count: np.ndarray) -> dict[str, np.ndarray]:
        p = self.parts
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        h = np.tanh(x @ p["E"] + p["e"])
        v, u = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        raw = (v * u) @ p["w"]
        some = np.flatnonzero(count)
        starts = (np.cumsum(count) - count)[some]
        bag = np.repeat(np.arange(len(some)), count[some])
        z = np.zeros((len(count), h.shape[1]))
        a = np.zeros(len(x))
        if len(some):
            raw = np.exp(raw - np.maximum.reduceat(raw, starts)[bag])
            a = raw / np.add.reduceat(raw, starts)[bag]
            z[some] = np.add.reduceat(a[:, None] * h, starts, axis=0)
        logit = np.clip(z @ p["c"] + p["d"], -30, 30)
        return {"x": x, "h": h, "v": v, "u": u, "a": a, "z": z, "bag": bag, "some": some,
                "starts": starts, "score": 1 / (1 + np.exp(-logit))}

    def gradient(self, x, count, label) -> dict[str, np.ndarray]:
        """Of the mean log loss."""
        p, f = self.parts, self.forward(x, count)
        off = (f["score"] - label) / len(label)
        dz = (off[:, None] * p["c"])[f["some"]][f["bag"]]
        h, a, v, u = f["h"], f["a"], f["v"], f["u"]
        da = (dz * h).sum(1)
        dh = dz * a[:, None]
        mean = np.add.reduceat(a * da, f["starts"])[f["bag"]]
        draw = a * (da - mean)
        dv, du = draw[:, None] * p["w"] * u * (1 - v * v), draw[:, None] * p["w"] * v * u * (1 - u)
        dh = (dh + dv @ p["V"].T + du @ p["U"].T) * (1 - h * h)
        return {"E": f["x"].T @ dh, "e": dh.sum(0), "V": h.T @ dv, "U": h.T @ du,
                "w": draw @ (v * u), "c": f["z"].T @ off, "d": np.array([off.sum()])}

    def scores(self, x: np.ndarray, count: np.ndarray) -> np.ndarray:
        return self.forward(x.astype(np.float64), count)["score"]


def fit(
    x: np.ndarray, count: np.ndarray, label: np.ndarray, rounds: int = 40, batch: int = 256,
    rate: float = 0.01, decay: float = 1e-4, seed: int = 7,
) -> AttentionModel:
    """Adam over small batches of texts."""
    model = AttentionModel.fresh(x.mean(0), x.std(0) + 1e-3, seed=seed)
    rng = np.random.default_rng(seed)
    first = np.concatenate(([0], np.cumsum(count)))
    moment = {k: np.zeros_like(v) for k, v in model.parts.items()}
    square = {k: np.zeros_like(v) for k, v in model.parts.items()}
    step = 0
    for _ in range(rounds):
        order = rng.permutation(len(count))
        for lo in range(0, len(order), batch):
            own = order[lo:lo + batch]
            if not count[own].any():
                continue
            rows = np.concatenate([np.arange(first[i], first[i + 1]) for i in own])
            step += 1
            for k, g in model.gradient(x[rows], count[own], label[own]).items():
                g = g + decay * model.parts[k]
                moment[k] = 0.9 * moment[k] + 0.1 * g
                square[k] = 0.999 * square[k] + 0.001 * g * g
                model.parts[k] = model.parts[k] - rate * (moment[k] / (1 - 0.9 ** step)) / (
                    np.sqrt(square[k] / (1 - 0.999 ** step)) + 1e-8)
    return model


def _mapped(docs: DataFrame, text: str, doc_id: str, schema: str, result) -> DataFrame:
    """Rows of ``result(counts, features)`` beside the id of each text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(block.lo, block.texts), result(*passages(block))],
                    ["doc_id", "value"])

    small_batches(docs.sparkSession)
    narrow = spread(docs.select(docs[doc_id].alias("doc_id"), docs[text].alias("text")))
    kind = narrow.schema["doc_id"].dataType.simpleString()
    return narrow.mapInArrow(run, f"doc_id {kind}, value {schema}")


def _as_lists(count: np.ndarray, x: np.ndarray) -> pa.Array:
    at = np.concatenate(([0], np.cumsum(count))) * len(FEATURES)
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(x.ravel()))


def train(
    docs: DataFrame, labels: DataFrame, may_train: Column, rows: int = 6_000,
    most_passages: int = 150_000, **options,
) -> AttentionModel | float:
    """Fit on about ``rows`` labelled texts at most and, of those, on as many whole texts as
    have ``most_passages`` passages together (in order of a hash of the id); the driver holds
    no more. A number, the share of good texts, when labels show no two classes."""
    known, texts = labelled_sample(docs, labels, "quality", may_train, rows)
    got = _mapped(texts, "text", "doc_id", "array<float>", _as_lists).join(known, "doc_id")
    order = F.xxhash64(F.lit("order"), F.col("doc_id").cast("string"))
    fits = F.size("value") <= most_passages * len(FEATURES)
    data = got.filter(fits).select("value", "label", order.alias("o"), "doc_id")
    x, count, label, total = [], [], [], 0
    for row in data.sort("o", "doc_id").toLocalIterator():
        n = len(row["value"]) // len(FEATURES)
        total += n
        if total > most_passages:
            break
        x.append(np.array(row["value"], np.float32).reshape(n, len(FEATURES)))
        count.append(n)
        label.append(row["label"])
    label, count = np.array(label), np.array(count, np.int64)
    if not count.sum() or len(np.unique(label)) < 2:
        return float(label.mean()) if len(label) else 0.0
    return fit(np.concatenate(x), count, label, **options)


def quality_scores(
    docs: DataFrame, labels: DataFrame, may_train: Column | None = None, text: str = "text",
    doc_id: str = "doc_id", **options,
) -> DataFrame:
    """doc_id and score, 0 to 1, of each row of ``docs``; higher is better.

    Learns from ``labels`` (doc_id, quality) where ``may_train``, an expression over doc_id,
    holds. Every passage of a text is encoded and weighed. A text without words has no passage
    and gets the score of an empty bag. Repeated rows and null ids are scored each for itself;
    null labels teach nothing. Without labels of both classes every score is the share of good
    ones, 0 without any. Only doc_id and text are read. No shuffle of texts.
    """
    model = train(docs, labels, F.lit(True) if may_train is None else may_train, **options)
    if isinstance(model, float):
        return docs.select(docs[doc_id].alias("doc_id"), F.lit(model).alias("score"))
    return _mapped(docs, text, doc_id, "double", lambda count, x: pa.array(
        model.scores(x, count))).withColumnRenamed("value", "score")
