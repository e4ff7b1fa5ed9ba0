"""Repeated bytes against every window in plain Python; suffix ranks against sorted suffixes."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from seclake.llm import byte_repeats as B
from seclake.llm import difference_cover as D
from seclake.llm.tables import Scratch, stored


def plain(texts, window=200):
    seen = Counter()
    raws = [(t or "").encode() for t in texts]
    for raw in raws:
        seen.update(raw[i:i + window] for i in range(len(raw) - window + 1))
    out = []
    for raw in raws:
        gone = [False] * len(raw)
        for i in range(len(raw) - window + 1):
            if seen[raw[i:i + window]] > 1:
                gone[i:i + window] = [True] * window
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(raw), sum(gone), spans, bytes(b for b, g in zip(raw, gone) if not g)))
    return out


def mine(docs_of, texts, **options):
    got = B.without_repeated_bytes(docs_of([(i, t) for i, t in enumerate(texts)]), **options).collect()
    return [tuple(r)[1:4] + (bytes(r.kept),) for r in sorted(got, key=lambda r: r.doc_id)]


def prose(lot, n):
    return "".join(lot.choice("abcdefgh éß\n") for _ in range(n))


def test_every_window(docs_of):
    lot = random.Random(4)
    common = [prose(lot, n) for n in (150, 199, 200, 201, 260, 420, 900)]
    texts = []
    for _ in range(60):
        parts = [prose(lot, lot.randrange(0, 300))]
        for _ in range(lot.randrange(4)):
            part = lot.choice(common)
            at = lot.randrange(len(part))
            changed = part[:at] + "#" + part[at + 1:] if lot.random() < 0.4 else part
            parts += [changed[lot.randrange(20):], prose(lot, lot.randrange(0, 120))]
        texts.append("".join(parts))
    texts += texts[:3]
    assert mine(docs_of, texts) == plain(texts)


def test_equal_letters_nulls_and_copies(docs_of):
    lot = random.Random(5)
    one = prose(lot, 700)
    texts = [None, "", "x" * 199, "x" * 200, "x" * 201, "y" * 1500, "ab" * 400, one, one, one[100:450],
             prose(lot, 100) + one + one, "short", "é" * 150]
    assert mine(docs_of, texts) == plain(texts)
    assert mine(docs_of, []) == []


def test_same_id_and_text_and_null_ids(spark, docs_of):
    lot = random.Random(6)
    one, other = prose(lot, 300), prose(lot, 300)
    rows = [(1, one), (1, one), (None, other), (None, other), (None, "z")]
    got = Counter((r.doc_id, r.n_removed) for r in B.without_repeated_bytes(docs_of(rows)).collect())
    size = [len(t.encode()) for t in (one, other)]
    assert got == Counter({(1, size[0]): 2, (None, size[1]): 2, (None, 0): 1})


def test_other_window_and_clashing_columns(spark, docs_of):
    lot = random.Random(7)
    part = prose(lot, 90)
    texts = [prose(lot, 50) + part + prose(lot, 40) for _ in range(4)] + [part[:70], part[:60]]
    assert mine(docs_of, texts, window=64) == plain(texts, 64)
    docs = docs_of([(i, t) for i, t in enumerate(texts)]).selectExpr(
        "doc_id", "text", "1 AS sid", "2 AS kept", "3 AS names", "4 AS k")
    got = B.without_repeated_bytes(docs, 64).orderBy("doc_id").collect()
    assert [r.n_removed for r in got] == [r[1] for r in plain(texts, 64)]


@pytest.mark.parametrize("seed,strings,longest,letters", [(0, 30, 40, 3), (1, 5, 200, 1), (2, 40, 30, 50)])
def test_suffix_ranks(spark, seed, strings, longest, letters):
    lot = random.Random(seed)
    rows = [[lot.randrange(-letters, letters) for _ in range(lot.randrange(1, longest))]
            for _ in range(strings)]
    rows[-1] = list(rows[0])
    df = stored(spark.createDataFrame(list(enumerate(rows)), "sid long, names array<long>"), "strings")
    ranks = {r.sid: r.ranks for r in D.suffix_ranks(df, 1000, Scratch(spark)).collect()}
    assert {s: len(r) for s, r in ranks.items()} == {i: len(r) for i, r in enumerate(rows)}
    pairs = sorted((rank, rows[s][at:]) for s, own in ranks.items() for at, rank in enumerate(own))
    suffixes = [suffix for _, suffix in pairs]
    for (rank, a), (other, b) in zip(pairs, pairs[1:]):
        assert a <= b or rank == other
    assert all(a <= b for a, b in zip(suffixes, suffixes[1:]))


def test_anchors_follow_from_the_bytes_around():
    lot = np.random.default_rng(3)
    shape = B.Shape(200)
    same = lot.integers(97, 110, 600).astype(np.uint8)
    texts = [np.concatenate((lot.integers(97, 110, n).astype(np.uint8), same,
                             lot.integers(97, 110, 50).astype(np.uint8))) for n in (0, 37, 400)]
    found = []
    for data, before in zip(texts, (0, 37, 400)):
        text = next(B._found(iter([data]), shape))
        names, size = text.names()
        at = text.anchors - before
        inside = (at >= shape.runs) & (at + shape.name <= 600)
        found.append((at[inside].tolist(), names[inside].tolist()))
        assert np.diff(text.anchors).max() <= shape.runs
    assert found[0] == found[1] == found[2] and len(found[0][0]) > 3


def test_texts_side_by_side_have_the_anchors_they_have_alone():
    lot, shape = np.random.default_rng(4), B.Shape(200)
    texts = [lot.integers(97, 100, n).astype(np.uint8) for n in (0, 5, 199, 200, 900, 31, 0, 4000, 201)]
    texts += [np.full(n, 120, np.uint8) for n in (199, 200, 201, 300)]
    together = list(B._found(iter(texts), shape))
    assert len(together) == len(texts)
    for data, text in zip(texts, together):
        alone = next(B._found(iter([data]), shape))
        assert np.array_equal(text.data, data) and text.windows == max(0, len(data) - 199)
        for part in ("anchors", "values", "least"):
            assert np.array_equal(getattr(text, part), getattr(alone, part)), (len(data), part)


def test_grams_are_ordered_by_small_numbers():
    """32 bits, the same for the same bytes wherever they stand, and never 0, which means no run."""
    rng = np.random.default_rng(5)
    data = rng.integers(0, 256, 5000).astype(np.uint8)
    data[3000:3500] = data[100:600]
    values = B._gram_values(data)
    assert values.dtype == np.uint32 and len(values) == 5000 - B.GRAM + 1 and values.min() > 0
    assert (values[3000:3469] == values[100:569]).all()
    assert len(np.unique(values)) == len(values) - 469
    for texts in ([data], [data[:40], data[40:300], data[300:], data[3000:3500]]):
        for text in B._found(iter(texts), B.Shape(200)):
            assert text.values.dtype == np.uint32


def test_small_batches_are_put_together():
    def one(*values):
        return pa.RecordBatch.from_arrays([pa.array(values, pa.int64())], ["x"])

    got = list(B._together(iter([one(1, None), one(), one(3), one(4), one()]), 3))
    assert [b.column(0).to_pylist() for b in got] == [[1, None, 3], [4]]
    assert not list(B._together(iter([one()])))


def test_few_windows_are_sorted_one_by_one(docs_of, monkeypatch):
    """Of windows at an edge of a repeat, those whose group is nowhere else, or is the same
    everywhere, are settled together."""
    lot = random.Random(8)
    common = [prose(lot, 600) for _ in range(3)]
    texts = [prose(lot, lot.randrange(100, 400)) + common[i % 3] + prose(lot, 200) for i in range(40)]
    sorted_rows = []

    def counted(values, met=B._met_again):
        sorted_rows.append(values.count())
        return met(values)

    monkeypatch.setattr(B, "_met_again", counted)
    assert mine(docs_of, texts) == plain(texts)
    assert 0 < sorted_rows[0] <= 40 * 3 * B.GROUP


@pytest.mark.parametrize("window", [64, 200])
def test_repeats_that_begin_and_end_anywhere_in_a_group(docs_of, window):
    lot = random.Random(9)
    one = prose(lot, window * 2)
    texts = [prose(lot, 40) + one[at:at + window + more] + prose(lot, 40)
             for at in range(0, 20) for more in (0, 1, 7, 9)]
    texts += [one[3:window + 3], one[:window - 1], one[5:window + 6] * 2]
    assert mine(docs_of, texts, window=window) == plain(texts, window)


@pytest.mark.parametrize("seed,strings,longest,letters", [(3, 30, 40, 2), (4, 5, 120, 1)])
def test_few_names_are_ranked_by_two_sorts(spark, monkeypatch, seed, strings, longest, letters):
    lot = random.Random(seed)
    rows = [[lot.randrange(-letters, letters) for _ in range(lot.randrange(1, longest))]
            for _ in range(strings)]
    rows[-1] = list(rows[0])
    sorts = []

    def counted(*args, ranked=D.ranked):
        sorts.append(args[1])
        return ranked(*args)

    monkeypatch.setattr(D, "ranked", counted)
    df = stored(spark.createDataFrame(list(enumerate(rows)), "sid long, names array<long>"), "strings")
    for depth, most in ((2, 2), (9, 2), (10, 4)):
        sorts.clear()
        ranks = {r.sid: r.ranks for r in D.suffix_ranks(df, depth, Scratch(spark)).collect()}
        pairs = sorted((rank, rows[s][at:at + depth]) for s, own in ranks.items()
                       for at, rank in enumerate(own))
        assert sum(map(len, rows)) == len(pairs) and len(sorts) <= most
        for (rank, a), (other, b) in zip(pairs, pairs[1:]):
            assert a <= b and (a == b or rank < other)


def test_values_of_bytes_behind_anchors_are_told_for_a_block_at_once(monkeypatch):
    lot, shape = np.random.default_rng(6), B.Shape(200)
    texts = [lot.integers(97, 100, n).astype(np.uint8) for n in (900, 5, 200, 0, 1500, 199, 201)]
    alone = [next(B._found(iter([data]), shape, shape.name)).names() for data in texts]
    calls = []

    def counted(*args, span_hashes=B.span_hashes):
        calls.append(1)
        return span_hashes(*args)

    monkeypatch.setattr(B, "span_hashes", counted)
    for text, data, (names, size) in zip(B._found(iter(texts), shape, shape.name), texts, alone):
        mine, own = text.names()
        assert np.array_equal(mine, names) and np.array_equal(own, size)
        assert np.array_equal(own, np.minimum(text.anchors + shape.name, len(data)) - text.anchors)
    assert len(calls) == 1


def test_first_anchor_of_windows_with_the_least_value():
    lot, shape = np.random.default_rng(7), B.Shape(64)
    for data in (lot.integers(97, 99, 700).astype(np.uint8), np.full(150, 97, np.uint8)):
        text = next(B._found(iter([data]), shape))
        for p in (np.arange(text.windows), np.flatnonzero(lot.random(text.windows) < 0.5)):
            plainly = [next(a for a in range(w, w + shape.runs) if text.values[a] == text.least[w])
                       for w in p.tolist()]
            assert text.anchors[text.first_least(p)].tolist() == plainly
    assert not len(text.first_least(np.zeros(0, np.int64)))


def in_order(rows, ranks):
    """Whether of any two suffixes that differ the lesser one has the smaller rank."""
    assert {s: len(r) for s, r in ranks.items()} == {i: len(r) for i, r in rows.items()}
    suffixes = sorted((rank, rows[s][at:]) for s, own in ranks.items() for at, rank in enumerate(own))
    return all(a == b or (a < b and rank < other)
               for (rank, a), (other, b) in zip(suffixes, suffixes[1:]))


@pytest.mark.parametrize("partitions", [1, 13])
def test_suffixes_are_ranked_to_their_end(spark, partitions):
    lot = random.Random(11)
    common = [[lot.randrange(50) for _ in range(n)] for n in (9, 10, 40, 130, 300)]
    rows = [[7] * n for n in (1, 2, 3, 60, 200, 200)] + [[1, 2] * 60, [2, 1, 2, 3] * 40, [3, 1, 2] * 50]
    for part in common:
        for _ in range(3):  # the same inside, at the start and at the end
            mine = [[lot.randrange(50) for _ in range(lot.randrange(8))] for _ in range(2)]
            rows += [mine[0] + part + mine[1], part + mine[1], mine[0] + part]
    rows += [common[4][:150] + [-5] + common[4][151:], common[4][:150] + [99] + common[4][151:]]
    rows = {i: row for i, row in enumerate(row for row in rows if row)}
    settings = {"spark.sql.shuffle.partitions": str(partitions),
                "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {key: spark.conf.get(key) for key in settings}
    try:
        for key, value in settings.items():
            spark.conf.set(key, value)
        df = stored(spark.createDataFrame(list(rows.items()), "sid long, names array<long>"), "strings")
        ranks = {r.sid: r.ranks for r in D.suffix_ranks(df, None, Scratch(spark)).collect()}
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert in_order(rows, ranks)


def test_ranks_that_are_there_once_go_no_further(spark, monkeypatch):
    lot = random.Random(12)
    part = [lot.randrange(1000) for _ in range(60)]
    rows = {i: [lot.randrange(10**9) for _ in range(600)] for i in range(8)}
    rows[8], rows[9] = part + [3] + rows[0][:5], part + [4] + rows[1][:5]
    asked = []

    def counted(strings, *more, own=D.suffix_ranks):
        asked.append(sum(len(r.names) for r in strings.collect()))
        return own(strings, *more)

    monkeypatch.setattr(D, "suffix_ranks", counted)
    df = stored(spark.createDataFrame(list(rows.items()), "sid long, names array<long>"), "strings")
    ranks = {r.sid: r.ranks for r in D.suffix_ranks(df, None, Scratch(spark)).collect()}
    assert in_order(rows, ranks)
    assert asked[0] > 4900 and 0 < asked[1] < 100 and len(asked) > 2


def test_texts_that_share_much_are_ranked_by_all_their_names(docs_of, monkeypatch):
    lot = random.Random(13)
    one = prose(lot, 4000)
    texts = [prose(lot, 150) + one + prose(lot, 250) for _ in range(3)] + ["ab" * 300 + one[:900], "ab" * 310]
    seen = []

    def told(strings, *more, own=D.suffix_ranks):
        ranks = own(strings, *more)
        if len(more) == 2:  # not for a shorter string
            seen.append(({r.sid: list(r.names) for r in strings.collect()},
                         {r.sid: r.ranks for r in ranks.collect()}))
        return ranks

    monkeypatch.setattr(D, "suffix_ranks", told)
    assert mine(docs_of, texts) == plain(texts)
    rows, ranks = seen[0]
    assert max(map(len, rows.values())) > 60 and in_order(rows, ranks)
