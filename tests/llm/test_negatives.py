"""Hard negatives against all scores in plain Python; the index against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from seclake.llm import negatives as N

SCHEMA = "row_id long, label long, vector array<double>, chunk int, low int"


def plain(rows, anchor, positives=5, negatives=10):
    good = [(i, lab, v) for i, lab, v in rows if i is not None and lab is not None and v is not None
            and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for a, lab, v in good:
        if not anchor(a):
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w)), i, other) for i, other, w in good if i != a)
        tops = [(i, -s) for s, i, other in scored if other == lab][:positives]
        for p, ps in tops:
            near = [(i, -s) for s, i, other in scored
                    if other != lab and 30 * ps <= -100 * s <= 90 * ps][:negatives]
            out += [(a, p, k + 1, i, int(ps), int(s)) for k, (i, s) in enumerate(near)]
    return sorted(out)


def mine(spark, rows, every):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], SCHEMA)
    return sorted(tuple(r) for r in N.hard_negatives(df, F.col("row_id") % every == 0).collect())


@pytest.mark.parametrize("spread", [3, 60])
def test_all_scores(spark, spread):
    lot = np.random.default_rng(spread)
    rows = [(int(i), int(lot.integers(4)), [float(x) for x in lot.integers(-spread, spread + 1, 40)])
            for i in range(400)]
    rows += [(400 + k, k % 4, rows[0][2]) for k in range(60)]  # a common vector: ties
    assert mine(spark, rows, 20) == plain(rows, lambda i: i % 20 == 0)


def test_odd_rows(spark):
    rows = [(0, 1, [2.0, 2.0]), (1, 1, [3.0]), (2, 2, [1.0, 0.0]), (3, 2, [float("nan"), 1.0]),
            (4, None, [1.0, 1.0]), (None, 1, [1.0, 1.0]), (5, 2, None), (6, 2, [None, 1.0]),
            (7, 2, [1.0, 1.0]), (7, 2, [1.0, 1.0]), (8, 3, []), (9, 2, [float("inf"), 0.0])]
    got = mine(spark, rows, 100)
    assert got == [(0, 1, 1, 7, 6, 4), (0, 1, 2, 7, 6, 4), (0, 1, 3, 2, 6, 2)]
    assert mine(spark, [], 100) == [] and mine(spark, rows[2:3], 100) == []


def test_index_finds_every_pair_and_omits_dimensions():
    lot = np.random.default_rng(1)
    rows = lot.integers(-50, 50, (500, 64)) * np.linspace(2, 0, 64).round(1)
    anchors = rows[:20]
    rest = N._rest_norms(anchors)
    scores = anchors @ rows.T
    for share in (0.9, 0.5, 0.1):
        least = share * scores.max(axis=1)
        index = N.Index(rows, (rest / least[:, None]).max(axis=0))
        got = {(a, y) for part in index.search(anchors, rest, least) for a, y in zip(part[0], part[1])}
        assert got == set(zip(*np.nonzero(scores >= least[:, None])))
        assert share < 0.5 or index.upto.mean() < len(index.lists)
