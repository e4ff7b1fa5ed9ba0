"""Benchmark matches, mixing and the trained models: edges, hand checks, held-out accuracy."""

import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seclake.llm import attention, contamination, licences, mixing, toxicity

LABELS = "doc_id long, quality int, toxic int"
WORDS = [a + b for a in "bdfgklmnprst" for b in ("a", "en", "ir", "osh", "ut")]


def prose(rng, words=60):
    return " ".join(rng.choice(WORDS) + rng.choice(WORDS) for _ in range(words))


# ---- benchmark -------------------------------------------------------------------------

def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


def best_inside(item, text):
    """Least edits between the item and any part of the text."""
    row = [0] * (len(text) + 1)
    for i, x in enumerate(item, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(text, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return min(row)


def damaged(rng, text, edits):
    chars = list(text)
    for _ in range(edits):
        i = rng.randrange(len(chars))
        chars[i:i + 1] = rng.choice([[], [chars[i], "Q"], ["é"]])
    return "".join(chars)


def test_matches_against_all_alignments(spark, docs_of):
    rng = random.Random(1)
    rule = contamination.MatchRule()
    items = [(i, prose(rng, n)) for i, n in enumerate((6, 8, 12, 20, 30))]
    items += [(50, items[2][1]), (51, "short"), (52, None), (None, prose(rng))]
    rows = []
    for k in range(60):
        text = prose(rng, rng.randrange(5, 40))
        if k % 3:
            item = items[k % 5][1]
            hit = damaged(rng, item, rng.randrange(0, 2 + len(item) // 9))
            text += " é " + hit.upper().replace(" ", " \n ") + " " + prose(rng, 5)
        rows.append((k, text))
    rows += [(100, None), (101, ""), (102, items[0][1]), (102, items[0][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = contamination.benchmark_matches(docs_of(rows), bench, rule).collect()
    found = {(r.doc_id, r.item_id): r for r in got}
    texts = dict(rows)
    for k, text in rows:
        flat = "".join(map(chr, contamination.normal(text or "")))
        for i, item in items:
            if i is None or item is None or len(item) < 32:
                assert (k, i) not in found
                continue
            least = best_inside(item, flat)
            assert ((k, i) in found) == (least <= rule.budget(len(item))), (k, i, least)
    for r in got:
        part = "".join(map(chr, contamination.normal(texts[r.doc_id][r.start:r.end])))
        assert distance(dict(items)[r.item_id], part) == r.edits == best_inside(
            dict(items)[r.item_id], "".join(map(chr, contamination.normal(texts[r.doc_id]))))
    assert sum(r.doc_id == 102 and r.item_id == 0 for r in got) == 2
    clean = {r.doc_id for r in contamination.without_matches(docs_of(rows), bench).collect()}
    assert clean == {k for k, _ in rows} - {k for k, _ in found}


def test_benchmark_in_chunks_and_of_nothing(spark, docs_of, monkeypatch):
    monkeypatch.setattr(contamination, "CHUNK_CHARS", 100)
    rng = random.Random(3)
    items = [(i, prose(rng, 12)) for i in range(5)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = docs_of([(i, "x " + t + " y") for i, t in items])
    assert sorted((r.doc_id, r.item_id) for r in contamination.benchmark_matches(
        docs, bench).collect()) == [(i, i) for i in range(5)]
    assert contamination.without_matches(docs, bench).count() == 0
    assert contamination.benchmark_matches(docs, bench.limit(0)).count() == 0
    assert contamination.benchmark_matches(docs.limit(0), bench).count() == 0


def test_short_items_and_items_without_id(spark, docs_of):
    rng = random.Random(9)
    long = prose(rng, 12)
    items = [(1, "Ab c"), (2, "x"), (3, "two  words here and there"), (4, "  \n"), (5, "é!"),
             (None, long), (None, None), (7, "Ab c")]
    texts = {1: "say ab \n C now", 2: "tab c", 3: "ab cd", 4: "x", 5: "axb x_ xé", 6: "a(x)",
             7: "Two words here AND there.", 8: "Two words here AND thereby.", 9: "é!é!", 10: None,
             11: "", 12: "so " + long.upper() + " on", 13: "ab", 14: "c"}
    docs = docs_of(list(texts.items()))
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id, r.start, r.end, r.edits)
                  for r in contamination.benchmark_matches(docs, bench).collect()), key=str)
    assert got == sorted([
        (1, 1, 4, 10, 0), (1, 7, 4, 10, 0), (4, 2, 0, 1, 0), (6, 2, 2, 3, 0), (7, 3, 0, 24, 0),
        (9, 5, 0, 2, 0), (9, 5, 2, 4, 0), (12, None, 3, 3 + len(long), 0)], key=str)
    clean = {r.doc_id for r in contamination.without_matches(docs, bench.drop("item_id")).collect()}
    assert clean == set(texts) - {1, 4, 6, 7, 9, 12}


def test_costs_side_by_side_are_those_of_all_alignments(monkeypatch):
    rng = random.Random(11)
    rule = contamination.MatchRule(q=4, edits=0.2, least_chars=8)
    items = [(i, contamination.normal("".join(rng.choice("ab ") for _ in range(rng.randrange(8, 40)))
                                      .strip() + "abababab")) for i in range(30)]
    monkeypatch.setattr(contamination, "_CELLS", 4000)
    index = contamination.ItemIndex(items, rule)
    text = "".join(rng.choice("ab ") for _ in range(400))
    points = contamination.normal(text)
    jobs = [(0, i, lo, hi, x, y) for x, y in ((0, 150), (150, len(contamination.normal(text))))
            for i, lo, hi in index.candidates(points[x:y])]
    assert len(jobs) > 20
    good = index.near_enough(points, jobs)
    for job, near in zip(jobs, good):
        assert near == bool(index.align(job[1], points[job[4]:job[5]], job[2], job[3])), job


def test_common_runs_of_many_items_and_of_one_letter(spark, docs_of, monkeypatch):
    rng = random.Random(13)
    shared = prose(rng, 9)[:60]
    items = [(i, f"{prose(rng, 3)} {shared} {prose(rng, 3)}") for i in range(3000)]
    items.append((9000, "e" * 500))
    docs = docs_of([(1, f" {prose(rng, 2)} ".join([shared] * 10)), (2, "e" * 3000),
                    (3, "so " + items[17][1] + " on")])
    bench = spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(contamination, "_PLACES", 1000)
    got = contamination.benchmark_matches(docs, bench).collect()
    assert sorted({(r.doc_id, r.item_id) for r in got}) == [(2, 9000), (3, 17)]


# ---- mixing ----------------------------------------------------------------------------

def test_mix_edges(docs_of):
    rng = random.Random(5)
    rows = [(i, "w " * rng.randrange(1, 300), rng.choice(["a", "b", "c", "hot", "hot", "hot"]))
            for i in range(300)]
    rows += [(900 + i, "n " * 40, None) for i in range(20)] + [(None, "x y", "")] * 3
    rows += [(950, None, "void"), (951, "", "void"), (1, rows[1][1], rows[1][2])]
    got = mixing.mix_report(docs_of(rows)).collect()
    assert len(got) == len(rows)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_report(docs_of(rows[::-1])).collect()))
    words = sum(r.size for r in got)
    by = defaultdict(list)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        by[r.source].append(r)
    assert set(by) == {"a", "b", "c", "hot", None, "", "void"}
    assert abs(sum(rs[0].target for rs in by.values()) - 1.5 * words) < 1e-6
    for source, rs in by.items():
        assert rs[0].source_size == sum(r.size for r in rs)
        assert rs[0].target <= 2 * rs[0].source_size
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= max(3, 0.01 * rs[0].target), source
    mixed = mixing.mixed_documents(docs_of(rows))
    assert mixed.agg(F.sum(F.col("copies") * F.col("n_words"))).first()[0] == sum(
        r.taken for r in got)
    assert mixing.mix_report(docs_of([])).count() == 0
    clash = docs_of(rows).withColumn("copies", F.lit("x")).withColumn("n_words", F.lit("y"))
    again = mixing.mixed_documents(clash)
    assert len(again.columns) == len(set(again.columns))
    assert again.agg(F.sum(F.col("copies") * F.col("n_words"))).first()[0] == sum(r.taken for r in got)


# ---- trained models --------------------------------------------------------------------

def labelled(docs_of, spark, seed):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(600):
        text = "\n".join(prose(rng, 15) for _ in range(rng.randrange(1, 6)))
        toxic, good = i % 6 == 0, i % 5 != 0
        if toxic:
            text += " you are a stupid, worthless IDIOT"
        if not good:
            text += "\n" + "buy### now$$$ " * rng.randrange(20, 60)
        rows.append((i, text))
        labels.append((i, int(good), int(toxic)))
    labels += [(None, 1, 1), (5, None, None), (9999, 1, 0)]
    return docs_of(rows + [(None, None), (700, ""), (0, rows[0][1])]), spark.createDataFrame(
        labels, LABELS)


@pytest.mark.parametrize("column", ["toxic", "quality"])
def test_models_learn(spark, docs_of, column):
    docs, labels = labelled(docs_of, spark, 7)
    rest = toxicity.remainder(F.col("doc_id"), 3)
    scored = toxicity.toxicity(docs, labels, rest != 1) if column == "toxic" else \
        attention.quality_scores(docs, labels, rest != 1)
    rows = scored.withColumn("held", rest == 1).collect()
    assert len(rows) == 603 and all(0 <= r.score <= 1 for r in rows)
    truth = {r.doc_id: r[column] for r in labels.filter(f"{column} IS NOT NULL").collect()}
    held = [((r.score >= 0.5) == bool(truth[r.doc_id])) for r in rows
            if r.held and r.doc_id in truth]
    assert len(held) > 150 and np.mean(held) > 0.97


def test_lexicon_is_learnt_in_every_language(spark, docs_of):
    """Toxic words that no list of the module has, in two made-up languages, also disguised."""
    rng = random.Random(11)
    bad = [["grumplix", "snorvast", "blattering"], ["\u00e9crab\u00f4l", "zufflekopf", "trottelant"]]
    rows, labels = [], []
    for i in range(900):
        words = prose(rng, rng.randrange(15, 60)).split()
        toxic = i % 6 == 0
        if toxic:
            for _ in range(3):
                word = rng.choice(bad[i % 12 // 6])
                word = word.replace("o", "0") if rng.random() < 0.2 else word + rng.choice(["", "s", "!"])
                words.insert(rng.randrange(len(words)), word)
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(toxic)))
    rest = toxicity.remainder(F.col("doc_id"), 3)
    scored = {r.doc_id: r.score for r in toxicity.toxicity(
        docs_of(rows), spark.createDataFrame(labels, LABELS), rest != 1).withColumn(
        "held", rest == 1).filter("held").collect()}
    for language in (0, 1):
        caught = [scored[i] >= 0.7 for i in scored if i % 6 == 0 and i % 12 // 6 == language]
        assert len(caught) > 15 and np.mean(caught) > 0.9
    assert np.mean([scored[i] >= 0.7 for i in scored if i % 6]) < 0.02


def test_models_without_two_classes(spark, docs_of):
    docs = docs_of([(1, "a b"), (2, None)])
    for rows, want in (([], 0.0), ([(1, 1, 1)], 1.0), ([(1, 0, 0)], 0.0)):
        labels = spark.createDataFrame(rows, LABELS)
        assert {r.score for r in toxicity.toxicity(docs, labels).collect()} == {want}
        assert {r.score for r in attention.quality_scores(docs, labels).collect()} == {want}
    labels = spark.createDataFrame([(1, 1, 1)], LABELS)
    assert toxicity.without_toxic(docs, labels, 0.7).count() == 0
    assert attention.quality_scores(docs.limit(0), labels).count() == 0


def test_attention_gradient():
    rng = np.random.default_rng(1)
    x, count = rng.normal(size=(9, 4)), np.array([3, 0, 4, 2])
    label = np.array([1.0, 0.0, 0.0, 1.0])
    model = attention.AttentionModel.fresh(np.zeros(4), np.ones(4), 5, 3)

    def loss():
        p = model.forward(x, count)["score"]
        return -np.mean(label * np.log(p) + (1 - label) * np.log(1 - p))

    for name, gradient in model.gradient(x, count, label).items():
        part = model.parts[name]
        for at in list(np.ndindex(part.shape))[:7]:
            kept = part[at]
            part[at] = kept + 1e-5
            up = loss()
            part[at] = kept - 1e-5
            down = loss()
            part[at] = kept
            assert abs((up - down) / 2e-5 - gradient[at]) < 1e-7


def test_scores_read_only_the_text(spark, docs_of):
    docs, labels = labelled(docs_of, spark, 8)
    model = attention.train(docs, labels, F.lit(True))
    other = docs.select((F.col("doc_id") + 1).alias("doc_id"), "text", F.lit("zz").alias("lang"))
    a, b = (attention._mapped(d, "text", "doc_id", "double", lambda c, x: pa.array(
        model.scores(x, c))) for d in (docs, other))
    assert a.select("value").exceptAll(b.select("value")).count() == 0


# ---- licences --------------------------------------------------------------------------

def test_licences(spark, docs_of):
    rng = random.Random(9)
    rows = [(i, "\n".join(prose(rng, 20) for _ in range(4))) for i in range(200)]
    planted = {
        300: ("mit", "Released under the MIT License."),
        301: ("apache", prose(rng, 20) + " Licensed under the Apache License, Version 2.0. "
              + prose(rng, 100)),
        302: ("gpl", "This work is licensed under the GNU General Public License, version 3."),
        303: ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
        304: ("bsd", "redistribution and use in source and binary forms, with or without "
              "modification, are permitted provided that these conditions are met"),
    }
    rows += [(k, prose(rng, 10) + "\n" + t) for k, (_, t) in planted.items()]
    rows += [(400, "the driver lost his license and paid a fine"), (401, None), (402, ""),
             (303, planted[303][1])]
    got = licences.licence_scan(docs_of(rows)).collect()
    told = {(r.doc_id, r.family) for r in got if r.confirmed}
    assert told == {(k, f) for k, (f, _) in planted.items()}
    assert any(r.doc_id == 400 and not r.confirmed for r in got)
    assert sum(r.doc_id == 303 and r.confirmed for r in got) == 2
    assert licences.licence_scan(docs_of([])).count() == 0


def test_threshold_by_trying_all():
    rng = random.Random(3)
    for _ in range(200):
        told = [(rng.choice([0.4, 0.5, 0.6, 0.75, 0.8, 0.9, 0.99]), rng.random() < 0.1)
                for _ in range(rng.randrange(0, 60))]
        fine = [p for p in {q for q, _ in told}
                if sum(w for q, w in told if q >= p) <= 0.05 * sum(q >= p for q, _ in told)]
        got = licences._threshold(told, 0.05)
        if fine:
            assert got == min(fine)
        elif told:
            assert got > max(q for q, _ in told)
        else:
            assert got == 0.5


def pieces_by_hand(text):
    """line and words of each piece of each paragraph."""
    got, paragraph = [], []
    for line, row in enumerate([*text.split("\n"), ""]):
        if row.strip():
            paragraph += [(line, w) for w in re.findall(r"[^\W_]+", row.lower())]
            continue
        at = 0
        while paragraph and (at == 0 or at + licences.PIECE_WORDS - licences.STEP_WORDS < len(paragraph)):
            piece = paragraph[at:at + licences.PIECE_WORDS]
            got.append((piece[0][0], [w for _, w in piece]))
            at += licences.STEP_WORDS
        paragraph = []
    return got


def test_pieces_and_likeness_by_hand(spark, docs_of):
    """Pieces, most alike template and similarity are those of plain Python."""
    rng = random.Random(8)
    known = [(r.family, r.text) for r in licences.templates(spark).collect()]
    texts = []
    for i in range(40):
        family, text = rng.choice(known)
        texts.append("\n".join(rng.choice([
            prose(rng, rng.randrange(1, 130)), "", text, f"{prose(rng, 9)} {text}"])
            for _ in range(rng.randrange(1, 7))))
    model = licences.train(docs_of([(i, prose(rng, 80)) for i in range(300)]))
    got = licences.licence_scan(docs_of(list(enumerate(texts))), model=model).collect()
    pieces = {(i, line): words for i, text in enumerate(texts)
              for line, words in pieces_by_hand(text)}
    assert {(r.doc_id, r.line) for r in got} == set(pieces)
    assert len(got) == sum(len(pieces_by_hand(text)) for text in texts)

    def runs(words):
        return {" ".join(words[i:i + 3]) for i in range(len(words) - 2)} or {" ".join(words)}

    listed = [(f, runs(licences._words(t))) for f, t in known]
    told = [r for r in got if r.family != licences.UNKNOWN]
    assert len(told) > 20
    for r in told:
        best = set()
        for line, words in pieces_by_hand(texts[r.doc_id]):
            own = runs(words)
            if line == r.line:
                best.add(max(max(len(own & g) / len(g), len(own & g) / len(own))
                             for f, g in listed if f == r.family))
        assert any(abs(r.similarity - b) < 1e-9 for b in best)
        assert r.confirmed == (r.similarity >= licences.CONFIRM_FROM)


def test_every_template_is_judged_and_found(spark, docs_of):
    """Alone and amid other words; lines with a licence word that are no notice stay unknown."""
    rng = random.Random(4)
    known = [(r.family, r.text) for r in licences.templates(spark).collect()]
    model = licences.train(docs_of(
        [(i, "\n".join(prose(rng, 20) for _ in range(4))) for i in range(300)]))
    rows = [(i, text) for i, (_, text) in enumerate(known)]
    amid = [(1000 + i, f"{prose(rng, 15)} {text} {prose(rng, 15)}")
            for i, (_, text) in enumerate(known)]
    got = licences.licence_scan(docs_of(rows + amid), model=model).collect()
    assert {r.doc_id for r in got} == {k for k, _ in rows + amid}
    told = {(r.doc_id % 1000, r.doc_id >= 1000, r.family) for r in got if r.confirmed}
    lacking, amid_lacking = ([t for i, (f, t) in enumerate(known) if f != licences.UNKNOWN and (
        i, around, f) not in told] for around in (False, True))
    assert lacking == []
    # Of a name of one word after "License:", between 30 other words, too little may remain.
    assert all(t.startswith("License: ") for t in amid_lacking) and len(amid_lacking) <= 12
    others = {i for i, (f, _) in enumerate(known) if f == licences.UNKNOWN}
    assert not any(i in others for i, _, _ in told)


def test_wrapped_notices(spark, docs_of):
    """A notice over two lines is one paragraph's; line tells where a piece starts."""
    rng = random.Random(5)
    rows = [
        (1, "Licensed under the\nApache 2.0 license."),
        (2, "# a title\n\n# Distributed under the terms of the\r\n# BSD-3-Clause.\r\n\r\nother words"),
        (3, "\n \n" + "\n".join(prose(rng, 12) for _ in range(6)) + "\n\n\nmore\nand more"),
        (4, "\n\n"), (5, "12:5 x\n\n\n7")]
    model = licences.train(docs_of([(i, prose(rng, 80)) for i in range(300)]))
    got = licences.licence_scan(docs_of(rows), model=model).collect()
    assert {(r.doc_id, r.line, r.family) for r in got if r.confirmed} == {
        (1, 0, "apache"), (2, 2, "bsd")}
    assert sorted((r.doc_id, r.line) for r in got) == [
        (1, 0), (2, 0), (2, 2), (2, 5), (3, 2), (3, 5), (3, 10), (5, 0), (5, 3)]


def test_only_known_runs_reach_the_counter(spark, monkeypatch):
    """Runs of words outside the vocabulary are left out before the counter makes objects of them."""
    known = set(licences.vocabulary())

    class Counter:
        from_vocabulary = staticmethod(lambda *_, **__: Counter())
        setBinary = lambda self, _: self
        transform = lambda self, rows: rows.withColumn("_x", F.col("_grams"))

    monkeypatch.setattr(licences, "CountVectorizerModel", Counter)
    cases = [[], ["mit"], ["the", "mit"], ["qq", "the", "mit", "license", "qq", "license"]]
    rows = spark.createDataFrame(list(enumerate(cases)), "i long, words array<string>")
    got = {r.i: r for r in licences._featured(rows).collect()}
    for i, w in enumerate(cases):
        runs = [" ".join(w[k:k + n]) for n in (1, 2, 3) for k in range(len(w) - n + 1)]
        assert got[i].words == w and got[i]._x == [run for run in runs if run in known]
