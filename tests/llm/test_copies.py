"""Near copies, repeated passages and repeated lines against plain Python."""

import random
import re
from collections import Counter

import pytest

from seclake.llm import near_copies as near_copies_module
from seclake.llm.components import components
from seclake.llm.lines import (
    CHARS_AN_EDIT, LEAST_WORDS, with_kept_lines, within_one, without_repeated_lines,
)
from seclake.llm.near_copies import least_shared, near_copies, one_of_each
from seclake.llm.passages import without_repeats

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        i = rng.randrange(len(words))
        words[i:i + 1] = rng.choice([[], [rng.choice("xyz") + str(rng.random())],
                                     [words[i], str(rng.random())]])
    return words


def corpus(seed, many=40, copies=60):
    rng = random.Random(seed)
    rows = [(i, None if i == 3 else "" if i == 4 else " \n" if i == 5 else "one two" if i < 9
             else " ".join(str(rng.randrange(400)) for _ in range(rng.randrange(1, 160))))
            for i in range(many)]
    base = [r for r in rows if r[1] and len(r[1]) > 100]
    for k in range(copies):
        words = rng.choice(base)[1].split()
        rows.append((many + k, " ".join(edited(rng, words, rng.randrange(6)))))
    big = [str(rng.random()) for _ in range(120)]
    rows += [(1000 + k, " ".join(edited(rng, big, 1 + k % 3))) for k in range(40)]
    rows += [(2000 + k, " ".join(big).upper()) for k in range(10)]
    return rows


def components_by_hand(rows, percent):
    sets = []
    for _, text in rows:
        words = WORD.findall((text or "").lower())
        sets.append({tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words
                    else set())
    root = {r[0]: r[0] for r in rows if r[0] is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                x, y = find(rows[i][0]), find(rows[j][0])
                root[max(x, y)] = min(x, y)
    return Counter((r[0], len(s), find(r[0]), r[0] == find(r[0])) for r, s in zip(rows, sets))


@pytest.mark.parametrize("percent", [80, 85])
def test_near_copies(docs_of, percent):
    rows = corpus(percent)
    got = near_copies(docs_of(rows), percent).select(
        "doc_id", "n_shingles", "component_id", "kept").collect()
    assert Counter(tuple(r) for r in got) == components_by_hand(rows, percent)


def test_near_copies_of_odd_rows(docs_of):
    text = " ".join(str(i) for i in range(40))
    rows = [(None, text), (None, None), (7, text), (7, text), (7, "other"), (9, "other"), (9, "")]
    got = sorted(map(str, near_copies(docs_of(rows), 80).drop("t", "n_shingles").collect()))
    want = [(None, 7, False), (None, None, True), (7, 7, True), (7, 7, True), (7, 7, True),
            (9, 7, False), (9, 9, True)]
    assert got == sorted(f"Row(doc_id={a}, component_id={b}, kept={c})" for a, b, c in want)
    assert near_copies(docs_of([])).count() == 0
    left = Counter((r.doc_id, r.text) for r in one_of_each(docs_of(rows)).collect())
    assert left == Counter([(None, None), (7, text), (7, "other"), (9, "")])


def test_texts_without_id_take_part(spark, docs_of):
    """They tie others, and of a group without any id the rows of one text stay."""
    words = [f"w{i}" for i in range(200)]

    def changed(at):
        return " ".join(f"other{i}" if i in at else w for i, w in enumerate(words))

    bridge = changed({50})
    rows = [(5, changed({50, 100, 120})), (None, bridge), (9, changed({50, 20, 70})), (None, bridge)]
    # Only the text without id is within the bound of both.
    assert {r.component_id for r in near_copies(docs_of([rows[0], rows[2]]), 90).collect()} == {5, 9}
    got = Counter((r.doc_id, r.component_id, r.kept) for r in near_copies(docs_of(rows), 90).collect())
    assert got == Counter([(5, 5, True), (None, 5, False), (9, 5, False), (None, 5, False)])

    other = [" ".join(f"v{i}x{j}" for i in range(30)) for j in range(3)]
    lone = [(None, bridge), (None, changed({50, 100})), (None, bridge.upper()), (None, other[0]),
            (None, other[1]), (None, other[1]), (None, " "), (None, None), (3, other[2])]
    got = near_copies(docs_of(lone), 85).collect()
    assert all(r.component_id == r.doc_id for r in got)
    kept = Counter(r.n_shingles for r in got if r.kept)
    assert kept == Counter({196: 1, 26: 4, 0: 2})
    left = Counter(r.text for r in one_of_each(docs_of(lone), 85).collect())
    assert sum(left[x] for x in (bridge, changed({50, 100}), bridge.upper())) == 1
    assert [left[x] for x in other] == [1, 1, 1]


def test_copies_with_edits_of_their_own_are_not_compared_with_all(docs_of, monkeypatch):
    """Those too far from the group's first pivot are not paired with each copy that is linked to it."""
    rng = random.Random(4)
    base = [f"w{i}" for i in range(300)]

    def changed(drop):
        words = list(base)
        for at in rng.sample(range(10, 290), 2):
            words[at] = str(rng.random())
        at = rng.randrange(20, 240)
        return " ".join(words[:at] + words[at + drop:])

    rows = [(0, " ".join(base))] + [(i, changed(0)) for i in range(1, 61)]
    rows += [(100 + i, changed(30)) for i in range(8)]
    written, stored = [], near_copies_module.stored

    def noted(df, name):
        out = stored(df, name)
        written.append((name, out.count()))
        return out

    monkeypatch.setattr(near_copies_module, "stored", noted)
    got = Counter(tuple(r) for r in near_copies(docs_of(rows), 85).select(
        "doc_id", "n_shingles", "component_id", "kept").collect())
    assert got == components_by_hand(rows, 85)
    assert max(Counter(c for _, _, c, _ in got).values()) >= 61
    assert sum(n for name, n in written if name == "pairs") < 150  # 607 without the counts


def test_least_shared_rises():
    assert least_shared(100) == 48 and 15 < least_shared(80) < least_shared(90) < 48


def test_components_of_chains_and_hubs(spark):
    rng = random.Random(2)
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 50)]
    links += [(5, 5), (70, 69), (69, 70)]
    rng.shuffle(links)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long"))
           .collect()}
    want = {i: 0 for i in range(61)} | {100 + i: 100 for i in range(50)} | {69: 69, 70: 69}
    assert got == want
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def removed_by_hand(rows, window):
    lists = [WORD.findall(t or "") for _, t in rows]
    count = Counter(tuple(ws[i:i + window]) for ws in lists
                    for i in range(len(ws) - window + 1))
    out = Counter()
    for (doc_id, _), ws in zip(rows, lists):
        gone = {k for i in range(len(ws) - window + 1) if count[tuple(ws[i:i + window])] > 1
                for k in range(i, i + window)}
        out[doc_id, len(ws), len(gone), " ".join(w for i, w in enumerate(ws) if i not in gone)] += 1
    return out


@pytest.mark.parametrize("members", [512, 4])
def test_repeated_passages(docs_of, monkeypatch, members):
    monkeypatch.setattr("seclake.llm.passages.GROUP_MEMBERS", members)
    monkeypatch.setattr("seclake.llm.passages.TREE_WORDS", 900)
    rows = corpus(7, 30, 30)
    rng = random.Random(9)
    passage = [str(rng.random()) for _ in range(60)]
    for k in range(25):
        around = [str(rng.random()) for _ in range(30)]
        cut = rng.randrange(26)
        rows.append((3000 + k, " \t".join(around[:15] + passage[cut:cut + 35 + k % 3] + around[15:])))
    rows += [(4000, "z " * 34), (4001, "y " * 36), (4002, "a b " * 50), (None, rows[-1][1]),
             (4003, "w " * 35), (4004, "v " * 35 + "\n" + "v " * 35), (3001, rows[-1][1])]
    got = without_repeats(docs_of(rows)).collect()
    assert Counter(tuple(r) for r in got) == removed_by_hand(rows, 35)


def test_passages_of_nothing_and_of_repeated_rows(docs_of):
    assert without_repeats(docs_of([])).count() == 0
    text = " ".join(str(i) for i in range(40))
    rows = [(1, text), (1, text), (2, text + " end"), (3, "short"), (3, "short")]
    got = without_repeats(docs_of(rows)).collect()
    assert Counter(tuple(r) for r in got) == removed_by_hand(rows, 35)


def alike(a, b):
    """Whether two lines of words are equal or within the bound for their length."""
    if min(len(a), len(b)) >= LEAST_WORDS:
        return within_one(a, b)
    x, y = " ".join(a), " ".join(b)
    return a == b or max(len(a), len(b)) < LEAST_WORDS and min(
        len(x), len(y)) >= CHARS_AN_EDIT and within_one(list(x), list(y))


def kept_by_hand(rows):
    """Rows in order; every line against all lines before it."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    before, out = [], []
    for i in order:
        lines = (rows[i][1] or "").split("\n")
        left, worded, gone = [], 0, 0
        for line in lines:
            words = WORD.findall(line)
            stays = not words or not any(alike(w, words) for w in before)
            worded += bool(words)
            gone += not stays
            if stays:
                left.append(line)
            if words:
                before.append(words)
        out.append((rows[i][0], worded, gone, "" if worded and worded == gone
                    else "\n".join(left)))
    return Counter(out)


def line_corpus():
    rng = random.Random(4)
    lines = [[rng.choice("abcdefgh") * rng.randrange(1, 3) for _ in range(rng.randrange(1, 30))]
             for _ in range(60)]
    lines += [edited(rng, rng.choice(lines), rng.randrange(3)) for _ in range(120)]
    lines += [[str(i) for i in range(n)] for n in (7, 8, 9, 14, 15, 16, 17, 18)]
    lines += [["w"] * n for n in (6, 7, 8, 9, 15, 16, 17)]
    rng.shuffle(lines)
    return [(i, "\n".join(" ".join(w) for w in lines[i * 5:i * 5 + 5])) for i in range(40)]


def test_repeated_lines(docs_of):
    rows = line_corpus() + [(900, None), (901, ""), (902, "\n \n"), (None, "null id line\n\nab")]
    got = without_repeated_lines(docs_of(rows)).select(
        "row.doc_id", "n_lines", "n_removed", "kept").collect()
    assert Counter(tuple(r) for r in got) == kept_by_hand(rows)


def test_lines_of_few_words(docs_of):
    """Characters put in, left out and replaced, at both ends too; lines at the bounds."""
    rng = random.Random(6)
    base = ["Share this page with friends", "Privacy policy and terms", "a" * 20, "a" * 19, "é" * 20,
            "aabb" * 5, "one two three four five six seven", "\U0001f600 smile at the camera now"]
    lines = list(base)
    for _ in range(150):
        chars = list(rng.choice(base))
        for _ in range(rng.choice((1, 1, 2))):
            i = rng.choice((0, len(chars) - 1, rng.randrange(len(chars))))
            chars[i:i + 1] = rng.choice([[], [chars[i], rng.choice("ab é")], [rng.choice("xé ")]])
        lines.append("".join(chars).replace(" ", rng.choice((" ", "  ", "\t"))))
    rng.shuffle(lines)
    rows = [(i, "\n".join(lines[i * 4:i * 4 + 4])) for i in range(40)]
    got = without_repeated_lines(docs_of(rows)).select(
        "row.doc_id", "n_lines", "n_removed", "kept").collect()
    assert Counter(tuple(r) for r in got) == kept_by_hand(rows)


def test_lines_of_repeated_rows(docs_of):
    rows = [(1, "a b\nc"), (1, "a b\nc"), (2, "c\n\nnew"), (None, "c"), (None, "c")]
    got = without_repeated_lines(docs_of(rows)).select("row.doc_id", "n_removed", "kept").collect()
    assert Counter(tuple(r) for r in got) == Counter(
        [(1, 0, "a b\nc"), (1, 2, ""), (2, 1, "\nnew"), (None, 1, ""), (None, 1, "")])
    left = with_kept_lines(docs_of(rows)).collect()
    assert sorted((r.doc_id, r.text, r.n_chars) for r in left) == [(1, "a b\nc", 5), (2, "\nnew", 4)]
    assert with_kept_lines(docs_of([])).count() == 0


def test_within_one():
    assert within_one("a b c".split(), "a x c".split())
    assert within_one("a b c".split(), "a c".split())
    assert not within_one("a b c".split(), "b c d".split())


def test_clashing_columns(docs_of):
    from pyspark.sql import functions as F
    rows = [(1, "some line here\nnext"), (2, "other text of it")]
    extra = docs_of(rows).withColumns({c: F.lit(1) for c in (
        "k", "t", "row", "packed", "stay", "kept", "n", "cid", "n_lines", "least", "features")})
    for stage in (with_kept_lines, one_of_each):
        assert stage(extra).columns == extra.columns
        assert stage(extra).count() == 2


def test_classes_whose_sets_are_read_are_written_first(docs_of, monkeypatch):
    """They are read four times for each search; a join behind them would run as often."""
    plans = []

    def seen(docs, wanted, sets=near_copies_module._full_sets):
        plans.append(wanted._jdf.queryExecution().toString())
        return sets(docs, wanted)

    monkeypatch.setattr(near_copies_module, "_full_sets", seen)
    words = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join([*words[:55], f"x{i}", *words[56:]])) for i in range(3)]
    assert {r.component_id for r in near_copies(docs_of(rows), 70).collect()} == {0}
    assert plans and not any("Join" in plan for plan in plans)
