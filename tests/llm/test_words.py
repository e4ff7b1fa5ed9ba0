"""Blocks, suffix arrays and quality rules against plain Python."""

import random
import re

import numpy as np
import pyarrow as pa

from seclake.llm.blocks import blocks, ngram_hashes
from seclake.llm.repetition import RepetitionLimits, longest_shared, quality_rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def texts(seed, many=60):
    rng = random.Random(seed)
    out = [None, "", " ", "a", "\n\n", "ä ö\tü", "a\x0bb\x0cc", "x" * 5000]
    for _ in range(many):
        out.append("".join(rng.choice(["a", "b ", "é", " ", "\n", "#", "ab "])
                           for _ in range(rng.randrange(200))))
    return out


def test_words_are_those_of_the_pattern():
    values = texts(1)
    got = {}
    for limit in (1, 100, 1 << 20):
        for block in blocks(pa.array(values), limit=limit):
            for i in range(block.texts):
                got[block.lo + i] = [block.word_bytes(w).decode() for w in
                                     range(block.first_word[i], block.first_word[i + 1])]
        assert got == {i: WORD.findall(t or "") for i, t in enumerate(values)}


def test_equal_words_have_equal_values():
    block = next(blocks(pa.array(["one two one", "two three", "One"]), lower=True))
    h = block.word_hashes()
    assert h[0] == h[2] == h[5] and h[1] == h[3] and len(set(h.tolist())) == 3
    assert len(ngram_hashes(h, 7)) == 0


def longest_by_hand(words, i):
    best = 0
    for j in range(len(words)):
        n = 0
        while j != i and max(i, j) + n < len(words) and words[i + n] == words[j + n]:
            n += 1
        best = max(best, n)
    return best


def test_longest_shared():
    rng = random.Random(3)
    lists = [[rng.choice("abc") for _ in range(rng.randrange(40))] for _ in range(30)]
    lists += [["z"] * 33, ["q"]]
    names = np.array([ord(w) for ws in lists for w in ws], np.uint64)
    doc = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    want = [longest_by_hand(ws, i) for ws in lists for i in range(len(ws))]
    assert longest_shared(names, doc).tolist() == want


def rules_by_hand(text, limits):
    text = text or ""
    words = WORD.findall(text)
    shared = [longest_by_hand(words, i) for i in range(len(words))]

    def covered(least, whole):
        return len({k for i, n in enumerate(shared) if n >= least
                    for k in range(i, i + (n if whole else least))})

    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    n, three = len(words), covered(3, False)
    failed = n < 50 or 100 * three > 50 * n
    fine = (100 * covered(limits.least, True) <= limits.covered_percent * n
            and max(shared, default=0) <= limits.longest)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, three,
            failed, fine and not failed)


def test_quality_rules(docs_of):
    rng = random.Random(5)
    values = texts(2, 25)
    passage = " ".join(str(rng.random()) for _ in range(20))
    for copies in (1, 2, 5):
        values.append(" ".join([passage] * copies + [str(rng.random()) for _ in range(150)]))
    values.append(" ".join(str(i) for i in range(49)))
    values.append(" ".join(str(i) for i in range(50)))
    limits = RepetitionLimits()
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words,
                      r.base_failed, r.kept)
           for r in quality_rules(docs_of(list(enumerate(values))), limits=limits).collect()}
    assert got == {i: rules_by_hand(t, limits) for i, t in enumerate(values)}


def test_quality_rules_of_nothing_and_repeated_rows(docs_of):
    assert quality_rules(docs_of([])).count() == 0
    rows = quality_rules(docs_of([(1, "a b"), (1, "a b"), (None, None)])).collect()
    assert sorted((r.n_words, r.kept) for r in rows) == [(0, False), (2, False), (2, False)]
