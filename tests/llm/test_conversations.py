"""Conversation repair against all edits in plain Python, spilled walks, odd rows."""

import hashlib
import itertools
import random

import pytest

from seclake.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string, copies int"
SPACE = " \t\n\x0b\x0c\r"


def legal(initials):
    rest = initials[1:] if initials[:1] == "s" else initials
    return initials == "" or (rest != "" and len(rest) % 2 == 0 and rest == "ua" * (len(rest) // 2))


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = text.rstrip(SPACE)
        out.append(1 if not body else 2 if (role, text) in seen else 3 if body[-1] not in ".!?" else 0)
        seen.add((role, text))
    return out


def cheapest(rows):
    """Least (cost, audit) over all edits with at most two inserts before a row, and its lines."""
    marks = faults(rows)
    ways = {"": (0, "", [])}
    best = None
    inserts = [[], ["user"], ["assistant"], ["user", "assistant"], ["assistant", "user"]]

    def key(done):  # what may follow depends only on whether anything is there, and the last letter
        return done[0] if len(done) == 1 else done[-1:] + "+"

    paths = [(0, "", "", [])]
    for (_, role, text), mark in zip(rows, marks):
        nxt = {}
        for cost, audit, done, lines in paths:
            for extra in inserts:
                base = done + "".join(r[0] for r in extra)
                told = lines + [f"{r}:" for r in extra]
                options = [("D", base, told, 3)]
                if mark in (0, 3):
                    price = 1 if mark == 3 else 0
                    options.append(("K", base + (role[:1] or "?"), told + [f"{role}:{text}"], price))
                    options += [("R", base + r[0], told + [f"{r}:{text}"], price + 2)
                                for r in ("user", "assistant")]
                for edit, new, lines2, price in options:
                    ok = any(legal(new + tail) for tail in ("", "a", "ua"))
                    if not ok:
                        continue
                    found = (cost + 2 * len(extra) + price, audit + "I" * len(extra) + edit, new, lines2)
                    state = (new == "", new == "s", new[-1:])
                    if state not in nxt or found[:2] < nxt[state][:2]:
                        nxt[state] = found
        paths = list(nxt.values())
    for cost, audit, done, lines in paths:
        for extra in inserts:
            if legal(done + "".join(r[0] for r in extra)):
                found = (cost + 2 * len(extra), audit + "I" * len(extra), lines + [f"{r}:" for r in extra])
                best = found if best is None or found[:2] < best[:2] else best
    return best, marks


def random_rows(seed, n):
    lot = random.Random(seed)
    return [(t, lot.choice(["system", "user", "assistant", "user", "assistant", "tool", ""]),
             lot.choice(["One.", "Two!", "cut", " ", "", "Three? ", "four\n", "Five."]))
            for t in sorted(lot.choices(range(n + 2), k=n))]


def frame(spark, convs):
    return spark.createDataFrame(
        [(c, t, r, x, 1) for c, rows in convs.items() for t, r, x in rows], SCHEMA)


def check(spark, convs):
    got = {r.conv_id: r for r in C.conversation_report(frame(spark, convs)).collect()}
    assert set(got) == set(convs)
    for c, rows in convs.items():
        rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        (cost, audit, lines), marks = cheapest(rows)
        r = got[c]
        assert (r.cost, r.audit) == (cost, audit), (c, rows)
        assert r.repaired_sha256 == hashlib.sha256("\n".join(lines).encode()).hexdigest()
        assert (r.blank, r.duplicate, r.truncated) == tuple(marks.count(k) for k in (1, 2, 3))
        pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(rows)]
        assert r.illegal == sum(p not in ("su", "ua", "au") for p in pairs)
        turns = {t for t, _, _ in rows if t is not None}
        assert r.gaps == (max(turns) - min(turns) + 1 - len(turns) if turns else 0)
    return got


def test_cheapest_of_all_edits(spark):
    check(spark, {c: random_rows(c, c % 9 + 1) for c in range(120)})


def test_spilled_walks(spark, monkeypatch):
    convs = {c: random_rows(c, 60) for c in range(6)}
    whole = check(spark, convs)
    # Long texts close a chunk early in the workers too, where the row limit is the module's own.
    big = {c: [(t, r, x + "y" * (C.CHUNK_BYTES // 2) + "." if x.strip() and t % 7 == 0 else x)
               for t, r, x in rows] for c, rows in list(convs.items())[:2]}
    got = {r.conv_id: r for r in C.conversation_report(frame(spark, big)).collect()}
    for c, rows in big.items():
        (cost, audit, lines), _ = cheapest(sorted(rows))
        assert (got[c].cost, got[c].audit) == (cost, audit)
        assert got[c].repaired_sha256 == hashlib.sha256("\n".join(lines).encode()).hexdigest()
    assert len(whole) == 6


def test_nulls_missing_rows_and_empty_tables(spark):
    rows = frame(spark, {1: [(None, None, None), (0, "user", "Hi."), (1, "assistant", "Yes.")],
                         None: [(3, "user", "A."), (None, "assistant", "B.")]})
    got = {r.conv_id: r for r in C.conversation_report(rows).collect()}
    assert got[1].audit == "DKK" and got[1].blank == 1 and got[1].gaps == 0
    assert got[None].audit == "DKI" or got[None].audit == "IKKI"
    gone = C.conversation_report(rows, rows["turn"].isNull() & rows["turn"].isNotNull()).collect()
    assert {(r.audit, r.cost, r.repaired_sha256) for r in gone} == {
        ("", 0, hashlib.sha256(b"").hexdigest())}
    assert C.conversation_report(rows.limit(0)).count() == 0


def test_repaired_rows_have_the_digest(spark):
    convs = {c: random_rows(c + 500, 12) for c in range(20)}
    rows = frame(spark, convs)
    report = C.conversation_report(rows)
    lines: dict = {}
    for r in sorted(C.repaired_rows(rows, report).collect(), key=lambda r: (r.conv_id, r.position)):
        lines.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    for r in report.collect():
        text = "\n".join(lines.get(r.conv_id, []))
        assert r.repaired_sha256 == hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("initials,good", [("", True), ("sua", True), ("ua", True), ("s", False),
                                           ("su", False), ("au", False), ("uaua", True)])
def test_grammar(initials, good):
    assert legal(initials) is good
