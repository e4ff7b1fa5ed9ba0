"""Known values of scores, levels, paths, lines and times."""

import math

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from seclake.functions import scores, texts
from seclake.operators import risk


def values(spark, column, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


@pytest.mark.parametrize("counts, score, level", [
    ((0, 0, 0, 0), 0, "Low"), ((0, 1, 0, 0), 41, "Medium"), ((0, 2, 0, 0), 54, "High"),
    ((1, 0, 0, 0), 65, "High"), ((1, 1, 0, 0), 65, "High"), ((2, 0, 0, 0), 70, "High"),
    ((8, 0, 0, 0), 100, "Critical"), ((50, 0, 0, 0), 100, "Critical"), ((0, 0, 0, 1), 13, "Low"),
])
def test_score_of_counts(spark, counts, score, level):
    rows = spark.createDataFrame([counts], "critical INT, high INT, medium INT, low INT")
    got = risk.with_score(rows).first()
    assert (got.risk_score, got.risk_level) == (score, level)


def test_score_for_many_counts(spark):
    cases = [(c, h, m, lo) for c in (0, 1, 7, 9) for h in (0, 1, 3, 40) for m in (0, 2, 99)
             for lo in (0, 1, 1000)]
    rows = spark.createDataFrame(cases, "critical INT, high INT, medium INT, low INT")
    for got in risk.with_score(rows).collect():
        raw = 10 * got.critical + 7 * got.high + 4 * got.medium + got.low
        want = 0 if raw == 0 else int(min(100, 20 * math.log1p(raw)))
        if got.critical:
            want = max(want, 60 + min(40, 5 * got.critical))
        assert got.risk_score == min(want, 100)


def test_lifecycle_rules_at_their_edges(spark):
    edges = [0, 1, 24, 25, 49, 50, 74, 75, 100]
    s = F.col("s")
    rows = spark.createDataFrame([(e,) for e in edges], "s INT").select(
        scores.level_of(s), scores.lifecycle_at_transition(s), scores.lifecycle_at_override(s),
        scores.lifecycle_at_scan(s), scores.lifecycle_of_open(s)).collect()
    level, move, override, scan, rest = map(list, zip(*rows))
    assert level == ["Low"] * 3 + ["Medium"] * 2 + ["High"] * 2 + ["Critical"] * 2
    assert move == ["Safe", "Warning", "Warning", "Vulnerable", "Vulnerable"] + ["Critical"] * 4
    assert override == ["Resolved"] + move[1:]
    assert scan == ["Safe"] * 3 + ["Warning"] * 2 + ["Vulnerable"] * 2 + ["Critical"] * 2
    assert rest == ["Resolved"] + scan[1:]


def test_moves(spark):
    rows = [("Safe", "Warning"), ("Safe", "Safe"), ("Safe", "Critical"), ("Resolved", "Safe"),
            ("Odd", "Safe"), (None, "Safe"), ("Critical", "Resolved")]
    got = values(spark, scores.may_move(F.col("a"), F.col("b")), rows, "a STRING, b STRING")
    assert got == [True, False, False, False, False, False, True]


@pytest.mark.parametrize("path, extension, language", [
    ("a/b.PY", ".PY", "python"), (".bashrc", "", "unknown"), ("x/y.tar.gz", ".gz", "unknown"),
    ("noext", "", "unknown"), ("a.d/file", "", "unknown"), ("..py", "", "unknown"),
    ("a/.x.js", ".js", "javascript"), ("a.tsx", ".tsx", "javascript"), ("m.h", ".h", "c"),
])
def test_extension_and_language(spark, path, extension, language):
    p = F.lit(path)
    got = spark.range(1).select(texts.extension(p), texts.language_by_path(p)).first()
    assert tuple(got) == (extension, language)


@pytest.mark.parametrize("code, language", [
    ("  #include <x>", "cpp"), ("int main() {}", "cpp"), ("const a = 1", "javascript"),
    ("let a", "javascript"), ("print(1)", "python"), ("", "python"),
    (" " * 600 + "let a", "javascript"), ("x" * 500 + "let a", "python"),
])
def test_language_by_content(spark, code, language):
    assert values(spark, texts.language_by_content(F.col("t")), [(code,)], "t STRING") == [language]


LINE_CASES = ["", "\n", "a", "a\n", "a\n\n", "a\r\nb", "a\r\r\nb", "a\rb", "a\x0bb\x0cc", "a b ",
              "a\x85b", "\x1ca\x1db\x1e", "a\n ", "\r\n\r\n", "\n\r"]


def test_lines_like_splitlines(spark):
    got = values(spark, texts.split_lines("t"), [(c,) for c in LINE_CASES], "t STRING")
    assert got == [c.splitlines() for c in LINE_CASES]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet="ab \t\r\n\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0  　é", max_size=30),
                min_size=20, max_size=40))
def test_lines_and_strip_of_any_text(spark, cases):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i INT, t STRING")
    got = df.select("i", texts.split_lines("t"), texts.strip(F.col("t"))).collect()
    for i, lines, stripped in got:
        assert lines == cases[i].splitlines()
        assert stripped == cases[i].strip()


def test_paths_and_keys(spark):
    got = spark.sql("SELECT 'src\\\\a.b/m.x.py' p, TIMESTAMP_NTZ '2026-01-02 03:04:05' t").select(
        texts.normal_path(F.col("p")), texts.secure_name(F.lit("d/m.x.py")),
        texts.report_key(F.lit("d/m.x.py"), F.col("t")), texts.iso_text(F.col("t")),
        texts.normal_path(F.lit(None).cast("string"))).first()
    assert tuple(got) == ("src/a.b/m.x.py", "m.x_secure.py", "security_report_m_x_py_20260102_030405",
                          "2026-01-02T03:04:05.000000Z", "")


def test_iso_times(spark):
    cases = ["1970-01-01T00:00:01Z", "1970-01-01T00:00:00.000005+00:00", "1970-01-01T01:00:00+01:00", "bad"]
    got = values(spark, texts.micros_of_iso(F.col("t")), [(c,) for c in cases], "t STRING")
    assert got == [1_000_000, 5, 0, None]


def test_camel_case(spark):
    df = spark.sql("SELECT 1 id, 2 file_path, 3 is_it_so")
    assert texts.camel_case(df, {"id": "scanId"}).columns == ["scanId", "filePath", "isItSo"]
