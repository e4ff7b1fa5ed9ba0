"""Rules, context, structural checks and user rules."""

import re

import pytest
from checks.adapters import PLANTS
from seclake.fixed_values import RULES, Rule
from seclake.functions.patterns import needed_words
from seclake.functions.texts import split_lines
from seclake.operators import risk, scanning
from seclake.schemas import RULES as RULE_SCHEMA

LANGUAGE = {".py": "python", ".js": "javascript", ".php": "php", ".java": "java"}


def files(spark, *rows):
    return spark.createDataFrame(list(rows), "file_path STRING, text STRING, language STRING")


def found(spark, *rows, **options):
    hits = scanning.findings_of(scanning.scan_files(files(spark, *rows), **options))
    return [(r.file_path, r.vuln_id, r.line_number) for r in
            hits.orderBy("file_path", "source_order").collect()]


def test_each_plant_hits_and_its_twin_misses(spark):
    rows = []
    for k, ext, rule, hit, miss in PLANTS:
        rows += [(f"hit{k:02}", hit, LANGUAGE[ext]), (f"miss{k:02}", miss, LANGUAGE[ext])]
    got = found(spark, *rows)
    hits = {(f, r) for f, r, _ in got}
    for k, _, rule, _, _ in PLANTS:
        assert (f"hit{k:02}", rule) in hits
        assert (f"miss{k:02}", rule) not in hits
    assert ("hit06", "CRYPTO-001") in hits


def test_words_are_needed(spark):
    """A text that matches a pattern holds one of the rule's words."""
    assert all(needed_words(r.pattern) for r in RULES)
    by_id = {rule: hit for _, _, rule, hit, _ in PLANTS}
    more = {
        "SEC-001": ["PASSWD = 'aaaa'", "pwd='aaaa'", "secret= 'aaaa'", "API_KEY='aaaa'", "apikey='aaaa'",
                    "Token = \"aaaa\"", "PASSWORD='bbbb'"],
        "CMD-001": ["subprocess.call(a + b)", "SUBPROCESS.Popen(a+b)"],
        "JS-SEC-001": ["secret: 'aaaa'", "API_KEY = 'aaaa'", "token='aaaa'", "password: 'aaaa'"],
        "JS-SQL-001": ["execute('${x}')"], "JS-PROTO-001": ["prototype[x]"],
        "PHP-CMD-001": ["system($_GET[1])", "exec($_POST[1])", "passthru($_REQUEST[1])"],
        "CRYPTO-001": ["SHA1 ("], "DBG-001": ["debug = true"], "XSS-001": ["render(request.x)"],
    }
    for rule in RULES:
        for text in [by_id[rule.vuln_id], *more.get(rule.vuln_id, [])]:
            for form in (text, text.upper() if rule.vuln_id not in ("JS-SQL-001",) else text):
                if re.search(rule.pattern, form, re.IGNORECASE):
                    assert any(w in form.lower() for w in needed_words(rule.pattern))


def test_same_hits_as_plain_regular_expressions(spark):
    """Against Python's search on every line, odd letters and line breaks included."""
    lines = [hit for _, _, _, hit, _ in PLANTS] + [miss for _, _, _, _, miss in PLANTS] + [
        "ſecret = 'abcdef'", "TOKEN = 'abcdef'", "pıckle.loads(x)", "EVAL (x)",
        "eval (x)", "password\t=\t'x y z w'", "cursor.execute('%s' % İ)"]
    rows = []
    for language in ("python", "javascript", "php", "java", "c", "unknown"):
        rows.append((language, "\n".join(lines), language))
        rows.append((f"{language}-crlf", "\r\n".join(lines) + "\r\n", language))
    want = []
    for name, text, language in rows:
        for number, line in enumerate(text.splitlines(), 1):
            want += [(name, r.vuln_id, number) for r in RULES
                     if r.language == language and re.search(r.pattern, line, re.IGNORECASE)]
    assert sorted(found(spark, *rows, structural=False)) == sorted(want)


def test_join_form_gives_the_same_hits(spark, sf):
    from checks.adapters import source_files
    source = source_files(spark, sf)
    columns = ["file_path", "line_number", "vuln_id", "line_content"]
    literal = scanning.findings_of(scanning.scan_files(source, structural=False)).select(columns)
    joined = scanning.join_rules(source, spark.createDataFrame(RULES, RULE_SCHEMA)).select(columns)
    assert literal.count() > 0
    assert literal.exceptAll(joined).count() == 0 and joined.exceptAll(literal).count() == 0


def test_context_is_clamped(spark):
    text = "\n".join(["eval(1)", "b", "c", "d", "e", "eval(2)"])
    rows = scanning.findings_of(scanning.scan_files(files(spark, ("f", text, "python")))).orderBy(
        "line_number").collect()
    assert [r.context_lines for r in rows] == [["eval(1)", "b", "c", "d"], ["c", "d", "e", "eval(2)"]]


def test_context_at_every_line(spark):
    text = "\n".join("abcdefghij")
    df = spark.createDataFrame([(text,)], "text STRING").withColumn("lines", split_lines("text"))
    got = df.selectExpr(f"transform(lines, (x, i) -> {scanning.context_text('lines', 'i')})").first()[0]
    lines = list("abcdefghij")
    assert got == [lines[max(0, i - 3):i + 4] for i in range(10)]


@pytest.mark.parametrize("text, want", [
    ("assert x", [("PY-AST-001", 1)]),
    ("    assert(x)\nassertion = 1\n# assert y", [("PY-AST-001", 1)]),
    ("try:\n    f()\nexcept:\n    pass", [("PY-AST-002", 3)]),
    ("try:\n    f()\nexcept: pass", [("PY-AST-002", 3)]),
    ("try:\n    f()\nexcept:  # why\n\n    # note\n    pass  # ok\nx = 1", [("PY-AST-002", 3)]),
    ("try:\n    f()\nexcept:\n    pass\n    g()", []),
    ("try:\n    f()\nexcept:\n    g()\n    pass", []),
    ("try:\n    f()\nexcept Exception:\n    pass", []),
    ("try:\n    f()\nexcept:\n    pass\nassert y", [("PY-AST-001", 5), ("PY-AST-002", 3)]),
])
def test_structural_checks(spark, text, want):
    assert [(r, n) for _, r, n in found(spark, ("f", text, "python"))] == want
    assert found(spark, ("f", text, "javascript")) == []


QQQ = '"' * 3


@pytest.mark.parametrize("text, want", [
    (f"def f():\n    {QQQ}Says:\n    assert x\n    {QQQ}\n    return 1", []),
    ("x = '''\nassert a\nit's\n'''\nassert b", [("PY-AST-001", 5)]),
    ("if x: assert y", [("PY-AST-001", 1)]),
    ("a = 1; assert z", [("PY-AST-001", 1)]),
    ("a = f(\n  1); assert z", [("PY-AST-001", 2)]),
    ("assert (a and\n  # assert no\n  b), 'assert c'", [("PY-AST-001", 1)]),
    ("a = b + \\\n    c; assert d", [("PY-AST-001", 2)]),
    ("d = {'k': [1, (2,\n 3)],\n 'assert': 4}\nassert d", [("PY-AST-001", 4)]),
    ("for a in b[1:2]: x = 1; assert a; assert b", [("PY-AST-001", 1)]),
    ("while (y := f(lambda: 1)): assert y", [("PY-AST-001", 1)]),
    ("x = 'a # b'; assert x", [("PY-AST-001", 1)]),
    ("s = r'\\\\'; assert s", [("PY-AST-001", 1)]),
    ("s = 'it\\'s'; assert s", [("PY-AST-001", 1)]),
    ("assert_that(x)\nobj.assert_(y)\nmy_assert = 1", []),
    ("try: f()\nexcept: pass; pass", []),
    ("try: f()\nexcept: pass;", [("PY-AST-002", 2)]),
    (f"try:\n  f()\nexcept:\n  {QQQ}why{QQQ}\n  pass", []),
    (f"s = {QQQ}\ntry: f()\nexcept: pass\n{QQQ}", []),
    ("try:\n  f(\n1)\nexcept :\n  pass\nelse:\n  g()", [("PY-AST-002", 4)]),
    ("try:\n  f()\nexcept:\n  if x:\n    pass", []),
])
def test_statements_as_python_sees_them(spark, text, want):
    import ast
    tree = list(ast.walk(ast.parse(text)))  # the expectation itself is checked by Python's parser
    lines = sorted({n.lineno for n in tree if isinstance(n, ast.Assert)})
    silent = sorted(n.lineno for n in tree if isinstance(n, ast.ExceptHandler) and n.type is None
                    and len(n.body) == 1 and isinstance(n.body[0], ast.Pass))
    assert want == [("PY-AST-001", n) for n in lines] + [("PY-AST-002", n) for n in silent]
    assert [(r, n) for _, r, n in found(spark, ("f", text, "python")) if r.startswith("PY-AST")] == want


def test_statements_of_a_whole_library(spark):
    import ast
    import glob
    import sysconfig
    texts = {}
    for path in sorted(glob.glob(sysconfig.get_paths()["stdlib"] + "/*.py"))[:120]:
        with open(path, encoding="utf-8", errors="replace") as file:
            texts[path] = file.read()
    rows = spark.createDataFrame(
        [(p, t, "python") for p, t in texts.items()], "file_path STRING, text STRING, language STRING")
    got = {(r.file_path, r.vuln_id, r.line_number) for r in scanning.findings_of(
        scanning.scan_files(rows, [])).collect()}
    want = set()
    for path, text in texts.items():
        for n in ast.walk(ast.parse(text)):
            if isinstance(n, ast.Assert):
                want.add((path, "PY-AST-001", n.lineno))
            if isinstance(n, ast.ExceptHandler) and n.type is None and len(n.body) == 1 \
                    and isinstance(n.body[0], ast.Pass):
                want.add((path, "PY-AST-002", n.lineno))
    assert got == want and len(want) > 50


def test_needed_words(spark):
    assert all(needed_words(r.pattern) for r in RULES)
    assert needed_words(r"\bexec(ute)?\s*\(") == ("exec",)
    assert needed_words(r"(?:system|exec)\s*\(.*\$") == ("system", "exec")
    assert needed_words(r"a{0,2}x?") is None and needed_words(r"(foo|[a-z]+)") is None
    assert needed_words(r"\p{Lu}abc") is None and needed_words("(") is None
    rule = Rule("MY-1", "python", "Mine", r"[a-z]+_unsafe\(", "", "CWE-1", "N/A", "LOW", "Low")
    loose = rule._replace(vuln_id="MY-2", pattern=r"^\w\W")
    assert "contains(lowered, '_unsafe(')" in scanning._may_match([*RULES[:2], rule], "lowered")
    text = "go_UNSAFE(x)\na=1\neval(b)\nmd5(c)"
    with_both = found(spark, ("f", text, "python"), rules=[*RULES, rule, loose], structural=False)
    alone = [x for r in (*RULES, rule, loose) if r.language == "python" for x in found(
        spark, ("f", text, "python"), rules=[r], structural=False)]
    assert sorted(with_both) == sorted(alone) and {"MY-1", "MY-2"} < {r for _, r, _ in with_both}


def test_no_text_no_findings(spark):
    assert found(spark, ("a", "", "python"), ("b", None, "python"), ("c", "eval(x)", None)) == []


def test_user_rules(spark):
    rule = Rule("MY-1", "cobol", "Mine", r"^\s*perform\b", "", "CWE-1", "N/A", "LOW", "Low")
    source = files(spark, ("f", "PERFORM x\nno perform", "cobol"), ("g", "perform", "python"))
    frame = spark.createDataFrame([rule], RULE_SCHEMA)
    want = [("f", "MY-1", 1)]
    for hits in (scanning.scan_with_rule_frame(source, frame), scanning.join_rules(source, frame)):
        assert [(r.file_path, r.vuln_id, r.line_number) for r in hits.collect()] == want


@pytest.mark.parametrize("options", [{}, {"structural": False, "width": 2}])
def test_more_user_rules_than_the_limit(spark, sf, monkeypatch, options):
    from checks.adapters import source_files
    text = "\n".join(["assert eval(x)", "md5(a)", "eval(pickle.load(f))", "except: pass"])
    source = source_files(spark, sf).select("file_path", "text", "language").limit(300).union(
        files(spark, ("many", text, "python"), ("none", None, "python")))
    frame = spark.createDataFrame(RULES, RULE_SCHEMA)
    want = scanning.scan_with_rule_frame(source, frame, **options)
    monkeypatch.setattr(scanning, "MAX_LITERAL_RULES", 3)
    got = scanning.scan_with_rule_frame(source, frame, **options)
    assert got.columns == want.columns and want.count() > 0
    assert want.exceptAll(got).count() == 0 and got.exceptAll(want).count() == 0


def test_bad_user_rules(spark):
    good = Rule("A", "python", "", "x", "", "", "", "", "Low")
    with pytest.raises(ValueError, match="not unique"):
        scanning.check_rules([good, good])
    for pattern in ("(", r"{\w+}", "a{,3}"):  # the last two compile in Python only
        with pytest.raises(ValueError, match="pattern of rule A"):
            scanning.check_rules([good._replace(pattern=pattern)])
    scanning.check_rules([good._replace(pattern=r"\p{Lu}\h+")])  # in the engine only
    doubled = spark.createDataFrame([good, good], RULE_SCHEMA)
    with pytest.raises(ValueError, match="not unique"):
        scanning.join_rules(files(spark, ("f", "x", "python")), doubled)


def test_own_rule_with_a_known_id_is_not_prefiltered(spark):
    rule = RULES[0]._replace(pattern="zzz")
    assert found(spark, ("f", "zzz", "python"), rules=[rule]) == [("f", "SQL-001", 1)]


def test_file_profile_agrees_with_row_profile(spark, sf):
    from checks.adapters import source_files
    scanned = scanning.scan_files(source_files(spark, sf))
    by_file = risk.file_profiles(scanned)
    rows = scanning.analyzed_of(scanning.findings_of(scanned))
    by_row = risk.risk_profile(rows, ["file_path"])
    both = by_row.join(by_file.withColumnRenamed("risk_score", "other"), "file_path")
    assert both.count() == by_row.count() > 0
    assert both.filter("risk_score <> other").count() == 0
    assert by_file.filter("total > 0").count() == by_row.count()
