"""Files to findings.

A file is one row, so everything about a file is worked out inside its row: no shuffle
is needed to number lines, match rules, cut context, or drop repeats. Text is split only
when it holds a word that some rule needs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from seclake.fixed_values import (
    ASSERT_RULE,
    CONTEXT_LINES,
    RULES,
    Rule,
    SILENT_EXCEPT_RULE,
    STATIC_EXPLOIT,
    STATIC_FALSE_POSITIVE,
    STATIC_RECOMMENDATION,
    STRUCTURAL_RULES,
    WHITESPACE,
)
from seclake.functions.lookup import quoted
from seclake.functions.patterns import needed_words
from seclake.functions.texts import lines_text, split_lines, strip
from seclake.schemas import RULES as RULE_SCHEMA

# This many rules at most become literal patterns of one scan; longer tables take more scans.
MAX_LITERAL_RULES = 2000

_FLAGS = "(?iU)"
_HIT = "struct<vuln_id:string,line_number:int,line_content:string,context_lines:array<string>>"

# Letters that equal an ASCII letter when case is ignored, and that letter. Lower-casing
# alone would not turn all of them into it.
_ODD_LETTERS = "\u017f\u0131\u0130\u212a"
_PLAIN_LETTERS = "siik"

# One pass over Python text: strings become their first quote, comments go, lines that a
# backslash continues are joined. Every line starts with its number between _MARK and _AFTER.
_MARK, _AFTER = "\x01", "\x02"
_NUMBER = _MARK + r"\d++" + _AFTER
_LONG = r'QQQ[^Q\\]*+(?:(?:\\.|Q{1,2}(?!Q))[^Q\\]*+)*+(?:QQQ|\z)'
_SHORT = r'Q[^Q\\\n]*+(?:\\.[^Q\\\n]*+)*+Q?'
_LEXEME = (
    "(?s)(?=([\"']))(?:" + "|".join(p.replace("Q", q) for p in (_LONG, _SHORT) for q in "\"'")
    + r")|#[^\n]*+|\\\n(" + _NUMBER + ")")
# Brackets with none inside, and the number of the last line in them.
_BRACKETS = r"[(\[{](?:[^()\[\]{}]*(" + _NUMBER + r"))?[^()\[\]{}]*+[)\]}]"
# What comes before the first statement of a line that may hold several.
_HEAD = (r"^((?:async\s+)?(?:if|elif|else|for|while|try|except|finally|with|def|class|match|case)\b"
         r"(?:lambda\b[^:]*+:|:=|[^:])*?:(?!=))")
_ASSERT = r"^assert\b"
_BARE_EXCEPT = r"^except\s*:$"


def lines_of(files: DataFrame) -> DataFrame:
    """One row per line, numbered from 1."""
    return files.withColumn("_lines", split_lines("text")).select(
        *[c for c in files.columns if c != "text"],
        F.posexplode_outer("_lines").alias("_at", "line"),
    ).filter("_at is not null").withColumn("line_number", F.col("_at") + 1).drop("_at")


def context_text(lines: str, at: str, width: int = CONTEXT_LINES) -> str:
    """SQL text for the lines around 0-based position ``at``, clamped at both ends."""
    first = f"greatest({at} - {width - 1}, 1)"
    return f"slice({lines}, {first}, {at} + {width + 2} - {first})"


# The expressions below are SQL text: one parse is far cheaper than hundreds of calls that
# build the same tree column by column.

def _by_language(rules: Sequence[Rule], of_rules, otherwise: str) -> str:
    groups: dict[str, list[Rule]] = {}
    for rule in rules:
        groups.setdefault(rule.language, []).append(rule)
    if not groups:
        return otherwise
    cases = [f"WHEN {quoted(name)} THEN {of_rules(group)}" for name, group in groups.items()]
    return f"CASE language {' '.join(cases)} ELSE {otherwise} END"


def _may_match(rules: Sequence[Rule], lowered: str) -> str:
    """False only when no rule can match the text; a rule without words may always match.

    Looking for a word costs a fraction of a regular expression; the pattern decides.
    """
    needed = [needed_words(r.pattern) for r in rules]
    if None in needed:
        return "true"
    words = dict.fromkeys(word for of_rule in needed for word in of_rule)
    return "(" + " OR ".join(f"contains({lowered}, {quoted(w)})" for w in words) + ")"


def _lowered(text: str) -> str:
    """Text in lower case, with the odd letters replaced by the ones they stand for."""
    odd = " OR ".join(f"contains({text}, {quoted(letter)})" for letter in _ODD_LETTERS)
    plain = f"translate({text}, {quoted(_ODD_LETTERS)}, {quoted(_PLAIN_LETTERS)})"
    return f"lower(CASE WHEN {odd} THEN {plain} ELSE {text} END)"


def _hit_ids(rules: Sequence[Rule]) -> str:
    """Ids of the rules that match ``line``, in rule order (J1, literal form)."""
    tests = [
        f"CASE WHEN {_may_match([r], 'lowered')} AND line RLIKE {quoted(_FLAGS + r.pattern)} "
        f"THEN {quoted(r.vuln_id)} END" for r in rules]
    return f"array_compact(array({', '.join(tests)}))"


def _pattern_hits(rules: Sequence[Rule], width: int) -> str:
    hit = (
        "named_struct('vuln_id', id, 'line_number', at + 1, "
        f"'line_content', btrim(line, {quoted(WHITESPACE)}), "
        f"'context_lines', {context_text('_lines', 'at', width)})")
    # A one-element transform binds the lowered line.
    return (
        "flatten(array_compact(transform(_lines, (line, at) -> "
        "element_at(transform(array(get(_lowered_lines, at)), lowered -> "
        f"CASE WHEN {_may_match(rules, 'lowered')} "
        f"THEN transform({_hit_ids(rules)}, id -> {hit}) END), 1))))")


def _bound(value: str, name: str, result: str) -> str:
    """SQL text that works out ``value`` once and uses it as ``name``."""
    return f"element_at(transform(array({value}), {name} -> {result}), 1)"


def _statement_lines() -> str:
    """Lines of statements of ``_lines``: number, indent, and the statements on the line.

    Strings, comments and what stands in brackets are blanked first, so a line is one that
    Python sees. A statement behind ``if x:`` or ``;`` is one of its line's; the first item
    is what comes before a colon, if anything does.
    """
    marked = (
        "array_join(transform(_lines, (line, at) -> concat('\n', "
        f"{quoted(_MARK)}, cast(at + 1 AS string), {quoted(_AFTER)}, "
        f"translate(line, {quoted(_MARK + _AFTER)}, '  '))), '')")
    lexed = f"regexp_replace({marked}, {quoted(_LEXEME)}, '$1$2')"
    deepest = (
        r"aggregate(split(regexp_replace(t, '[^()\\[\\]{}]++', ''), ''), "
        "named_struct('now', 0, 'most', 0), (s, c) -> "
        + _bound("CASE WHEN c IN ('(', '[', '{') THEN s.now + 1 WHEN c = '' THEN s.now "
                 "ELSE greatest(s.now - 1, 0) END", "n",
                 "named_struct('now', n, 'most', greatest(s.most, n))") + ", s -> s.most)")
    flat = _bound(lexed, "t", _bound(
        deepest, "d", "CASE WHEN d = 0 THEN t ELSE aggregate(sequence(1, d), t, (u, k) -> "
        f"regexp_replace(u, {quoted(_BRACKETS)}, '~$1')) END"))
    first, numbers = quoted("^" + _NUMBER), quoted(_NUMBER)
    rest = f"regexp_replace(l, {first}, '')"
    bare = f"btrim(regexp_replace(l, {numbers}, ''), {quoted(WHITESPACE)})"
    rows = (
        f"transform(filter(split({flat}, '\n'), l -> {bare} <> ''), l -> named_struct("
        f"'n', cast(substring_index(substr(l, 2), {quoted(_AFTER)}, 1) AS int), "
        f"'indent', length({rest}) - length(ltrim({quoted(WHITESPACE)}, {rest})), "
        f"'parts', split(regexp_replace(btrim({rest}, {quoted(WHITESPACE)}), "
        f"{quoted(_HEAD)}, '$1;'), ';')))")
    return rows


def _structural_hits() -> str:
    """Asserts, and bare excepts whose only statement is ``pass``.

    Works on the lines of statements in native functions. Files that Python could not parse
    are judged as far as their lines go.
    """
    numbers = quoted(_NUMBER)

    def plain(part: str) -> str:
        return f"btrim(regexp_replace({part}, {numbers}, ''), {quoted(WHITESPACE)})"

    # A statement behind brackets that end on a later line stands on that line.
    behind = f"regexp_extract(array_join(slice(s.parts, 1, k), ''), {quoted('(?s).*' + _MARK + r'(\d++)' + _AFTER)}, 1)"
    asserts = (
        "flatten(transform(filter(all_s, s -> exists(s.parts, p -> contains(p, 'assert'))), s -> "
        "transform(filter(sequence(0, size(s.parts) - 1), "
        f"k -> {plain('get(s.parts, k)')} RLIKE {quoted(_ASSERT)}), "
        f"k -> coalesce(try_cast(CASE WHEN k > 0 THEN {behind} END AS int), s.n))))")
    said = f"filter(transform(s.parts, p -> {plain('p')}), p -> p <> '')"
    body = said.replace("s.parts", "get(all_s, at + 1).parts")
    only_pass = (
        f"{body} = array('pass') AND get(all_s, at + 1).indent > s.indent "
        "AND (get(all_s, at + 2) IS NULL OR get(all_s, at + 2).indent < get(all_s, at + 1).indent)")
    silent = (
        "transform(filter(all_s, (s, at) -> "
        f"{plain('get(s.parts, 0)')} RLIKE {quoted(_BARE_EXCEPT)} AND "
        f"(slice({said}, 2, 2) = array('pass') OR (size({said}) = 1 AND coalesce({only_pass}, false)))), "
        "s -> s.n)")

    def as_hits(found: str, rule: Rule) -> str:
        return (
            f"transform(array_distinct({found}), n -> named_struct('vuln_id', {quoted(rule.vuln_id)}, "
            f"'line_number', n, 'line_content', btrim(get(_lines, n - 1), {quoted(WHITESPACE)}), "
            "'context_lines', cast(array() as array<string>)))")

    return _bound(_statement_lines(), "all_s",
                  f"concat({as_hits(asserts, ASSERT_RULE)}, {as_hits(silent, SILENT_EXCEPT_RULE)})")


def scan_files(
    files: DataFrame,
    rules: Sequence[Rule] = RULES,
    structural: bool = True,
    width: int = CONTEXT_LINES,
) -> DataFrame:
    """Add ``hits``: the findings of each file, deduplicated, in source order.

    ``files`` has file_path, text and language. Pattern hits come first, then structural
    ones (U2). A line and a rule meet at most once, so no later dedup is needed (A12).
    """
    check_rules(rules)
    columns = files.columns
    no_lines, no_hits = "cast(array() as array<string>)", f"cast(array() as array<{_HIT}>)"
    structure = (
        "language = 'python' AND (contains(text, 'assert') OR contains(text, 'except'))"
        if structural else "false")
    may_hit = _by_language(rules, lambda group: _may_match(group, "_lowered"), "false")

    lowered = files.selectExpr(*columns, f"{_lowered('text')} AS _lowered")
    marked = lowered.selectExpr(
        *columns, "_lowered", f"coalesce({may_hit}, false) AS _may_hit",
        f"coalesce({structure}, false) AS _structure")
    split = marked.selectExpr(
        *columns, "_may_hit", "_structure",
        f"CASE WHEN _may_hit OR _structure THEN {lines_text('text')} ELSE {no_lines} END AS _lines",
        f"CASE WHEN _may_hit THEN {lines_text('_lowered')} ELSE {no_lines} END AS _lowered_lines")
    by_pattern = _by_language(rules, lambda group: _pattern_hits(group, width), no_hits)
    hits = (
        f"cast(concat(CASE WHEN _may_hit THEN {by_pattern} ELSE {no_hits} END, "
        f"CASE WHEN _structure THEN {_structural_hits()} ELSE {no_hits} END) as array<{_HIT}>)")
    # The hits come out of a generator, not a projection: Catalyst copies a projected
    # expression into every filter that uses it, and these are the costly ones.
    return split.selectExpr(*columns, f"inline_outer(array(named_struct('hits', {hits})))")


def rule_attributes(rules: Sequence[Rule]) -> Column:
    """Map from rule id to the rule's texts, as one constant."""
    pairs = []
    for r in rules:
        pairs.append(quoted(r.vuln_id))
        pairs.append(
            f"named_struct('category', {quoted(r.category)}, "
            f"'description', {quoted(r.description)}, 'cwe_id', {quoted(r.cwe_id)}, "
            f"'owasp_category', {quoted(r.owasp_category)}, "
            f"'confidence', {quoted(r.confidence)}, 'raw_severity', {quoted(r.severity)})")
    return F.expr(f"map({', '.join(pairs)})")


def findings_of(scanned: DataFrame, rules: Sequence[Rule] = RULES) -> DataFrame:
    """One row per finding of ``scan_files`` output."""
    known = list(rules) + [r for r in STRUCTURAL_RULES if r not in rules]
    kept = [c for c in scanned.columns if c not in ("text", "hits")]
    rows = scanned.select(*kept, F.posexplode("hits").alias("source_order", "_hit"))
    rows = rows.withColumn("_rule", F.element_at(rule_attributes(known), F.col("_hit.vuln_id")))
    return rows.select(*kept, "source_order", "_hit.*", "_rule.*")


def check_rules(rules: Sequence[Rule]) -> None:
    """Ids must be unique and patterns must compile in the engine that runs them."""
    seen, spark = set(), SparkSession.active()
    for rule in rules:
        if rule.vuln_id in seen:
            raise ValueError(f"rule id {rule.vuln_id} is not unique")
        seen.add(rule.vuln_id)
        if rule in RULES:
            continue
        try:
            spark._jvm.java.util.regex.Pattern.compile(_FLAGS + rule.pattern)
        except IllegalArgumentException as problem:
            raise ValueError(f"pattern of rule {rule.vuln_id}: {problem}") from problem


def rules_from(frame: DataFrame) -> list[Rule]:
    """The rules of a frame as literals, in its order."""
    return [Rule(*row) for row in frame.select(*RULE_SCHEMA.fieldNames()).collect()]


def scan_in_chunks(
    files: DataFrame, rules: Sequence[Rule], structural: bool = True, width: int = CONTEXT_LINES,
) -> DataFrame:
    """As scan_files, by scans of MAX_LITERAL_RULES rules each; same hits in the same order.

    The hits of a file are merged in its row.
    """
    check_rules(rules)
    if len(rules) <= MAX_LITERAL_RULES:
        return scan_files(files, rules, structural, width)
    columns, scanned, found = files.columns, files, []
    for first in range(0, len(rules), MAX_LITERAL_RULES):
        chunk = rules[first:first + MAX_LITERAL_RULES]
        scanned = scan_files(scanned, chunk, False, width).withColumnRenamed(
            "hits", name := f"_hits{len(found)}")
        found.append(name)
    scanned = scan_files(scanned, [], structural, width)
    # By line, then by chunk, then as found in it.
    keyed = ", ".join(
        f"transform({name}, (h, i) -> named_struct('n', h.line_number, 'k', {k}, 'i', i, 'h', h))"
        for k, name in enumerate(found))
    merged = f"transform(array_sort(concat({keyed})), s -> s.h)"
    return scanned.selectExpr(*columns, f"concat({merged}, hits) AS hits")


def scan_with_rule_frame(files: DataFrame, rules: DataFrame, **options) -> DataFrame:
    """Findings for a caller's rule table (X1), which becomes literal patterns.

    The driver holds the table. However long it is, the findings have the same columns.
    """
    literal = rules_from(rules)
    return findings_of(scan_in_chunks(files, literal, **options), literal)


def join_rules(files: DataFrame, rules: DataFrame, salts: int = 16) -> DataFrame:
    """Lines joined to rules of their language on "pattern matches line" (J1, table form).

    The language alone would send a whole language to one task, so lines are spread over
    ``salts`` buckets and each rule is copied into every bucket. Context lines are left
    out, so that a line is shuffled once and not seven times.
    """
    repeated = rules.groupBy("vuln_id").count().filter("count > 1").limit(1).count()
    if repeated:
        raise ValueError("rule ids are not unique")
    hashed = F.pmod(F.hash("file_path", "line_number"), F.lit(salts))
    lines = lines_of(files).withColumn("_salt", hashed)
    copies = rules.select(
        F.col("language").alias("_language"), "vuln_id", "category", "pattern", "description",
        "cwe_id", "owasp_category", "confidence", F.col("severity").alias("raw_severity"),
        F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("_bucket"))
    met = lines.join(
        copies,
        (F.col("language") == F.col("_language"))
        & (F.col("_salt") == F.col("_bucket"))
        & F.expr(f"line rlike concat('{_FLAGS}', pattern)"),
    ).drop("_salt", "_bucket", "_language", "pattern")
    return met.withColumn("line_content", strip(F.col("line"))).drop("line")


def distinct_findings(findings: DataFrame, order: list, keys: Sequence[str]) -> DataFrame:
    """First finding of each key in the given order.

    ``row_number() = 1`` lets Spark keep one row per key and task before the shuffle.
    """
    first = Window.partitionBy(*keys).orderBy(*order)
    return findings.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn")


def analyzed_of(findings: DataFrame) -> DataFrame:
    """Static findings in the shape of analyzed ones."""
    return findings.select(
        *[c for c in findings.columns
          if c not in ("raw_severity", "description", "context_lines")],
        F.col("raw_severity").alias("severity"),
        F.col("description").alias("ai_explanation"),
        F.lit(STATIC_EXPLOIT).alias("exploit_scenario"),
        F.lit(STATIC_RECOMMENDATION).alias("recommendation"),
        F.lit("").alias("secure_code_snippet"),
        F.lit(STATIC_FALSE_POSITIVE).alias("false_positive_likelihood"),
        F.array().cast("array<string>").alias("references"),
    )
