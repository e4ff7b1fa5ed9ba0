"""SQL pieces shared by several checks."""

from __future__ import annotations

from checks.adapters import SQL, _quote
from seclake.fixed_values import RULES, STRUCTURAL_RULES, WHITESPACE

WS = _quote(WHITESPACE)
BREAK = r"'\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]'"

RULE_ROWS = ", ".join(
    "(" + ", ".join([str(i)] + [_quote(v) for v in rule]) + ")" for i, rule in enumerate(RULES))
STRUCT_ROWS = ", ".join(
    "(" + ", ".join([str(100 + i)] + [_quote(v) for v in rule]) + ")"
    for i, rule in enumerate(STRUCTURAL_RULES))
_RULE_NAMES = ("place, vuln_id, language, category, pattern, description, cwe_id, "
               "owasp_category, confidence, raw_severity")


def lines_sql(table: str, name: str = "lines") -> str:
    return f"""
    {name}_split AS (SELECT * EXCLUDE (text), regexp_split_to_array(text, {BREAK}) AS p FROM {table}),
    {name}_parts AS (SELECT * EXCLUDE (p),
        CASE WHEN p[len(p)] = '' THEN p[1:len(p)-1] ELSE p END AS p FROM {name}_split),
    {name} AS (SELECT *, p[line_number] AS line FROM
        (SELECT *, CAST(unnest(range(1, len(p) + 1)) AS INT) AS line_number FROM {name}_parts))"""


# source_files -> lines -> hits (patterns), structural hits, all findings
LINES = f"WITH source_files AS ({SQL['source_files']}), {lines_sql('source_files')}"
SCAN = f"""{LINES},
rules AS (SELECT * FROM (VALUES {RULE_ROWS}) AS r({_RULE_NAMES})),
structural_rules AS (SELECT * FROM (VALUES {STRUCT_ROWS}) AS r({_RULE_NAMES})),
hits AS (
    SELECT l.doc_id, l.repo, l.file_path, l.language, l.line_number, r.place, r.vuln_id,
        trim(l.line, {WS}) AS line_content,
        array_to_string(l.p[greatest(l.line_number - 3, 1):l.line_number + 3], chr(10)) AS context,
        r.category, r.description, r.cwe_id, r.owasp_category, r.confidence, r.raw_severity
    FROM lines l JOIN rules r
      ON l.language = r.language AND regexp_matches(l.line, r.pattern, 'i')),
code AS (
    SELECT doc_id, repo, file_path, language, line_number, trim(line, {WS}) AS code,
        length(line) - length(ltrim(line, {WS})) AS indent
    FROM lines WHERE language = 'python'),
statements AS (
    SELECT *, lead(code) OVER w AS body, lead(indent) OVER w AS body_indent,
        lead(indent, 2) OVER w AS after_indent
    FROM code WHERE code <> '' AND NOT starts_with(code, '#')
    WINDOW w AS (PARTITION BY file_path ORDER BY line_number)),
found AS (
    SELECT *, 'PY-AST-001' AS rule FROM statements WHERE regexp_matches(code, '^assert\\b')
    UNION ALL
    SELECT *, 'PY-AST-002' FROM statements
    WHERE regexp_matches(code, '^except\\s*:\\s*pass\\s*(#.*)?$')
       OR (regexp_matches(code, '^except\\s*:\\s*(#.*)?$')
           AND regexp_matches(body, '^pass\\s*(#.*)?$') AND body_indent > indent
           AND (after_indent IS NULL OR after_indent < body_indent))),
structural AS (
    SELECT f.doc_id, f.repo, f.file_path, f.language, f.line_number, r.place, r.vuln_id,
        f.code AS line_content, '' AS context, r.category, r.description, r.cwe_id,
        r.owasp_category, r.confidence, r.raw_severity
    FROM found f JOIN structural_rules r ON f.rule = r.vuln_id),
findings AS (
    SELECT *, CAST(row_number() OVER (PARTITION BY file_path ORDER BY part, head, line_number, place) - 1
        AS INT) AS source_order
    FROM (SELECT *, 0 AS part, 0 AS head FROM hits
          UNION ALL SELECT *, 1 AS part, place AS head FROM structural))
"""


def score_sql(raw: str, critical: str) -> str:
    return (
        f"CAST(CASE WHEN {raw} = 0 THEN 0 ELSE least(100, greatest("
        f"floor(least(100.0, 20 * ln(1 + {raw}))), "
        f"CASE WHEN {critical} > 0 THEN 60 + least(40, 5 * {critical}) ELSE 0 END)) END AS INT)")


def level_sql(score: str) -> str:
    return (f"CASE WHEN {score} >= 75 THEN 'Critical' WHEN {score} >= 50 THEN 'High' "
            f"WHEN {score} >= 25 THEN 'Medium' ELSE 'Low' END")


def lifecycle_sql(score: str) -> str:
    return (f"CASE WHEN {score} >= 75 THEN 'Critical' WHEN {score} >= 50 THEN 'Vulnerable' "
            f"WHEN {score} >= 25 THEN 'Warning' ELSE 'Safe' END")


WEIGHT_ALL = "CASE severity WHEN 'Critical' THEN 10 WHEN 'High' THEN 7 WHEN 'Medium' THEN 4 ELSE 1 END"
COUNTS = ", ".join(
    f"CAST(count(*) FILTER (WHERE severity = '{s}') AS BIGINT) AS {s.lower()}"
    for s in ("Critical", "High", "Medium", "Low"))
RAW = "(10 * critical + 7 * high + 4 * medium + low)"
TREND = ("CASE {} WHEN 'Critical' THEN '🔴 Urgent Action Required — Exploitable vulnerabilities present' "
         "WHEN 'High' THEN '🟠 Action Required — Significant security weaknesses detected' "
         "WHEN 'Medium' THEN '🟡 Review Recommended — Moderate risk requiring attention' "
         "WHEN 'Low' THEN '🟢 Low Risk — Minor issues detected; best-practice hardening advised' "
         "ELSE '' END")
