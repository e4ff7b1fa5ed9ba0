"""Files to findings: lines, rules, context, structure, sources."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import adapters as A
from checks.pieces import BREAK, SCAN, WS, lines_sql
from checks.registry import given, query
from seclake.functions import texts
from seclake.operators import answers, scanning
from seclake.plans.answered_scans import store_answered_scans
from seclake.plans.file_scan import scan_and_store
from seclake.plans.repo_scan import scan_repositories_and_store
from seclake.session import new_folder, spread
from seclake.sources.tables import read_table
from seclake.sources.tree import list_tree, read_tree, tree_total
from seclake.streaming.arriving import scan_arriving, scan_growing_tree
from seclake.fixed_values import LANGUAGE_SNIFF_CHARS, RULES, Rule
from seclake.schemas import RULES as RULE_SCHEMA

_HIT = "file_path, line_number, vuln_id, line_content, category, description, cwe_id, " \
       "owasp_category, confidence, raw_severity"
_HIT_COLUMNS = _HIT.split(", ")
def _at():
    return F.lit("2026-01-02 03:04:05").cast("timestamp_ntz")




def _hits(spark, sf, **options):
    return scanning.findings_of(scanning.scan_files(A.source_files(spark, sf), **options))


@query("f1_language_by_content", f"""
SELECT doc_id, CASE WHEN contains(head, '#include') OR contains(head, 'int main(') THEN 'cpp'
    WHEN contains(head, 'const ') OR contains(head, 'let ') THEN 'javascript'
    ELSE 'python' END AS language
FROM (SELECT doc_id, left(trim(text, {WS}), 500) AS head FROM documents)""")
def f1(spark, sf):
    # The first 500 characters are the feature: the language is sniffed from them.
    documents = A.read(spark, sf, "documents")
    return documents.select("doc_id", texts.language_by_content(F.col("text")).alias("language"))


@query("f2_language_by_path", given("scans") + """
SELECT id, CASE regexp_extract(lower(file_path), '(\\.[^./]*)$', 1) WHEN '.py' THEN 'python'
    WHEN '.js' THEN 'javascript' WHEN '.tsx' THEN 'javascript' WHEN '.cpp' THEN 'c'
    ELSE 'unknown' END AS language FROM scans""")
def f2(spark, sf):
    return A.scans(spark, sf).select("id", texts.language_by_path(F.col("file_path")).alias("language"))


@query("f17_strip_and_split", given("source_files") + f"""
SELECT file_path, trim(text, {WS}) AS stripped,
    CAST(len(p) - CASE WHEN p[len(p)] = '' THEN 1 ELSE 0 END AS INT) AS line_count
FROM (SELECT *, regexp_split_to_array(text, {BREAK}) AS p FROM source_files)""")
def f17(spark, sf):
    text = F.col("text")
    return A.source_files(spark, sf).select(
        "file_path", texts.strip(text).alias("stripped"),
        F.size(texts.split_lines("text")).alias("line_count"))


@query("w3_line_numbers", given("source_files")[:-1] + f", {lines_sql('source_files')} "
       "SELECT file_path, line_number, line FROM lines")
def w3(spark, sf):
    return scanning.lines_of(A.source_files(spark, sf)).select("file_path", "line_number", "line")


@query("j1_rule_hits", SCAN + f"SELECT {_HIT} FROM hits")
def j1(spark, sf):
    return _hits(spark, sf, structural=False).select(*_HIT_COLUMNS)


@query("j1_rule_hits_by_join", SCAN + f"SELECT {_HIT} FROM hits")
def j1_join(spark, sf):
    rules = spark.createDataFrame(RULES, RULE_SCHEMA)
    return scanning.join_rules(A.source_files(spark, sf), rules).select(*_HIT_COLUMNS)


@query("w2_context_lines", SCAN + "SELECT file_path, line_number, vuln_id, context FROM hits")
def w2(spark, sf):
    return _hits(spark, sf, structural=False).select(
        "file_path", "line_number", "vuln_id",
        F.array_join("context_lines", "\n").alias("context"))


@query("w8_structural_checks", SCAN + f"SELECT {_HIT} FROM structural")
def w8(spark, sf):
    return _hits(spark, sf).filter(F.col("vuln_id").startswith("PY-AST")).select(*_HIT_COLUMNS)


@query("u2_all_findings", SCAN + f"SELECT source_order, {_HIT} FROM findings")
def u2(spark, sf):
    return _hits(spark, sf).select("source_order", *_HIT_COLUMNS)


@query("a12_distinct_findings", given("vulnerabilities") + """
SELECT scan_id, vuln_id, line_number, min(id) AS id FROM vulnerabilities
GROUP BY scan_id, vuln_id, line_number""")
def a12(spark, sf):
    keys = ["scan_id", "vuln_id", "line_number"]
    return scanning.distinct_findings(
        A.vulnerabilities(spark, sf), [F.col("id")], keys).select(*keys, "id")


@query("f21_static_to_analyzed", SCAN + """
SELECT file_path, vuln_id, line_number, raw_severity AS severity, description AS ai_explanation,
    'N/A' AS exploit_scenario, '' AS secure_code_snippet, 'MEDIUM' AS false_positive_likelihood,
    'Review the flagged line and apply secure coding best practices.' AS recommendation
FROM findings""")
def f21(spark, sf):
    return scanning.analyzed_of(_hits(spark, sf)).select(
        "file_path", "vuln_id", "line_number", "severity", "ai_explanation", "exploit_scenario",
        "secure_code_snippet", "false_positive_likelihood", "recommendation")


_USER_RULES = [
    Rule("USR-001", "python", "Personal Data", r"[a-z0-9._]+@[a-z0-9]+\.[a-z]+", "mail address",
         "CWE-359", "A01:2021 - Broken Access Control", "LOW", "Low"),
    Rule("USR-002", "python", "License", r"\blicen[sc]e\b", "license text",
         "CWE-1104", "A06:2021 - Vulnerable and Outdated Components", "LOW", "Low"),
]


@query("x1_user_rules", f"""
WITH {lines_sql('documents')}
SELECT doc_id, line_number, 'USR-001' AS vuln_id, trim(line, {WS}) AS line_content, 'Low' AS raw_severity
FROM lines WHERE regexp_matches(line, '{_USER_RULES[0].pattern}', 'i')
UNION ALL
SELECT doc_id, line_number, 'USR-002', trim(line, {WS}), 'Low'
FROM lines WHERE regexp_matches(line, '{_USER_RULES[1].pattern}', 'i')""")
def x1(spark, sf):
    files = spread(A.read(spark, sf, "documents"), "doc_id").select(
        "doc_id", F.col("doc_id").cast("string").alias("file_path"), "text",
        F.lit("python").alias("language"))
    rules = spark.createDataFrame(_USER_RULES, RULE_SCHEMA)
    return scanning.scan_with_rule_frame(files, rules, structural=False).select(
        "doc_id", "line_number", "vuln_id", "line_content", "raw_severity")


@query("f12_prompts", SCAN + f""", listed AS (
    SELECT file_path, to_json(list(struct_pack(id := vuln_id, line := line_number,
        content := line_content) ORDER BY source_order)) AS found FROM findings GROUP BY file_path)
SELECT s.file_path, CAST(COALESCE(l.found, '[]') AS VARCHAR) AS findings_json,
    sha256(CONCAT('Analyze this ', s.language, ' source code.', chr(10), 'SOURCE: ', s.file_path,
    chr(10), 'CODE: ', s.text, chr(10), 'FINDINGS: ', COALESCE(l.found, '[]'), chr(10), chr(10),
    'Return JSON strictly in this format:', chr(10), '{{', chr(10),
    '  "analyzed_vulnerabilities": [],', chr(10), '  "additional_findings": [],', chr(10),
    '  "overall_risk_score": 0,', chr(10), '  "overall_risk_level": "Low",', chr(10),
    '  "executive_summary": "",', chr(10), '  "top_priority_fixes": [],', chr(10),
    '  "secure_code": ""', chr(10), '}}')) AS prompt_sha
FROM source_files s LEFT JOIN listed l ON s.file_path = l.file_path""")
def f12(spark, sf):
    made = answers.prompts(scanning.scan_files(A.source_files(spark, sf)))
    return made.select("file_path", "findings_json", F.sha2("prompt", 256).alias("prompt_sha"))


@query("s1_read_source_tree", f"""
WITH {lines_sql('documents')}
SELECT source AS folder, count(*) AS lines, CAST(sum(length(line)) AS BIGINT) AS characters
FROM lines GROUP BY source""")
def s1(spark, sf):
    root = new_folder(spark, "tree")
    A.read(spark, sf, "documents").select("source", F.col("text").alias("value")).write.option(
        "maxRecordsPerFile", 1000).partitionBy("source").text(root)
    files = read_tree(spark, root, (".txt",))
    folder = F.regexp_extract("file_path", "source=([^/]*)", 1)
    lines = scanning.lines_of(files.withColumn("folder", folder))
    return lines.groupBy("folder").agg(
        F.count("*").alias("lines"), F.sum(F.length("line")).alias("characters"))


@query("s2_file_inventory", """
SELECT source AS folder, CAST(sum(strlen(text) + 1) AS BIGINT) AS bytes
FROM documents GROUP BY ROLLUP (source)""")
def s2(spark, sf):
    root = new_folder(spark, "inventory")
    A.read(spark, sf, "documents").select("source", F.col("text").alias("value")).write.partitionBy(
        "source").text(root)
    files = list_tree(spark, root).withColumn("folder", F.regexp_extract(
        "relative_path", r"^source=([^/]*)/part-[^/]*\.txt$", 1)).filter("folder <> ''")
    return files.rollup("folder").agg(F.sum("length").alias("bytes"))


@query("s2_flat_folder", """
WITH files AS (SELECT CAST(doc_id AS VARCHAR) || '.txt' AS relative_path,
    CAST(strlen(coalesce(text, '')) AS BIGINT) AS length FROM documents)
SELECT relative_path, length, 1 AS files FROM files
UNION ALL SELECT NULL, CAST(sum(length) AS BIGINT), count(*) FROM files""")
def s2_flat(spark, sf):
    """One folder with a file per document, listed in parts, and its total."""
    root = new_folder(spark, "flat")
    A.write_files(A.read(spark, sf, "documents").select(
        F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("file_path"), "text"), root)
    files = list_tree(spark, root, names_per_task=100)
    return files.select("relative_path", "length", F.lit(1).cast("bigint").alias("files")).unionByName(
        tree_total(files).select(
            F.lit(None).cast("string").alias("relative_path"), F.col("bytes").alias("length"), "files"))


_STORED = SCAN + f""",
per_file AS (
    SELECT s.file_path, s.language,
        COALESCE(sum(CASE raw_severity WHEN 'Critical' THEN 10 WHEN 'High' THEN 7
            WHEN 'Medium' THEN 4 WHEN 'Low' THEN 1 END), 0) AS raw,
        count(*) FILTER (WHERE raw_severity = 'Critical') AS critical
    FROM source_files s LEFT JOIN findings f ON s.file_path = f.file_path
    GROUP BY s.file_path, s.language),
scored AS (SELECT *, CAST(CASE WHEN raw = 0 THEN 0 ELSE least(100, greatest(
    floor(least(100.0, 20 * ln(1 + raw))),
    CASE WHEN critical > 0 THEN 60 + least(40, 5 * critical) ELSE 0 END)) END AS INT) AS score FROM per_file),
scans AS (SELECT sha256(CAST(to_json(['first', file_path, '2026-01-02 03:04:05']) AS VARCHAR)) AS id, file_path, language, score,
    CASE WHEN score >= 75 THEN 'Critical' WHEN score >= 50 THEN 'High' WHEN score >= 25 THEN 'Medium'
        ELSE 'Low' END AS level,
    CASE WHEN score >= 75 THEN 'Critical' WHEN score >= 50 THEN 'Vulnerable'
        WHEN score >= 25 THEN 'Warning' ELSE 'Safe' END AS lifecycle FROM scored)
SELECT 'scans' AS part, id AS scan_id, CONCAT_WS('|', file_path, language, 'upload', score, level,
    lifecycle, CONCAT('reports/security_report_', replace(split_part(file_path, '/', 2), '.', '_'),
    '_20260102_030405.html')) AS content FROM scans
UNION ALL
SELECT 'vulnerabilities', sha256(CAST(to_json(['first', file_path, '2026-01-02 03:04:05']) AS VARCHAR)),
    CONCAT_WS('|', sha256(CAST(to_json(['first', file_path, '2026-01-02 03:04:05', vuln_id,
        CAST(line_number AS VARCHAR)]) AS VARCHAR)),
    vuln_id, category, raw_severity, line_number, line_content, 'open') FROM findings
UNION ALL
SELECT 'score_history', id, CONCAT_WS('|', score, lifecycle, 'system', 'Initial scan') FROM scans
UNION ALL
SELECT 'audit_logs', id, CONCAT_WS('|', 'scan_created', 'system', 'user', score, lifecycle, level,
    CONCAT('Scan completed — score ', score, ' (', level, ')')) FROM scans"""


def _stored(spark, folder):
    content = {
        "scans": ["file_path", "language", "mode", "risk_score", "risk_level",
                  "lifecycle_status", "report_path"],
        "vulnerabilities": ["id", "vuln_id", "category", "severity", "line_number",
                            "line_content", "status"],
        "score_history": ["score", "lifecycle_status", "changed_by", "reason"],
        "audit_logs": ["action", "performed_by", "role", "new_score", "new_status",
                       "severity_level", "details"],
    }
    parts = None
    for name, columns in content.items():
        key = "id" if name == "scans" else "scan_id"
        rows = read_table(spark, folder, name).select(
            F.lit(name).alias("part"), F.col(key).alias("scan_id"),
            F.concat_ws("|", *[F.col(c).cast("string") for c in columns]).alias("content"))
        parts = rows if parts is None else parts.unionByName(rows)
    return parts


@query("s4_scan_and_store", _STORED)
def s4(spark, sf):
    folder = new_folder(spark, "store")
    scan_and_store(A.source_files(spark, sf), folder, "first", _at())
    return _stored(spark, folder)


@query("t3_scan_arriving_files", _STORED.replace("'first'", "'batch-0'"))
def t3(spark, sf):
    folder = new_folder(spark, "arriving")
    scan_arriving(A.with_plants(A.arriving(spark, sf, "documents"), "hit"), folder, f"{folder}/state", _at())
    return _stored(spark, folder)


_RUN = ("CASE WHEN CAST(regexp_extract(file_path, 'f([0-9]+)[.]', 1) AS BIGINT) % 2 = 0 "
        "THEN 'batch-0' ELSE 'batch-1' END")
_HEAD = f"substr(trim(text, {WS}), 1, {LANGUAGE_SNIFF_CHARS})"
_GROWING = _STORED.replace("'first'", _RUN).replace(
    f"({A.SQL['source_files']})", f"""(
    SELECT * REPLACE (regexp_replace(file_path, '/f', CASE WHEN doc_id % 3 = 0 THEN '/.f' ELSE '/f' END)
            AS file_path,
        CASE WHEN contains({_HEAD}, '#include') OR contains({_HEAD}, 'int main(') THEN 'cpp'
            WHEN contains({_HEAD}, 'const ') OR contains({_HEAD}, 'let ') THEN 'javascript'
            ELSE 'python' END AS language)
    FROM ({A.SQL['source_files']})
    WHERE suffix(file_path, '.py') OR suffix(file_path, '.js') OR suffix(file_path, '.cpp'))""", 1)


@query("t3_growing_tree", _GROWING)
def t3_tree(spark, sf):
    """A tree with hidden names that grows between two runs; languages told from the content."""
    folder, root = new_folder(spark, "scanned"), new_folder(spark, "growing")
    files = A.source_files(spark, sf).withColumn("file_path", F.when(
        F.col("doc_id") % 3 == 0, F.regexp_replace("file_path", "/f", "/.f")).otherwise(F.col("file_path")))
    for half in (0, 1):
        A.write_files(files.filter(F.col("doc_id") % 2 == half), root)
        scan_growing_tree(spark, root, folder, f"{folder}-state", _at(), lists_per_trigger=10_000)
    return _stored(spark, folder)


_SUPPORTED = "suffix(file_path, '.py') OR suffix(file_path, '.js') OR suffix(file_path, '.cpp')"


@query("s4_repositories_and_store", _STORED.split("scans AS (SELECT")[0] + f"""
tops AS (SELECT split_part(file_path, '/', 1) AS repo, max(score) AS score, count(*) AS files,
    arg_max(file_path, (score, file_path)) AS top_file FROM scored WHERE {_SUPPORTED} GROUP BY repo),
scans AS (SELECT *, sha256(CAST(to_json(['first', repo, '2026-01-02 03:04:05']) AS VARCHAR)) AS id,
    CASE WHEN score >= 75 THEN 'Critical' WHEN score >= 50 THEN 'High' WHEN score >= 25 THEN 'Medium'
        ELSE 'Low' END AS level,
    CASE WHEN score >= 75 THEN 'Critical' WHEN score >= 50 THEN 'Vulnerable'
        WHEN score >= 25 THEN 'Warning' ELSE 'Safe' END AS lifecycle FROM tops)
SELECT 'scans' AS part, id AS scan_id, CONCAT_WS('|', repo, 'multi', 'github', score, level,
    lifecycle, CONCAT('reports/security_report_', replace(split_part(top_file, '/', 2), '.', '_'),
    '_20260102_030405.html')) AS content FROM scans
UNION ALL
SELECT 'vulnerabilities', sha256(CAST(to_json(['first', repo, '2026-01-02 03:04:05']) AS VARCHAR)),
    CONCAT_WS('|', sha256(CAST(to_json(['first', repo, '2026-01-02 03:04:05', file_path, vuln_id,
        CAST(line_number AS VARCHAR)]) AS VARCHAR)),
    vuln_id, CONCAT('[', split_part(file_path, '/', 2), '] ', category), raw_severity, line_number,
    line_content, 'open') FROM findings WHERE {_SUPPORTED}
UNION ALL
SELECT 'score_history', id, CONCAT_WS('|', score, lifecycle, 'system', 'Initial repository scan') FROM scans
UNION ALL
SELECT 'audit_logs', id, CONCAT_WS('|', 'scan_created', 'system', 'user', score, lifecycle, level,
    CONCAT('Repository scan completed — ', files, ' files scanned. Risk score: ', score)) FROM scans""")
def s4_repositories(spark, sf):
    folder = new_folder(spark, "repositories")
    scan_repositories_and_store(A.source_files(spark, sf), folder, "first", _at())
    return _stored(spark, folder)


@query("s4_answered_scans", given("llm_responses") + """
, files AS (SELECT CONCAT('answers/f', file_id, '.py') AS file_path, raw LIKE '%{%' AS good,
    json_extract_string(NULLIF(regexp_extract(raw, '(?s)\\{.*\\}', 0), ''),
        '$.analyzed_vulnerabilities[0].category') AS category, file_id % 50 AS line FROM llm_responses),
scans AS (SELECT *, sha256(CAST(to_json(['first', file_path, '2026-01-02 03:04:05']) AS VARCHAR)) AS id,
    CASE WHEN good THEN 41 ELSE 0 END AS score, CASE WHEN good THEN 'Medium' ELSE 'Low' END AS level,
    CASE WHEN good THEN 'Warning' ELSE 'Safe' END AS lifecycle,
    CASE WHEN good THEN 'Audit finished.' ELSE 'Analysis Error: AI response contained no valid JSON block.' END
        AS summary FROM files)
SELECT 'scans' AS part, id AS scan_id, CONCAT_WS('|', file_path, 'python', 'upload', score, level, lifecycle,
    CONCAT('reports/security_report_', replace(split_part(file_path, '/', 2), '.', '_'),
    '_20260102_030405.html')) AS content FROM scans
UNION ALL SELECT 'summary', id, summary FROM scans
UNION ALL SELECT 'vulnerabilities', id, CONCAT_WS('|', sha256(CAST(to_json(['first', file_path,
    '2026-01-02 03:04:05', 'AI-VULN', CAST(line AS VARCHAR), '0']) AS VARCHAR)), 'AI-VULN', category, 'High',
    line, 'Review code', 'open') FROM scans WHERE good
UNION ALL SELECT 'score_history', id, CONCAT_WS('|', score, lifecycle, 'system', 'Initial scan') FROM scans
UNION ALL SELECT 'audit_logs', id, CONCAT_WS('|', 'scan_created', 'system', 'user', score, lifecycle, level,
    CONCAT('Scan completed — score ', score, ' (', level, ')')) FROM scans""")
def s4_answered(spark, sf):
    folder = new_folder(spark, "answered")
    answers = A.llm_responses(spark, sf).select(
        F.concat(F.lit("answers/f"), "file_id", F.lit(".py")).alias("file_path"),
        F.lit("python").alias("language"), "raw")
    store_answered_scans(answers, folder, "first", _at())
    summaries = read_table(spark, folder, "scans").select(
        F.lit("summary").alias("part"), F.col("id").alias("scan_id"),
        F.col("executive_summary").alias("content"))
    return _stored(spark, folder).unionByName(summaries)
