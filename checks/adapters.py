"""Logical tables made from the test tables.

The expressions are valid in Spark SQL and in DuckDB, so both sides of a check start
from the same rows. ``spark_*`` builds the DataFrame, ``SQL`` holds the query text.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from seclake.functions.texts import language_by_path
from seclake.session import spread

TABLES = {
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, "
                "c_mktsegment STRING",
    "part": "p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT, "
            "p_retailprice DOUBLE",
    "orders": "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE, "
              "o_orderdate TIMESTAMP_NTZ, o_orderpriority STRING",
    "lineitem": "l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, "
                "l_quantity DOUBLE, l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, "
                "l_returnflag STRING, l_linestatus STRING, l_shipdate TIMESTAMP_NTZ",
    "events": "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, "
              "value DOUBLE, props STRING",
    "documents": "doc_id BIGINT, text STRING, lang STRING, source STRING, n_chars BIGINT",
}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


_USERS = [
    "CAST(c_custkey AS STRING) AS id",
    "c_name AS username",
    "CONCAT('hash-', CAST(c_custkey AS STRING)) AS password_hash",
    "CASE WHEN c_custkey % 50 = 0 THEN 'admin' ELSE 'user' END AS role",
]

_SCORE = "CAST(CAST(floor(o_totalprice) AS BIGINT) % 101 AS INT)"
_SCANS = [
    "CAST(o_orderkey AS STRING) AS id",
    "CONCAT('repo', CAST(o_orderkey % 40 AS STRING), '/f', CAST(o_orderkey AS STRING), "
    "CASE o_orderkey % 5 WHEN 0 THEN '.py' WHEN 1 THEN '.js' WHEN 2 THEN '.cpp' "
    "WHEN 3 THEN '.TSX' ELSE '.txt' END) AS file_path",
    "CASE o_orderkey % 5 WHEN 0 THEN 'python' WHEN 1 THEN 'javascript' WHEN 2 THEN 'c' "
    "WHEN 3 THEN 'javascript' ELSE 'unknown' END AS language",
    "CASE o_orderstatus WHEN 'P' THEN 'paste' WHEN 'O' THEN 'upload' ELSE 'github' END AS mode",
    f"{_SCORE} AS risk_score",
    f"CASE WHEN {_SCORE} >= 75 THEN 'Critical' WHEN {_SCORE} >= 50 THEN 'High' "
    f"WHEN {_SCORE} >= 25 THEN 'Medium' ELSE 'Low' END AS risk_level",
    f"CASE WHEN {_SCORE} = 0 THEN 'Resolved' WHEN {_SCORE} >= 75 THEN 'Critical' "
    f"WHEN {_SCORE} >= 50 THEN 'Vulnerable' WHEN {_SCORE} >= 25 THEN 'Warning' "
    "ELSE 'Safe' END AS lifecycle_status",
    "o_orderdate AS created_at",
    "o_orderdate AS updated_at",
    "CAST(o_custkey AS STRING) AS user_id",
    "CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE CONCAT('reports', chr(92), 'r', "
    "CAST(o_orderkey AS STRING), '.html') END AS report_path",
    "o_orderpriority AS executive_summary",
]

_VULNERABILITIES = [
    "CONCAT_WS('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), "
    "CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING)) AS id",
    "CAST(l_orderkey AS STRING) AS scan_id",
    "p_brand AS vuln_id",
    "p_type AS category",
    "CASE WHEN l_quantity >= 46 THEN 'Critical' WHEN l_quantity >= 31 THEN 'High' "
    "WHEN l_quantity >= 11 THEN 'Medium' WHEN l_quantity >= 3 THEN 'Low' "
    "ELSE 'Info' END AS severity",
    "l_linenumber AS line_number",
    "p_name AS line_content",
    "CASE l_suppkey % 5 WHEN 0 THEN 'open' WHEN 1 THEN 'mitigated' WHEN 2 THEN 'resolved' "
    "WHEN 3 THEN 'fixed' ELSE 'accepted' END AS status",
    "CONCAT('CWE-', CAST(p_size AS STRING)) AS cwe_id",
    "CASE l_partkey % 4 WHEN 0 THEN 'A03:2021 - Injection' "
    "WHEN 1 THEN 'A02:2021 - Cryptographic Failures' "
    "WHEN 2 THEN 'A07:2021 - Identification and Authentication Failures' "
    "ELSE 'N/A' END AS owasp_category",
    "CONCAT('fix ', p_brand) AS recommendation",
    "CASE WHEN l_discount >= 0.08 THEN 'HIGH' WHEN l_discount >= 0.04 THEN 'MEDIUM' "
    "ELSE 'LOW' END AS false_positive_likelihood",
    "l_shipdate AS created_at",
]

_AUDIT_LOGS = [
    "event_id AS id",
    "CAST(event_id % 500 AS STRING) AS scan_id",
    "CASE event_type WHEN 'signup' THEN 'scan_created' WHEN 'view' THEN 'lifecycle_transition' "
    "WHEN 'click' THEN 'vulnerability_status_changed' "
    "WHEN 'purchase' THEN 'manual_score_override' ELSE 'scan_deleted' END AS action",
    "CASE WHEN event_id % 97 = 0 THEN 'system' ELSE CAST(user_id AS STRING) END AS performed_by",
    "ts AS timestamp",
]

_SCORE_HISTORY = [
    "event_id AS id",
    "CAST(user_id AS STRING) AS scan_id",
    "CAST(CAST(floor(value) AS BIGINT) % 101 AS INT) AS score",
    "CASE WHEN event_id % 11 = 0 THEN NULL "
    "ELSE CASE WHEN floor(value) % 101 >= 75 THEN 'Critical' "
    "WHEN floor(value) % 101 >= 50 THEN 'Vulnerable' "
    "WHEN floor(value) % 101 >= 25 THEN 'Warning' ELSE 'Safe' END END AS lifecycle_status",
    "CASE WHEN event_id % 13 = 0 THEN NULL ELSE event_type END AS reason",
    "ts AS timestamp",
]

_TRANSITION_REQUESTS = [
    "event_id AS id",
    "CAST(user_id AS STRING) AS scan_id",
    "CASE event_id % 9 WHEN 0 THEN 'Safe' WHEN 1 THEN 'Warning' WHEN 2 THEN 'Vulnerable' "
    "WHEN 3 THEN 'Critical' WHEN 4 THEN 'Warning' WHEN 5 THEN 'Vulnerable' "
    "WHEN 6 THEN 'Safe' WHEN 7 THEN 'Critical' "
    "ELSE CASE WHEN event_id % 45 = 8 THEN 'Resolved' ELSE 'Bogus' END END AS target",
    "ts AS timestamp",
]

_STATUS_CHANGES = [
    "event_id AS id",
    "CAST(user_id % 40 AS STRING) AS vuln_id",
    "CAST(user_id % 8 AS STRING) AS scan_id",
    "CASE user_id % 40 % 5 WHEN 0 THEN 'Critical' WHEN 1 THEN 'High' WHEN 2 THEN 'Medium' "
    "WHEN 3 THEN 'Low' ELSE 'Info' END AS severity",
    "CASE event_id % 5 WHEN 0 THEN 'open' WHEN 1 THEN 'mitigated' WHEN 2 THEN 'resolved' "
    "WHEN 3 THEN 'fixed' ELSE 'accepted' END AS status",
    "ts AS timestamp",
]

_LLM_RESPONSES = [
    "event_id AS file_id",
    "CASE WHEN event_id % 7 = 0 THEN 'sorry, no analysis' "
    "ELSE CONCAT('Here: {\"analyzed_vulnerabilities\": [{\"category\": \"', event_type, "
    "'\", \"line_number\": ', CAST(event_id % 50 AS STRING), "
    "'}], \"overall_risk_level\": \"High\"} done') END AS raw",
]

# k, extension, rule, hit, miss
PLANTS = [
    (0, ".py", "SQL-001", 'cursor.execute("SELECT * FROM t WHERE id = %s" % x)', "cursor.execute(query)"),
    (1, ".py", "SQL-002", 'cursor.execute(f"SELECT {x}")', "cursor.execute(q, (x,))"),
    (2, ".py", "CMD-001", 'os.system("echo " + name)', 'os.system("ls")'),
    (3, ".py", "CMD-002", "y = eval (user)", "y = evaluate(user)"),
    (4, ".py", "SEC-001", 'DB_PASSWORD = "hunter22"', 'password = "abc"'),
    (5, ".py", "CRYPTO-001", "d = md5(b)", "d = sha256(b)"),
    (6, ".py", "CRYPTO-002", "d = hashlib.sha1(b)", "d = hashlib.sha256(b)"),
    (7, ".py", "DESER-001", "o = pickle.loads(b)", "o = json.loads(b)"),
    (8, ".py", "DESER-002", "c = yaml.load(f)", "c = yaml.load(f, Loader=L)"),
    (9, ".py", "PATH-001", 'open(request.args["p"])', "open(path)"),
    (10, ".py", "XSS-001", "render_template_string(t, q=request.args)", "render_template_string(t)"),
    (11, ".py", "RAND-001", "n = random.randint(1, 9)", "n = secrets.randbelow(9)"),
    (12, ".py", "DBG-001", "app.run(debug=True)", "app.run(debug=False)"),
    (13, ".py", "SSRF-001", 'requests.get(request.args["u"])', "requests.get(URL)"),
    (14, ".py", "XXE-001", "t = etree.parse(f)", "t = tree.walk(f)"),
    (15, ".js", "JS-SQL-001", "db.query(`SELECT ${id}`)", 'db.query("SELECT 1")'),
    (16, ".js", "JS-XSS-001", "el.innerHTML = s", "el.textContent = s"),
    (17, ".js", "JS-EVAL-001", "eval(s)", "medieval(s)"),
    (18, ".js", "JS-SEC-001", 'apiKey: "abcd1234"', "apiKey: process.env.K"),
    (19, ".js", "JS-PROTO-001", "o.__proto__.x = 1", "o.proto.x = 1"),
    (20, ".php", "PHP-SQL-001", 'mysql_query("SELECT " . $_GET["q"]);', "mysql_query($sql);"),
    (21, ".php", "PHP-XSS-001", 'echo $_GET["q"];', "echo htmlspecialchars($q);"),
    (22, ".php", "PHP-CMD-001", 'shell_exec("ls " . $_POST["d"]);', 'shell_exec("ls");'),
    (23, ".java", "JAVA-SQL-001", 'em.createQuery("FROM U WHERE n=" + n);', 'em.createQuery("FROM U");'),
    (24, ".java", "JAVA-XXE-001", "DocumentBuilderFactory.newInstance();", "SAXParserFactory.newInstance();"),
    (25, ".java", "JAVA-DESER-001", "new ObjectInputStream(in);", "new DataInputStream(in);"),
    (26, ".py", "PY-AST-001", "if ok:\n    assert user.is_admin", "assertion = 1"),
    (27, ".py", "PY-AST-002", "try:\n    f()\nexcept:\n    pass",
     "try:\n    f()\nexcept Exception:\n    pass"),
]


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_PLANT_ROWS = ", ".join(
    f"({k}, {_quote(ext)}, {_quote(hit)}, {_quote(miss)})" for k, ext, _, hit, miss in PLANTS)


def _file_sql(line: str, missing: str) -> str:
    return (
        "SELECT d.doc_id, d.source AS repo, "
        "CONCAT(d.source, '/f', CAST(d.doc_id AS STRING), COALESCE(p.ext, '.txt')) AS file_path, "
        f"CASE WHEN p.k IS NULL THEN d.text ELSE CONCAT(d.text, chr(10), {line}) END AS text, "
        "CASE COALESCE(p.ext, '.txt') WHEN '.py' THEN 'python' WHEN '.js' THEN 'javascript' "
        "WHEN '.php' THEN 'php' WHEN '.java' THEN 'java' ELSE 'unknown' END AS language "
        f"FROM documents d LEFT JOIN (VALUES {_PLANT_ROWS}) AS p(k, ext, hit, miss) "
        "ON d.doc_id % 40 = p.k" + missing)


SQL = {
    "users": f"SELECT {', '.join(_USERS)} FROM customer",
    "scans": f"SELECT {', '.join(_SCANS)} FROM orders",
    "vulnerabilities":
        f"SELECT {', '.join(_VULNERABILITIES)} FROM lineitem JOIN part ON l_partkey = p_partkey",
    "audit_logs": f"SELECT {', '.join(_AUDIT_LOGS)} FROM events",
    "score_history": f"SELECT {', '.join(_SCORE_HISTORY)} FROM events",
    "transition_requests": f"SELECT {', '.join(_TRANSITION_REQUESTS)} FROM events",
    "status_changes": f"SELECT {', '.join(_STATUS_CHANGES)} FROM events",
    "llm_responses": f"SELECT {', '.join(_LLM_RESPONSES)} FROM events",
    "source_files": _file_sql("p.hit", ""),
    "secure_files": _file_sql("p.miss", ""),
}


def users(spark, sf):
    return read(spark, sf, "customer").selectExpr(*_USERS)


def scans(spark, sf):
    return read(spark, sf, "orders").selectExpr(*_SCANS)


def vulnerabilities(spark, sf):
    lines = spread(read(spark, sf, "lineitem"), "l_orderkey")
    parts = read(spark, sf, "part")
    return lines.join(parts, lines.l_partkey == parts.p_partkey).selectExpr(*_VULNERABILITIES)


def audit_logs(spark, sf):
    return read(spark, sf, "events").selectExpr(*_AUDIT_LOGS)


def score_history(spark, sf):
    return read(spark, sf, "events").selectExpr(*_SCORE_HISTORY)


def transition_requests(spark, sf):
    return read(spark, sf, "events").selectExpr(*_TRANSITION_REQUESTS)


def status_changes(spark, sf):
    return read(spark, sf, "events").selectExpr(*_STATUS_CHANGES)


def llm_responses(spark, sf):
    return read(spark, sf, "events").selectExpr(*_LLM_RESPONSES)


def arriving(spark, sf, name: str, **options: str) -> DataFrame:
    """A test table as a stream of files, whether it is one file or a folder of them.

    A pattern names it: Spark takes a plain path of a stream to be a folder, and a filter of
    names would be held against the files in the folder too.
    """
    return spark.readStream.schema(TABLES[name]).options(**options).parquet(
        f"{sf}/{name}[.]parquet")


def stream(spark, sf, name: str, exprs: list[str]) -> DataFrame:
    """A test table as a stream of arriving files; a trigger takes a bounded amount."""
    return arriving(spark, sf, name, maxBytesPerTrigger=str(8 << 30)).selectExpr(*exprs)


def with_plants(documents: DataFrame, column: str) -> DataFrame:
    """Documents as source files, each with its planted line (28 fixed plants)."""
    spark = documents.sparkSession
    plants = spark.createDataFrame(
        [(k, ext, hit, miss) for k, ext, _, hit, miss in PLANTS],
        "k INT, ext STRING, hit STRING, miss STRING")
    joined = documents.join(
        F.broadcast(plants), F.col("doc_id") % 40 == F.col("k"), "left")
    ext = F.coalesce("ext", F.lit(".txt"))
    return joined.select(
        "doc_id",
        F.col("source").alias("repo"),
        F.concat("source", F.lit("/f"), F.col("doc_id").cast("string"), ext).alias("file_path"),
        F.when(F.col("k").isNull(), F.col("text"))
        .otherwise(F.concat("text", F.lit("\n"), column)).alias("text"),
    ).withColumn("language", language_by_path(F.col("file_path")))


def source_files(spark, sf):
    return with_plants(spread(read(spark, sf, "documents"), "doc_id"), "hit")


def secure_files(spark, sf):
    return with_plants(spread(read(spark, sf, "documents"), "doc_id"), "miss")


def write_files(files: DataFrame, root: str) -> None:
    """Write each text to its path below root, by tasks."""
    def run(batches):
        from pyarrow import fs
        for batch in batches:
            for path, text in zip(batch["file_path"], batch["text"]):
                system, inside = fs.FileSystem.from_uri(f"{root}/{path}")
                system.create_dir(os.path.dirname(inside))
                with system.open_output_stream(inside) as out:
                    out.write((text or "").encode())
            yield batch[["file_path"]].iloc[:0]

    files.select("file_path", "text").mapInPandas(run, "file_path STRING").count()
