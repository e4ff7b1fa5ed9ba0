"""Source trees, stored tables, answers and arriving files."""

import json
import os
import shutil

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from checks import adapters as A
from checks.change_queries import _safe_scans, _starting
from seclake import schemas
from seclake.operators import answers, lifecycle, maintain
from seclake.plans import changes
from seclake.plans.file_scan import scan_and_store
from seclake.plans.logs import append_log
from seclake.sources import tables
from seclake.sources.bucketed import BucketedTable
from seclake.sources.tables import read_table
from seclake.sources.tree import list_tree, read_tree, tree_total
from seclake.streaming.arriving import scan_arriving, scan_growing_tree
from seclake.streaming.lifecycle import run_lifecycle_stream
from seclake.streaming.scores import run_live_scores
from seclake.streaming.state_table import StateTable

def at():
    return F.lit("2026-01-02 03:04:05").cast("timestamp_ntz")


@pytest.fixture
def tree(tmp_path):
    names = ["a.py", "b.js", "c.cpp", "d.txt", "E.PY", "pkg/__init__.py", "pkg/.hidden.py",
             ".git/x.py", "_build/y.js", "pkg/sub dir/a+b%20.py", "pkg/sub dir/é.py"]
    for name in names:
        path = tmp_path / "root" / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(f"# {name}\neval(x)\n".encode())
    return str(tmp_path / "root"), names


def test_tree(spark, tree):
    root, names = tree
    listed = list_tree(spark, root + "/")
    assert sorted(r.relative_path for r in listed.collect()) == sorted(names)
    total = tree_total(listed).first()
    assert total.files == len(names)
    assert total.bytes == sum(os.path.getsize(os.path.join(root, n)) for n in names)
    read = {r.file_path: r.text for r in read_tree(spark, "file://" + root).collect()}
    wanted = [n for n in names if n.endswith((".py", ".js", ".cpp"))]
    assert read == {n: f"# {n}\neval(x)\n" for n in wanted}


def test_empty_tree(spark, tmp_path):
    (tmp_path / "none").mkdir()
    assert read_tree(spark, str(tmp_path / "none")).count() == 0
    assert tree_total(list_tree(spark, str(tmp_path / "none"))).first().files == 0


def test_store_twice_keeps_one_copy(spark, tmp_path):
    files = spark.createDataFrame([("a.py", "eval(x)\nassert y"), ("b.py", "")], "file_path STRING, text STRING")
    for _ in range(2):
        scan_and_store(files, str(tmp_path), "one", at())
    stored = {
        n: tables.read_table(spark, str(tmp_path), n)
        for n in ("scans", "vulnerabilities", "score_history", "audit_logs")}
    assert {n: df.count() for n, df in stored.items()} == {
        "scans": 2, "vulnerabilities": 2, "score_history": 2, "audit_logs": 2}
    scans = {r.file_path: r for r in stored["scans"].collect()}
    assert scans["a.py"].risk_score == 65 and scans["a.py"].lifecycle_status == "Vulnerable"
    assert scans["b.py"].risk_score == 0 and scans["b.py"].lifecycle_status == "Safe"
    assert {r.scan_id for r in stored["vulnerabilities"].collect()} == {scans["a.py"].id}
    scan_and_store(files, str(tmp_path), "two", at())
    assert tables.read_table(spark, str(tmp_path), "scans").count() == 4
    assert tables.read_table(spark, str(tmp_path), "vulnerabilities").select("id").distinct().count() == 4


def test_stored_keys_fit_together(spark, tmp_path):
    """With the current time as the time, nothing is an orphan and no id comes twice."""
    from pyspark.sql import functions as F

    from seclake.operators.maintain import orphans, repeated_keys
    from seclake.plans.repo_scan import scan_repositories_and_store
    files = spark.createDataFrame(
        [("one", "main.py", "eval(x)", "python"), ("two", "main.py", "eval(x)", "python")],
        "repo STRING, file_path STRING, text STRING, language STRING")
    scan_repositories_and_store(files, str(tmp_path / "r"), "one", F.current_timestamp())
    scan_and_store(files.filter("repo = 'one'"), str(tmp_path / "f"), "a", F.current_timestamp())
    scan_and_store(files.filter("repo = 'two'"), str(tmp_path / "f"), "b", F.current_timestamp())
    for folder in ("r", "f"):
        stored = {n: tables.read_table(spark, str(tmp_path / folder), n)
                  for n in ("scans", "vulnerabilities", "score_history", "audit_logs")}
        for name, df in stored.items():
            assert df.count() == 2 and repeated_keys(df, "id").count() == 0
            if name != "scans":
                assert orphans(df, stored["scans"], "scan_id").count() == 0


CASES = {
    "none": "no braces at all",
    "broken": 'text {"analyzed_vulnerabilities": [} more',
    "prose": 'Sure! {"analyzed_vulnerabilities": [{"category": "X", "line_number": "12"}]} Bye.',
    "lines": '{\n"analyzed_vulnerabilities": [],\n"overall_risk_score": 7\n}',
    "objects": '{"top_priority_fixes": [{"a": 1}, "b"], "overall_risk_score": 51}',
    "two": '{"overall_risk_score": 1} and {"overall_risk_score": 2}',
    "quotes": "{'overall_risk_score': 1}",
    "badline": '{"analyzed_vulnerabilities": [{"line_number": "abc"}]}',
    "textitem": '{"analyzed_vulnerabilities": ["text"]}',
    "nolist": '{"analyzed_vulnerabilities": {"category": "X"}}',
    "hugeline": '{"analyzed_vulnerabilities": [{"line_number": 99999999999}]}',
    "nanline": '{"analyzed_vulnerabilities": [{"line_number": "NaN"}]}',
    "hugescore": '{"overall_risk_score": 1e12}',
    "full": json.dumps({"analyzed_vulnerabilities": [{
        "category": "C", "line_number": 3.7, "line_content": "c", "severity": "Low",
        "explanation": "e", "recommendation": "r"}], "overall_risk_level": "Medium",
        "executive_summary": "s", "secure_code": "x = 1"}),
}


def test_answers(spark):
    raw = spark.createDataFrame(list(CASES.items()), "name STRING, raw STRING")
    got = {r.name: r for r in answers.answers_with_defaults(raw).collect()}
    failed = {n for n, r in got.items() if r.analysis_failed}
    assert failed == {"none", "broken", "two", "quotes", "badline", "textitem", "nolist",
                      "hugeline", "nanline", "hugescore"}
    for name in failed:
        r = got[name]
        assert (r.findings, r.overall_risk_score, r.overall_risk_level) == ([], 50, "Warning")
        assert r.executive_summary.startswith("Analysis Error")
    prose = got["prose"]
    assert (prose.overall_risk_score, prose.overall_risk_level, prose.executive_summary) == (
        70, "High", "Audit finished.")
    f = prose.findings[0]
    assert (f.vuln_id, f.category, f.line_number, f.line_content, f.severity, f.confidence,
            f.false_positive_likelihood) == ("AI-VULN", "X", 12, "Review code", "High", "High", "Low")
    assert (got["lines"].overall_risk_score, got["lines"].overall_risk_level) == (7, "Low")
    assert got["objects"].top_priority_fixes == ['{"a":1}', "b"]
    assert got["objects"].overall_risk_level == "High"
    full = got["full"].findings[0]
    assert (full.line_number, full.severity, full.ai_explanation, full.recommendation) == (3, "Low", "e", "r")
    assert (got["full"].secure_code, got["full"].overall_risk_level) == ("x = 1", "Medium")
    assert answers.answer_findings(answers.answers_with_defaults(raw), "name").count() == 2


def test_answers_as_files(spark, tmp_path):
    for name, text in CASES.items():
        (tmp_path / f"{name}.txt").write_text(text)
    read = tables.read_answers(spark, str(tmp_path))
    assert sorted(r.raw for r in read.collect()) == sorted(CASES.values())


def _log(events, folder, parts=3):
    """The event table as several files, in time order."""
    rows = events.orderBy("ts", "event_id").collect()
    size = len(rows) // parts + 1
    for i in range(parts):
        part = events.sparkSession.createDataFrame(rows[i * size:(i + 1) * size], events.schema)
        part.coalesce(1).write.mode("append").parquet(f"{folder}/{i}")
    return [f"{folder}/{i}" for i in range(parts)]


def _same(a, b):
    columns = sorted(a.columns)
    assert a.select(columns).exceptAll(b.select(columns)).count() == 0 and a.count() == b.count() > 0


def _feed_in_turn(spark, paths, inbox, step):
    """Let one more file arrive before each run of the stream."""
    for path in paths:
        spark.read.parquet(path).coalesce(1).write.mode("append").parquet(inbox)
        step()


def _hot(rows, scan="1"):
    """Half of all rows belong to one scan."""
    return rows.withColumn("scan_id", F.when(F.col("id") % 2 == 0, scan).otherwise(F.col("scan_id")))


@pytest.mark.parametrize("limit", [5_000_000, 40])
def test_lifecycle_over_several_batches(spark, sf, tmp_path, limit):
    events = A.read(spark, sf, "events")
    inbox, folder = str(tmp_path / "in"), str(tmp_path / "work")
    requests = _hot(A.transition_requests(spark, sf))
    scans = _safe_scans(requests).filter("id <> '3'")

    def step():
        arriving = spark.readStream.schema(A.TABLES["events"]).parquet(inbox).selectExpr(
            *A._TRANSITION_REQUESTS)
        run_lifecycle_stream(_hot(arriving), scans, folder, limit)

    _feed_in_turn(spark, _log(events, str(tmp_path / "log")), inbox, step)
    _same(spark.read.parquet(f"{folder}/steps").drop("batch"), lifecycle.run_lifecycle(requests, scans))


@pytest.mark.parametrize("limit", [5_000_000, 40])
def test_live_scores_over_several_batches(spark, sf, tmp_path, limit):
    events = A.read(spark, sf, "events")
    inbox, folder = str(tmp_path / "in"), str(tmp_path / "work")
    changes = _hot(A.status_changes(spark, sf))
    found = _starting(changes).filter("vuln_id <> '5'")

    def step():
        arriving = spark.readStream.schema(A.TABLES["events"]).parquet(inbox).selectExpr(
            *A._STATUS_CHANGES)
        run_live_scores(_hot(arriving), found, folder, limit)

    _feed_in_turn(spark, _log(events, str(tmp_path / "log")), inbox, step)
    scores = spark.read.parquet(f"{folder}/scores").drop("batch")
    _same(scores, lifecycle.replay_status_changes(changes, found))
    assert scores.filter("vuln_id = '5'").count() == 0


def test_state_table_over_merges(spark, tmp_path):
    """Any micro-batch finds the rows as of its start, also when it is repeated after a merge."""
    first = spark.createDataFrame([(k, "start") for k in range(30)], "key long, value string")
    table = StateTable(spark, str(tmp_path), ["key"], first.schema, buckets=4, merge_every=3)
    table.start(first)
    table.start(first.limit(0))  # a stream that goes on keeps what it has
    now = {k: "start" for k in range(30)}
    for batch in range(8):
        asked = first.filter(F.col("key") % 5 == batch % 5).select("key")
        for _ in range(2):
            got = {r.key: r.value for r in table.rows_for(batch, asked).collect()}
            assert got == {k: v for k, v in now.items() if k % 5 == batch % 5}
            table.put(batch, asked.filter("key <> 7").withColumn("value", F.lit(f"b{batch}")))
        now.update({k: f"b{batch}" for k in now if k % 5 == batch % 5 and k != 7})
    names = sorted(p.name for p in tmp_path.iterdir())
    assert [n for n in names if n.startswith("whole")] == ["whole-3", "whole-6"]
    plan = table.rows_for(8, first.filter("key = 1"))._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan


def test_arriving_table_in_many_files(spark, tmp_path, sf):
    """A table that is a folder of files arrives like one that is a single file."""
    from checks.change_queries import t1
    from checks.scan_queries import s4, t3
    for name in ("documents", "events"):
        A.read(spark, sf, name).limit(40).repartition(3).write.parquet(str(tmp_path / f"{name}.parquet"))
    many = str(tmp_path)
    count = {r.part: r["count"] for r in t3(spark, many).groupBy("part").count().collect()}
    assert count == {r.part: r["count"] for r in s4(spark, many).groupBy("part").count().collect()}
    assert count["scans"] == 40
    assert t1(spark, many).select("audit_id").distinct().count() == 40


def test_arriving_files_once(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    for run in range(2):
        (inbox / f"f{run}.py").write_text("eval(x)\n")
        files = spark.readStream.schema("value STRING").option("wholetext", "true").text(
            str(inbox)).select(F.col("_metadata.file_name").alias("file_path"), F.col("value").alias("text"))
        scan_arriving(files, str(tmp_path / "out"), str(tmp_path / "state"), at())
    scans = tables.read_table(spark, str(tmp_path / "out"), "scans")
    assert sorted((r.file_path, r.language, r.risk_score) for r in scans.collect()) == [
        ("f0.py", "python", 65), ("f1.py", "python", 65)]


def test_large_flat_folder_is_listed_in_parts(spark, tmp_path):
    root = tmp_path / "flat"
    (root / "sub").mkdir(parents=True)
    for i in range(20_000):
        (root / f"{i}.py").write_bytes(b"x" * (i % 7))
    (root / "sub" / "_one.py").write_bytes(b"1234")
    files = list_tree(spark, str(root), names_per_task=1_000)
    got = {r.relative_path: r.length for r in files.collect()}
    assert got == {**{f"{i}.py": i % 7 for i in range(20_000)}, "sub/_one.py": 4}
    total = tree_total(files).first()
    assert (total.files, total.bytes) == (20_001, sum(got.values()))


def test_large_flat_folder_is_read_once(tmp_path, monkeypatch):
    """Each name of a folder is read once, however many parts the folder is dealt out in."""
    import pandas as pd

    from seclake.sources import tree
    for i in range(1_000):
        (tmp_path / f"{i}.py").write_bytes(b"")
    read, names = [], tree._names
    monkeypatch.setattr(tree, "_names", lambda folder: (read.append(n) or n for n in names(folder)))
    rows, files = pd.DataFrame([(str(tmp_path), 0, 1)], columns=["path", "part", "parts"]), []
    rows["names"] = None
    while len(rows):
        listed = pd.concat(list(tree._list_folders(30)(iter([rows]))))
        files += listed[~listed.is_folder].path.tolist()
        rows = listed[listed.is_folder]
    assert sorted(files) == sorted(str(tmp_path / f"{i}.py") for i in range(1_000))
    assert len(read) == 1_000


def test_tree_that_grows_and_changes(spark, tmp_path):
    root, out, state = tmp_path / "tree", str(tmp_path / "out"), str(tmp_path / "state")

    def put(name, text):
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)

    def step():
        scan_growing_tree(spark, str(root), out, state, at(), files_per_list=2, lists_per_trigger=1)
        return sorted((r.file_path, r.language, r.risk_score) for r in tables.read_table(
            spark, out, "scans").collect())

    put("a.py", "eval(x)\n")
    put(".hidden/_b.py", "eval(y)\n")
    put("c.txt", "eval(z)\n")
    first = [(".hidden/_b.py", "python", 65), ("a.py", "python", 65)]
    assert step() == first
    assert step() == first  # nothing new
    put("deep/er/d.js", "const a = 1;\n")
    for i in range(5):
        put(f"many/{i}.cpp", "#include <x>\n")
    put("a.py", "x = 1\n")  # a new version is a new scan
    more = first + [("a.py", "python", 0), ("deep/er/d.js", "javascript", 0)] + [
        (f"many/{i}.cpp", "cpp", 0) for i in range(5)]
    assert step() == sorted(more)
    batches = tables.read_table(spark, out, "scans").select("created_at").count()
    assert batches == len(more)
    lists = spark.read.parquet(f"{state}/lists")
    assert lists.count() == len(more)


def test_log_numbers(spark, tmp_path):
    """No gap, no id twice, the same ids after a repeated run and after a lost part."""
    folder = str(tmp_path)

    def rows(low, high):
        return spark.range(low, high).select(
            F.concat(F.lit("s"), F.col("id") % 3).alias("scan_id"), F.lit("scan_created").alias("action"),
            F.col("id").cast("string").alias("details"),
            F.timestamp_seconds(1000 - F.col("id")).cast("timestamp_ntz").alias("timestamp"))

    def add(low, high, run):
        append_log(maintain.audit_rows(rows(low, high)), folder, "audit_logs", run)

    def ids():
        return {(r.run, int(r.details)): r.id for r in read_table(spark, folder, "audit_logs").collect()}

    add(0, 100, "one"), add(200, 250, "two")
    got = ids()
    assert sorted(got.values()) == list(range(1, 151))
    assert [got["one", i] for i in (99, 0)] == [1, 100] and got["two", 249] == 101  # by time
    add(0, 100, "one")
    assert ids() == got
    shutil.rmtree(tmp_path / "audit_logs" / "run=two")
    add(300, 310, "three"), add(200, 250, "two")
    assert {k: v for k, v in ids().items() if k[0] != "three"} == got
    add(0, 90, "one")  # other rows take other numbers
    assert sorted(ids().values()) == list(range(101, 251))
    add(0, 0, "none"), add(400, 401, "four")
    assert ids()["four", 400] == 251


def test_deletes_go_on_with_the_numbers(spark):
    tables = {name: spark.createDataFrame([], schema) for name, schema in (
        ("scans", schemas.SCANS), ("vulnerabilities", schemas.VULNERABILITIES),
        ("score_history", schemas.SCORE_HISTORY))}
    tables["audit_logs"] = maintain.audit_rows(spark.createDataFrame(
        [("a", "x"), ("b", "y")], "scan_id string, action string").withColumn(
        "details", F.lit("d")).withColumn("timestamp", F.lit("2026-01-01").cast("timestamp_ntz"))
        ).withColumn("id", F.when(F.col("scan_id") == "a", 7).otherwise(8).cast("long"))
    ids = spark.createDataFrame([("a",), ("a",), ("c",)], "scan_id string")
    got = changes.delete_scans(tables, ids, "1", F.lit("2026-01-02").cast("timestamp_ntz"))["audit_logs"]
    assert sorted((r.id, r.scan_id, r.action) for r in got.collect()) == [
        (8, "b", "y"), (9, "a", "scan_deleted"), (10, "c", "scan_deleted")]


def test_untouched_buckets_keep_their_files(spark, tmp_path):
    schema = StructType([StructField(n, StringType()) for n in ("id", "owner", "state")])
    table = BucketedTable(spark, str(tmp_path), "owner", schema)
    rows = [(f"f{i}", f"o{i % 40}", "open") for i in range(400)] + [("x", None, "open")]
    table.create(spark.createDataFrame(rows, schema), buckets=16)

    def files():
        return {r[0] for r in table.rows().select(F.input_file_name()).distinct().collect()}

    def held():
        return {tuple(r) for r in table.rows().collect()}

    start = files()
    news = [("f3", "o3", "closed"), ("f43", "o3", None), ("nobody", "o3", "new"), ("f1", None, "no")]
    touched = table.merge(spark.createDataFrame(news, schema), "one", key="id")
    assert len(touched) == 1
    want = {("f3", "o3", "closed") if r[0] == "f3" else r for r in rows}
    assert held() == want
    kept = {f for f in start if f"/bucket={touched[0]}/" not in f}
    assert kept < start and kept < files() and len(files() - kept) >= 1
    # Done already; and a job that died before its manifest is run again.
    assert table.merge(spark.createDataFrame([("f3", "o3", "lost")], schema), "one", key="id") == []
    assert held() == want
    gone = spark.createDataFrame([("o5",), ("o5",), (None,), ("unknown",)], "owner string")
    table.delete(gone, "two")
    shutil.rmtree(tmp_path / "manifest" / "version=2")
    assert table.version() == 1 and held() == want
    table.delete(gone, "two")
    want = {r for r in want if r[1] != "o5"}
    assert held() == want and {tuple(r) for r in table.rows(0).collect()} == set(rows)
    everyone = spark.createDataFrame([(f"o{i}",) for i in range(40)], "owner string")
    table.delete(everyone, "three")
    assert held() == {("x", None, "open")}
    table.merge(spark.createDataFrame([("f3", "o3", "closed")], schema), "four", key="id")
    assert held() == {("x", None, "open")}


@pytest.mark.parametrize("sent", [1 << 20, 0])
def test_small_changes_go_to_the_rows(spark, tmp_path, monkeypatch, sent):
    """The rows of a bucketed table are not shuffled for a small change; large ones do the same."""
    from seclake.sources import bucketed
    monkeypatch.setattr(bucketed, "SENT_BYTES", sent, raising=False)
    schema = StructType([StructField(n, StringType()) for n in ("id", "owner", "state")])
    table = BucketedTable(spark, str(tmp_path), "owner", schema)
    rows = [(f"f{i}", f"o{i % 40}", "open") for i in range(400)] + [("x", None, "open")]
    table.create(spark.createDataFrame(rows, schema), buckets=16)
    plans, store = [], table._store

    def noted(version, made, *rest, **more):
        plans.append(made._jdf.queryExecution().toString())
        store(version, made, *rest, **more)

    monkeypatch.setattr(table, "_store", noted)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        table.delete(spark.createDataFrame([(f"o{i}",) for i in (1, 1, 2, 3, None)], "owner string"), "one")
        table.merge(spark.createDataFrame([("f4", "o4", "shut"), ("f5", None, "no")], schema), "two", key="id")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    kept = [r for r in rows if r[1] not in ("o1", "o2", "o3")]
    assert sorted(map(str, table.rows().collect())) == sorted(map(str, spark.createDataFrame(
        [("f4", "o4", "shut") if r[0] == "f4" else r for r in kept], schema).collect()))
    assert [("SortMergeJoin" in p, "BroadcastHashJoin" in p) for p in plans] == 2 * [(not sent, bool(sent))]


def test_empty_bucketed_table(spark, tmp_path):
    table = BucketedTable(spark, str(tmp_path), "id", schemas.SCANS)
    table.create(spark.createDataFrame([], schemas.SCANS), buckets=4)
    assert table.rows().count() == 0
    assert table.delete(spark.createDataFrame([("a",)], "id string"), "one") == []
    assert table.rows().schema == schemas.SCANS


def test_dashboard_of_parts_reads_only_new_ones(spark, sf, tmp_path):
    """Equal to the dashboard of the whole tables after appends, a replaced part, a part that
    goes and a part of no rows."""
    import shutil
    from checks import adapters as A
    from pyspark.sql import functions as F
    from seclake.plans.dashboard import dashboard
    from seclake.plans.stored_dashboard import kept_counts, stored_dashboard, stored_parts

    folder = str(tmp_path)
    scans, found = A.scans(spark, sf), A.vulnerabilities(spark, sf)
    odd = scans.limit(3).withColumn("lifecycle_status", F.lit(None).cast("string")).withColumn(
        "risk_score", F.lit(None).cast("int"))

    def check():
        got = stored_dashboard(spark, folder)
        want = dashboard(tables.read_table(spark, folder, "scans"),
                         tables.read_table(spark, folder, "vulnerabilities"))
        for name in want:
            assert got[name].columns == want[name].columns
            assert sorted(map(str, got[name].collect())) == sorted(map(str, want[name].collect())), name

    def counted(run):
        return {p.name: p.stat().st_mtime_ns for p in (tmp_path / "scans_by_status" / f"part=run%3D{run}").iterdir()}

    tables.append(scans.filter("id % 2 = 0"), folder, "scans", "one")
    tables.append(found.filter("severity = 'High'"), folder, "vulnerabilities", "one")
    check()
    first = counted("one")
    tables.append(scans.filter("id % 2 = 1").union(odd), folder, "scans", "a=b %")
    tables.append(found.filter("severity <> 'High'"), folder, "vulnerabilities", "01")
    tables.append(scans.limit(0), folder, "scans", "none")
    check()
    assert counted("one") == first
    tables.append(scans.filter("id % 4 = 1"), folder, "scans", "a=b %")
    _, new = kept_counts(spark, folder, "scans_by_status", stored_parts(spark, folder, "scans"))
    assert "run=a=b %" in new and "run=one" not in new
    check()
    shutil.rmtree(tmp_path / "scans" / "run=one")
    check()
    tables.append(scans.filter("id % 2 = 0"), folder, "scans", "one")
    check()
    assert counted("one") != first
