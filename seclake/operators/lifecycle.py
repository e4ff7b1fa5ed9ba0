"""Lifecycle of scans: changes, replay of finding statuses, and the state machine."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from seclake.fixed_values import (
    ALLOWED_MOVES,
    CLOSED_STATUSES,
    LIFECYCLE,
    MOVE_REJECTED,
    SCAN_MISSING,
)
from seclake.functions.scores import (
    is_open,
    lifecycle_at_override,
    lifecycle_of_open,
    open_weight,
    score_of,
)
from seclake.operators.ordered import ROWS_PER_PIECE, any_large_group, previous, running_sums
from seclake.session import cut

TIME_ORDER = ["timestamp", "id"]


def score_changes(history: DataFrame, limit: int = ROWS_PER_PIECE) -> DataFrame:
    """Old and new score and status of each history row, per scan in time order."""
    with_old = previous(
        history, ["scan_id"], TIME_ORDER,
        {"old_score": "score", "old_status": "lifecycle_status"}, limit)
    return with_old.withColumn("new_score", F.col("score")).withColumn(
        "new_status", F.col("lifecycle_status"))


def status_deltas(changes: DataFrame, old_status: Column) -> DataFrame:
    """What each status change adds to its scan's open weight and critical count."""
    now, before = is_open(F.col("status")).cast("int"), is_open(old_status).cast("int")
    step = (now - before).cast("bigint")
    return changes.withColumn("weight_change", step * open_weight(F.col("severity"))).withColumn(
        "critical_change", F.when(F.col("severity") == "Critical", step).otherwise(F.lit(0)))


def open_totals(findings: DataFrame) -> DataFrame:
    """Open weight and open critical count per scan before any change."""
    return findings.filter(is_open(F.col("status"))).groupBy("scan_id").agg(
        F.sum(open_weight(F.col("severity"))).cast("bigint").alias("start_weight"),
        F.count_if(F.col("severity") == "Critical").alias("start_critical"))


def scored(changes: DataFrame) -> DataFrame:
    """Score and lifecycle from the open weight and critical count of a row."""
    return changes.withColumn(
        "score", score_of(F.col("open_weight"), F.col("open_critical"))
    ).withColumn("lifecycle_status", lifecycle_of_open(F.col("score")))


def replay_status_changes(
    changes: DataFrame, findings: DataFrame, limit: int = ROWS_PER_PIECE
) -> DataFrame:
    """Score and lifecycle of the scan after every finding-status change.

    ``changes`` has id, vuln_id, scan_id, severity, status, timestamp; ``findings`` has
    vuln_id, scan_id, severity, status as they were before the first change. The findings
    go in as rows that sort before all changes, so no join is needed. A change of an
    unknown finding is left out.
    """
    columns = ["id", "vuln_id", "scan_id", "severity", "status", "timestamp"]
    start = findings.select(
        F.lit(None).cast("bigint").alias("id"), "vuln_id", "scan_id", "severity", "status",
        F.lit(None).cast("timestamp_ntz").alias("timestamp"), F.lit(0).alias("kind"))
    rows = changes.select(*columns, F.lit(1).alias("kind")).unionByName(start)
    order = ["kind", *TIME_ORDER]
    if not any_large_group(rows, ["scan_id"], limit):
        # One shuffle by scan serves both windows below.
        rows, limit = rows.repartition("scan_id"), None
    finding = ["scan_id", "vuln_id"]
    with_old = previous(rows, finding, order, {"old_status": "status"}, limit, rows)
    # A finding is known once its starting row has been seen; that row sorts first.
    marked = running_sums(
        with_old.withColumn("_start", 1 - F.col("kind")), finding, [F.col(c) for c in order],
        {"_known": "_start"}, limit, rows)
    known = marked.filter("_known > 0").drop("_start", "_known")
    # A starting row adds what is open at the start; before it nothing was.
    before = F.when(F.col("kind") == 0, F.lit(CLOSED_STATUSES[0])).otherwise(F.col("old_status"))
    summed = running_sums(
        status_deltas(known, before), ["scan_id"], [F.col(c) for c in order],
        {"open_weight": "weight_change", "open_critical": "critical_change"}, limit, rows)
    return scored(summed.filter("kind = 1").select(
        *columns, "old_status", "open_weight", "open_critical"))


def replay_from(
    changes: DataFrame, statuses: DataFrame, totals: DataFrame, limit: int = ROWS_PER_PIECE
) -> DataFrame:
    """The same as ``replay_status_changes``, going on from an earlier replay.

    ``statuses`` (scan_id, vuln_id, status) has the last status of each known finding, ``totals``
    (scan_id, start_weight, start_critical) what was open in each scan; a scan without a row had nothing
    open. Both go in as rows that sort before all changes.
    """
    columns = ["id", "vuln_id", "scan_id", "severity", "status", "timestamp"]
    order = ["kind", *TIME_ORDER]
    by = [F.col(c) for c in order]
    rows = changes.select(*columns, F.lit(1).alias("kind"), F.lit(0).alias("_start")).unionByName(
        statuses.select("scan_id", "vuln_id", "status", F.lit(0).alias("kind"), F.lit(1).alias("_start")),
        allowMissingColumns=True)
    finding = ["scan_id", "vuln_id"]
    with_old = previous(rows, finding, order, {"old_status": "status"}, limit)
    known = running_sums(with_old, finding, by, {"_known": "_start"}, limit).filter(
        "kind = 1 AND _known > 0").drop("_start", "_known")
    summed = running_sums(
        status_deltas(known, F.col("old_status")).unionByName(totals.select(
            "scan_id", F.col("start_weight").alias("weight_change"),
            F.col("start_critical").alias("critical_change"), F.lit(0).alias("kind")),
            allowMissingColumns=True),
        ["scan_id"], by, {"open_weight": "weight_change", "open_critical": "critical_change"}, limit)
    return scored(summed.filter("kind = 1").select(
        *columns, "old_status", "open_weight", "open_critical"))


def score_overrides(scans: DataFrame, overrides: DataFrame) -> DataFrame:
    """Manual scores: old and new score and status by the override rule.

    ``overrides`` has id, scan_id, score, timestamp. They build on each other in order of time
    and id: what the scan had counts for the first of a scan only.
    """
    asked = overrides.select(
        "id", "scan_id", F.col("score").alias("new_score"),
        lifecycle_at_override(F.col("score")).alias("new_status"), "timestamp")
    chained = previous(asked, ["scan_id"], ["timestamp", "id"],
                       {"_score": "new_score", "_status": "new_status"}).withColumn(
        "_first", F.col("_status").isNull())
    had = scans.select(F.col("id").alias("_scan"), "risk_score", "lifecycle_status")
    return chained.join(had, F.col("scan_id") == F.col("_scan")).select(
        "id", "scan_id",
        F.when(F.col("_first"), F.col("risk_score")).otherwise(F.col("_score")).alias("old_score"),
        "new_score",
        F.when(F.col("_first"), F.col("lifecycle_status")).otherwise(F.col("_status")).alias(
            "old_status"), "new_status", "timestamp")


# ---- the state machine (T2) --------------------------------------------------------

STEP_SCHEMA = (
    "id BIGINT, scan_id STRING, target STRING, timestamp TIMESTAMP_NTZ, accepted BOOLEAN, "
    "old_status STRING, new_status STRING, old_score INT, new_score INT, reason STRING")
_EDGE_SCHEMA = (
    "part INT, first_scan STRING, goes_on BOOLEAN, ends MAP<STRING,STRING>, "
    "last_scan STRING, last_status STRING, last_score INT")


def move(status, score, target):
    """One request against one state: accepted?, status and score after it."""
    if target in ALLOWED_MOVES.get(status, ()):
        return True, target, 0 if target == "Resolved" else score
    return False, status, score


def refusal(scan_id, status, target) -> str:
    return SCAN_MISSING % scan_id if status is None else MOVE_REJECTED % (status, target)


def steps_frame(requests: pd.DataFrame, outcomes: list[tuple]) -> pd.DataFrame:
    """Requests with their outcomes (accepted, old and new status, old and new score, reason)."""
    names = ["accepted", "old_status", "new_status", "old_score", "new_score", "reason"]
    columns = list(zip(*outcomes)) if outcomes else [[]] * len(names)
    frame = requests[["id", "scan_id", "target", "timestamp"]].reset_index(drop=True)
    for name, values in zip(names, columns):
        kind = "Int32" if name.endswith("score") else "boolean" if name == "accepted" else "object"
        frame[name] = pd.array(values, dtype=kind) if kind != "object" else pd.Series(
            list(values), dtype="object")
    return frame


def apply_requests(scan_ids, targets, status, score, scan=None, starts=None):
    """Outcomes of requests in order. ``starts`` marks rows that set the state of a scan.

    Returns the outcomes and the scan, status and score at the end.
    """
    outcomes = []
    for at, (scan_id, target) in enumerate(zip(scan_ids, targets)):
        if scan_id != scan:
            scan, status, score = scan_id, None, None
        if starts is not None and starts[at] is not None:
            status, score = starts[at]
            continue
        accepted, new_status, new_score = move(status, score, target)
        reason = None if accepted else refusal(scan_id, status, target)
        outcomes.append((accepted, status, new_status, score, new_score, reason))
        status, score = new_status, new_score
    return outcomes, (scan, status, score)


def _starts(batch: pd.DataFrame) -> list:
    scores = [None if pd.isna(s) else int(s) for s in batch["start_score"]]
    return [
        (status, score) if kind == 0 else None
        for kind, status, score in zip(batch["kind"], batch["start_status"], scores)]


def _walker(carried: dict[int, tuple]):
    """Outcomes for a sorted partition; only the current scan's state is kept."""
    def walk(batches: Iterator[pd.DataFrame]):
        state = None
        for batch in batches:
            if batch.empty:
                continue
            if state is None:
                state = carried.get(int(batch["part"].iloc[0]), (None, None, None))
            scan, status, score = state
            outcomes, state = apply_requests(
                batch["scan_id"].tolist(), batch["target"].tolist(), status, score, scan,
                _starts(batch))
            yield steps_frame(batch[batch["kind"] == 1], outcomes)
    return walk


def _edges(batches: Iterator[pd.DataFrame]):
    """One row per partition: how its first scan maps states, and the state it ends in.

    The first scan may go on from the partition before, so every start is tried for it.
    """
    part, first_scan, goes_on, ends, state = None, None, False, {}, (None, None, None)
    for batch in batches:
        if batch.empty:
            continue
        scan_ids, targets = batch["scan_id"].tolist(), batch["target"].tolist()
        starts = _starts(batch)
        if part is None:
            part, first_scan = int(batch["part"].iloc[0]), scan_ids[0]
            goes_on = starts[0] is None
            ends = {s: s for s in LIFECYCLE} if goes_on else {}
        if goes_on:
            own = [t for s, t in zip(scan_ids, targets) if s == first_scan]
            for start, now in ends.items():
                ends[start] = apply_requests(
                    [first_scan] * len(own), own, now, 0, first_scan)[1][1]
        scan, status, score = state
        state = apply_requests(scan_ids, targets, status, score, scan, starts)[1]
    if part is not None:
        yield pd.DataFrame([{
            "part": part, "first_scan": first_scan, "goes_on": goes_on, "ends": ends,
            "last_scan": state[0], "last_status": state[1], "last_score": state[2]}])


def _carry_over(edges: list) -> dict[int, tuple]:
    """State at the start of each partition whose first scan began before it."""
    carried: dict[int, tuple] = {}
    state = (None, None, None)
    for edge in edges:
        known = edge.goes_on and state[0] == edge.first_scan
        if known:
            carried[edge.part] = state
        if known and edge.last_scan == edge.first_scan:
            _, status, score = state
            ended = edge.ends.get(status, status)
            moved_to_end = ended == "Resolved" and status != "Resolved"
            state = (edge.last_scan, ended, 0 if moved_to_end else score)
        else:
            state = (edge.last_scan, edge.last_status, edge.last_score)
    return carried


def run_lifecycle(
    requests: DataFrame, scans: DataFrame, limit: int = ROWS_PER_PIECE
) -> DataFrame:
    """Accept or reject every transition request, per scan in time order (T2, batch).

    A request counts only against the state left by earlier accepted ones. The scans
    (id, lifecycle_status, risk_score) go in as rows that sort before the requests, so one
    shuffle brings everything together. Partitions are sorted and streamed: a task holds
    one batch and one state. When some scan has more than ``limit`` requests, rows are
    range-partitioned, so that the scan spreads over many tasks: a first pass finds how
    each partition maps states, a second replays it from the right start.
    """
    no_text, no_number = F.lit(None).cast("string"), F.lit(None).cast("int")
    asked = requests.select(
        "id", "scan_id", "target", "timestamp", F.lit(1).alias("kind"),
        no_text.alias("start_status"), no_number.alias("start_score"))
    start = scans.select(
        # Not null: pandas would turn the whole id column into floating point.
        F.lit(0).cast("bigint").alias("id"), F.col("id").alias("scan_id"),
        no_text.alias("target"), F.lit(None).cast("timestamp_ntz").alias("timestamp"),
        F.lit(0).alias("kind"), F.col("lifecycle_status").alias("start_status"),
        F.col("risk_score").cast("int").alias("start_score"))
    rows = asked.unionByName(start)
    by = ["scan_id", "kind", *TIME_ORDER]
    if not any_large_group(requests, ["scan_id"], limit):
        together = rows.repartition("scan_id").sortWithinPartitions(*by)
        return together.withColumn("part", F.lit(0)).mapInPandas(_walker({}), STEP_SCHEMA)
    ranged = cut(
        rows.repartitionByRange(*by).sortWithinPartitions(*by)
        .withColumn("part", F.spark_partition_id()))
    edges = sorted(ranged.mapInPandas(_edges, _EDGE_SCHEMA).collect(), key=lambda e: e.part)
    return ranged.mapInPandas(_walker(_carry_over(edges)), STEP_SCHEMA)
