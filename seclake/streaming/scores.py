"""Live scores after finding-status changes (T4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seclake.operators.lifecycle import open_totals, replay_from
from seclake.operators.ordered import ROWS_PER_PIECE
from seclake.session import spread
from seclake.streaming.feed import finish
from seclake.streaming.state_table import StateTable


def run_live_scores(
    changes: DataFrame, findings: DataFrame, folder: str, limit: int = ROWS_PER_PIECE,
    timeout: int = 3600,
) -> DataFrame:
    """Score and lifecycle of the scan after each arriving status change; all of them so far.

    ``findings`` (vuln_id, scan_id, severity, status) is read once, when the stream first
    starts. Two tables go from micro-batch to micro-batch: the last status of each finding and
    two sums per scan; a micro-batch reads the buckets its keys lie in. It is one run
    of the batch operator, so a scan with more than ``limit`` of its changes is cut into
    pieces and no worker holds more than a piece. The source's own options bound a
    micro-batch. Changes must arrive in time order from one micro-batch to the next; inside one
    they may come in any order. A change of an unknown finding is left out. A repeated
    micro-batch replaces its own part.
    """
    spark = changes.sparkSession
    first = findings.select("scan_id", "vuln_id", "status")
    statuses = StateTable(spark, f"{folder}/statuses", ["scan_id", "vuln_id"], first.schema)
    statuses.start(first)
    sums = open_totals(findings)
    totals = StateTable(spark, f"{folder}/totals", ["scan_id"], sums.schema)
    totals.start(sums)

    def step(batch: DataFrame, batch_id: int) -> None:
        new = spread(batch).persist()
        out = f"{folder}/scores/batch={batch_id}"
        replay_from(new, statuses.rows_for(batch_id, new), totals.rows_for(batch_id, new),
                    limit).write.mode("overwrite").parquet(out)
        done = spark.read.parquet(out)
        at = F.struct("timestamp", "id")
        statuses.put(batch_id, done.groupBy("scan_id", "vuln_id").agg(
            F.max_by("status", at).alias("status")))
        totals.put(batch_id, done.groupBy("scan_id").agg(F.max_by(F.struct(
            F.col("open_weight").alias("start_weight"), F.col("open_critical").alias("start_critical")),
            at).alias("last")).select("scan_id", "last.*"))
        new.unpersist()

    finish(changes.writeStream.foreachBatch(step).option(
        "checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start(), timeout)
    return spark.read.parquet(f"{folder}/scores").drop("batch")
