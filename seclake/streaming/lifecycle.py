"""Lifecycle state machine of arriving requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seclake.operators.lifecycle import run_lifecycle
from seclake.operators.ordered import ROWS_PER_PIECE
from seclake.session import spread
from seclake.streaming.feed import finish
from seclake.streaming.state_table import StateTable


def run_lifecycle_stream(
    requests: DataFrame, scans: DataFrame, folder: str, limit: int = ROWS_PER_PIECE,
    timeout: int = 3600,
) -> DataFrame:
    """Accept or reject each arriving transition request; all outcomes so far.

    ``scans`` (id, lifecycle_status, risk_score) is read once, when the stream first starts:
    later micro-batches find the states of their scans in a small table by scan. A micro-batch
    is one run of the batch operator, so a scan with more than ``limit`` of its requests
    spreads over many tasks, each of which maps states for its piece. Requests must arrive in
    time order from one micro-batch to the next, as in a log; inside one they may come in
    any order. Outcomes are written once per micro-batch; a repeated one replaces its own part.
    """
    spark = requests.sparkSession
    first = scans.select(
        F.col("id").alias("scan_id"), F.col("lifecycle_status").alias("status"),
        F.col("risk_score").cast("int").alias("score"))
    states = StateTable(spark, f"{folder}/states", ["scan_id"], first.schema)
    states.start(first)

    def step(batch: DataFrame, batch_id: int) -> None:
        asked = spread(batch.select("id", "scan_id", "target", "timestamp")).persist()
        known = states.rows_for(batch_id, asked)
        out = f"{folder}/steps/batch={batch_id}"
        run_lifecycle(asked, known.select(
            F.col("scan_id").alias("id"), F.col("status").alias("lifecycle_status"),
            F.col("score").alias("risk_score")), limit).write.mode("overwrite").parquet(out)
        done = spark.read.parquet(out).filter("old_status IS NOT NULL")
        states.put(batch_id, done.groupBy("scan_id").agg(F.max_by(
            F.struct(F.col("new_status").alias("status"), F.col("new_score").alias("score")),
            F.struct("timestamp", "id")).alias("last")).select("scan_id", "last.*"))
        asked.unpersist()

    finish(requests.writeStream.foreachBatch(step).option(
        "checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start(), timeout)
    return spark.read.parquet(f"{folder}/steps").drop("batch")
