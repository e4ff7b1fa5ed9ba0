"""Event feed from the audit log (T1), and running a stream to its end."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from seclake.fixed_values import AUDIT_EVENT, EVENT_OF_ACTION
from seclake.functions.lookup import look_up
from seclake.functions.texts import camel


def event_feed(audit: DataFrame) -> DataFrame:
    """Named JSON messages: one for the audit row, one for its action if that has an event.

    Stateless, for a stream or a batch of audit rows. Null fields are left out of the JSON.
    """
    payload = F.to_json(F.struct(*[
        F.col(c).alias(camel(c)) for c in audit.columns if c != "timestamp"]))
    names = F.array_compact(F.array(
        F.lit(AUDIT_EVENT), look_up(EVENT_OF_ACTION, F.col("action"))))
    return audit.select(
        F.col("id").alias("audit_id"), F.explode(names).alias("event_name"),
        payload.alias("payload"), "timestamp")


def run_to_end(stream: DataFrame, sink: str, checkpoint: str, form: str = "parquet",
               timeout: int = 3600) -> None:
    """Write what has arrived so far to files and stop."""
    query = (
        stream.writeStream.format(form).outputMode("append")
        .option("path", sink).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start())
    finish(query, timeout)


def finish(query: StreamingQuery, timeout: int = 3600) -> None:
    if not query.awaitTermination(timeout):
        query.stop()
        raise TimeoutError("the stream did not end in time")
