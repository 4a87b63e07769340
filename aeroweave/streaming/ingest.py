"""Status messages to conflict groups, one group per event-time window."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.groups import assemble_conflict
from ..operators.latest import latest_state
from ..sources.conflict import part_key
from ..sources.messages import write_messages
from ..sources.status import decode_status

Sink = Callable[[DataFrame, int], None]


def ingest_stream(
    messages: DataFrame, window: str = "1 second", delay: str = "5 seconds"
) -> DataFrame:
    """Latest state per aircraft and window, emitted once the watermark has passed the window.

    State is keyed by (window, aircraft), so no window gathers in one task, and repeated reports
    are merged before the shuffle. ``conflict_id`` is the window start in milliseconds.
    """
    states = decode_status(messages.select("value", F.col("timestamp").alias("event_ts")))
    # within one instant the larger state wins, so the choice does not depend on arrival order
    tie = F.struct("lat", "lon", "heading", "speed")
    latest = latest_state(
        states.withWatermark("event_ts", delay).withColumn("seq", tie),
        keys=(F.window("event_ts", window), "flight_id"),
    )
    return _flights(latest)


def _flights(latest: DataFrame) -> DataFrame:
    return latest.select(
        F.unix_millis("window.start").cast("string").alias("conflict_id"),
        "flight_id",
        "lat",
        "lon",
        "heading",
        "speed",
        "event_ts",
    )


def open_windows(spark: SparkSession, checkpoint: str) -> DataFrame:
    """What the windows that a stopped ``start_ingest`` has not closed hold so far, read from its state store.

    The same columns as ``ingest_stream``. These are the windows behind the last watermark: the end of a stream that went quiet.
    """
    state = spark.read.format("statestore").load(checkpoint)
    return _flights(state.select("key.*", "value.valueWithExtremumOrdering.*"))


def close_ingest(
    spark: SparkSession,
    checkpoint: str,
    topic: str = "conflict",
    format: str = "kafka",
    options: dict[str, str] | None = None,
    max_records: int = 50_000,
) -> None:
    """Publish the windows that are still open after a stopped run, as a batch of its own that a repeat replaces.

    For the end of a bounded run, or a stream that stays quiet. The stream may be resumed; a window that was closed here is then published
    again, with the same name and all its reports, once the watermark passes it.
    """
    write_messages(assemble_stream(open_windows(spark, checkpoint), max_records), topic, format, options, batch_id=-1)


def late_reports(query: StreamingQuery) -> int:
    """Reports that came after their window had closed, in the batches whose progress the query remembers.

    Reports of one aircraft, window and task are combined before they are counted.
    """
    return sum(state.numRowsDroppedByWatermark for p in query.recentProgress for state in p.stateOperators)


def assemble_stream(flights: DataFrame, max_records: int = 50_000) -> DataFrame:
    """Conflict messages ``(key, value)`` of a batch of closed windows; large windows come in parts that say so."""
    parts = assemble_conflict(flights, max_records)
    key = part_key(*(F.col(c) for c in ("conflict_id", "part", "n_parts", "first")))
    return parts.select(key.alias("key"), "value")


def start_ingest(
    messages: DataFrame,
    checkpoint: str,
    topic: str = "conflict",
    format: str = "kafka",
    options: dict[str, str] | None = None,
    window: str = "1 second",
    delay: str = "5 seconds",
    trigger: dict | None = None,
    max_records: int = 50_000,
) -> StreamingQuery:
    """Run status -> conflict. A window closes within one batch, so a message is never torn."""

    def publish(batch: DataFrame, batch_id: int) -> None:
        write_messages(assemble_stream(batch, max_records), topic, format, options, batch_id=batch_id)

    return (
        ingest_stream(messages, window, delay)
        .writeStream.outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"processingTime": "1 second"}))
        .foreachBatch(publish)
        .start()
    )
