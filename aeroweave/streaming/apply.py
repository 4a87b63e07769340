"""Advisories put onto the flight states they are in force for, on tables and on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_in_force(flights: DataFrame, advisories: DataFrame, period: str = "5 seconds") -> DataFrame:
    """``flights`` with every advisory of the aircraft that was issued up to ``period`` before the state.

    ``flights`` has ``flight_id`` and ``event_ts``, ``advisories`` ``flight_id`` and ``issued_ts``. A state without an advisory
    in force stays, with NULLs. Bounded tables join as they are; streams need watermarks, see ``apply_advisories_stream``.
    """
    told = advisories.withColumnRenamed("flight_id", "_advised")
    in_force = (
        (F.col("flight_id") == F.col("_advised"))
        & (F.col("issued_ts") <= F.col("event_ts"))
        & (F.col("issued_ts") > F.col("event_ts") - F.expr(f"interval {period}"))
    )
    return flights.join(told, in_force, "left").drop("_advised")


def apply_advisories_stream(
    flights: DataFrame, advisories: DataFrame, period: str = "5 seconds", delay: str = "10 seconds"
) -> DataFrame:
    """The same join of two streams, either of which may run up to ``delay`` behind.

    Both sides are kept by aircraft only as long as a partner may come. A state without an advisory comes out once
    the watermark says that none can be on its way, so never before ``delay``.
    """
    return join_in_force(
        flights.withWatermark("event_ts", delay), advisories.withWatermark("issued_ts", delay), period
    )
