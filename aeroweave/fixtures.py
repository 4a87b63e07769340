"""Flight states and a utility table derived from the given tables, for queries and tests."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.grid import Grid
from .operators.latest import latest_state
from .schemas import N_JOINT

GROUP_SECONDS = 300


def epoch_micros(ts: Column) -> Column:
    """Microseconds since 1970 of a zone-less timestamp, whatever the session zone is."""
    return F.timestamp_diff("MICROSECOND", F.expr("timestamp_ntz'1970-01-01 00:00:00'"), ts)


def reports(spark: SparkSession, sf_dir: str, box: int = 5001) -> DataFrame:
    """One aircraft report per event, spread over a square of ``box`` metres."""
    e = F.col("event_id")
    us = epoch_micros(F.col("ts"))
    half = box // 2
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.floor(us / (GROUP_SECONDS * 1_000_000)).cast("string").alias("conflict_id"),
        F.concat(F.lit("F"), F.col("user_id").cast("string")).alias("flight_id"),
        F.col("user_id").alias("ord"),
        ((e * 7919) % box - half).cast("double").alias("lat"),
        ((e * 104729) % box - half).cast("double").alias("lon"),
        ((e * 31) % 6283 / 1000.0).alias("heading"),
        (10 + (e * 13) % 1001 / 100.0).alias("speed"),
        us.alias("event_us"),
        e.alias("seq"),
    )


def flight_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest report per aircraft and 5-minute group; ``ord`` is the position key of the group."""
    return latest_state(reports(spark, sf_dir), order=("event_us", "seq"))


def one_airspace(spark: SparkSession, sf_dir: str, box: int) -> DataFrame:
    """Every event as an aircraft of its own; a third of them share one conflict group."""
    e = F.col("seq")
    group = F.when(e % 3 == 0, F.lit("hub")).otherwise(F.concat(F.lit("g"), F.floor(e / 8)))
    return reports(spark, sf_dir, box).select(
        group.alias("conflict_id"),
        F.concat(F.lit("E"), e.cast("string")).alias("flight_id"),
        e.alias("ord"),
        "lat",
        "lon",
        "heading",
        "speed",
    )


def synthetic_utility(n_states: int | None = None, n_joint: int = N_JOINT) -> np.ndarray:
    """A table of the real shape with dyadic values in [-1, 0); it has no aeronautical meaning."""
    n_states = Grid().length + 1 if n_states is None else n_states
    s, j = np.arange(n_states)[:, None], np.arange(n_joint)[None, :]
    return ((s * 37 + j * 101) % 1024) / 1024.0 - 1.0
