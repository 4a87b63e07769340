"""Shared-folder helpers: where checkpoints and intermediate tables may be written."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_DIR_KEY = "spark.checkpoint.dir"


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    Only a local-mode session may fall back to a folder of its own; on a cluster an unset
    folder is an error, because a machine-local path would not survive a lost executor.
    """
    root = spark.conf.get(_DIR_KEY, None) or spark.sparkContext.getConf().get(_DIR_KEY)
    if root:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(root)
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {_DIR_KEY} to a folder that every executor can reach")
    root = tempfile.mkdtemp(prefix="aeroweave-")
    spark.conf.set(_DIR_KEY, root)
    spark.sparkContext.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder for one intermediate table or stream checkpoint."""
    return f"{checkpoint_root(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: cuts lineage, survives executor loss, keeps the partitioning."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def materialize_placed(df: DataFrame, *keys: str) -> DataFrame:
    """Reliable checkpoint of rows hashed by ``keys`` to a fixed number of partitions, in the order of the keys.

    Joins and aggregates on the keys then leave these rows where they are. A checkpoint remembers partitioning and order
    only if its plan was not adaptive, so adaptive planning is off for this one job.
    """
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return materialize(df.repartition(parts, *keys).sortWithinPartitions(*keys))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


@contextmanager
def state_store(spark: SparkSession, bounded: bool = False) -> Iterator[None]:
    """Streams started inside keep their state in RocksDB, which keyed state with maps, timers and expiry needs.

    Processing-time timers ask for one batch after another, so a ``bounded`` run would never end with batches without data.
    """
    wanted = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}
    if bounded:
        wanted["spark.sql.streaming.noDataMicroBatches.enabled"] = "false"
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
