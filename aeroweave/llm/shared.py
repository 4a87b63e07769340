"""Helpers of the operators: intermediate tables in the shared folder, caches that outlive a task."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable
from typing import TypeVar

from pyspark.sql import DataFrame

from ..session import scratch_path

T = TypeVar("T")
_CACHE = "_aeroweave_worker_cache"


def per_process(name: str, make: Callable[[], T]) -> T:
    """A value made once per worker process; it stays for later tasks of the same worker."""
    store = sys.modules.setdefault(_CACHE, types.ModuleType(_CACHE))
    if not hasattr(store, name):
        setattr(store, name, make())
    return getattr(store, name)


def stored(df: DataFrame, label: str, compression: str = "zstd") -> DataFrame:
    """Write to the shared folder and read back: the lineage ends here, so a lost executor costs a re-read."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Memory:
    """A dict for hot keys with a bound: when the young half is full it becomes the old half."""

    def __init__(self, half: int):
        self.half, self.young, self.old = half, {}, {}

    def put(self, key, value):
        if len(self.young) >= self.half:
            self.young, self.old = {}, self.young
        self.young[key] = value
        return value

    def find(self, key):
        """The value, or None."""
        got = self.young.get(key)
        if got is None and (got := self.old.get(key)) is not None:
            self.put(key, got)
        return got
