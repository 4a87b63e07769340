"""Latest report per aircraft."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest_state(
    df: DataFrame,
    keys: Sequence[str] | Sequence[Column] = ("conflict_id", "flight_id"),
    order: Sequence[str] = ("event_ts", "seq"),
) -> DataFrame:
    """Keep the row with the greatest ``order`` per key.

    An aggregate, not a ranking window: reports of one aircraft are combined before the shuffle,
    so an aircraft that floods the stream costs its key one row per map task. The same plan is
    valid on a stream with a watermark.
    """
    names = [k for k in keys if isinstance(k, str)]
    payload = [c for c in df.columns if c not in names]
    picked = F.max_by(F.struct(*payload), F.struct(*order)).alias("_latest")
    return df.groupBy(*keys).agg(picked).select("*", "_latest.*").drop("_latest")
