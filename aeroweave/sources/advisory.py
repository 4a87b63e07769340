"""Advisory messages: nested JSON whose leaves are strings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import ADVISORIES, ADVISORY
from .status import number


def _flatten(df: DataFrame, rest: list[str], adv: str) -> DataFrame:
    """First waypoint of each advisory; the flag must read exactly ``true`` or ``false``.

    A hovering aircraft has no turn rate: a waypoint may leave it out, but not garble it.
    """
    flag = F.col(f"{adv}.clearOfConflict")
    first = F.get(F.col(f"{adv}.waypoints"), F.lit(0))
    return df.select(
        *rest,
        F.col(f"{adv}.gufi").alias("flight_id"),
        F.when(flag == "true", F.lit(True)).when(flag == "false", F.lit(False)).alias("clear_of_conflict"),
        number(first["lat"]).alias("lat"),
        number(first["lon"]).alias("lon"),
        number(first["speed"]).alias("speed"),
        number(first["heading"]).alias("heading"),
        number(first["period"]).alias("period_s"),
        number(first["turn"]).alias("turn_rate"),
        (first["turn"].isNull() | number(first["turn"]).isNotNull()).alias("_turn_ok"),
        F.col(adv).alias("_adv"),
    )


def _valid() -> Column:
    return F.coalesce(
        F.col("flight_id").isNotNull()
        & F.col("clear_of_conflict").isNotNull()
        & F.col("period_s").isNotNull()
        & F.col("_turn_ok"),
        F.lit(False),
    )


def _exploded(df: DataFrame, col: str) -> DataFrame:
    rest = [c for c in df.columns if c != col]
    parsed = df.select(*rest, F.col(col).alias("_raw"), F.from_json(col, ADVISORIES).alias("_m"))
    rows = parsed.select(*rest, "_raw", F.explode_outer("_m.advisories").alias("_a"))
    return _flatten(rows, [*rest, "_raw"], "_a")


def decode_advisories(df: DataFrame, col: str = "value") -> DataFrame:
    """One row per advisory of ``{"advisories": [...]}`` messages."""
    return _exploded(df, col).where(_valid()).drop("_adv", "_raw", "_turn_ok")


def advisory_rejects(df: DataFrame, col: str = "value") -> DataFrame:
    """Advisories, or whole messages, that cannot be decoded; ``reject`` holds the JSON."""
    rest = [c for c in df.columns if c != col]
    bad = _exploded(df, col).where(~_valid())
    return bad.select(*rest, F.coalesce(F.to_json("_adv"), F.col("_raw")).alias("reject"))


def decode_advisory(df: DataFrame, col: str = "value") -> DataFrame:
    """One row per message that holds a single bare advisory."""
    rest = [c for c in df.columns if c != col]
    parsed = df.select(*rest, F.explode(F.array(F.from_json(col, ADVISORY))).alias("_a"))
    return _flatten(parsed, rest, "_a").where(_valid()).drop("_adv", "_turn_ok")
