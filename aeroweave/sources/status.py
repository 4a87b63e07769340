"""Status messages: five-field JSON per aircraft."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import STATUS

_NUMERIC = ("lat", "lon", "speed", "heading")


def finite(value: Column) -> Column:
    """The double itself, or NULL for NaN and infinities, which must never reach the grid."""
    return F.when(~F.isnan(value) & (F.abs(value) != F.lit(float("inf"))), value)


def number(text: Column) -> Column:
    """Finite double or NULL for text that holds none."""
    return finite(text.try_cast("double"))


def _parse(df: DataFrame, col: str) -> DataFrame:
    # a generator evaluates its input once, a plain projection would parse once per field
    fields = F.inline(
        F.transform(
            F.array(F.from_json(F.col(col), STATUS)),
            lambda s: F.struct(
                s["flightId"].alias("flight_id"),
                *[s[name].try_cast("double").alias(name) for name in _NUMERIC],
            ),
        )
    )
    return df.select("*", fields).withColumns({name: finite(F.col(name)) for name in _NUMERIC})


def _valid() -> Column:
    valid = F.col("flight_id").isNotNull() & (F.col("flight_id") != "")
    for name in _NUMERIC:
        valid = valid & F.col(name).isNotNull()
    return valid


def decode_status(df: DataFrame, col: str = "value") -> DataFrame:
    """Flight states of the well-formed messages; other columns are kept."""
    return _parse(df, col).where(_valid()).drop(col)


def status_rejects(df: DataFrame, col: str = "value") -> DataFrame:
    """The messages that :func:`decode_status` leaves out, unchanged."""
    return _parse(df, col).where(~F.coalesce(_valid(), F.lit(False))).select(*df.columns)
