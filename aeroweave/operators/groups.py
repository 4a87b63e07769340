"""Operators on whole conflict groups. None of them gathers an unbounded group in one row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.codec import advisory_struct, flight_record, status_json
from ..session import materialize


def group_sizes(flights: DataFrame) -> DataFrame:
    """``(conflict_id, n)``, counted before the shuffle."""
    return flights.groupBy("conflict_id").agg(F.count("*").alias("n"))


def filter_multi(flights: DataFrame, keep_size: bool = False) -> DataFrame:
    """Drop the groups of one aircraft.

    A plain join on the counts rather than a window, which would sort a whole group in one task;
    the adaptive skew join splits a dominant group.
    """
    sizes = group_sizes(flights).where(F.col("n") > 1)
    if keep_size:
        return flights.join(sizes, "conflict_id")
    return flights.join(sizes, "conflict_id", "left_semi")


def _parts(df: DataFrame, max_records: int) -> DataFrame:
    """Add ``part``, ``n_parts`` and ``first`` so that a part is a run of up to ``max_records`` rows of its group.

    Parts follow the order of the group, and ``first`` is the position of a part's first row, so the whole order can be
    put together again. Only groups above the limit are ranked, range by range. The rows are written to the
    checkpoint folder first: they are counted and then encoded, and what produced them should not run twice.
    """
    if "ord" not in df.columns:
        df = df.withColumn("ord", F.col("flight_id"))
    df = materialize(df)
    sizes = group_sizes(df)
    largest = sizes.agg(F.coalesce(F.max("n"), F.lit(0))).first()[0]
    if largest <= max_records:
        return df.withColumns({"part": F.lit(0), "n_parts": F.lit(1), "first": F.lit(0).cast("bigint")})
    sized = df.join(sizes, "conflict_id")
    ranged = materialize(
        sized.where(F.col("n") > max_records)
        .repartitionByRange(F.col("conflict_id"), F.col("ord"))
        .withColumn("_range", F.spark_partition_id())
    )
    order = W.partitionBy("conflict_id").orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    before = ranged.groupBy("conflict_id", "_range").agg(F.count("*").alias("_m"))
    before = before.select("conflict_id", "_range", F.coalesce(F.sum("_m").over(order), F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy("conflict_id", "_range").orderBy("ord"))
    rank = inside - 1 + F.col("_before")
    part = F.floor(rank / max_records).cast("int")
    ranked = ranged.join(before, ["conflict_id", "_range"]).withColumn("part", part)
    large = ranked.withColumn("n_parts", F.ceil(F.col("n") / F.lit(max_records)).cast("int")).select(
        *df.columns, "part", "n_parts", (F.col("part") * F.lit(max_records)).cast("bigint").alias("first")
    )
    whole = sized.where(F.col("n") <= max_records).select(
        *df.columns, F.lit(0).alias("part"), F.lit(1).alias("n_parts"), F.lit(0).cast("bigint").alias("first")
    )
    return whole.unionByName(large)


def _ordered(payload: Column) -> Column:
    rows = F.sort_array(F.collect_list(F.struct(F.col("ord"), payload.alias("payload"))))
    return F.transform(rows, lambda r: r["payload"])


def assemble_conflict(flights: DataFrame, max_records: int = 50_000) -> DataFrame:
    """One conflict string per group: ``(conflict_id, part, n_parts, first, value)``.

    Records follow ``ord``, or ``flight_id`` where there is no position.
    A group beyond ``max_records`` becomes several strings, so none grows with the group; ``part_key`` writes
    into a message key what is needed to put the group together again in its order.
    """
    record = flight_record(*[F.col(c) for c in ("flight_id", "lat", "lon", "heading", "speed")])
    return (
        _parts(flights, max_records)
        .repartition("conflict_id", "part")
        .groupBy("conflict_id", "part", "n_parts", "first")
        .agg(F.array_join(_ordered(record), "").alias("value"))
    )


def encode_status(flights: DataFrame) -> DataFrame:
    """Status JSON in ``value``, other columns kept."""
    fields = [F.col(c) for c in ("flight_id", "lat", "lon", "speed", "heading")]
    return flights.withColumn("value", status_json(*fields))


def encode_advisories(advisories: DataFrame, max_records: int = 10_000) -> DataFrame:
    """One advisory JSON per group: ``(conflict_id, part, n_parts, first, value)``.

    A group beyond ``max_records`` becomes several messages; each is complete on its own, and
    decoding all of them gives the same advisories as one.
    """
    adv = advisory_struct(
        F.col("flight_id"),
        F.col("clear_of_conflict"),
        F.col("lat"),
        F.col("lon"),
        F.col("speed"),
        F.col("heading"),
        F.col("turn_rate"),
        F.col("period_s"),
    )
    return (
        _parts(advisories, max_records)
        .repartition("conflict_id", "part")
        .groupBy("conflict_id", "part", "n_parts", "first")
        .agg(F.to_json(F.struct(_ordered(adv).alias("advisories"))).alias("value"))
    )
