"""Registered queries: every operator over the whole of the given tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import fixtures
from .functions import Grid, action_value, joint_action_index, turn_rate, with_noise, wrap_angle
from .operators import (
    NoiseModel,
    apply_advisories,
    assemble_conflict,
    encode_advisories,
    encode_status,
    filter_multi,
    in_range_pairs,
    is_terminal,
    joint_utility,
    ordered_pairs,
    pair_belief,
    brick_table,
    pair_utility_by_brick,
    pair_utility_by_join,
    project_state,
    project_straight,
    project_turn,
    relative_state,
    rollout,
    share_bricks,
    share_states,
    unmatched_advisories,
    wide_utility,
)
from .plans import (
    FunctionPolicy,
    StreamedPolicy,
    TablePolicy,
    advise,
    advisory_rows,
    default_policy,
    maxmin,
    policy_sweep,
    resolve_conflicts,
    worst_cases,
)
from .plans.sweep import linear_range
from .schemas import CLEAR, DECISION_PERIOD_S, N_ACTIONS, N_JOINT
from .session import materialize, scratch_path
from .sources import (
    advisory_rejects,
    conflict_rejects,
    decode_advisories,
    decode_advisory,
    decode_conflict_group,
    decode_operation_messages_xml,
    decode_operations_xml,
    decode_positions_xml,
    decode_status,
    load_utility,
    operation_rejects,
    read_messages,
    read_operation_message_rejects,
    read_operation_messages_xml,
    read_operation_rejects,
    read_operations_xml,
    read_position_rejects,
    read_positions_xml,
    read_stream,
    split_conflict_groups,
    status_rejects,
    to_planar,
    write_messages,
)
from .sources.conflict import part_key, read_part_key
from .streaming import apply_advisories_stream, close_ingest, start_advise, start_ingest

Query = Callable[[SparkSession, str], DataFrame]

GRID = Grid()

SHUFFLE_SEED = 11
POLICY = TablePolicy(fixtures.synthetic_utility(), GRID)
SWEEP_METRES = tuple(linear_range(-2500.0, 2500.0, 10))
HUB_BOX = 200_001
STREAM_WINDOW = "5 minutes"
STREAM_DELAY = "10 minutes"

_STATE = ("lat", "lon", "heading", "speed")


def _r(col: str | Column, digits: int = 6) -> Column:
    """Rounded for comparison only; adding 0 turns -0.0 into 0.0."""
    return F.round(F.col(col) if isinstance(col, str) else col, digits) + F.lit(0.0)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: _r(n) for n in names})


def _rp(col: str | Column, digits: int = 6) -> Column:
    """:func:`_r` for rows per pair: the arithmetic of SQL's ROUND, where Spark's writes every number out in decimal."""
    x = F.col(col) if isinstance(col, str) else col
    scale = F.lit(10.0**digits)
    # floor gives whole numbers of 64 bits; what is larger, or not a number, is rounded as before
    near = F.floor(F.abs(x) * scale + F.lit(0.5)) / scale
    return F.when(F.abs(x) < F.lit(1e9), F.when(x < 0, -near).otherwise(near)).otherwise(F.round(x, digits)) + F.lit(0.0)


def _flights(spark: SparkSession, sf: str) -> DataFrame:
    return fixtures.flight_state(spark, sf)


# --- states and groups -------------------------------------------------------------------------


def latest_state_query(spark, sf):
    return _rounded(_flights(spark, sf), "heading", "speed")


def filter_multi_query(spark, sf):
    return filter_multi(_flights(spark, sf)).select("conflict_id", "flight_id", "ord")


# --- codecs ------------------------------------------------------------------------------------


def encode_flight_record_query(spark, sf):
    """Conflict strings, assembled and taken apart at the record borders."""
    strings = assemble_conflict(filter_multi(_flights(spark, sf)))
    record = F.explode(F.split("value", ",")).alias("record")
    fields = F.split("record", "%")
    return (
        strings.select("conflict_id", "n_parts", record)
        .where("record <> ''")
        .select(
            "conflict_id",
            "n_parts",
            F.get(fields, F.lit(0)).alias("flight_id"),
            *[_r(F.get(fields, F.lit(i)).cast("double")).alias(c) for i, c in
              ((1, "lat"), (2, "lon"), (3, "heading"), (4, "speed"))],
        )
    )


def assemble_conflict_query(spark, sf):
    """Shape of each assembled string: parts, records and their order."""
    strings = assemble_conflict(filter_multi(_flights(spark, sf)))
    records = F.filter(F.split("value", ","), lambda r: r != "")
    ids = F.transform(records, lambda r: F.substring_index(r, "%", 1))
    return strings.select(
        "conflict_id",
        "part",
        F.size(records).alias("n_records"),
        F.array_join(ids, ",").alias("ids"),
        F.col("value").endswith(",").alias("ends_with_comma"),
    )


def _wire_groups(spark, sf) -> DataFrame:
    """One message per hour: the hour's conflict strings split by spaces, keyed by the hour.

    An hour has twelve groups at most. Where one of them is cut into parts, each string of the hour is a message of its
    own, keyed by ``part_key`` of the name that the group has in its hour, so no message grows with a group.
    """
    strings = materialize(assemble_conflict(filter_multi(_flights(spark, sf))))
    hour = F.floor(F.col("conflict_id").cast("bigint") / 12).cast("string")
    same, ordered = W.partitionBy("hour"), W.partitionBy("hour").orderBy("conflict_id")
    groups = strings.where("part = 0").select("conflict_id", hour.alias("hour"), "n_parts").select(
        "conflict_id",
        "hour",
        F.when(F.count("*").over(same) == 1, F.col("hour"))
        .otherwise(F.concat_ws("-", "hour", F.row_number().over(ordered) - 1))
        .alias("name"),
        (F.max("n_parts").over(same) > 1).alias("torn"),
    )
    named = strings.join(groups, "conflict_id")
    torn = named.where("torn").select(
        part_key(F.col("name"), F.col("part"), F.col("n_parts"), F.col("first")).alias("key"), "value"
    )
    rows = F.sort_array(F.collect_list(F.struct("conflict_id", "value")))
    whole = named.where(~F.col("torn")).groupBy(F.col("hour").alias("key")).agg(
        F.array_join(F.transform(rows, lambda s: s["value"]), " ").alias("value")
    )
    return whole.unionByName(torn)


def _unwired(messages: DataFrame) -> DataFrame:
    """Group strings under the groups' names; the parts of a group share its name."""
    return split_conflict_groups(read_part_key(messages).select("name", "value", "first"), key="name", unique=True)


def split_conflict_groups_query(spark, sf):
    records = F.filter(F.split("group", ","), lambda r: r != "")
    parts = _unwired(_wire_groups(spark, sf)).select(
        "conflict_id",
        "first",
        F.size(records).alias("n"),
        F.substring_index(F.get(records, F.lit(0)), "%", 1).alias("id"),
    )
    return parts.groupBy("conflict_id").agg(
        F.sum("n").cast("int").alias("n_records"), F.min_by("id", "first").alias("first_id")
    )


def decode_conflict_group_query(spark, sf):
    """Records of every message, at their position in the whole group."""
    return _rounded(decode_conflict_group(_unwired(_wire_groups(spark, sf))).drop("first"), *_STATE)


def conflict_rejects_query(spark, sf):
    flights = _flights(spark, sf)
    broken = (
        F.when(F.col("ord") % 4 == 0, F.concat("flight_id", F.lit("%1%2%3")))
        .when(F.col("ord") % 4 == 1, F.concat("flight_id", F.lit("%1%x%3%4")))
        .when(F.col("ord") % 4 == 2, F.concat("flight_id", F.lit("%1%NaN%3%4")))
        .otherwise(F.concat("flight_id", F.lit("%1%2%3%4")))
    )
    groups = flights.select("conflict_id", F.concat(broken, F.lit(",")).alias("group"))
    return conflict_rejects(groups).select("conflict_id", "record")


def encode_status_query(spark, sf):
    """Status JSON read back field by field as text."""
    encoded = encode_status(_noisy(_flights(spark, sf)))
    parts = F.json_tuple("value", "flightId", "lat", "lon", "speed", "heading")
    texts = encoded.select("conflict_id", parts.alias("flight_id", "lat", "lon", "speed", "heading"))
    return texts.select(
        "conflict_id",
        "flight_id",
        *[_r(F.col(c).cast("double"), 3).alias(c) for c in _STATE],
        *[(F.length(F.substring_index(F.concat(c, F.lit(".")), ".", 2)) -
           F.length(F.substring_index(c, ".", 1)) - 1 <= 3).alias(f"{c}_short") for c in _STATE],
    )


def _noisy(flights: DataFrame) -> DataFrame:
    """Thirds and sevenths, so that more than three decimals are there to drop."""
    return flights.withColumns(
        {"lat": F.col("lat") / 3.0, "lon": F.col("lon") / 7.0, "speed": F.col("speed") / 3.0}
    )


def _status_text(spark, sf) -> DataFrame:
    """Well-formed, numeric and malformed status messages, one per report."""
    e = F.col("seq")
    number = F.format_string(
        '{"flightId":"%s","lat":%s,"lon":%s,"alt":1.0,"speed":%s,"heading":%s}',
        "flight_id", F.col("lat").cast("string"), F.col("lon").cast("string"),
        F.col("speed").cast("string"), F.col("heading").cast("string"),
    )
    encoded = encode_status(fixtures.reports(spark, sf))
    value = (
        F.when(e % 10 == 7, F.substring(F.col("value"), 1, 15))
        .when(e % 10 == 8, F.regexp_replace("value", '"lat":"[^"]*"', '"lat":"north"'))
        .when(e % 10 == 9, F.regexp_replace("value", '"speed":"[^"]*",', ""))
        .when(e % 2 == 0, number)
        .otherwise(F.col("value"))
    )
    return encoded.select(F.col("seq").alias("event_id"), value.alias("value"))


def decode_status_query(spark, sf):
    return _rounded(decode_status(_status_text(spark, sf)), *_STATE)


def status_rejects_query(spark, sf):
    return status_rejects(_status_text(spark, sf)).select("event_id")


# --- XML ---------------------------------------------------------------------------------------


def _utc_text(ts: str) -> Column:
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))


def _element(name: str, text: Column) -> Column:
    return F.concat(F.lit(f"<utm:{name}>"), text.cast("string"), F.lit(f"</utm:{name}>"))


def _gml(shape: str, coordinates: Column) -> Column:
    return F.concat(
        F.lit(f'<gml:{shape} srsName="http://www.opengis.net/gml/srs/epsg.xml#4326">'
              '<gml:coordinates decimal="." cs="," ts=" ">\n '),
        coordinates,
        F.lit(f"\n</gml:coordinates></gml:{shape}>"),
    )


def _document(tag: str, *children: Column) -> Column:
    spaces = 'xmlns:gml="http://www.opengis.net/gml" xmlns:utm="http://opengeo.org/utm"'
    return F.concat(F.lit(f"<utm:{tag} {spaces}>"), *children, F.lit(f"</utm:{tag}>"))


def _position_xml(spark, sf) -> DataFrame:
    e = F.col("event_id")
    lon, lat = ((e * 7919) % 36001 - 18000) / 100.0, ((e * 104729) % 18001 - 9000) / 100.0
    value = _document(
        "positions",
        _element("gufi", F.concat(F.lit("fid-"), e)),
        _element("heading", e % 360),
        _element("location", _gml("Point", F.concat_ws(",", lon, lat))),
        _element("speed", 10 + e % 90),
        _element("time_received", _utc_text("ts")),
        _element("time_measured", _utc_text("ts")),
    )
    return spark.read.parquet(f"{sf}/events.parquet").select(value.alias("value"))


def _position_output(positions: DataFrame) -> DataFrame:
    degrees = positions.withColumns({"heading_deg": F.col("heading"), "lon_deg": F.col("lon"), "lat_deg": F.col("lat")})
    return to_planar(degrees).select(
        "gufi",
        F.col("heading_deg").alias("heading"),
        F.col("lon_deg").alias("lon"),
        F.col("lat_deg").alias("lat"),
        "speed",
        F.unix_micros("time_received").alias("received_us"),
        F.unix_micros("time_measured").alias("measured_us"),
        _r("lon", 3).alias("x_m"),
        _r("lat", 3).alias("y_m"),
    )


def read_positions_xml_query(spark, sf):
    return _position_output(decode_positions_xml(_position_xml(spark, sf)))


def _xml_files(documents: DataFrame, label: str) -> str:
    """Files of many documents each; one document in ten is cut off before its closing tag, by its digits."""
    spark = documents.sparkSession
    path = scratch_path(spark, label)
    cut = F.regexp_extract("value", "<utm:(?:gufi|flight_number)>(?:fid-|N)(\\d+)<", 1).cast("bigint") % 10 == 7
    shorter = F.substring("value", F.lit(1), F.length("value") - 10)
    documents.select(F.when(cut, shorter).otherwise(F.col("value"))).write.option("lineSep", " ").text(path)
    return path


def _rejected(rejects: DataFrame, tag: str) -> DataFrame:
    return rejects.select(F.regexp_extract("reject", f"<utm:{tag}>([^<]*)<", 1).alias(tag))


def read_positions_xml_files_query(spark, sf):
    return _position_output(read_positions_xml(spark, _xml_files(_position_xml(spark, sf), "positions")))


def position_rejects_query(spark, sf):
    return _rejected(read_position_rejects(spark, _xml_files(_position_xml(spark, sf), "positions")), "gufi")


def _operation_xml(spark, sf) -> DataFrame:
    k = F.col("o_orderkey")
    end = F.when(k % 11 == 0, F.expr("o_orderdate - interval 1 day")).otherwise(
        F.expr("o_orderdate + interval 1 day")
    )
    line = F.array_join(
        F.transform(
            F.sequence(F.lit(0), (k % 4 + 1).cast("int")),
            lambda i: F.concat_ws(",", (i + k % 100) / 4.0, (i * 2 + k % 80) / 8.0),
        ),
        "\n  ",
    )
    value = _document(
        "operations_proposed",
        _element("unmanned", k % 2 == 0),
        _element("aircraft_type", F.concat(F.lit("type "), k % 7)),
        _element("flight_number", F.concat(F.lit("N"), k)),
        _element("notify_url", F.lit("http://example.org/notify")),
        _element("primary_contact_name", F.concat(F.lit("contact "), "o_custkey")),
        _element("primary_contact_phone", F.lit("000-000-0000")),
        _element("primary_contact_email", F.lit("contact@example.org")),
        _element("submit_time", _utc_text("o_orderdate")),
        _element("effective_time_begin", _utc_text("o_orderdate")),
        _element("effective_time_end", _utc_text("end")),
        _element("primary_phone", F.lit("000-000-0000")),
        _element("aircraft_comments", F.col("o_orderpriority")),
        _element("flight_geography", _gml("LineString", line)),
        _element("min_altitude", 50 + k % 10),
        _element("max_altitude", 150 + k % 10),
    )
    orders = spark.read.parquet(f"{sf}/orders.parquet").withColumn("end", end)
    return orders.select(value.alias("value"))


def _operation_output(operations: DataFrame) -> DataFrame:
    line = F.col("flight_geography")
    return operations.select(
        "flight_number",
        "unmanned",
        "aircraft_type",
        "primary_contact_name",
        "aircraft_comments",
        F.unix_micros("submit_time").alias("submit_us"),
        F.unix_micros("effective_time_begin").alias("begin_us"),
        F.unix_micros("effective_time_end").alias("end_us"),
        F.size(line).alias("n_points"),
        F.get(line, F.lit(1))["lon"].alias("lon1"),
        F.get(line, F.lit(1))["lat"].alias("lat1"),
        "min_altitude",
        "max_altitude",
    )


def read_operations_xml_query(spark, sf):
    return _operation_output(decode_operations_xml(_operation_xml(spark, sf)))


def read_operations_xml_files_query(spark, sf):
    return _operation_output(read_operations_xml(spark, _xml_files(_operation_xml(spark, sf), "operations")))


def operation_file_rejects_query(spark, sf):
    """Operations that are cut off or whose window ends before it begins."""
    return _rejected(read_operation_rejects(spark, _xml_files(_operation_xml(spark, sf), "operations")), "flight_number")


def operation_rejects_query(spark, sf):
    return operation_rejects(_operation_xml(spark, sf)).select("flight_number")


def _operation_message_xml(spark, sf) -> DataFrame:
    e = F.col("event_id")
    value = _document(
        "operation_messages", _element("gufi", F.concat(F.lit("fid-"), e)), _element("message_id", e % 40)
    )
    return spark.read.parquet(f"{sf}/events.parquet").select(value.alias("value"))


def read_operation_messages_xml_query(spark, sf):
    return decode_operation_messages_xml(_operation_message_xml(spark, sf))


def read_operation_messages_xml_files_query(spark, sf):
    return read_operation_messages_xml(spark, _xml_files(_operation_message_xml(spark, sf), "operation-messages"))


def operation_message_rejects_query(spark, sf):
    files = _xml_files(_operation_message_xml(spark, sf), "operation-messages")
    return _rejected(read_operation_message_rejects(spark, files), "gufi")


# --- utility table -----------------------------------------------------------------------------


def load_utility_query(spark, sf):
    """A CSV with one line per event, written in event order and read back by line number."""
    e = F.col("event_id")
    row = F.concat_ws(",", *[((e * 37 + j * 101) % 1024 / 1024.0 - 1.0) for j in range(N_JOINT)])
    path = scratch_path(spark, "utility")
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.select("event_id", row.alias("value")).orderBy("event_id").select("value").write.text(path)
    table = load_utility(spark, path, events.count())
    return table.select(
        "state_idx",
        F.get("u", F.lit(0)).alias("u_first"),
        F.get("u", F.lit(N_JOINT - 1)).alias("u_last"),
        _r(F.aggregate("u", F.lit(0.0), lambda a, v: a + v)).alias("u_sum"),
    )


# --- scalar functions --------------------------------------------------------------------------


def scalar_functions_query(spark, sf):
    """Joint action, bank angle, turn rate and wrapped angle of every report."""
    e = F.col("seq")
    own, intr = (e % N_ACTIONS).cast("int"), (e * 7 % N_ACTIONS).cast("int")
    bank = action_value(own)
    speed = F.when(e % 50 == 0, F.lit(0.0)).otherwise(F.col("speed"))
    return fixtures.reports(spark, sf).select(
        F.col("seq").alias("event_id"),
        joint_action_index(own, intr).alias("joint_idx"),
        _r(bank, 9).alias("bank"),
        _r(turn_rate(bank, speed), 9).alias("turn_rate"),
        _r(wrap_angle(F.col("heading") * 3 - F.lit(9.0)), 9).alias("wrapped"),
    )


def joint_action_index_query(spark, sf):
    return scalar_functions_query(spark, sf).select("event_id", "joint_idx")


def action_value_query(spark, sf):
    return scalar_functions_query(spark, sf).select("event_id", "bank")


def turn_rate_query(spark, sf):
    return scalar_functions_query(spark, sf).select("event_id", "turn_rate")


def wrap_angle_query(spark, sf):
    return scalar_functions_query(spark, sf).select("event_id", "wrapped")


# --- grid --------------------------------------------------------------------------------------


def _points(spark, sf) -> DataFrame:
    """A grid query point per report; some coordinates hit cuts or lie outside the axes."""
    e = F.col("seq")
    return fixtures.reports(spark, sf).select(
        F.col("seq").alias("event_id"),
        F.when(e % 5 == 0, F.col("lat") - F.col("lat") % 400).otherwise(F.col("lat") / 1.1).alias("x"),
        (F.col("lon") / 1.1).alias("y"),
        F.when(e % 7 == 0, F.lit(1.5708)).otherwise(F.col("heading") - 2.0).alias("bearing"),
        (F.col("speed") / 1.1).alias("v_own"),
        F.when(e % 3 == 0, F.lit(15.0)).otherwise(F.col("speed") * 1.3 / 1.1).alias("v_int"),
    )


def grid_bracket_query(spark, sf):
    rows = _points(spark, sf)
    for dim, name in enumerate(("x", "y", "bearing", "v_own", "v_int")):
        rows = rows.withColumn(f"b{dim}", GRID.bracket(F.col(name), dim))
    return rows.select(
        "event_id",
        *[F.col(f"b{d}.{f}").alias(f"{f}_{d}") for d in range(5) for f in ("lo", "hi")],
        *[_r(f"b{d}.w_lo").alias(f"w_lo_{d}") for d in range(5)],
        *[_r(f"b{d}.w_hi").alias(f"w_hi_{d}") for d in range(5)],
    )


def grid_interpolants_query(spark, sf):
    vertices = pair_belief(_points(spark, sf), GRID)
    return vertices.select("event_id", F.explode("vertices").alias("v")).select(
        "event_id", F.col("v.state_idx").alias("state_idx"), _r("v.w").alias("w")
    )


def grid_interpolate_query(spark, sf):
    """One value vector, x + 2y + 3z..., held in a table of all grid points."""
    point = F.aggregate(
        F.zip_with("point", F.array(*[F.lit(float(k)) for k in range(1, 6)]), lambda a, b: a * b),
        F.lit(0.0),
        lambda t, v: t + v,
    )
    values = GRID.points(spark).select("state_idx", point.alias("value"))
    beliefs = pair_belief(_points(spark, sf), GRID)
    return _rounded(GRID.interpolate_by_join(beliefs, values, ["event_id"]), "value")


def grid_decode_query(spark, sf):
    idx = (F.col("event_id") * 31 % (GRID.length + 7) - 3).cast("int")
    rows = spark.read.parquet(f"{sf}/events.parquet").select("event_id", idx.alias("state_idx"))
    decoded = rows.withColumn("p", GRID.decode(F.col("state_idx")))
    return decoded.select(
        "event_id", "state_idx", *[F.get("p", F.lit(d)).alias(f"c{d}") for d in range(5)]
    )


def grid_points_query(spark, sf):
    """Each report with the grid point that its number names, from the table of all points."""
    idx = (F.col("event_id") * 31 % (GRID.length + 7) - 3).cast("int")
    rows = spark.read.parquet(f"{sf}/events.parquet").select("event_id", idx.alias("state_idx"))
    return rows.join(GRID.points(spark), "state_idx").select(
        "event_id", "state_idx", *[F.get("point", F.lit(d)).alias(f"c{d}") for d in range(5)]
    )


# --- pairs -------------------------------------------------------------------------------------


def ordered_pairs_query(spark, sf):
    """Per ownship: all intruders, those in range and those beyond."""
    return ordered_pairs(_flights(spark, sf))[1]


def in_range_pairs_query(spark, sf):
    pairs = in_range_pairs(_flights(spark, sf))
    return pairs.withColumns({n: _rp(n) for n in ("x", "y", "bearing", "v_own", "v_int")})


def hub_in_range_pairs_query(spark, sf):
    """The same where a third of all aircraft share one conflict group."""
    pairs = in_range_pairs(fixtures.one_airspace(spark, sf, HUB_BOX))
    return pairs.select("conflict_id", "own_ord", "intr_ord", *[_rp(n).alias(n) for n in ("x", "y", "bearing")])


def relative_state_query(spark, sf):
    """Each report seen from the aircraft's first report of the day."""
    reports = fixtures.reports(spark, sf)
    day = F.floor(F.col("event_us") / 86_400_000_000)
    firsts = reports.groupBy("flight_id", day.alias("day")).agg(
        F.min_by(F.struct(*_STATE), F.struct("event_us", "seq")).alias("o")
    )
    pairs = reports.withColumn("day", day).join(firsts, ["flight_id", "day"]).select(
        F.col("seq").alias("event_id"),
        *[F.col(f"o.{c}").alias(f"own_{c}") for c in _STATE],
        *[F.col(c).alias(f"intr_{c}") for c in _STATE],
    )
    seen = relative_state(pairs)
    return seen.select(
        "event_id",
        *[_r(c).alias(c) for c in ("x", "y", "bearing", "v_own", "v_int")],
        is_terminal(F.col("x"), F.col("y")).alias("is_terminal"),
        _r(wrap_angle(F.col("bearing"))).alias("wrapped"),
    )


# --- utilities ---------------------------------------------------------------------------------


def _named_pairs(spark, sf) -> DataFrame:
    """Pairs in range, by position; the ids of the aircraft are not asked for."""
    return in_range_pairs(_flights(spark, sf).drop("flight_id"))


def pair_utility_query(spark, sf):
    return POLICY.pair_q(_named_pairs(spark, sf), digits=6)


def pair_utility_by_join_query(spark, sf):
    beliefs = pair_belief(_named_pairs(spark, sf), GRID)
    return wide_utility(pair_utility_by_join(beliefs, share_states(POLICY.frame(spark))), 6)


def pair_utility_by_brick_query(spark, sf):
    """The same with one row of the packed table per pair."""
    beliefs = pair_belief(_named_pairs(spark, sf), GRID)
    bricks = share_bricks(brick_table(POLICY.frame(spark), GRID), GRID)
    return pair_utility_by_brick(beliefs, bricks, GRID, digits=6)


def _spread_utils(df: DataFrame) -> list[Column]:
    return [_r(F.get("utils", F.lit(a))).alias(f"u{a}") for a in range(N_ACTIONS)]


def worst_case_query(spark, sf):
    """Worst case while every aircraft flies the action numbered by its id."""
    flights = materialize(_flights(spark, sf))
    current = flights.select("conflict_id", "ord", (F.col("ord") % N_ACTIONS).cast("int").alias("action_idx"))
    utils = worst_cases(flights, POLICY, current)
    return utils.select("conflict_id", "flight_id", "ord", *_spread_utils(utils))


def best_response_query(spark, sf):
    best = maxmin(_flights(spark, sf), POLICY)
    return best.select(
        "conflict_id", "flight_id", "ord", *_spread_utils(best), "action_idx", _r("util").alias("util")
    )


def maxmin_query(spark, sf):
    """Best response where a third of all aircraft share one conflict group."""
    best = maxmin(fixtures.one_airspace(spark, sf, HUB_BOX), POLICY)
    return best.select("conflict_id", "ord", "action_idx", _r("util").alias("util"))


def joint_utility_query(spark, sf):
    return _rounded(joint_utility(maxmin(_flights(spark, sf), POLICY)), "joint_util")


# --- search ------------------------------------------------------------------------------------


def resolve_conflicts_query(spark, sf):
    return _rounded(resolve_conflicts(_flights(spark, sf), POLICY), "bank", "joint_util")


def resolve_distributed_query(spark, sf):
    """The same search with every group treated as too large for a task."""
    return _rounded(resolve_conflicts(_flights(spark, sf), POLICY, max_group_pairs=0), "bank", "joint_util")


def resolve_shuffled_query(spark, sf):
    resolved = resolve_conflicts(_flights(spark, sf), POLICY, order="shuffle", seed=SHUFFLE_SEED)
    return _rounded(resolved, "bank", "joint_util")


def resolve_hub_query(spark, sf):
    """A third of all aircraft in one group, which is searched by joins, the rest in tasks."""
    flights = fixtures.one_airspace(spark, sf, HUB_BOX)
    return _rounded(resolve_conflicts(flights, POLICY, max_group_pairs=2_000), "bank", "joint_util")


def default_policy_query(spark, sf):
    """The table written to CSV, loaded by the default policy and used for the search."""
    path = scratch_path(spark, "policy")
    lines = POLICY.frame(spark).repartitionByRange(4, "state_idx").sortWithinPartitions("state_idx")
    lines.select(F.array_join(F.transform("u", lambda v: v.cast("string")), ",").alias("v")).write.text(path)
    resolved = default_policy(spark, path).resolve(_flights(spark, sf))
    return resolved.select("conflict_id", "flight_id", "ord", "action_idx")


def function_policy_query(spark, sf):
    """A user's rule in place of the table: manoeuvres dealt out by position."""
    rule = FunctionPolicy(lambda group: np.arange(len(group)) % N_ACTIONS)
    resolved = rule.resolve(_flights(spark, sf))
    return resolved.select("conflict_id", "flight_id", "ord", "action_idx", _r("bank").alias("bank"))


def _yielding():
    """Each aircraft turns one step further than the one before it, two if it is faster."""
    seen = [0, None]

    def rule(flight):
        if seen[1] is not None:
            seen[0] = (seen[0] + (2 if flight["speed"] > seen[1] else 1)) % N_ACTIONS
        seen[1] = flight["speed"]
        return seen[0]

    return rule


def streamed_policy_query(spark, sf):
    """A rule that sees the aircraft of a group one by one, called from SQL as a table function."""
    StreamedPolicy(_yielding).register(spark, "yielding")
    name = f"flights_{uuid.uuid4().hex}"
    _flights(spark, sf).createOrReplaceTempView(name)
    resolved = spark.sql(f"SELECT * FROM yielding(TABLE({name}))")
    return resolved.select("conflict_id", "flight_id", "ord", "action_idx", _r("bank").alias("bank"))


def advise_query(spark, sf):
    """Published advisories of every group, decoded again."""
    decoded = decode_advisories(advise(_flights(spark, sf), POLICY))
    return _advisory_output(decoded, "conflict_id")


def _advisory_output(decoded: DataFrame, *keys: str) -> DataFrame:
    return decoded.select(
        *keys, "flight_id", "clear_of_conflict",
        *[_r(c).alias(c) for c in ("lat", "lon", "speed", "heading", "period_s", "turn_rate")],
    )


def policy_sweep_query(spark, sf):
    """Every group of the data with its first aircraft moved over a grid of positions."""
    flights = materialize(_flights(spark, sf))
    firsts = flights.groupBy("conflict_id").agg(F.min("ord").alias("first_ord"))
    swept = policy_sweep(
        flights.join(firsts, "conflict_id"), SWEEP_METRES, SWEEP_METRES, POLICY,
        F.col("ord") == F.col("first_ord"),
    )
    return _rounded(swept, "shade")


# --- advisories and trajectories ---------------------------------------------------------------


def _first_advisories(spark, sf) -> tuple[DataFrame, DataFrame]:
    flights = _flights(spark, sf).select("conflict_id", "flight_id", "ord", *_STATE)
    bank = action_value(F.col("action_idx"))
    best = maxmin(flights, POLICY).withColumn("bank", bank)
    return flights, advisory_rows(flights, best)


def encode_advisories_query(spark, sf):
    """Shape of each advisory message: advisories, their order and their clear flags."""
    encoded = encode_advisories(_first_advisories(spark, sf)[1])
    items = F.from_json("value", "advisories array<struct<gufi:string,clearOfConflict:string>>")["advisories"]
    return encoded.select(
        "conflict_id",
        "part",
        F.size(items).alias("n_advisories"),
        F.array_join(F.transform(items, lambda a: a["gufi"]), ",").alias("ids"),
        F.array_join(F.transform(items, lambda a: a["clearOfConflict"]), ",").alias("flags"),
    )


def decode_advisories_query(spark, sf):
    encoded = encode_advisories(_first_advisories(spark, sf)[1])
    return _advisory_output(decode_advisories(encoded), "conflict_id")


def decode_advisory_query(spark, sf):
    """Bare advisories, one message each, a tenth of them with an invalid flag."""
    return _advisory_output(decode_advisory(_bare_advisories(spark, sf)), "event_id")


def _bare_advisories(spark, sf) -> DataFrame:
    e = F.col("seq")
    flag = F.when(e % 10 == 3, F.lit("maybe")).when(e % 2 == 0, F.lit("true")).otherwise(F.lit("false"))
    waypoint = F.struct(
        *[F.col(c).cast("string").alias(c) for c in ("lat", "lon", "speed", "heading")],
        F.lit("5.0").alias("period"),
        (e % 7 / 40.0).cast("string").alias("turn"),
    )
    value = F.to_json(
        F.struct(F.col("flight_id").alias("gufi"), flag.alias("clearOfConflict"),
                 F.array(waypoint).alias("waypoints"))
    )
    return fixtures.reports(spark, sf).select(F.col("seq").alias("event_id"), value.alias("value"))


def advisory_rejects_query(spark, sf):
    bare = _bare_advisories(spark, sf)
    wrapped = bare.withColumn("value", F.concat(F.lit('{"advisories":['), "value", F.lit("]}")))
    return advisory_rejects(wrapped).select("event_id")


def _advised(spark, sf) -> DataFrame:
    """Flights with the advisories of the even-numbered aircraft only."""
    flights, advisories = _first_advisories(spark, sf)
    even = advisories.where(F.col("ord") % 2 == 0)
    return apply_advisories(flights, even, on=("conflict_id", "flight_id"))


def apply_advisories_query(spark, sf):
    return _advised(spark, sf).select(
        "conflict_id",
        "flight_id",
        F.col("clear_of_conflict").cast("string").alias("clear_of_conflict"),
        _r("turn_rate").alias("turn_rate"),
        F.col("period_s").cast("double").alias("period_s"),
    )


def unmatched_advisories_query(spark, sf):
    """Advisories for aircraft that the first half of the fleet does not know."""
    flights, advisories = _first_advisories(spark, sf)
    known = flights.where(F.col("ord") % 2 == 0)
    return unmatched_advisories(known, advisories, on=("conflict_id", "flight_id")).select(
        "conflict_id", "flight_id"
    )


def project_straight_query(spark, sf):
    moved = project_straight(fixtures.reports(spark, sf), 5.0)
    return _rounded(moved, *_STATE).select(F.col("seq").alias("event_id"), *_STATE)


def project_turn_query(spark, sf):
    rate = (F.col("seq") % 9 - 4 + 0.5) / 20.0
    moved = project_turn(fixtures.reports(spark, sf), 5.0, rate)
    return _rounded(moved, *_STATE).select(F.col("seq").alias("event_id"), *_STATE)


def project_state_query(spark, sf):
    moved = project_state(_advised(spark, sf), dt=5.0)
    return _rounded(moved, *_STATE).select("conflict_id", "flight_id", *_STATE)


def rollout_query(spark, sf):
    path = rollout(_advised(spark, sf), steps=10, dt=5.0)
    return _rounded(path, *_STATE).select("conflict_id", "flight_id", "step", *_STATE)


def rollout_noise_query(spark, sf):
    """Ten noisy steps per aircraft; the draws depend on aircraft and step only."""
    turn = np.radians(1.0).item()
    noise = NoiseModel(
        lat=("gaussian", 0.0, 10.0), lon=("gaussian", 0.0, 10.0),
        heading=("gaussian", 0.0, np.radians(10.0).item()), speed=("gaussian", 0.0, 1.0),
        turn_clear=("uniform", 0.0, np.radians(5.0).item()), turn_conflict=("gaussian", 0.0, turn),
        seed=123456, keys=("conflict_id", "flight_id"),
    )
    path = rollout(_advised(spark, sf), steps=10, dt=5.0, noise=noise)
    return path.select("conflict_id", "flight_id", "step", *[_r(c, 3).alias(c) for c in _STATE])


def with_noise_query(spark, sf):
    rows = fixtures.reports(spark, sf).select(F.col("seq").alias("event_id"), "lat", "speed")
    rows = with_noise(rows, "lat", "gaussian", 0.0, 10.0, 123456, ["event_id"])
    rows = with_noise(rows, "speed", "uniform", 0.0, 5.0, 123456, ["event_id"])
    return _rounded(rows, "lat", "speed")


# --- streaming ---------------------------------------------------------------------------------


def _publish_status(spark, sf, root: str) -> None:
    states = encode_status(fixtures.reports(spark, sf))
    # micros to instant: the same whatever the session time zone
    messages = states.select("value", F.timestamp_micros("event_us").alias("timestamp"))
    write_messages(messages, "status", "parquet", {"path": root})


def ingest_stream_query(spark, sf):
    """Status files streamed into conflict messages per window, the last ones closed at the end, then decoded."""
    root = scratch_path(spark, "ingest")
    _publish_status(spark, sf, root)
    query = start_ingest(
        read_stream(spark, "status", "parquet", {"path": root}), f"{root}/checkpoint",
        format="parquet", options={"path": root}, window=STREAM_WINDOW, delay=STREAM_DELAY,
        trigger={"availableNow": True},
    )
    query.awaitTermination()
    close_ingest(spark, f"{root}/checkpoint", format="parquet", options={"path": root})
    messages = read_messages(spark, "conflict", "parquet", {"path": root})
    states = decode_conflict_group(split_conflict_groups(messages.select("key", "value"), key="key"))
    return _rounded(states.drop("ord"), *_STATE)


def advise_stream_query(spark, sf):
    """Conflict files streamed into advisory messages, then decoded."""
    root = scratch_path(spark, "advise")
    strings = assemble_conflict(_flights(spark, sf)).select(F.col("conflict_id").alias("key"), "value")
    write_messages(strings, "conflict", "parquet", {"path": root})
    query = start_advise(
        read_stream(spark, "conflict", "parquet", {"path": root}), POLICY, f"{root}/checkpoint",
        format="parquet", options={"path": root}, trigger={"availableNow": True},
    )
    query.awaitTermination()
    messages = read_messages(spark, "advisory", "parquet", {"path": root})
    decoded = decode_advisories(messages.select(F.col("key").alias("conflict_id"), "value"))
    return _advisory_output(decoded, "conflict_id")


def apply_advisories_stream_query(spark, sf):
    """Two file streams joined by aircraft and time: a third of the reports follow their advisory in time, a third too late.

    A last row on each side, a day after all others, lets the watermark pass them.
    """
    root = scratch_path(spark, "in-force")
    seq = F.col("seq")
    reports = fixtures.reports(spark, sf).select("flight_id", seq.alias("event_id"), "event_us")
    end = reports.agg(F.lit("end").alias("flight_id"), F.lit(-1).cast("bigint").alias("event_id"), (F.max("event_us") + 86_400_000_000).alias("event_us"))
    states = reports.unionByName(end).select("flight_id", "event_id", F.timestamp_micros("event_us").alias("event_ts"))
    ahead = F.when(F.col("event_id") % 3 == 0, 2).otherwise(60) * 1_000_000
    issued = reports.where("event_id % 3 < 2").withColumn("event_us", F.col("event_us") - ahead).unionByName(end)
    advisories = issued.select(
        "flight_id", F.col("event_id").alias("advisory_id"), F.timestamp_micros("event_us").alias("issued_ts"), (F.col("event_id") % 7 / 40).alias("turn_rate")
    )
    for name, side in (("states", states), ("advisories", advisories)):
        side.write.parquet(f"{root}/{name}")
    streams = [spark.readStream.schema(side.schema).parquet(f"{root}/{name}") for name, side in (("states", states), ("advisories", advisories))]
    joined = apply_advisories_stream(*streams).writeStream.format("parquet").outputMode("append")
    joined.option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start(f"{root}/out").awaitTermination()
    found = spark.read.parquet(f"{root}/out").where("event_id >= 0")
    return found.select("event_id", F.coalesce("advisory_id", F.lit(-1)).alias("advisory_id"), _r("turn_rate").alias("turn_rate"))


_SUFFIX = "_query"

QUERIES: dict[str, Query] = {
    name.removesuffix(_SUFFIX): fn
    for name, fn in list(globals().items())
    if name.endswith(_SUFFIX) and not name.startswith("_")
}

__all__ = ["CLEAR", "DECISION_PERIOD_S", "QUERIES"]
