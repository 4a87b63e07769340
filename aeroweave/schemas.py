"""Table schemas, wire schemas and the fixed values of the data model."""

from __future__ import annotations

import math

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values. They define the encounter model, so they are stated as they are.
# ---------------------------------------------------------------------------
GRID_X = tuple(float(v) for v in range(-2000, 2001, 400))  # metres, ahead of ownship
GRID_Y = tuple(float(v) for v in range(-2000, 2001, 400))  # metres, right of ownship
GRID_BEARING = (0.0, 1.5708, 3.14159, 4.71239, 6.28319)  # radians
GRID_SPEED = (10.0, 15.0, 20.0)  # metres per second, ownship and intruder
ENCOUNTER_CUTS = (GRID_X, GRID_Y, GRID_BEARING, GRID_SPEED, GRID_SPEED)

CLEAR = -1.0  # sentinel bank value: clear of conflict
BANK_ANGLES = (
    -0.3490658503988659,
    -0.17453292519943295,
    0.0,
    0.17453292519943295,
    0.3490658503988659,
    CLEAR,
)
N_ACTIONS = len(BANK_ANGLES)
N_JOINT = N_ACTIONS * N_ACTIONS
CLEAR_INDEX = N_ACTIONS - 1

RANGE_LIMIT_M = 2000.0  # |x| and |y| bound, inclusive
TERMINAL_CLEAR_UTILITY = 0.0
TERMINAL_ADVISORY_UTILITY = -0.5
MAX_SWEEPS = 100
DECISION_PERIOD_S = 5
GRAVITY = 9.8
METRES_PER_DEGREE = 111111.0
TWO_PI = 2.0 * math.pi
# ---------------------------------------------------------------------------

#: Farthest distance at which a pair can still be in range on both rotated axes.
RANGE_RADIUS_M = RANGE_LIMIT_M * math.sqrt(2.0)

PAIR_KEYS = ("conflict_id", "own_id", "own_ord", "intr_id", "intr_ord")
VERTICES = T.ArrayType(
    T.StructType(
        [T.StructField("state_idx", T.IntegerType()), T.StructField("w", T.DoubleType())]
    )
)

MESSAGE = T.StructType(
    [
        T.StructField("key", T.StringType()),
        T.StructField("value", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
    ]
)

STATUS = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in ("flightId", "lat", "lon", "speed", "heading")
    ]
)

WAYPOINT = T.StructType(
    [
        T.StructField(name, T.StringType())
        for name in ("lat", "lon", "speed", "heading", "period", "turn")
    ]
)
ADVISORY = T.StructType(
    [
        T.StructField("gufi", T.StringType()),
        T.StructField("clearOfConflict", T.StringType()),
        T.StructField("waypoints", T.ArrayType(WAYPOINT)),
    ]
)
ADVISORIES = T.StructType([T.StructField("advisories", T.ArrayType(ADVISORY))])

FLIGHT_STATE = T.StructType(
    [
        T.StructField("conflict_id", T.StringType()),
        T.StructField("flight_id", T.StringType()),
        T.StructField("ord", T.LongType()),
        T.StructField("lat", T.DoubleType()),
        T.StructField("lon", T.DoubleType()),
        T.StructField("heading", T.DoubleType()),
        T.StructField("speed", T.DoubleType()),
    ]
)

RESOLUTION = T.StructType(
    [
        T.StructField("conflict_id", T.StringType()),
        T.StructField("flight_id", T.StringType()),
        T.StructField("ord", T.LongType()),
        T.StructField("action_idx", T.IntegerType()),
        T.StructField("bank", T.DoubleType()),
        T.StructField("joint_util", T.DoubleType()),
        T.StructField("n_iter", T.IntegerType()),
        T.StructField("hit_cap", T.BooleanType()),
    ]
)

_GML_POINT = T.StructType(
    [
        T.StructField(
            "gml:Point",
            T.StructType(
                [
                    T.StructField("_srsName", T.StringType()),
                    T.StructField(
                        "gml:coordinates",
                        T.StructType([T.StructField("_VALUE", T.StringType())]),
                    ),
                ]
            ),
        )
    ]
)
_GML_LINE = T.StructType(
    [
        T.StructField(
            "gml:LineString",
            T.StructType(
                [
                    T.StructField("_srsName", T.StringType()),
                    T.StructField(
                        "gml:coordinates",
                        T.StructType([T.StructField("_VALUE", T.StringType())]),
                    ),
                ]
            ),
        )
    ]
)

POSITION_XML = T.StructType(
    [
        T.StructField("utm:gufi", T.StringType()),
        T.StructField("utm:heading", T.StringType()),
        T.StructField("utm:location", _GML_POINT),
        T.StructField("utm:speed", T.StringType()),
        T.StructField("utm:time_received", T.StringType()),
        T.StructField("utm:time_measured", T.StringType()),
    ]
)
OPERATION_XML = T.StructType(
    [
        T.StructField(f"utm:{name}", T.StringType())
        for name in (
            "unmanned",
            "aircraft_type",
            "flight_number",
            "notify_url",
            "primary_contact_name",
            "primary_contact_phone",
            "primary_contact_email",
            "submit_time",
            "effective_time_begin",
            "effective_time_end",
            "primary_phone",
            "aircraft_comments",
        )
    ]
    + [T.StructField("utm:flight_geography", _GML_LINE)]
    + [T.StructField(f"utm:{name}", T.StringType()) for name in ("min_altitude", "max_altitude")]
)
OPERATION_MESSAGE_XML = T.StructType(
    [
        T.StructField("utm:gufi", T.StringType()),
        T.StructField("utm:message_id", T.StringType()),
    ]
)
