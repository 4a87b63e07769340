"""Utilities of pairs, worst case over intruders, best response over actions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.grid import Grid
from ..functions.kernel import POINT_COLUMNS, brick_sums, point_matrix, utilities, vertex_lists, vertex_sums
from ..schemas import (
    CLEAR_INDEX,
    N_ACTIONS,
    N_JOINT,
    PAIR_KEYS,
    TERMINAL_ADVISORY_UTILITY,
    TERMINAL_CLEAR_UTILITY,
    VERTICES,
)
from .groups import filter_multi

#: Largest packed table that is sent to the Python workers; a larger one is joined.
MAX_BRICK_BYTES = 256 * 1024 * 1024


def grid_vertices(df: DataFrame, coords: Sequence[str], grid: Grid) -> DataFrame:
    """Add ``vertices array<struct<state_idx,w>>``: the grid points around each row's point.

    Whole Arrow batches at a time, for grids of any dimension; the expression of
    :meth:`Grid.interpolants` gives the same for grids of few axes.
    """
    cuts, names = grid.cuts, list(coords)
    schema = T.StructType([*df.schema.fields, T.StructField("vertices", VERTICES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                lists = vertex_lists(point_matrix(batch, names), cuts)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, lists], [*batch.schema.names, "vertices"]
                )

    return df.mapInArrow(run, schema)


def pair_belief(pairs: DataFrame, grid: Grid = Grid()) -> DataFrame:
    """Add ``vertices``: the grid states, with weights, that a relative state lies between."""
    return grid_vertices(pairs, POINT_COLUMNS, grid)


def _kept(pairs: DataFrame) -> list[str]:
    return [c for c in pairs.columns if c not in (*POINT_COLUMNS, "vertices")]


def round_half_up(x: np.ndarray, digits: int) -> np.ndarray:
    """SQL's ``ROUND(x, digits)`` of a matrix, without -0.0."""
    scale, size = 10.0**digits, np.abs(x)
    near = size * scale
    near += 0.5
    np.floor(near, out=near)
    near /= scale
    near = np.copysign(near, x, out=near)
    near += 0.0
    if not (size < 1e9).all():
        # what is larger has few digits left, which a product would lose
        for at in zip(*np.nonzero(~(size < 1e9))):
            exact = Decimal(repr(float(x[at]))) if np.isfinite(x[at]) else None
            near[at] = x[at] if exact is None else float(exact.quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return near


def wide_utility(pair_q: DataFrame, digits: int, n_joint: int = N_JOINT) -> DataFrame:
    """``q`` as rounded columns ``q0, q1, ...``, for results that are read by column.

    Whole Arrow batches at a time: so many expressions of a row are one method, too long to be compiled.
    """
    keep = [c for c in pair_q.columns if c != "q"]
    names = [f"q{j}" for j in range(n_joint)]
    schema = T.StructType([pair_q.schema[c] for c in keep] + [T.StructField(n, T.DoubleType()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column("q").flatten()
            if len(flat) != batch.num_rows * n_joint or batch.column("q").null_count:
                raise ValueError(f"q must hold {n_joint} numbers")
            mask = np.asarray(flat.is_null()).reshape(-1, n_joint) if flat.null_count else None
            q = round_half_up(flat.to_numpy(zero_copy_only=False).reshape(-1, n_joint), digits)
            columns = [
                pa.array(np.ascontiguousarray(q[:, j]), mask=None if mask is None else np.ascontiguousarray(mask[:, j]))
                for j in range(n_joint)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + columns, [*keep, *names])

    return pair_q.mapInArrow(run, schema)


def _q_fields(n_joint: int, digits: int | None) -> list[T.StructField]:
    if digits is None:
        return [T.StructField("q", T.ArrayType(T.DoubleType(), False))]
    return [T.StructField(f"q{j}", T.DoubleType()) for j in range(n_joint)]


def _q_columns(q: np.ndarray, digits: int | None) -> list[pa.Array]:
    if digits is None:
        offsets = pa.array(np.arange(len(q) + 1, dtype=np.int32) * q.shape[1])
        return [pa.ListArray.from_arrays(offsets, pa.array(q.ravel()))]
    return [pa.array(column) for column in np.ascontiguousarray(round_half_up(q, digits).T)]


def pair_utility(pairs: DataFrame, table, grid: Grid = Grid(), digits: int | None = None) -> DataFrame:
    """Joint-action utilities of each pair: replaces the relative state by ``q array<double>``.

    ``table`` is the broadcast utility matrix. Arrow batches in, Arrow batches out; no shuffle,
    and the sum follows the vertex order, so results do not depend on the partitioning. With ``digits`` the utilities
    come as those of :func:`wide_utility`, without another pass over the rows.
    """
    keep = _kept(pairs)
    cuts = grid.cuts
    schema = T.StructType([f for f in pairs.schema if f.name in keep] + _q_fields(table.value.shape[1], digits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u = table.value
        for batch in batches:
            if batch.num_rows == 0:
                continue
            q = utilities(point_matrix(batch), cuts, u)
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + _q_columns(q, digits), names=schema.names)

    return pairs.mapInArrow(run, schema)


def clear_utility(pairs: DataFrame, table, grid: Grid = Grid(), n_actions: int = N_ACTIONS) -> DataFrame:
    """``u0 .. u5``: utility of each own action while every intruder stays clear of conflict.

    The slice of :func:`pair_utility` that a first best response needs, as flat columns so that
    the minimum over intruders runs in generated code.
    """
    keep = _kept(pairs)
    names = [f"u{a}" for a in range(n_actions)]
    cuts = grid.cuts
    schema = T.StructType(
        [f for f in pairs.schema if f.name in keep] + [T.StructField(n, T.DoubleType()) for n in names]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u = np.ascontiguousarray(table.value[:, n_actions - 1 :: n_actions])
        for batch in batches:
            if batch.num_rows == 0:
                continue
            q = utilities(point_matrix(batch), cuts, u)
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(np.ascontiguousarray(c)) for c in q.T],
                [*keep, *names],
            )

    return pairs.mapInArrow(run, schema)


def acted_utility(pairs: DataFrame, table, grid: Grid = Grid(), n_actions: int = N_ACTIONS) -> DataFrame:
    """``u0 .. u5``: utility of each own action against the action in ``intr_action``.

    Like :func:`clear_utility`, for intruders that each fly an action of their own.
    """
    keep = [c for c in _kept(pairs) if c not in ("own_action", "intr_action")]
    names = [f"u{a}" for a in range(n_actions)]
    cuts = grid.cuts
    schema = T.StructType(
        [f for f in pairs.schema if f.name in keep] + [T.StructField(n, T.DoubleType()) for n in names]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        u = table.value
        for batch in batches:
            if batch.num_rows == 0:
                continue
            q = utilities(point_matrix(batch), cuts, u).reshape(-1, n_actions, n_actions)
            flown = batch.column("intr_action").to_numpy()
            own = q[np.arange(len(q)), :, flown]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in keep] + [pa.array(np.ascontiguousarray(c)) for c in own.T],
                [*keep, *names],
            )

    return pairs.mapInArrow(run, schema)


def pair_utility_by_join(
    beliefs: DataFrame, utility: DataFrame | Broadcast, n_joint: int = N_JOINT, keys: tuple[str, ...] = PAIR_KEYS
) -> DataFrame:
    """The same ``q`` from vertices joined with the utility table and summed.

    From :func:`share_states` a task joins the vertices of its pairs itself, and exchanges no pair. A table too large for that is
    joined without Python; Catalyst chooses how. A vertex without a row in it fails the query. A pair's vertices, 32 at most, are added up in their own order.

    A table that is not shared is joined with the distinct lists of vertices, of which a grid has so many and no more, however many pairs share
    one. A pair is then exchanged once, with its weights only. ``beliefs`` are read twice, for the lists and for the weights.
    """
    if missing := {"conflict_id", "own_ord", "intr_ord"} - set(beliefs.columns):
        raise ValueError(f"pairs are not identified without {sorted(missing)}")
    keys = [k for k in keys if k in beliefs.columns]
    if isinstance(utility, Broadcast):
        return _by_shared_states(beliefs, utility, n_joint, keys)
    rows = beliefs.where(F.size("vertices") > 0).select(
        *keys, F.col("vertices.state_idx").alias("states"), F.col("vertices.w").alias("weights")
    )
    spots = rows.select("states").distinct().select("states", F.posexplode("states").alias("at", "state_idx"))
    state = F.col("state_idx").cast("string")
    missing = F.raise_error(F.concat(F.lit("the utility table has no state "), state))
    u = F.when(F.col("u").isNull(), missing).otherwise(F.col("u")).alias("u")
    met = spots.join(utility, "state_idx", "left").select("states", F.struct("at", u).alias("corner"))
    # a list has 32 vertices at most, whatever the table
    cells = met.groupBy("states").agg(F.sort_array(F.collect_list("corner"))["u"].alias("corners"))
    zero = F.array_repeat(F.lit(0.0), n_joint)
    parts = F.arrays_zip(F.col("weights").alias("w"), F.col("corners").alias("u"))
    total = F.aggregate(parts, zero, lambda t, p: F.zip_with(t, p["u"], lambda x, y: x + y * p["w"]))
    # no corners where the pairs changed between the readings, too many where the table holds a state twice
    unmet = F.raise_error(F.lit("pairs that change while they are read, or a utility table that holds a state twice"))
    found = rows.join(cells.hint("shuffle_hash"), "states", "left")
    met = F.coalesce(F.size("corners") == F.size("weights"), F.lit(False))
    return found.select(*keys, F.when(met, total).otherwise(unmet).alias("q"))


def share_states(utility: DataFrame, n_joint: int = N_JOINT):
    """A utility table as a Spark broadcast, by state, for pairs that are too many to be exchanged.

    Above ``MAX_BRICK_BYTES``, or with a state twice, it raises. A state without utilities is left out.
    """
    most = MAX_BRICK_BYTES // (n_joint * 8)
    rows = utility.where("state_idx IS NOT NULL AND u IS NOT NULL").select("state_idx", "u").limit(most + 1).toArrow()
    if rows.num_rows > most:
        raise ValueError(f"a utility table of more than {most} states is too large to broadcast; join it instead")
    states, u = rows.column("state_idx").to_numpy().astype(np.int64), rows.column("u").combine_chunks()
    values = u.flatten()
    if len(values) != len(states) * n_joint or values.null_count or (np.diff(u.offsets.to_numpy()) != n_joint).any():
        raise ValueError(f"a state must hold {n_joint} numbers")
    order = np.argsort(states)
    if (np.diff(states[order]) == 0).any():
        raise ValueError("a utility table that holds a state twice")
    table = values.to_numpy().reshape(-1, n_joint)[order]
    return utility.sparkSession.sparkContext.broadcast((states[order], np.ascontiguousarray(table)))


def _by_shared_states(beliefs: DataFrame, utility: Broadcast, n_joint: int, keys: list[str]) -> DataFrame:
    rows = beliefs.where(F.size("vertices") > 0).select(*keys, "vertices")
    schema = T.StructType([rows.schema[k] for k in keys] + _q_fields(n_joint, None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        states, table = utility.value
        for batch in batches:
            if batch.num_rows:
                q = vertex_sums(batch.column("vertices"), states, table)
                yield pa.RecordBatch.from_arrays([batch.column(k) for k in keys] + _q_columns(q, None), names=schema.names)

    return rows.mapInArrow(run, schema)


def brick_table(utility: DataFrame, grid: Grid = Grid()) -> DataFrame:
    """``(state_idx, corners)``: the utilities at all corners of the cell above each grid point, packed in one row.

    ``corners`` follows :attr:`Grid.corners`; a corner beyond the grid, or without a row in ``utility``, is NULL. The table
    is 2^d times as long as ``utility`` and is made once; a state that occurs twice fails.
    """
    state = F.col("state_idx")
    index = [F.floor(state / F.lit(stride)) % len(axis) for axis, stride in zip(grid.cuts, grid.strides)]
    places = []
    for number, (distance, axes) in enumerate(grid.corners):
        inside = F.lit(True)
        for d in axes:
            inside = inside & (index[d] > 0)
        place = F.struct((state - distance).cast("int").alias("state_idx"), F.lit(number).alias("corner"))
        places.append(F.when(inside, place))
    placed = utility.where((state >= 0) & (state < grid.length)).select(
        F.explode(F.array_compact(F.array(*places))).alias("at"), "u"
    )
    # a cell has 2^d corners, whatever the table
    cells = placed.groupBy(F.col("at.state_idx").alias("state_idx")).agg(
        F.map_from_entries(F.collect_list(F.struct("at.corner", "u"))).alias("found")
    )
    numbers = F.sequence(F.lit(0), F.lit(len(places) - 1))
    return cells.select("state_idx", F.transform(numbers, lambda i: F.try_element_at("found", i)).alias("corners"))


def share_bricks(bricks: DataFrame, grid: Grid = Grid(), n_joint: int = N_JOINT):
    """A :func:`brick_table` as a Spark broadcast, for pairs that are too many to be exchanged.

    The grid bounds its size: a row per grid point at most, of ``2^d`` corners. Above ``MAX_BRICK_BYTES`` it raises.
    """
    n_corners = len(grid.corners)
    size = grid.length * n_corners * n_joint * 8
    if size > MAX_BRICK_BYTES:
        raise ValueError(f"a packed table of {size} bytes is too large to broadcast; join it instead")
    rows = bricks.select("state_idx", "corners").limit(grid.length + 1).toArrow()
    index = rows.column("state_idx").to_numpy()
    if len(np.unique(index)) != len(index) or not ((index >= 0) & (index < grid.length)).all():
        raise ValueError(f"state_idx must be from 0 to {grid.length - 1}, each once")
    packed, missing = np.zeros((grid.length, n_corners, n_joint)), np.ones((grid.length, n_corners), bool)
    corners = rows.column("corners").combine_chunks()
    u = corners.flatten()
    if len(u) != len(index) * n_corners or corners.null_count:
        raise ValueError(f"a brick must hold {n_corners} corners")
    there, values = np.asarray(u.is_valid()).reshape(-1, n_corners), u.flatten()
    if len(values) != there.sum() * n_joint or values.null_count:
        raise ValueError(f"a corner must hold {n_joint} numbers")
    missing[index] = ~there
    packed[index[:, None].repeat(n_corners, axis=1)[there], np.nonzero(there)[1]] = values.to_numpy().reshape(-1, n_joint)
    return bricks.sparkSession.sparkContext.broadcast((packed, missing))


def pair_utility_by_brick(
    beliefs: DataFrame,
    bricks: DataFrame | Broadcast,
    grid: Grid = Grid(),
    n_joint: int = N_JOINT,
    keys: tuple[str, ...] = PAIR_KEYS,
    digits: int | None = None,
) -> DataFrame:
    """The same ``q`` as :func:`pair_utility_by_join` from one row of a :func:`brick_table` per pair.

    The pair's first vertex is the lowest corner of its cell and names the brick; the others lie inside it. Each pair is
    exchanged once, at most, and nothing is grouped. A vertex without utilities fails the query. From :func:`share_bricks`
    a task looks up its pairs itself and exchanges none. ``digits`` is that of :func:`wide_utility`.
    """
    keys = [k for k in keys if k in beliefs.columns]
    if isinstance(bricks, Broadcast):
        return _by_shared_brick(beliefs, bricks, grid, n_joint, keys, digits)
    distances = F.array(*[F.lit(distance) for distance, _ in grid.corners])
    rows = beliefs.where(F.size("vertices") > 0).select(
        *keys, "vertices", F.get("vertices", F.lit(0))["state_idx"].alias("state_idx")
    )

    def add(total: Column, vertex: Column) -> Column:
        number = F.array_position(distances, vertex["state_idx"] - F.col("state_idx")).cast("int") - 1
        found = F.get("corners", number)
        state = vertex["state_idx"].cast("string")
        missing = F.raise_error(F.concat(F.lit("the utility table has no state "), state))
        u = F.when(found.isNull(), missing).otherwise(found)
        return F.zip_with(total, u, lambda t, x: t + x * vertex["w"])

    total = F.aggregate("vertices", F.array_repeat(F.lit(0.0), n_joint), add)
    q = rows.join(bricks, "state_idx", "left").select(*keys, total.alias("q"))
    return q if digits is None else wide_utility(q, digits, n_joint)


def _by_shared_brick(beliefs: DataFrame, bricks: Broadcast, grid: Grid, n_joint: int, keys: list[str], digits: int | None) -> DataFrame:
    rows = beliefs.where(F.size("vertices") > 0).select(*keys, "vertices")
    numbers = np.full(grid.corners[-1][0] + 1, -1)
    numbers[[distance for distance, _ in grid.corners]] = np.arange(len(grid.corners))
    schema = T.StructType([rows.schema[k] for k in keys] + _q_fields(n_joint, digits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, missing = bricks.value
        for batch in batches:
            if batch.num_rows:
                q = brick_sums(batch.column("vertices"), packed, missing, numbers)
                yield pa.RecordBatch.from_arrays([batch.column(k) for k in keys] + _q_columns(q, digits), names=schema.names)

    return rows.mapInArrow(run, schema)


def action_slice(q: Column, intr_action: Column, n_actions: int = N_ACTIONS) -> list[Column]:
    """Utilities of every own action against one intruder action."""
    return [F.get(q, F.lit(a * n_actions) + intr_action) for a in range(n_actions)]


def terminal_utility(action: int, n_actions: int = N_ACTIONS) -> float:
    return TERMINAL_CLEAR_UTILITY if action == n_actions - 1 else TERMINAL_ADVISORY_UTILITY


def fold_terminal(flights: DataFrame, worst: DataFrame, n_actions: int = N_ACTIONS) -> DataFrame:
    """Join the in-range minima to the roster and add the constants of out-of-range intruders.

    ``worst`` has ``(conflict_id, ord, n_in_range, u0..)``; aircraft without in-range intruder
    stay, aircraft alone in their group do not.
    """
    roster = filter_multi(flights.select("conflict_id", "flight_id", "ord"), keep_size=True)
    joined = roster.join(worst, ["conflict_id", "ord"], "left")
    far = F.col("n") - 1 > F.coalesce("n_in_range", F.lit(0))
    folded = [
        F.when(far, F.least(F.col(f"u{a}"), F.lit(terminal_utility(a, n_actions)))).otherwise(F.col(f"u{a}"))
        for a in range(n_actions)
    ]
    return joined.select("conflict_id", "flight_id", "ord", F.array(*folded).alias("utils"))


def worst_case(
    flights: DataFrame,
    pair_q: DataFrame,
    current: DataFrame | None = None,
    n_actions: int = N_ACTIONS,
) -> DataFrame:
    """``utils array<double>`` per aircraft: minimum over its intruders, per own action.

    ``current`` holds ``(conflict_id, ord, action_idx)``, the action each aircraft now flies;
    without it everyone is clear. The minimum is combined before the shuffle.
    """
    if current is None:
        acted = pair_q.withColumn("_ja", F.lit(n_actions - 1))
    else:
        intr = current.select("conflict_id", F.col("ord").alias("intr_ord"), F.col("action_idx").alias("_ja"))
        acted = pair_q.join(intr, ["conflict_id", "intr_ord"])
    sliced = action_slice(F.col("q"), F.col("_ja"), n_actions)
    worst = acted.groupBy("conflict_id", F.col("own_ord").alias("ord")).agg(
        F.count("*").alias("n_in_range"), *[F.min(c).alias(f"u{a}") for a, c in enumerate(sliced)]
    )
    return fold_terminal(flights, worst, n_actions)


def best_response(utils: DataFrame) -> DataFrame:
    """Add ``action_idx`` and ``util``: the first action that attains the largest utility."""
    best = F.array_max("utils")
    return utils.withColumn("action_idx", (F.array_position("utils", best) - 1).cast("int")).withColumn(
        "util", best
    )


def joint_utility(responses: DataFrame) -> DataFrame:
    """Sum of the utilities of each group."""
    return responses.groupBy("conflict_id").agg(
        F.sum("util").alias("joint_util"), F.count("*").alias("n_aircraft")
    )


__all__ = [
    "CLEAR_INDEX",
    "action_slice",
    "acted_utility",
    "best_response",
    "brick_table",
    "clear_utility",
    "fold_terminal",
    "grid_vertices",
    "joint_utility",
    "pair_belief",
    "pair_utility",
    "pair_utility_by_brick",
    "pair_utility_by_join",
    "round_half_up",
    "share_bricks",
    "share_states",
    "terminal_utility",
    "wide_utility",
    "worst_case",
]
