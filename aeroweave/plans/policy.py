"""Conflict-resolution policies."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol, runtime_checkable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grid import Grid
from ..functions.kernel import POINT_COLUMNS
from ..operators.groups import filter_multi
from ..operators.utility import (
    acted_utility,
    action_slice,
    brick_table,
    clear_utility,
    pair_belief,
    pair_utility,
    pair_utility_by_brick,
)
from ..schemas import BANK_ANGLES, FLIGHT_STATE, RESOLUTION
from ..session import materialize
from ..sources.utility import UtilityShapeError, load_utility

#: Largest utility matrix that is sent to the Python workers; larger tables are joined.
MAX_TABLE_BYTES = 256 * 1024 * 1024


@runtime_checkable
class Policy(Protocol):
    """What a conflict-resolution algorithm provides."""

    def resolve(self, flights: DataFrame) -> DataFrame:
        """``flight_state`` rows in, ``resolution`` rows out, one per aircraft in a conflict."""


class TablePolicy:
    """Pair utilities from a precomputed table over a grid; see :func:`resolve_conflicts`.

    The table has one row per grid point and one for the terminal state, and one column per
    joint action. Its size is fixed by the grid and checked before it is broadcast.
    """

    def __init__(
        self,
        utility: DataFrame | np.ndarray,
        grid: Grid = Grid(),
        actions: tuple[float, ...] = BANK_ANGLES,
        order: str = "ord",
        seed: int = 0,
    ):
        self.grid = grid
        self.actions = tuple(actions)
        self.order = order
        self.seed = seed
        self.n_states = grid.length + 1
        self.n_joint = len(self.actions) ** 2
        self.utility = utility
        self._matrix = None
        self._shared: tuple[str, object] | None = None
        self._sound: SparkSession | None = None
        self._bricks: tuple[SparkSession, DataFrame] | None = None
        if isinstance(utility, np.ndarray):
            self._matrix = self._checked(utility)

    def _checked(self, matrix: np.ndarray) -> np.ndarray:
        if matrix.shape != (self.n_states, self.n_joint):
            raise UtilityShapeError(
                f"utility is {matrix.shape}, expected {(self.n_states, self.n_joint)}"
            )
        if np.isnan(matrix).any():
            raise UtilityShapeError("utility holds NaN")
        return np.ascontiguousarray(matrix, dtype=np.float64)

    def _check_frame(self) -> None:
        """The same demands on a table that is only joined, in one aggregate."""
        whole = (F.size("u") == self.n_joint) & ~F.exists("u", lambda x: x.isNull() | F.isnan(x))
        states = F.count_distinct("state_idx")
        rows, distinct, low, high, bad = self.utility.agg(
            F.count("*"), states, F.min("state_idx"), F.max("state_idx"), F.count_if(~F.coalesce(whole, F.lit(False)))
        ).first()
        if (rows, distinct, low, high) != (self.n_states, self.n_states, 0, self.n_states - 1):
            raise UtilityShapeError(f"state_idx must run from 0 to {self.n_states - 1}, each once")
        if bad:
            raise UtilityShapeError(f"utility rows must hold {self.n_joint} numbers")

    @property
    def broadcastable(self) -> bool:
        return self.n_states * self.n_joint * 8 <= MAX_TABLE_BYTES

    def table(self, spark: SparkSession):
        """The matrix as a Spark broadcast, fetched once per application."""
        if not self.broadcastable:
            raise ValueError("the table is too large to broadcast; join it instead")
        app = spark.sparkContext.applicationId
        if self._shared is None or self._shared[0] != app:
            if self._matrix is None:
                # bounded by the grid: at most n_states rows are fetched, one more shows an excess
                rows = self.utility.orderBy("state_idx").limit(self.n_states + 1).toArrow()
                index = rows.column("state_idx").to_numpy()
                if not np.array_equal(index, np.arange(self.n_states)):
                    raise UtilityShapeError(f"state_idx must run from 0 to {self.n_states - 1}")
                flat = rows.column("u").combine_chunks().flatten().to_numpy(zero_copy_only=False)
                if len(flat) != self.n_states * self.n_joint:
                    raise UtilityShapeError(f"utility rows must hold {self.n_joint} numbers")
                self._matrix = self._checked(flat.reshape(self.n_states, self.n_joint))
            self._shared = (app, spark.sparkContext.broadcast(self._matrix))
        return self._shared[1]

    def peak(self, spark: SparkSession) -> float:
        """Largest absolute utility."""
        if self.broadcastable:
            return float(np.abs(self.table(spark).value).max())
        return self.frame(spark).agg(F.max(F.array_max(F.transform("u", F.abs)))).first()[0]

    def frame(self, spark: SparkSession) -> DataFrame:
        """The table as ``(state_idx, u)``."""
        if isinstance(self.utility, DataFrame):
            if self._sound is not spark:
                self._check_frame()
                self._sound = spark
            return self.utility
        offsets = pa.array(np.arange(self.n_states + 1, dtype=np.int32) * self.n_joint)
        rows = pa.ListArray.from_arrays(offsets, pa.array(self._matrix.ravel()))
        return spark.createDataFrame(pa.table({"state_idx": np.arange(self.n_states), "u": rows}))

    def bricks(self, spark: SparkSession) -> DataFrame:
        """The table packed by grid cells, made once per session and kept in the shared folder."""
        if self._bricks is None or self._bricks[0] is not spark:
            self._bricks = (spark, materialize(brick_table(self.frame(spark), self.grid)))
        return self._bricks[1]

    def pair_q(self, pairs: DataFrame, digits: int | None = None) -> DataFrame:
        """Joint-action utilities ``q`` per in-range pair; with ``digits`` as columns ``q0, q1, ...``, rounded."""
        spark = pairs.sparkSession
        if self.broadcastable:
            return pair_utility(pairs, self.table(spark), self.grid, digits)
        keys = tuple(c for c in pairs.columns if c not in POINT_COLUMNS)
        return pair_utility_by_brick(
            pair_belief(pairs, self.grid), self.bricks(spark), self.grid, self.n_joint, keys, digits
        )

    def pair_clear(self, pairs: DataFrame) -> DataFrame:
        """Utilities ``u0..`` per in-range pair while the intruder is clear of conflict."""
        n = len(self.actions)
        if self.broadcastable:
            lean = pairs.drop("own_id", "intr_id", "intr_ord")
            return clear_utility(lean, self.table(pairs.sparkSession), self.grid, n)
        keep = [c for c in pairs.columns if c not in POINT_COLUMNS]
        q = self.pair_q(pairs)
        return q.select(
            *keep, *[F.get("q", F.lit(a * n + n - 1)).alias(f"u{a}") for a in range(n)]
        )

    def pair_acted(self, pairs: DataFrame) -> DataFrame:
        """Utilities ``u0..`` per in-range pair against the intruder's ``intr_action``."""
        n = len(self.actions)
        if self.broadcastable:
            return acted_utility(pairs, self.table(pairs.sparkSession), self.grid, n)
        keep = [c for c in pairs.columns if c not in (*POINT_COLUMNS, "own_action", "intr_action")]
        own = action_slice(F.col("q"), F.col("intr_action"), n)
        return self.pair_q(pairs).select(*keep, *[c.alias(f"u{a}") for a, c in enumerate(own)])

    def resolve(self, flights: DataFrame) -> DataFrame:
        from .resolve import resolve_conflicts

        return resolve_conflicts(flights, self, order=self.order, seed=self.seed)


class FunctionPolicy:
    """A user function per conflict group.

    ``fn`` gets one group as a pandas frame (``flight_state`` columns, in ``ord`` order) and
    returns one ``action_idx`` per row. Every group goes to ``fn``, whatever its size, so the largest
    one must fit in a task; where that is not given, use a policy of DataFrame operations.
    """

    def __init__(
        self,
        fn: Callable[[pd.DataFrame], "np.ndarray | list[int]"],
        actions: tuple[float, ...] = BANK_ANGLES,
    ):
        self.fn = fn
        self.actions = tuple(actions)

    def resolve(self, flights: DataFrame) -> DataFrame:
        columns = [f.name for f in FLIGHT_STATE]
        usable = filter_multi(flights.select(*columns))
        fn, actions = self.fn, np.asarray(self.actions)

        def answer(group: pd.DataFrame) -> pd.DataFrame:
            chosen = np.asarray(fn(group.reset_index(drop=True)), dtype=np.int32)
            return pd.DataFrame(
                {
                    "conflict_id": group["conflict_id"].to_numpy(),
                    "flight_id": group["flight_id"].to_numpy(),
                    "ord": group["ord"].to_numpy(),
                    "action_idx": chosen,
                    "bank": actions[chosen],
                    "joint_util": np.nan,
                    "n_iter": np.int32(1),
                    "hit_cap": False,
                }
            )

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            """Groups arrive one after the other; only the unfinished last one is held back."""
            held: list[pd.DataFrame] = []
            for batch in batches:
                if batch.empty:
                    continue
                ids = batch["conflict_id"].to_numpy()
                starts = np.flatnonzero(np.r_[True, ids[1:] != ids[:-1]])
                pieces = [batch.iloc[a:b] for a, b in zip(starts, np.r_[starts[1:], len(batch)])]
                done = []
                for piece in pieces:
                    if held and held[0]["conflict_id"].iat[0] != piece["conflict_id"].iat[0]:
                        done.append(answer(pd.concat(held)))
                        held = []
                    held.append(piece)
                if done:
                    yield pd.concat(done)
            if held:
                yield answer(pd.concat(held))

        sorted_groups = usable.repartition("conflict_id").sortWithinPartitions("conflict_id", "ord")
        return sorted_groups.mapInPandas(run, RESOLUTION)


def default_policy(spark: SparkSession, path: str, **options) -> TablePolicy:
    """Standard grid and actions with the utility table at ``path``; fails on a wrong shape."""
    grid = Grid()
    return TablePolicy(load_utility(spark, path, grid.length + 1), grid, **options)
