"""Rectilinear grid of any dimension: multilinear interpolation as column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import ENCOUNTER_CUTS


@dataclass(frozen=True)
class Grid:
    """Cut points per axis; the first axis varies fastest in the point index."""

    cuts: tuple[tuple[float, ...], ...] = ENCOUNTER_CUTS

    def __post_init__(self):
        for axis in self.cuts:
            if len(axis) == 0 or any(a >= b for a, b in zip(axis, axis[1:])):
                raise ValueError("cut points must be non-empty and strictly increasing")

    @property
    def dimensions(self) -> int:
        return len(self.cuts)

    @property
    def length(self) -> int:
        return math.prod(len(axis) for axis in self.cuts)

    @property
    def strides(self) -> tuple[int, ...]:
        return tuple(math.prod(len(a) for a in self.cuts[:d]) for d in range(self.dimensions))

    @property
    def corners(self) -> tuple[tuple[int, tuple[int, ...]], ...]:
        """Corners of a cell: distance in ``state_idx`` from the lowest one, and the axes on which they lie above it."""
        wide = [d for d in range(self.dimensions) if len(self.cuts[d]) > 1]
        above = [axes for n in range(len(wide) + 1) for axes in combinations(wide, n)]
        return tuple(sorted((sum(self.strides[d] for d in axes), axes) for axes in above))

    def _cases(self, coord: Column, dim: int, edge) -> Column:
        """``edge(lo, hi, w_lo, w_hi)`` for the interval or cut that holds the coordinate.

        One flat CASE: nothing is computed twice, and the generated code stays short.
        """
        axis = self.cuts[dim]
        one, zero = F.lit(1.0), F.lit(0.0)
        cases = F.when(coord.isNull() | F.isnan(coord), None).when(
            coord <= axis[0], edge(0, 0, one, zero)
        )
        for i in range(1, len(axis)):
            low = 1.0 - (coord - axis[i - 1]) / (axis[i] - axis[i - 1])
            cases = cases.when(coord < axis[i], edge(i - 1, i, low, 1.0 - low))
            if i < len(axis) - 1:
                cases = cases.when(coord == axis[i], edge(i, i, one, zero))
        last = len(axis) - 1
        return cases.otherwise(edge(last, last, one, zero))

    def bracket(self, coord: Column, dim: int) -> Column:
        """``struct(lo, hi, w_lo, w_hi)``: the cuts around a coordinate, clamped at both ends."""

        def edge(lo: int, hi: int, w_lo: Column, w_hi: Column) -> Column:
            return F.struct(
                F.lit(lo).alias("lo"), F.lit(hi).alias("hi"), w_lo.alias("w_lo"), w_hi.alias("w_hi")
            )

        return self._cases(coord, dim, edge)

    def interpolants(self, coords: Sequence[Column]) -> Column:
        """``array<struct<state_idx,w>>`` with 1 to 2^d vertices; the weights sum to 1."""
        vertices = None
        for dim, (coord, stride) in enumerate(zip(coords, self.strides, strict=True)):
            vertices = self._extend(vertices, self._axis(coord, dim, stride))
        return vertices

    def _axis(self, coord: Column, dim: int, stride: int) -> Column:
        def vertex(cut: int, weight: Column) -> Column:
            return F.struct(F.lit(cut * stride).alias("state_idx"), weight.alias("w"))

        def edge(lo: int, hi: int, w_lo: Column, w_hi: Column) -> Column:
            if lo == hi:
                return F.array(vertex(lo, w_lo))
            return F.array(vertex(lo, w_lo), vertex(hi, w_hi))

        return self._cases(coord, dim, edge)

    @staticmethod
    def _extend(vertices: Column | None, axis: Column) -> Column:
        if vertices is None:
            return axis
        return F.flatten(
            F.transform(
                axis,
                lambda new: F.transform(
                    vertices,
                    lambda old: F.struct(
                        (old["state_idx"] + new["state_idx"]).alias("state_idx"),
                        (old["w"] * new["w"]).alias("w"),
                    ),
                ),
            )
        )

    def decode(self, idx: Column) -> Column:
        """Coordinates of a grid point index as ``array<double>``; NULL outside the grid."""
        inside = (idx >= 0) & (idx < self.length)
        coords = [
            F.get(
                F.array(*[F.lit(float(c)) for c in axis]),
                (F.floor(idx / F.lit(stride)) % len(axis)).cast("int"),
            )
            for axis, stride in zip(self.cuts, self.strides)
        ]
        return F.when(inside, F.array(*coords))

    def points(self, spark: SparkSession) -> DataFrame:
        """Every grid point: ``(state_idx, point)``."""
        idx = F.col("id").cast("int")
        return spark.range(self.length).select(idx.alias("state_idx"), self.decode(idx).alias("point"))

    @staticmethod
    def interpolate(vertices: Column, values: Column) -> Column:
        """Weighted value at the vertices of one point; ``values`` is an array column."""
        return F.aggregate(
            vertices, F.lit(0.0), lambda total, v: total + v["w"] * F.get(values, v["state_idx"])
        )

    def interpolate_by_join(
        self, vertices: DataFrame, values: DataFrame, keys: Sequence[str], out: str = "value"
    ) -> DataFrame:
        """Same sum with the values in a table ``(state_idx, value)``, for grids of any size.

        A vertex without a value fails the query; a point's vertices are added in their own order.
        """
        exploded = vertices.select(*keys, F.posexplode("vertices").alias("at", "v")).select(
            *keys, "at", F.col("v.state_idx").alias("state_idx"), F.col("v.w").alias("w")
        )
        missing = F.raise_error(F.concat(F.lit("no value for state "), F.col("state_idx").cast("string")))
        part = F.when(F.col("value").isNull(), missing).otherwise(F.col("w") * F.col("value"))
        met = exploded.join(values, "state_idx", "left").select(*keys, F.struct("at", part.alias("x")).alias("part"))
        listed = met.groupBy(*keys).agg(F.sort_array(F.collect_list("part")).alias("parts"))
        return listed.select(*keys, F.aggregate("parts", F.lit(0.0), lambda t, p: t + p["x"]).alias(out))
