"""Grid decoding and interpolation against golden values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from aeroweave.functions import Grid
from aeroweave.functions.kernel import utilities, vertices
from aeroweave.operators import grid_vertices
from aeroweave.schemas import ENCOUNTER_CUTS
from brute import corners

# fixed values: golden cases of a 10 x 10 x 10 grid
CUTS = (
    tuple(float(v) for v in range(0, 10)),
    tuple(float(v) for v in range(10, 20)),
    tuple(float(v) for v in range(20, 30)),
)
DECODED = {
    0: (0, 10, 20),
    477: (7, 17, 24),
    320: (0, 12, 23),
    609: (9, 10, 26),
    647: (7, 14, 26),
    35: (5, 13, 20),
    562: (2, 16, 25),
    307: (7, 10, 23),
    184: (4, 18, 21),
    903: (3, 10, 29),
    841: (1, 14, 28),
    33: (3, 13, 20),
    397: (7, 19, 23),
    425: (5, 12, 24),
    779: (9, 17, 27),
    301: (1, 10, 23),
    524: (4, 12, 25),
    997: (7, 19, 29),
    535: (5, 13, 25),
    976: (6, 17, 29),
}
INTERPOLATED = [
    ((4.8, 16.9, 28.2), 893.8),
    ((0.8, 14.7, 24.4), 487.8),
    ((8.4, 18.9, 21.9), 287.4),
    ((4.9, 13.8, 24.7), 512.9),
    ((3.9, 12.4, 22.7), 297.9),
    ((2.9, 14.7, 26.4), 689.9),
    ((7.5, 14.9, 24.8), 536.5),
    ((6.6, 16.4, 23.1), 380.6),
    ((1.4, 14.9, 24.8), 530.4),
    ((1.6, 13.0, 23.7), 401.6),
    ((7.7, 11.2, 25.2), 539.7),
    ((8.2, 16.4, 20.1), 82.2),
    ((0.4, 13.4, 24.6), 494.4),
    ((3.4, 18.0, 20.3), 113.4),
    ((6.1, 10.6, 22.1), 222.1),
    ((8.9, 11.8, 26.7), 696.9),
    ((8.4, 12.9, 22.3), 267.4),
    ((6.6, 17.5, 25.9), 671.6),
    ((2.4, 16.3, 23.6), 425.4),
    ((0.9, 18.6, 28.8), 966.9),
]


def test_decode_golden(spark):
    grid = Grid(CUTS)
    df = spark.createDataFrame([(i,) for i in [*DECODED, -1, 1000]], "i int")
    got = {r.i: r.p for r in df.select("i", grid.decode(F.col("i")).alias("p")).collect()}
    assert got.pop(-1) is None and got.pop(1000) is None
    assert {k: tuple(v) for k, v in got.items()} == {k: tuple(map(float, v)) for k, v in DECODED.items()}


def test_interpolate_golden(spark):
    grid = Grid(CUTS)
    rows = [(i, *point, want) for i, (point, want) in enumerate(INTERPOLATED)]
    df = spark.createDataFrame(rows, "i int, a double, b double, c double, want double")
    df = df.withColumn("vertices", grid.interpolants([F.col("a"), F.col("b"), F.col("c")]))
    values = F.array(*[F.lit(float(v)) for v in range(1000)])
    for r in df.select("want", grid.interpolate(F.col("vertices"), values).alias("got")).collect():
        assert r.got == pytest.approx(r.want, abs=1e-6)
    table = spark.range(1000).select(F.col("id").cast("int").alias("state_idx"), F.col("id").cast("double").alias("value"))
    joined = grid.interpolate_by_join(df, table, ["i", "want"])
    for r in joined.collect():
        assert r.value == pytest.approx(r.want, abs=1e-6)


def test_a_missing_value_fails(spark):
    grid = Grid(((0.0, 2.0), (0.0, 1.0)))
    points = grid_vertices(spark.createDataFrame([(1, 1.0, 0.5)], "i int, a double, b double"), ["a", "b"], grid)
    whole = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 4.0), (3, 8.0)], "state_idx int, value double")
    assert grid.interpolate_by_join(points, whole, ["i"]).first().value == 3.75
    for values in (whole.where("state_idx <> 2"), whole.selectExpr("state_idx", "nullif(value, 4.0) as value")):
        with pytest.raises(Exception, match="no value for state 2"):
            grid.interpolate_by_join(points, values, ["i"]).collect()


def test_corners_of_a_cell():
    grid = Grid(((0.0, 1.0, 2.0), (5.0,), (0.0, 1.0)))
    assert grid.corners == ((0, ()), (1, (0,)), (3, (2,)), (4, (0, 2)))
    assert len(Grid().corners) == 32


def test_length_and_points(spark):
    grid = Grid()
    assert grid.length + 1 == 5446 and grid.dimensions == 5
    points = grid.points(spark)
    assert points.count() == 5445
    assert points.where("state_idx = 5444").first().point == [2000.0, 2000.0, 6.28319, 20.0, 20.0]
    with pytest.raises(ValueError):
        Grid(((1.0, 1.0),))


EDGES = [
    (-2000.0, 2000.0, -3.0, 5.0, 25.0),  # clamped everywhere
    (0.0, 400.0, 1.5708, 15.0, 10.0),  # every axis on a cut
    (-1999.9, 1.0, 6.28318, 19.99, 10.01),
    (123.4, -567.8, 2.2, 12.5, 17.5),
    (2000.0, -2000.0, 7.0, 20.0, 10.0),
]


def test_bracket_edges(spark):
    grid = Grid(((0.0, 1.0, 3.0),))
    cases = [-1.0, 0.0, 0.25, 1.0, 2.0, 3.0, 9.0, float("nan"), None]
    df = spark.createDataFrame([(c,) for c in cases], "c double")
    got = [r.b for r in df.select(grid.bracket(F.col("c"), 0).alias("b")).collect()]
    assert [tuple(b) if b else None for b in got] == [
        (0, 0, 1.0, 0.0),
        (0, 0, 1.0, 0.0),
        (0, 1, 0.75, 0.25),
        (1, 1, 1.0, 0.0),
        (1, 2, 0.5, 0.5),
        (2, 2, 1.0, 0.0),
        (2, 2, 1.0, 0.0),
        None,
        None,
    ]


def test_expression_kernel_and_brute_force_agree(spark):
    grid = Grid()
    df = spark.createDataFrame(EDGES, "x double, y double, bearing double, v_own double, v_int double")
    vertices_column = grid.interpolants([F.col(c) for c in df.columns])
    got = [
        {v.state_idx: v.w for v in r.v} for r in df.select(vertices_column.alias("v")).collect()
    ]
    index, weight = vertices(np.array(EDGES), ENCOUNTER_CUTS)
    rows = grid_vertices(df, df.columns, grid).collect()
    assert [[tuple(v) for v in r.vertices] for r in rows] == [list(g.items()) for g in got]
    for k, point in enumerate(EDGES):
        want = dict(corners(point))
        assert got[k] == pytest.approx(want)
        assert sum(got[k].values()) == pytest.approx(1.0)
        dense = np.zeros(grid.length)
        np.add.at(dense, index[:, k], weight[:, k])
        assert {int(i): dense[i] for i in np.flatnonzero(dense)} == pytest.approx(want)


def test_points_that_are_not_numbers_have_no_vertices(spark):
    df = spark.createDataFrame([(1.0, 0.5), (None, 0.5), (float("nan"), 0.5)], "a double, b double")
    got = grid_vertices(df, ["a", "b"], Grid(((0.0, 2.0), (0.0, 1.0)))).collect()
    assert [r.vertices is None for r in got] == [False, True, True]
    assert [tuple(v) for v in got[0].vertices] == [(0, 0.25), (1, 0.25), (2, 0.25), (3, 0.25)]


def test_kernel_slices_match_one_by_one():
    rng = np.random.default_rng(3)
    points = np.column_stack([rng.uniform(-2500, 2500, (3000, 2)), rng.uniform(-7, 7, 3000), rng.uniform(5, 25, (3000, 2))])
    table = rng.normal(size=(5446, 4))
    together = utilities(points, ENCOUNTER_CUTS, table)
    alone = np.concatenate([utilities(p[None], ENCOUNTER_CUTS, table) for p in points[::500]])
    assert np.array_equal(together[::500], alone)
