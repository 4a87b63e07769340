"""Utilities as rounded columns."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from aeroweave.functions import Grid
from aeroweave.operators import (
    brick_table,
    in_range_pairs,
    pair_belief,
    pair_utility,
    pair_utility_by_brick,
    share_bricks,
    wide_utility,
)
from aeroweave.operators.utility import round_half_up
from aeroweave.queries import QUERIES, _rp
from tests.brute import random_group

SF = "/root/testdata/sf0.001"


def test_rounding_is_that_of_rows(spark):
    rng = np.random.default_rng(4)
    x = np.r_[rng.uniform(-1, 1, 500), np.arange(-40, 40) / 2e6, 0.0, -0.0, 4e-7, -4e-7, 1e9, -3.3e9 / 7, 12345678901.25, math.inf, -math.inf]
    got = round_half_up(x.reshape(-1, 1), 6)[:, 0]
    want = [r.y for r in spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "i int, x double").select("i", _rp("x").alias("y")).orderBy("i").collect()]
    assert got.tolist() == want and not np.signbit(got[got == 0]).any()
    assert np.isnan(round_half_up(np.array([[math.nan]]), 6)[0, 0])


def test_wide_utilities_are_rounded_in_batches(spark, make_flights, policy):
    """36 rounding expressions of a row made a method that was too long to be compiled."""
    pairs = in_range_pairs(make_flights(random_group(random.Random(3), "g", 25, 2000)))
    q = pair_utility(pairs, policy.table(spark), policy.grid)
    keyed = lambda df: {(r.own_ord, r.intr_ord): tuple(r)[-36:] for r in df.collect()}
    want = keyed(q.select("own_ord", "intr_ord", *[_rp(F.get("q", F.lit(j))).alias(f"q{j}") for j in range(36)]))
    assert want and keyed(wide_utility(q, 6)) == want
    assert keyed(pair_utility(pairs, policy.table(spark), policy.grid, 6)) == want
    nulls = q.limit(3).withColumn("q", F.transform("q", lambda v, j: F.when(j != 1, v)))
    assert all(r.q1 is None and r.q0 is not None for r in wide_utility(nulls, 6).collect())
    with pytest.raises(Exception, match="q must hold"):
        wide_utility(q.withColumn("q", F.slice("q", 1, 3)), 6).collect()


@pytest.mark.parametrize("name", ["pair_utility", "pair_utility_by_join", "pair_utility_by_brick"])
def test_no_query_of_pairs_rounds_by_expression(spark, name):
    rows = QUERIES[name](spark, SF)
    assert rows.columns[:3] == ["conflict_id", "own_ord", "intr_ord"]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "AS q35" not in plan and "FLOOR((abs" not in plan


def test_shared_bricks_give_the_sums_of_the_join(spark, make_flights, policy):
    """a task looks its pairs up in the packed table, so none is exchanged or added up number by number."""
    rows = random_group(random.Random(5), "g", 30, 2500) + [("e", x, y, 0.0, v) for x in (-2000, 0, 2000) for y in (0, 400) for v in (0, 20, 30)]
    beliefs = pair_belief(in_range_pairs(make_flights(rows)), policy.grid)
    bricks = brick_table(policy.frame(spark), policy.grid)
    shared = share_bricks(bricks, policy.grid)
    by_key = lambda df: {(r.conflict_id, r.own_ord, r.intr_ord): r.q for r in df.collect()}
    want = by_key(pair_utility_by_brick(beliefs, bricks, policy.grid))
    got = pair_utility_by_brick(beliefs, shared, policy.grid)
    assert want and by_key(got) == want and by_key(pair_utility_by_brick(beliefs.repartition(3), shared, policy.grid)) == want
    assert got.columns == ["conflict_id", "own_id", "own_ord", "intr_id", "intr_ord", "q"]
    state = beliefs.where("size(vertices) > 3").selectExpr("vertices[3].state_idx as s").first().s
    short = share_bricks(brick_table(policy.frame(spark).where(f"state_idx <> {state}"), policy.grid), policy.grid)
    with pytest.raises(Exception, match=f"has no state {state}"):
        pair_utility_by_brick(beliefs, short, policy.grid).collect()
    with pytest.raises(ValueError, match="each once"):
        share_bricks(bricks.union(bricks.where("state_idx = 7")), policy.grid)
    with pytest.raises(ValueError, match="too large"):
        share_bricks(bricks, Grid((tuple(range(200)),) * 2 + policy.grid.cuts[2:]))


def test_no_pair_meets_the_bricks_in_a_join(spark):
    plan = QUERIES["pair_utility_by_brick"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert "vertices" in plan and "corners" not in plan
