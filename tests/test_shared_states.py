"""pair_utility_by_join with a shared table: the sums of the join, and no pair is exchanged."""

import random

import pytest

from aeroweave import queries
from aeroweave.operators import in_range_pairs, pair_belief, pair_utility_by_join
from aeroweave.operators import utility as utility_module
from aeroweave.operators.utility import share_states
from aeroweave.session import materialize
from brute import random_group


def _beliefs(make_flights, policy):
    rows = random_group(random.Random(9), "g", 40, 2000) + [("e", x, y, 0.0, v) for x in (-2000, 0, 2000) for y in (0, 400) for v in (0, 30)]
    return materialize(pair_belief(in_range_pairs(make_flights(rows)), policy.grid))


def test_shared_table_gives_the_sums_of_the_join(spark, make_flights, policy):
    beliefs, table = _beliefs(make_flights, policy), policy.frame(spark)
    by_key = lambda df: {(r.conflict_id, r.own_ord, r.intr_ord): r.q for r in df.collect()}
    got = pair_utility_by_join(beliefs, share_states(table.repartition(3)))
    want = by_key(pair_utility_by_join(beliefs, table))
    assert want and by_key(got) == want
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()


def test_shared_table_must_be_whole(spark, make_flights, policy, monkeypatch):
    beliefs, table = _beliefs(make_flights, policy), policy.frame(spark)
    state = beliefs.where("size(vertices) > 1").selectExpr("vertices[1].state_idx as s").first().s
    with pytest.raises(Exception, match=f"has no state {state}"):
        pair_utility_by_join(beliefs, share_states(table.where(f"state_idx <> {state}"))).collect()
    with pytest.raises(ValueError, match="holds a state twice"):
        share_states(table.union(table.where(f"state_idx = {state}")))
    monkeypatch.setattr(utility_module, "MAX_BRICK_BYTES", 10_000)
    with pytest.raises(ValueError, match="too large to broadcast"):
        share_states(table)


def test_the_registered_query_exchanges_aircraft_only(spark):
    """Before, each pair was exchanged with its list of vertices and their weights."""
    plan = queries.pair_utility_by_join_query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "vertices" in plan and "states#" not in plan
