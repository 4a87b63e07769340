"""Search in tasks, search by joins and a plain sequential search give the same answers."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from aeroweave.fixtures import synthetic_utility
from aeroweave.functions import near as near_module
from aeroweave.functions.angles import joint_action_index
from aeroweave.operators import best_response, brick_table, in_range_pairs, pair_belief, pair_utility_by_brick, pair_utility_by_join, worst_case
from aeroweave.operators import inside as inside_module
from aeroweave.operators.pairs import distinct_state_pairs
from aeroweave.plans import FunctionPolicy, Policy, StreamedPolicy, TablePolicy, maxmin, policy_sweep, resolve_conflicts, worst_cases
from aeroweave.plans import policy as policy_module
from aeroweave.plans import resolve as resolve_module
from aeroweave.plans.resolve import _large_groups
from aeroweave.plans.search import SHUFFLE_PRIME, sweep_factor
from aeroweave.plans import sweep as sweep_module
from aeroweave.plans.sweep import linear_range
from aeroweave.queries import SWEEP_METRES
from aeroweave.session import materialize
from brute import random_group, search

TABLE = synthetic_utility()


def groups_of(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    return groups


def as_dict(resolution):
    out = {}
    for r in resolution.collect():
        out[r.conflict_id, r.ord] = (r.action_idx, round(r.joint_util, 7), r.n_iter)
    return out


def expected(rows, table, orders=None):
    out = {}
    for conflict, members in groups_of(rows).items():
        if len(members) > 1:
            order_of = None if orders is None else (lambda sweep, c=conflict: orders(c, sweep))
            best, total, sweeps = search(members, table, order_of)
            out.update({(conflict, i): (a, round(total, 7), sweeps) for i, a in enumerate(best)})
    return out


@pytest.fixture(scope="module")
def scenario():
    rng = random.Random(11)
    rows = []
    for g in range(25):
        rows += random_group(rng, f"g{g:02d}", rng.randint(1, 9), rng.choice([800, 2500, 5000]))
    return rows + random_group(rng, "crowd", 24, 2500)


@pytest.mark.parametrize("max_group_pairs", [10**9, 60])
def test_resolve_matches_plain_search(make_flights, policy, scenario, max_group_pairs):
    got = as_dict(resolve_conflicts(make_flights(scenario), policy, max_group_pairs=max_group_pairs))
    assert got == expected(scenario, TABLE)


def test_bank_follows_the_action(make_flights, policy, scenario):
    for r in resolve_conflicts(make_flights(scenario), policy).collect():
        assert r.bank == policy.actions[r.action_idx] and not r.hit_cap


def test_shuffled_order_is_seeded_and_exact(spark, make_flights, policy, scenario):
    flights = make_flights(scenario)
    hashed = {
        (r.conflict_id, r.ord): r.r
        for r in flights.select("conflict_id", "ord", resolve_module._shuffle_hash("shuffle", 5).alias("r")).collect()
    }

    def orders(conflict, sweep):
        members = [o for c, o in hashed if c == conflict]
        factor = sweep_factor(5, sweep)
        return sorted(members, key=lambda o: (hashed[conflict, o] * factor % SHUFFLE_PRIME, o))

    want = expected(scenario, TABLE, orders)
    for limit in (10**9, 0):
        got = resolve_conflicts(flights.repartition(5), policy, order="shuffle", seed=5, max_group_pairs=limit)
        assert as_dict(got) == want


def test_large_group_in_order_ranges(make_flights, policy, monkeypatch):
    """The running total of a group is the same when it is cut into many position ranges."""
    monkeypatch.setattr(resolve_module, "BLOCK_ORDER_ROWS", 4)
    rows = random_group(random.Random(3), "big", 30, 4000)
    want = expected(rows, TABLE)
    assert as_dict(resolve_conflicts(make_flights(rows), policy, max_group_pairs=0)) == want


def test_sweep_cap_is_reported(make_flights, policy, scenario):
    for limit in (10**9, 0):
        got = resolve_conflicts(make_flights(scenario), policy, max_iter=1, max_group_pairs=limit).collect()
        assert all(r.n_iter == 1 and r.hit_cap for r in got)


def test_result_does_not_depend_on_partitions(make_flights, policy, scenario):
    flights = make_flights(scenario)
    assert as_dict(resolve_conflicts(flights.repartition(13), policy)) == as_dict(
        resolve_conflicts(flights.coalesce(1), policy)
    )


def test_eight_aircraft_scenario(make_flights, policy):
    pi = np.pi
    rows = [("s", 0, 0, 0, 10)] + [
        ("s", la, lo, pi, 10)
        for la, lo in ((200, 300), (200, -300), (600, 500), (600, -500), (1000, 800), (1000, -800), (1000, 0))
    ]
    assert as_dict(resolve_conflicts(make_flights(rows), policy)) == expected(rows, TABLE)


def test_everyone_out_of_range_stays_clear(make_flights, policy):
    rows = [("far", 10_000 * i, 0, 0, 10) for i in range(4)]
    got = resolve_conflicts(make_flights(rows), policy).collect()
    assert len(got) == 4 and all(r.action_idx == 5 and r.joint_util == 0.0 for r in got)


def test_table_too_large_to_broadcast_is_joined(make_flights, policy, scenario, monkeypatch):
    flights = make_flights(scenario)
    want = as_dict(resolve_conflicts(flights, policy))
    want_first = {(r.conflict_id, r.ord): r.action_idx for r in maxmin(flights, policy).collect()}
    monkeypatch.setattr(policy_module, "MAX_TABLE_BYTES", 0)
    joined = TablePolicy(TABLE)
    assert not joined.broadcastable
    assert {(r.conflict_id, r.ord): r.action_idx for r in maxmin(flights, joined).collect()} == want_first
    assert as_dict(resolve_conflicts(flights, joined)) == want


def test_maxmin_equals_composed_operators(spark, make_flights, policy, scenario):
    flights = make_flights(scenario)
    q = pair_utility_by_join(pair_belief(in_range_pairs(flights), policy.grid), policy.frame(spark))
    composed = best_response(worst_case(flights, q))
    got = {(r.conflict_id, r.ord): (r.action_idx, r.util) for r in composed.collect()}
    direct = {(r.conflict_id, r.ord): (r.action_idx, r.util) for r in maxmin(flights, policy).collect()}
    assert got.keys() == direct.keys()
    for key in got:
        assert got[key][0] == direct[key][0] and got[key][1] == pytest.approx(direct[key][1], abs=1e-12)


def test_bricks_give_the_sums_of_the_join(spark, make_flights, policy):
    rng = random.Random(8)
    rows = random_group(rng, "g", 40, 2500) + [("e", x, y, 0.0, v) for x in (-2000, 0, 2000) for y in (0, 400) for v in (0, 20, 30)]
    beliefs = pair_belief(in_range_pairs(make_flights(rows)), policy.grid)
    bricks = brick_table(policy.frame(spark), policy.grid)
    assert bricks.count() == policy.grid.length
    by_key = lambda df: {(r.conflict_id, r.own_ord, r.intr_ord): r.q for r in df.collect()}
    want = by_key(pair_utility_by_join(beliefs, policy.frame(spark)))
    assert want and by_key(pair_utility_by_brick(beliefs, bricks, policy.grid)) == want


def test_join_exchanges_a_pair_once(spark, make_flights, policy):
    """pairs go along with their weights; the table meets the distinct lists of vertices only."""
    beliefs = materialize(pair_belief(in_range_pairs(make_flights(random_group(random.Random(9), "g", 40, 2000))), policy.grid))
    table = materialize(policy.frame(spark))
    plan = pair_utility_by_join(beliefs, table)._jdf.queryExecution().optimizedPlan().toString()
    with_pairs = [line for line in plan.split("\n") if "own_ord" in line and ("Aggregate" in line or "Generate" in line)]
    assert not with_pairs and "Generate" in plan
    state = beliefs.selectExpr("vertices[1].state_idx as s").first().s
    with pytest.raises(Exception, match=f"has no state {state}"):
        pair_utility_by_join(beliefs, table.where(f"state_idx <> {state}")).collect()
    with pytest.raises(Exception, match="holds a state twice"):
        pair_utility_by_join(beliefs, table.union(table.where(f"state_idx = {state}"))).collect()


def test_bricks_are_joined_once_and_complete(spark, make_flights, policy):
    beliefs = pair_belief(in_range_pairs(make_flights([("g", 10, 20, 0.1, 12), ("g", 300, -50, 2.1, 14)])), policy.grid)
    written = materialize(brick_table(policy.frame(spark), policy.grid))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lean = materialize(beliefs)
        plan = pair_utility_by_brick(lean, written, policy.grid)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.count("Exchange hashpartitioning") == 2 and "Aggregate" not in plan  # one of pairs, one of the table
    state = beliefs.selectExpr("vertices[3].state_idx as s").first().s
    short = brick_table(policy.frame(spark).where(f"state_idx <> {state}"), policy.grid)
    with pytest.raises(Exception, match=f"has no state {state}"):
        pair_utility_by_brick(beliefs, short, policy.grid).collect()
    twice = policy.frame(spark).union(policy.frame(spark).where("state_idx = 7"))
    with pytest.raises(Exception, match="DUPLICATED_MAP_KEY"):
        brick_table(twice, policy.grid).collect()


def test_copies_of_a_state_are_collapsed(make_flights, policy, monkeypatch):
    """A crowd at one state costs one pair; the answers equal those of the full pair list."""
    rng = random.Random(4)
    rows = random_group(rng, "g", 25, 3000) + [("g", 10.0, -20.0, 1.0, 12.0)] * 60
    rows += [("h", 5.0, 5.0, 1.0, 15.0)] * 3 + [("g", 9000.0, 9000.0, 1.0, 12.0)] * 2
    flights = make_flights(rows)
    want = {(r.conflict_id, r.ord): r.utils for r in maxmin(flights, policy).collect()}
    got = {(r.conflict_id, r.ord): r.utils for r in maxmin(flights, policy, block_rows=20).collect()}
    assert got == want and len(got) == len(rows)
    states, pairs = distinct_state_pairs(flights, 20)
    assert states.count() == 28 and pairs.count() < 28 * 28
    full = in_range_pairs(flights)
    assert pairs.join(states.withColumnRenamed("ord", "own_ord"), ["conflict_id", "own_ord"]).selectExpr(
        "sum(intruders * copies)"
    ).first()[0] == full.count()


def test_first_action_wins_ties(spark):
    df = spark.createDataFrame([([-0.5, -0.25, -0.25, -1.0, -0.25, -0.5],)], "utils array<double>")
    r = best_response(df).first()
    assert (r.action_idx, r.util) == (1, -0.25)


def test_joint_index_is_row_major(spark):
    df = spark.createDataFrame([(o, i) for o in range(6) for i in range(6)], "o int, i int")
    got = [r[0] for r in df.select(joint_action_index(F.col("o"), F.col("i"))).collect()]
    assert got == list(range(36))


def test_function_policy(make_flights, policy, scenario):
    rule = FunctionPolicy(lambda group: (group["speed"] > 15).astype(int).to_numpy())
    assert isinstance(rule, Policy) and isinstance(policy, Policy)
    got = {(r.conflict_id, r.ord): r.action_idx for r in rule.resolve(make_flights(scenario)).collect()}
    want = {
        (c, i): int(m[4] > 15) for c, ms in groups_of(scenario).items() if len(ms) > 1 for i, m in enumerate(ms)
    }
    assert got == want


def test_worst_cases_equal_the_pairwise_ones(make_flights, policy, scenario):
    flights = make_flights(scenario)
    current = flights.select("conflict_id", "ord", (F.col("ord") % 6).cast("int").alias("action_idx"))
    lean = worst_cases(flights, policy, current)
    full = worst_case(flights, policy.pair_q(in_range_pairs(flights)), current)
    assert lean.exceptAll(full.select(*lean.columns)).isEmpty() and lean.count() == full.count() > 0
    plan = lean._jdf.queryExecution().executedPlan().toString()
    assert not any("array" in line for line in plan.split("\n") if "Exchange" in line)


def test_function_policy_gets_every_group(make_flights, scenario):
    seen = FunctionPolicy(lambda g: np.full(len(g), len(g) % 6)).resolve(make_flights(scenario)).collect()
    sizes = {c: len(m) for c, m in groups_of(scenario).items() if len(m) > 1}
    assert {r.conflict_id: r.action_idx for r in seen} == {c: n % 6 for c, n in sizes.items()}


@pytest.fixture
def counting():
    """Makes rules that remember how many aircraft of their group came before."""

    def make():
        seen = []

        def rule(flight):
            seen.append(flight["ord"])
            return (len(seen) - 1) % 6

        return rule

    return make


def test_streamed_policy_sees_a_group_in_order(make_flights, scenario, spark, counting):
    policy = StreamedPolicy(counting)
    flights = make_flights(scenario).withColumn("action_idx", F.lit("clash"))
    want = {(c, i): i % 6 for c, ms in groups_of(scenario).items() if len(ms) > 1 for i in range(len(ms))}
    got = policy.resolve(flights.repartition(5, "speed"))
    assert isinstance(policy, Policy) and {(r.conflict_id, r.ord): r.action_idx for r in got.collect()} == want
    policy.register(spark, "counted")
    flights.createOrReplaceTempView("flights_of_test")
    assert spark.sql("SELECT * FROM counted(TABLE(flights_of_test))").count() == len(want)
    assert policy.resolve(flights.where("false")).count() == 0
    unnamed = flights.withColumn("ord", F.monotonically_increasing_id()).withColumn("conflict_id", F.lit(None).cast("string"))
    assert policy.resolve(unnamed).count() == len(scenario)


@pytest.mark.parametrize("broken, message", [("drop", "lack"), ("repeat", "not unique")])
def test_streamed_policy_rejects_bad_flights(make_flights, scenario, counting, broken, message):
    flights = make_flights(scenario)
    flights = flights.drop("speed") if broken == "drop" else flights.withColumn("ord", F.lit(0).cast("bigint"))
    with pytest.raises(Exception, match=message):
        StreamedPolicy(counting).resolve(flights).collect()


def test_sparse_group_is_bounded_by_its_aircraft(spark, policy):
    """A wide lattice has no pairs in range, but still too many aircraft for one task."""
    lattice = spark.range(3000).selectExpr(
        "'far' AS conflict_id", "concat('f', id) AS flight_id", "id AS ord", "id * 9000D AS lat", "0D AS lon", "0D AS heading", "10D AS speed"
    )
    large, _ = _large_groups(lattice, 1000, 500)
    assert [r.conflict_id for r in large.collect()] == ["far"]
    got = resolve_conflicts(lattice, policy, max_group_pairs=1000)
    want = resolve_conflicts(lattice, policy, max_group_pairs=10_000_000)
    assert got.exceptAll(want).isEmpty() and got.count() == 3000


def test_joined_table_must_be_whole(spark, policy, make_flights, scenario, monkeypatch):
    from aeroweave.plans import policy as module
    from aeroweave.plans import TablePolicy

    whole = policy.frame(spark).cache()
    monkeypatch.setattr(module, "MAX_TABLE_BYTES", 0)
    flights = make_flights(scenario)
    for broken in (whole.where("state_idx % 2 = 0"), whole.withColumn("u", F.transform("u", lambda x: x * float("nan")))):
        with pytest.raises(Exception, match="state_idx|numbers"):
            resolve_conflicts(flights, TablePolicy(broken)).collect()
    got = resolve_conflicts(flights, TablePolicy(whole))
    monkeypatch.undo()
    want = resolve_conflicts(flights, policy)
    assert got.select("conflict_id", "ord", "action_idx").exceptAll(want.select("conflict_id", "ord", "action_idx")).isEmpty()


def test_policy_sweep_three_aircraft(make_flights, policy):
    pi = np.pi
    fleet = [("s", 0, 0, 0, 10), ("s", 1000, 800, pi, 10), ("s", 1000, -800, pi, 10)]
    axis = linear_range(-2500.0, 2500.0, 6)
    cells = policy_sweep(make_flights(fleet), axis, axis, policy).collect()
    assert len(cells) == 6 * 6 * 3
    for r in cells:
        moved = [("s", axis[r.ix], axis[r.iy], 0, 10)] + fleet[1:]
        assert r.action_idx == search(moved, TABLE)[0][r.ord]
        assert r.shade == (0.05 if r.action_idx == 5 else policy.actions[r.action_idx])


def test_policy_sweep_matches_cells_resolved_one_by_one(make_flights, policy, scenario, monkeypatch):
    """Shared pairs, runs of cells, several or no moved aircraft and large scenarios give what separate groups give."""
    flights = make_flights(scenario)
    lats, lons = linear_range(-2500.0, 2500.0, 3), linear_range(-2000.0, 2000.0, 4)
    swept = F.col("ord") % 5 == 1
    want = sorted(sweep_module._sweep_groups(flights, lats, lons, policy, swept).collect())
    assert want and sorted(policy_sweep(flights, lats, lons, policy, swept).collect()) == want
    monkeypatch.setattr(sweep_module, "BATCH_PAIRS", 50)
    assert sorted(policy_sweep(flights, lats, lons, policy, swept, 200, 300).collect()) == want


def test_policy_sweep_finds_unmoved_pairs_once(make_flights, policy, monkeypatch):
    """The reference's scenario at its resolution: the join on cells sees the unmoved aircraft once."""
    pi, seen = np.pi, []
    fleet = [("s", 0, 0, 0, 10), ("s", 1000, 800, pi, 10), ("s", 1000, -800, pi, 10)]
    found = sweep_module.pairs_within
    monkeypatch.setattr(sweep_module, "pairs_within", lambda f, *a: (seen.append(f.count()), found(f, *a))[1])
    axis = linear_range(-2500.0, 2500.0, 100)
    cells = policy_sweep(make_flights(fleet), axis, axis, policy).collect()
    assert len(cells) == 100 * 100 * 3 and seen == [2]
    for r in cells[::61]:
        assert r.action_idx == search([("s", axis[r.ix], axis[r.iy], 0, 10)] + fleet[1:], TABLE)[0][r.ord]


def test_crowded_cell_has_an_edge_per_aircraft(make_flights, policy):
    """Copies of few states: rows of pairs grow with aircraft, not with their square, and answers stay those of the tasks."""
    def crowd(copies):
        rows = [("c", 0, 0, 0.5, 12)] * copies + [("c", 300, -200, 2.0, 15)] * copies + [("c", 900, 400, 4.0, 18)]
        return make_flights(rows + [("g", 250 * i, -150 * i, i, 11) for i in range(6)])

    edges = {}
    for copies in (30, 120):
        trace = []
        got = resolve_conflicts(crowd(copies), policy, max_group_pairs=0, max_iter=1, trace=trace)
        assert sorted(got.collect()) == sorted(resolve_conflicts(crowd(copies), policy, max_iter=1).collect())
        edges[copies] = trace[0]["edges"].count()
    assert edges[120] < 4.2 * edges[30] and edges[120] < 4 * 2 * 120


def test_only_aircraft_behind_a_change_answer_again(spark, policy, monkeypatch):
    """A chain of neighbours: what answers in a sweep stays below aircraft times rounds."""
    monkeypatch.setattr(resolve_module, "FRONTIER_FROM", 0)
    chain = spark.range(2000).repartition(4).selectExpr(
        "'chain' as conflict_id", "concat('f', id) as flight_id", "id as ord", "cast(1500 * id as double) as lat", "cast(id % 7 * 90 as double) as lon",
        "(id * 37) % 628 / 100.0D as heading", "10 + (id * 13) % 100 / 10.0D as speed",
    )
    trace = []
    got = resolve_conflicts(chain, policy, max_group_pairs=0, max_iter=1, trace=trace)
    assert sorted(got.collect()) == sorted(resolve_conflicts(chain, policy, max_iter=1).collect())
    for sweep in trace:
        rounds = sweep["answered"]
        assert rounds[0] == 2000 and len(rounds) > 1 and sum(rounds) < 0.7 * 2000 * len(rounds)


@pytest.mark.parametrize("limit", [0, 10**9])
def test_a_repeated_position_raises(make_flights, policy, limit):
    flights = make_flights([("g", 100 * i, 50 * i, i, 12) for i in range(4)]).withColumn("ord", F.when(F.col("ord") > 0, F.col("ord") - 1).otherwise(0))
    with pytest.raises(Exception, match="ord is not unique"):
        resolve_conflicts(flights, policy, max_group_pairs=limit).collect()


def test_registered_sweep_covers_the_reference_square():
    assert SWEEP_METRES[0] == -2500.0 and SWEEP_METRES[-1] == 2500.0 and len(SWEEP_METRES) > 2


def test_small_groups_exchange_aircraft_not_pairs(make_flights, policy, scenario):
    """the pairs of a group are formed where it is searched; what is exchanged grows with the aircraft."""
    plan = resolve_conflicts(make_flights(scenario), policy)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" in plan and "own_ord" not in plan and "bearing" not in plan


def test_pairs_of_a_fleet_are_those_of_the_cells(make_flights, spark, monkeypatch):
    rng = random.Random(4)
    rows = [r for g, box in (("a", 900), ("b", 9000), ("c", 60_000)) for r in random_group(rng, g, 60, box)]
    rows += [("b", float("nan"), 0, 1, 12), ("d", 0, 0, 0, 10), ("d", 2000, -2000, 0, 10)]
    flights = make_flights(rows)
    want = {(p.conflict_id, p.own_ord, p.intr_ord): (p.x, p.y, p.bearing) for p in in_range_pairs(flights).collect()}
    held = flights.select("conflict_id", "ord", *inside_module.spread(flights)).orderBy("conflict_id", "ord").toArrow()
    names = held.column("conflict_id").to_pylist()
    monkeypatch.setattr(near_module, "CHUNK_PAIRS", 50)
    fleet = inside_module.fleet(held, np.unique(names, return_inverse=True)[1], np.arange(len(names)))
    ord_, got = held.column("ord").to_pylist(), {}
    for own, intr, points in fleet.chunks(np.arange(len(names))):
        got |= {(names[i], ord_[i], ord_[j]): tuple(p[:3]) for i, j, p in zip(own, intr, points)}
    assert got == want and ("d", 0, 1) in got
    assert fleet.candidates.sum() < 60 * 60 * 2 + 60 * 30


@pytest.mark.parametrize("rows, pairs", [(20_000, 50), (8, 50), (0, 50)])
def test_worst_cases_in_tasks_are_those_of_the_cells(make_flights, policy, scenario, monkeypatch, rows, pairs):
    """small groups stay in tasks, several for a group of many pairs, and nothing of a pair is exchanged."""
    flights = make_flights(scenario)
    current = flights.select("conflict_id", "ord", (F.col("ord") % 6).cast("int").alias("action_idx"))
    monkeypatch.setattr(resolve_module, "MAX_TASK_ROWS", rows)
    monkeypatch.setattr(resolve_module, "PART_PAIRS", pairs)
    acted, clear = worst_cases(flights, policy, current), maxmin(flights, policy)
    for got, flown in ((acted, current), (clear, None)):
        want = worst_case(flights, policy.pair_q(in_range_pairs(flights)), flown)
        assert got.select(*want.columns).exceptAll(want).isEmpty() and got.count() == want.count() > 0
        if rows > len(scenario):
            assert "own_ord" not in got._jdf.queryExecution().executedPlan().toString()
