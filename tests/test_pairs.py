"""Pair search against brute force, with hot cells, borders and one dominant group."""

import math
import random

import pytest
from pyspark.sql import functions as F

from aeroweave.operators import filter_multi, in_range_pairs, latest_state, ordered_pairs, relative_state
from aeroweave.operators import pairs as pairs_module
from brute import local_state, random_group


def brute_pairs(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    out = {}
    for conflict, members in groups.items():
        for i, own in enumerate(members):
            for k, intr in enumerate(members):
                if i != k and local_state(own, intr) is not None:
                    out[conflict, i, k] = local_state(own, intr)
    return out


def collected(pairs):
    rows = pairs.collect()
    got = {(r.conflict_id, r.own_ord, r.intr_ord): (r.x, r.y, r.bearing, r.v_own, r.v_int) for r in rows}
    assert len(got) == len(rows), "a pair was found twice"
    return got


def check(got, want):
    assert got.keys() == want.keys()
    for key, state in want.items():
        assert got[key] == pytest.approx(state, abs=1e-6)


@pytest.mark.parametrize("block_rows", [None, 4096, 3])
def test_pairs_match_brute_force(make_flights, block_rows):
    rng = random.Random(5)
    rows = random_group(rng, "wide", 120, 9000)
    for g in range(15):
        rows += random_group(rng, f"g{g}", rng.randint(1, 6), 2500)
    check(collected(in_range_pairs(make_flights(rows), block_rows)), brute_pairs(rows))


def test_hot_cell_is_cut_into_blocks(make_flights):
    """Most of the rows in one cell: the blocks keep every pair exactly once."""
    rng = random.Random(6)
    rows = random_group(rng, "hot", 90, 600) + random_group(rng, "hot", 20, 12000)
    flights = make_flights(rows)
    hot = pairs_module.hot_cells(flights, 10)
    assert hot is not None and hot.agg(F.max("nb")).first()[0] >= 9
    check(collected(in_range_pairs(flights, 10)), brute_pairs(rows))


def test_hot_cells_beyond_the_broadcast_limit(make_flights, monkeypatch):
    monkeypatch.setattr(pairs_module, "MAX_BROADCAST_CELLS", 0)
    rows = random_group(random.Random(7), "hot", 60, 3000)
    check(collected(in_range_pairs(make_flights(rows), 5)), brute_pairs(rows))


def test_range_bounds_are_inclusive(make_flights):
    rows = [("e", 0, 0, 0, 10), ("e", 2000, -2000, 0, 10), ("e", 2000.001, 0, 0, 10), ("e", -2000, 2000, 0, 10)]
    got = collected(in_range_pairs(make_flights(rows)))
    assert {k[1:] for k in got if 0 in k[1:]} == {(0, 1), (1, 0), (0, 3), (3, 0)}


def test_range_depends_on_the_ownship_frame(make_flights):
    turned = math.pi / 4
    rows = [("a", 0, 0, 0, 10), ("a", 2400, 0, turned, 10)]
    got = collected(in_range_pairs(make_flights(rows)))
    assert {k[1:] for k in got} == {(1, 0)}


def test_relative_state_golden(spark):
    own = (2.0, 4.0, 3.0, math.sqrt(13.0))
    intr = (410.0, 4.5, 3.5, math.sqrt(400 + 1.54**2))
    names = [f"{s}_{c}" for s in ("own", "intr") for c in ("lat", "lon", "heading", "speed")]
    df = spark.createDataFrame([own + intr], ", ".join(f"{n} double" for n in names))
    r = relative_state(df).first()
    want = (-403.8463786089518, -58.07195953672605, 0.5, 3.605551275463989, 20.059202376964045)
    assert (r.x, r.y, r.bearing, r.v_own, r.v_int) == pytest.approx(want, abs=1e-6)


def test_bearing_is_wrapped_only_on_request(make_flights):
    flights = make_flights([("b", 0, 0, 3.0, 10), ("b", 10, 0, 1.0, 10)])
    assert min(r.bearing for r in in_range_pairs(flights).collect()) == pytest.approx(-2.0)
    wrapped = in_range_pairs(flights, wrap_bearing=True).collect()
    assert max(r.bearing for r in wrapped) == pytest.approx(2 * math.pi - 2.0)


def test_factored_pairs_cover_every_ordered_pair(make_flights):
    rows = random_group(random.Random(8), "f", 30, 4000) + [("alone", 0, 0, 0, 10)]
    near, counts = ordered_pairs(make_flights(rows))
    got = counts.collect()
    assert len(got) == 30 and all(r.n_pairs == 29 for r in got)
    assert sum(r.n_in_range for r in got) == near.count() == len(brute_pairs(rows))
    assert all(r.n_in_range + r.n_terminal == 29 for r in got)


def test_profile_bounds_the_pairs(make_flights):
    rows = random_group(random.Random(9), "p", 80, 7000) + random_group(random.Random(1), "q", 3, 500)
    profile = {r.conflict_id: r for r in pairs_module.group_profile(make_flights(rows)).collect()}
    want = brute_pairs(rows)
    for group, n in (("p", 80), ("q", 3)):
        assert profile[group].n == n
        assert profile[group].pair_bound >= sum(1 for k in want if k[0] == group)


def test_filter_multi_drops_single_aircraft(make_flights):
    rows = [("one", 0, 0, 0, 10), ("two", 0, 0, 0, 10), ("two", 1, 1, 0, 10)]
    assert {r.conflict_id for r in filter_multi(make_flights(rows)).collect()} == {"two"}


def test_latest_state_breaks_ties_by_sequence(spark):
    rows = [("c", "a", 1, 1, 10.0), ("c", "a", 2, 5, 20.0), ("c", "a", 2, 7, 30.0), ("c", "b", 1, 1, 1.0)]
    df = spark.createDataFrame(rows, "conflict_id string, flight_id string, event_ts int, seq int, lat double")
    got = {r.flight_id: r.lat for r in latest_state(df).collect()}
    assert got == {"a": 30.0, "b": 1.0}


def test_no_all_pairs_join_in_the_plan(make_flights):
    rows = random_group(random.Random(2), "g", 5, 100)
    plan = in_range_pairs(make_flights(rows))._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("rows", [20_000, 30, 0])
def test_counts_come_from_tasks(make_flights, monkeypatch, rows):
    """counts of groups that fit a task are made there, without a join of pairs, and are those of the pairs."""
    rng = random.Random(12)
    flights = make_flights(random_group(rng, "a", 40, 4000) + random_group(rng, "b", 20, 1500) + random_group(rng, "c", 1, 10))
    monkeypatch.setattr(pairs_module, "MAX_TASK_ROWS", rows)
    monkeypatch.setattr(pairs_module, "PART_PAIRS", 200)
    pairs, counts = ordered_pairs(flights)
    want = pairs_module.pair_counts(flights, pairs)
    assert counts.exceptAll(want).isEmpty() and counts.count() == 60
    assert ("intr" not in counts._jdf.queryExecution().optimizedPlan().toString()) == (rows == 20_000)
