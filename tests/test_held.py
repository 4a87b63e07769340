"""The distributed search holds aircraft, not pairs, and gives the answers of the search in one task."""

import random

import numpy as np
import pytest

from aeroweave.fixtures import synthetic_utility
from aeroweave.functions import Grid
from aeroweave.functions.near import Fleet, Watch
from aeroweave.plans import resolve as resolve_module
from aeroweave.plans import resolve_conflicts


def _crowd(seed, n, box, copies):
    rng = random.Random(seed)
    rows = [("c", rng.uniform(-box, box), rng.uniform(-box, box), rng.uniform(0, 6.28), rng.uniform(9, 21)) for _ in range(n)]
    rows += rows[:copies] * 2
    rng.shuffle(rows)
    return rows


def test_rounds_hold_aircraft_and_no_pairs(make_flights, policy):
    """All in range of each other: as many rows as aircraft, where a row per pair would be 40 times as many."""
    trace = []
    flights = make_flights(_crowd(1, 40, 600, 0))
    got = resolve_conflicts(flights, policy, max_group_pairs=0, trace=trace)
    assert sorted(got.collect()) == sorted(resolve_conflicts(flights, policy).collect())
    held = trace[0]["edges"]
    assert held.count() == 40 and "q" not in held.columns


@pytest.mark.parametrize("copies, tile_edges", [(0, 10**6), (30, 10**6), (0, 40_000)])
def test_estimated_pairs_give_the_answers_of_one_task(make_flights, policy, monkeypatch, copies, tile_edges):
    """Enough pairs to be estimated, in several turns, with copies of a state and in several tiles."""
    monkeypatch.setattr(resolve_module, "TILE_EDGES", tile_edges)
    flights = make_flights(_crowd(2, 640, 3000, copies))
    got = resolve_conflicts(flights, policy, order="shuffle", seed=3, max_group_pairs=0, max_iter=3)
    assert sorted(got.collect()) == sorted(resolve_conflicts(flights, policy, order="shuffle", seed=3, max_iter=3).collect())


@pytest.mark.parametrize("n", [30, 200])
def test_watch_gives_the_minimum_over_what_is_seen(n):
    from aeroweave.functions.kernel import utilities
    from aeroweave.plans.resolve import _stacked

    rng = np.random.default_rng(n)
    lat, lon, heading, speed = rng.uniform(0, 4000, n), rng.uniform(0, 4000, n), rng.uniform(0, 6.28, n), rng.uniform(9, 21, n)
    fleet = Fleet(np.zeros(n, np.int64), lat, lon, heading, speed, np.cos(heading), np.sin(heading))
    table, cuts = synthetic_utility(), Grid().cuts
    stacked, screen = _stacked(table, 6, cuts)
    flown, own = rng.integers(0, 6, n), np.arange(n)
    watch = Watch(fleet, own, 6, screen)
    assert (watch._estimates is not None) == (n == 200)

    def seen(k, j):
        kept = np.flatnonzero(k != j)
        return kept, flown[j[kept]]

    asking = own[::3]
    i, j, points = fleet.pairs(own)
    q = utilities(points, cuts, table).reshape(-1, 6, 6)[np.arange(len(j)), :, flown[j]]
    want = np.array([q[i == a].min(axis=0, initial=np.inf) for a in asking])
    assert (watch.lowest(asking, seen, cuts, stacked) == want).all()
