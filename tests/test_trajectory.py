"""Trajectory operators against a step-by-step computation."""

import math

import pytest
from pyspark.sql import functions as F

from aeroweave.functions import with_noise, wrap_angle
from aeroweave.operators import (
    NoiseModel,
    apply_advisories,
    project_state,
    project_straight,
    project_turn,
    rollout,
    unmatched_advisories,
)

NAMES = ("lat", "lon", "heading", "speed")


def wrap(a):
    return ((math.fmod(a, 2 * math.pi)) + 2 * math.pi) % (2 * math.pi)


def step(state, dt, rate, slices=4000):
    """Fly in many short straight slices, each along the heading in its middle."""
    lat, lon, heading, speed = state
    short = dt / slices
    for i in range(slices):
        middle = heading + rate * (i + 0.5) * short
        lat += speed * math.cos(middle) * short
        lon += speed * math.sin(middle) * short
    return lat, lon, wrap(heading + rate * dt), speed


@pytest.fixture(scope="module")
def fleet(spark):
    rows = [("a", 0.0, 0.0, 0.0, 10.0), ("b", 0.0, 0.0, 0.0, 15.0), ("c", 5.0, 5.0, 3.0, 0.0), ("d", 1.0, 2.0, 6.2, 12.0)]
    return spark.createDataFrame(rows, "flight_id string, lat double, lon double, heading double, speed double")


@pytest.fixture(scope="module")
def orders(spark):
    rows = [("a", False, 0.175, 5.0), ("b", False, -0.175, 5.0), ("c", False, None, 4.0), ("x", True, 0.0, 5.0)]
    return spark.createDataFrame(rows, "flight_id string, clear_of_conflict boolean, turn_rate double, period_s double")


RATES = {"a": (0.175, 5.0), "b": (-0.175, 5.0), "c": (0.0, 4.0), "d": (0.0, 3.0)}


def states(df):
    return {r.flight_id: tuple(r[n] for n in NAMES) for r in df.collect()}


def test_projections(fleet):
    start = states(fleet)
    for k, got in states(project_straight(fleet, 7.0)).items():
        assert got == pytest.approx(step(start[k], 7.0, 0))
    for k, got in states(project_turn(fleet, 7.0, -0.3)).items():
        assert got == pytest.approx(step(start[k], 7.0, -0.3))


def test_unknown_and_missing_advisories(fleet, orders):
    advised = apply_advisories(fleet, orders)
    assert advised.count() == 4 and advised.where("clear_of_conflict is null").count() == 1
    assert [r.flight_id for r in unmatched_advisories(fleet, orders).collect()] == ["x"]


def test_repeated_advisories_do_not_multiply_aircraft(fleet, orders):
    late = orders.withColumns({"event_ts": F.lit(2), "turn_rate": F.lit(0.5)})
    both = late.unionByName(orders.withColumn("event_ts", F.lit(1))).unionByName(late)
    advised = apply_advisories(fleet, both)
    assert advised.count() == 4 and advised.where("turn_rate = 0.5").count() == 3


def test_project_state_and_rollout_match_steps(fleet, orders):
    advised = apply_advisories(fleet, orders)
    start = states(fleet)
    after_one = states(project_state(advised, dt=3.0))
    path = {}
    for r in rollout(advised, 10, dt=3.0).collect():
        path[r.flight_id, r.step] = tuple(r[n] for n in NAMES)
    assert len(path) == 40
    for k, (rate, dt) in RATES.items():
        state = start[k]
        for i in range(1, 11):
            state = step(state, dt, rate)
            assert path[k, i] == pytest.approx(state, abs=1e-5)
        assert after_one[k] == pytest.approx(path[k, 1])


def test_folded_rollout_without_spread_equals_closed_form(fleet, orders):
    advised = apply_advisories(fleet, orders)
    still = NoiseModel(lat=("gaussian", 0.0, 0.0), turn_clear=("uniform", 0.0, 0.0))
    exact = {(r.flight_id, r.step): tuple(r[n] for n in NAMES) for r in rollout(advised, 6).collect()}
    folded = {(r.flight_id, r.step): tuple(r[n] for n in NAMES) for r in rollout(advised, 6, noise=still).collect()}
    assert exact.keys() == folded.keys()
    for k in exact:
        assert folded[k] == pytest.approx(exact[k], abs=1e-8)


def test_first_noisy_step_equals_projection_and_ignores_partitions(fleet, orders):
    noise = NoiseModel(
        lat=("gaussian", 0.0, 10.0), lon=("gaussian", 0.0, 10.0), heading=("gaussian", 0.0, 0.1),
        speed=("gaussian", 0.0, 1.0), turn_clear=("uniform", 0.0, 0.08), turn_conflict=("gaussian", 0.0, 0.02), seed=5,
    )
    advised = apply_advisories(fleet, orders)
    first = rollout(advised, 4, noise=noise).where("step = 1")
    assert states(first) == states(project_state(advised.repartition(7), noise=noise))
    assert states(first) != states(project_state(advised))


def test_noise_moments(spark):
    rows = spark.range(20_000).withColumn("g", F.lit(3.0)).withColumn("u", F.lit(0.0))
    noisy = with_noise(with_noise(rows, "g", "gaussian", 1.0, 2.0, 9, ["id"]), "u", "uniform", -1.0, 3.0, 9, ["id"])
    r = noisy.agg(F.mean("g"), F.stddev("g"), F.mean("u"), F.min("u"), F.max("u"), F.corr("g", "u")).first()
    assert r[0] == pytest.approx(4.0, abs=0.06) and r[1] == pytest.approx(2.0, abs=0.05)
    assert r[2] == pytest.approx(1.0, abs=0.04) and -1 <= r[3] and r[4] <= 3 and abs(r[5]) < 0.03
    again = with_noise(rows.repartition(3), "g", "gaussian", 1.0, 2.0, 9, ["id"])
    assert again.agg(F.sum("g")).first()[0] == pytest.approx(noisy.agg(F.sum("g")).first()[0])
    with pytest.raises(ValueError):
        with_noise(rows, "g", "laplace", 0.0, 1.0, 9, ["id"])


def test_wrap_angle(spark):
    cases = [0.0, -0.1, 7.0, -13.0, 2 * math.pi]
    df = spark.createDataFrame([(c,) for c in cases], "a double")
    got = [r[0] for r in df.select(wrap_angle(F.col("a"))).collect()]
    assert got == pytest.approx([wrap(c) for c in cases]) and all(0 <= g < 2 * math.pi for g in got)
