"""Trajectory operators: one projection step per row, or many steps, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.angles import wrap_angle
from ..functions.noise import draw

_STATE = ("lat", "lon", "heading", "speed")
_ADVISORY = ("clear_of_conflict", "turn_rate", "period_s")


@dataclass(frozen=True)
class NoiseModel:
    """``(kind, a, b)`` per disturbed quantity; None leaves the quantity exact.

    Draws depend on the seed, the values of ``keys`` and the step number, never on partitioning.
    """

    lat: tuple[str, float, float] | None = None
    lon: tuple[str, float, float] | None = None
    heading: tuple[str, float, float] | None = None
    speed: tuple[str, float, float] | None = None
    turn_clear: tuple[str, float, float] | None = None
    turn_conflict: tuple[str, float, float] | None = None
    seed: int = 0
    keys: tuple[str, ...] = ("flight_id",)

    def sample(self, name: str, step: Column) -> Column:
        spec = getattr(self, name)
        if spec is None:
            return F.lit(0.0)
        kind, a, b = spec
        return draw(kind, [*[F.col(k) for k in self.keys], step], a, b, self.seed, name)


def _straight(lat: Column, lon: Column, heading: Column, speed: Column, dt: Column) -> list[Column]:
    return [
        lat + speed * F.cos(heading) * dt,
        lon + speed * F.sin(heading) * dt,
        heading,
        speed,
    ]


def _turn(
    lat: Column, lon: Column, heading: Column, speed: Column, dt: Column, rate: Column
) -> list[Column]:
    """The velocity integrated over a heading that grows by ``rate`` every second."""
    reached = heading + rate * dt
    metres_per_radian = F.try_divide(F.abs(speed), rate)
    north = F.sin(reached) - F.sin(heading)
    east = F.cos(heading) - F.cos(reached)
    return [lat + metres_per_radian * north, lon + metres_per_radian * east, reached, speed]


def _move(state: Sequence[Column], dt: Column, rate: Column) -> list[Column]:
    """Straight flight at rate 0, else a constant-rate turn; the heading is not yet wrapped."""
    return [
        F.when(rate == 0.0, s).otherwise(t)
        for s, t in zip(_straight(*state, dt), _turn(*state, dt, rate))
    ]


def _replace(df: DataFrame, values: Sequence[Column]) -> DataFrame:
    lat, lon, heading, speed = values
    return df.withColumns({"lat": lat, "lon": lon, "heading": wrap_angle(heading), "speed": speed})


def _columns() -> list[Column]:
    return [F.col(c) for c in _STATE]


def project_straight(df: DataFrame, dt: float | Column) -> DataFrame:
    """Fly ``dt`` seconds straight ahead."""
    return _replace(df, _straight(*_columns(), _column(dt)))


def project_turn(df: DataFrame, dt: float | Column, rate: float | Column) -> DataFrame:
    """Fly ``dt`` seconds on an arc of turn rate ``rate`` (rad/s, not 0)."""
    return _replace(df, _turn(*_columns(), _column(dt), _column(rate)))


def _column(value: float | Column) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def apply_advisories(
    flights: DataFrame, advisories: DataFrame, on: Sequence[str] = ("flight_id",)
) -> DataFrame:
    """Attach each aircraft's advisory; aircraft without one keep NULLs.

    Of several advisories for one aircraft the latest by ``event_ts`` counts where there is such a column, and the
    largest by value among equals, so no aircraft is multiplied and the choice does not depend on the order of rows.
    """
    content = F.struct(*_ADVISORY)
    newest = F.struct(*([F.col("event_ts")] if "event_ts" in advisories.columns else []), *_ADVISORY)
    single = advisories.groupBy(*on).agg(F.max_by(content, newest).alias("_advisory")).select(*on, "_advisory.*")
    return flights.join(single, list(on), "left")


def unmatched_advisories(
    flights: DataFrame, advisories: DataFrame, on: Sequence[str] = ("flight_id",)
) -> DataFrame:
    """Advisories addressed to no known aircraft."""
    return advisories.join(flights.select(*on), list(on), "left_anti")


def _period(dt: float) -> Column:
    return F.coalesce(F.col("period_s"), F.lit(float(dt)))


def _rate(noise: NoiseModel | None, step: Column) -> Column:
    clear = F.col("clear_of_conflict")
    turn = F.coalesce(F.col("turn_rate"), F.lit(0.0))
    if noise is None:
        return F.when(clear.isNull() | clear, F.lit(0.0)).otherwise(turn)
    return F.when(clear.isNull() | clear, noise.sample("turn_clear", step)).otherwise(
        turn + noise.sample("turn_conflict", step)
    )


def _draws(noise: NoiseModel, step: Column) -> Column:
    """All random quantities of one step; they do not depend on the state."""
    return F.struct(
        _rate(noise, step).alias("rate"), *[noise.sample(n, step).alias(n) for n in _STATE]
    )


def _disturbed(state: Sequence[Column], dt: Column, draws: Column) -> list[Column]:
    moved = _move(state, dt, draws["rate"])
    return [m + draws[name] for m, name in zip(moved, _STATE)]


def project_state(df: DataFrame, dt: float = 5.0, noise: NoiseModel | None = None) -> DataFrame:
    """One step of every aircraft under the advisory that :func:`apply_advisories` attached.

    Clear or level advisories and missing ones drift straight on (or at the turn noise), others
    turn at their rate. ``dt`` seconds pass where no advisory names a period.
    """
    if noise is None:
        return _replace(df, _move(_columns(), _period(dt), _rate(None, F.lit(1))))
    drawn = df.withColumn("_draws", _draws(noise, F.lit(1)))
    return _replace(drawn, _disturbed(_columns(), _period(dt), F.col("_draws"))).drop("_draws")


def rollout(
    df: DataFrame, steps: int, dt: float = 5.0, noise: NoiseModel | None = None
) -> DataFrame:
    """``steps`` rows per aircraft, the advisory being supplied again at each step.

    Without noise, step k is one move of k periods: an arc stays the same arc. So every row is
    computed on its own. With noise the draws are made first, then the steps are folded in order
    inside the row.
    """
    if noise is None:
        rows = df.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
        return _replace(rows, _move(_columns(), _period(dt) * F.col("step"), _rate(None, F.lit(1))))

    names = list(_STATE)

    def as_struct(values: Sequence[Column]) -> Column:
        return F.struct(*[v.alias(n) for v, n in zip(values, names)])

    def advance(path: Column, draws: Column) -> Column:
        last = F.element_at(path, -1)
        lat, lon, heading, speed = _disturbed([last[n] for n in names], _period(dt), draws)
        return F.concat(path, F.array(as_struct([lat, lon, wrap_angle(heading), speed])))

    draws = F.transform(F.sequence(F.lit(1), F.lit(steps)), lambda step: _draws(noise, step))
    start = F.array(as_struct([F.col(n).cast("double") for n in names]))
    path = F.aggregate(draws, start, advance)
    rest = [c for c in df.columns if c not in names]
    rows = df.select(*rest, F.posexplode(F.slice(path, 2, steps)).alias("_pos", "_s"))
    return rows.select(*rest, *[F.col(f"_s.{n}") for n in names], (F.col("_pos") + 1).alias("step"))
