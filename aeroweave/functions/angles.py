"""Angle, action and turn-rate expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import BANK_ANGLES, CLEAR, GRAVITY, N_ACTIONS, TWO_PI


def wrap_angle(angle: Column) -> Column:
    """Angle in radians folded into [0, 2*pi)."""
    return (angle % TWO_PI + TWO_PI) % TWO_PI


def joint_action_index(own_action: Column, intr_action: Column, n_actions: int = N_ACTIONS) -> Column:
    """0-based column of the utility table for an (ownship, intruder) action pair."""
    return (own_action * F.lit(n_actions) + intr_action).cast("int")


def action_value(action_idx: Column, actions: tuple[float, ...] = BANK_ANGLES) -> Column:
    """Bank angle of an action index."""
    return F.get(F.array(*[F.lit(a) for a in actions]), action_idx)


def turn_rate(bank: Column, speed: Column) -> Column:
    """Coordinated-turn rate in rad/s; 0 when clear, NULL when the speed is 0."""
    return F.when(bank == CLEAR, F.lit(0.0)).otherwise(
        F.try_divide(F.lit(GRAVITY) * F.tan(bank), speed)
    )
