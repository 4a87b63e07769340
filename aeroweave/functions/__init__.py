"""Column expressions and the numpy kernel."""

from .angles import action_value, joint_action_index, turn_rate, wrap_angle
from .codec import advisory_struct, compact_number, flight_record, status_json
from .grid import Grid
from .noise import gaussian_draw, uniform_draw, with_noise

__all__ = [
    "Grid",
    "action_value",
    "advisory_struct",
    "compact_number",
    "flight_record",
    "gaussian_draw",
    "joint_action_index",
    "status_json",
    "turn_rate",
    "uniform_draw",
    "with_noise",
    "wrap_angle",
]
