"""Relational operators on flight states, pairs and utilities."""

from .groups import assemble_conflict, encode_advisories, encode_status, filter_multi, group_sizes
from .latest import latest_state
from .pairs import in_range_pairs, is_terminal, ordered_pairs, pair_counts, relative_state
from .trajectory import (
    NoiseModel,
    apply_advisories,
    project_state,
    project_straight,
    project_turn,
    rollout,
    unmatched_advisories,
)
from .utility import (
    best_response,
    brick_table,
    grid_vertices,
    joint_utility,
    pair_belief,
    pair_utility,
    pair_utility_by_brick,
    pair_utility_by_join,
    share_bricks,
    share_states,
    wide_utility,
    worst_case,
)

__all__ = [
    "NoiseModel",
    "apply_advisories",
    "assemble_conflict",
    "best_response",
    "brick_table",
    "encode_advisories",
    "encode_status",
    "filter_multi",
    "grid_vertices",
    "group_sizes",
    "in_range_pairs",
    "is_terminal",
    "joint_utility",
    "latest_state",
    "ordered_pairs",
    "pair_belief",
    "pair_counts",
    "pair_utility",
    "pair_utility_by_brick",
    "pair_utility_by_join",
    "project_state",
    "project_straight",
    "project_turn",
    "relative_state",
    "rollout",
    "share_bricks",
    "share_states",
    "unmatched_advisories",
    "wide_utility",
    "worst_case",
]
