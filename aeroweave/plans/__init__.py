"""Composed plans: policies, best response, search, advisories, sweeps."""

from .advise import advise, advisory_rows
from .policy import FunctionPolicy, Policy, TablePolicy, default_policy
from .resolve import maxmin, resolve_conflicts, worst_cases
from .sweep import policy_sweep, sweep_scenarios
from .table_function import StreamedPolicy

__all__ = [
    "FunctionPolicy",
    "Policy",
    "StreamedPolicy",
    "TablePolicy",
    "advise",
    "advisory_rows",
    "default_policy",
    "maxmin",
    "policy_sweep",
    "resolve_conflicts",
    "sweep_scenarios",
    "worst_cases",
]
