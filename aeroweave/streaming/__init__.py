"""Structured Streaming queries of the three stages."""

from .advise import advise_stream, start_advise
from .apply import apply_advisories_stream, join_in_force
from .ingest import assemble_stream, close_ingest, ingest_stream, late_reports, open_windows, start_ingest

from .parts import whole_messages

__all__ = [
    "advise_stream",
    "apply_advisories_stream",
    "assemble_stream",
    "close_ingest",
    "ingest_stream",
    "join_in_force",
    "late_reports",
    "open_windows",
    "start_advise",
    "start_ingest",
    "whole_messages",
]
