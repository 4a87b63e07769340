"""Policies as SQL table functions: rows of a group stream through a rule, in position order."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.functions import AnalyzeResult, OrderingColumn, PartitioningColumn, SelectedColumn, udtf

from ..schemas import BANK_ANGLES, FLIGHT_STATE, RESOLUTION
from .resolve import REPEATED_ORD

#: Takes one flight state and gives its ``action_idx``; it may remember what it saw of the group.
Rule = Callable[[object], int]


def _handler(make_rule: Callable[[], Rule], actions: tuple[float, ...]):
    columns, schema = tuple(FLIGHT_STATE.names), RESOLUTION

    class Answers:
        """One per group. It holds one row back, because a group of one aircraft has no answer."""

        def __init__(self):
            self.rule, self.held, self.last = make_rule(), None, None

        @staticmethod
        def analyze(flights):
            if not flights.isTable:
                raise ValueError("a policy takes TABLE(flights)")
            missing = sorted(set(columns) - {f.name for f in flights.dataType.fields})
            if missing:
                raise ValueError(f"flight states lack {missing}")
            return AnalyzeResult(
                schema=schema,
                partitionBy=[PartitioningColumn("conflict_id")],
                orderBy=[OrderingColumn("ord")],
                select=[SelectedColumn(c) for c in columns],
            )

        def eval(self, flight):
            if self.last is not None and self.last == flight["ord"]:
                raise ValueError(REPEATED_ORD)
            self.last = flight["ord"]
            action = int(self.rule(flight))
            answer = (flight["conflict_id"], flight["flight_id"], flight["ord"], action, actions[action], float("nan"), 1, False)
            if self.held is not None:
                yield self.held
            self.many, self.held = self.held is not None, answer

        def terminate(self):
            if self.held is not None and self.many:
                yield self.held

    return udtf(Answers)


class StreamedPolicy:
    """A rule that answers the aircraft of a group one after the other.

    ``make_rule()`` gives a fresh rule for each group. Where :class:`FunctionPolicy` hands a whole group over, a rule sees it row
    by row, so a task holds one row and what the rule keeps, however large the group. Spark partitions the rows by
    ``conflict_id`` and sorts them by ``ord``, extra columns are left out, groups of one aircraft have no rows, and an ``ord`` that a
    group holds twice raises. Rows without ``conflict_id`` form a group.
    """

    def __init__(self, make_rule: Callable[[], Rule], actions: tuple[float, ...] = BANK_ANGLES):
        self.function = _handler(make_rule, tuple(actions))

    def register(self, spark: SparkSession, name: str) -> None:
        """From then on ``SELECT * FROM name(TABLE(flights))`` resolves conflicts in SQL."""
        spark.udtf.register(name, self.function)

    def resolve(self, flights: DataFrame) -> DataFrame:
        return self.function(flights.asTable())
