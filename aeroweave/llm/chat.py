"""Chat formatting from an event log.

The log is folded per message: deltas append, an edit replaces what came before, a regeneration starts
over. Folding is keyed by conversation and message, so a conversation with very many events is
still spread. The final messages of a conversation, in order, are then rendered with a template that marks
turns and escapes control strings inside texts, and can be read back.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|turn|>", "<|end|>"
_TURN = re.compile(r"<\|turn\|>([^\n]*)\n(.*?)<\|end\|>\n", re.DOTALL)
_ESCAPED = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    """Without ``<|`` inside, whatever the text holds."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


def render(turns: list[tuple[str, str]], learn: str = "assistant") -> tuple[str, list[int]]:
    """The formatted conversation and its loss mask as start, end, start, end, ... in characters."""
    out, mask, at = [], [], 0
    for role, text in turns:
        head = OPEN + escape(role).replace("\n", "\\n") + "\n"
        body = escape(text)
        if role == learn:
            mask += [at + len(head), at + len(head) + len(body)]
        out.append(head + body + CLOSE + "\n")
        at += len(out[-1])
    return "".join(out), mask


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts back from :func:`render`."""
    return [(unescape(role), unescape(body)) for role, body in _TURN.findall(formatted)]


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages ``conv_id, message, role, text`` from ``conv_id, message, seq, kind, role, text``.

    ``kind`` is ``start`` (role and first text), ``delta`` (appends), ``edit`` (replaces) or ``regenerate`` (drops the
    text so far; what it carries begins the new one). Events fold in ``seq`` order; ties by kind and text. The last role given
    counts. NULL texts append nothing; NULL or unknown kinds count as deltas. A message with no text is empty. Other columns are ignored.
    """
    resets = F.col("kind").isin("start", "edit", "regenerate")
    item = F.struct(F.col("seq"), resets.alias("late"), F.col("kind"), F.coalesce("text", F.lit("")).alias("text"), F.col("role"))
    grouped = events.groupBy("conv_id", "message").agg(F.sort_array(F.collect_list(item)).alias("log"))
    # everything from the last reset on
    cut = F.expr("array_max(transform(log, (e, i) -> if(coalesce(e.late, false), i, 0)))")
    kept = F.slice("log", cut + 1, F.size("log"))
    roles = F.filter(F.transform("log", lambda e: e["role"]), lambda r: r.isNotNull())
    return grouped.select(
        "conv_id",
        "message",
        F.get(F.reverse(roles), F.lit(0)).alias("role"),
        F.array_join(F.transform(kept, lambda e: e["text"]), "").alias("text"),
    )


def format_conversations(events: DataFrame, learn: str = "assistant") -> DataFrame:
    """``conv_id, formatted, loss_spans`` per conversation of an event log.

    Messages come in ``message`` order (NULL first, ties by role and text). A NULL role is an empty one. An empty log gives
    no rows; events without a conversation form one of their own.
    """
    turn = F.struct("message", F.coalesce("role", F.lit("")).alias("role"), "text")
    grouped = fold_events(events).groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))

    def run(batches):
        for batch in batches:
            made = [render([(t["role"], t["text"]) for t in turns]) for turns in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.list_(pa.int64()))],
                ["conv_id", "formatted", "loss_spans"],
            )

    return grouped.mapInArrow(run, "conv_id bigint, formatted string, loss_spans array<bigint>")


def read_back(formatted: DataFrame) -> DataFrame:
    """What the formatted text says: turn count, digest of roles and texts, learned characters and their digest."""

    def run(batches):
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = parse(text)
                whole = "".join(f"{role}\n{said}\n" for role, said in turns)
                learned = "".join(unescape(text[a:b]) for a, b in zip(spans[::2], spans[1::2], strict=True))
                digest = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
                rows.append((len(turns), digest(whole), len(learned), digest(learned), len(text)))
            columns = list(zip(*rows, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return formatted.select("conv_id", "formatted", "loss_spans").mapInArrow(run, schema)
