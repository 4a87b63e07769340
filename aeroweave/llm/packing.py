"""Packing of token sequences into windows by best-fit decreasing.

Documents are encoded once, per task; what is longer than a window is cut into full windows and a rest.
The cut pieces, not their ids, go to the shared folder. They are then dealt by hash into groups of
about ``GROUP_PIECES`` pieces, and each group is packed by itself: longest piece first, each into the
tightest open window, which a segment tree over the remaining capacities finds. Groups keep the
packing parallel; each costs at most one badly filled window.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .library_tokens import library_tokens
from .shared import stored

WINDOW = 2048
GROUP_PIECES = 2000
_PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"


class _OpenWindows:
    """Open windows by remaining capacity; the tree marks the capacities that some window has."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.tree = bytearray(2 * self.leaves)
        self.windows: dict[int, list[int]] = {}

    def add(self, capacity: int, number: int) -> None:
        held = self.windows.setdefault(capacity, [])
        held.append(number)
        if len(held) == 1:
            at = capacity + self.leaves
            while at and not self.tree[at]:
                self.tree[at] = 1
                at >>= 1

    def take(self, length: int) -> tuple[int, int] | None:
        """Number and capacity of the tightest window that holds ``length``, removed from the tree."""
        at = length + self.leaves
        if not self.tree[at]:
            # climb until a right neighbour holds something, then go down its left edge
            while at > 1 and (at & 1 or not self.tree[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at + (not self.tree[2 * at])
        capacity = at - self.leaves
        held = self.windows[capacity]
        number = held.pop()
        if not held:
            self.tree[at] = 0
            at >>= 1
            while at and not (self.tree[2 * at] or self.tree[2 * at + 1]):
                self.tree[at] = 0
                at >>= 1
        return number, capacity


def best_fit(lengths: list[int], window: int) -> tuple[list[int], list[int]]:
    """Window number and offset of each piece, given longest first."""
    open_windows, n = _OpenWindows(window), 0
    where, offset = [], []
    for length in lengths:
        got = open_windows.take(length) if length < window else None
        if got is None:
            got, n = (n, window), n + 1
        number, capacity = got
        where.append(number)
        offset.append(window - capacity)
        if capacity > length:
            open_windows.add(capacity - length, number)
    return where, offset


def cut_documents(documents: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``window`` ids: ``doc_id, start, length, ids_crc32, doc_tokens`` and, if asked for, ``ids``."""

    def encode(batches):
        library = library_tokens(tokenizer)
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            _, offsets = W.text_bytes(batch.column(1))
            for low, high in W.row_slices(offsets):
                part = batch.slice(low, high - low)
                rows: list[tuple] = []
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = library.ids(text or "") + end
                    total = len(ids) // 4
                    for start in range(0, total, window):
                        own = ids[4 * start : 4 * (start + window)]
                        rows.append((key, start, len(own) // 4, zlib.crc32(own), total, own))
                keys, starts, lengths, sums, totals, own = zip(*rows, strict=True)
                columns = [pa.array(x, pa.int64()) for x in (keys, starts, lengths, sums, totals)]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if with_ids:
                    flat = pa.array(np.frombuffer(b"".join(own), "<u4").astype(np.int32))
                    columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), flat))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return docs.mapInArrow(encode, _PIECE + (", ids array<int>" if with_ids else ""))


def pack(documents: DataFrame, tokenizer: str, end_id: int, window: int = WINDOW, with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its ``sequence_id`` and ``offset`` there.

    NULL and empty texts are the end id alone. Repeated rows and rows without an id are packed like any
    others and spread over the groups by their place in the written pieces; other columns are ignored; an empty table gives
    no rows. Sequence numbers are unique, not dense: the packing group is in the upper half.
    """
    pieces = stored(cut_documents(documents, tokenizer, end_id, window, with_ids), "pieces")
    n_groups = max(1, -(-pieces.count() // GROUP_PIECES))
    # the pieces are written, so a repeated task finds each at the same place
    place = F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id())
    group = F.pmod(place, F.lit(n_groups)).alias("group")

    def fill(table: pa.Table) -> pa.Table:
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        where, offset = best_fit(table.column("length").to_pylist(), window)
        first = table.column("group")[0].as_py() << 32
        return table.drop_columns("group").append_column("sequence_id", pa.array([first + w for w in where], pa.int64())).append_column(
            "offset", pa.array(offset, pa.int64())
        )

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return pieces.select("*", group).groupBy("group").applyInArrow(fill, f"{schema}, sequence_id bigint, offset bigint")


def sequences(packed: DataFrame, pad_id: int, window: int = WINDOW) -> DataFrame:
    """``sequence_id, ids`` padded to the window, from pieces packed ``with_ids``; each row is bounded by the window."""
    ordered = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    ids = F.flatten(F.transform(ordered, lambda p: p["ids"]))
    grouped = packed.groupBy("sequence_id").agg(ids.alias("ids"))
    return grouped.withColumn("ids", F.concat("ids", F.array_repeat(F.lit(pad_id), F.lit(window) - F.size("ids"))))
