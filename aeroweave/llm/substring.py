"""Removal of word passages that an earlier document has, found through difference-cover anchors.

A cover ``D`` of the residues modulo ``v`` has, for any two positions ``i`` and ``j``, an offset below ``v``
that brings both onto ``D``. So two equal windows always share an aligned *anchor* of
``window - v + 1`` words that starts on the cover in both texts, although only ``|D| / v`` of all positions are
hashed. Shared anchors are then extended to the full windows around them.

Documents travel in *chunks*, packed rows of about ``CHUNK_BYTES`` text, written once to the
shared folder. Every exchange carries sorted, distinct hashes of a whole chunk, so a passage that a
third of all documents share costs one entry per chunk, and no row, task or join key grows
with the number of copies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import words as W
from .shared import stored

#: Smallest difference covers, perfect ones where they exist, by period.
COVERS = {7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (0, 1, 4, 14, 16), 31: (0, 1, 3, 8, 12, 18)}
CHUNK_BYTES = 8 << 20
#: Hashes that one reducing group holds, on average.
BUCKET = 1 << 18
#: Anchors only nominate, so a shorter hash does: a chance hit costs a look at one more window.
ANCHOR_BITS = 46
_U = np.uint64


def _ipc(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _read(blob: bytes) -> pa.RecordBatch:
    return pa.ipc.open_stream(blob).read_next_batch()


def _pack(values: np.ndarray) -> bytes:
    """Ascending numbers as 32-bit gaps where they fit."""
    if len(values) and (gaps := np.diff(values, prepend=values[:1])).max() < 2**32:
        return b"g" + values[:1].tobytes() + gaps.astype(np.uint32).tobytes()
    return b"r" + values.tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    if blob[:1] == b"r":
        return np.frombuffer(blob, np.uint64, offset=1)
    gaps = np.frombuffer(blob, np.uint32, offset=9).astype(np.uint64)
    return np.cumsum(gaps, dtype=np.uint64) + np.frombuffer(blob, np.uint64, 1, 1)


def _member(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which of ``values`` occur in the ascending ``known``."""
    if not len(known):
        return np.zeros(len(values), dtype=bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _cuts(values: np.ndarray, bits: int, n: int) -> np.ndarray:
    """Where each of ``n`` equal hash ranges begins among ascending ``values`` of ``bits`` bits."""
    bounds = [_U((b << bits) // n) for b in range(1, n)]
    return np.concatenate([[0], np.searchsorted(values, np.array(bounds, np.uint64)), [len(values)]]).astype(np.int64)


class _Chunk:
    """Words of a chunk; rows without an id take no part in any window."""

    def __init__(self, blob: bytes):
        batch = _read(blob)
        self.texts = batch.column(1)
        self.raw, self.offsets = W.text_bytes(self.texts)
        starts, ends, self.first = W.word_spans(self.raw, self.offsets)
        self.spans = starts, ends
        self.words = W.word_hashes(self.raw, starts, ends)
        self.named = np.asarray(batch.column(0).is_valid())
        self.ids = np.asarray(batch.column(0).fill_null(0))
        self.row = np.repeat(np.arange(len(self.named)), np.diff(self.first))

    def starts_of(self, width: int) -> np.ndarray:
        """Word positions where a run of ``width`` words of one document starts."""
        n = max(0, len(self.words) - width + 1)
        return np.flatnonzero(W.inside(self.first, width, n) & self.named[self.row[:n]])

    def anchors(self, window: int, period: int) -> tuple[np.ndarray, np.ndarray]:
        """Position and short hash of every anchor on the cover."""
        width = window - period + 1
        at = self.starts_of(width)
        at = at[np.isin(at % period, COVERS[period])]
        return at, W.window_hashes(self.words, width)[at] >> _U(64 - ANCHOR_BITS)

    def repeated(self, hashed: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Marks hashes that several documents of the chunk have."""
        order = np.lexsort((self.row[at], hashed))
        h, r = hashed[order], self.row[at][order]
        new = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        end = np.concatenate([new[1:], [len(h)]])[: len(new)]
        several = np.repeat(r[new] != r[end - 1], end - new)
        out = np.empty(len(h), dtype=bool)
        out[order] = several
        return out

    def candidates(self, window: int, period: int, shared: np.ndarray) -> np.ndarray:
        """Starts of windows around an anchor that another document may have too."""
        at, hashed = self.anchors(window, period)
        hit = at[_member(hashed, shared) | self.repeated(hashed, at)]
        mark = np.zeros(len(self.words), dtype=bool)
        for back in range(period):
            mark[hit[hit >= back] - back] = True
        starts = self.starts_of(window)
        return starts[mark[starts]]

    def earliest(self, window: int, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct window hashes in order, their second hashes, and the smallest id that has each."""
        hashed = W.window_hashes(self.words, window)[starts]
        checks = W.window_checks(self.words, window)[starts]
        ids = self.ids[self.row[starts]]
        order = np.lexsort((ids, checks, hashed))
        hashed, checks, ids = hashed[order], checks[order], ids[order]
        new = np.ones(len(order), dtype=bool)
        new[1:] = (hashed[1:] != hashed[:-1]) | (checks[1:] != checks[:-1])
        return hashed[new], checks[new], ids[new]

    def removed(self, window: int, period: int, shared: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        """Marks the words to drop: ``earlier`` holds windows that a document of another chunk starts first."""
        starts = self.candidates(window, period, shared)
        hashed = W.window_hashes(self.words, window)[starts]
        ids = self.ids[self.row[starts]]
        order = np.lexsort((ids, hashed))
        h = hashed[order]
        new = np.ones(len(h), dtype=bool)
        new[1:] = h[1:] != h[:-1]
        least = ids[order][new][np.cumsum(new) - 1]
        gone = np.zeros(len(h), dtype=bool)
        gone[order] = ids[order] > least
        gone |= _member(hashed, earlier)
        edge = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(edge, starts[gone], 1)
        np.add.at(edge, starts[gone] + window, -1)
        return np.cumsum(edge)[:-1] > 0

    def kept_texts(self, removed: np.ndarray, rejoin: bool) -> tuple[list, np.ndarray, np.ndarray]:
        """Kept words joined by a space (untouched texts stay as they are unless ``rejoin``), word counts, removed counts."""
        total = np.diff(self.first)
        lost = np.diff(np.concatenate([[0], np.cumsum(removed)])[self.first])
        out = []
        for i in range(len(total)):
            if not lost[i] and not rejoin:
                out.append(self.texts[i].as_py())
                continue
            parts = bytes(self.raw[self.offsets[i] : self.offsets[i + 1]]).split()
            if lost[i]:
                drop = removed[self.first[i] : self.first[i + 1]]
                parts = [w for w, gone in zip(parts, drop.tolist(), strict=True) if not gone]
            out.append(b" ".join(parts).decode())
        return out, total, lost


def _chunks(documents: DataFrame) -> DataFrame:
    """``chunk, n_words, docs, rest``: packed rows in the shared folder."""
    rest = [c for c in documents.columns if c not in ("doc_id", "text")]
    ordered = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *rest)

    def pack(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            raw, offsets = W.text_bytes(batch.column(1))
            for low, high in W.row_slices(offsets, CHUNK_BYTES):
                own = offsets[low : high + 1]
                n_words = len(W.word_spans(raw[own[0] : own[-1]], own - own[0])[0])
                part = batch.slice(low, high - low)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number]), pa.array([n_words], pa.int64()), pa.array([_ipc(part.select([0, 1]))]), pa.array([_ipc(part.select(range(2, part.num_columns)))])],
                    ["chunk", "n_words", "docs", "rest"],
                )
                number += 1

    return stored(ordered.mapInArrow(pack, "chunk bigint, n_words bigint, docs binary, rest binary"), "chunks", "none")


def _check(window: int, period: int) -> None:
    if period not in COVERS or period > window:
        raise ValueError(f"period must be one of {sorted(COVERS)} and at most the window")


def _shared_anchors(chunks: DataFrame, window: int, period: int, n_buckets: int) -> DataFrame:
    """``chunk, shared``: a chunk's anchors that some other chunk has."""

    def send(batches):
        for batch in batches:
            for number, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = np.unique(_Chunk(blob.as_py()).anchors(window, period)[1])
                cut = _cuts(found, ANCHOR_BITS, n_buckets)
                full = np.flatnonzero(np.diff(cut))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full), pa.array([number] * len(full), pa.int64()), pa.array([_pack(found[cut[b] : cut[b + 1]]) for b in full], pa.binary())],
                    ["bucket", "chunk", "anchors"],
                )

    def meet(table: pa.Table) -> pa.Table:
        lists = [_unpack(x.as_py()) for x in table.column("anchors")]
        both = np.sort(np.concatenate(lists))
        twice = np.unique(both[1:][both[1:] == both[:-1]])
        back = [x[_member(x, twice)] for x in lists]
        return pa.table(
            {"chunk": table.column("chunk"), "shared": pa.array([_pack(x) for x in back], pa.binary())}
        ).filter(pa.array([len(x) > 0 for x in back]))

    sent = chunks.select("chunk", "docs").mapInArrow(send, "bucket bigint, chunk bigint, anchors binary")
    return sent.groupBy("bucket").applyInArrow(meet, "chunk bigint, shared binary").groupBy("chunk").agg(F.collect_list("shared").alias("shared"))


def _earlier_windows(met: DataFrame, window: int, period: int, n_buckets: int) -> DataFrame:
    """``chunk, earlier``: a chunk's windows that a smaller id of another chunk starts."""

    def send(batches):
        for batch in batches:
            for number, blob, shared in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist(), strict=True):
                chunk = _Chunk(blob.as_py())
                starts = chunk.candidates(window, period, _joined(shared))
                hashed, checks, ids = chunk.earliest(window, starts)
                cut = _cuts(hashed, 64, n_buckets)
                full = np.flatnonzero(np.diff(cut))
                base = int(ids.min()) if len(ids) else 0
                wide = len(ids) and int(ids.max()) - base >= 2**32
                near = ids if wide else (ids - base).astype(np.uint32)
                each = lambda x: pa.array([x[cut[b] : cut[b + 1]].tobytes() for b in full], pa.binary())  # noqa: E731, B023
                yield pa.RecordBatch.from_arrays(
                    [pa.array(full), pa.array([number] * len(full), pa.int64()), pa.array([None if wide else base] * len(full), pa.int64()), each(hashed), each(checks), each(near)],
                    ["bucket", "chunk", "base", "hashes", "checks", "ids"],
                )

    def meet(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        hashes = [np.frombuffer(r["hashes"], np.uint64) for r in rows]
        checks = np.concatenate([np.frombuffer(r["checks"], np.uint32) for r in rows])
        ids = np.concatenate(
            [np.frombuffer(r["ids"], np.int64) if r["base"] is None else np.frombuffer(r["ids"], np.uint32).astype(np.int64) + r["base"] for r in rows]
        )
        hashed = np.concatenate(hashes)
        order = np.lexsort((ids, checks, hashed))
        new = np.ones(len(order), dtype=bool)
        h, c = hashed[order], checks[order]
        new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
        later = np.empty(len(order), dtype=bool)
        later[order] = ids[order] > ids[order][new][np.cumsum(new) - 1]
        ends = np.cumsum([len(x) for x in hashes])
        back = [x[later[e - len(x) : e]] for x, e in zip(hashes, ends, strict=True)]
        return pa.table(
            {"chunk": table.column("chunk"), "earlier": pa.array([_pack(np.unique(x)) for x in back], pa.binary())}
        ).filter(pa.array([len(x) > 0 for x in back]))

    sent = met.select("chunk", "docs", "shared").mapInArrow(
        send, "bucket bigint, chunk bigint, base bigint, hashes binary, checks binary, ids binary"
    )
    return sent.groupBy("bucket").applyInArrow(meet, "chunk bigint, earlier binary").groupBy("chunk").agg(F.collect_list("earlier").alias("earlier"))


def _joined(blobs: list[bytes] | None) -> np.ndarray:
    return np.sort(np.concatenate([_unpack(b) for b in blobs])) if blobs else np.zeros(0, np.uint64)


def _removal(documents: DataFrame, window: int, period: int, emit, schema: T.StructType | str) -> DataFrame:
    _check(window, period)
    chunks = _chunks(documents)
    total = chunks.agg(F.sum("n_words")).first()[0] or 0
    n_buckets = max(32, total * len(COVERS[period]) // period // BUCKET)
    shared = stored(_shared_anchors(chunks, window, period, n_buckets), "shared")
    met = chunks.join(shared, "chunk", "left")
    earlier = _earlier_windows(met, window, period, n_buckets)
    judged = chunks.join(shared, "chunk", "left").join(earlier, "chunk", "left").select("docs", "rest", "shared", "earlier")

    def finish(batches):
        for batch in batches:
            for docs, rest, near, first in zip(*(batch.column(i) for i in range(4)), strict=True):
                chunk = _Chunk(docs.as_py())
                gone = chunk.removed(window, period, _joined(near.as_py()), _joined(first.as_py()))
                yield emit(chunk, gone, docs.as_py(), rest.as_py())

    return judged.mapInArrow(finish, schema)


def repeat_report(documents: DataFrame, window: int = 13, period: int = 7) -> DataFrame:
    """``doc_id, n_words, n_removed, kept`` for every row of ``documents``.

    A word goes if some window of ``window`` consecutive words around it also starts in a document with
    a smaller ``doc_id``, judged on the input. ``kept`` is the other words joined by one space.

    NULL and empty texts have no words; texts shorter than the window lose nothing. Rows with equal ids
    do not remove from each other; rows without an id keep everything and remove nothing. Other columns are
    ignored; an empty table gives no rows.
    """

    def emit(chunk, gone, docs, rest):
        texts, total, lost = chunk.kept_texts(gone, rejoin=True)
        return pa.RecordBatch.from_arrays(
            [_read(docs).column(0), pa.array(total, pa.int64()), pa.array(lost, pa.int64()), pa.array(texts, pa.string())],
            ["doc_id", "n_words", "n_removed", "kept"],
        )

    schema = "doc_id bigint, n_words bigint, n_removed bigint, kept string"
    return _removal(documents.select("doc_id", "text"), window, period, emit, schema)


def drop_repeats(documents: DataFrame, window: int = 13, period: int = 7) -> DataFrame:
    """``documents`` with the repeated passages cut out of ``text``; rows, order of columns and other values stay.

    A text that loses nothing is left untouched, NULL included. Cases are as in :func:`repeat_report`.
    """
    names = documents.columns
    rest = [c for c in names if c not in ("doc_id", "text")]

    def emit(chunk, gone, docs, rest_blob):
        texts, _, _ = chunk.kept_texts(gone, rejoin=False)
        other = _read(rest_blob)
        found = {"doc_id": _read(docs).column(0), "text": pa.array(texts, pa.string())}
        found |= {c: other.column(i) for i, c in enumerate(rest)}
        return pa.RecordBatch.from_arrays([found[c] for c in names], names)

    fields = [T.StructField("doc_id", T.LongType()) if f.name == "doc_id" else T.StructField(f.name, f.dataType) for f in documents.schema]
    return _removal(documents, window, period, emit, T.StructType(fields))
