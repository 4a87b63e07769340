"""Binary token store: concatenated ids with Elias-Fano document boundaries.

The store is a sequence of *segments* in ascending ``doc_id`` order. A segment is

``magic, width, n_docs, n_nameless, n_ids, local start, base`` | boundaries | document ids | ids

with ids in 16 or 32 bits. Boundaries (ends of documents) and document ids are ascending, so both are
Elias-Fano coded: low bits packed, high bits in unary, and a sample of every 256th set bit for select.
That takes about two bits more than the logarithm of the average gap, where a table would take 64.

Segments are binary values of a Parquet table, so Spark commits them, on any storage, and a lost
executor repeats only its own. They hold about ``SEGMENT_IDS`` ids; a longer document is one segment.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import words as W
from .library_tokens import library_tokens

SEGMENT_IDS = 1 << 20
_MAGIC = b"AWT1"
_HEAD = "<4sBIIQQq"
_EF_HEAD = "<QBQI"
_SAMPLE = 256


def ef_encode(values: np.ndarray) -> bytes:
    """Elias-Fano code of ascending unsigned numbers."""
    values = np.asarray(values, np.uint64)
    n = len(values)
    most = int(values[-1]) if n else 0
    low_bits = max(0, (most // n).bit_length() - 1) if n else 0
    low = values & np.uint64((1 << low_bits) - 1)
    if low_bits:
        bits = (low[:, None] >> np.arange(low_bits, dtype=np.uint64)) & np.uint64(1)
        packed = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()
    else:
        packed = b""
    ones = (values >> np.uint64(low_bits)).astype(np.int64) + np.arange(n)
    high = np.zeros(int(ones[-1]) + 1 if n else 0, np.uint8)
    high[ones] = 1
    unary = np.packbits(high, bitorder="little").tobytes()
    sample = ones[::_SAMPLE].astype("<u4").tobytes()
    return struct.pack(_EF_HEAD, n, low_bits, len(packed), len(unary)) + packed + unary + sample


class EliasFano:
    """Reads an Elias-Fano code: all values at once, or one of them through the select sample."""

    def __init__(self, data: memoryview):
        self.n, self.low_bits, n_low, n_unary = struct.unpack_from(_EF_HEAD, data)
        at = struct.calcsize(_EF_HEAD)
        self.low = np.frombuffer(data, np.uint8, n_low, at)
        self.unary = np.frombuffer(data, np.uint8, n_unary, at + n_low)
        self.sample = np.frombuffer(data, "<u4", -(-self.n // _SAMPLE), at + n_low + n_unary)
        self.size = at + n_low + n_unary + 4 * len(self.sample)

    def all(self) -> np.ndarray:
        ones = np.flatnonzero(np.unpackbits(self.unary, bitorder="little"))[: self.n]
        out = (ones - np.arange(self.n)).astype(np.uint64) << np.uint64(self.low_bits)
        if self.low_bits:
            bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits)
            out |= (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return out

    def __getitem__(self, i: int) -> int:
        if not 0 <= i < self.n:
            raise IndexError(i)
        block, left = divmod(i, _SAMPLE)
        start = int(self.sample[block])
        stop = int(self.sample[block + 1]) if block + 1 < len(self.sample) else 8 * len(self.unary)
        # the wanted bit is the (left + 1)-th set one from the sampled bit on: halve the span by counting
        span = int.from_bytes(self.unary[start // 8 : -(-stop // 8)].tobytes(), "little") >> (start % 8)
        one, size = start, 1 << (stop - start).bit_length()
        while size > 1:
            size >>= 1
            lower = span & ((1 << size) - 1)
            if (ones := lower.bit_count()) <= left:
                left, span, one = left - ones, span >> size, one + size
            else:
                span = lower
        bit = i * self.low_bits
        low = int.from_bytes(self.low[bit // 8 : -(-(bit + self.low_bits) // 8)].tobytes(), "little") >> (bit % 8)
        return (one - i) << self.low_bits | low & ((1 << self.low_bits) - 1)


def write_segment(keys: list[int | None], ids: list[bytes], start: int, width: int) -> bytes:
    """One segment; ``ids`` are little-endian 32-bit ids by document, keys ascend with the missing ones first."""
    ends = np.cumsum([len(x) // 4 for x in ids])
    nameless = sum(k is None for k in keys)
    named = np.array(keys[nameless:], np.int64)
    base = int(named[0]) if len(named) else 0
    apart = named.view(np.uint64) - np.int64(base).view(np.uint64)
    flat = np.frombuffer(b"".join(ids), "<u4").astype(f"<u{width}")
    head = struct.pack(_HEAD, _MAGIC, width, len(keys), nameless, len(flat), start, base)
    return head + ef_encode(ends) + ef_encode(apart) + flat.tobytes()


class Segment:
    """A segment read back."""

    def __init__(self, blob: bytes):
        data = memoryview(blob)
        magic, width, self.n_docs, self.nameless, n_ids, self.start, self.base = struct.unpack_from(_HEAD, data)
        if magic != _MAGIC:
            raise ValueError("not a token segment")
        self.ends = EliasFano(data[struct.calcsize(_HEAD) :])
        at = struct.calcsize(_HEAD) + self.ends.size
        self.keys = EliasFano(data[at:])
        self.ids = np.frombuffer(data, f"<u{width}", n_ids, at + self.keys.size)

    def offset(self, i: int) -> int:
        """Where the i-th document begins among the segment's ids."""
        return self.ends[i - 1] if i else 0

    def doc_ids(self) -> list[int | None]:
        named = self.keys.all() + np.int64(self.base).view(np.uint64)
        return [None] * self.nameless + named.view(np.int64).tolist()


def write_tokens(documents: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Encode every text, append ``end_id``, and write segments in ascending ``doc_id`` order below ``path``.

    Rows are range-partitioned by id (and text, so that repeated ids spread), sorted within a partition, and
    streamed: no task holds more than one segment. NULL and empty texts are the end id alone; rows without an id
    come first; repeated rows are all written. An empty table writes an empty store.
    """

    def encode(batches):
        library = library_tokens(tokenizer)
        width = 2 if max(library.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        end = np.array([end_id], "<u4").tobytes()
        part, number, start = TaskContext.get().partitionId(), 0, 0
        keys: list = []
        ids: list[bytes] = []
        held = 0

        def segment():
            return pa.RecordBatch.from_arrays(
                [pa.array([part]), pa.array([number]), pa.array([held], pa.int64()), pa.array([write_segment(keys, ids, start, width)], pa.binary())],
                ["part", "number", "n_ids", "segment"],
            )

        for batch in batches:
            _, offsets = W.text_bytes(batch.column(1))
            for low, high in W.row_slices(offsets):
                rows = batch.slice(low, high - low)
                for key, text in zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True):
                    keys.append(key)
                    ids.append(library.ids(text or "") + end)
                    held += len(ids[-1]) // 4
                    if held >= SEGMENT_IDS:
                        yield segment()
                        number, start = number + 1, start + held
                        keys, ids, held = [], [], 0
        if keys:
            yield segment()

    ordered = (
        documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
        .repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    )
    ordered.mapInArrow(encode, "part bigint, number bigint, n_ids bigint, segment binary").write.option("compression", "zstd").parquet(path)


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` and, if wanted, ``ids`` of every document of a store.

    ``start`` counts the ids of all documents before it, by select on the boundaries; it needs one number per written
    partition on the driver.
    """
    store = spark.read.parquet(path)
    totals = {r["part"]: r["n"] for r in store.groupBy("part").agg(F.sum("n_ids").alias("n")).collect()}
    begins, at = {}, 0
    for part in sorted(totals):
        begins[part], at = at, at + totals[part]

    def decode(batches):
        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                segment = Segment(blob.as_py())
                starts = np.array([segment.offset(i) for i in range(segment.n_docs)], np.int64)
                ends = np.append(starts[1:], len(segment.ids))
                wide = segment.ids.astype("<u4")
                sums = [zlib.crc32(wide[s:e].tobytes()) for s, e in zip(starts, ends, strict=True)]
                columns = {
                    "doc_id": pa.array(segment.doc_ids(), pa.int64()),
                    "start": pa.array(starts + (begins[part] + segment.start)),
                    "n_tokens": pa.array(ends - starts),
                    "ids_crc32": pa.array(sums, pa.int64()),
                }
                if with_ids:
                    cut = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                    columns["ids"] = pa.ListArray.from_arrays(cut, pa.array(wide.astype(np.int32)))
                yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids array<int>" if with_ids else "")
    return store.select("part", "segment").mapInArrow(decode, schema)
