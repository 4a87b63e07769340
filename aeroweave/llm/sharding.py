"""Two-pass external shuffle of documents into shards.

Pass one scatters the rows by a seeded hash into buckets that fit in a task's memory. Pass two loads one
bucket at a time, permutes it by Fisher-Yates with a generator seeded by the bucket, and writes it. The
buckets laid end to end are a uniform permutation of the table; shards are equal cuts of it, so their row
counts differ by one at most.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

BUCKET_BYTES = 8 << 20
#: Buckets whose counts are added up in one task.
BLOCK = 4096
LAW = "rows"


def row_bytes(text) -> F.Column:
    """UTF-8 bytes of the text (NULL: none) plus 8 for the id."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("bigint")


def _unused(name: str, columns: list[str]) -> str:
    taken = {c.lower() for c in columns}
    while name in taken:
        name += "_"
    return name


def _begins(counts: DataFrame) -> DataFrame:
    """``number, begin``: rows in buckets of smaller number, from ``(number, n)``.

    Added up within blocks of buckets, and over the blocks, which are ``BLOCK`` times fewer.
    """
    blocked = counts.withColumn("block", F.floor(F.col("number") / BLOCK))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = blocked.groupBy("block").agg(F.sum("n").alias("n"))
    blocks = sums.select("block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("block").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.col("base") + F.coalesce(F.sum("n").over(within), F.lit(0))
    return blocked.join(blocks, "block").select("number", begin.alias("begin"))


def shuffled_shards(documents: DataFrame, n_shards: int, seed: int = 0) -> DataFrame:
    """Every column of ``documents`` plus ``shard`` and ``slot``, the place in the shard, gapless from 0.

    The result depends only on the rows and the seed. NULL ids and texts are values like others; rows that
    repeat in full share a bucket; columns called ``shard`` or ``slot`` are an error, any other name is fine; an empty table
    gives no rows. The buckets' first places are a table that meets the rows bucket by bucket; the driver holds two totals.
    """
    if clash := {"shard", "slot"} & {c.lower() for c in documents.columns}:
        raise ValueError(f"documents already has {sorted(clash)}")
    number, order = (_unused(name, documents.columns) for name in ("__bucket", "__order"))
    key = F.xxhash64(F.lit(seed).cast("bigint"), "doc_id", F.crc32(F.coalesce("text", F.lit("")).cast("binary")))
    total = documents.agg(F.sum(row_bytes("text"))).first()[0] or 0
    n_buckets = max(64, -(-total // BUCKET_BYTES))
    bucket = F.pmod(key, F.lit(n_buckets))
    counts = stored(documents.groupBy(bucket.alias("number")).agg(F.count("*").alias("n")), "shard-counts")
    n_rows = counts.agg(F.sum("n")).first()[0] or 0
    # shard s holds the positions from edges[s] to edges[s + 1]
    edges = np.array([s * n_rows // n_shards for s in range(n_shards + 1)], np.int64)

    def permute(rows: pa.Table, begin: pa.Table) -> pa.Table:
        mine = begin.column("number")[0].as_py()
        table = rows.sort_by([("doc_id", "ascending"), (order, "ascending")]).drop_columns([number, order])
        drawn = np.arange(table.num_rows)
        np.random.Generator(np.random.PCG64([seed, mine])).shuffle(drawn)
        place = np.arange(table.num_rows) + begin.column("begin")[0].as_py()
        shard = np.searchsorted(edges, place, "right") - 1
        return (
            table.take(pa.array(drawn))
            .append_column("shard", pa.array(shard.astype(np.int32)))
            .append_column("slot", pa.array(place - edges[shard]))
        )

    schema = documents.selectExpr("*", "0 as shard", "0L as slot").schema
    scattered = documents.select("*", bucket.alias(number), F.xxhash64("text").alias(order))
    return scattered.groupBy(number).cogroup(_begins(counts).groupBy("number")).applyInArrow(permute, schema)


def write_shards(documents: DataFrame, path: str, n_shards: int, seed: int = 0) -> None:
    """Parquet files below ``path``, one folder per shard, rows of a file in slot order."""
    shards = shuffled_shards(documents, n_shards, seed)
    shards.sortWithinPartitions("shard", "slot").write.option("compression", "zstd").partitionBy("shard").parquet(path)
