"""Exact k-means over whole-number vectors with heap-ordered bounds.

Vectors are packed into blocks of rows that never move again. For each cluster a block keeps a heap of
its members, ordered by gap: distance to the second nearest centroid less distance to the own one, plus the drift
the cluster had accumulated when the member went in. When centroids move, a cluster's accumulated
drift grows by its own drift and the largest of the others; a member whose key is still above it is
strictly nearest to its centroid and is not looked at. Only members whose gap expired are popped, held
against all centroids with exact arithmetic, and pushed again.

Between rounds a block keeps 12 bytes a vector (key and place); the vectors stay where the first exchange put
them, and only the small states are exchanged. Moves change sums and counts by difference, so a
round adds up whole numbers: one row per changed cluster, block and component.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .shared import stored

#: Vectors packed in one row.
BLOCK = 8192
#: Largest component: squared distances then fit in a long for up to 128 components.
LARGEST = 1 << 27
#: Up to this, sums of squares are exact in doubles for 64 components, and the fast product may be used.
_EXACT = 1 << 22
_STATE = "block bigint, sizes array<int>, keys binary, places binary, clusters array<int>, counts array<bigint>, sums array<array<bigint>>"


def usable(vector: str, width: int) -> Column:
    """Whether a vector has exactly ``width`` components, none NULL or non-finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) == width) & ~bad, F.lit(False))


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, one row per vector and one column per centroid."""
    if max(np.abs(x).max(initial=0), np.abs(centroids).max(initial=0)) * max(1, x.shape[1] / 64) <= _EXACT:
        a, b = x.astype(float), centroids.astype(float)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)).astype(np.int64)
    return np.stack([((x - c) ** 2).sum(1) for c in centroids.astype(np.int64)], axis=1)


def _nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the nearest centroid (ties: the smaller) and a safe lower bound of the gap to the second."""
    far = squared(x, centroids)
    rows = np.arange(len(x))
    best = far.argmin(1)
    first = np.sqrt(far[rows, best].astype(float))
    far[rows, best] = np.iinfo(np.int64).max
    second = np.sqrt(far.min(1).astype(float)) if far.shape[1] > 1 else np.full(len(x), np.inf)
    return best, second * (1 - 1e-12) - first * (1 + 1e-12)


class Bounds:
    """Centroids and, for each cluster, the drift it has accumulated: all that tasks need of the past."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.drift = np.zeros(len(centroids))

    def moved(self, centroids: np.ndarray) -> Bounds:
        step = [math.sqrt(sum(int(d) ** 2 for d in row)) for row in centroids - self.centroids]
        following = Bounds(centroids)
        for j in range(len(step)):
            others = max(step[:j] + step[j + 1 :], default=0.0)
            following.drift[j] = (self.drift[j] + step[j] + others) * (1 + 1e-12)
        return following

    def reassign(self, x: np.ndarray, heaps: list[list] | None) -> tuple[list[list], np.ndarray, np.ndarray, np.ndarray]:
        """New heaps, and place, old and new cluster of every vector that was scanned (old: -1 at first)."""
        if heaps is None:
            heaps = [[] for _ in self.centroids]
            places, old = np.arange(len(x)), np.full(len(x), -1)
        else:
            popped = []
            for j, heap in enumerate(heaps):
                limit = self.drift[j] + 1e-9 * (1 + self.drift[j])
                while heap and heap[0][0] <= limit:
                    popped.append((heapq.heappop(heap)[1], j))
            places, old = np.array(popped, np.int64).reshape(-1, 2).T
        if not len(places):
            return heaps, places, old, old
        new, gap = _nearest(x[places], self.centroids)
        for place, j, key in zip(places.tolist(), new.tolist(), (gap + self.drift[new]).tolist(), strict=True):
            heapq.heappush(heaps[j], (key, place))
        return heaps, places, old, new


def _whole(x: np.ndarray) -> np.ndarray:
    """``floor(256 * x)``; raises where squared distances would not fit in a long."""
    x = np.floor(256 * x)
    if np.abs(x).max(initial=0) > LARGEST:
        raise ValueError(f"a vector component is beyond {LARGEST / 256}: its squared distances do not fit in a long")
    return x.astype(np.int64)


def _pack(width: int):
    def pack(batches):
        number = TaskContext.get().partitionId() << 33
        ids, parts, waiting = [], [], 0

        def block():
            x = np.concatenate(parts)
            most = np.abs(x).max(initial=0)
            kind = np.int16 if most < 1 << 15 else np.int32
            yield pa.RecordBatch.from_arrays(
                [pa.array([number]), pa.array([pa.concat_arrays(ids).to_pylist()], pa.list_(pa.int64())), pa.array([x.astype(kind).tobytes()])],
                ["block", "ids", "vectors"],
            )

        for batch in batches:
            flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            x = _whole(flat)
            at = 0
            while at < len(x):
                take = min(BLOCK - waiting, len(x) - at)
                ids.append(batch.column(0).slice(at, take))
                parts.append(x[at : at + take])
                at, waiting = at + take, waiting + take
                if waiting == BLOCK:
                    yield from block()
                    number, ids, parts, waiting = number + 1, [], [], 0
        if waiting:
            yield from block()

    return pack


def _open(left: pa.Table, right: pa.Table, width: int) -> tuple[np.ndarray, list[list] | None]:
    raw, n = left.column("vectors")[0].as_buffer(), len(left.column("ids")[0])
    x = np.frombuffer(raw, np.int16 if len(raw) == 2 * n * width else np.int32).reshape(n, width).astype(np.int64)
    if not right.num_rows:
        return x, None
    keys = np.frombuffer(right.column("keys")[0].as_buffer(), float).tolist()
    places = np.frombuffer(right.column("places")[0].as_buffer(), np.int32).tolist()
    heaps, at = [], 0
    for size in right.column("sizes")[0].as_py():
        heaps.append(list(zip(keys[at : at + size], places[at : at + size], strict=True)))
        at += size
    return x, heaps


def _step(bounds: Bounds, width: int):
    def step(key, left: pa.Table, right: pa.Table) -> pa.Table:
        x, heaps = _open(left, right, width)
        heaps, places, old, new = bounds.reassign(x, heaps)
        changed = old != new
        places, old, new = places[changed], old[changed], new[changed]
        touched = np.union1d(old[old >= 0], new).astype(int).tolist()
        counts = [int((new == j).sum() - (old == j).sum()) for j in touched]
        sums = [(x[places[new == j]].sum(0) - x[places[old == j]].sum(0)).tolist() for j in touched]
        flat = [entry for heap in heaps for entry in heap]
        return pa.table(
            {
                "block": left.column("block").combine_chunks(),
                "sizes": pa.array([[len(heap) for heap in heaps]], pa.list_(pa.int32())),
                "keys": pa.array([np.array([k for k, _ in flat], float).tobytes()]),
                "places": pa.array([np.array([p for _, p in flat], np.int32).tobytes()]),
                "clusters": pa.array([touched], pa.list_(pa.int32())),
                "counts": pa.array([counts], pa.list_(pa.int64())),
                "sums": pa.array([sums], pa.list_(pa.list_(pa.int64()))),
            }
        )

    return step


def _finish(bounds: Bounds, width: int):
    def finish(key, left: pa.Table, right: pa.Table) -> pa.Table:
        x, heaps = _open(left, right, width)
        heaps, *_ = bounds.reassign(x, heaps)
        own = np.empty(len(x), np.int32)
        for j, heap in enumerate(heaps):
            own[[place for _, place in heap]] = j
        away = x - bounds.centroids[own]
        return pa.table(
            {"vec_id": left.column("ids").combine_chunks().flatten(), "cluster": pa.array(own), "distance": pa.array((away * away).sum(1))}
        )

    return finish


def seeds(vectors: DataFrame, k: int, salt: str) -> np.ndarray:
    """The ``k`` vectors whose ``sha256(salt:id)`` is smallest, in that order, as whole numbers."""
    first = vectors.select(F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256).alias("h"), "vector")
    rows = first.orderBy(F.asc_nulls_last("h"), "vector").limit(k).collect()
    return _whole(np.array([r.vector for r in rows], float))


def _placed(packed: DataFrame) -> DataFrame:
    """Blocks hashed to a fixed number of partitions and checkpointed, so that rounds exchange states only.

    A checkpoint remembers partitioning and order unless its plan was adaptive.
    """
    spark = packed.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return materialize(packed.repartition(parts, "block").sortWithinPartitions("block"))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)


def cluster(vectors: DataFrame, k: int = 40, rounds: int = 5, width: int = 64, salt: str = "2") -> tuple[DataFrame, np.ndarray]:
    """``(vec_id, cluster, distance)`` for every usable row of ``vectors(vec_id, embedding)``, and the centroids.

    Components count as ``floor(256 * x)``. Centroids start as ``seeds``; each round assigns all vectors to the nearest
    centroid (ties: the smaller number) and moves every centroid that has members to the floor of their mean. A last
    assignment follows; ``distance`` is squared. All of it is exact.

    Rows whose vector is NULL, has another length, or holds a NULL, NaN or infinity are left out. Repeated rows count
    each time; a seed tie goes to the smaller vector. A row without an id is clustered and is a seed only after all
    others. Fewer rows than ``k`` give that many clusters, none gives no rows. Other columns are
    ignored. A component beyond +-2^27 / 256 raises.
    """
    spark = vectors.sparkSession
    kept = vectors.where(usable("embedding", width)).select(
        F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector")
    )
    centroids = seeds(kept, k, salt)
    if not len(centroids):
        return spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint"), centroids
    blocks = _placed(kept.mapInArrow(_pack(width), "block bigint, ids array<bigint>, vectors binary"))
    state = spark.createDataFrame([], _STATE)
    bounds = Bounds(centroids)
    counts = [0] * len(centroids)
    sums = [[0] * width for _ in centroids]
    both = lambda state: blocks.groupBy("block").cogroup(state.select("block", "sizes", "keys", "places").groupBy("block"))
    for _ in range(rounds):
        state = stored(both(state).applyInArrow(_step(bounds, width), _STATE), "heaps")
        moved = state.select(F.explode(F.arrays_zip("clusters", "counts", "sums")).alias("m"))
        moved = moved.select("m.clusters", "m.counts", F.posexplode("m.sums").alias("at", "part"))
        total = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
        # at most k x width rows, whatever the number of vectors
        for j, at, n, part in moved.groupBy("clusters", "at").agg(total("counts"), total("part")).collect():
            sums[j][at] += int(part)
            if at == 0:
                counts[j] += int(n)
        after = [[s // n for s in row] if n else old.tolist() for row, n, old in zip(sums, counts, bounds.centroids, strict=True)]
        bounds = bounds.moved(np.array(after, np.int64))
    found = both(state).applyInArrow(_finish(bounds, width), "vec_id bigint, cluster int, distance bigint")
    return stored(found, "clusters"), bounds.centroids


def report(assigned: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``assigned`` plus the summed distance of its cluster and of all, and a digest of its centroid."""
    spark = assigned.sparkSession
    # at most k rows
    inertia = dict(assigned.groupBy("cluster").agg(F.sum("distance")).collect())
    rows = [(j, n, sum(inertia.values()), ",".join(map(str, centroids[j].tolist()))) for j, n in inertia.items()]
    told = spark.createDataFrame(rows, "cluster int, cluster_inertia bigint, inertia bigint, centroid string")
    # one row per cluster: the size is the number of centroids
    return assigned.join(F.broadcast(told), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", F.sha2("centroid", 256).alias("centroid_sha256")
    )
