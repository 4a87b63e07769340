"""N-gram Jaccard join as a grouped prefix join.

Components are complete; links are not returned, and pairs that are connected already are not verified one by one.

1. Frequent shingles are counted and put last in the order of all shingles; the others keep hash order.
2. A document is reduced to its set size, a digest of the set, its prefix (the first
   ``n - ceil(t * n) + 1`` shingles: linked sets always share one of these) and a 512-bit parity sketch.
3. Documents with equal sets collapse into a class, classes with equal prefix and size into a group.
4. Groups that share a prefix shingle are candidates. First every group is held only against one
   group of its list (a star), then whole lists are searched, but only where classes are not
   connected yet: pairs of groups are filtered by size, by the places of the common shingle (it must be able to
   be the first common one) and by sketches; those left are expanded to classes and verified on the texts.
5. Components of the verified links, handed back to all copies.

Everything keyed by a shingle is a join that Spark can split where a shingle is hot; a list is never
collected into one row. A star is linear in its list, and the pair search leaves out pairs
inside the list's most frequent component, so a large group of near copies costs its size times the
number of its members that are *not* connected to the rest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import words as W
from .components import connected_components
from .shared import stored

_SKETCH_LONGS = 8
#: Longest parity sketch that goes along with a prefix shingle, in bits (one bit per shingle below that).
MIDDLE_BITS = 2048
#: Shingles in more than this share of all documents go last in the order. At most
#: (shingles per document / FREQUENT) of them can exist, whatever the number of documents.
FREQUENT = 1 / 1000
_LEAN = "doc_id bigint, n bigint, d1 bigint, d2 bigint, g bigint"
_SKETCH = ", ".join(f"s{i} bigint" for i in range(_SKETCH_LONGS))
_U = np.uint64


def _parts(batch: pa.RecordBatch, width: int):
    raw, offsets = W.text_bytes(batch.column(1))
    for low, high in W.row_slices(offsets):
        own = offsets[low : high + 1]
        row, hashed = W.shingles(raw[own[0] : own[-1]], own - own[0], width)
        yield low, high, row, hashed


def frequent_shingles(docs: DataFrame, width: int, share: float = FREQUENT) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (ascending) and document counts of shingles in more than ``share`` of the documents.

    A task reports what is frequent among its own rows, so nothing frequent overall is missed by
    all tasks; the reports are added up by Spark. Only the order of shingles depends on the result,
    never which documents link.
    """

    def report(batches):
        for batch in batches:
            least = max(2, int(share * batch.num_rows))
            found = [hashed for *_, hashed in _parts(batch, width)]
            if found:
                value, count = np.unique(np.concatenate(found), return_counts=True)
                value, count = value[count >= least], count[count >= least]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(value.view(np.int64)), pa.array(count), pa.array(np.zeros(len(value), np.int64))],
                    ["h", "c", "rows"],
                )
            yield pa.RecordBatch.from_arrays(
                [pa.array([0], pa.int64()), pa.array([0], pa.int64()), pa.array([batch.num_rows], pa.int64())],
                ["h", "c", "rows"],
            )

    counts = stored(
        docs.mapInArrow(report, "h bigint, c bigint, rows bigint").groupBy("h").agg(F.sum("c").alias("c"), F.sum("rows").alias("rows")),
        "frequent",
    )
    n_docs = counts.agg(F.sum("rows")).first()[0] or 0
    kept = counts.where(F.col("c") > max(1, share * n_docs)).select("h", "c").collect()
    pairs = np.array([tuple(r) for r in kept], np.int64).reshape(-1, 2)
    value = pairs[:, 0].copy().view(np.uint64)
    order = np.argsort(value)
    return value[order], pairs[order, 1]


def _parities(hashed: np.ndarray, row: np.ndarray, bits: np.ndarray) -> pa.ListArray:
    """For each row a sketch of ``bits[row]`` bits: how often each was hit by the row's shingles, odd or even."""
    edge = np.concatenate([[0], np.cumsum(bits)])
    bit = edge[row] + (W.mix(hashed) & (bits[row] - 1).astype(np.uint64)).astype(np.int64)
    odd = (np.bincount(bit, minlength=edge[-1]) & 1).astype(np.uint8)
    return pa.ListArray.from_arrays(pa.array((edge // 64).astype(np.int32)), pa.array(np.packbits(odd, bitorder="little").view(np.int64)))


def _describe(docs: DataFrame, width: int, percent: int) -> DataFrame:
    """One lean row per document: size, digest, prefix hash, prefix and sketch."""
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_shingles(docs, width))
    names = ["doc_id", "n", "d1", "d2", "g", "prefix", *(f"s{i}" for i in range(_SKETCH_LONGS)), "wide", "middle"]

    def describe(batches):
        value, count = frequent.value
        for batch in batches:
            for low, high, row, hashed in _parts(batch, width):
                rank = np.zeros(len(hashed), np.int64)
                if len(value) and len(hashed):
                    at = np.minimum(np.searchsorted(value, hashed), len(value) - 1)
                    rank = np.where(value[at] == hashed, count[at], 0)
                    order = np.lexsort((hashed, rank, row))
                    hashed = hashed[order]
                m = high - low
                n = np.bincount(row, minlength=m)
                begin = np.concatenate([[0], np.cumsum(n)])
                total = lambda x: np.diff(np.concatenate([[_U(0)], np.cumsum(x, dtype=np.uint64)])[begin])
                length = np.where(n > 0, n - (percent * n + 99) // 100 + 1, 0)
                position = np.arange(len(hashed)) - begin[row]
                lead = position < length[row]
                bit = row * 64 * _SKETCH_LONGS + (W.mix(hashed) >> _U(64 - 9)).astype(np.int64)
                odd = (np.bincount(bit, minlength=m * 64 * _SKETCH_LONGS) & 1).astype(np.uint8)
                sketch = np.packbits(odd, bitorder="little").view(np.int64).reshape(m, _SKETCH_LONGS)
                width_bits = 2 ** np.maximum(np.ceil(np.log2(np.maximum(n, 1))), 9).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(low, m),
                        pa.array(n),
                        pa.array(total(W.mix(hashed ^ _U(0x5851F42D4C957F2D))).view(np.int64)),
                        pa.array(total(W.mix(hashed + _U(0x14057B7EF767814F))).view(np.int64)),
                        pa.array(total(np.where(lead, W.mix(hashed), _U(0))).view(np.int64)),
                        pa.ListArray.from_arrays(
                            pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), pa.array(hashed[lead].view(np.int64))
                        ),
                        *(pa.array(sketch[:, i].copy()) for i in range(_SKETCH_LONGS)),
                        _parities(hashed, row, width_bits),
                        _parities(hashed, row, np.minimum(width_bits, MIDDLE_BITS)),
                    ],
                    names,
                )

    return docs.mapInArrow(describe, f"{_LEAN}, prefix array<bigint>, {_SKETCH}, wide array<bigint>, middle array<bigint>")


def _may_link(x: str, y: str, percent: int) -> Column:
    """Bounds that every linked pair meets: set sizes, and set differences that the parity sketches prove."""
    difference = " + ".join(f"bit_count({x}.s{i} ^ {y}.s{i})" for i in range(_SKETCH_LONGS))
    return F.expr(
        f"100 * least({x}.n, {y}.n) >= {percent} * greatest({x}.n, {y}.n)"
        f" and ({difference}) * {100 + percent} <= ({x}.n + {y}.n) * {100 - percent}"
    )


def _screened(pairs: DataFrame, facts: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs(a, b)`` that sketches of one bit per shingle do not rule out.

    The sketch of the longer set is folded to the length of the other; folding keeps the bound.
    """
    wide = facts.join(
        classes.select(F.col("cls").alias("doc_id"), "d1", "d2", "n"), ["doc_id", "d1", "d2", "n"], "left_semi"
    ).select(F.col("doc_id").alias("cls"), "n", "wide")
    both = (
        stored(pairs, "pairs")
        .join(wide.alias("x"), F.col("a") == F.col("x.cls"))
        .join(wide.alias("y"), F.col("b") == F.col("y.cls"))
    )
    return both.where(_sketches_allow("x.n + y.n", "x.wide", "y.wide", percent)).select("a", "b").distinct()


def _sketches_allow(total: str, p: str, q: str, percent: int) -> Column:
    """Whether two parity sketches leave room for a link; the longer is folded to the other, which keeps the bound."""
    fold = "if(size({0}) > size({1}), zip_with(slice({0}, 1, size({1})), slice({0}, 1 + size({1}), size({1})), (p, q) -> p ^ q), {0})"
    p, q = fold.format(p, q), fold.format(q, p)
    differ = f"aggregate(zip_with({p}, {q}, (u, v) -> bit_count(u ^ v)), 0, (t, u) -> t + u)"
    return F.expr(f"size({p}) <> size({q}) or {differ} * {100 + percent} <= ({total}) * {100 - percent}")


def _may_be_first(x: str, y: str, percent: int) -> Column:
    """Whether a shingle at these places of two prefixes can be the first common one of a linked pair.

    All common shingles stand at or after the first, so those that are left must reach the overlap a link needs.
    """
    overlap = f"({percent} * ({x}.n + {y}.n) + {99 + percent}) div {100 + percent}"
    return F.expr(f"{x}.pos + {overlap} <= {x}.n and {y}.pos + {overlap} <= {y}.n")


def verified(pairs: DataFrame, docs: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of ``pairs(a, b)`` whose texts link: exact set sizes and intersection.

    Where a key has several texts, the one with the smallest digest speaks for it. The pairs are written
    first, so Spark knows their size and moves the texts only where the pairs are too many to send around.
    """
    sides = stored(pairs.select(F.explode(F.array("a", "b")).alias("doc_id"), "a", "b"), "pairs")
    met = (
        sides.join(docs, "doc_id")
        .groupBy("a", "b")
        .agg(F.collect_set(F.struct("doc_id", F.coalesce("text", F.lit("")).alias("text"))).alias("texts"))
    )

    def best(texts: list[str]) -> np.ndarray:
        sets = []
        for text in texts:
            raw, offsets = W.text_bytes(pa.array([text]))
            hashed = W.shingles(raw, offsets, width)[1]
            digest = [np.sum(W.mix(x), dtype=np.uint64).view(np.int64) for x in (hashed ^ _U(0x5851F42D4C957F2D), hashed + _U(0x14057B7EF767814F))]
            sets.append((*digest, len(hashed), hashed))
        return min(sets, key=lambda s: s[:3])[3]

    def judge(batches):
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            keep = []
            for i, (x, y) in enumerate(zip(a, b, strict=True)):
                texts = batch.column(2)[i].as_py()
                sets = [best([t["text"] for t in texts if t["doc_id"] == key]) for key in (x, y)]
                common = len(np.intersect1d(*sets, assume_unique=True))
                keep.append(100 * common >= percent * (len(sets[0]) + len(sets[1]) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return met.mapInArrow(judge, "a bigint, b bigint")


def near_duplicates(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, class_id, component_id`` for every document.

    Documents link when ``100 * |intersection| >= percent * |union|`` over their distinct
    ``width``-word shingles (A-Z lower-cased; a shorter text is one shingle). ``class_id`` is the smallest
    ``doc_id`` with the same set, ``component_id`` the smallest reachable by links.

    Empty or NULL texts have no shingles and link with nothing. Rows that repeat a ``doc_id`` are one
    document; if their texts differ, the set with the smallest digest counts. Rows without a ``doc_id`` are returned
    one by one, without class or component. Other columns are ignored. An empty table gives no rows.
    """
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    facts = stored(_describe(docs, width, percent), "facts")
    sketch = [f"s{i}" for i in range(_SKETCH_LONGS)]
    lean = (
        facts.where("doc_id is not null")
        .groupBy("doc_id")
        .agg(F.min(F.struct("d1", "d2", "n", "g", *sketch)).alias("k"))
        .select("doc_id", "k.*")
    )
    classes = lean.where("n > 0").groupBy("d1", "d2", "n").agg(
        F.min("doc_id").alias("cls"), F.first("g").alias("g"), *(F.first(c).alias(c) for c in sketch)
    )
    groups = classes.groupBy("n", "g").agg(F.min("cls").alias("gid"))
    classes = stored(classes.join(groups, ["n", "g"]), "classes")

    # prefix shingles of one class per group, where another group has the shingle too
    leaders = classes.where("cls = gid").select(F.col("cls").alias("doc_id"), "d1", "d2", "n")
    tokens = facts.join(leaders, ["doc_id", "d1", "d2", "n"], "left_semi").select(
        F.posexplode("prefix").alias("pos", "tok"), F.col("doc_id").alias("gid"), "n"
    )
    lists = tokens.groupBy("tok").agg(F.min("gid").alias("low"), F.max("gid").alias("high")).where("low < high").select("tok")
    tokens = stored(tokens.join(lists, "tok"), "tokens")

    # star: each group against the group it shares most prefix shingles with, among the smallest of its lists
    band = F.floor(F.log(F.col("n").cast("double")) / float(-np.log(percent / 100))) if percent < 100 else F.col("n")
    banded = tokens.withColumn("band", band)
    pivots = banded.groupBy("tok", "band").agg(F.min("gid").alias("pivot"))
    near = (
        banded.join(pivots, ["tok", "band"])
        .where("gid <> pivot")
        .groupBy("gid", "pivot")
        .count()
        .groupBy("gid")
        .agg(F.max(F.struct("count", (-F.col("pivot")).alias("p"))).alias("best"))
        .select((-F.col("best.p")).alias("a"), F.col("gid").alias("b"))
    )
    inner = classes.where("cls <> gid").select(F.col("gid").alias("a"), F.col("cls").alias("b"))
    sized = classes.select("cls", "n", *sketch)
    near = (
        near.unionByName(inner)
        .join(sized.alias("x"), F.col("a") == F.col("x.cls"))
        .join(sized.alias("y"), F.col("b") == F.col("y.cls"))
        .where(_may_link("x", "y", percent))
        .select("a", "b")
    )
    near = _screened(near, facts, classes, percent)
    known = connected_components(verified(near, docs, width, percent))

    # lists that still hold several components: first pairs of groups, then pairs of their classes
    placed = stored(
        classes.join(known.withColumnRenamed("node", "cls"), "cls", "left").select(
            "cls", "gid", "n", F.coalesce("component", "cls").alias("comp"), *sketch
        ),
        "placed",
    )
    members = placed.groupBy("gid").agg(F.first("n").alias("n"), F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("size"))
    listed = tokens.select("tok", "pos", "gid").join(members.select("gid", "low", "high"), "gid")
    # the component that most groups of a list belong to: counted first, then compared
    mixed = (
        listed.groupBy("tok", "low")
        .agg(F.count("*").alias("c"), F.max("high").alias("high"))
        .groupBy("tok")
        .agg(F.min("low").alias("l"), F.max("high").alias("h"), F.max(F.struct("c", "low")).alias("top"))
        .where("l < h")
        .select("tok", F.col("top.low").alias("top"))
    )
    # a group of several classes has no sketch of its own: its pairs are judged after they are expanded
    sketched = (
        facts.join(leaders, ["doc_id", "d1", "d2", "n"], "left_semi")
        .groupBy(F.col("doc_id").alias("gid"))
        .agg(F.first("n").alias("n"), F.first("middle").alias("middle"))
        .join(members.select("gid", "size"), "gid")
        .select("gid", "n", F.expr("if(size = 1, middle, null)").alias("middle"))
    )
    entries = stored(listed.join(mixed, "tok").join(sketched, "gid"), "entries")
    apart = F.expr("not (x.low = x.high and y.low = y.high and x.low = y.low)")
    met = (
        entries.where("low <> top or high <> top")
        .alias("x")
        .join(
            entries.alias("y"),
            F.expr(
                "x.tok = y.tok and x.gid <> y.gid and (x.gid < y.gid or (y.low = y.top and y.high = y.top))"
                f" and 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)"
            )
            & apart
            & _may_be_first("x", "y", percent)
            & (F.expr("x.middle is null or y.middle is null") | _sketches_allow("x.n + y.n", "x.middle", "y.middle", percent)),
        )
        .select(F.least("x.gid", "y.gid").alias("ga"), F.greatest("x.gid", "y.gid").alias("gb"))
        .distinct()
    )
    inside = members.where("low < high").select(F.col("gid").alias("ga"), F.col("gid").alias("gb"))
    pairs = (
        stored(met.unionByName(inside), "groups")
        .join(placed.alias("x"), F.col("ga") == F.col("x.gid"))
        .join(placed.alias("y"), F.col("gb") == F.col("y.gid"))
        .where(F.expr("x.comp <> y.comp and (ga < gb or x.cls < y.cls)") & _may_link("x", "y", percent))
        .select(F.least("x.cls", "y.cls").alias("a"), F.greatest("x.cls", "y.cls").alias("b"))
    )
    more = verified(_screened(pairs, facts, classes, percent), docs, width, percent)
    final = connected_components(known.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))

    found = (
        lean.join(classes.select("d1", "d2", "n", "cls"), ["d1", "d2", "n"], "left")
        .join(final.withColumnRenamed("node", "cls"), "cls", "left")
        .select(
            "doc_id",
            F.col("n").alias("n_shingles"),
            F.coalesce("cls", "doc_id").alias("class_id"),
            F.coalesce("component", "cls", "doc_id").alias("component_id"),
        )
    )
    nameless = facts.where("doc_id is null").select(
        "doc_id", F.col("n").alias("n_shingles"), F.lit(None).cast("bigint").alias("class_id"), F.lit(None).cast("bigint").alias("component_id")
    )
    return found.unionByName(nameless)


def keep_one(documents: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``documents`` whose id is the smallest of its component, and those without an id.

    Repeated rows of a kept id all stay; columns are left as they are.
    """
    kept = near_duplicates(documents, width, percent).where("doc_id = component_id").select("doc_id")
    named = documents.join(kept, "doc_id", "left_semi")
    return named.unionByName(documents.where("doc_id is null"))
