"""Document fingerprints by randomised I-Match, in DataFrame operations only.

The lexicon is the terms whose document frequency lies in a band: rarer ones are noise, more frequent ones say
nothing. A document keeps its distinct lexicon terms, sorted, and each of ``SUBSETS`` random sub-lexicons
gives one hash of the terms that fall into it. Sub-lexicons keep between most and very few of the terms, so large ones
tell near copies apart and small ones still agree on half a text. Two documents are alike by the share of
hashes that agree, over those where either has a term.

Frequencies count all documents. At most (distinct terms per document / ``LOW``) terms can be in the band,
whatever the number of documents; only that lexicon is sent to the tasks. Terms are exploded, looked up
and gathered per document inside the partition that the neighbour window needs anyway: the texts move once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored

LOW, HIGH = 1 / 400, 1 / 10
#: Share of the lexicon that each sub-lexicon keeps.
SUBSETS = [rate for rate in (0.6, 0.2, 0.05, 0.02, 0.01, 0.005) for _ in range(4)]
RANGE_BYTES = 8 << 20
_KNOTS = 64
_SPACES = "\t\n\x0b\x0c\r"


def terms(text: Column) -> Column:
    """Distinct lower-cased words, and the empty string, which marks that the document is there."""
    return F.array_distinct(F.split(F.concat(F.lit(" "), F.translate(F.lower(text), _SPACES, "     ")), " "))


def lexicon(documents: DataFrame) -> DataFrame:
    """``term, subsets``: hashes of the terms in the band and a bit for each sub-lexicon that keeps them."""
    docs = documents.select(F.coalesce("text", F.lit("")).alias("text"))
    counts = docs.select(F.explode(terms(F.col("text"))).alias("w")).groupBy(F.xxhash64("w").alias("term")).count()
    counts = stored(counts.where("count > 1"), "terms")
    mark = F.xxhash64(F.lit(""))
    # every document has the mark, so its count is the number of documents
    n_docs = counts.where(F.col("term") == mark).select("count").first()
    n = n_docs[0] if n_docs else 1
    bits = sum(
        (F.when(F.pmod(F.xxhash64("term", F.lit(k)), F.lit(10_000)) < int(rate * 10_000), F.lit(1 << k)).otherwise(0) for k, rate in enumerate(SUBSETS)),
        F.lit(0),
    )
    band = counts.where((F.col("count") >= LOW * n) & (F.col("count") <= HIGH * n) & (F.col("term") != mark))
    marks = documents.sparkSession.range(1).select(mark.alias("term"), F.lit(0).alias("subsets"))
    return band.select("term", bits.cast("int").alias("subsets")).unionByName(marks)


def _fingerprint(found: Column, own: Column) -> Column:
    """Hashes of the sub-lexicons joined by ``-`` (nothing where one has no term); without any term, a hash of the text."""

    def member(k: int):
        return lambda t: t["subsets"].bitwiseAND(F.lit(1 << k)) != 0

    hashes = []
    for k in range(len(SUBSETS)):
        kept = F.filter(found, member(k))
        value = F.lpad(F.lower(F.hex(F.xxhash64(F.transform(kept, lambda t: t["term"])).bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")
        hashes.append(F.when(F.size(kept) > 0, value).otherwise(""))
    return F.when(F.size(found) > 0, F.array_join(F.array(*hashes), "-")).otherwise(F.concat(F.lit("text-"), F.hex(own)))


def likeness(a: Column, b: Column) -> Column:
    """Share of agreeing hashes among those that either fingerprint has, 1 for equal fingerprints."""
    parts = F.zip_with(F.split(a, "-"), F.split(b, "-"), lambda x, y: F.when((x == "") & (y == ""), None).otherwise((x == y).cast("int")))
    told = F.filter(parts, lambda p: p.isNotNull())
    share = F.aggregate(told, F.lit(0), lambda t, p: t + p) / F.greatest(F.size(told), F.lit(1))
    odd = a.startswith("text-") | b.startswith("text-")
    return F.when(a == b, 1.0).when(odd, 0.0).otherwise(share)


def with_ranges(docs: DataFrame) -> DataFrame:
    """``docs`` plus ``part``, the number of the row's id range, ascending with the id; NULL ids are range -1.

    Ranges hold about ``RANGE_BYTES`` however the ids lie: quantiles cut them in ``_KNOTS``, and quantiles of each cut it again
    until there are enough. Rows of one id, and rows without one, share a range.
    """

    def cuts(n: int) -> Column:
        return F.percentile_approx("doc_id", [i / n for i in range(1, n)], 10_000)

    size, first = docs.agg(F.sum(F.octet_length("text")), cuts(_KNOTS)).first()
    named, below = F.col("doc_id").isNotNull(), lambda k: k <= F.col("doc_id")
    at = F.size(F.filter(F.lit(first), below)) if first else F.lit(0)
    ranged = docs.withColumn("part", F.when(named, at).otherwise(-1).cast("bigint"))
    n_ranges = _KNOTS
    while n_ranges * RANGE_BYTES < (size or 0):
        n = min(_KNOTS, -(-size // (n_ranges * RANGE_BYTES)))
        inner = stored(ranged.where(named).groupBy(F.col("part").alias("whole")).agg(cuts(n).alias("cuts")), "cuts")
        # one row of knots per range: 2 MB at most when sent to the tasks
        inner = F.broadcast(inner) if n_ranges <= _KNOTS**2 else inner
        finer = F.when(named, F.col("part") * n + F.size(F.filter("cuts", below))).otherwise(-1).cast("bigint")
        ranged = ranged.join(inner, F.col("part") == F.col("whole"), "left").select(*docs.columns, finer.alias("part"))
        n_ranges *= n
    return ranged


def fingerprints(documents: DataFrame) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``.

    The edited text has its last ``floor(n_chars / 2)`` code points replaced by as many (or all) from the start of
    the next document in descending ``doc_id`` order, after the last the first. ``near_next`` compares with that document.

    NULL texts are empty; texts without a lexicon term are alike only if equal. Equal ids follow each other by
    descending text, rows without an id come last; a single row is its own neighbour. Other columns are ignored; an
    empty table gives no rows.
    """
    base = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    words = F.broadcast(stored(lexicon(base), "lexicon"))
    ranged = with_ranges(base)
    # the first row of the next lower range closes each range, so that neighbours never cross one
    heads = ranged.groupBy("part").agg(F.max("doc_id").alias("head"))
    order = Window.orderBy(F.col("part").desc())
    heads = heads.select(
        "part",
        F.lead(F.struct("part", "head")).over(order).alias("after"),
        F.first(F.struct("part", "head")).over(order).alias("first"),
    ).select("part", F.coalesce("after", "first").alias("next"))
    heads = stored(heads.select("part", F.col("next.part").alias("next_part"), F.col("next.head").alias("head")), "heads")
    closing = (
        ranged.join(heads.withColumnRenamed("part", "own"), (F.col("part") == F.col("next_part")) & F.col("doc_id").eqNullSafe(F.col("head")))
        .groupBy("own")
        .agg(F.max("text").alias("text"))
        .select(F.lit(None).cast("bigint").alias("doc_id"), "text", F.col("own").alias("part"), F.lit(True).alias("closing"))
    )
    rows = ranged.withColumn("closing", F.lit(False)).unionByName(closing)
    inside = Window.partitionBy("part").orderBy("closing", F.col("doc_id").desc_nulls_last(), F.col("text").desc())
    n, half = F.char_length("text"), F.floor(F.char_length("text") / 2).cast("int")
    paired = rows.select(
        "part", "doc_id", "closing", "text", F.row_number().over(inside).alias("place"), F.coalesce(F.lead("text").over(inside), F.lit("")).alias("next")
    ).select(
        "part", "doc_id", "closing", "place", n.alias("n_chars"), "text",
        F.concat(F.substring("text", F.lit(1), n - half), F.substring("next", F.lit(1), half)).alias("edited"),
    )
    sides = F.array(
        F.struct(F.lit(0).alias("side"), F.xxhash64("text").alias("own"), terms(F.col("text")).alias("terms")),
        F.struct(F.lit(1).alias("side"), F.xxhash64("edited").alias("own"), terms(F.col("edited")).alias("terms")),
    )
    key = ["part", "place", "doc_id", "closing", "n_chars", "edited_sha"]
    looked_up = (
        paired.select(*key[:-1], F.unhex(F.sha2("edited", 256)).alias("edited_sha"), F.explode(sides).alias("s"))
        .select(*key, "s.side", "s.own", F.explode("s.terms").alias("w"))
        .select(*key, "side", "own", F.xxhash64("w").alias("term"))
        .join(words, "term")
    )
    kept = F.collect_list(F.when(F.col("subsets") != 0, F.struct("term", "subsets")))
    made = looked_up.groupBy(*key, "side", "own").agg(F.sort_array(kept).alias("found"))
    made = made.select(*key, "side", _fingerprint(F.col("found"), F.col("own")).alias("print"))
    both = made.groupBy(*key).agg(
        F.max(F.when(F.col("side") == 0, F.col("print"))).alias("fingerprint"),
        F.max(F.when(F.col("side") == 1, F.col("print"))).alias("edited_fingerprint"),
    )
    along = Window.partitionBy("part").orderBy("place")
    return both.withColumn("next", F.lead("fingerprint").over(along)).where("not closing").select(
        "doc_id",
        F.col("n_chars").cast("bigint").alias("n_chars"),
        F.lower(F.hex("edited_sha")).alias("edited_sha256"),
        "fingerprint",
        "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next")).alias("near_next"),
    )
