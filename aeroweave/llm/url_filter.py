"""URL filter: host and path rules first, then a character language-model ratio.

URLs that a rule accepts or rejects teach two variable-order Markov models. Each estimates a character
after the longest context it has counts for and blends with the shorter ones (Witten-Bell weights:
a context counts as much as it was seen against how many different characters followed it). A URL that
no rule fits is judged by the mean over its characters of ``log p_accepted - log p_rejected``; the
threshold is the score that separates rule decisions best, each scored by models that have not seen it.

Counts cover every URL that a rule decides. Characters fall into ``SYMBOLS`` classes, so a model is a
table of at most ``len(SYMBOLS) ** (ORDER + 1)`` counts whatever the input: that is what is sent to the tasks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: (host, path, verdict): a rule fits its host and all subdomains if the path starts with its own.
Rule = tuple[str, str, str]
#: Class 0 begins and ends a URL, the last class is every other character.
SYMBOLS = "\0abcdefghijklmnopqrstuvwxyz0123456789./-_?=&:%~+#,@\1"
ORDER = 3
_BINS = 2000
_RANGE = 10.0


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without ``://`` or for NULL."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_for(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits (by host, then by path); NULL if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]), len(r[1]), r[0], r[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _codes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Symbol classes of all texts, each led by ``ORDER`` begin marks and closed by an end mark, and their offsets."""
    table = np.full(128, len(SYMBOLS) - 1, np.int64)
    for i, s in enumerate(SYMBOLS[1:-1], 1):
        table[ord(s)] = i
    table[ord("A") : ord("Z") + 1] = table[ord("a") : ord("z") + 1]
    texts = [t or "" for t in column.to_pylist()]
    lengths = np.array([len(t) for t in texts], np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    own = np.where(points < 128, table[np.minimum(points, 127)], len(SYMBOLS) - 1)
    offsets = np.concatenate([[0], np.cumsum(lengths + ORDER + 1)])
    out = np.zeros(offsets[-1], np.int64)
    row = np.repeat(np.arange(len(texts)), lengths)
    out[np.arange(len(own)) + row * (ORDER + 1) + ORDER] = own
    return out, offsets


def _grams(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Code of the ``ORDER + 1`` symbols that end at each character (or end mark), and the row of each."""
    codes, offsets = _codes(column)
    size = len(SYMBOLS)
    at = np.ones(len(codes), dtype=bool)
    for k in range(ORDER):
        at[offsets[:-1] + k] = False
    at = np.flatnonzero(at)
    gram = np.zeros(len(at), np.int64)
    for k in range(ORDER, -1, -1):
        gram = gram * size + codes[at - k]
    return gram, np.searchsorted(offsets, at, "right") - 1


def count_grams(urls: DataFrame) -> DataFrame:
    """``label, gram, n`` over ``url, label``; each task adds up its own rows before the exchange."""

    def run(batches):
        for batch in batches:
            gram, row = _grams(batch.column(0))
            label = np.asarray(batch.column(1))[row]
            key, n = np.unique(label * len(SYMBOLS) ** (ORDER + 1) + gram, return_counts=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(key // len(SYMBOLS) ** (ORDER + 1)), pa.array(key % len(SYMBOLS) ** (ORDER + 1)), pa.array(n)], ["label", "gram", "n"]
            )

    return urls.select("url", F.col("label").cast("bigint")).mapInArrow(run, "label bigint, gram bigint, n bigint").groupBy("label", "gram").agg(F.sum("n").alias("n"))


class CharModel:
    """A smoothed variable-order Markov model over symbol classes."""

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        size = len(SYMBOLS)
        self.orders = []
        for order in range(ORDER + 1):
            key, back = np.unique(grams % size ** (order + 1), return_inverse=True)
            n = np.bincount(back, weights=counts, minlength=len(key))
            context, of = np.unique(key // size, return_inverse=True)
            seen = np.bincount(of, weights=n, minlength=len(context))
            kinds = np.bincount(of, minlength=len(context))
            self.orders.append((key, n, context, seen, kinds))

    def log_p(self, gram: np.ndarray) -> np.ndarray:
        size = len(SYMBOLS)
        p = np.full(len(gram), 1.0 / size)
        for order, (key, n, context, seen, kinds) in enumerate(self.orders):
            if not len(key):
                continue
            own = gram % size ** (order + 1)
            at = np.minimum(np.searchsorted(key, own), len(key) - 1)
            hits = np.where(key[at] == own, n[at], 0)
            above = own // size
            at = np.minimum(np.searchsorted(context, above), len(context) - 1)
            known = context[at] == above
            total, different = np.where(known, seen[at], 0), np.where(known, kinds[at], 1)
            p = (hits + different * p) / (total + different)
        return np.log(p)


def score_urls(urls: DataFrame, models: list[tuple[CharModel, CharModel]]) -> DataFrame:
    """``urls`` plus ``score``, the mean log ratio per character (above 0: more like the accepted ones).

    ``models`` are pairs of an accepted and a rejected model; a row uses the pair that its column ``fold`` numbers.
    """
    shared = urls.sparkSession.sparkContext.broadcast(models)
    at, of = urls.columns.index("url"), urls.columns.index("fold")

    def run(batches):
        for batch in batches:
            gram, row = _grams(batch.column(at))
            fold = np.asarray(batch.column(of))[row]
            ratio = np.zeros(len(gram))
            for k in np.unique(fold):
                yes, no = shared.value[k]
                own = fold == k
                ratio[own] = yes.log_p(gram[own]) - no.log_p(gram[own])
            total = np.bincount(row, weights=ratio, minlength=batch.num_rows)
            length = np.bincount(row, minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(total / np.maximum(length, 1))], [*batch.schema.names, "score"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in urls.schema)
    return urls.mapInArrow(run, f"{fields}, score double")


def _models(taught: DataFrame, folds: int) -> list[tuple[CharModel, CharModel]]:
    """A pair of models without each fold's URLs and, last, the pair of all URLs; counted in one pass over ``url, label, fold``."""
    marked = taught.select("url", (F.col("fold") * 2 + F.col("label")).alias("label"))
    counts = count_grams(marked).toArrow()
    mark, gram, n = (counts.column(c).to_numpy() for c in ("label", "gram", "n"))

    def model(label: int, without: int) -> CharModel:
        own = (mark % 2 == label) & (mark // 2 != without)
        return CharModel(gram[own], n[own])

    return [(model(1, k), model(0, k)) for k in range(folds + 1)]


def _threshold(scored: DataFrame) -> float:
    """The score with the best balanced accuracy on ``score, label``; 0 if rules decide for one class only."""
    place = F.least(F.greatest(F.floor((F.col("score") + _RANGE) / (2 * _RANGE) * _BINS), F.lit(0)), F.lit(_BINS - 1))
    rows = scored.groupBy(place.alias("bin"), "label").count().collect()
    hist = np.zeros((2, _BINS))
    for r in rows:
        hist[int(r["label"]), int(r["bin"])] += r["count"]
    if not hist.sum(axis=1).all():
        return 0.0
    rejected_below = np.concatenate([[0], np.cumsum(hist[0])]) / hist[0].sum()
    accepted_above = 1 - np.concatenate([[0], np.cumsum(hist[1])]) / hist[1].sum()
    gain = rejected_below + accepted_above
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    # in the middle of the gap between the classes
    return float((best.min() + best.max()) / 2 / _BINS * 2 * _RANGE - _RANGE)


def judge_urls(pages: DataFrame, rules: list[Rule], folds: int = 5) -> DataFrame:
    """``page_id, url, host, path, rule, score, verdict`` for every row; verdicts are ``allow`` or ``block``.

    The threshold is calibrated on all URLs that rules decide: they fall into ``folds`` parts by hash, and each part is scored by
    models of the others. Verdicts come from models of all parts. NULL or odd URLs have an empty host and path, fit no rule unless one is empty, and
    are judged by the models like others; if rules decide for one class only, the threshold is 0; with no decided URLs at all every score is 0
    and the verdict allow. Repeated rows are judged alike; other columns are ignored; an empty table gives no rows.
    """
    base = pages.select("page_id", "url")
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    name, verdict = rule_for(F.col("host"), F.col("path"), rules)
    ruled = base.withColumns({"host": host, "path": path}).withColumns({"rule": name, "ruled": verdict})
    taught = ruled.where("ruled is not null").select(
        "url",
        F.when(F.col("ruled") == "allow", 1).otherwise(0).alias("label"),
        F.pmod(F.xxhash64("url"), F.lit(folds)).cast("int").alias("fold"),
    )
    models = _models(taught, folds)
    threshold = _threshold(score_urls(taught, models))
    scored = score_urls(ruled.withColumn("fold", F.lit(folds)), models)
    learned = F.when(F.col("score") >= threshold, "allow").otherwise("block")
    return scored.select("page_id", "url", "host", "path", "rule", "score", F.coalesce("ruled", learned).alias("verdict"))
