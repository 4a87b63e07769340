"""Quality rules: statistics of a text in DataFrame operations, and a decision list learned from labels.

Learning is sequential covering. A rule is a conjunction of thresholds that is grown on two thirds of the
labelled rows, condition by condition, by information gain, and pruned on the last third. Rows that a kept rule
covers are set aside and the next rule is sought, until none is precise enough. The list becomes one ordered
Spark conditional expression; applying it needs no Python in the tasks and no exchange.

Only the fitting is bounded: it sees at most ``SAMPLE`` labelled documents, chosen by hash of the id.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most labelled documents that one fit collects to the driver.
SAMPLE = 20_000
#: A rule must be right about this share of what it rejects, on rows it was not grown on.
PRECISION = 0.95
SYMBOLS = "#*$%&|<>"
_SPACES = "\t\n\x0b\x0c\r"
_WINDOW = 5


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(text, _SPACES, "     "), " "), "")


def _repeated_words(words: Column) -> Column:
    """Words that lie in a window of five words found twice or more in the text.

    The windows' hashes are sorted with their places, equal neighbours give the places of repeated windows,
    and the gaps between those places say how many words they cover: all inside the row.
    """
    last = F.size(words) - _WINDOW + 1
    shifted = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - _WINDOW + 1), lambda i: F.xxhash64(F.slice(w, i, _WINDOW)))

    def places(hashes: Column) -> Column:
        in_order = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeated(s: Column) -> Column:
            twin = lambda x, i: (x["h"] == F.get(s, i - 1)["h"]) | (x["h"] == F.get(s, i + 1)["h"])
            return F.sort_array(F.transform(F.filter(s, lambda x, i: F.coalesce(twin(x, i), F.lit(False))), lambda x: x["i"]))

        return _let(in_order, repeated)

    def covered(at: Column) -> Column:
        following = F.slice(at, F.lit(2), F.size(at))
        steps = F.zip_with(at, following, lambda p, q: F.least(F.lit(_WINDOW), F.coalesce(q - p, F.lit(_WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda t, s: t + s)

    count = lambda hashes: F.when(
        F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0)
    ).otherwise(_let(places(hashes), covered))
    return F.when(last <= 0, F.lit(0)).otherwise(_let(shifted(words), count))


def _counts() -> Column:
    """A struct of counts over the whole ``text`` (NULL: none)."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    drop = lambda t, chars: F.char_length(t) - F.char_length(F.translate(t, chars, ""))
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("bigint").alias("n_words"),
            F.size(F.array_distinct(words)).cast("bigint").alias("n_distinct"),
            _repeated_words(words).cast("bigint").alias("n_repeat_words"),
        )

    return F.struct(
        _let(_words(text), of_words).alias("w"),
        (F.char_length(text) - drop(text, " " + _SPACES)).cast("bigint").alias("word_chars"),
        drop(text, SYMBOLS).cast("bigint").alias("n_symbols"),
        _let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x)))).cast("bigint").alias("n_dup_lines"),
        _let(lines, lambda x: F.size(x)).cast("bigint").alias("n_lines"),
        drop(text, "0123456789").cast("bigint").alias("n_digits"),
        drop(text, upper).cast("bigint").alias("n_upper"),
        drop(text, ".,;:!?").cast("bigint").alias("n_marks"),
    )


def statistics(documents: DataFrame) -> DataFrame:
    """``documents`` plus a struct ``stats`` of counts over the whole text (NULL: none)."""
    return documents.withColumn("stats", _counts())


def base_failed(stats: Column) -> Column:
    """Fewer than ten words, or more than a fifth of them in repeated five-word windows."""
    words = stats["w"]["n_words"]
    return (words < 10) | (stats["w"]["n_repeat_words"] * 100 > words * 20)


def features(stats: Column) -> dict[str, Column]:
    """What thresholds are learned on; shares are of 0 where there is nothing to share."""
    words = F.greatest(stats["w"]["n_words"], F.lit(1)).cast("double")
    chars = F.greatest(stats["word_chars"], F.lit(1)).cast("double")
    return {
        "n_words": stats["w"]["n_words"].cast("double"),
        "word_length": stats["word_chars"] / words,
        "distinct_share": stats["w"]["n_distinct"] / words,
        "repeat_share": stats["w"]["n_repeat_words"] / words,
        "symbols_per_word": stats["n_symbols"] / words,
        "dup_line_share": stats["n_dup_lines"] / F.greatest(stats["n_lines"], F.lit(1)),
        "digit_share": stats["n_digits"] / chars,
        "upper_share": stats["n_upper"] / chars,
        "marks_per_word": stats["n_marks"] / words,
    }


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self, x: np.ndarray, names: list[str]) -> np.ndarray:
        value = x[:, names.index(self.feature)]
        return value > self.threshold if self.above else value <= self.threshold

    def column(self, found: dict[str, Column]) -> Column:
        value = found[self.feature]
        return value > self.threshold if self.above else value <= self.threshold


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: np.ndarray, names: list[str]) -> np.ndarray:
    out = np.ones(len(x), dtype=bool)
    for condition in rule:
        out &= condition.holds(x, names)
    return out


def _cuts(values: np.ndarray, most: int = 64) -> np.ndarray:
    """Midpoints between quantiles of the values."""
    kept = np.unique(np.quantile(values, np.linspace(0, 1, most + 1)))
    return (kept[1:] + kept[:-1]) / 2


def _grow(x: np.ndarray, bad: np.ndarray, names: list[str], most: int = 4) -> Rule:
    rule: list[Condition] = []
    inside = np.ones(len(x), dtype=bool)
    while len(rule) < most and bad[inside].any() and not bad[inside].all():
        p, n = int(bad[inside].sum()), int((~bad[inside]).sum())
        before, best = math.log2(p / (p + n)), (1e-9, None, None)
        for j, name in enumerate(names):
            for cut in _cuts(x[inside, j]):
                for above in (True, False):
                    now = inside & ((x[:, j] > cut) == above)
                    p1 = int(bad[now].sum())
                    if p1:
                        gain = p1 * (math.log2(p1 / int(now.sum())) - before)
                        if gain > best[0]:
                            best = gain, Condition(name, above, float(cut)), now
        if best[1] is None:
            break
        rule.append(best[1])
        inside = best[2]
    return tuple(rule)


def _worth(rule: Rule, x: np.ndarray, bad: np.ndarray, names: list[str]) -> tuple[float, int, float]:
    inside = _covers(rule, x, names)
    p, n = int(bad[inside].sum()), int((~bad[inside]).sum())
    return (p - n) / max(1, p + n), p, p / max(1, p + n)


def learn_rules(x: np.ndarray, bad: np.ndarray, names: list[str], most: int = 12, least: int = 3) -> list[Rule]:
    """An ordered list of rules that mark bad rows, from features and labels."""
    rules: list[Rule] = []
    order = np.random.Generator(np.random.PCG64(7)).permutation(len(x))
    prune = np.zeros(len(x), dtype=bool)
    prune[order[: len(x) // 3]] = True
    left = np.ones(len(x), dtype=bool)
    while len(rules) < most:
        grow_rows, prune_rows = left & ~prune, left & prune
        rule = _grow(x[grow_rows], bad[grow_rows], names)
        if not rule:
            break
        # keep the beginning of the rule that is worth most on rows it has not seen
        shorter = [rule[:k] for k in range(1, len(rule) + 1)]
        rule = max(shorter, key=lambda r: (_worth(r, x[prune_rows], bad[prune_rows], names)[0], -len(r)))
        _, found, precision = _worth(rule, x[prune_rows], bad[prune_rows], names)
        if found < least or precision < PRECISION:
            break
        rules.append(rule)
        left &= ~_covers(rule, x, names)
    return rules


def fit(documents: DataFrame, labels: DataFrame) -> list[Rule]:
    """Rules for documents of quality 0, from those of at most ``SAMPLE`` labelled rows that pass the base rules.

    Rows without an id or a label teach nothing; of repeated labels of an id all count. Without both kinds of labels
    there are no rules, and everything the base rules pass is kept.
    """
    named = labels.where("doc_id is not null and quality is not null").select(F.col("doc_id").cast("bigint").alias("doc_id"), "quality")
    chosen = named.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(SAMPLE)
    told = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    names = list(features(F.col("stats")))

    def described(counts: Column) -> Column:
        return F.struct(base_failed(counts).alias("failed"), *(c.alias(name) for name, c in features(counts).items()))

    told = told.select("quality", _let(_counts(), described).alias("f")).select("quality", "f.*")
    # an id may have any number of rows: the bound holds after the join
    bounded = told.orderBy(F.xxhash64(*told.columns), *told.columns).limit(SAMPLE)
    rows = sorted((r.quality, *(r[name] for name in names)) for r in bounded.collect() if not r.failed)
    if not rows:
        return []
    bad = np.array([r[0] == 0 for r in rows])
    if bad.all() or not bad.any():
        return []
    return learn_rules(np.array([r[1:] for r in rows], float), bad, names)


def rejected_by(rules: list[Rule], found: dict[str, Column]) -> Column:
    """Number of the first rule that rejects a row, from 1; 0 if none does."""
    verdict = F.lit(0)
    for number, rule in reversed(list(enumerate(rules, 1))):
        holds = F.lit(True)
        for condition in rule:
            holds = holds & condition.column(found)
        verdict = F.when(holds, F.lit(number)).otherwise(verdict)
    return verdict


def judge(documents: DataFrame, rules: list[Rule]) -> DataFrame:
    """``documents`` plus ``stats``, ``base_failed``, ``rule`` (0: none) and ``kept``.

    NULL and empty texts have no words and fail. Rows are judged one by one, so repeated ones alike; ids do not
    matter. Input columns with one of the new names are replaced. An empty table gives no rows.
    """
    def verdict(counts: Column) -> Column:
        rule = rejected_by(rules, features(counts))
        return F.struct(counts.alias("stats"), base_failed(counts).alias("base_failed"), rule.alias("rule"))

    # one value holds all, so the counts are made once
    judged = documents.withColumn("stats", _let(_counts(), verdict))
    judged = judged.withColumns({c: F.col("stats")[c] for c in ("base_failed", "rule", "stats")})
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))


def keep_good(documents: DataFrame, rules: list[Rule]) -> DataFrame:
    """The rows of ``documents`` that are kept, with its own columns only."""
    # a filter of its own, in which the counts are made once
    return documents.where(_let(_counts(), lambda counts: ~base_failed(counts) & (rejected_by(rules, features(counts)) == 0)))
