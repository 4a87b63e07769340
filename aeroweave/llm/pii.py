"""Personal data: fixed base patterns, and a semi-Markov conditional random field that adds what they miss.

A text is cut in segments: single characters outside any entity, which score 0, and entities of at most
``LONGEST`` characters. An entity is scored as a whole: its kind, the shape of the whole span, digits, groups,
separators, checksum, the characters around it and the word before it. The best segmentation and the probability of
each of its entities come from one dynamic programme over the boundaries of the candidates. Outside candidates nothing
scores, so stretches without them need no work and the answer is that of the whole text.

The model is trained here, by conditional likelihood, on at most ``SAMPLE`` windows of text per kind and as many
without an entity. The base patterns label them. Some spans are rewritten first (a telephone number without
its plus, a masked address) or replaced by something that only resembles them (dates, versions,
numbers that fail a checksum), so that the field learns more than the patterns know.
"""

from __future__ import annotations

import hashlib
import heapq
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Memory, stored

KINDS = ("email", "ip", "card", "phone")
#: Training windows per kind, and without an entity; they are chosen by hash of their text.
SAMPLE = 250
#: Longest entity that the field proposes, and text kept around a training span.
LONGEST, MARGIN = 64, 48
#: Added entities need this probability.
CONFIDENCE = 0.9
#: Most tokens of an entity.
_TOKENS = 24
_SCORES = 200_000

Span = tuple[int, int, str]

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+(?=@)", re.A)
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_PARTS = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    """Whether the last digit checks the others."""
    twice = [2 * int(d) for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in twice)) % 10 == 0


def _emails(text: str) -> list[Span]:
    out, at, low = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, found.end(), "email"))
        # the characters up to here belong to no later local part, unless a match ended earlier
        low = found.end() if found else at + 1
        at = text.find("@", low)
    return out


def _addresses(text: str) -> list[Span]:
    out = []
    for chain in _PARTS.finditer(text):
        parts = [(chain.start() + m.start(), chain.start() + m.end()) for m in re.finditer("[0-9]+", chain[0])] if chain[0].count(".") > 2 else []
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in (text[a:b].lstrip("0") for a, b in four)):
                out.append((four[0][0], four[3][1], "ip"))
    return out


def base_spans(text: str) -> list[Span]:
    """What the fixed patterns find, ordered by start, then kind as listed; offsets are code points.

    Per kind leftmost and non-overlapping; a match that fails its check is dropped and not tried again. Time is
    linear in the text.
    """
    out = _emails(text)
    out += _addresses(text)
    for m in _DIGITS.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((*m.span(), "card"))
    if "+" in text:
        out += [(*m.span(), "phone") for m in _PHONE.finditer(text) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
    return in_order(out)


def in_order(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def written(spans: list[Span]) -> str:
    """``kind:start:end`` of all, comma-joined."""
    return ",".join(f"{kind}:{a}:{b}" for a, b, kind in spans)


# candidates

_TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|[^\W\d_]+| ?[(\[{] ?(?:at|AT|dot|DOT) ?[)\]}] ?|[(\[{]\.[)\]}]|.", re.S)
_AT = re.compile(r" ?[(\[{] ?(?:at|AT) ?[)\]}] ?")
_DOT = re.compile(r" ?[(\[{] ?(?:dot|DOT) ?[)\]}] ?|[(\[{]\.[)\]}]")
_ANCHOR = re.compile(r"[0-9]++|@|[(\[{] ?(?:at|AT) ?[)\]}]")


def _islands(text: str):
    """Stretches that hold every candidate: ``LONGEST`` characters around digits and at-signs."""
    low = high = -1
    for m in _ANCHOR.finditer(text):
        if m.start() - LONGEST > high:
            if high >= 0:
                yield low, high
            low = max(0, m.start() - LONGEST)
        high = min(len(text), m.end() + LONGEST)
    if high >= 0:
        yield low, high


def candidates(text: str, low: int, high: int) -> list[Span]:
    """Spans within an island that may be entities: what a kind cannot do without, nothing more."""
    tokens = [(m.start(), m.end(), m[0]) for m in _TOKEN.finditer(text, low, high)]
    out = []
    for i, (start, _, first) in enumerate(tokens):
        numeric = first[0] in "+(" or "0" <= first[0] <= "9"
        digits = groups = 0
        for _, end, token in tokens[i : i + _TOKENS] if numeric else ():
            if end - start > LONGEST or not (token in " .-()/+" or "0" <= token[0] <= "9" or _DOT.fullmatch(token)):
                break
            if "0" <= token[0] <= "9":
                digits, groups = digits + len(token), groups + 1
                if digits > 19:
                    break
                if groups == 4 and digits <= 12:
                    out.append((start, end, "ip"))
                if digits >= 12:
                    out.append((start, end, "card"))
                if 7 <= digits <= 15:
                    out.append((start, end, "phone"))
        if first[0].isascii() and first[0].isalnum():
            at = dots = 0
            for _, end, token in tokens[i : i + _TOKENS]:
                if end - start > LONGEST:
                    break
                if token == "@" or _AT.fullmatch(token):
                    at += 1
                    if at > 1:
                        break
                elif token == "." or _DOT.fullmatch(token):
                    dots += at
                elif token[0].isascii() and token[0].isalnum():
                    if at and dots:
                        out.append((start, end, "email"))
                elif token not in "_%+-":
                    break
    return out


def _near(text: str, at: int) -> str:
    if not 0 <= at < len(text):
        return "edge"
    c = text[at]
    return "digit" if c.isdigit() else "letter" if c.isalpha() else "space" if c.isspace() else c


_WORD_BEFORE = re.compile(r"([A-Za-z]{1,12})[^A-Za-z0-9]{0,4}\Z")


def features(text: str, span: Span) -> tuple[str, ...]:
    """Names of the features of a whole candidate span, its surroundings included."""
    start, end, kind = span
    body = text[start:end]
    marked = _DOT.sub("\x01" if kind == "ip" else "\x02", _AT.sub("\x03", body)) if any(c in body for c in "([{") else body
    digits = re.findall("[0-9]+", body)
    number = "".join(digits)
    if kind == "email":
        shape = re.sub(r"(?:x\.){2,}", "x.x.", re.sub("[A-Za-z0-9]+", "x", marked))
        last = re.search("[A-Za-z0-9]+$", body)
        facts = [f"last{last[0].isalpha() if last else None}{min(len(last[0]), 7) if last else 0}"]
    else:
        shape = re.sub("[0-9]+", lambda m: str(len(m[0])) if kind != "ip" else "d", marked)
        facts = [f"n{len(number)}", f"g{len(digits)}", f"s{''.join(sorted(set(re.sub('[0-9]', '', marked))))}"]
        if kind == "card":
            facts.append(f"luhn{luhn(number)}")
        if kind == "ip":
            facts.append(f"octets{all(len(d) <= 3 and int(d) <= 255 for d in digits)}")
        if kind == "phone":
            facts += [f"lead{body[0] if not body[0].isdigit() else 'd'}", f"pairs{body.count('(') == body.count(')')}", f"tail{len(digits[-1])}"]
    before, after = _near(text, start - 1), _near(text, end)
    facts += [f"shape{shape}", f"before{before}", f"after{after}", f"after2{after}{_near(text, end + 1)}", f"before2{_near(text, start - 2)}{before}"]
    word = _WORD_BEFORE.search(text, max(0, start - 16), start)
    facts.append(f"word{word[1].lower() if word else ''}")
    return (kind, *(f"{kind}|{x}" for x in facts))


# the field


def _chart(spans: list[Span], scores: list[float]) -> tuple[list[int], dict[int, list[int]]]:
    """Boundaries in order, and the candidates that end at each."""
    ending = defaultdict(list)
    for k, (_, b, _) in enumerate(spans):
        ending[b].append(k)
    return sorted({x for a, b, _ in spans for x in (a, b)}), ending


def _add(x: float, y: float) -> float:
    if x < y:
        x, y = y, x
    return x + math.log1p(math.exp(y - x))


def probabilities(spans: list[Span], scores: list[float]) -> list[float]:
    """Probability of every candidate, over all segmentations (forward and backward sums)."""
    points, ending = _chart(spans, scores)
    ahead, last = {}, 0.0
    for p in points:
        for k in ending.get(p, ()):
            last = _add(last, ahead[spans[k][0]] + scores[k])
        ahead[p] = last
    behind = dict.fromkeys(points, 0.0)
    starting = defaultdict(list)
    for k, (a, _, _) in enumerate(spans):
        starting[a].append(k)
    rest = 0.0
    for p in reversed(points):
        for k in starting.get(p, ()):
            rest = _add(rest, behind[spans[k][1]] + scores[k])
        behind[p] = rest
    return [math.exp(min(0.0, ahead[a] + s + behind[b] - last)) for (a, b, _), s in zip(spans, scores, strict=True)]


def best_segments(spans: list[Span], scores: list[float]) -> list[int]:
    """Candidates of the best segmentation: boundaries and kinds are chosen together."""
    points, ending = _chart(spans, scores)
    best, chosen, value, last = {}, {}, 0.0, None
    for p in points:
        for k in ending.get(p, ()):
            now = best[spans[k][0]][0] + scores[k]
            if now > value:
                value, last = now, (k, best[spans[k][0]][1])
        best[p] = value, last
    out = []
    while last:
        out.append(last[0])
        last = last[1]
    return out[::-1]


class Field:
    """Feature weights of a fitted field."""

    def __init__(self, weights: dict[str, float]):
        self.weights = weights
        self.kinds = {k for k in KINDS if k in weights}

    def spans(self, text: str, base: list[Span], confidence: float = CONFIDENCE, memory: Memory | None = None) -> list[Span]:
        """Entities that the field adds: none overlaps one of ``base`` or another."""
        out = []
        if not self.weights:
            return out
        taken = 0
        for low, high in _islands(text):
            found = [s for s in candidates(text, low, high) if s[2] in self.kinds]
            if not found:
                continue
            # the field sees base spans too: they win or lose against their rivals like all others
            scores = [self.score(text, s, memory) for s in found]
            segments = best_segments(found, scores)
            if not segments:
                continue
            sure = probabilities(found, scores)
            for k in segments:
                a, b, kind = found[k]
                while taken < len(base) and base[taken][1] <= a - LONGEST:
                    taken += 1
                if sure[k] >= confidence and not any(x < b and a < y for x, y, _ in base[taken:] if x < b):
                    out.append((a, b, kind))
        return out

    def score(self, text: str, span: Span, memory: Memory | None) -> float:
        start, end, kind = span
        key = kind, text[start:end], text[max(0, start - 16) : start], text[end : end + 2]
        got = memory.find(key) if memory else None
        if got is None:
            got = sum(self.weights.get(f, 0.0) for f in features(text, span))
            if memory:
                memory.put(key, got)
        return got


# training

_MASKED = [("[at]", "[dot]"), (" (at) ", " (dot) "), ("(at)", "."), (" [at] ", "."), ("@", "[.]")]


def _rewritten(kind: str, body: str, rng: random.Random) -> str:
    """Another way to write the entity."""
    if kind == "email":
        at, dot = rng.choice(_MASKED)
        local, _, domain = body.partition("@")
        return local + at + domain.replace(".", dot)
    digits = re.sub("[^0-9]", "", body)
    if kind == "ip":
        return body.replace(".", rng.choice(["[.]", "(.)"]))
    if kind == "card":
        return rng.choice([".", "/", "  "]).join(digits[i : i + 4] for i in range(0, len(digits), 4))
    area, middle, tail = digits[-10:-7], digits[-7:-4], digits[-4:]
    return rng.choice([f"({area}) {middle}-{tail}", f"{area}-{middle}-{tail}", f"{area}.{middle}.{tail}", f"1-{area}-{middle}-{tail}", f"({area}){middle}-{tail}", f"{area} {middle} {tail}"])


def _resembling(kind: str, rng: random.Random) -> str:
    """Something of the same look that is nobody's data."""
    n = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    if kind == "email":
        return rng.choice([f"{n(2)}@{n(3)}", f"@user{n(2)}.name", f"a.{n(1)}@", f"{n(3)} (at) {n(2)}"])
    if kind == "ip":
        return rng.choice([f"{rng.randint(256, 999)}.{n(3)}.{n(2)}.{rng.randint(300, 999)}", f"{n(1)}.{n(1)}.{n(1)}", f"{n(2)}.{n(3)}.{n(3)}", f"{n(1)}.{n(6)}"])
    if kind == "card":
        body = n(rng.choice([12, 13, 15, 16, 16, 16, 17, 18]))
        body = body if not luhn(body) else body[:-1] + str((int(body[-1]) + 1) % 10)
        return rng.choice([body, body, ".".join(body[i : i + 4] for i in range(0, len(body), 4))])
    date = f"{rng.randint(1900, 2099)}-{rng.randint(1, 12):02}-{rng.randint(1, 28):02}"
    return rng.choice([
        date, f"{date} {n(2)}", f"{n(10)}", f"{n(7)}", f"{n(8)}", f"{n(9)}", f"{n(1)},{n(3)},{n(3)}", f"{n(3)}.{n(3)}.{n(3)}", f"{n(4)}-{n(4)}", f"978-{n(1)}-{n(2)}-{n(6)}-{n(1)}",
        f"{n(2)}/{n(2)}/{n(4)}", f"{n(4)} {n(4)}", f"{n(4)}-{n(4)} {n(4)}", f"{n(11)}", f"{n(3)}-{n(2)}-{n(4)}", f"{n(1)} {n(3)} {n(3)}", f"{n(5)}-{n(4)}",
    ])


Window = tuple[str, list[Span]]


def _disjoint(spans: list[Span]) -> list[Span]:
    out: list[Span] = []
    for s in sorted(spans, key=lambda s: (s[0], -s[1], KINDS.index(s[2]))):
        if not out or s[0] >= out[-1][1]:
            out.append(s)
    return out


def vary(text: str, rng: random.Random) -> Window:
    """A window with its entities kept, rewritten or replaced, and the spans of those that are left."""
    out, labels, at = [], [], 0
    size = 0
    for a, b, kind in _disjoint(base_spans(text)):
        draw = rng.random()
        body = text[a:b] if draw < 0.3 else _rewritten(kind, text[a:b], rng) if draw < 0.65 else _resembling(kind, rng)
        out += [text[at:a], body]
        size += a - at
        if draw < 0.65:
            labels.append((size, size + len(body), kind))
        size, at = size + len(body), b
    return "".join(out) + text[at:], labels


def train(windows: list[Window], epochs: int = 10, rate: float = 0.4, shrink: float = 1e-4) -> Field:
    """Weights by stochastic ascent of the conditional likelihood (steps scaled per feature)."""
    common = Counter(f for text, labels in windows for s in labels for f in set(features(text, s)) if "|word" in f)
    told = []
    for text, labels in windows:
        spans = [s for low, high in _islands(text) for s in candidates(text, low, high)]
        if spans:
            names = [[f for f in features(text, s) if "|word" not in f or common[f] > 4] for s in spans]
            told.append((spans, names, [s in labels for s in spans]))
    weights: dict[str, float] = defaultdict(float)
    seen: dict[str, float] = defaultdict(float)
    order = random.Random(5)
    for _ in range(epochs):
        order.shuffle(told)
        for spans, names, gold in told:
            sure = probabilities(spans, [sum(weights[f] for f in own) for own in names])
            steps: dict[str, float] = defaultdict(float)
            for own, p, y in zip(names, sure, gold, strict=True):
                if y or p > 1e-6:
                    for f in own:
                        steps[f] += y - p
            for f, g in steps.items():
                g -= shrink * weights[f]
                seen[f] += g * g
                weights[f] += rate * g / math.sqrt(1e-6 + seen[f])
    return Field({f: w for f, w in weights.items() if w})


def sample_windows(documents: DataFrame, most: int = SAMPLE) -> list[str]:
    """At most ``most`` different windows per kind, and as many without an entity, by hash of their text.

    A task keeps the windows of smallest hash only, so what reaches the driver is bounded in number and length.
    """

    def collect(batches):
        held: dict[str, list] = defaultdict(list)
        known = set()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                if not text or not _ANCHOR.search(text):
                    continue
                spans = base_spans(text)
                places = [(a, b, kind) for a, b, kind in spans] or [(m.start(), m.end(), "none") for m in _ANCHOR.finditer(text)]
                for a, b, kind in places:
                    if b - a > LONGEST:
                        continue
                    window = text[max(0, a - MARGIN) : b + MARGIN]
                    h = int.from_bytes(hashlib.blake2b(window.encode(errors="surrogatepass"), digest_size=8).digest(), "big", signed=True)
                    heap = held[kind]
                    if (kind, h) in known or (len(heap) >= most and -heap[0][0] <= h):
                        continue
                    known.add((kind, h))
                    if len(heap) >= most:
                        known.discard((kind, -heapq.heapreplace(heap, (-h, window))[0]))
                    else:
                        heapq.heappush(heap, (-h, window))
        rows = [(kind, -h, window) for kind, heap in held.items() for h, window in heap]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int64(), pa.string()))], ["kind", "h", "window"])

    rows = stored(documents.select("text").mapInArrow(collect, "kind string, h bigint, window string"), "windows")
    out = []
    for kind in (*KINDS, "none"):
        chosen = rows.where(F.col("kind") == kind).select("h", "window").distinct().orderBy("h", "window").limit(most)
        out += [r.window for r in chosen.collect()]
    return out


def fit(documents: DataFrame, most: int = SAMPLE) -> Field:
    """A field for these documents. A kind that no sampled window shows is never added; without windows nothing is."""
    windows = sample_windows(documents, most)
    rng = random.Random(11)
    return train([vary(text, rng) for text in windows for _ in range(2)])


def find(documents: DataFrame, field: Field, confidence: float = CONFIDENCE) -> DataFrame:
    """``doc_id, base, spans``: arrays of ``(start, end, kind)`` in code points for every row of ``documents(doc_id, text)``.

    ``base`` is what the fixed patterns find, ``spans`` that and what the field adds. Every whole text is read, its
    cost is linear in its length. NULL and empty texts have no spans; rows are judged one by one, so repeated rows
    alike, and a row without an id is returned as well. Other columns are ignored; no rows give no rows.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
    as_rows = lambda spans: [{"start": a, "end": b, "kind": k} for a, b, k in spans]

    def judge(batches):
        memory = Memory(_SCORES)
        for batch in batches:
            base, spans = [], []
            for text in batch.column(1).to_pylist():
                own = base_spans(text) if text and _ANCHOR.search(text) else []
                base.append(as_rows(own))
                spans.append(as_rows(in_order(own + (field.spans(text, own, confidence, memory) if text else []))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, kind), pa.array(spans, kind)], ["doc_id", "base", "spans"])

    entity = "array<struct<start: bigint, end: bigint, kind: string>>"
    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return docs.mapInArrow(judge, f"doc_id bigint, base {entity}, spans {entity}")
