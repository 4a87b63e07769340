"""Centroid clustering, personal data and ranked search: against brute force, on odd rows, and on what the methods save."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest

from aeroweave.llm import dual_tree, heap_clusters, pii
from aeroweave.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


# clustering


def plain_clusters(rows, k, rounds):
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v and len(v) == 4 and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    centers = [v for _, v in first[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    nearest = lambda v: min(range(len(centers)), key=lambda j: (far(v, centers[j]), j))
    for _ in range(rounds):
        own = [nearest(v) for _, v in kept]
        for j in set(own):
            members = [v for (_, v), o in zip(kept, own, strict=True) if o == j]
            centers[j] = [sum(x) // len(members) for x in zip(*members, strict=True)]
    return sorted((str(i), nearest(v), far(v, centers[nearest(v)])) for i, v in kept), centers


@pytest.mark.parametrize("block", [3, 8192])
def test_clusters_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(heap_clusters, "BLOCK", block)
    rng = np.random.default_rng(4)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(60)]
    rows += [(100 + i, [0.5, 0.5, -0.5, 0.25]) for i in range(30)]  # ties and copies
    rows += [(7, [1.0, 2.0, 3.0, 4.0]), (7, [1.0, 2.0, 3.0, 4.0]), (None, [0.0, 0.0, 0.0, 9.5])]
    rows += [(200, None), (201, []), (202, [1.0]), (203, [1.0, None, 2.0, 3.0]), (204, [math.nan] * 4), (205, [math.inf, 0.0, 0.0, 0.0])]
    rows += [(206, [5000.0, -20000.0, 0.1, 0.0]), (207, [300000.0, -400000.0, 0.1, 0.0])]  # beyond the fast product
    df = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], "vec_id bigint, embedding array<double>, cluster int, block int, vector int")
    assigned, centers = heap_clusters.cluster(df, k=5, rounds=4, width=4)
    want, plain = plain_clusters(rows, 5, 4)
    assert sorted((str(None if math.isnan(r.vec_id) else int(r.vec_id)), r.cluster, r.distance) for r in assigned.toPandas().itertuples()) == want
    assert centers.tolist() == plain
    told = heap_clusters.report(assigned, centers).toPandas()
    assert set(told.inertia) == {sum(d for *_, d in want)} and len(told) == len(want)


def test_clusters_of_few_or_no_rows(spark):
    schema = "vec_id bigint, embedding array<float>"
    assert heap_clusters.report(*heap_clusters.cluster(spark.createDataFrame([], schema))).count() == 0
    few = spark.createDataFrame([(1, [0.0] * 64), (2, [1.0] * 64)], schema)
    assigned, centers = heap_clusters.cluster(few)
    assert len(centers) == 2 and assigned.where("distance = 0").count() == 2
    far = spark.createDataFrame([(1, [1e30] * 64)], schema)
    with pytest.raises(Exception, match="beyond"):
        heap_clusters.cluster(far)[0].count()


def test_heaps_leave_most_vectors_alone():
    rng = np.random.default_rng(8)
    middles = rng.integers(-4000, 4000, (10, 8))
    x = middles[rng.integers(0, 10, 3000)] + rng.integers(-60, 60, (3000, 8))
    bounds, heaps, own, scanned = heap_clusters.Bounds(middles + 40), None, np.zeros(3000, int), []
    for _ in range(6):
        heaps, places, _, new = bounds.reassign(x, heaps)
        own[places] = new
        scanned.append(len(places))
        assert (own == heap_clusters.squared(x, bounds.centroids).argmin(1)).all()
        assert sorted(p for heap in heaps for _, p in heap) == list(range(3000))
        bounds = bounds.moved(np.array([x[own == j].sum(0) // max(1, (own == j).sum()) for j in range(10)]))
    assert scanned[0] == 3000 and max(scanned[1:]) < 300


# personal data


def plain_base(text):
    out = [(*m.span(), "email") for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [
        (*m.span(), "ip") for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))
    ]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = [int(c) for c in m[0] if c.isdigit()][::-1]
        total = sum(d if i % 2 == 0 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits))
        if 14 <= len(digits) <= 19 and total % 10 == 0:
            out.append((*m.span(), "card"))
    out += [(*m.span(), "phone") for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= sum(map(str.isdigit, m[0])) <= 15]
    return sorted(out, key=lambda s: (s[0], pii.KINDS.index(s[2]), s[1]))


def test_base_spans_equal_the_patterns():
    rng = random.Random(3)
    for _ in range(20_000):
        text = "".join(rng.choice("0123456789..--++@@ ()a_%é\n") for _ in range(rng.randint(0, 50)))
        assert pii.base_spans(text) == plain_base(text)
    for text in ("1" * 300_000, "1." * 200_000, "a" * 300_000, "a@" * 200_000, "+1" + "(" * 300_000, "@." * 100_000, "1 " * 150_000):
        pii.base_spans(text)  # linear: ends at once


def all_segmentations(spans):
    for n in range(len(spans) + 1):
        for chosen in itertools.combinations(range(len(spans)), n):
            taken = sorted(spans[k][:2] for k in chosen)
            if all(x[1] <= y[0] for x, y in itertools.pairwise(taken)):
                yield chosen


def test_segmentation_equals_enumeration():
    rng = random.Random(6)
    for _ in range(60):
        spans = list({(a, a + rng.randint(1, 4), rng.choice(pii.KINDS)) for a in (rng.randint(0, 8) for _ in range(8))})
        scores = [rng.uniform(-2, 2) for _ in spans]
        ways = [(math.exp(sum(scores[k] for k in way)), way) for way in all_segmentations(spans)]
        total = sum(w for w, _ in ways)
        for k, p in enumerate(pii.probabilities(spans, scores)):
            assert p == pytest.approx(sum(w for w, way in ways if k in way) / total)
        assert sum(scores[k] for k in pii.best_segments(spans, scores)) == pytest.approx(math.log(max(w for w, _ in ways)))


@pytest.fixture(scope="module")
def windows():
    texts = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["text"])["text"].to_pylist()
    found = defaultdict(dict)
    for text in filter(None, texts):
        for a, b, kind in pii.base_spans(text) or [(m.start(), m.end(), "none") for m in pii._ANCHOR.finditer(text)]:
            found[kind][text[max(0, a - pii.MARGIN) : b + pii.MARGIN]] = None
    return {kind: list(own) for kind, own in found.items()}


def test_field_on_held_out_windows(windows):
    rng = random.Random(11)
    field = pii.train([pii.vary(w, rng) for own in windows.values() for w in own[:100] for _ in range(2)])
    count = Counter()
    for text, labels in (pii.vary(w, random.Random(i)) for own in windows.values() for i, w in enumerate(own[100:])):
        base = pii.base_spans(text)
        added = field.spans(text, base)
        assert not any(x < b and a < y for x, y, _ in base for a, b, _ in added)
        count["right"] += len(set(added) & set(labels))
        count["wrong"] += len(set(added) - set(labels))
        count["lost"] += len(set(labels) - set(added) - set(base))
    assert count["right"] > 80 and count["wrong"] <= 0.05 * count["right"] and count["lost"] <= 0.05 * count["right"], count


def test_pii_query_and_odd_rows(spark):
    got = QUERIES["op12_pii"](spark, SF).toPandas().set_index("doc_id")
    texts = spark.read.parquet(f"{SF}/documents.parquet").toPandas().set_index("doc_id").text.to_dict()
    assert sorted(got.index) == sorted(texts)
    for key, text in texts.items():
        base, r = plain_base(text or ""), got.loc[key]
        assert (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(sum(s[2] == k for s in base) for k in pii.KINDS)
        assert r.base_sha256 == hashlib.sha256(pii.written(base).encode()).hexdigest()
        assert set(pii.written(base).split(",")) <= set(r.spans.split(","))
    field = pii.Field({"email": 0.0})
    schema = "doc_id bigint, text string, base int, spans int, kind int"
    odd = [(1, None), (2, ""), (None, "a@b.co"), (3, "x 😀 a@b.co"), (3, "x 😀 a@b.co"), (4, "1" * 500_000), (5, "7 " * 100_000)]
    rows = pii.find(spark.createDataFrame([(k, t, 0, 0, 0) for k, t in odd], schema), field).collect()
    assert sorted((r.doc_id or 0, [tuple(s) for s in r.base]) for r in rows) == sorted(
        [(1, []), (2, []), (0, [(0, 6, "email")]), (3, [(4, 10, "email")]), (3, [(4, 10, "email")]), (4, []), (5, [])]
    )
    empty = spark.createDataFrame([], schema)
    fitted = pii.fit(empty)
    assert fitted.spans("call (017) 555-7713", []) == [] and pii.find(empty, fitted).count() == 0


# ranked search


def plain_ranked(docs, items, k):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(i, Counter(cut(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, total, df = len(held), sum(sum(c.values()) for _, c in held), Counter(t for _, c in held for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in held:
            m = 50 + 50 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(cut(text)) if t in c)
            if s > 0:
                scored.append((-s, i is None, i or 0))
        out += [(item, r, None if none else i, -s) for r, (s, none, i) in enumerate(sorted(scored)[:k], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("block_bytes", [40, 1 << 18])
def test_ranked_search_equals_brute_force(spark, monkeypatch, block_bytes):
    monkeypatch.setattr(dual_tree, "BLOCK_BYTES", block_bytes)
    monkeypatch.setattr(dual_tree, "ROW_DOCS", 16)
    monkeypatch.setattr(dual_tree, "DOC_LEAF", 4)
    monkeypatch.setattr(dual_tree, "ITEM_LEAF", 2)
    rng = random.Random(5)
    words = ["Ab", "ab", "É", "é", "x1", "日本", "z", "common", "common", "common"]
    docs = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 30)))) for i in range(80)]
    docs += [(5, docs[5][1])] * 3 + [(None, "x1 common"), (None, "x1 common"), (90, None), (91, "--"), (92, "long " * 50_000 + "x1"), (93, "a\x00b é")]
    items = [(1, "AB common!"), (2, "É x1 日本"), (2, "z z z"), (3, "AB common!"), (4, None), (5, ""), (6, "nowhere"), (None, "x1"), (7, "a b é " + "é " * 500)]
    as_df = lambda rows, key: spark.createDataFrame([(i, t, 0, 0, 0) for i, t in rows], f"{key} bigint, text string, rank int, score int, term int")
    got = dual_tree.ranked_search(as_df(docs, "doc_id"), as_df(items, "item_id"), 7).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain_ranked(docs, items, 7)
    nothing = as_df([], "doc_id")
    assert dual_tree.ranked_search(nothing, as_df(items, "item_id")).count() == 0
    assert dual_tree.ranked_search(as_df(docs, "doc_id"), as_df([], "item_id")).count() == 0


def test_search_prunes_node_pairs(spark):
    texts = pq.read_table("/root/testdata/sf0.1/benchmark.parquet", columns=["text"])["text"].to_pylist()
    docs = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["doc_id", "text"])
    vocabulary, items = dual_tree._items(texts)
    rows = [r for b in dual_tree._extract(vocabulary)(docs.to_batches()) for r in b.to_pylist()]
    df = np.zeros(len(vocabulary.hashes), np.int64)
    for r in rows:
        df[r["terms_df"]] += r["counts_df"]
    n, total = sum(r["n_docs"] for r in rows), sum(r["n_terms"] for r in rows)
    weights = np.floor(1000 * np.log((2 * n + 2) / (2 * df + 1))).astype(np.int64)
    run = dual_tree.Search(dual_tree.ItemTree(items, len(weights)), 50)
    for r in rows:
        run.add(dual_tree._Documents(r, weights, n, total, run.tree))
    assert run.scored < 0.7 * len(texts) * n and run.pruned > 0
