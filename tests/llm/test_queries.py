"""Registered training-data queries on the smallest tables: against SQL, or against plain Python."""

import hashlib
import json
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import xxhash
from conftest import SF_DIR
from tokenizers import Tokenizer

import corpus_pipeline
from aeroweave.llm import imatch, quality, url_filter
from aeroweave.llm.oracle import ORACLES
from aeroweave.llm.queries import QUERIES, URL_RULES, conversation_log


def rows_of(pdf):
    pdf = pdf[sorted(pdf.columns)]
    return sorted(pdf.astype(object).where(pdf.notna(), None).astype(str).agg("|".join, axis=1).tolist())


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF_DIR}/documents.parquet").toPandas().set_index("doc_id").text.to_dict()


@pytest.fixture(scope="module")
def result(spark):
    made = {}

    def get(name):
        if name not in made:
            made[name] = QUERIES[name](spark, SF_DIR).toPandas()
        return made[name]

    return get


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(result, name):
    con = duckdb.connect()
    for table in ("documents", "conversations", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF_DIR}/{table}.parquet'")
    want = con.execute(ORACLES[name]).df()
    assert rows_of(result(name)) == rows_of(want)


def library_ids(docs, name, end):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(name))
    return {k: tokenizer.encode(t or "", add_special_tokens=False).ids + end for k, t in docs.items()}


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_packing(result, docs):
    ids = library_ids(docs, "byte_bpe_50k.json", [1])
    got = result("op2_packing")
    covered = Counter()
    for r in got.itertuples():
        own = ids[r.doc_id]
        assert r.ids_crc32 == crc(own[r.start : r.start + r.length]) and r.doc_tokens == len(own)
        covered.update((r.doc_id, i) for i in range(r.start, r.start + r.length))
    assert set(covered.values()) == {1} and len(covered) == sum(map(len, ids.values()))
    ordered = got.sort_values(["sequence_id", "offset"])
    assert (ordered.groupby("sequence_id").length.cumsum() - ordered.length == ordered.offset).all()
    full = ordered.groupby("sequence_id").length.sum()
    assert full.max() <= 2048 and len(full) <= full.sum() / 2048 * 1.01 + 1


def test_bpe(result, docs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in result("op3_bpe").itertuples():
        ids = tokenizer.encode(docs[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == digest(" ".join(map(str, ids)))
        assert r.decoded_sha256 == digest(tokenizer.decode(ids, skip_special_tokens=False))
    assert len(result("op3_bpe")) == len(docs)


def test_url_filter(spark, result):
    urls = spark.read.parquet(f"{SF_DIR}/pages.parquet").toPandas().set_index("page_id").url.to_dict()
    got = result("op4_url_filter")
    assert sorted(got.page_id) == sorted(urls)
    for r in got.itertuples():
        found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", urls[r.page_id] or "")
        host, path = (found[1].lower(), found[2]) if found else ("", "")
        fit = [x for x in URL_RULES if ("." + host).endswith("." + x[0]) and path.startswith(x[1])]
        rule = max(fit, key=lambda x: (len(x[0]), len(x[1])), default=None)
        assert (r.host, r.path, r.rule) == (host, path, rule and rule[0] + rule[1])
        assert r.verdict == (rule[2] if rule else r.verdict) and r.verdict in ("allow", "block")


def plain_log_p(seen, gram):
    """Witten-Bell estimate of the last of four symbols, straight from the four-symbol counts ``seen``."""
    p = 1 / len(url_filter.SYMBOLS)
    for order in range(len(gram)):
        after = Counter()
        for other, n in seen.items():
            if other[len(gram) - 1 - order : -1] == gram[len(gram) - 1 - order : -1]:
                after[other[-1]] += n
        if after:
            p = (after[gram[-1]] + len(after) * p) / (after.total() + len(after))
    return math.log(p)


def test_url_verdicts_follow_the_models(spark):
    urls = [f"http://a.org/{w}" for w in ("fr/x1", "fr/y2", "fr/x2", "fr/é", "de/x1", "de/z2", "de/z3", "de/Q?u=1")]
    urls += [f"http://b.net/{w}" for w in ("fr/x", "de/z", "fr/z9", "de/y", "")] + [None, "", "none", "http://a.org/de/z3"]
    told = [("org", "/fr/", "allow"), ("org", "/de/", "block")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    fold = {u: f for u, f in pages.selectExpr("url", "pmod(xxhash64(url), 5)").collect()}
    symbols = url_filter.SYMBOLS

    def grams(url):
        one = [symbols[0]] * 3 + [c if c in symbols[1:-1] else symbols[-1] for c in re.sub("[A-Z]", lambda m: m[0].lower(), url or "")] + [symbols[0]]
        return ["".join(one[i - 3 : i + 1]) for i in range(3, len(one))]

    def score(url, taught):
        seen = {v: Counter(g for u in taught if ("/fr/" in u) == v for g in grams(u)) for v in (True, False)}
        return sum(plain_log_p(seen[True], g) - plain_log_p(seen[False], g) for g in grams(url)) / len(grams(url))

    decided = [u for u in urls if u and "a.org/" in u]
    place = lambda x: min(max(math.floor((x + 10) / 20 * 2000), 0), 1999)
    held = [(place(score(u, [t for t in decided if fold[t] != fold[u]])), "/fr/" in u) for u in decided]
    gain = [
        sum(p < b for p, good in held if not good) / sum(not good for _, good in held) + sum(p >= b for p, good in held if good) / sum(good for _, good in held)
        for b in range(2001)
    ]
    top = [b for b, g in enumerate(gain) if g >= max(gain) - 1e-12]
    threshold = (min(top) + max(top)) / 2 / 2000 * 20 - 10
    got = {r.page_id: r for r in url_filter.judge_urls(pages, told).collect()}
    for i, url in enumerate(urls):
        want = score(url, decided)
        assert abs(got[i].score - want) < 1e-9
        ruled = url in decided
        assert got[i].verdict == (("allow" if "/fr/" in url else "block") if ruled else "allow" if want >= threshold else "block")
    assert {got[i].verdict for i, u in enumerate(urls) if u not in decided} == {"allow", "block"}


def test_conversation_log_drafts_edits_and_regenerates(spark):
    log = conversation_log(spark.read.parquet(f"{SF_DIR}/conversations.parquet")).toPandas()
    assert set(log.kind) == {"start", "delta", "edit", "regenerate"}
    assert len(log) > 2.5 * len(log.drop_duplicates(["conv_id", "message"]))


def test_url_models_tell_held_out_rules_apart(spark):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    told = [("com", "/fr/", "allow"), ("com", "/de/", "block"), ("net", "/fr/", "allow"), ("net", "/de/", "block")]
    judged = url_filter.judge_urls(pages, told).where("rule is null and (path like '/fr/%' or path like '/de/%')").toPandas()
    right = (judged.path.str[1:3] == "fr") == (judged.verdict == "allow")
    assert len(judged) > 100 and right.mean() > 0.95


def test_sharding(result, docs):
    got = result("op5_sharding")
    assert sorted(got.doc_id) == sorted(docs) and set(got.shard) == set(range(24))
    counts = got.groupby("shard").slot.agg(["count", "min", "max", "nunique"])
    assert counts["count"].max() - counts["count"].min() <= 1 and (counts["min"] == 0).all()
    assert (counts["max"] == counts["count"] - 1).all() and (counts["nunique"] == counts["count"]).all()
    for r in got.itertuples():
        raw = (docs[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32) == (len(raw) + 8, zlib.crc32(raw))


def test_token_store(result, docs):
    ids = library_ids(docs, "word_bpe_49k.json", [2])
    at = 0
    for r in result("op9_token_store").sort_values("doc_id").itertuples():
        own = ids[r.doc_id]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(own), crc(own))
        at += len(own)
    assert at == sum(map(len, ids.values()))


def test_fingerprints(result, docs):
    got = result("op8_fingerprints").set_index("doc_id")
    order = sorted(docs, reverse=True)
    prints = {}
    for key, following in zip(order, order[1:] + order[:1], strict=True):
        text, other, r = docs[key] or "", docs[following] or "", got.loc[key]
        half = len(text) // 2
        edited = text[: len(text) - half] + other[:half]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert prints.setdefault(text, r.fingerprint) == r.fingerprint
        if edited == text:
            assert r.edited_fingerprint == r.fingerprint and r.near_edited == 1
        if other == text:
            assert r.near_next == 1
    assert got.near_edited.between(0, 1).all() and got.near_edited.mean() > 3 * got.near_next.mean()


def chained(parts, seed=42):
    """Spark's hash of a row or array: each value is hashed with the hash so far as seed."""
    for part in parts:
        seed = xxhash.xxh64_intdigest(part, seed=seed)
    return seed - (1 << 64) if seed >> 63 else seed


def long_bytes(value):
    return value.to_bytes(8, "little", signed=True)


def test_fingerprints_against_plain_hashing(result, docs):
    words = lambda text: {w for w in re.split(r"[ \t\n\x0b\x0c\r]", text.lower()) if w}
    df = Counter(w for text in docs.values() for w in words(text or ""))
    band = {w: chained([w.encode()]) for w, n in df.items() if n > 1 and imatch.LOW * len(docs) <= n <= imatch.HIGH * len(docs)}
    holds = {
        t: [chained([long_bytes(t), k.to_bytes(4, "little")]) % 10_000 < int(rate * 10_000) for k, rate in enumerate(imatch.SUBSETS)]
        for t in band.values()
    }

    def fingerprint(text):
        found = sorted(t for w in words(text) if (t := band.get(w)) is not None and any(holds[t]))
        if not found:
            return f"text-{chained([text.encode()]) % 2**64:X}"
        kept = [[t for t in found if holds[t][k]] for k in range(len(imatch.SUBSETS))]
        return "-".join(f"{chained(map(long_bytes, ts)) % 2**32:08x}" if ts else "" for ts in kept)

    def alike(a, b):
        if a == b or a.startswith("text-") or b.startswith("text-"):
            return float(a == b)
        told = [x == y for x, y in zip(a.split("-"), b.split("-"), strict=True) if x or y]
        return sum(told) / len(told)

    order = sorted(docs, reverse=True)
    got = result("op8_fingerprints").set_index("doc_id")
    for key, following in zip(order, order[1:] + order[:1], strict=True):
        text, other, r = docs[key] or "", docs[following] or "", got.loc[key]
        edited = text[: len(text) - len(text) // 2] + other[: len(text) // 2]
        assert (r.fingerprint, r.edited_fingerprint) == (fingerprint(text), fingerprint(edited))
        assert abs(r.near_edited - alike(r.fingerprint, r.edited_fingerprint)) < 1e-12
        assert abs(r.near_next - alike(r.fingerprint, fingerprint(other))) < 1e-12
    assert sum(p.startswith("text-") for p in got.fingerprint) < len(got) / 2


def test_ranges_stay_even_beside_an_outlying_id(spark, monkeypatch):
    monkeypatch.setattr(imatch, "RANGE_BYTES", 1000)
    monkeypatch.setattr(imatch, "_KNOTS", 8)
    text = "repeat('x', 50) as text"
    docs = spark.range(3000).selectExpr("if(id = 2999, 1000000000000000000, id) as doc_id", text)
    docs = docs.unionByName(spark.range(5).selectExpr("cast(null as bigint) as doc_id", text))
    got = imatch.with_ranges(docs).toPandas()
    sizes = got[got.doc_id.notna()].groupby("part").size()
    assert len(got) == 3005 and sizes.max() < 40 and (got.part[got.doc_id.isna()] == -1).all()
    named = got.dropna().sort_values("doc_id")
    assert named.part.is_monotonic_increasing
    assert imatch.with_ranges(docs.where("false")).count() == 0


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    at = {}
    for i in range(len(words) - 4):
        at.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {p + k for places in at.values() if len(places) > 1 for p in places for k in range(5)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    symbols = len(re.findall(r"[#*$%&|<>]", text or ""))
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, result, docs):
    got = result("op10_quality_rules").set_index("doc_id")
    for key, text in docs.items():
        r, want = got.loc[key], plain_counts(text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert r.kept == (not r.base_failed and r["rule"] == 0)


def test_quality_counts_are_made_once_and_verdicts_are_the_rules(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rules = quality.fit(docs, labels)
    plan = quality.keep_good(docs, rules)._jdf.queryExecution().optimizedPlan().toString()
    assert rules and plan.count("xxhash64(") == quality.statistics(docs)._jdf.queryExecution().optimizedPlan().toString().count("xxhash64(")
    judged = quality.judge(docs, rules)
    found = quality.features(judged["stats"])
    rows = judged.select("kept", "base_failed", "rule", *(c.alias(name) for name, c in found.items())).toPandas()
    x = rows[list(found)].to_numpy(float)
    first = np.zeros(len(x), int)
    for number, rule in reversed(list(enumerate(rules, 1))):
        first[quality._covers(rule, x, list(found))] = number
    assert (rows["rule"] == first).all() and (rows.kept == (~rows.base_failed & (first == 0))).all()
    assert quality.keep_good(docs, rules).count() == rows.kept.sum()


def test_fit_collects_a_bounded_number_of_rows(spark, monkeypatch):
    monkeypatch.setattr(quality, "SAMPLE", 50)
    seen = []
    monkeypatch.setattr(quality, "learn_rules", lambda x, bad, names: seen.append(len(x)) or [])
    text = "one two three four five six seven eight nine ten eleven"
    docs = spark.range(3000).selectExpr("id % 2 as doc_id", f"concat('{text}', ' ', id) as text")
    quality.fit(docs, spark.createDataFrame([(0, 0), (1, 1)], "doc_id bigint, quality int"))
    assert seen == [50]


def test_learned_rules_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rules = quality.fit(docs.where("doc_id % 3 <> 0"), labels)
    held = quality.judge(docs.where("doc_id % 3 = 0"), rules).where("not base_failed").join(labels, "doc_id").toPandas()
    bad = held.quality == 0
    assert (~held.kept[bad]).mean() > 0.9 and held.kept[~bad].mean() > 0.98


def shingle_sets(docs, width):
    out = {}
    for key, text in docs.items():
        w = (text or "").encode().lower().split()
        out[key] = {tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set())
    return out


def components(sets, percent):
    parent = {k: k for k in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[i + 1 :]:
            if sets[a] and sets[b]:
                common = len(sets[a] & sets[b])
                if 100 * common >= percent * (len(sets[a]) + len(sets[b]) - common) and root(a) != root(b):
                    parent[max(root(a), root(b))] = min(root(a), root(b))
    return {k: root(k) for k in keys}


def without_repeats(docs, window=13):
    first = {}
    for key in sorted(docs):
        w = (docs[key] or "").encode().split()
        for i in range(len(w) - window + 1):
            first.setdefault(tuple(w[i : i + window]), key)
    out = {}
    for key, text in docs.items():
        w = (text or "").encode().split()
        gone = set()
        for i in range(len(w) - window + 1):
            if first[tuple(w[i : i + window])] < key:
                gone.update(range(i, i + window))
        out[key] = b" ".join(x for i, x in enumerate(w) if i not in gone).decode() if gone else text
    return out


def test_pipeline(spark, docs):
    at = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = at.dtypes
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    rules = quality.fit(at, labels)
    verdicts = quality.judge(at, rules).select("doc_id", "kept").toPandas()
    now = {k: docs[k] for k, kept in zip(verdicts.doc_id, verdicts.kept, strict=True) if kept}
    kept = corpus_pipeline.keep_good(spark, at, SF_DIR)
    assert kept.dtypes == columns and kept.toPandas().set_index("doc_id").text.to_dict() == now

    groups = components(shingle_sets(now, 5), 80)
    now = {k: t for k, t in now.items() if groups[k] == k}
    single = corpus_pipeline.keep_one_copy(spark, kept, SF_DIR)
    assert single.dtypes == columns and single.toPandas().set_index("doc_id").text.to_dict() == now

    now = without_repeats(now)
    cut = corpus_pipeline.drop_repeats(spark, single, SF_DIR)
    got = cut.toPandas().set_index("doc_id")
    assert cut.dtypes == columns and got.text.to_dict() == now and got.n_chars.to_dict() == {k: len(t) for k, t in now.items()}

    packed = QUERIES_PIPELINE(spark, SF_DIR).toPandas()
    ids = library_ids(now, "byte_bpe_50k.json", [1])
    assert packed.groupby("doc_id").length.sum().to_dict() == {k: len(v) for k, v in ids.items()}
    assert all(r.ids_crc32 == crc(ids[r.doc_id][r.start : r.start + r.length]) for r in packed.itertuples())


QUERIES_PIPELINE = corpus_pipeline.run


def test_stages_are_the_dealt_ones():
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["quality_rules", "ngram_jaccard_join", "substring_dedup", "packing"]
    assert json.dumps(corpus_pipeline.ORACLE_SQL) == "null"
