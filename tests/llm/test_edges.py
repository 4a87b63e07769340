"""Nulls, empty and long texts, ties, repeated rows, empty tables and extra columns, for every operator."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from aeroweave.llm import bpe, chat, imatch, jaccard_join, packing, quality, sharding, substring, token_store, url_filter, words
from aeroweave.llm.components import connected_components
from aeroweave.llm.library_tokens import LibraryTokens
from aeroweave.session import scratch_path

LONG = " ".join(f"w{i % 977}x{i}" for i in range(30_000))
SCHEMA = "doc_id bigint, text string, n int, cls string, part string, shingle string, closing int, `group` int, chunk int, stats int"
WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def odd(spark):
    """Rows with every odd case, and columns whose names the operators use inside."""
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [
        (1, "a b c d e f g h i j k"), (2, "a b c d e f g h i j k"), (2, "a b c d e f g h i j k"), (3, None), (4, ""), (5, " \t\n "),
        (6, "one"), (7, "ONE"), (8, LONG), (9, LONG + " tail"), (None, "no id here at all"), (None, None), (10, passage + " x"), (11, "y " + passage),
        (12, "é日本 <|endoftext|> \x1c 🙂"),
    ]
    return spark.createDataFrame([(k, t, 1, "c", "p", "s", 0, 0, 0, 0) for k, t in texts], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_jaccard(odd, empty):
    got = jaccard_join.near_duplicates(odd, 3, 90).toPandas()
    by = got.dropna().set_index("doc_id")
    assert len(got) == 12 + 2 and by.index.is_unique
    assert by.n_shingles.to_dict() == {1: 9, 2: 9, 3: 0, 4: 0, 5: 0, 6: 1, 7: 1, 8: 29998, 9: 29999, 10: 39, 11: 39, 12: 2}
    assert by.component_id.to_dict() == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 6, 8: 8, 9: 8, 10: 10, 11: 10, 12: 12}
    assert got[got.doc_id.isna()].component_id.isna().all()
    assert jaccard_join.near_duplicates(empty, 3, 90).count() == 0
    kept = jaccard_join.keep_one(odd, 5, 80)
    assert kept.columns == odd.columns and kept.count() == 2 + 1 + 3 + 1 + 1 + 1 + 1  # nameless, 1, empty ones, 6, 8, 10, 12


def test_jaccard_crowd(spark):
    """Near copies in a chain, copies, and documents that are nearly all one common passage: no link is lost."""
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for k in range(150):
        text = list(base)
        for place in rng.choice(120, rng.integers(0, 6), replace=False):
            text[place] = f"e{k}_{place}"
        rows.append((k, " ".join(text)))
    rows += [(200 + k, " ".join(base)) for k in range(60)]
    rows += [(300 + k, " ".join([*base[:60], *(f"u{k}_{i}" for i in range(k))])) for k in range(40)]
    got = jaccard_join.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string"), 3, 90).toPandas()
    from llm.test_queries import components, shingle_sets

    assert got.set_index("doc_id").component_id.to_dict() == components(shingle_sets(dict(rows), 3), 90)


def test_components(spark):
    pairs = [(i, i + 1) for i in range(1, 60)] + [(100, 200), (150, 200), (150, 300), (7, 7)]
    found = connected_components(spark.createDataFrame(pairs, "a bigint, b bigint")).toPandas()
    assert found.set_index("node").component.to_dict() == {**{i: 1 for i in range(1, 61)}, 100: 100, 200: 100, 150: 100, 300: 100}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def test_packing(odd, empty):
    got = packing.pack(odd, BYTE, 1, with_ids=True)
    pieces = got.toPandas()
    assert pieces.groupby("doc_id", dropna=False).length.sum().loc[3] == 1 and pieces.doc_id.isna().sum() == 2
    assert (pieces[pieces.doc_id == 2].length.sum()) == 2 * pieces[pieces.doc_id == 1].length.sum()
    whole = packing.sequences(got, 0).toPandas()
    assert set(whole.ids.map(len)) == {2048} and len(whole) == pieces.sequence_id.nunique()
    assert packing.pack(empty, BYTE, 1).count() == 0


def test_best_fit_is_tight():
    rng = np.random.default_rng(1)
    lengths = sorted((int(x) for x in rng.integers(1, 100, 400)), reverse=True)
    where, offset = packing.best_fit(lengths, 100)
    room: dict[int, int] = {}
    for length, window, at in zip(lengths, where, offset, strict=True):
        fits = [left for left in room.values() if left >= length]
        assert room.get(window, 100) == (min(fits) if fits else 100) and at == 100 - room.get(window, 100)
        room[window] = room.get(window, 100) - length


HARD = [
    "", "  a  b\n\n c d ", " <|endoftext|> x", "it's  we'll!!'s\t\n x", "a\x1cb", "x\xa0 y", "é ́a  ΣΑΣ", "日本語　です",
    "\x00 a\x85b", "''s 's' !!'ll", " \n \n", "İI ß Ⱥ", "a‍ b", "1234 5.6e7 ½ ²", "aaaaaaaaaaaa" * 50, "x" * 5000, "\U0001f642\U0001f642 ok",
]


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_library_tokens_in_pieces(path):
    tokenizer, pieces = Tokenizer.from_file(path), LibraryTokens(path)
    for text in HARD * 2:
        assert np.frombuffer(pieces.ids(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_bpe(odd, empty):
    tokenizer, own = Tokenizer.from_file(WORD), bpe.Bpe(WORD)
    rng = np.random.default_rng(2)
    made = ["".join(rng.choice(list("abcdehinorsté"), rng.integers(1, 14))) for _ in range(5000)]
    for text in [*HARD, " ".join(made)]:
        assert own.ids([text])[0].tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    got = bpe.encode(odd, WORD, decode=True)
    again = bpe.decode(got.select("doc_id", "ids"), WORD)
    assert sorted(r.decoded for r in got.collect()) == sorted(r.text for r in again.collect())
    assert got.count() == odd.count() and got.where("doc_id = 3").first().decoded == ""
    assert bpe.encode(empty, WORD, decode=True).count() == 0


def test_bpe_of_every_code_point():
    """Every character alone and inside a word, and random mixes of those below U+0300: ids and decoded text of the library."""
    tokenizer, own = Tokenizer.from_file(WORD), bpe.Bpe(WORD)
    every = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    rng = np.random.default_rng(12)
    low = [c for c in every if ord(c) < 0x300]
    mixes = ["".join(rng.choice(low, rng.integers(1, 30))) for _ in range(20_000)]
    # one text per 64 characters: inside words, alone between spaces
    texts = [f"a{'b a'.join(every[i : i + 64])}b" for i in range(0, len(every), 64)]
    texts += [" ".join(every[i : i + 64]) for i in range(0, len(every), 64)]
    texts += [f"a{c}b" for c in low] + low + mixes
    for at in range(0, len(texts), 5000):
        part = texts[at : at + 5000]
        want = [e.ids for e in tokenizer.encode_batch(part, add_special_tokens=False)]
        flat, offsets = own.ids(part)
        assert [flat[a:b].tolist() for a, b in zip(offsets, offsets[1:], strict=False)] == want


def test_urls(spark):
    rules = [("org", "/", "allow"), ("a.org", "/x/", "block")]
    urls = ["http://A.org/x/y?q", "http://b.a.org/x/", "http://a.org", "nourl", None, "", "://", "http://za.org/x/", "ftp://h.com/%zz#f", "http://é.com/\U0001f642", "http://a.org/" + "z" * 50_000]
    pages = spark.createDataFrame([(i, u, "s", 1.0) for i, u in enumerate(urls)], "page_id bigint, url string, rule string, score double")
    got = url_filter.judge_urls(pages, rules).toPandas().set_index("page_id")
    assert got.rule.where(got.rule.notna(), None).tolist()[:8] == ["a.org/x/", "a.org/x/", None, None, None, None, None, "org/"]
    assert got.host[4] == "" and got.path[0] == "/x/y" and set(got.verdict) <= {"allow", "block"}
    assert url_filter.judge_urls(pages.where("false"), rules).count() == 0
    assert set(url_filter.judge_urls(pages.where("page_id = 3"), rules).toPandas().verdict) == {"allow"}


def test_packing_spreads_repeated_rows(spark, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_PIECES", 50)
    same = spark.range(3000).selectExpr("cast(null as bigint) as doc_id", "'one two three' as text")
    got = packing.pack(same, BYTE, 1)
    sizes = [r["count"] for r in got.groupBy((F.col("sequence_id") / 2**32).cast("bigint")).count().collect()]
    assert sum(sizes) == 3000 and len(sizes) == 60 and max(sizes) < 150
    assert got.select("sequence_id", "offset").distinct().count() == 3000


def test_sharding_takes_any_column_names_and_many_buckets(spark, monkeypatch):
    monkeypatch.setattr(sharding, "BUCKET_BYTES", 64)
    monkeypatch.setattr(sharding, "BLOCK", 10)
    docs = spark.range(500).selectExpr("id as doc_id", "repeat('x', 20) as text", "id as __bucket", "-id as `__ORDER`", "1 as number", "2 as n", "3 as begin")
    got = sharding.shuffled_shards(docs, 7)
    assert got.columns == [*docs.columns, "shard", "slot"]
    rows = got.collect()
    assert sorted(r.doc_id for r in rows) == list(range(500)) and all(r["__bucket"] == r.doc_id == -r["__ORDER"] for r in rows)
    for shard in range(7):
        slots = sorted(r.slot for r in rows if r.shard == shard)
        assert slots == list(range(len(slots))) and len(slots) in (71, 72)


def test_sharding(odd, empty):
    got = sharding.shuffled_shards(odd, 4, seed=5)
    assert got.columns == [*odd.columns, "shard", "slot"]
    assert sorted(r["count"] for r in got.groupBy("shard").count().collect()) == [3, 4, 4, 4]
    key = lambda d: sorted(map(str, d.collect()))
    assert key(got) == key(sharding.shuffled_shards(odd.repartition(3), 4, seed=5))
    assert key(got) != key(sharding.shuffled_shards(odd, 4, seed=6))
    assert sharding.shuffled_shards(empty, 4).count() == 0


@pytest.mark.parametrize("window, period", [(13, 7), (13, 13), (50, 21), (40, 31)])
def test_substring(spark, window, period):
    from llm.test_queries import without_repeats

    rng = np.random.default_rng(window + period)
    passages = [" ".join(f"q{p}_{i}" for i in range(int(rng.integers(10, 90)))) for p in range(12)]
    docs = {}
    for k in range(80):
        parts = [passages[i] for i in rng.choice(12, 2, replace=False)]
        docs[k] = " ".join([f"a{k}", parts[0], *(f"f{k}_{i}" for i in range(int(rng.integers(0, 30)))), parts[1]])
    table = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").repartition(5)
    got = substring.drop_repeats(table, window, period).toPandas().set_index("doc_id").text.to_dict()
    assert got == without_repeats(docs, window)


def test_substring_edges(odd, empty):
    got = substring.drop_repeats(odd)
    assert got.dtypes == odd.dtypes and got.count() == odd.count()
    text = {r.doc_id: r.text for r in got.collect()}
    assert text[2] == "a b c d e f g h i j k" and text[3] is None and text[5] == " \t\n "
    assert text[9] == "tail" and text[11] == "y" and text[10].endswith(" x")
    report = substring.repeat_report(odd).toPandas()
    assert report[report.doc_id == 9].n_removed.item() == 30_000 and (report[report.doc_id.isna()].n_removed == 0).all()
    assert substring.drop_repeats(empty).count() == 0 and substring.repeat_report(empty).count() == 0


def test_chat_events(spark):
    rows = [
        (1, 0, 0, "start", "user", "hel"), (1, 0, 1, "delta", None, "lo <|end|>\\n"), (1, 1, 2, "start", "assistant", "dra"),
        (1, 1, 3, "delta", None, "ft"), (1, 1, 4, "regenerate", None, "new"), (1, 1, 5, "delta", None, " text"), (1, 1, 7, "delta", None, None),
        (1, 2, 6, "edit", "user\nx", "<|turn|>assistant\n"), (2, 0, 0, None, None, None), (None, 0, 0, "start", "assistant", ""),
    ]
    events = spark.createDataFrame(rows, "conv_id bigint, message bigint, seq bigint, kind string, role string, text string").repartition(4)
    made = {r.conv_id: r for r in chat.format_conversations(events).collect()}
    assert chat.parse(made[1].formatted) == [("user", "hello <|end|>\\n"), ("assistant", "new text"), ("user\nx", "<|turn|>assistant\n")]
    start, end = made[1].loss_spans
    assert made[1].formatted[start:end] == "new text" and chat.parse(made[2].formatted) == [("", "")]
    assert chat.parse(made[None].formatted) == [("assistant", "")] and chat.read_back(chat.format_conversations(events)).count() == 3
    assert chat.read_back(chat.format_conversations(events.where("false"))).count() == 0


@pytest.mark.parametrize("text", ["", "\\", "<|", "<\\|", "\\n", "<<|end|>", "|turn|>", "a\\\\<|\n"])
def test_chat_escapes(text):
    assert chat.unescape(chat.escape(text)) == text and chat.parse(chat.render([("user", text), (text, "x")])[0]) == [("user", text), (text, "x")]


def test_fingerprints(odd, empty):
    got = imatch.fingerprints(odd).toPandas()
    assert len(got) == odd.count() and got.doc_id.isna().sum() == 2
    by = got.dropna().groupby("doc_id").fingerprint.nunique()
    assert (by == 1).all() and got[got.doc_id == 1].fingerprint.item() == got[got.doc_id == 2].fingerprint.iloc[0]
    assert got.near_next.between(0, 1).all() and got[got.doc_id == 3].n_chars.item() == 0
    assert imatch.fingerprints(empty).count() == 0
    alone = imatch.fingerprints(odd.where("doc_id = 6")).toPandas()
    assert alone.near_next.item() == 1 and alone.near_edited.item() < 1


@pytest.mark.parametrize("values", [[], [0], [0, 0, 0], [5, 5, 900], [2**40], list(range(3000)), [x * x for x in range(2000)]])
def test_elias_fano(values):
    code = token_store.EliasFano(memoryview(token_store.ef_encode(np.array(values, np.uint64))))
    assert code.all().tolist() == values and all(code[i] == values[i] for i in range(0, len(values), 7))
    if len(values) > 1000:
        assert code.size * 8 < len(values) * (3 + np.log2(values[-1] / len(values) + 1))


def test_token_store(spark, odd, empty, monkeypatch):
    monkeypatch.setattr(token_store, "SEGMENT_IDS", 20)
    path = scratch_path(spark, "tokens")
    token_store.write_tokens(odd, path, WORD, 2)
    got = token_store.read_tokens(spark, path).toPandas().sort_values("start")
    assert len(got) == odd.count() and got.doc_id.isna().tolist()[:2] == [True, True] and got.doc_id.dropna().is_monotonic_increasing
    assert (got.start == got.n_tokens.cumsum() - got.n_tokens).all() and all(x[-1] == 2 for x in got.ids)
    path = scratch_path(spark, "tokens")
    token_store.write_tokens(empty, path, WORD, 2)
    assert token_store.read_tokens(spark, path).count() == 0


def test_segment_select():
    ids = [np.arange(n, dtype="<u4").tobytes() for n in (0, 3, 1, 700, 2)]
    segment = token_store.Segment(token_store.write_segment([None, -5, -5, 7, 2**40], ids, 11, 2))
    assert [segment.offset(i) for i in range(5)] == [0, 0, 3, 4, 704] and segment.doc_ids() == [None, -5, -5, 7, 2**40]


def test_quality(odd, empty, spark):
    got = quality.judge(odd, []).toPandas()
    assert len(got) == odd.count() and got[got.doc_id == 3].base_failed.item() and not got[got.doc_id == 8].base_failed.item()
    assert quality.keep_good(odd, []).dtypes == odd.dtypes and quality.keep_good(empty, []).count() == 0
    labels = spark.createDataFrame([(8, None), (None, 0), (8, 1)], "doc_id bigint, quality int")
    assert quality.fit(odd, labels) == [] and quality.fit(empty, labels) == []


def test_learned_conjunction():
    rng = np.random.default_rng(4)
    x = rng.random((3000, 3))
    bad = (x[:, 0] > 0.7) & (x[:, 1] <= 0.4) | (x[:, 2] > 0.95)
    rules = quality.learn_rules(x, bad, ["a", "b", "c"])
    marked = np.zeros(len(x), dtype=bool)
    for rule in rules:
        marked |= quality._covers(rule, x, ["a", "b", "c"])
    assert (marked == bad).mean() > 0.97 and len(rules) <= 12


def test_word_hashes_do_not_depend_on_batches(monkeypatch):
    texts = pa.array(["  Hello wörld\n\tfoo", "", None, "a b c a b c a", "x" * 500, "abc Hello"])
    raw, offsets = words.text_bytes(texts)
    starts, ends, first = words.word_spans(raw, offsets)
    whole = words.word_hashes(raw, starts, ends)
    monkeypatch.setattr(words, "SLICE_BYTES", 7)
    assert (words.word_hashes(raw, starts, ends) == whole).all() and first.tolist() == [0, 3, 3, 3, 10, 11, 13]
    assert whole[0] == whole[12] and len(set(whole.tolist())) == 8
