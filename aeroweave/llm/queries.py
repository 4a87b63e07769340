"""Registered queries of the training-data operators, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import scratch_path
from . import bpe, chat, dual_tree, heap_clusters, imatch, packing, pii, quality, sharding, token_store, url_filter
from .jaccard_join import near_duplicates
from .oracle import ORACLES  # noqa: F401
from .substring import repeat_report

Query = Callable[[SparkSession, str], DataFrame]

WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"
N_SHARDS = 24
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf: str) -> DataFrame:
    """Components of documents whose 3-word shingles overlap by 90 % or more."""
    return near_duplicates(_table(spark, sf, "documents"), width=3, percent=90)


def op2_packing(spark: SparkSession, sf: str) -> DataFrame:
    """All documents packed into windows of 2048 tokens."""
    return packing.pack(_table(spark, sf, "documents"), public_tokenizers.path(BYTE_BPE), end_id=1)


def op3_bpe(spark: SparkSession, sf: str) -> DataFrame:
    """Ids of all texts and the text made back from them, as digests."""
    coded = bpe.encode(_table(spark, sf, "documents"), public_tokenizers.path(WORD_BPE), decode=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op4_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    """A verdict on every page address, by rule or by model."""
    judged = url_filter.judge_urls(_table(spark, sf, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict", F.round("score", 6).alias("score"))


def op5_sharding(spark: SparkSession, sf: str) -> DataFrame:
    """All documents shuffled into 24 written shards, described from the files."""
    path = scratch_path(spark, "shards")
    sharding.write_shards(_table(spark, sf, "documents").select("doc_id", "text"), path, N_SHARDS)
    written = spark.read.schema("doc_id bigint, text string, slot bigint, shard int").parquet(path)
    return written.select(
        "doc_id",
        sharding.row_bytes("text").alias("size"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit(sharding.LAW).alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op6_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """All documents without the 13-word passages that an earlier one has."""
    report = repeat_report(_table(spark, sf, "documents"), window=13, period=7)
    return report.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def conversation_log(rows: DataFrame) -> DataFrame:
    """Events ``conv_id, message, seq, kind, role, text`` that a client would have logged for ``conv_id, turn, role, text``.

    A third of the messages (by hash) streams in at once. Of the others a draft streams in first, made of the message's own
    first characters backwards, and is then edited or regenerated into the final text.
    """
    same = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    message = F.struct("turn", F.row_number().over(same).alias("copy")).alias("message")
    told = rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), message, "role", F.coalesce("text", F.lit("")).alias("text"))
    told = told.withColumn("way", F.pmod(F.xxhash64("conv_id", "message"), F.lit(3)))
    drafted = F.col("way") > 0
    settled = F.when(~drafted, "start").when(F.col("way") == 1, "edit").otherwise("regenerate")
    part = lambda seq, kind, role, text: F.struct(
        F.lit(seq).alias("seq"), kind.alias("kind"), role.alias("role"), F.expr(text).alias("text")
    )
    nobody = F.lit(None).cast("string")
    draft = F.array(
        part(0, F.lit("start"), F.col("role"), "reverse(substring(text, 1, 40))"),
        part(1, F.lit("delta"), nobody, "reverse(substring(text, 41, 40))"),
    )
    final = F.array(
        part(2, settled, F.when(~drafted, F.col("role")), "substring(text, 1, 40)"),
        part(3, F.lit("delta"), nobody, "substring(text, 41)"),
    )
    parts = F.when(drafted, F.concat(draft, final)).otherwise(final)
    return told.select("conv_id", "message", F.explode(parts).alias("e")).select("conv_id", "message", "e.*")


def op7_chat_formatting(spark: SparkSession, sf: str) -> DataFrame:
    """All conversations, logged as streamed, edited and regenerated messages, folded, rendered and read back."""
    odd = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id bigint, turn bigint, role string, text string")
    rows = _table(spark, sf, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.format_conversations(conversation_log(rows)))


def op8_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """I-Match fingerprints of all texts and of their edited versions."""
    return imatch.fingerprints(_table(spark, sf, "documents"))


def op9_token_store(spark: SparkSession, sf: str) -> DataFrame:
    """All documents written as a binary token store, described from the files."""
    path = scratch_path(spark, "tokens")
    token_store.write_tokens(_table(spark, sf, "documents"), path, public_tokenizers.path(WORD_BPE), end_id=2)
    return token_store.read_tokens(spark, path, with_ids=False)


def op10_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of all texts and the verdict of base and learned rules."""
    docs = _table(spark, sf, "documents").select("doc_id", "text")
    judged = quality.judge(docs, quality.fit(docs, _table(spark, sf, "labels")))
    stats = F.col("stats")
    return judged.select(
        "doc_id",
        stats["w"]["n_words"].alias("n_words"),
        stats["word_chars"].alias("word_chars"),
        stats["n_symbols"].alias("n_symbols"),
        stats["n_dup_lines"].alias("n_dup_lines"),
        stats["w"]["n_repeat_words"].alias("n_repeat_words"),
        "base_failed",
        "kept",
        "rule",
    )


def op11_centroid_clustering(spark: SparkSession, sf: str) -> DataFrame:
    """All embeddings in 40 clusters after five rounds, with what the clusters sum to."""
    assigned, centroids = heap_clusters.cluster(_table(spark, sf, "embeddings"), k=40, rounds=5, width=64, salt="2")
    return heap_clusters.report(assigned, centroids)


def op12_pii(spark: SparkSession, sf: str) -> DataFrame:
    """Personal data in all texts: what the base patterns find, and with what a fitted field adds."""
    docs = _table(spark, sf, "documents")
    found = pii.find(docs, pii.fit(docs))
    listed = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    return found.select(
        "doc_id",
        *(count(kind) for kind in pii.KINDS),
        F.sha2(listed("base"), 256).alias("base_sha256"),
        listed("spans").alias("spans"),
        (F.size("spans") - F.size("base")).cast("bigint").alias("n_added"),
    )


def op13_ranked_search(spark: SparkSession, sf: str) -> DataFrame:
    """The 50 best of all documents for every benchmark item."""
    return dual_tree.ranked_search(_table(spark, sf, "documents"), _table(spark, sf, "benchmark"), k=50)


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join,
        op2_packing,
        op3_bpe,
        op4_url_filter,
        op5_sharding,
        op6_substring_dedup,
        op7_chat_formatting,
        op8_fingerprints,
        op9_token_store,
        op10_quality_rules,
        op11_centroid_clustering,
        op12_pii,
        op13_ranked_search,
    )
}
