"""The operators of this subpackage as named queries over the given tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import Scratch
from . import conversation_trie, decontamination, embedding_dedup, hard_negatives, line_dedup, minhash, mixing, packing, quality_classifier, quality_rules, sharding, suffix_dedup, token_counts, twins
from .common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TOKEN_LIMIT = 1024


def query(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[build.__name__] = build
    return build


def twin(sql: str) -> Callable:
    """Registers ``sql`` for the query that follows."""

    def register(build: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        ORACLES[build.__name__] = sql
        return build

    return register


@query
def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Exact tokens of every text; SQL has no tokenizer, so tests compare with the library."""
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    docs = documents(spark, folder).select("doc_id", size.alias("n_bytes"), "text")
    counted = token_counts.token_totals(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", "n_bytes", "n_tokens").withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


@query
def op6_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Sequences of 2,048 tokens; SQL has neither tokenizer nor linear program, so tests check the packing's laws."""
    scratch = Scratch(spark)
    cut = packing.pieces(documents(spark, folder), public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(scratch.keep(cut), scratch)


@query
def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Base rules and the forest's verdict; tests compare the counts with brute force, the forest with labels."""
    rows = quality_rules.judged(documents(spark, folder), documents(spark, folder, "labels"), Scratch(spark))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")


@query
def op8_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    """Scores of all texts; tests measure held-out accuracy."""
    docs = documents(spark, folder)
    machine = quality_classifier.fit(docs, documents(spark, folder, "labels"))
    rows = quality_classifier.scored(docs.select("doc_id", "text", "n_chars"), machine)
    held = F.coalesce(quality_classifier.fold(F.col("doc_id")) == 0, F.lit(False))
    predicted = (F.col("score") >= quality_classifier.THRESHOLD).cast("int")
    return rows.select("doc_id", held.alias("held_out"), "score", predicted.alias("predicted"))


@query
def op10_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """Law ``rows``: 24 shards of equal counts; tests check margins, gapless slots and uniformity."""
    docs = documents(spark, folder)
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    rows = docs.select("doc_id", sharding.text_size(F.col("text")).alias("size"), crc.alias("text_crc32"))
    out = sharding.shuffled(rows, Scratch(spark))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
@twin(twins.MINHASH_DEDUP)
def op1_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Links at a similarity of 0.85; tests compare with brute force."""
    return minhash.near_duplicates(documents(spark, folder), Scratch(spark), threshold=(85, 100))


@query
@twin(twins.EMBEDDING_DEDUP)
def op7_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Cosine of 0.93 or more inside a label; tests compare with the full matrix."""
    return embedding_dedup.near_vectors(documents(spark, folder, "embeddings"), Scratch(spark))


@query
def op4_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Lines that each document loses; tests compare with brute force over all pairs of lines."""
    docs, scratch = documents(spark, folder).select("doc_id", "text"), Scratch(spark)
    gone = line_dedup.dropped_lines(docs, scratch).withColumnRenamed("doc", "doc_id")
    lines = docs.select("doc_id", F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).alias("n_lines"))
    n = F.when(F.col("dropped").isNull(), 0).otherwise(F.size("dropped")).cast("long")
    return lines.join(gone, "doc_id", "left").select("doc_id", "n_lines", n.alias("n_dropped"), F.coalesce("n_near", F.lit(0)).alias("n_near"), "dropped")


#: target shares of tokens, by what the labels say
DOMAINS = {"clean": 0.93, "noisy": 0.04, "toxic": 0.03}


def domains_of(labels: DataFrame) -> DataFrame:
    kind = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "noisy").when(F.col("quality") == 1, "clean")
    return labels.select("doc_id", kind.alias("domain"))


@query
def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    """Rates and copies for the target weights; tests compare totals with targets."""
    labelled = domains_of(documents(spark, folder, "labels"))
    rows = mixing.mixed(documents(spark, folder), labelled, DOMAINS, Scratch(spark), full="clean", scale=1.1)
    return rows.select("doc_id", "n_tokens", "rate", "copies", "miss", *[F.col("posteriors")[k].alias(f"p_{d}") for k, d in enumerate(DOMAINS)])


@query
def op2_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Bytes covered by repeated strings of 400 bytes; tests compare with brute force over all strings."""
    return suffix_dedup.without_repeats(documents(spark, folder), Scratch(spark))


@query
@twin(twins.DECONTAMINATION)
def op11_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Words of documents inside benchmark windows of ten words."""
    rows = decontamination.contamination(documents(spark, folder), documents(spark, folder, "benchmark"), Scratch(spark))
    listed = F.sha2(F.array_join("items", ","), 256).alias("items_sha256")
    return rows.select("doc_id", "n_words", "n_hit", "n_items", listed, (F.col("n_hit") > 0).alias("contaminated"))


@query
@twin(twins.CONVERSATION_TRIE)
def op12_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    """Nodes of the prefix trie; a conversation takes up to five first turns from the one at its hundred."""
    conv = F.col("conv")
    borrowed = F.crc32(conv.cast("string").cast("binary")) % 6
    return conversation_trie.conversation_trie(documents(spark, folder, "conversations"), Scratch(spark), conv - conv % 100, borrowed)


@query
@twin(twins.HARD_NEGATIVES)
def op13_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    """Hard negatives of each anchor (ids divisible by 100) and positive, over all vectors."""
    rows = hard_negatives.quantised(documents(spark, folder, "embeddings").select("vec_id", "label", "embedding"), 256)
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mined(rows.withColumn("label", moved), F.col("id") % 100 == 0, Scratch(spark))
