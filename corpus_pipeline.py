"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns the
columns of ``documents`` (the last one returns pieces); ``run`` stores every result as Parquet in
the shared folder and reads it again for the next stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from thallus.llm import line_dedup, minhash, mixing, packing, quality_classifier
from thallus.llm.common import documents
from thallus.llm.queries import DOMAINS, domains_of
from thallus.runtime import Scratch, durable

#: the clean domain's target over what there is: a little more than all of it, so that no clean document goes
CLEAN_SCALE = 1.02


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorisation machine rejects go."""
    machine = quality_classifier.fit(docs, documents(spark, sf_dir, "labels"))
    judged = quality_classifier.scored(docs, machine, out="_score")
    return judged.where(F.col("_score") >= quality_classifier.THRESHOLD).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from the texts; documents that consisted of nothing else go, too."""
    cleaned = line_dedup.without_repeated_lines(docs, Scratch(spark))
    left = cleaned.where((F.col("lines_dropped") == 0) | (F.length(F.trim("text")) > 0))
    return left.withColumn("n_chars", F.when(F.col("lines_dropped") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    kept = minhash.near_duplicates(docs, Scratch(spark)).where("kept").select(F.col("doc_id").alias("_kept")).distinct()
    return docs.join(kept, docs["doc_id"].eqNullSafe(kept["_kept"]), "left_semi")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in proportion to the target weights; none is repeated."""
    labelled = domains_of(documents(spark, sf_dir, "labels"))
    rated = mixing.mixed(docs, labelled, DOMAINS, Scratch(spark), full="clean", scale=CLEAN_SCALE, most=1.0)
    gone = rated.where("copies = 0").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2,048 tokens."""
    scratch = Scratch(spark)
    return packing.pack(scratch.keep(packing.pieces(docs, public_tokenizers.path("word_bpe_49k.json"))), scratch)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("mixing", mix), ("packing", pack)]

#: SQL has no learned scores, tokenizer or linear program: tests check each stage instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for _, stage in STAGES:
        docs = durable(stage(spark, docs, sf_dir))
    return docs
