"""Lineages, guild annotation, roll-ups and consensus."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.text import RANKS, UNASSIGNED

# A lookup of at most this many rows is broadcast, a larger one meets the taxa by a shuffle.
LOOKUP_ROWS = 100_000


def parse_lineage(df: DataFrame, col: str = "lineage", ranks: Sequence[str] = RANKS, sep: str = ";") -> DataFrame:
    """Rank columns by position; missing tail ranks are NULL, surplus pieces are an error.

    Splitting is what costs: lineages are dealt out first, as they often come in one small file, and split once per row."""
    split = df.repartition(*df.columns).withColumn("_pieces", text.lineage_pieces(F.col(col), sep))
    surplus = F.raise_error(F.concat(F.lit("too many ranks: "), F.col(col)))
    split = split.withColumn("_pieces", F.when(F.size("_pieces") > len(ranks), surplus).otherwise(F.col("_pieces")))
    return split.select(
        *[c for c in df.columns if c != col], *[F.get("_pieces", F.lit(i)).alias(rank) for i, rank in enumerate(ranks)]
    )


def taxonomy_table(tax_raw: DataFrame) -> DataFrame:
    """Parsed lineages with binomial species names; an unassigned lineage has no kingdom."""
    parsed = parse_lineage(tax_raw)
    return parsed.withColumns(
        {
            "species": text.binomial(F.col("genus"), F.col("species")),
            "kingdom": F.when(F.col("kingdom") != UNASSIGNED, F.col("kingdom")),
        }
    )


def assign_by_rank(
    tax: DataFrame, lookup: DataFrame, ranks: Sequence[str] = RANKS[:6], value: str = "guild"
) -> DataFrame:
    """``lookup(taxon, rank_name, <value>)``: the entry of the most specific rank that matches.

    The lookup is counted, as its size is not known to the optimizer, which else broadcasts the taxa: a stored
    taxonomy takes few bytes a row and has a row per rank here.  The taxa stay where they are."""
    ranked = tax.select(
        "feature",
        F.explode(F.array(*[F.struct(F.lit(i).alias("no"), F.lit(r).alias("rank"), F.col(r).alias("name")) for i, r in enumerate(ranks)])).alias("r"),
    ).select("feature", F.col("r.no").alias("no"), F.col("r.rank").alias("rank"), F.col("r.name").alias("name"))
    entries = lookup.select(F.col("taxon").alias("name"), F.lower("rank_name").alias("rank"), value)
    named, few = ranked.where(F.col("name").isNotNull()), entries.limit(LOOKUP_ROWS + 1).count() <= LOOKUP_ROWS
    best = (named if few else named.hint("merge")).join(F.broadcast(entries) if few else entries, ["name", "rank"])
    best = best.groupBy("feature").agg(F.max_by(value, "no").alias(value))
    return tax.join(best, "feature", "left")


def primary_guild(df: DataFrame, overrides: DataFrame, guild: str = "guild", genus: str = "genus", label: str = "DSE") -> DataFrame:
    """Adds ``primary_guild``: the last piped label, or ``label`` for genera on the override list."""
    listed = overrides.select(F.col("genus").alias("_listed")).distinct()
    joined = df.join(listed, F.col(genus) == F.col("_listed"), "left")
    return joined.withColumn(
        "primary_guild", F.when(F.col("_listed").isNotNull(), label).otherwise(text.last_piped(F.col(guild)))
    ).drop("_listed")


def rollup_rank(counts: DataFrame, tax: DataFrame, rank: str, value: str = "n") -> DataFrame:
    """Sum of ``value`` per (sample, taxon at ``rank``)."""
    taxon = F.coalesce(F.col(rank), F.lit(UNASSIGNED)).alias("taxon")
    named = counts.join(tax.select("feature", rank), "feature", "left")
    return named.groupBy("sample", taxon).agg(F.sum(value).alias(value))


def consensus_taxonomy(
    hits: DataFrame, tax_raw: DataFrame, max_hits: int = 10, min_share: float = 0.51, sep: str = ";"
) -> DataFrame:
    """Deepest lineage prefix shared by at least ``min_share`` of a query's best hits.

    The rank filter is a per-query top-k, which Spark also applies before the shuffle,
    so one query with very many hits sends only its best ones on.
    """
    best = Window.partitionBy("query").orderBy(F.desc("score"), "tie")
    top = hits.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= max_hits)
    pieces = F.transform(F.split("lineage", sep), lambda piece: F.trim(piece))
    lineages = top.join(tax_raw.select(F.col("feature").alias("subject"), pieces.alias("_pieces")), "subject")
    # at most max_hits hits per query are left: their prefixes are counted inside one row
    queries = lineages.groupBy("query").agg(F.count(F.lit(1)).alias("hits"), F.collect_list("_pieces").alias("lineages"))
    kind = dict(hits.dtypes)["query"]
    return queries.mapInArrow(_deepest_shared(min_share), f"query {kind}, lineage string, depth int, share double")


def _deepest_shared(min_share: float):
    """Per row of (query, hits, lineages): the deepest prefix with enough votes, the last by name among equals."""

    def best(hits: int, lineages: list[list[str]]) -> tuple | None:
        # depth 0 is shared by every hit: a query without agreement falls back on it
        votes = {(0, UNASSIGNED): len(lineages)} if lineages else {}
        for pieces in lineages:
            prefix = None
            for depth, piece in enumerate(pieces, 1):
                prefix = piece if prefix is None else f"{prefix}; {piece}"
                votes[depth, prefix] = votes.get((depth, prefix), 0) + 1
        depth, prefix = max((p for p, n in votes.items() if n >= min_share * hits), default=(None, None))
        return None if depth is None else (prefix, depth, votes[depth, prefix] / hits if depth else None)

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [best(*row) for row in zip(batch.column("hits").to_pylist(), batch.column("lineages").to_pylist(), strict=True)]
            lineage, depth, share = (pa.array([row and row[c] for row in told], kind) for c, kind in enumerate((pa.string(), pa.int32(), pa.float64())))
            made = pa.RecordBatch.from_arrays([batch.column("query"), lineage, depth, share], ["query", "lineage", "depth", "share"])
            yield made.filter(depth.is_valid())

    return vote
