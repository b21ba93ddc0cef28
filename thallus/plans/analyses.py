"""The three analyses a user runs end to end."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import classes
from ..operators import differential, distances, ecology, ordination as axes, ranking, relational, summaries, taxonomy
from ..runtime import durable


@dataclass(frozen=True)
class Community:
    """An imported experiment: rarefied counts with relative abundance, samples, annotated taxonomy."""

    rarefied: DataFrame
    relative: DataFrame
    samples: DataFrame
    taxonomy: DataFrame
    fungal: DataFrame


def annotate_taxonomy(tax_raw: DataFrame, edits: DataFrame, guild_db: DataFrame, endophytes: DataFrame) -> DataFrame:
    """Overrides, ranks, guild by most specific rank, primary guild."""
    ranks = taxonomy.taxonomy_table(relational.apply_overrides(tax_raw, edits))
    return taxonomy.primary_guild(taxonomy.assign_by_rank(ranks, guild_db), endophytes)


def import_community(
    counts: DataFrame, samples: DataFrame, tax_raw: DataFrame, edits: DataFrame, guild_db: DataFrame, endophytes: DataFrame,
    depth: int, seed: int = 67, kingdom: str = "Fungi", store: bool = False,
) -> Community:
    """Filter to one kingdom, rarefy (in that order: it decides what is drawn from), relativize.

    ``store`` keeps the rarefied table and the taxonomy on shared storage for the many readers that follow.
    """
    annotated = annotate_taxonomy(tax_raw, edits, guild_db, endophytes)
    annotated = durable(annotated) if store else annotated
    fungal = relational.filter_features(counts, annotated, F.col("kingdom") == kingdom)
    rarefied = ecology.rarefy(fungal, depth, seed)
    rarefied = durable(rarefied) if store else rarefied
    return Community(rarefied, ecology.relativize(rarefied), samples, annotated, fungal)


def guild_means(community: Community, by: Sequence[str] = ("time", "species")) -> DataFrame:
    """Mean guild share per treatment over the eligible samples."""
    shares = ecology.guild_sum(community.relative, community.taxonomy)
    observed = relational.keep_in(relational.eligible_samples(community.samples), community.rarefied.select("sample"), "sample")
    return ecology.group_mean(shares, observed, by, "guild", "abundance")


def ordination(community: Community, k: int = 3) -> DataFrame:
    """Eligible samples on ``k`` axes, with their metadata: transformed counts, Bray–Curtis,
    step-across for samples that share nothing, principal coordinates.  One row per sample, ``V1 .. Vk``."""
    eligible = relational.eligible_samples(community.samples)
    kept = durable(relational.keep_in(community.rarefied, eligible.select("sample"), "sample"))
    near = distances.bray_curtis(ecology.wisconsin_autotransform(kept), "value")
    scores = axes.pcoa(axes.step_across(near, kept, apart=False), kept, k)  # a pair without a path counts as one left out
    columns = [F.max(F.when(F.col("axis") == a, F.col("score"))).alias(f"V{a}") for a in range(1, k + 1)]
    return scores.groupBy("sample").agg(*columns).join(eligible, "sample")


def guild_classes(community: Community, cut: float) -> DataFrame:
    """Eligible samples with the class that their guild shares give them; a guild they lack counts as 0."""
    shares = ecology.guild_sum(community.relative, community.taxonomy)
    wide = relational.pivot_unique(shares, ["sample"], "guild", "abundance", ["Arbuscular Mycorrhizal", "Ectomycorrhizal"], fill=0.0)
    state = classes.threshold_class(F.col("Arbuscular Mycorrhizal"), F.col("Ectomycorrhizal"), cut)
    return wide.withColumn("class", state).join(relational.eligible_samples(community.samples), "sample")


def guild_shares_long(community: Community, places: int = 9) -> DataFrame:
    """Every guild in every eligible sample, absent ones as 0: ``(sample, pot, species, time, grp, guild, abundance)``.

    Shares are rounded, so that equal sums are ties whatever order they were added in."""
    shares = durable(ecology.guild_sum(community.relative, community.taxonomy))
    eligible = relational.eligible_samples(community.samples)
    observed = relational.keep_in(eligible, community.rarefied.select("sample"), "sample")
    guilds = relational.keep_in(shares, observed.select("sample"), "sample").agg(F.collect_set("guild")).scalar()  # a handful of labels
    grid = observed.withColumn("guild", F.explode(guilds)).join(shares, ["sample", "guild"], "left")
    share = F.round(F.coalesce("abundance", F.lit(0.0)), places).alias("abundance")
    return grid.select("sample", "pot", "species", "time", F.concat_ws("_", "species", "time").alias("grp"), "guild", share)


def eligible_diversity(community: Community) -> DataFrame:
    """Alpha diversity of the eligible samples with their metadata."""
    return ecology.alpha_diversity(community.rarefied).join(relational.eligible_samples(community.samples), "sample")


def found_taxa(community: Community, rank: str, stable: DataFrame, min_n: int = 5, corrected: DataFrame | None = None) -> DataFrame:
    """Taxa to show: those that differ by presence, those that differ by corrected abundance (a tested table), and the ``stable`` ones."""
    by_presence = ecology.presence_contrast(community.rarefied, community.samples, community.taxonomy, rank, min_n)
    present = by_presence.where(F.col("time_filter").isNotNull() | F.col("species_filter").isNotNull())
    more = [differential.differing_taxa(corrected)] if corrected is not None else []
    return relational.distinct_union(present, *more, stable, key="taxon")


def guild_colonization(community: Community, microscopy: DataFrame) -> DataFrame:
    """Sequencing and microscopy treatment means in one table.

    ``microscopy(species, time, guild, percent)``, one row per subject and guild.
    """
    sequencing = guild_means(community).select(
        classes.recode(F.col("time")).alias("time"), "species", "guild", F.col("mean").alias("abundance")
    )
    seen = microscopy.where(F.col("percent").isNotNull()).groupBy("time", "species", "guild").agg((F.avg("percent") / 100).alias("abundance"))
    return summaries.stacked_shares({"Sequencing": sequencing, "Microscopy": seen})


def differential_taxa(
    community: Community, rank: str = "genus", min_n: int = 5, levels: Mapping[str, Sequence[str]] | None = None
) -> DataFrame:
    """Taxa that differ by presence or by corrected abundance."""
    by_presence = ecology.presence_contrast(community.rarefied, community.samples, community.taxonomy, rank, min_n)
    present = by_presence.where(F.col("time_filter").isNotNull() | F.col("species_filter").isNotNull())
    tested = differential.diff_abundance(community.rarefied, community.samples, community.taxonomy, rank=rank, levels=levels)
    return relational.distinct_union(present, differential.differing_taxa(tested), key="taxon")


def heatmap(community: Community, selected: DataFrame, order: DataFrame, rank: str = "genus") -> DataFrame:
    """Scaled abundance of the selected taxa with its plotting position."""
    rolled = taxonomy.rollup_rank(community.relative, community.taxonomy, rank, "rel")
    table = ecology.scaled_long(rolled, community.samples, selected, order, "rel")
    ranked = table.withColumn("time_order", classes.level_rank(F.col("time"), ("June20", "Jan21")))
    return ranking.level_index(durable(ranked), ["time_order", "species", "taxon_order"]).drop("time_order")
