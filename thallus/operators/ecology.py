"""Counts to diversity, distances and contrasts.

``counts`` is ``(sample, feature, n)`` without zeros; where a mean, spread or minimum
needs the zeros, they enter through the number of samples instead of through rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from ..functions import classes
from ..functions.numeric import log_gamma
from ..runtime import durable
from . import taxonomy
from .relational import complete_groups, eligible_samples, keep_in, null_safe_join, with_order

READS_PER_CHUNK = 65536
MD5_HEX = 12
# Taxa that one sample meets at once in a heat map.
GRID_BLOCK = 1024


# -- depth and rarefaction ---------------------------------------------------------

def seq_depth(counts: DataFrame, value: str = "n") -> DataFrame:
    return counts.groupBy("sample").agg(F.sum(value).alias("depth"))


def at_depth(counts: DataFrame, depth: int) -> DataFrame:
    """Counts of the samples whose total is exactly ``depth``."""
    return keep_in(counts, seq_depth(counts).where(F.col("depth") == depth), "sample")


def rarefy(counts: DataFrame, depth: int, seed: int = 67) -> DataFrame:
    """Random subsample of ``depth`` reads per sample without replacement; poorer samples are left out.

    A read's place in the draw is the md5 of (sample, feature, i, seed), so the result does
    not depend on partitioning.  The ``depth`` smallest hashes of N lie below a known
    fraction of the hash range (ten standard deviations of slack): reads above it are
    discarded where they arise, and the ranking window holds about ``depth`` rows for any
    sample, however deep.  Should a sample ever fall short, the job fails instead of
    returning fewer reads.  The counts are read several times and therefore stored first; only
    cells move, by sample, but for samples of more than ``READS_PER_CHUNK`` reads, whose reads
    are hashed all over the cluster before what is left of them meets.
    """
    negative = F.raise_error(F.concat(F.lit("rarefy: negative count of "), F.col("feature").cast("string")))
    counts = durable(counts.where(F.when(F.col("n") < 0, negative.cast("boolean")).otherwise(F.col("n") > 0)).select("sample", "feature", "n"))
    fraction = F.lit(depth + 10 * depth**0.5 + 64) / F.col("depth")
    cut = F.when(fraction < 1, F.lower(F.lpad(F.hex(F.floor(fraction * 16**MD5_HEX)), MD5_HEX, "0"))).otherwise("g")
    totals = durable(seq_depth(counts).where(F.col("depth") >= depth).select("sample", "depth", cut.alias("cut")))
    shallow = counts.join(totals.where(F.col("depth") <= READS_PER_CHUNK), "sample").repartition("sample")
    drawn = _drawn(shallow.select("sample", "feature", "cut", F.lit(1).cast("long").alias("first"), F.col("n").cast("long").alias("last")), depth, seed)
    deep = totals.where(F.col("depth") > READS_PER_CHUNK)
    if deep.isEmpty():
        return drawn
    # one abundant cell may hold very many reads: spread its chunks before they are expanded
    chunk = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / READS_PER_CHUNK)))
    chunks = counts.join(deep, "sample").select("sample", "feature", "n", "cut", chunk.alias("chunk")).repartition("sample", "feature", "chunk")
    last = F.least((F.col("chunk") + 1) * READS_PER_CHUNK, F.col("n")).cast("long")
    spread = chunks.select("sample", "feature", "cut", (F.col("chunk") * READS_PER_CHUNK + 1).alias("first"), last.alias("last"))
    return drawn.unionByName(_drawn(spread, depth, seed))


def _drawn(spans: DataFrame, depth: int, seed: int) -> DataFrame:
    """The ``depth`` reads of lowest hash of each sample, from ``(sample, feature, cut, first, last)``, counted."""
    reads = spans.select("sample", "feature", "cut", F.explode(F.sequence("first", "last")).alias("i"))
    place = F.md5(F.concat_ws("|", "sample", "feature", F.col("i").cast("string"), F.lit(str(seed))))
    below = F.when(F.col("cut") == "g", True).otherwise(place < F.col("cut"))  # hashed once where all reads are candidates
    drawn = reads.where(below).select("sample", "feature", F.unhex(place).alias("h"))
    by_sample = Window.partitionBy("sample")
    ranked = drawn.select(
        "sample", "feature",
        F.row_number().over(by_sample.orderBy("h")).alias("rank"),
        F.count(F.lit(1)).over(by_sample).alias("drawn"),
    )
    enough = F.when(F.col("drawn") >= depth, True).otherwise(F.raise_error(F.lit("rarefy: too few candidates, change the seed")))
    return ranked.where((F.col("rank") <= depth) & enough).groupBy("sample", "feature").agg(F.count(F.lit(1)).alias("n"))


def rarefaction_curve(counts: DataFrame, step: int = 100) -> DataFrame:
    """Expected richness of a subsample of 1, 1+step, ... and all reads, per sample.

    Features with equal counts share a term, so a sample contributes few rows.
    """
    frequency = counts.groupBy("sample", "n").agg(F.count(F.lit(1)).alias("features"))
    totals = seq_depth(counts)
    size = F.explode(F.array_distinct(F.concat(F.sequence(F.lit(1).cast("long"), "depth", F.lit(step).cast("long")), F.array("depth"))))
    terms = frequency.join(totals, "sample").select("sample", "n", "features", "depth", size.alias("size"))
    n, total, drawn = (F.col(c).cast("double") for c in ("n", "depth", "size"))
    missed = F.exp(log_gamma(total - n + 1) + log_gamma(total - drawn + 1) - log_gamma(total - n - drawn + 1) - log_gamma(total + 1))
    seen = F.when(total - n >= drawn, 1 - missed).otherwise(1.0)
    return terms.groupBy("sample", "size").agg(F.sum(F.col("features") * seen).alias("richness"))


# -- relative abundance and diversity ----------------------------------------------

def relativize(counts: DataFrame, value: str = "n") -> DataFrame:
    """Adds ``rel``: the share of the sample total.  Totals are joined, not windowed, so a
    sample that holds most rows is still summed in parts."""
    return counts.join(seq_depth(counts, value), "sample").withColumn("rel", F.try_divide(value, "depth")).drop("depth")


def alpha_diversity(counts: DataFrame) -> DataFrame:
    """Shannon, Simpson, inverse Simpson and richness in one aggregation, without relative values:
    H = ln N - sum(n ln n)/N."""
    n = F.col("n").cast("double")
    sums = counts.where("n > 0").groupBy("sample").agg(
        F.sum(n).alias("total"), F.sum(n * F.log(n)).alias("nlogn"), F.sum(n * n).alias("squares"), F.count(F.lit(1)).alias("richness")
    )
    concentration = F.col("squares") / (F.col("total") * F.col("total"))
    return sums.select(
        "sample",
        (F.log("total") - F.col("nlogn") / F.col("total")).alias("shannon"),
        (1 - concentration).alias("simpson"),
        (1 / concentration).alias("inv_simpson"),
        "richness",
    )


def wisconsin_autotransform(counts: DataFrame, value: str = "n", sqrt_above: float = 50, standardize_above: float = 9) -> DataFrame:
    """Square root for large counts, then (for more than small ones) division by the feature
    maximum and by the sample total.  The choice looks at the largest count of the table."""
    largest = counts.agg(F.max(value)).scalar()
    rooted = counts.withColumn("_v", F.when(largest > sqrt_above, F.sqrt(value)).otherwise(F.col(value).cast("double")))
    feature_max = rooted.groupBy("feature").agg(F.max("_v").alias("_max"))
    scaled = rooted.join(feature_max, "feature").withColumn("_s", F.try_divide("_v", "_max"))
    totals = scaled.groupBy("sample").agg(F.sum("_s").alias("_total"))
    return scaled.join(totals, "sample").select(
        "sample", "feature",
        F.when(largest > standardize_above, F.try_divide("_s", "_total")).otherwise(F.col("_v")).alias("value"),
    )


# -- group summaries over sparse values --------------------------------------------

def group_sizes(samples: DataFrame, by: Sequence[str]) -> DataFrame:
    return samples.groupBy(*by).agg(F.countDistinct("sample").alias("samples"))


def group_mean_sd(
    df: DataFrame, samples: DataFrame, by: Sequence[str], key: str, value: str, zeros: bool = True
) -> DataFrame:
    """Mean, sd and non-zero count per (``by``, ``key``).

    With ``zeros`` a sample without a row counts as zero: the moments of the rows present
    are merged with those of the absent ones, and combinations without any row appear
    with mean 0.
    """
    joined = df.join(samples.select("sample", *by), "sample")
    v = F.col(value).cast("double")
    present = joined.groupBy(*by, key).agg(
        F.avg(v).alias("_m"), F.stddev_samp(v).alias("_sd"), F.var_pop(v).alias("_var"),
        F.count(v).alias("_k"), F.count_if(v != 0).alias("occurrences"),
    )
    if not zeros:
        return present.select(*by, key, F.col("_m").alias("mean"), F.col("_sd").alias("sd"), "occurrences")
    grid = complete_groups(joined, group_sizes(samples, by), [key], by)
    merged = null_safe_join(grid, present, [*by, key])
    k, m, n = F.coalesce("_k", F.lit(0)), F.coalesce("_m", F.lit(0.0)), F.col("samples")
    squares = k * F.coalesce("_var", F.lit(0.0)) + m * m * k * (n - k) / n
    return merged.select(
        *by, key, (k * m / n).alias("mean"), F.sqrt(F.try_divide(squares, n - 1)).alias("sd"),
        F.coalesce("occurrences", F.lit(0)).alias("occurrences"),
    )


def group_mean(df: DataFrame, samples: DataFrame, by: Sequence[str], key: str, value: str, zeros: bool = True) -> DataFrame:
    return group_mean_sd(df, samples, by, key, value, zeros).select(*by, key, "mean")


def occurrences(df: DataFrame, samples: DataFrame, by: Sequence[str], key: str, value: str = "n") -> DataFrame:
    """Samples with a non-zero value per (``by``, ``key``), zeros included."""
    return group_mean_sd(df, samples, by, key, value).select(*by, key, "occurrences")


def guild_sum(rel: DataFrame, tax_guild: DataFrame, value: str = "rel") -> DataFrame:
    """Relative abundance per (sample, guild class)."""
    guild = classes.guild_class(F.col("primary_guild"), F.col("genus")).alias("guild")
    joined = rel.join(tax_guild.select("feature", "genus", "primary_guild"), "feature", "left")
    return joined.groupBy("sample", guild).agg(F.sum(value).alias("abundance"))


def group_profile(
    rel: DataFrame, samples: DataFrame, tax: DataFrame, groups: Sequence[str], by: Sequence[str] = ("species", "time"), value: str = "rel"
) -> DataFrame:
    """Mean and non-zero count per treatment side by side, the mean of means, and taxonomy, per feature.

    ``groups`` lists the treatment labels (``by`` values joined with ``_``); one pivoted
    aggregation yields both measures.  Every feature of ``rel`` has its row, also one that none
    of ``samples`` holds (means and counts of 0).
    """
    observed = keep_in(samples, rel.select("sample"), "sample").select("sample", F.concat_ws("_", *by).alias("grp")).where(F.col("grp").isin(list(groups)))
    sizes = observed.groupBy("grp").agg(F.count(F.lit(1)).alias("samples")).agg(F.map_from_entries(F.collect_list(F.struct("grp", "samples")))).scalar()
    v = F.col(value).cast("double")
    wide = rel.join(observed, "sample", "left").groupBy("feature").pivot("grp", list(groups)).agg(F.sum(v).alias("sum"), F.count_if(v != 0).alias("count"))
    sized = wide.withColumn("_sizes", sizes)
    means = {g: F.try_divide(F.coalesce(F.col(f"{g}_sum"), F.lit(0.0)), F.col("_sizes")[g]) for g in groups}
    total = sum((F.coalesce(m, F.lit(0.0)) for m in means.values()), F.lit(0.0))
    used = sum((m.isNotNull().cast("int") for m in means.values()), F.lit(0))
    profile = sized.select(
        "feature",
        *[m.alias(f"mean_{g}") for g, m in means.items()],
        *[F.coalesce(F.col(f"{g}_count"), F.lit(0)).alias(f"count_{g}") for g in groups],
        F.try_divide(total, used).alias("global_mean"),
    )
    return profile.join(tax, "feature", "left")


# -- presence contrasts ------------------------------------------------------------

def margins(df: DataFrame, key: str, sets: Sequence[Sequence[str]], value: str) -> DataFrame:
    """Sums of ``value`` per ``key`` over each set of treatment columns, in one pass."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    grouped = df.groupingSets([[F.col(key), *[F.col(c) for c in s]] for s in sets], key, *columns)
    return grouped.agg(F.sum(value).alias(value))


def contrast_class(wide: DataFrame, first_time: str, second_time: str, first_species: str, second_species: str,
                   labels: Mapping[str, tuple[str, str]], min_n: int = 5, strict_first: bool = False) -> DataFrame:
    """Tags for taxa confined to one time or one species, and the combined tag."""
    time = classes.contrast_tag(F.col(first_time), F.col(second_time), labels["time"], min_n, strict_first)
    species = classes.contrast_tag(F.col(first_species), F.col(second_species), labels["species"], min_n, strict_first)
    tagged = wide.withColumns({"time_filter": time, "species_filter": species})
    return tagged.withColumn("combined", classes.combined_tag(F.col("time_filter"), F.col("species_filter")))


def presence_contrast(
    counts: DataFrame, samples: DataFrame, tax: DataFrame, rank: str = "genus", min_n: int = 5, strict_first: bool = False,
    times: tuple[str, str] = ("June20", "Jan21"), species: tuple[str, str] = ("A", "T"),
    labels: Mapping[str, tuple[str, str]] | None = None,
) -> DataFrame:
    """Taxa that occur in at least ``min_n`` samples of one condition and in none of the other."""
    rolled = taxonomy.rollup_rank(counts, tax, rank).where("n <> 0")
    joined = rolled.join(eligible_samples(samples).select("sample", "species", "time"), "sample")

    def occurring(column: str, level: str) -> Column:
        return F.count_if(F.col(column) == level).alias(level)

    wide = joined.groupBy("taxon").agg(*[occurring("time", t) for t in times], *[occurring("species", s) for s in species])
    return contrast_class(wide, *times, *species, labels or {"time": times, "species": species}, min_n, strict_first)


def prevalence_filter(counts: DataFrame, prv_cut: float, lib_cut: float = 0, key: str = "feature") -> DataFrame:
    """Keys present in at least ``prv_cut`` of the samples, in samples of at least ``lib_cut`` reads."""
    library = seq_depth(counts).where(F.col("depth") >= lib_cut)
    deep = keep_in(counts, library, "sample")
    n_samples = library.agg(F.count(F.lit(1))).scalar()
    # one row per (sample, key): a plain count combines map-side, a distinct one would shuffle every cell
    present = deep.where("n <> 0").groupBy(key).agg(F.count(F.lit(1)).alias("_p"))
    return keep_in(deep, present.where(F.col("_p") >= F.lit(prv_cut) * n_samples), key)


# -- scaled tables -----------------------------------------------------------------

def minmax_scale(df: DataFrame, key: str, value: str, samples: DataFrame) -> DataFrame:
    """``(x - min) / (max - min)`` per key over all ``samples``; constant keys give NULL.

    ``df`` has one row per (sample, key).  A key absent from some sample has a zero there,
    which bounds its minimum and maximum.
    """
    n_samples = samples.agg(F.count_distinct("sample")).scalar()
    v = F.col(value).cast("double")
    ranges = df.groupBy(key).agg(F.min(v).alias("_lo"), F.max(v).alias("_hi"), F.count(F.lit(1)).alias("_k"))
    sparse = F.col("_k") < n_samples
    lo = F.when(sparse, F.least("_lo", F.lit(0.0))).otherwise(F.col("_lo"))
    hi = F.when(sparse, F.greatest("_hi", F.lit(0.0))).otherwise(F.col("_hi"))
    ranges = ranges.select(key, lo.alias("_lo"), hi.alias("_hi"))
    scaled = F.try_divide(v - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    return null_safe_join(df, ranges, [key], "inner").withColumn("scaled", scaled).drop("_lo", "_hi")


def scaled_long(
    values: DataFrame, samples: DataFrame, selected: DataFrame, order: DataFrame, value: str = "n"
) -> DataFrame:
    """Heat-map table: every selected taxon in every eligible sample, scaled over all samples.

    ``values(sample, taxon, <value>)``, ``selected(taxon)``, ``order(taxon, taxon_order)``.
    Scaling comes before the eligibility filter.
    """
    observed = keep_in(samples, values.select("sample"), "sample")
    scaled = minmax_scale(keep_in(values, selected, "taxon"), "taxon", value, observed)
    ranges = scaled.groupBy("taxon").agg(F.max("scaled").alias("_max"))
    wanted = _selected_grid(ranges, eligible_samples(observed))
    filled = wanted.join(scaled.select("sample", "taxon", "scaled"), ["sample", "taxon"], "left")
    # absent means zero, which scales to zero; a constant taxon has no scale at all
    abundance = F.when(F.col("_max").isNotNull(), F.coalesce("scaled", F.lit(0.0)))
    table = filled.select(
        "sample", "taxon", "species", "time", F.concat_ws("_", "time", "species", "sample").alias("sample_mod"), abundance.alias("abundance")
    )
    return with_order(table, order, "taxon")


def _selected_grid(taxa: DataFrame, samples: DataFrame) -> DataFrame:
    """Every sample with every selected taxon, which is the size of the result: taxa are cut into
    blocks that each sample joins, so none of both is ever gathered."""
    blocks = F.greatest(F.lit(1), F.ceil(taxa.agg(F.count(F.lit(1))).scalar() / GRID_BLOCK)).cast("int")
    dealt = taxa.withColumn("_block", F.pmod(F.xxhash64("taxon"), blocks).cast("int"))
    spread = samples.select("sample", "species", "time", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("_block"))
    return spread.join(dealt, "_block").select("sample", "species", "time", "taxon", "_max")


# -- shares ------------------------------------------------------------------------

def count_by(df: DataFrame, by: Sequence[str], out: str = "n") -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(out))


def share_in_group(df: DataFrame, by: Sequence[str], value: str, out: str = "share") -> DataFrame:
    """Value over the total of its group."""
    totals = df.groupBy(*by).agg(F.sum(value).alias("_total"))
    return null_safe_join(df, totals, by, "inner").withColumn(out, F.try_divide(value, "_total")).drop("_total")


def rel_freq(df: DataFrame, value: str, out: str = "rel_freq") -> DataFrame:
    """Value over the grand total, which is a scalar subquery rather than a one-task window."""
    return df.withColumn(out, F.try_divide(F.col(value), df.agg(F.sum(value)).scalar()))


def table_summary(counts: DataFrame) -> DataFrame:
    """Total and number of non-zero cells per sample and per feature."""
    summed = counts.groupingSets([[F.col("sample")], [F.col("feature")]], "sample", "feature").agg(
        F.sum("n").alias("total"), F.count_if(F.col("n") != 0).alias("cells"), F.grouping("sample").alias("_by_feature")
    )
    return summed.select(
        F.when(F.col("_by_feature") == 1, "feature").otherwise("sample").alias("axis"),
        F.coalesce("sample", "feature").alias("id"), "total", "cells",
    )


def kept_by_step(steps: Mapping[str, DataFrame]) -> DataFrame:
    """Samples, features and reads left after each processing step."""
    parts = [
        df.agg(F.count_distinct("sample").alias("samples"), F.count_distinct("feature").alias("features"), F.sum("n").alias("reads"))
        .select(F.lit(i).alias("step_no"), F.lit(name).alias("step"), "samples", "features", "reads")
        for i, (name, df) in enumerate(steps.items())
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def summarise_numeric(df: DataFrame, fns: Sequence[str] = ("mean", "sd"), by: Sequence[str] = ()) -> DataFrame:
    """Every numeric column summarised, named ``{column}_{function}``; missing values are ignored."""
    functions = {"mean": F.avg, "sd": F.stddev_samp, "min": F.min, "max": F.max}
    columns = [f.name for f in df.schema if isinstance(f.dataType, NumericType) and f.name not in by]
    return df.groupBy(*by).agg(*[functions[f](c).alias(f"{c}_{f}") for c in columns for f in fns])


def col_means(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    means = summarise_numeric(df, ("mean",), by)
    return means.withColumnsRenamed({c: c.removesuffix("_mean") for c in means.columns if c not in by})
