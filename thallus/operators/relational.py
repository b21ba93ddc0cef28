"""Projection, filtering, joining and reshaping of long community tables.

No operator forces a broadcast: Catalyst and AQE decide from measured sizes, and AQE
splits the hot keys of the shuffled joins that remain.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import classes, text

CONTROL_STAND, NEGATIVE_SPECIES = "C", "Neg"


# -- scans to rows -----------------------------------------------------------------

def build_manifest(lists: DataFrame, dirs: DataFrame, exclude: DataFrame) -> DataFrame:
    """``lists(name, batch)`` + ``dirs(batch, dir)`` to ``(sample-id, absolute-filepath)`` without excluded samples."""
    named = lists.select(text.manifest_name(F.col("name")).alias("sample-id"), "batch")
    kept = named.join(exclude.select(F.col("name").alias("sample-id")).distinct(), "sample-id", "left_anti")
    return kept.join(dirs, "batch").select(
        "sample-id", F.concat("dir", F.lit("/"), F.col("sample-id"), F.lit(".fastq")).alias("absolute-filepath")
    )


# -- projection and filters --------------------------------------------------------

def cols_where(
    df: DataFrame,
    starts_with: str | None = None,
    dtype: Sequence[str] | None = None,
    between: tuple[str, str] | None = None,
    exclude: Sequence[str] = (),
) -> list[str]:
    """Names of the columns that satisfy every given test; ``between`` is a lexical range."""
    return [
        name
        for name, kind in df.dtypes
        if name not in exclude
        and (starts_with is None or name.startswith(starts_with))
        and (dtype is None or kind in dtype)
        and (between is None or between[0] <= name <= between[1])
    ]


def keys_between(df: DataFrame, key: str, low: str, high: str, unassigned: str = text.UNASSIGNED) -> DataFrame:
    """Long-form name range: keys in a lexical range, where the catch-all group sorts last and falls out."""
    return df.where(F.col(key).between(low, high) & (F.col(key) != unassigned))


def eligible_samples(samples: DataFrame) -> DataFrame:
    """Without uninoculated controls and negatives."""
    return samples.where((F.col("stand") != CONTROL_STAND) & (F.col("species") != NEGATIVE_SPECIES))


def keep_in(df: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    return df.join(lookup.select(key), key, "left_semi")


def drop_in(df: DataFrame, lookup: DataFrame, key: str) -> DataFrame:
    return df.join(lookup.select(key), key, "left_anti")


def filter_features(counts: DataFrame, tax: DataFrame, predicate: Column | str) -> DataFrame:
    """Counts of the features whose taxonomy satisfies ``predicate``."""
    return keep_in(counts, tax.where(predicate), "feature")


def drop_incomplete(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Rows without NULL or NaN."""
    floats = {name for name, kind in df.dtypes if kind in ("double", "float")}
    wanted = list(cols or df.columns)
    complete = [F.col(c).isNotNull() & (~F.isnan(c) if c in floats else F.lit(True)) for c in wanted]
    return df.where(reduce(Column.__and__, complete))


def strip_prefix(df: DataFrame, col: str, prefix: str) -> DataFrame:
    """Rows whose ``col`` carries ``prefix``, with the prefix removed."""
    return df.where(F.col(col).contains(prefix)).withColumn(col, text.without_prefix(F.col(col), prefix))


def filter_reference(df: DataFrame, col: str, any_of: Sequence[str], none_of: Sequence[str]) -> DataFrame:
    """Rows whose text names any of one list and none of another, ignoring case."""
    def named(words: Sequence[str]) -> Column:
        return F.col(col).rlike(r"(?i)(?<!\w)(" + "|".join(map(re.escape, words)) + r")(?!\w)")

    return df.where(named(any_of) & ~named(none_of))


# -- joins -------------------------------------------------------------------------

def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "left") -> DataFrame:
    """Equi join in which a missing key matches a missing key."""
    if not keys:
        raise ValueError("null_safe_join needs keys")
    marked = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    on = reduce(Column.__and__, [left[k].eqNullSafe(marked[f"__{k}"]) for k in keys])
    joined = left.join(marked, on, how)
    return joined if how in ("left_semi", "left_anti") else joined.drop(*[f"__{k}" for k in keys])


def with_metadata(df: DataFrame, samples: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    wanted = samples if cols is None else samples.select("sample", *cols)
    return df.join(wanted, "sample", "left")


def with_taxonomy(df: DataFrame, tax: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.join(tax.select("feature", *cols), "feature", "left")


def with_order(df: DataFrame, order: DataFrame, key: str) -> DataFrame:
    return null_safe_join(df, order, [key])


def apply_overrides(tax_raw: DataFrame, edits: DataFrame, key: str = "feature") -> DataFrame:
    """The edited lineage where there is one."""
    return tax_raw.join(edits.select(key, "edited"), key, "left").select(
        *[F.coalesce("edited", "lineage").alias("lineage") if c == "lineage" else c for c in tax_raw.columns]
    )


def distinct_union(*dfs: DataFrame, key: str) -> DataFrame:
    return reduce(DataFrame.union, [df.select(key) for df in dfs]).distinct()


# -- reshaping ---------------------------------------------------------------------

def unpivot(df: DataFrame, ids: Sequence[str], values: Sequence[str], name: str, value: str) -> DataFrame:
    return df.unpivot(list(ids), list(values), name, value)


def pivot_unique(
    df: DataFrame, ids: Sequence[str], col: str, value: str, values: Sequence[str], prefix: str = "", fill: float | str | None = None
) -> DataFrame:
    """Long to wide with known column values; a repeated (ids, col) fails as it has no single value.

    ``fill`` stands for what the long table leaves out, as in a table that lists no zeros.
    """
    single = F.when(F.count(F.lit(1)) > 1, F.raise_error(F.lit(f"more than one {value} for the same {col}"))).otherwise(
        F.first(value)
    )
    kind = dict(df.dtypes)[value]
    wide = df.groupBy(*ids).pivot(col, list(values)).agg(single.cast(kind))
    if fill is not None:
        wide = wide.withColumns({v: F.coalesce(F.col(f"`{v}`"), F.lit(fill).cast(kind)) for v in values})
    return wide.withColumnsRenamed({v: f"{prefix}{v}" for v in values})


def pivot_mean_count(df: DataFrame, group: str, key: str, value: str, groups: Sequence[str]) -> DataFrame:
    """Mean and number of values per group side by side, in one aggregation per ``key``."""
    wide = df.groupBy(key).pivot(group, list(groups)).agg(F.avg(value).alias("mean"), F.count(value).alias("count"))
    return wide.select(key, *[c for g in groups for c in (
        F.col(f"{g}_mean").alias(f"mean_{g}"), F.coalesce(F.col(f"{g}_count"), F.lit(0)).alias(f"count_{g}"))])


def transpose(df: DataFrame, row: str, col: str, value: str, rows: Sequence[str]) -> DataFrame:
    """Display form of the transposed table: one row per ``col`` value, one column per ``rows`` value."""
    return pivot_unique(df.select(row, col, value), [col], row, value, rows)


def state_transition(
    df: DataFrame, subject: str, time: str, state: str, times: Sequence[str]
) -> DataFrame:
    return pivot_unique(df, [subject], time, state, times)


def stack(tagged: Mapping[str, DataFrame], tag: str = "method") -> DataFrame:
    """Rows of several tables matched by column name, each marked with its tag."""
    parts = [df.withColumn(tag, F.lit(name)) for name, df in tagged.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def sort_levels(df: DataFrame, cols: Sequence[str], levels: Mapping[str, Sequence[str]]) -> DataFrame:
    """Sort with explicit level orders where given."""
    return df.orderBy(
        *[classes.level_rank(F.col(c), levels[c]).asc_nulls_last() if c in levels else F.col(c) for c in cols]
    )


def complete_groups(values: DataFrame, groups: DataFrame, keys: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Every ``keys`` value once per row of ``groups``: absent combinations carry a zero later on.

    ``groups`` is a treatment table (a row per treatment), so it rides along as one array.
    """
    treatments = groups.agg(F.collect_list(F.struct(*groups.columns))).scalar()
    grid = values.select(*keys).distinct().select(*keys, F.explode(treatments).alias("_g"))
    return grid.select(*keys, *[F.col(f"_g.{c}").alias(c) for c in groups.columns])


def attach(df: DataFrame, table: DataFrame, by: Sequence[str]) -> DataFrame:
    """Group-level columns next to the rows of their group; without ``by`` the one row is a scalar subquery."""
    if by:
        return null_safe_join(df, table, by, "inner")
    row = table.select(F.struct(*table.columns)).scalar()
    return df.withColumn("_row", row).select(*df.columns, "_row.*")
