"""Totals along an order, without a window over one unbounded group.

Rows are range-partitioned by the order and stored once; each slice is summed, the
(few) slice totals give every slice its offset, and the inner window never spans more
than one slice.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import durable
from .relational import attach, null_safe_join

SLICE = "_slice"
_ALL_BEFORE = (Window.unboundedPreceding, -1)


def sliced(df: DataFrame, order: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """``df`` stored in range slices of (by, order); ``_slice`` numbers them in order."""
    return durable(df.repartitionByRange(*by, *order).withColumn(SLICE, F.spark_partition_id()))


def running_totals(df: DataFrame, order: Sequence[str], sums: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Adds ``before_<s>``: the total of ``s`` over all earlier rows of the same ``by`` group.

    (by, order) should be unique per row for the result to be well defined.
    """
    placed = sliced(df, order, by)
    totals = placed.groupBy(*by, SLICE).agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    over_slices = Window.partitionBy(*by).orderBy(SLICE).rowsBetween(*_ALL_BEFORE)
    offsets = totals.select(
        *by, SLICE, *[F.coalesce(F.sum(f"_t_{s}").over(over_slices), F.lit(0)).alias(f"_o_{s}") for s in sums]
    )
    inside = Window.partitionBy(*by, SLICE).orderBy(*order).rowsBetween(*_ALL_BEFORE)
    joined = null_safe_join(placed, offsets, [*by, SLICE], "inner")
    return joined.select(
        *placed.columns,
        *[(F.coalesce(F.sum(s).over(inside), F.lit(0)) + F.col(f"_o_{s}")).alias(f"before_{s}") for s in sums],
    )


def value_counts(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """Distinct values with ``n`` (how often) and ``before_n`` (how many rows are smaller).

    Counting first means a value shared by a third of the rows is one row here.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    return running_totals(counted, [value], ["n"], by)


def quantiles(df: DataFrame, value: str, probabilities: Mapping[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Exact quantiles per group, interpolated between the two ranks around ``p (n - 1)``: one column per probability."""
    counted = value_counts(df, value, by)
    sizes = counted.groupBy(*by).agg(F.sum("n").alias("_all"))
    placed = attach(counted, sizes, by)

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("before_n") <= rank) & (rank < F.col("before_n") + F.col("n")), F.col(value)))

    columns = []
    for name, p in probabilities.items():
        place = F.lit(float(p)) * (F.col("_all") - 1)
        columns += [at(F.floor(place)).alias(f"_low_{name}"), at(F.ceil(place)).alias(f"_high_{name}"), F.max(place - F.floor(place)).alias(f"_part_{name}")]
    found = placed.groupBy(*by).agg(*columns)
    return found.select(*by, *[(F.col(f"_low_{c}") + F.col(f"_part_{c}") * (F.col(f"_high_{c}") - F.col(f"_low_{c}"))).alias(c) for c in probabilities])


def dense_index(df: DataFrame, key: str, name: str = "index") -> DataFrame:
    """Distinct keys numbered from zero in key order."""
    keys = df.select(key).distinct().withColumn("_one", F.lit(1).cast("long"))
    return running_totals(keys, [key], ["_one"]).select(key, F.col("before__one").alias(name))


def level_index(df: DataFrame, order_cols: Sequence[str], name: str = "level") -> DataFrame:
    """Rows with the 1-based rank of their distinct ``order_cols`` combination."""
    levels = df.select(*order_cols).distinct().withColumn("_one", F.lit(1).cast("long"))
    ranked = running_totals(levels, order_cols, ["_one"]).select(*order_cols, (F.col("before__one") + 1).alias(name))
    return null_safe_join(df, ranked, order_cols, "inner")


def bh_adjust(df: DataFrame, p: str = "p_value", by: Sequence[str] = (), out: str = "p_adj", bounded: bool = False) -> DataFrame:
    """Benjamini-Hochberg within ``by``; rows with a NULL p keep a NULL result.

    ``bounded=True`` is for families whose size the design limits (all pairs of a
    few treatments): a plain window is enough there.
    """
    untested = df.where(F.col(p).isNull()).withColumn(out, F.lit(None).cast("double"))
    tested = df.where(F.col(p).isNotNull())
    if bounded:
        ascending = Window.partitionBy(*by).orderBy(p)
        rank = F.count(F.lit(1)).over(ascending)
        family = F.count(F.lit(1)).over(Window.partitionBy(*by))
        tested = tested.withColumn("_q", F.col(p) * family / rank)
        following = ascending.rowsBetween(Window.currentRow, Window.unboundedFollowing)
        adjusted = tested.withColumn(out, F.least(F.min("_q").over(following), F.lit(1.0))).drop("_q")
        return adjusted.unionByName(untested)
    # equal p-values share a rank (the last of them), so each distinct one is counted once
    counted = tested.groupBy(*by, p).agg(F.count(F.lit(1)).alias("_n"))
    placed = running_totals(counted, [p], ["_n"], by)
    family = placed.groupBy(*by).agg(F.sum("_n").alias("_m"))
    placed = attach(placed, family, by).withColumn("_q", F.col(p) * F.col("_m") / (F.col("before__n") + F.col("_n")))
    lowest = placed.groupBy(*by, SLICE).agg(F.min("_q").alias("_low"))
    later = Window.partitionBy(*by).orderBy(F.desc(SLICE)).rowsBetween(*_ALL_BEFORE)
    lowest = lowest.select(*by, SLICE, F.min("_low").over(later).alias("_later"))
    inside = Window.partitionBy(*by, SLICE).orderBy(F.desc(p)).rowsBetween(Window.unboundedPreceding, 0)
    adjusted = null_safe_join(placed, lowest, [*by, SLICE], "inner").withColumn(
        out, F.least(F.min("_q").over(inside), F.col("_later"), F.lit(1.0))
    )
    valued = null_safe_join(tested, adjusted.select(*by, p, out), [*by, p], "inner")
    return valued.select(*df.columns, out).unionByName(untested)
