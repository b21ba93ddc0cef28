"""Tables behind the usual figures."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranking import value_counts
from .relational import attach, stack

QUARTILES = {"q1": 0.25, "median": 0.5, "q3": 0.75}


def quantiles(df: DataFrame, x: str, by: Sequence[str] = (), probabilities: Mapping[str, float] | None = None) -> DataFrame:
    """Exact quantiles (linear between order statistics), with ``n``."""
    return _quantiles_of_counts(value_counts(df, x, by), x, by, probabilities or QUARTILES)


def _quantiles_of_counts(counted: DataFrame, x: str, by: Sequence[str], probabilities: Mapping[str, float]) -> DataFrame:
    sizes = counted.groupBy(*by).agg(F.sum("n").alias("_n"))
    joined = attach(counted, sizes, by)
    v = F.col(x).cast("double")
    ends = []
    for name, p in probabilities.items():
        place = (F.col("_n") - 1) * F.lit(float(p))
        for side, at in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            here = (F.col("before_n") <= at) & (at < F.col("before_n") + F.col("n"))
            ends.append(F.max(F.when(here, v)).alias(f"_{name}_{side}"))
    picked = joined.groupBy(*by).agg(F.max("_n").alias("n"), *ends)

    def between(name: str, p: float):
        place = (F.col("n") - 1) * F.lit(float(p))
        return (F.col(f"_{name}_lo") + (place - F.floor(place)) * (F.col(f"_{name}_hi") - F.col(f"_{name}_lo"))).alias(name)

    return picked.select(*by, "n", *[between(name, p) for name, p in probabilities.items()])


def box_stats(df: DataFrame, x: str, by: Sequence[str] = (), exact: bool = True) -> DataFrame:
    """Quartiles, whiskers (most extreme values within 1.5 IQR) and number of outliers.

    Exact quartiles come from counted distinct values with distributed running totals;
    ``exact=False`` uses Spark's percentile sketch.
    """
    if exact:
        counted = value_counts(df, x, by)
        quartile = _quantiles_of_counts(counted, x, by, QUARTILES).drop("n")
    else:
        counted = df.where(F.col(x).isNotNull()).groupBy(*by, x).agg(F.count(F.lit(1)).alias("n"))
        sketch = df.groupBy(*by).agg(F.percentile_approx(x, list(QUARTILES.values())).alias("_q"))
        quartile = sketch.select(*by, *[F.col("_q")[i].cast("double").alias(q) for i, q in enumerate(QUARTILES)])
    joined = attach(counted, quartile, by)
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    v = F.col(x).cast("double")
    inside = v.between(F.col("q1") - reach, F.col("q3") + reach)
    return joined.groupBy(*by, *QUARTILES).agg(
        F.sum("n").alias("n"), F.min(F.when(inside, v)).alias("whisker_low"), F.max(F.when(inside, v)).alias("whisker_high"),
        F.sum(F.when(inside, F.lit(0)).otherwise(F.col("n"))).alias("outliers"),
    )


def trend_line(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """Least-squares line per facet."""
    a, b = F.col(y).cast("double"), F.col(x).cast("double")
    return df.where(a.isNotNull() & b.isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.regr_slope(a, b).alias("slope"), F.regr_intercept(a, b).alias("intercept"), F.regr_r2(a, b).alias("r2")
    )


def stacked_shares(methods: Mapping[str, DataFrame]) -> DataFrame:
    """Treatment means of several methods, one under the other."""
    return stack(methods, "method")
