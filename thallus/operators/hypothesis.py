"""Pairwise tests, normality and residual histograms."""

from __future__ import annotations

import math
from collections.abc import Sequence
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tails
from ..functions.numeric import normal_quantile
from .ranking import SLICE, bh_adjust, sliced, value_counts
from .relational import attach, null_safe_join

EXACT_BELOW = 50
SHAPIRO_MIN, SHAPIRO_MAX = 3, 5000
RANK_RUN, CELLS = 4096, 1 << 21


def pairwise_wilcox(df: DataFrame, y: str, g: str, by: Sequence[str] = (), levels: Sequence[str] | None = None) -> DataFrame:
    """Rank-sum test for every pair of groups, Benjamini-Hochberg adjusted.

    ``w`` belongs to ``group1``.  Equal values are counted first and put into slices of the value
    range; each slice gives all pairs' statistics and ties as matrix products, which are then
    summed.  Groups are data: their number is not limited and does not enter the plan.  Without ties and with both groups below 50 the
    p-value is exact, otherwise normal with tie and continuity correction.
    """
    used = df.where(F.col(y).isNotNull() & F.col(g).isNotNull())
    place = {name: i for i, name in enumerate(levels)} if levels else None
    if levels:
        used = used.where(F.col(g).isin(list(levels)))
    counted = used.groupBy(*by, y, F.col(g).alias("group")).agg(F.count(F.lit(1)).cast("double").alias("_n"))
    family = list(by) or ["_family"]
    placed = sliced(counted if by else counted.withColumn("_family", F.lit(0)), [y], by)
    inside = placed.groupBy(*family, SLICE, "group").agg(F.sum("_n").alias("_n"))
    # every slice meets every group of its family: as many rows as slices times groups
    slices, groups = placed.select(*family, SLICE).distinct(), placed.groupBy(*family, "group").agg(F.sum("_n").alias("_all"))
    grid = null_safe_join(slices, groups, family, "inner")
    earlier = Window.partitionBy(*family, "group").orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    absent = grid.withColumn("_n", F.lit(0.0)).unionByName(inside.withColumn("_all", F.lit(0.0)))
    filled = absent.groupBy(*family, SLICE, "group").agg(F.sum("_n").alias("_n"), F.max("_all").alias("_all"))
    offsets = filled.select(*family, SLICE, "group", "_all", F.coalesce(F.sum("_n").over(earlier), F.lit(0.0)).alias("_before"))
    head = [c for c in placed.columns if c in by]

    def partial(own: pd.DataFrame, known: pd.DataFrame) -> pd.DataFrame:
        """Rank sums and ties of all pairs inside one slice, for pairs with group1 first."""
        known = known.assign(_order=[place[v] if place else str(v) for v in known["_name"]]).sort_values("_order").reset_index(drop=True)
        k, before = len(known), known["_before"].to_numpy(float)
        column = own["group"].map({v: i for i, v in enumerate(known["_name"])}).to_numpy()
        row, n = pd.factorize(own[y], sort=True)[0], own["_n"].to_numpy(float)
        u, ties, step = np.zeros((k, k)), np.zeros((k, k)), max(1, CELLS // k)
        order = np.argsort(row, kind="stable")
        row, column, n = row[order], column[order], n[order]
        for low in range(0, int(row[-1]) + 1, step):
            at = slice(*np.searchsorted(row, [low, low + step]))
            counts = np.zeros((min(step, int(row[-1]) + 1 - low), k))
            counts[row[at] - low, column[at]] = n[at]
            upto = before + np.cumsum(counts, axis=0)
            u += counts.T @ (upto - counts / 2)
            before = upto[-1]
            cube, mixed = (counts**3 - counts).sum(axis=0), (counts**2).T @ counts
            ties += cube[:, None] + cube[None, :] + 3 * (mixed + mixed.T)
        i, j = np.triu_indices(k, 1)
        out = {c: [own[c].iloc[0]] * len(i) for c in head}
        names, every = known["_name"].to_numpy(), known["_all"].to_numpy(float)
        return pd.DataFrame(out | {"group1": names[i], "group2": names[j], "n1": every[i], "n2": every[j], "w": u[i, j], "ties": ties[i, j]})

    kinds = dict(counted.dtypes)
    schema = "".join(f"`{c}` {kinds[c]}, " for c in head) + f"group1 {kinds['group']}, group2 {kinds['group']}, n1 double, n2 double, w double, ties double"
    keys = [*head, SLICE]
    apart = offsets.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("group").alias("_name"), "_all", "_before")
    sums = placed.groupBy(*keys).cogroup(apart.groupBy(*[f"_of_{k}" for k in keys])).applyInPandas(partial, schema)
    rows = sums.groupBy(*by, "group1", "group2", "n1", "n2").agg(F.sum("w").alias("w"), F.sum("ties").alias("ties"))
    total = F.col("n1") + F.col("n2")
    spread = F.col("n1") * F.col("n2") / 12 * (total + 1 - F.try_divide("ties", total * (total - 1)))
    distance = F.col("w") - F.col("n1") * F.col("n2") / 2
    z = F.try_divide(distance - F.signum(distance) * 0.5, F.sqrt(spread))

    @F.pandas_udf("double")
    def p_value(w: pd.Series, n1: pd.Series, n2: pd.Series, ties: pd.Series, z: pd.Series) -> pd.Series:
        return pd.Series([
            tails.rank_sum_exact(u, int(a), int(b)) if t == 0 and max(a, b) < EXACT_BELOW
            else (None if pd.isna(score) else tails.normal_tail(score))
            for u, a, b, t, score in zip(w, n1, n2, ties, z)
        ], dtype="float64")

    tested = rows.withColumn("z", z).withColumn("p_value", p_value("w", "n1", "n2", "ties", "z")).drop("ties")
    return bh_adjust(tested, "p_value", by, bounded=True)


def pairwise_t(df: DataFrame, y: str, g: str, by: Sequence[str] = ()) -> DataFrame:
    """Pooled-sd t test for every pair of groups, Benjamini-Hochberg adjusted.  ``group1`` sorts first."""
    used = df.where(F.col(y).isNotNull() & F.col(g).isNotNull())
    v = F.col(y).cast("double")
    moments = used.groupBy(*by, F.col(g).alias("group")).agg(
        F.count(v).cast("double").alias("n"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(v)).alias("ss")
    )
    # one entry per treatment: the pairs of this short list are the table asked for
    pooled = moments.groupBy(*by).agg(
        F.sum("ss").alias("_ss"), (F.sum("n") - F.count(F.lit(1))).alias("df"), F.sort_array(F.collect_list(F.struct("group", "n", "mean"))).alias("_g")
    )
    firsts = pooled.select("*", F.posexplode("_g").alias("_at", "a"))
    pairs = firsts.withColumn("b", F.explode(F.slice("_g", F.col("_at") + 2, F.size("_g")))).select(
        *by, "_ss", "df", F.col("a.group").alias("group1"), F.col("b.group").alias("group2"), F.col("a.n").alias("n1"), F.col("b.n").alias("n2"),
        F.col("a.mean").alias("mean1"), F.col("b.mean").alias("mean2"),
    )
    scale = F.sqrt(F.try_divide("_ss", "df") * (1 / F.col("n1") + 1 / F.col("n2")))
    tested = pairs.withColumn("t", F.try_divide(F.col("mean1") - F.col("mean2"), scale))
    tested = tested.withColumn("p_value", tails.t_p(F.col("t"), F.col("df"))).select(*by, "group1", "group2", "n1", "n2", "t", "df", "p_value")
    return bh_adjust(tested, "p_value", by, bounded=True)


def histogram(df: DataFrame, x: str, bins: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width bins between minimum and maximum; Sturges' number of bins by default."""
    used = df.where(F.col(x).isNotNull())
    limits = used.groupBy(*by).agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count(F.lit(1)).alias("_n"))
    limits = limits.withColumn("bins", F.lit(bins) if bins else (F.ceil(F.log2("_n")) + 1).cast("int")).drop("_n")
    placed = attach(used, limits, by)
    width = (F.col("hi") - F.col("lo")) / F.col("bins")
    position = F.least(F.floor(F.try_divide(F.col(x) - F.col("lo"), width)) + 1, F.col("bins"))
    counted = placed.groupBy(*by, F.coalesce(position, F.lit(1)).cast("int").alias("bin"), "lo", "hi", "bins").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(
        *by, "bin", (F.col("lo") + (F.col("bin") - 1) * width).alias("lower"), (F.col("lo") + F.col("bin") * width).alias("upper"), "n"
    )


def _royston(n: int, normed: float, weighted: float, spread: float, outer_gap: float, inner_gap: float) -> tuple[float, float]:
    """Shapiro-Wilk W and p after Royston (1995), from sums over ranks.

    ``normed`` and ``weighted`` are the sums of m² and m·x with m the normal scores; the gaps lie
    between the largest and smallest, second largest and second smallest value.
    """
    if spread <= 0:
        return math.nan, math.nan
    u = 1 / math.sqrt(n)
    last, before = (NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in (n, n - 1))
    if n == 3:
        total = math.sqrt(0.5) * outer_gap
    else:
        # fixed values: Royston's polynomials for the outer weights
        outer = float(np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, last / math.sqrt(normed)], u))
        total, rest, norm = outer * outer_gap, weighted - last * outer_gap, normed - 2 * last**2
        left = 1 - 2 * outer**2
        if n > 5:
            second = float(np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, before / math.sqrt(normed)], u))
            total, rest, norm = total + second * inner_gap, rest - before * inner_gap, norm - 2 * before**2
            left -= 2 * second**2
        total += rest / math.sqrt(norm / left)
    w = min(1.0, total**2 / spread)
    if n == 3:
        return w, max(0.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75))))
    log_n = math.log(n)
    if n <= 11:
        gamma = 0.459 * n - 2.273
        if math.log1p(-w) >= gamma:
            return w, 1e-99
        z = -math.log(gamma - math.log1p(-w))
        mu = float(np.polyval([-0.0006714, 0.025054, -0.39978, 0.5440], n))
        sigma = math.exp(float(np.polyval([-0.0020322, 0.062767, -0.77857, 1.3822], n)))
    else:
        z = math.log1p(-w) if w < 1 else -math.inf
        mu = float(np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], log_n))
        sigma = math.exp(float(np.polyval([0.0030302, -0.082676, -0.4803], log_n)))
    return w, 0.5 * math.erfc((z - mu) / sigma / math.sqrt(2))


def shapiro(df: DataFrame, x: str, by: Sequence[str] = ()) -> DataFrame:
    """Shapiro-Wilk per group: ``w`` for groups of any size from 3 values on.

    Equal values are counted and ranked by running totals, a frequent one in runs of
    ``RANK_RUN`` ranks, and W comes out of sums over ranks, so no task ever holds a group; normal
    scores are expressions, Python sees one row per group.  The
    published p-value approximation ends at 5000 values: beyond, ``in_range`` is false and
    ``p_value`` NULL.  Below 3 values both results are NULL.
    """
    used = df.where(F.col(x).isNotNull()).select(*by, F.col(x).cast("double").alias("_x"))
    sizes = used.groupBy(*by).agg(F.count(F.lit(1)).alias("_size"), F.avg("_x").alias("_mean"), (F.var_pop("_x") * F.count(F.lit(1))).alias("_spread"))
    placed = attach(value_counts(used, "_x", by), sizes, by)
    runs = placed.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / RANK_RUN))))
    runs = runs.withColumn("_first", F.col("before_n") + 1 + F.col("_run") * RANK_RUN)
    runs = runs.withColumn("_rank", F.explode(F.sequence("_first", F.least(F.col("_first") + RANK_RUN - 1, F.col("before_n") + F.col("n")))))
    runs = runs.withColumn("_m", normal_quantile((F.col("_rank") - 0.375) / (F.col("_size") + 0.25)))

    def at(rank: Column) -> Column:
        return F.max(F.when((F.col("before_n") < rank) & (rank <= F.col("before_n") + F.col("n")), F.col("_x")))

    size = F.col("_size")
    sums = runs.groupBy(*by, "_size", "_spread").agg(
        F.sum(F.col("_m") * F.col("_m")).alias("_normed"), F.sum(F.col("_m") * (F.col("_x") - F.col("_mean"))).alias("_weighted"),
        (at(size) - at(F.lit(1))).alias("_outer"), (at(size - 1) - at(F.lit(2))).alias("_inner"),
    )
    names = ["_size", "_normed", "_weighted", "_spread", "_outer", "_inner"]

    @F.pandas_udf("w double, p_value double")
    def test(n: pd.Series, *given: pd.Series) -> pd.DataFrame:
        rows = [_royston(int(k), *own) if k >= SHAPIRO_MIN else (None, None) for k, *own in zip(n, *given)]
        return pd.DataFrame(rows, columns=["w", "p_value"], dtype="float64")

    in_range = F.col("n").between(SHAPIRO_MIN, SHAPIRO_MAX)
    tested = sums.withColumn("_t", test(*names)).select(*by, F.col("_size").alias("n"), F.col("_t.w").alias("w"), F.col("_t.p_value").alias("_p"))
    return tested.select(*by, "n", F.when(F.col("n") >= SHAPIRO_MIN, F.col("w")).alias("w"), F.when(in_range, F.col("_p")).alias("p_value"), in_range.alias("in_range"))
