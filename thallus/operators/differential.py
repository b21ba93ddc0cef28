"""Bias-corrected differential abundance (after Lin and Peddada's ANCOM-BC2)."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import tails
from ..runtime import durable
from . import taxonomy
from .ecology import prevalence_filter
from .models import _Columns, cell_moments, complete_cases, fitted_cells, lm
from .ranking import bh_adjust, level_index, quantiles
from .relational import eligible_samples, null_safe_join

PSEUDO_COUNTS = (0.1, 0.2, 0.3, 0.4, 0.5)
# One number per sample, or per taxon and treatment, is broadcast up to this size.
BROADCAST_BYTES = 32 << 20
# What a taxon and treatment takes there, fits of two rounds, its number and its mean included.
CELL_BYTES = 64


def log_counts(counts: DataFrame, samples: DataFrame, tax: DataFrame | None, factors: Sequence[str], rank: str = "genus", prv_cut: float = 0.02, lib_cut: float = 0) -> DataFrame:
    """``(taxon, sample, n, y, factors)`` for the taxa and samples that pass the filters; zeros are missing."""
    used = counts.join(samples.select("sample"), "sample", "left_semi")
    rolled = taxonomy.rollup_rank(used, tax, rank) if tax is not None else used.select("sample", F.col("feature").alias("taxon"), "n")
    kept = prevalence_filter(durable(rolled.where("n > 0")), prv_cut, lib_cut, "taxon")
    return kept.join(samples.select("sample", *factors), "sample").withColumn("y", F.log(F.col("n").cast("double")))


def taxon_ols(table: DataFrame, factors: Sequence[str], levels: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Per-taxon least squares of log counts; taxa whose design is deficient keep NULL coefficients."""
    return lm(table, "y", factors, by=["taxon"], levels=levels)


@dataclass(frozen=True)
class Settled:
    """How an iteration ended: rounds done, and whether it met its tolerance before its last allowed one."""

    rounds: int
    converged: bool


def _measured(table: DataFrame, row_bytes: int) -> DataFrame:
    """A small side of a join, broadcast if it is counted to be one."""
    return F.broadcast(table) if table.count() * row_bytes <= BROADCAST_BYTES else table


def _bias(table: DataFrame, factors: Sequence[str], levels, tol: float, max_iter: int) -> tuple[DataFrame, Settled]:
    """Sampling bias per sample: alternate per-taxon fits and per-sample mean residuals.

    Moments of y per taxon and treatment never change; a round adds the mean bias to them, solves, and
    takes the mean residual of every sample, which the fits alone decide.  ``table`` is read twice: store it.
    """
    cells = durable(cell_moments(table, "y", factors, [], ["taxon"], levels=levels))
    if cells.count() * CELL_BYTES <= BROADCAST_BYTES:
        return _bias_of_lists(table, cells, factors, levels, tol, max_iter)
    return _bias_of_cells(table, cells, factors, levels, tol, max_iter)


def _bias_of_lists(table: DataFrame, cells: DataFrame, factors: Sequence[str], levels, tol: float, max_iter: int) -> tuple[DataFrame, Settled]:
    """Taxa and treatments are few enough to broadcast a number for each.

    A sample is stored once as the list of its (taxon, treatment) numbers, and a round is one pass over
    these lists: the bias comes from the broadcast fits, and only means per taxon and treatment are shuffled.
    """
    keys = ["taxon", *factors]
    numbered = durable(level_index(cells, keys, "_cell"))
    listed = null_safe_join(table, F.broadcast(numbered.select(*keys, "_cell")), keys)
    listed = durable(listed.groupBy("sample").agg(F.sum("y").alias("y"), F.count(F.lit(1)).alias("n"), F.collect_list("_cell").alias("cells")).where("sample IS NOT NULL"))
    means, before, now, moved, rounds = numbered.select("_cell", F.lit(0.0).alias("_theta")), None, None, None, 0

    def residual(bases: str) -> Column:
        """Mean residual of a sample under the fits in column ``bases``."""
        fitted = F.aggregate("cells", F.lit(0.0), lambda total, c: total + F.get(bases, (c - 1).cast("int")))
        return (F.col("y") - fitted) / F.col("n")

    while rounds < max_iter:
        rounds += 1
        known = numbered.join(F.broadcast(means), "_cell").withColumn("m0", F.col("m0") - F.col("_theta")).select(*cells.columns)
        fits = null_safe_join(numbered.select(*keys, "_cell"), fitted_cells(known, factors, factors, [], ["taxon"], levels), keys)
        fits = fits.select("_cell", F.coalesce("_base", F.lit(0.0)).alias("_base"))  # one for each number, so that numbers are places
        before, now = now, durable(fits.agg(F.sort_array(F.collect_list(F.struct("_cell", "_base"))).alias("b")).select(F.col("b._base").alias("now")))
        step = listed.crossJoin(F.broadcast(now))
        step = step.crossJoin(F.broadcast(before.withColumnRenamed("now", "before"))) if before is not None else step
        step = step.select("cells", residual("now").alias("new"), residual("before").alias("old") if before is not None else F.lit(0.0).alias("old"))
        step = step.select(F.explode_outer("cells").alias("_cell"), "new", F.abs(F.col("new") - F.col("old")).alias("moved"))
        means = durable(step.groupBy("_cell").agg(F.avg("new").alias("_theta"), F.max("moved").alias("moved")))
        moved = means.agg(F.max("moved")).first()[0]
        if moved is None or moved < tol:
            break
    theta = listed.crossJoin(F.broadcast(now)).select("sample", residual("now").alias("theta")) if now is not None else listed.select("sample", F.lit(0.0).alias("theta"))
    return durable(theta), Settled(rounds, moved is None or moved < tol)


def _bias_of_cells(table: DataFrame, cells: DataFrame, factors: Sequence[str], levels, tol: float, max_iter: int) -> tuple[DataFrame, Settled]:
    """For more taxa and treatments than that.

    The rows are stored once in the order of their taxa, so a pass over them meets whole taxa and its
    partial sums are what is shuffled; a round joins them with the biases, and with the fits.
    """
    arranged = durable(table.repartitionByRange("taxon", "sample").sortWithinPartitions("taxon"))
    seen = durable(arranged.groupBy("sample").agg(F.sum("y").alias("y"), F.count(F.lit(1)).alias("n")))
    theta, moved, rounds = durable(seen.select("sample", F.lit(0.0).alias("theta"))), None, 0
    keys = ["taxon", *factors]
    while rounds < max_iter:
        rounds += 1
        biased = arranged.join(_measured(theta, 64), "sample").groupBy(*keys).agg(F.avg("theta").alias("_theta"))
        known = null_safe_join(cells, biased, keys, "inner").withColumn("m0", F.col("m0") - F.col("_theta")).select(*cells.columns)
        fits = durable(fitted_cells(known, factors, factors, [], ["taxon"], levels))
        fitted = null_safe_join(arranged, _measured(fits, 128), keys, "inner").groupBy("sample").agg(F.sum("_base").alias("_fitted"))
        step = durable(seen.join(fitted, "sample").join(theta, "sample").select("sample", "theta", ((F.col("y") - F.col("_fitted")) / F.col("n")).alias("new")))
        moved = step.agg(F.max(F.abs(F.col("new") - F.col("theta")))).first()[0]
        theta = step.select("sample", F.col("new").alias("theta"))
        if moved is None or moved < tol:
            break
    return theta, Settled(rounds, moved is None or moved < tol)


def sampling_bias(table: DataFrame, factors: Sequence[str], levels: Mapping[str, Sequence[str]] | None = None, rounds: int = 20, tol: float = 1e-5) -> DataFrame:
    """``(sample, theta)`` after at most so many rounds."""
    return _bias(durable(complete_cases(table, factors, levels)), factors, levels, tol, rounds)[0]


_PARAMETERS = ("delta", "l1", "l2", "k1", "k2", "p0", "p1", "p2")


def _valid(state: dict[str, float]) -> dict[str, float]:
    """Parameters back inside their ranges."""
    weights = [max(state[p], 0.0) for p in ("p0", "p1", "p2")]
    whole = sum(weights) or 1.0
    return dict(
        delta=state["delta"], l1=min(state["l1"], 0.0), l2=max(state["l2"], 0.0), k1=max(state["k1"], 0.0), k2=max(state["k2"], 0.0),
        p0=weights[0] / whole, p1=weights[1] / whole, p2=weights[2] / whole,
    )


def _em_round(estimates: DataFrame, states: Mapping[str, dict[str, float]]) -> dict[str, dict[str, float]]:
    """One EM round for every coefficient: one aggregation, a dozen sums per coefficient."""
    rows = [(name, *[float(states[name][f]) for f in _PARAMETERS]) for name in sorted(states)]
    params = estimates.sparkSession.createDataFrame(rows, "coefficient string, " + ", ".join(f"{f} double" for f in _PARAMETERS))
    b, v = F.col("estimate"), F.col("variance")
    joined = estimates.join(params, "coefficient").withColumn("d", b - F.col("delta"))
    spread = (v, v + F.col("k1"), v + F.col("k2"))
    offset = (F.lit(0.0), F.col("l1"), F.col("l2"))
    logs = {
        f"f{c}": F.log(F.greatest(f"p{c}", F.lit(1e-300))) - 0.5 * F.log(spread[c]) - 0.5 * (F.col("d") - offset[c]) ** 2 / spread[c]
        for c in range(3)
    }
    joined = joined.withColumns(logs).withColumn("top", F.greatest(*logs))
    joined = joined.withColumns({f"e{c}": F.exp(F.col(f"f{c}") - F.col("top")) for c in range(3)}).withColumn("whole", F.expr("e0 + e1 + e2"))
    joined = joined.withColumns({f"r{c}": F.col(f"e{c}") / F.col("whole") for c in range(3)})
    shares = [F.col(f"r{c}") for c in range(3)]
    sums = joined.groupBy("coefficient").agg(
        F.avg(F.col("top") + F.log("whole")).alias("fit"),
        *[F.sum(shares[c]).alias(f"r{c}") for c in range(3)],
        F.sum(sum((shares[c] * (b - offset[c]) / spread[c] for c in range(3)), F.lit(0.0))).alias("up"),
        F.sum(sum((shares[c] / spread[c] for c in range(3)), F.lit(0.0))).alias("down"),
        *[F.sum(shares[c] * F.col("d") / spread[c]).alias(f"a{c}") for c in (1, 2)],
        *[F.sum(shares[c] / spread[c]).alias(f"w{c}") for c in (1, 2)],
        *[F.sum(shares[c] * ((F.col("d") - offset[c]) ** 2 - v)).alias(f"s{c}") for c in (1, 2)],
    ).collect()

    def over(top: float, bottom: float) -> float:
        return top / bottom if bottom > 0 else 0.0

    return {
        r["coefficient"]: _valid(dict(
            delta=over(r["up"], r["down"]), l1=over(r["a1"], r["w1"]), l2=over(r["a2"], r["w2"]),
            k1=over(r["s1"], r["r1"]), k2=over(r["s2"], r["r2"]), p0=r["r0"], p1=r["r1"], p2=r["r2"],
        )) | {"fit": r["fit"]}
        for r in sums
    }


def _mixture_bias(estimates: DataFrame, tol: float, max_iter: int) -> dict[str, float]:
    """Shared bias per coefficient, see ``_mixture``."""
    return {name: delta for name, (delta, _) in _mixture(estimates, tol, max_iter).items()}


def _mixture(estimates: DataFrame, tol: float, max_iter: int) -> dict[str, tuple[float, Settled]]:
    """Shared bias per coefficient by EM for a three-part normal mixture over taxa, and how it ended.

    ``estimates(coefficient, estimate, variance)``.  It starts from exact quantiles.  Every third round starts from a squared
    extrapolation of the two before it, which reaches the fixed point in far fewer passes
    over the taxa.  A coefficient is done when neither its bias nor the mean log-likelihood
    moves by ``tol``; the mixture's other parameters may be barely identified.
    """
    ends = quantiles(estimates, "estimate", {"q1": 0.125, "q2": 0.25, "q6": 0.75, "q7": 0.875}, ["coefficient"])
    named = estimates.join(ends, "coefficient")
    b = F.col("estimate")
    low, high = F.when(b < F.col("q1"), b), F.when(b > F.col("q7"), b)
    start = named.groupBy("coefficient").agg(
        F.avg(F.when(b.between(F.col("q2"), F.col("q6")), b)).alias("delta"), F.avg(low).alias("low"), F.avg(high).alias("high"),
        F.coalesce(F.var_samp(low), F.lit(1.0)).alias("k1"), F.coalesce(F.var_samp(high), F.lit(1.0)).alias("k2"),
    ).collect()
    states = {
        r["coefficient"]: _valid(dict(
            delta=r["delta"] or 0.0, l1=(r["low"] or 0.0) - (r["delta"] or 0.0), l2=(r["high"] or 0.0) - (r["delta"] or 0.0),
            k1=r["k1"], k2=r["k2"], p0=0.75, p1=0.125, p2=0.125,
        ))
        for r in start
    }

    def gap(a: dict[str, float], c: dict[str, float]) -> float:
        return math.sqrt(sum((a[f] - c[f]) ** 2 for f in _PARAMETERS))

    active, rounds, ended = set(states), 0, {}
    while active and rounds < max_iter:
        first = {name: states[name] for name in active}
        second = _em_round(estimates, first)
        third = _em_round(estimates, second)
        rounds += 2
        for name in list(active):
            states[name] = third[name]
            settled = abs(third[name]["fit"] - second[name]["fit"]) < tol
            if settled and max(abs(s[name]["delta"] - first[name]["delta"]) for s in (second, third)) < tol:
                active.discard(name)
                ended[name] = rounds
                continue
            step = gap(second[name], first[name])
            turn = math.sqrt(sum((third[name][f] - 2 * second[name][f] + first[name][f]) ** 2 for f in _PARAMETERS))
            length = max(step / turn, 1.0) if turn > 0 else 1.0
            states[name] = _valid({
                f: first[name][f] + 2 * length * (second[name][f] - first[name][f])
                + length**2 * (third[name][f] - 2 * second[name][f] + first[name][f])
                for f in _PARAMETERS
            })
        if active:
            states.update(_em_round(estimates, {name: states[name] for name in active}))
            rounds += 1
    return {name: (s["delta"], Settled(ended.get(name, rounds), name in ended)) for name, s in states.items()}


def _fit(counts, samples, tax, factors, rank, prv_cut, lib_cut, levels, tol, max_iter):
    """Cells that have all factors, bias per sample, per-taxon fits of the corrected counts, and how the bias ended."""
    table = durable(complete_cases(log_counts(counts, eligible_samples(samples), tax, factors, rank, prv_cut, lib_cut), factors, levels))
    theta, settled = _bias(table, factors, levels, tol, max_iter)
    adjusted = table.join(theta, "sample").withColumn("z", F.col("y") - F.col("theta"))
    return table, theta, durable(lm(adjusted, "z", factors, by=["taxon"], levels=levels)), settled


def diff_abundance(
    counts: DataFrame, samples: DataFrame, tax: DataFrame | None, factors: Sequence[str] = ("species", "time"), rank: str = "genus",
    prv_cut: float = 0.02, lib_cut: float = 0, s0_perc: float = 0.01, alpha: float = 0.05,
    tol: float = 1e-5, max_iter: int = 20, em_max_iter: int = 100, levels: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """``taxon, coefficient, lfc, se, w, p_value, q_value, diff`` per non-intercept coefficient, with the
    rounds that both iterations took (``bias_rounds``, ``em_rounds``) and whether both ``converged``."""
    _, _, fits, settled = _fit(counts, samples, tax, factors, rank, prv_cut, lib_cut, levels, tol, max_iter)
    return _tested(fits, settled, s0_perc, alpha, tol, em_max_iter)


def scored(effects: DataFrame, bias: Mapping[str, float], s0_perc: float, alpha: float) -> DataFrame:
    """``taxon, coefficient, lfc, se, w, p_value, q_value, diff`` from estimates and the bias that their coefficient shares."""
    delta = F.create_map(*[F.lit(x) for pair in bias.items() for x in pair])[F.col("coefficient")] if bias else F.lit(0.0)
    floor = quantiles(effects, "se", {"s0": s0_perc}, ["coefficient"])
    tested = effects.join(floor, "coefficient").withColumn("lfc", F.col("estimate") - delta)
    tested = tested.withColumn("w", F.col("lfc") / (F.col("se") + F.col("s0"))).withColumn("p_value", tails.normal_p(F.col("w")))
    adjusted = bh_adjust(tested.select("taxon", "coefficient", "lfc", "se", "w", "p_value"), "p_value", ["coefficient"], "q_value")
    return adjusted.withColumn("diff", F.col("q_value") < alpha)


def effects_of(fits: DataFrame) -> DataFrame:
    """(taxon, coefficient, estimate, variance, se) of the coefficients that have a spread."""
    return fits.where((F.col("coefficient") != "(Intercept)") & F.col("std_error").isNotNull()).select(
        "taxon", "coefficient", "estimate", (F.col("std_error") ** 2).alias("variance"), F.col("std_error").alias("se")
    )


def _tested(fits: DataFrame, settled: Settled, s0_perc: float, alpha: float, tol: float, em_max_iter: int) -> DataFrame:
    # every EM round reads these few columns: kept in memory, rebuilt from the stored table if lost
    effects = durable(effects_of(fits)).persist()
    mixture = _mixture(effects, tol, em_max_iter)
    rows = scored(effects, {name: delta for name, (delta, _) in mixture.items()}, s0_perc, alpha)
    rounds, good = F.lit(None).cast("int"), F.lit(None).cast("boolean")
    for name, (_, ended) in mixture.items():
        rounds = F.when(F.col("coefficient") == name, ended.rounds).otherwise(rounds)
        good = F.when(F.col("coefficient") == name, ended.converged and settled.converged).otherwise(good)
    return rows.select("*", F.lit(settled.rounds).alias("bias_rounds"), rounds.alias("em_rounds"), good.alias("converged"))


def diff_sensitivity(
    counts: DataFrame, samples: DataFrame, tax: DataFrame | None, factors: Sequence[str] = ("species", "time"), rank: str = "genus",
    prv_cut: float = 0.02, lib_cut: float = 0, s0_perc: float = 0.01, alpha: float = 0.05, pseudo: Sequence[float] = PSEUDO_COUNTS,
    tol: float = 1e-5, max_iter: int = 20, em_max_iter: int = 100, levels: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """Does each decision hold when zeros count as small pseudo-counts?

    Every pseudo-count is added to all counts and the fit repeated.  The zeros of a taxon
    enter as moments: number, mean and spread of the bias over the samples of a treatment
    that lack it, so the zero cells are never listed.  With its zeros filled in, every taxon has
    the same design: the normal equations are solved once, for the treatments, and a taxon's
    coefficients and residuals are fixed combinations of its treatment means.  Adds
    ``pseudo_agree`` (how many of the refits give the same decision) and ``sensitive``.
    """
    table, theta, fits, settled = _fit(counts, samples, tax, factors, rank, prv_cut, lib_cut, levels, tol, max_iter)
    main = durable(_tested(fits, settled, s0_perc, alpha, tol, em_max_iter))
    refit = pseudo_fits(table, theta, samples, factors, pseudo, levels)
    decided = bh_adjust(refit.select("taxon", "pseudo", "coefficient", "p"), "p", ["pseudo", "coefficient"], "q")
    votes = decided.groupBy("taxon", "coefficient").agg(F.count_if(F.col("q") < alpha).alias("yes"), F.count(F.lit(1)).alias("fits"))
    judged = main.join(votes, ["taxon", "coefficient"], "left")
    agree = F.when(F.col("diff"), F.coalesce("yes", F.lit(0))).otherwise(F.col("fits") - F.col("yes"))
    return judged.withColumn("pseudo_agree", agree).withColumn("sensitive", agree < F.coalesce("fits", F.lit(len(pseudo)))).drop("yes", "fits")


def pseudo_fits(
    table: DataFrame, theta: DataFrame, samples: DataFrame, factors: Sequence[str], pseudo: Sequence[float], levels: Mapping[str, Sequence[str]] | None = None,
) -> DataFrame:
    """(taxon, pseudo, coefficient, estimate, std_error, p) of log(count + pseudo) - theta over all samples, zeros included."""
    everywhere = theta.join(samples.select("sample", *factors), "sample").groupBy(*factors).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum("theta").alias("all_t"), F.sum(F.col("theta") ** 2).alias("all_tt")
    ).toPandas()  # a row per treatment
    design = _Columns(everywhere.assign(m0=0.0, c0_0=0.0), list(factors), [], factors, dict(levels or {}), centre=False)
    _, kept = design.rss(design.of_terms(range(len(factors))))
    x = np.column_stack([design.parts[j][0] for j in kept])
    weight = everywhere["n"].to_numpy()
    inverse = np.linalg.inv(x.T @ (x * weight[:, None]))
    solve, dof = inverse @ (x * weight[:, None]).T, float(weight.sum()) - len(kept)
    fit = x @ solve
    fields = {f.name: f.dataType.simpleString() for f in table.schema.fields if f.name in factors}
    listed = table.sparkSession.createDataFrame(
        [(*[r[f] for f in factors], g, float(r["n"]), float(r["all_t"]), float(r["all_tt"])) for g, (_, r) in enumerate(everywhere.iterrows())],
        ", ".join([*[f"`{f}` {fields[f]}" for f in factors], "g int, all_n double, all_t double, all_tt double"]),
    )
    levels_of = F.explode(F.array(*[F.lit(float(p)) for p in pseudo]))
    joined = table.join(theta, "sample")
    varied = joined.withColumn("pseudo", levels_of).withColumn("z", F.log(F.col("n") + F.col("pseudo")) - F.col("theta"))
    present = varied.groupBy("taxon", "pseudo", *factors).agg(
        F.count(F.lit(1)).alias("k"), F.avg("z").alias("m"), F.var_pop("z").alias("v"), F.sum("theta").alias("t"), F.sum(F.col("theta") ** 2).alias("tt")
    )
    # every taxon in every treatment: treatments are few, so they ride along as one array
    treatments = listed.agg(F.collect_list(F.struct(*listed.columns))).scalar()
    grid = table.select("taxon").distinct().withColumn("pseudo", levels_of)
    grid = grid.withColumn("_g", F.explode(treatments)).select("taxon", "pseudo", "_g.*")
    cells = null_safe_join(grid, present, ["taxon", "pseudo", *factors])
    zeros = F.col("all_n") - F.coalesce("k", F.lit(0))
    missing = F.col("all_t") - F.coalesce("t", F.lit(0.0))
    mean_zero = F.log("pseudo") - F.coalesce(F.try_divide(missing, zeros), F.lit(0.0))
    square_zero = F.greatest(F.col("all_tt") - F.coalesce("tt", F.lit(0.0)) - F.coalesce(F.try_divide(missing**2, zeros), F.lit(0.0)), F.lit(0.0))
    k, m = F.coalesce("k", F.lit(0)), F.coalesce("m", F.lit(0.0))
    between = k * zeros / F.col("all_n") * (m - mean_zero) ** 2
    moments = cells.select("taxon", "pseudo", "g", ((k * m + zeros * mean_zero) / F.col("all_n")).alias("m"), (k * F.coalesce("v", F.lit(0.0)) + square_zero + between).alias("c"))
    rows = moments.groupBy("taxon", "pseudo").agg(F.sort_array(F.collect_list(F.struct("g", "m"))).alias("ms"), F.sum("c").alias("inside"))  # a number per treatment

    def combined(weights: np.ndarray) -> Column:
        return sum((F.lit(float(w)) * F.col("ms")[g]["m"] for g, w in enumerate(weights)), F.lit(0.0))

    spread = sum((float(weight[g]) * (F.col("ms")[g]["m"] - combined(fit[g])) ** 2 for g in range(len(weight))), F.lit(0.0))
    rows = rows.withColumn("error", (F.col("inside") + spread) / dof if dof > 0 else F.lit(None).cast("double"))
    told = [
        F.struct(F.lit(design.names[j]).alias("coefficient"), combined(solve[a]).alias("estimate"), F.sqrt(F.col("error") * float(inverse[a, a])).alias("std_error"))
        for a, j in enumerate(kept) if j
    ]
    if not told:
        return rows.select("taxon", "pseudo", F.lit("").alias("coefficient"), F.lit(0.0).alias("estimate"), F.lit(0.0).alias("std_error"), F.lit(0.0).alias("p")).where("false")
    listed_fits = rows.select("taxon", "pseudo", F.inline(F.array(*told))).where("std_error > 0")
    return listed_fits.withColumn("p", tails.t_p(F.col("estimate") / F.col("std_error"), F.lit(dof)))


def differing_taxa(tested: DataFrame) -> DataFrame:
    """Taxa with at least one significant coefficient."""
    return tested.groupBy("taxon").agg(F.max("diff").alias("any")).where("any").select("taxon")


