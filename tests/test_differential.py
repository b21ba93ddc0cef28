import numpy as np
import pytest

from thallus.operators import differential
from thallus.runtime import durable

LEVELS = {"species": ["A", "T"], "time": ["June20", "Jan21"]}


@pytest.fixture(scope="module")
def study(spark):
    """40 taxa, two of them changed by species, samples sequenced to very different depths."""
    rng = np.random.default_rng(21)
    samples, counts = [], []
    for s in range(48):
        species, time = "AT"[s % 2], ("June20", "Jan21")[(s // 2) % 2]
        samples.append((f"s{s}", species, time, "S1"))
        depth = np.exp(rng.normal(0, 0.7))
        for t in range(40):
            shift = {3: 2.5, 7: -2.5}.get(t, 0.0) * (species == "T")
            n = rng.poisson(depth * np.exp(3.0 + 0.05 * t + shift + rng.normal(0, 0.3)))
            if n:
                counts.append((f"s{s}", f"t{t:02d}", int(n)))
    return (
        spark.createDataFrame(counts, "sample string, feature string, n long"),
        spark.createDataFrame(samples, "sample string, species string, time string, stand string"),
    )


@pytest.fixture(scope="module")
def tested(study):
    counts, samples = study
    return durable(differential.diff_abundance(counts, samples, None, levels=LEVELS))


def test_finds_the_changed_taxa(tested):
    rows = tested.collect()
    hits = {r.taxon for r in rows if r.coefficient == "species[T]" and r["diff"]}
    assert {"t03", "t07"} <= hits and len(hits) <= 4
    effect = {r.taxon: r.lfc for r in rows if r.coefficient == "species[T]"}
    assert effect["t03"] == pytest.approx(2.5, abs=0.4) and effect["t07"] == pytest.approx(-2.5, abs=0.4)
    assert not any(r["diff"] for r in rows if r.coefficient == "time[Jan21]")


def test_decisions_hold_with_pseudo_counts(study):
    counts, samples = study
    rows = differential.diff_sensitivity(counts, samples, None, levels=LEVELS).collect()
    strong = [r for r in rows if r.taxon in ("t03", "t07") and r.coefficient == "species[T]"]
    assert len(strong) == 2 and all(r.pseudo_agree == 5 and not r.sensitive for r in strong)


def test_listed_taxa(tested):
    listed = {r.taxon for r in differential.differing_taxa(tested).collect()}
    assert {"t03", "t07"} <= listed


def test_mixture_bias_recovers_a_shared_shift(spark):
    rng = np.random.default_rng(1)
    se = rng.uniform(0.05, 0.15, 400)
    b = 0.4 + rng.normal(size=400) * se
    b[:40] += rng.normal(2, 0.2, 40)
    b[40:80] -= rng.normal(2, 0.2, 40)
    df = spark.createDataFrame([("e", float(x), float(s * s)) for x, s in zip(b, se)], "coefficient string, estimate double, variance double")
    assert differential._mixture_bias(df, 1e-5, 100)["e"] == pytest.approx(0.4, abs=0.02)


def test_pseudo_counts_equal_refits(study):
    counts, samples = study
    factors = ["species", "time"]
    table, theta, _, settled = differential._fit(counts, samples, None, factors, "genus", 0.02, 0, LEVELS, 1e-5, 20)
    assert settled.converged and settled.rounds > 1
    bias = {r.sample: r.theta for r in theta.collect()}
    given = {r.sample: (1.0, float(r.species == "T"), float(r.time == "Jan21")) for r in samples.collect()}
    n = {(r.taxon, r.sample): r.n for r in table.collect()}
    order = sorted(bias)
    x = np.array([given[s] for s in order])
    inverse = np.linalg.inv(x.T @ x)
    for r in differential.pseudo_fits(table, theta, samples, factors, (0.1, 0.5), LEVELS).collect():
        y = np.array([np.log(n.get((r.taxon, s), 0) + r.pseudo) - bias[s] for s in order])
        beta = inverse @ x.T @ y
        error = ((y - x @ beta) ** 2).sum() / (len(order) - 3)
        at = {"species[T]": 1, "time[Jan21]": 2}[r.coefficient]
        assert r.estimate == pytest.approx(beta[at], abs=1e-9)
        assert r.std_error == pytest.approx(np.sqrt(error * inverse[at, at]), rel=1e-9)


def test_says_how_it_ended(study, tested):
    assert all(r.converged and 1 < r.bias_rounds <= 20 and 0 < r.em_rounds for r in tested.collect())
    counts, samples = study
    table = differential.log_counts(counts, samples, None, ["species", "time"])
    assert differential._bias(table, ["species", "time"], LEVELS, 1e-5, 1)[1] == differential.Settled(1, False)
