import math

import numpy as np
import pytest
from conftest import values

from thallus.functions import tails
from thallus.operators import ecology, hypothesis, models, ranking, summaries


def test_tail_probabilities():
    assert tails.t_tail(2.0, 10) == pytest.approx(0.07338803, abs=1e-8)
    assert tails.t_tail(1.0, 1) == pytest.approx(0.5)
    assert tails.f_tail(4.102821, 2, 10) == pytest.approx(0.05, abs=1e-6)
    assert tails.f_tail(3.0, 2, 2) == pytest.approx(0.25)  # closed form 1/(1+f) for 2 and 2 degrees
    assert tails.chi2_tail(3.841459, 1) == pytest.approx(0.05, abs=1e-7)
    assert tails.chi2_tail(10.0, 2) == pytest.approx(math.exp(-5))
    assert tails.chi2_tail(0.5, 4) == pytest.approx(math.exp(-0.25) * 1.25)
    assert tails.normal_tail(1.959964) == pytest.approx(0.05, abs=1e-7)
    assert tails.rank_sum_exact(0, 3, 3) == pytest.approx(0.1)
    assert tails.rank_sum_exact(5, 4, 6) == pytest.approx(2 * 18 / 210, abs=0.02)


@pytest.fixture(scope="module")
def experiment():
    rng = np.random.default_rng(11)
    rows = []
    for i in range(90):
        a, b = "AT"[i % 2], "xyz"[(i * 7) % 3]
        x = float(rng.normal())
        rows.append((a, b, x, float(rng.normal() + (a == "T") + 0.5 * x), f"p{i % 30}", "one" if i < 60 else "two"))
    rows.append(("A", None, 1.0, 2.0, "p1", "one"))
    rows.append(("A", "x", 1.0, None, "p1", "one"))
    return rows


@pytest.fixture(scope="module")
def table(spark, experiment):
    return spark.createDataFrame(experiment, "a string, b string, x double, y double, pot string, half string").cache()


def design(rows, terms):
    n = len(rows)
    codes = {"a": [(lambda r: r[0] == "T")], "b": [lambda r, v=v: r[1] == v for v in "yz"], "x": [lambda r: r[2]]}
    columns = [np.ones(n)]
    for term in terms:
        built = [np.ones(n)]
        for v in term.split(":"):
            built = [c * np.array([float(f(r)) for r in rows]) for c in built for f in codes[v]]
        columns += built
    return np.column_stack(columns)


def rss(rows, terms):
    x, y = design(rows, terms), np.array([r[3] for r in rows])
    beta, *_ = np.linalg.lstsq(x, y, rcond=None)
    return float(((y - x @ beta) ** 2).sum()), np.linalg.matrix_rank(x), beta


def test_coefficients(table, experiment):
    rows = [r for r in experiment if r[1] and r[3] is not None and r[5] == "one"]
    terms = ["a", "b", "x", "a:x"]
    want_rss, rank, beta = rss(rows, terms)
    got = models.lm(table, "y", terms, by=["half"]).where("half = 'one'").collect()
    assert [r.estimate for r in got] == pytest.approx(list(beta))
    assert got[0].sigma == pytest.approx(math.sqrt(want_rss / (len(rows) - rank)))
    x = design(rows, terms)
    se = np.sqrt(np.diag(np.linalg.inv(x.T @ x)) * want_rss / (len(rows) - rank))
    assert [r.std_error for r in got] == pytest.approx(list(se))


def test_type_two_table(table, experiment):
    rows = [r for r in experiment if r[1] and r[3] is not None]
    terms = ["a", "b", "x", "a:b"]
    full, rank, _ = rss(rows, terms)
    got = {r.term: r for r in models.anova(table, "y", terms).collect()}
    want = {
        "a": rss(rows, ["b", "x"])[0] - rss(rows, ["a", "b", "x"])[0],
        "b": rss(rows, ["a", "x"])[0] - rss(rows, ["a", "b", "x"])[0],
        "x": rss(rows, ["a", "b", "a:b"])[0] - full,
        "a:b": rss(rows, ["a", "b", "x"])[0] - full,
    }
    for term, ss in want.items():
        assert got[term].sum_sq == pytest.approx(ss)
        assert got[term].f_value == pytest.approx(ss / got[term].df / (full / (len(rows) - rank)))
    assert got["Residuals"].df == len(rows) - rank and got["a:b"].df == 2


def test_one_way_adds_up(table, experiment):
    y = np.array([r[3] for r in experiment if r[1] and r[3] is not None])
    got = models.anova(table.where("b is not null"), "y", ["b"]).collect()
    assert sum(r.sum_sq for r in got) == pytest.approx(((y - y.mean()) ** 2).sum())


def test_aliased_terms_drop_out(spark):
    rows = [("A", "x", 1.0), ("A", "x", 2.0), ("T", "y", 4.0), ("T", "y", 6.0), ("T", "y", 5.0)]
    df = spark.createDataFrame(rows, "a string, b string, y double")
    got = {r.term: r for r in models.anova(df, "y", ["a", "b", "a:b"]).collect()}
    assert got["b"].df == 0 and got["a:b"].df == 0 and got["Residuals"].df == 3
    assert [r.estimate is None for r in models.lm(df, "y", ["a", "b"]).collect()] == [False, False, True]


def test_large_offset_does_not_cancel(spark):
    rng = np.random.default_rng(0)
    ys = rng.normal(size=40)
    df = spark.createDataFrame([("AT"[i % 2], float(1e9 + ys[i])) for i in range(40)], "a string, y double")
    a, t = ys[::2], ys[1::2]
    ssw = ((a - a.mean()) ** 2).sum() + ((t - t.mean()) ** 2).sum()
    assert {r.term: r.sum_sq for r in models.anova(df, "y", ["a"]).collect()}["Residuals"] == pytest.approx(ssw, rel=1e-5)


def test_residuals_with_covariate(table, experiment):
    rows = [r for r in experiment if r[1] and r[3] is not None]
    x, y = design(rows, ["a", "x"]), np.array([r[3] for r in rows])
    beta = np.linalg.lstsq(x, y, rcond=None)[0]
    got = sorted(r.residual for r in models.residuals(table.where("b is not null"), "y", ["a", "x"]).collect())
    assert got == pytest.approx(sorted(y - x @ beta))


def reml(y, x, subjects):
    """Profiled REML deviance of a random-intercept model, by full matrices."""
    z = (subjects[:, None] == np.unique(subjects)[None, :]).astype(float)

    def deviance(theta):
        v = np.eye(len(y)) + theta * z @ z.T
        w = np.linalg.inv(v)
        beta = np.linalg.solve(x.T @ w @ x, x.T @ w @ y)
        r = y - x @ beta
        dof = len(y) - x.shape[1]
        return np.linalg.slogdet(v)[1] + np.linalg.slogdet(x.T @ w @ x)[1] + dof * math.log(r @ w @ r), beta, (r @ w @ r) / dof

    grid = np.concatenate([[0], np.geomspace(1e-4, 100, 4000)])
    best = min(grid, key=lambda t: deviance(t)[0])
    return best, *deviance(best)[1:]


def test_mixed_model_equals_full_matrices(spark):
    rng = np.random.default_rng(4)
    rows = []
    for p in range(25):
        u = rng.normal()
        for k in range(1 + p % 3):
            rows.append((f"p{p}", "AT"[p % 2], "xy"[k % 2], float(1 + u + 0.8 * (p % 2) + 0.6 * rng.normal())))
    df = spark.createDataFrame(rows, "pot string, a string, b string, y double")
    y = np.array([r[3] for r in rows])
    x = np.column_stack([np.ones(len(rows)), [r[1] == "T" for r in rows], [r[2] == "y" for r in rows], [r[1] == "T" and r[2] == "y" for r in rows]]).astype(float)
    theta, beta, error = reml(y, x, np.array([r[0] for r in rows]))
    got = models.lmm(df, "y", ["a", "b", "a:b"], "pot").collect()
    assert [r.estimate for r in got] == pytest.approx(list(beta), abs=1e-3)
    assert got[0].var_residual == pytest.approx(error, rel=1e-2)
    assert got[0].var_subject == pytest.approx(theta * error, rel=1e-2)
    wald = {r.term: r for r in models.lmm(df, "y", ["a", "b", "a:b"], "pot", table="wald").collect()}
    assert wald["a:b"].chisq == pytest.approx(got[3].t_value ** 2)


def test_balanced_mixed_model_is_the_anova_estimator(spark):
    rng = np.random.default_rng(9)
    data = rng.normal(size=(12, 4)) + 2 * rng.normal(size=(12, 1))
    df = spark.createDataFrame([(f"p{i}", "A", float(v)) for i, row in enumerate(data) for v in row], "pot string, a string, y double")
    got = models.lmm(df, "y", ["a"], "pot").first()
    within = data.var(axis=1, ddof=1).mean()
    between = 4 * data.mean(axis=1).var(ddof=1)
    assert got.var_residual == pytest.approx(within, rel=1e-6)
    assert got.var_subject == pytest.approx((between - within) / 4, rel=1e-6)


def test_singular_mixed_model(spark):
    df = spark.createDataFrame([(f"p{i}", "AT"[j], float((i + j) % 2 + j)) for i in range(6) for j in range(2)], "pot string, a string, y double")
    assert models.lmm(df, "y", ["a"], "pot").first().var_subject == 0.0


def test_rank_sums_without_ties_are_exact(spark):
    df = spark.createDataFrame([("g", v) for v in (1.0, 2.0, 3.0)] + [("h", v) for v in (4.0, 5.0, 6.0)] + [("i", v) for v in (1.5, 7.0)], "grp string, y double")
    got = {(r.group1, r.group2): r for r in hypothesis.pairwise_wilcox(df, "y", "grp").collect()}
    assert got["g", "h"].w == 0 and got["g", "h"].p_value == pytest.approx(0.1)
    assert got["h", "i"].w == 3 and got["h", "i"].p_value == pytest.approx(1.0)
    assert got["g", "h"].p_adj == pytest.approx(0.3)


def test_rank_sums_with_ties(spark):
    x, y = [0.0] * 6 + [1.0, 2.0], [0.0] * 2 + [1.0] * 3 + [4.0, 5.0]
    df = spark.createDataFrame([("g", v) for v in x] + [("h", v) for v in y], "grp string, y double")
    got = hypothesis.pairwise_wilcox(df, "y", "grp").first()
    u = sum((a > b) + (a == b) / 2 for a in x for b in y)
    n1, n2 = len(x), len(y)
    ties = sum(t**3 - t for t in (8, 4))
    z = (u - n1 * n2 / 2 + 0.5) / math.sqrt(n1 * n2 / 12 * (n1 + n2 + 1 - ties / ((n1 + n2) * (n1 + n2 - 1))))
    assert (got.w, got.z) == (u, pytest.approx(z)) and got.p_value == pytest.approx(math.erfc(abs(z) / math.sqrt(2)))


def test_pairwise_t(spark):
    data = {"g": [1.0, 2.0, 3.0], "h": [2.0, 4.0, 6.0, 8.0], "i": [5.0, 5.5]}
    df = spark.createDataFrame([(k, v, "z") for k, vs in data.items() for v in vs], "grp string, y double, f string")
    ss = sum(((np.array(v) - np.mean(v)) ** 2).sum() for v in data.values())
    sd = math.sqrt(ss / (9 - 3))
    for by in ([], ["f"]):
        got = {(r.group1, r.group2): r for r in hypothesis.pairwise_t(df, "y", "grp", by).collect()}
        assert got["g", "h"].t == pytest.approx((2 - 5) / (sd * math.sqrt(1 / 3 + 1 / 4))) and got["g", "h"].df == 6 and len(got) == 3


def brute_bh(p):
    m, order = len(p), np.argsort(p)
    out, low = np.empty(m), 1.0
    for rank in range(m, 0, -1):
        low = min(low, p[order[rank - 1]] * m / rank)
        out[order[rank - 1]] = low
    return out


def test_benjamini_hochberg(spark):
    rng = np.random.default_rng(3)
    p = np.concatenate([rng.random(60) ** 3, np.full(40, 1.0), np.full(20, 0.01)])
    df = spark.createDataFrame([("e", i, float(v)) for i, v in enumerate(p)] + [("e", -1, None), ("f", 0, 0.2)], "e string, id int, p double")
    want = brute_bh(p)
    for bounded in (False, True):
        got = {(r.e, r.id): r.p_adj for r in ranking.bh_adjust(df, "p", ["e"], bounded=bounded).collect()}
        assert got["e", -1] is None and got["f", 0] == pytest.approx(0.2)
        assert [got["e", i] for i in range(len(p))] == pytest.approx(list(want))
    whole = {r.id: r.p_adj for r in ranking.bh_adjust(df.where("e = 'e'"), "p").collect()}
    assert [whole[i] for i in range(len(p))] == pytest.approx(list(want))


def test_shapiro_known_values(spark):
    men = [148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236]
    rows = [("men", float(v)) for v in men] + [("seq", float(v)) for v in range(1, 11)] + [("few", 1.0), ("few", 2.0)]
    got = {r.g: r for r in hypothesis.shapiro(spark.createDataFrame(rows, "g string, x double"), "x", ["g"]).collect()}
    assert got["men"].w == pytest.approx(0.79, abs=0.005) and got["men"].p_value == pytest.approx(0.0067, abs=0.0005)
    assert got["seq"].w == pytest.approx(0.97016, abs=2e-4) and got["seq"].p_value == pytest.approx(0.8924, abs=2e-3)
    assert got["few"].w is None and got["few"].n == 2


def test_rank_sums_of_many_groups(spark):
    rng = np.random.default_rng(9)
    y, g = rng.integers(0, 500, 4000), rng.integers(0, 201, 4000)
    df = spark.createDataFrame([(float(a), f"g{b:03d}") for a, b in zip(y, g)], "y double, grp string")
    rows = hypothesis.pairwise_wilcox(df, "y", "grp").collect()
    assert len(rows) == 201 * 200 // 2
    for r in rows[::997]:
        a, b = (y[g == int(name[1:])] for name in (r.group1, r.group2))
        assert r.group1 < r.group2 and (r.n1, r.n2) == (len(a), len(b))
        assert r.w == (a[:, None] > b[None, :]).sum() + (a[:, None] == b[None, :]).sum() / 2
    assert {(r.group1, r.group2) for r in hypothesis.pairwise_wilcox(df, "y", "grp", levels=["g005", "g001"]).collect()} == {("g005", "g001")}


def test_shapiro_has_no_size_limit(spark):
    from statistics import NormalDist

    rng = np.random.default_rng(4)
    x = np.sort(np.concatenate([rng.normal(size=7000).round(3), np.full(5000, 0.25)]))  # one value fills several runs
    n = len(x)
    df = spark.createDataFrame([(float(v),) for v in rng.permutation(x)], "x double")
    got = hypothesis.shapiro(df, "x").first()
    m = np.array([NormalDist().inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    a = m / np.sqrt(m @ m)
    u = n**-0.5
    outer = np.polyval([-2.706056, 4.434685, -2.071190, -0.147981, 0.221157, a[-1]], u)
    second = np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, a[-2]], u)
    a = m / np.sqrt((m @ m - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * outer**2 - 2 * second**2))
    a[[0, 1, -2, -1]] = -outer, -second, second, outer
    assert got.n == n and not got.in_range and got.p_value is None
    assert got.w == pytest.approx((a @ x) ** 2 / ((x - x.mean()) ** 2).sum(), rel=1e-9)


def test_histogram_and_boxes(spark):
    rng = np.random.default_rng(8)
    x = np.round(rng.exponential(size=200), 2)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    want, edges = np.histogram(x, bins=9)
    got = {r.bin: r.n for r in hypothesis.histogram(df, "x").collect()}
    assert sum(got.values()) == 200 and max(got) == math.ceil(math.log2(200)) + 1 == 9
    box = summaries.box_stats(df, "x").first()
    q = np.quantile(x, [0.25, 0.5, 0.75])
    assert [box.q1, box.median, box.q3] == pytest.approx(list(q))
    inside = x[(x >= q[0] - 1.5 * (q[2] - q[0])) & (x <= q[2] + 1.5 * (q[2] - q[0]))]
    assert (box.whisker_low, box.whisker_high, box.outliers) == (inside.min(), inside.max(), 200 - len(inside))
    rough = summaries.box_stats(df, "x", exact=False).first()
    assert rough.median == pytest.approx(box.median, abs=0.05)


def test_numeric_summaries(spark):
    df = spark.createDataFrame([("A", 1.0, 2), ("A", None, 4), ("T", 5.0, 6)], "s string, x double, k int")
    got = ecology.summarise_numeric(df).first()
    assert (got.x_mean, got.k_mean, got.k_sd) == (3.0, 4.0, 2.0)
    assert values(ecology.col_means(df)) == [(3.0, 4.0)]
