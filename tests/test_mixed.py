"""Random intercepts: levels as data, covariates of any size."""

import pytest
from pyspark.sql import functions as F

from thallus.operators import models


def made(spark, n=240):
    rows = [(f"p{i % 40}", "AT"[i // 40 % 2], float(i % 17) + 0.25 * (i % 3), 1.0 + 2 * (i % 17) + 3 * (i % 2) + ((i % 40) * 7 % 11) * 0.5 + (i * 13 % 7) * 0.3) for i in range(n)]
    return spark.createDataFrame(rows, "pot string, a string, x double, y double")


def test_a_covariate_with_a_large_mean(spark):
    df = made(spark)
    near = {r.coefficient: r for r in models.lmm(df, "y", ["a", "x", "a:x"], "pot").collect()}
    far = {r.coefficient: r for r in models.lmm(df.withColumn("x", F.col("x") + 1e8), "y", ["a", "x", "a:x"], "pot").collect()}
    assert set(near) == set(far) == {"(Intercept)", "a[T]", "x", "a[T]:x"}
    for name in ("x", "a[T]:x"):
        assert far[name].estimate == pytest.approx(near[name].estimate, rel=1e-6)
        assert far[name].std_error == pytest.approx(near[name].std_error, rel=1e-6)
    assert far["x"].var_residual == pytest.approx(near["x"].var_residual, rel=1e-6)
    # the other coefficients are those of the given columns
    assert far["(Intercept)"].estimate == pytest.approx(near["(Intercept)"].estimate - 1e8 * near["x"].estimate, rel=1e-6)
    wald = {r.term: r.chisq for r in models.lmm(df.withColumn("x", F.col("x") + 1e6), "y", ["a", "x", "a:x"], "pot", table="wald").collect()}
    plain = {r.term: r.chisq for r in models.lmm(df, "y", ["a", "x", "a:x"], "pot", table="wald").collect()}
    assert wald == pytest.approx(plain, rel=1e-5)


def test_more_levels_than_a_plan_would_hold(spark):
    rows = [(f"p{i % 97}", f"l{i % 301:03d}", float(i % 301) + (i * 7 % 13) * 0.1) for i in range(1806)]
    df = spark.createDataFrame(rows, "pot string, g string, y double")
    got = {r.coefficient: r.estimate for r in models.lmm(df, "y", ["g"], "pot").collect()}
    assert len(got) == 301
    assert got["g[l300]"] == pytest.approx(300, abs=2) and got["g[l005]"] == pytest.approx(5, abs=2)


def test_given_order_of_levels_and_groups(spark):
    df = made(spark).withColumn("half", F.when(F.col("x") < 8, "low").otherwise("high"))
    got = models.lmm(df, "y", ["a"], "pot", by=["half"], levels={"a": ["T", "A"]}).collect()
    assert sorted((r.half, r.coefficient) for r in got) == [("high", "(Intercept)"), ("high", "a[A]"), ("low", "(Intercept)"), ("low", "a[A]")]
