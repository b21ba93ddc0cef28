"""Inputs that once gave wrong answers."""

from decimal import Decimal

import pytest
from conftest import values

from thallus import sources
from thallus.operators import ecology, models, ranking, relational


def test_equal_p_values_share_their_adjusted_value(spark):
    rows = spark.createDataFrame([(p,) for p in (0.01, 0.01, 0.01, 0.5, None)], "p_value double")
    got = sorted(r["p_adj"] for r in ranking.bh_adjust(rows).collect() if r["p_adj"] is not None)
    assert [round(v, 6) for v in got] == [0.013333, 0.013333, 0.013333, 0.5]


def test_rarefy_draws_nothing_from_zero_counts(spark):
    counts = spark.createDataFrame([("s", "f1", 10), ("s", "f2", 0)], "sample string, feature string, n long")
    assert [tuple(r) for r in ecology.rarefy(counts, 5).collect()] == [("s", "f1", 5)]


def test_decimals_are_numeric(spark):
    rows = spark.createDataFrame([(Decimal("1.5"),), (Decimal("2.5"),)], "d decimal(10,2)")
    assert float(ecology.col_means(rows).first()["d"]) == 2.0


def test_words_are_not_patterns(spark):
    rows = spark.createDataFrame([("gene 28S (LSU)",), ("gene 28S LSU",), ("x28S (LSU)",)], "t string")
    assert [r["t"] for r in relational.filter_reference(rows, "t", ["28S (LSU)"], ["none"]).collect()] == ["gene 28S (LSU)"]


def test_product_of_two_covariates(spark):
    rows = [(float(a), float(b), 1.0 + 2 * a + 3 * b + 4 * a * b) for a in range(4) for b in range(5)]
    df = spark.createDataFrame(rows, "a double, b double, y double")
    got = {r.coefficient: r.estimate for r in models.lm(df, "y", ["a", "b", "a:b"]).collect()}
    assert got == pytest.approx({"(Intercept)": 1.0, "a": 2.0, "b": 3.0, "a:b": 4.0})
    assert max(abs(r.residual) for r in models.residuals(df, "y", ["a", "b", "a:b"]).collect()) < 1e-9


def test_unlisted_levels_are_missing(spark):
    rows = [("A", 1.0), ("A", 1.2), ("T", 2.0), ("T", 2.4), ("X", 100.0), ("X", 101.0)]
    df = spark.createDataFrame(rows, "species string, y double").withColumn("pot", relational.F.monotonically_increasing_id().cast("string"))
    levels = {"species": ["A", "T"]}
    got = {r.coefficient: r.estimate for r in models.lm(df, "y", ["species"], levels=levels).collect()}
    assert got == pytest.approx({"(Intercept)": 1.1, "species[T]": 1.1})
    assert models.residuals(df, "y", ["species"], levels=levels).count() == 4
    mixed = {r.coefficient: r.estimate for r in models.lmm(df, "y", ["species"], "pot", levels=levels).collect()}
    assert mixed["(Intercept)"] == pytest.approx(1.1)


def test_mixed_model_with_a_large_mean(spark):
    rows = [(f"p{p}", "AT"[p % 2], float((p * 7 % 5) + 0.3 * k + 0.7 * (p * k % 3))) for p in range(12) for k in range(3)]
    df = spark.createDataFrame(rows, "pot string, a string, y double")
    near = models.lmm(df, "y", ["a"], "pot").collect()
    far = models.lmm(df.withColumn("y", relational.F.col("y") + 1e8), "y", ["a"], "pot").collect()
    assert near[0].var_subject > 0
    assert far[0].estimate - 1e8 == pytest.approx(near[0].estimate, abs=1e-5)
    assert [far[0].var_subject, far[0].var_residual, far[1].estimate] == pytest.approx([near[0].var_subject, near[0].var_residual, near[1].estimate], rel=1e-4)


def test_two_feature_tables_under_one_path(spark, tmp_path):
    (tmp_path / "lsu.tsv").write_text("#OTU ID\ta\tb\nf1\t1\t0\n")
    (tmp_path / "its.tsv").write_text("#OTU ID\tc\td\nf2\t0\t5\nf3\t7\t0\n")
    assert values(sources.read_feature_table(spark, str(tmp_path))) == [("a", "f1", 1), ("c", "f3", 7), ("d", "f2", 5)]
    (tmp_path / "its.tsv").write_text("#OTU ID\tc\n#OTU ID\td\nf2\t5\n")
    with pytest.raises(Exception, match="more than one header"):
        sources.read_feature_table(spark, str(tmp_path)).collect()


def test_missing_and_malformed_cells(spark, tmp_path):
    path = tmp_path / "m.tsv"
    path.write_text("name\tvalue\nx\t1.5\nNA\tNA\n\t2\ny\t\n")
    assert values(sources.read_tsv(spark, str(path), "name string, value double")) == [("", 2.0), ("x", 1.5), ("y", None), (None, None)]
    path.write_text("name\tvalue\nx\t1,5\n")
    with pytest.raises(Exception, match="value is not double: 1,5"):
        sources.read_tsv(spark, str(path), "name string, value double").collect()
    assert sources.read_tsv(spark, str(path), "name string, value double", strict=False).first()["value"] is None


def test_absent_guild_is_zero(spark):
    df = spark.createDataFrame([("s1", "E", 0.4), ("s1", "O", 0.6), ("s2", "O", 1.0)], "sample string, guild string, abundance double")
    assert values(relational.pivot_unique(df, ["sample"], "guild", "abundance", ["E", "O"], fill=0.0)) == [("s1", 0.4, 0.6), ("s2", 0.0, 1.0)]


def test_profile_lists_features_without_control_samples(spark):
    rel = spark.createDataFrame([("c1", "f1", 1.0), ("s1", "f2", 1.0)], "sample string, feature string, rel double")
    controls = spark.createDataFrame([("c1", "A", "7")], "sample string, species string, time string")
    tax = spark.createDataFrame([("f1", "g1"), ("f2", "g2")], "feature string, genus string")
    got = values(ecology.group_profile(rel, controls, tax, ["A_7"]), "feature", "mean_A_7", "count_A_7", "global_mean", "genus")
    assert got == [("f1", 1.0, 1, 1.0, "g1"), ("f2", 0.0, 0, 0.0, "g2")]
