"""Missing values behave as in the statistics language the analyses come from."""

from conftest import values

from pyspark.sql import functions as F

from thallus.functions import classes, numeric, text
from thallus.operators import ecology, relational


def test_missing_keys_match_each_other(spark):
    left = spark.createDataFrame([(None, 1), ("a", 2)], "k string, v int")
    right = spark.createDataFrame([(None, "none"), ("b", "bee")], "k string, w string")
    assert values(relational.null_safe_join(left, right, ["k"])) == [("a", 2, None), (None, 1, "none")]


def test_membership_is_never_missing(spark):
    df = spark.createDataFrame([("a",), (None,)], "x string")
    assert values(df.select(classes.is_in(F.col("x"), ["a"]).alias("m"))) == [(False,), (True,)]


def test_class_conditions_skip_missing_values(spark):
    df = spark.createDataFrame([(1.0, 0.0), (None, 1.0), (0.0, 0.0), (20.0, 30.0)], "a double, b double")
    assert [r[0] for r in df.select(classes.presence_class(F.col("a"), F.col("b"))).collect()] == ["AM", "Invalid", "NM", "DM"]
    assert df.select(classes.threshold_class(F.col("a"), F.col("b"), 20.0).alias("c")).collect()[3].c == "Invalid"  # equal to the cut


def test_status_puts_controls_first(spark):
    df = spark.createDataFrame([("Control1", 5.0, 5.0), ("x", None, 1.0), ("y", 0.0, 2.0)], "label string, am double, em double")
    flags = classes.status_columns(F.col("am"), F.col("em"), F.col("label"))
    rows = df.select("label", *[c.alias(n) for n, c in flags.items()]).collect()
    assert tuple(rows[0]) == ("Control1", "NM", "AMF", "EMF", "Control")
    assert tuple(rows[1]) == ("x", None, "AMF", "EMT", "NotControl")
    assert tuple(rows[2]) == ("y", "EM", "AMF", "EMT", "NotControl")


def test_pasted_missing_value_is_text(spark):
    df = spark.createDataFrame([("a", None)], "x string, y string")
    assert df.select(text.paste(F.col("x"), F.col("y"))).first()[0] == "a_NA"


def test_missing_group_is_kept_and_division_by_zero_is_missing(spark):
    df = spark.createDataFrame([(None, 0), (None, 0), ("a", 2)], "g string, n long")
    assert values(ecology.share_in_group(df, ["g"], "n")) == [("a", 2, 1.0), (None, 0, None), (None, 0, None)]


def test_strict_and_lenient_row_means(spark):
    df = spark.createDataFrame([(1.0, None), (None, None)], "a double, b double")
    cols = [F.col("a"), F.col("b")]
    assert values(df.select(numeric.row_mean(cols).alias("m"), numeric.row_mean(cols, False).alias("s"))) == [(1.0, None), (None, None)]


def test_sd_of_one_value_is_missing(spark):
    df = spark.createDataFrame([("s", "t", 1.0)], "sample string, taxon string, v double")
    samples = spark.createDataFrame([("s", "A")], "sample string, species string")
    assert values(ecology.group_mean_sd(df, samples, ["species"], "taxon", "v")) == [("A", "t", 1.0, None, 1)]


def test_incomplete_rows_go(spark):
    df = spark.createDataFrame([(1.0, "a"), (float("nan"), "b"), (None, "c"), (2.0, None)], "x double, y string")
    assert values(relational.drop_incomplete(df)) == [(1.0, "a")]


def test_repeated_pivot_cell_is_an_error(spark):
    import pytest

    df = spark.createDataFrame([("a", "x", 1), ("a", "x", 2)], "k string, c string, v int")
    with pytest.raises(Exception, match="more than one"):
        relational.pivot_unique(df, ["k"], "c", "v", ["x"]).collect()


def test_name_range_excludes_the_unassigned_group(spark):
    df = spark.createDataFrame([(t,) for t in ("Abc", "Agaricus", "Tuber", "Unassigned", "Wilcoxina", "Xylaria")], "taxon string")
    assert values(relational.keys_between(df, "taxon", "Agaricus", "Wilcoxina")) == [("Agaricus",), ("Tuber",), ("Wilcoxina",)]


def test_columns_by_pattern(spark):
    df = spark.createDataFrame([("a", 1.0, 2)], "bc1 string, bc2 double, other int")
    assert relational.cols_where(df, starts_with="bc") == ["bc1", "bc2"]
    assert relational.cols_where(df, dtype=("double", "int"), exclude=("other",)) == ["bc2"]
    assert relational.cols_where(df, between=("bc2", "other")) == ["bc2", "other"]


def test_prefix_strip_keeps_only_prefixed(spark):
    df = spark.createDataFrame([("Genus:Tuber",), ("Family:Tuberaceae",)], "taxon string")
    assert values(relational.strip_prefix(df, "taxon", "Genus:")) == [("Tuber",)]


def test_guild_classes(spark):
    df = spark.createDataFrame(
        [("Ectomycorrhizal", "Ilyonectria"), ("Endophyte", None), (None, "Ilyonectria"), ("DSE", "X"), (None, None), ("Saprotroph", "Y")], "g string, genus string"
    )
    got = [r[0] for r in df.select(classes.guild_class(F.col("g"), F.col("genus"))).collect()]
    assert got == ["Ectomycorrhizal", "TotalEndophyte", "TotalEndophyte", "TotalEndophyte", "Other", "Other"]


def test_contrast_tags(spark):
    df = spark.createDataFrame([(0, 5, 5, 0), (5, 0, 0, 4), (6, 0, 3, 3), (0, 0, 0, 0)], "June20 int, Jan21 int, A int, T int")
    labels = {"time": ("June20", "Jan21"), "species": ("A", "T")}
    loose = ecology.contrast_class(df, "June20", "Jan21", "A", "T", labels)
    assert [(r.time_filter, r.species_filter, r.combined) for r in loose.collect()] == [
        ("Jan21", "A", "TimeSpecies"), ("June20", None, "Time"), ("June20", None, "Time"), (None, None, "NonSig")
    ]
    strict = ecology.contrast_class(df, "June20", "Jan21", "A", "T", labels, strict_first=True)
    assert [r.combined for r in strict.collect()] == ["Time", "NonSig", "Time", "NonSig"]
