import math
import random

import pytest
from conftest import values

from thallus.operators import relational, sequences, spatial

FRONT, ADAPTER = sequences.FRONT_PRIMER, sequences.ADAPTER_PRIMER
PAIR = str.maketrans("ACGT", "TGCA")
END = ADAPTER[::-1].translate(PAIR)


def test_hull_of_a_square_in_any_order(spark):
    inner = [(random.Random(i).uniform(1, 9), random.Random(i + 99).uniform(1, 9)) for i in range(200)]
    points = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0), (0.0, 0.0), (5.0, 0.0)] + inner
    for seed in (0, 1):
        random.Random(seed).shuffle(points)
        hull = spatial.convex_hull(spark.createDataFrame(points, "x double, y double").repartition(5))
        assert values(hull, "vertex", "x", "y") == [(1, 0.0, 0.0), (2, 10.0, 0.0), (3, 10.0, 10.0), (4, 0.0, 10.0)]
        assert values(spatial.hull_area(hull)) == [(100.0, 0.01)]


def test_hulls_per_group(spark):
    rows = [("a", 0.0, 0.0), ("a", 2.0, 0.0), ("a", 0.0, 2.0), ("b", 1.0, 1.0), ("b", 2.0, 2.0), (None, 0.0, 0.0), (None, 4.0, 0.0), (None, 4.0, 4.0)]
    hull = spatial.convex_hull(spark.createDataFrame(rows, "g string, x double, y double"), by=["g"])
    assert values(spatial.hull_area(hull, ["g"])) == [("a", 2.0, 0.0), ("b", 0.0, 0.0), (None, 8.0, 0.0)]


def test_projection(spark):
    df = spark.createDataFrame([(-111.0, 0.0), (-111.0, 45.0), (-110.0, 0.0), (-112.0, 38.5), (-110.0, 38.5)], "lon double, lat double")
    got = [(r.x, r.y) for r in spatial.project_utm(df).collect()]
    assert got[0] == pytest.approx((500000.0, 0.0))
    # quarter of the meridian to 45 degrees is 4984944.378 m on this ellipsoid
    assert got[1] == pytest.approx((500000.0, 0.9996 * 4984944.378), abs=1e-3)
    assert got[2][0] - 500000 == pytest.approx(0.9996 * math.radians(1) * 6378137 * (1 + math.radians(1) ** 2 / 6), rel=1e-5)
    assert got[3][0] - 500000 == pytest.approx(500000 - got[4][0]) and got[3][1] == pytest.approx(got[4][1])


def test_primers(spark):
    body = "ACGT" * 200
    damaged = "T" + FRONT[1:5] + ("A" if FRONT[5] != "A" else "C") + FRONT[6:]
    broken = "".join("A" if c != "A" else "C" for c in FRONT[:3]) + FRONT[3:]
    reads = {
        "plain": "GG" + FRONT + body + END + "TT", "damaged": damaged + body + END, "broken": broken + body + END,
        "turned": (FRONT + body + END)[::-1].translate(PAIR), "tailless": FRONT + body, "short": "ACG", "none": None,
    }
    df = spark.createDataFrame([(k, v) for k, v in reads.items()], "read_id string, seq string")
    assert values(sequences.trim_primers(df)) == [(k, body) for k in ("damaged", "plain", "turned")]


def test_length_limits_are_inclusive(spark):
    df = spark.createDataFrame([("A" * n,) for n in (699, 700, 1600, 1601)], "seq string")
    assert sorted(len(r.seq) for r in sequences.length_filter(df).collect()) == [700, 1600]


def test_dereplication(spark):
    df = spark.createDataFrame([("s", "AC"), ("s", "AC"), ("t", "AC"), ("t", "GG")], "sample string, seq string")
    assert [r[2] for r in values(sequences.dereplicate(df))] == [2, 1, 1]
    reps = sequences.representatives(df).collect()
    assert {r.seq for r in reps} == {"AC", "GG"} and all(len(r.feature) == 32 for r in reps)


def test_reference_titles(spark):
    df = spark.createDataFrame([("Tuber 28S gene",), ("uncultured fungus 28S",), ("Tuber ITS",), ("Large ribosomal subunit of X",)], "title string")
    kept = relational.filter_reference(df, "title", ("LSU", "28S", "large ribosomal subunit"), ("uncultured", "unidentified", "unclassified", "unverified"))
    assert values(kept) == [("Large ribosomal subunit of X",), ("Tuber 28S gene",)]
