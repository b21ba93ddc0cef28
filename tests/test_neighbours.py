"""Range joins, nearest samples, linkage and quantiles against brute force."""

import random
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from thallus.functions.numeric import normal_quantile
from thallus.operators import distances, ranking


@pytest.fixture(scope="module")
def table(spark):
    draw = random.Random(11)
    rows = []
    for s in range(30):
        for f in draw.sample(range(25), draw.choice([1, 3, 6, 12])):
            rows.append((f"s{s:02d}", f"f{f if draw.random() < 0.7 else 0}", draw.choice([1, 2, 5, 40])))
    rows += [("t1", "only", 3), ("t2", "only", 3), ("t3", "f0", 0)]
    counts = {}
    for s, f, n in rows:
        counts[s, f] = counts.get((s, f), 0) + n
    cells = [(s, f, n) for (s, f), n in counts.items()]
    return cells, spark.createDataFrame(cells, "sample string, feature string, n long")


def all_distances(cells):
    by = {}
    for s, f, n in cells:
        if n:
            by.setdefault(s, {})[f] = n
    out = {}
    for a in sorted(by):
        for b in sorted(by):
            if a < b:
                shared = sum(min(n, by[b].get(f, 0)) for f, n in by[a].items())
                if shared:
                    out[a, b] = 1 - 2 * shared / (sum(by[a].values()) + sum(by[b].values()))
    return out


@pytest.mark.parametrize("max_d", [0.0, 0.3, 0.8])
def test_range_join_finds_every_near_pair(table, max_d):
    cells, df = table
    got = {(r.s1, r.s2): r.d for r in distances.bray_curtis(df, max_d=max_d).collect()}
    assert got == pytest.approx({k: d for k, d in all_distances(cells).items() if d <= max_d})


def test_nearest_samples_of_each(table):
    cells, df = table
    near = {}
    for (a, b), d in all_distances(cells).items():
        near.setdefault(a, []).append((d, b))
        near.setdefault(b, []).append((d, a))
    got = {}
    for r in distances.nearest_samples(df, 4, rings=(0.4, 0.8)).collect():
        got.setdefault(r.sample, []).append((r.rank, r.d, r.other))
    assert set(got) == set(near)
    for s, rows in got.items():
        want = sorted(near[s])[:4]
        assert [(d, o) for _, d, o in sorted(rows)] == [(pytest.approx(d), o) for d, o in want]


def linkage(d):
    clusters, heights = {i: [i] for i in range(len(d))}, []
    while len(clusters) > 1:
        h, a, b = min((max(d[i, j] for i in clusters[a] for j in clusters[b]), a, b) for a in clusters for b in clusters if a < b)
        clusters[a] += clusters.pop(b)
        heights.append((h, {k: sorted(v) for k, v in clusters.items()}))
    return heights


def test_clusters_equal_step_by_step_linkage(spark):
    x = np.random.default_rng(3).random((14, 4))
    rows = [(f"t{i:02d}", f"s{j}", float(x[i, j])) for i in range(14) for j in range(4)]
    df = spark.createDataFrame(rows, "taxon string, sample string, scaled double")
    want = linkage(np.linalg.norm(x[:, None] - x[None], axis=2))
    merges = [m for table in distances.complete_linkage(distances.feature_distance(df)) for m in table.collect()]
    assert sorted(m.height for m in merges) == pytest.approx([h for h, _ in want])
    got = {}
    for r in distances.feature_clusters(df, 4).collect():
        got.setdefault(r.cluster, []).append(int(r.taxon[1:]))
    assert sorted(map(sorted, got.values())) == sorted(want[-4][1].values())


def test_normal_quantile_is_exact(spark):
    p = [1e-300, 1e-20, 1e-9, 0.001, 0.0749, 0.0751, 0.3, 0.5, 0.62, 0.925, 0.9251, 0.999, 1 - 1e-12]
    got = spark.createDataFrame([(v,) for v in p], "p double").select("p", normal_quantile(F.col("p")).alias("z")).collect()
    for r in got:
        assert r.z == pytest.approx(NormalDist().inv_cdf(r.p), rel=1e-13, abs=1e-15)


def test_quantiles_interpolate(spark):
    draw = random.Random(2)
    rows = [(g, draw.choice([1.0, 2.5, 7.0, draw.random()])) for g in "ab" for _ in range(37 if g == "a" else 4)]
    wanted = {"low": 0.01, "mid": 0.5, "high": 0.875, "top": 1.0}
    got = {r.g: r for r in ranking.quantiles(spark.createDataFrame(rows, "g string, v double"), "v", wanted, ["g"]).collect()}
    for g in "ab":
        values = [v for k, v in rows if k == g]
        assert [got[g][c] for c in wanted] == pytest.approx([np.quantile(values, p) for p in wanted.values()])


def test_pairs_are_not_rows_before_their_totals_are_known(table, monkeypatch):
    cells, df = table
    monkeypatch.setattr(distances, "pair_on", None)  # one row per pair and feature
    for hot in (2, 5, 2048):
        got = {(r.s1, r.s2): r.d for r in distances.bray_curtis(df, hot=hot).collect()}
        assert got == pytest.approx(all_distances(cells))


def test_pair_sums_of_repeated_cells_nulls_and_long_lists(spark):
    draw = random.Random(5)
    cells = [(draw.choice(["a", "b", "c", "d", None]), draw.choice(["x", "y", None]), float(draw.choice([1, 2, 3]))) for _ in range(60)]
    want = {}
    for a, x, v in cells:
        for b, y, w in cells:
            if a and b and a < b and x and x == y:
                least, product = want.get((a, b), (0, 0))
                want[a, b] = least + min(v, w), product + v * w
    df = spark.createDataFrame(cells, "id string, dim string, v double")
    sizes = spark.createDataFrame([(c, float(i)) for i, c in enumerate("abcd")], "id string, size double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)  # an id's rows come in several batches
    try:
        for at, combine in enumerate(["least", "product"]):
            rows = distances.pair_sums(df, combine, sizes=sizes).collect()
            assert {(r.s1, r.s2): r.total for r in rows} == {k: pytest.approx(v[at]) for k, v in want.items()}
            assert all("abcd"[int(r.x)] == r.s1 and "abcd"[int(r.y)] == r.s2 for r in rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_long_prefixes_are_not_joined_cell_by_cell(spark, monkeypatch):
    draw = random.Random(7)
    counts = {(f"s{s:02d}", f"f{f}"): draw.choice([1, 2, 3]) for s in range(24) for f in draw.sample(range(60), 20)}
    cells = [(s, f, n) for (s, f), n in counts.items()]
    df = spark.createDataFrame(cells, "sample string, feature string, n long")
    want = all_distances(cells)
    monkeypatch.setattr(distances, "_near", None)  # a row per candidate pair and cell
    got = {(r.s1, r.s2): r.d for r in distances.bray_curtis(df, max_d=0.85).collect()}
    assert got and got == pytest.approx({k: d for k, d in want.items() if d <= 0.85})
    near = {}
    for (a, b), d in want.items():
        near.setdefault(a, []).append((d, b))
        near.setdefault(b, []).append((d, a))
    rows = {}
    for r in distances.nearest_samples(df, 3).collect():
        rows.setdefault(r.sample, []).append((r.rank, r.other))
    assert {s: [o for _, o in sorted(v)] for s, v in rows.items()} == {s: [o for _, o in sorted(v)[:3]] for s, v in near.items()}


def test_short_prefixes_are_joined(spark):
    cells = [(f"s{s:02d}", f"f{f}", n) for s in range(20) for f, n in [(s // 2, 30), ("all", 3), ("most" if s else "rare", 1)]]
    df = spark.createDataFrame([(s, str(f), n) for s, f, n in cells], "sample string, feature string, n long")
    ranked = distances._ranked_cells(df, "n")
    assert distances._prefix_pays(ranked, 0.2) and not distances._prefix_pays(ranked, 0.99)
    got = {(r.s1, r.s2): r.d for r in distances.bray_curtis(df, max_d=0.2).collect()}
    assert got == pytest.approx({k: d for k, d in all_distances(cells).items() if d <= 0.2}) and len(got) == 10


def test_feature_distance_reads_its_profiles_once(spark):
    rows = [("a", "s1", 1.0), ("a", "s2", 8.0), ("b", "s1", 8.0), ("c", "s3", 27.0)]
    scaled = spark.createDataFrame(rows, "taxon string, sample string, v double").withColumn("scaled", F.cbrt("v"))
    made = distances.feature_distance(scaled)
    assert "cbrt" not in made._jdf.queryExecution().optimizedPlan().toString().lower()
    got = {(r.s1, r.s2): round(r.d**2, 9) for r in made.collect()}
    assert got == {("a", "b"): 5.0, ("a", "c"): 14.0, ("b", "c"): 13.0}


def test_every_pair_of_samples_has_its_distance(table, spark, monkeypatch, tmp_path):
    cells, df = table
    df = df.unionByName(spark.createDataFrame([(None, "f0", 2), ("t1", None, 5)], df.schema))
    sizes = {"t1": 5}
    for s, _, n in cells:
        sizes[s] = sizes.get(s, 0) + n
    shared, names = all_distances(cells), sorted({c[0] for c in cells})
    old = {s: sum(n for t, _, n in cells if t == s) for s in names}
    want = {}
    for a in names:
        for b in names:
            if a < b:  # a read without a feature counts in its sample
                want[a, b] = 1 - (1 - shared[a, b]) * (old[a] + old[b]) / (sizes[a] + sizes[b]) if (a, b) in shared else 1.0
    for edge, hot in ((256, 2048), (5, 2048), (4, 3)):
        monkeypatch.setattr(distances, "IDS_PER_BLOCK", edge)
        rows = distances.bray_curtis(df, complete=True, hot=hot).collect()
        assert len(rows) == len(want) and {(r.s1, r.s2): r.d for r in rows} == pytest.approx(want)
    assert distances.all_pairs(df, "sample").count() == len(want)  # a missing id has no pairs, in blocks or not
    assert distances.bray_curtis(df.where("false"), complete=True).count() == 0


def test_registered_distances_list_samples_that_share_nothing(spark, tmp_path):
    from thallus.catalog import QUERIES

    rows = [(1, 1, "F"), (1, 2, "F"), (2, 1, "O"), (3, 3, "F")]  # supplier, part, status
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long, l_linestatus string").write.parquet(str(tmp_path / "lineitem.parquet"))
    got = {(r.s1, r.s2): r.d for r in QUERIES["bray_curtis"](spark, str(tmp_path)).collect()}
    assert got == {("1_F", "2_O"): pytest.approx(1 / 3, abs=1e-6), ("1_F", "3_F"): 1.0, ("2_O", "3_F"): 1.0}
