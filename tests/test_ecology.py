import hashlib
import math
import random

import numpy as np
import pytest
from conftest import values

from thallus.operators import distances, ecology, ordination, ranking, taxonomy


def brute_rarefy(counts, depth, seed):
    out = {}
    samples = {s for s, _, _ in counts}
    for s in samples:
        reads = [(hashlib.md5(f"{s}|{f}|{i}|{seed}".encode()).hexdigest(), f) for t, f, n in counts if t == s for i in range(1, n + 1)]
        if len(reads) < depth:
            continue
        for _, f in sorted(reads)[:depth]:
            out[s, f] = out.get((s, f), 0) + 1
    return out


@pytest.fixture(scope="module")
def community():
    rng = random.Random(5)
    rows = []
    for s in range(12):
        for f in rng.sample(range(30), 12):
            rows.append((f"s{s:02d}", f"f{f:02d}", rng.randint(1, 20)))
    # one sample holds a third of all reads
    rows.append(("s00", "hot", sum(n for *_, n in rows) // 2))
    return rows


@pytest.fixture(scope="module")
def counts(spark, community):
    return spark.createDataFrame(community, "sample string, feature string, n long").cache()


def test_rarefy_equals_brute_force(counts, community):
    got = {(r.sample, r.feature): r.n for r in ecology.rarefy(counts, 100, 67).collect()}
    assert got == brute_rarefy(community, 100, 67)


def test_rarefy_is_independent_of_partitions_and_chunks(spark, monkeypatch, counts):
    one = values(ecology.rarefy(counts, 60, 3))
    monkeypatch.setattr(ecology, "READS_PER_CHUNK", 7)
    assert values(ecology.rarefy(counts.repartition(13), 60, 3), "sample", "feature", "n") == one


def test_rarefy_of_shallow_and_deep_samples_equals_brute_force(monkeypatch, counts, community):
    depths = sorted(r.depth for r in ecology.seq_depth(counts).collect())
    monkeypatch.setattr(ecology, "READS_PER_CHUNK", depths[len(depths) // 2])
    got = {(r.sample, r.feature): r.n for r in ecology.rarefy(counts, 60, 67).collect()}
    assert got == brute_rarefy(community, 60, 67)


def test_rarefy_moves_cells_not_reads(counts):
    plan = ecology.rarefy(counts, 60, 3)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[plan.index("Window") : plan.rindex("Generate")]


def test_rarefied_totals_and_bounds(counts):
    rare = ecology.rarefy(counts, 80)
    assert {r.depth for r in ecology.seq_depth(rare).collect()} == {80}
    joined = rare.withColumnRenamed("n", "m").join(counts, ["sample", "feature"])
    assert joined.where("m > n").count() == 0 and joined.count() == rare.count()


def test_curve_ends(counts):
    curve = {(r.sample, r.size): r.richness for r in ecology.rarefaction_curve(counts, 50).collect()}
    depths = {r.sample: r.depth for r in ecology.seq_depth(counts).collect()}
    rich = {r.sample: r.richness for r in ecology.alpha_diversity(counts).collect()}
    for s, depth in depths.items():
        assert curve[s, 1] == pytest.approx(1.0, abs=1e-7)
        assert curve[s, depth] == pytest.approx(rich[s], abs=1e-7)


def test_alpha_by_hand(spark):
    df = spark.createDataFrame([("s", "a", 2), ("s", "b", 2), ("t", "a", 7)], "sample string, feature string, n long")
    got = {r.sample: r for r in ecology.alpha_diversity(df).collect()}
    assert got["s"].shannon == pytest.approx(math.log(2)) and got["s"].simpson == pytest.approx(0.5)
    assert got["s"].inv_simpson == pytest.approx(2) and got["t"].shannon == pytest.approx(0) and got["t"].richness == 1


def dense(rows):
    samples, features = sorted({r[0] for r in rows}), sorted({r[1] for r in rows})
    m = np.zeros((len(samples), len(features)))
    for s, f, n in rows:
        m[samples.index(s), features.index(f)] = n
    return samples, m


def test_bray_curtis_brute_force(spark, community, counts):
    extra = [("lonely", "only", 4)]
    rows = community + extra
    samples, m = dense(rows)
    df = counts.unionByName(spark.createDataFrame(extra, counts.schema))
    want = {
        (a, b): 1 - 2 * np.minimum(m[i], m[j]).sum() / (m[i].sum() + m[j].sum())
        for i, a in enumerate(samples) for j, b in enumerate(samples) if a < b
    }
    for hot in (distances.HOT_DIM, 3, 0):  # all dimensions rare, mixed, all in blocks
        full = {(r.s1, r.s2): r.d for r in distances.bray_curtis(df, complete=True, hot=hot).collect()}
        assert full.keys() == want.keys()
        assert all(full[k] == pytest.approx(want[k]) for k in want)
    near = distances.bray_curtis(df)
    assert near.count() == sum(1 for v in want.values() if v < 1)


def test_blocks_smaller_than_the_data(counts, monkeypatch):
    plain = values(distances.bray_curtis(counts))
    monkeypatch.setattr(distances, "IDS_PER_BLOCK", 4)
    monkeypatch.setattr(distances, "DIMS_PER_CHUNK", 5)
    blocked = values(distances.bray_curtis(counts, hot=2))
    assert [r[:2] for r in blocked] == [r[:2] for r in plain]
    assert np.allclose([r[2] for r in blocked], [r[2] for r in plain])
    assert distances.all_pairs(counts, "sample").count() == 12 * 11 // 2


def test_feature_distance_and_ordination_rebuild_each_other(spark):
    rng = np.random.default_rng(2)
    m = rng.random((7, 5))
    rows = [(f"t{i}", f"s{j}", float(m[i, j])) for i in range(7) for j in range(5)]
    df = spark.createDataFrame(rows, "taxon string, sample string, scaled double")
    pairs = distances.feature_distance(df)
    got = {(r.s1, r.s2): r.d for r in pairs.collect()}
    for i in range(7):
        for j in range(i + 1, 7):
            assert got[f"t{i}", f"t{j}"] == pytest.approx(float(np.linalg.norm(m[i] - m[j])))
    scores = ordination.pcoa(pairs, df, k=6, ident="taxon").collect()
    x = np.zeros((7, 6))
    for r in scores:
        x[int(r.taxon[1:]), r.axis - 1] = r.score
    for (a, b), d in got.items():
        assert np.linalg.norm(x[int(a[1:])] - x[int(b[1:])]) == pytest.approx(d, abs=1e-6)


def test_ordination_with_negative_eigenvalues(spark, counts, community):
    samples, m = dense(community)
    n = len(samples)
    d = np.array([[1 - 2 * np.minimum(a, b).sum() / (a.sum() + b.sum()) for b in m] for a in m])
    j = np.eye(n) - 1 / n
    lam, vec = np.linalg.eigh(-0.5 * j @ (d * d) @ j)
    top = np.argsort(lam)[::-1][:3]
    got = ordination.pcoa(distances.bray_curtis(counts), counts, 3).collect()
    for axis, at in enumerate(top, start=1):
        want = vec[:, at] * math.sqrt(lam[at])
        want = want * np.sign(want[np.abs(want).argmax()])
        mine = {r.sample: r.score for r in got if r.axis == axis}
        assert np.allclose([mine[s] for s in samples], want, atol=1e-7)


def test_step_across_is_shortest_path(spark):
    edges = [("a", "b", 0.5), ("b", "c", 0.4), ("c", "d", 0.3), ("a", "e", 0.9), ("d", "e", 0.2), ("x", "y", 0.1)]
    ids = spark.createDataFrame([(s,) for s in "abcdexyz"], "sample string")
    got = {(r.s1, r.s2): r.d for r in ordination.step_across(spark.createDataFrame(edges, "s1 string, s2 string, d double"), ids).collect()}
    nodes = "abcdexyz"
    best = {(p, q): math.inf for p in nodes for q in nodes}
    for a, b, w in edges:
        best[a, b] = best[b, a] = w
    original = dict(best)
    for k in nodes:
        for i in nodes:
            for j in nodes:
                best[i, j] = min(best[i, j], best[i, k] + best[k, j])
    for i in nodes:
        for j in nodes:
            if i < j:
                want = original[i, j] if original[i, j] < math.inf else best[i, j]
                assert (got[i, j] is None) == (want == math.inf)
                assert want == math.inf or got[i, j] == pytest.approx(want)


def test_zeros_enter_means_and_scales(spark):
    df = spark.createDataFrame([("s1", "x", 4.0), ("s2", "x", 2.0), ("s1", "y", 1.0), ("s3", "y", 1.0), ("s1", "c", 2.0), ("s2", "c", 2.0), ("s3", "c", 2.0), ("s4", "c", 2.0)], "sample string, taxon string, v double")
    samples = spark.createDataFrame([("s1", "A"), ("s2", "A"), ("s3", "T"), ("s4", "T")], "sample string, species string")
    got = {(r.species, r.taxon): (r["mean"], r.sd, r.occurrences) for r in ecology.group_mean_sd(df, samples, ["species"], "taxon", "v").collect()}
    assert got["A", "y"] == (0.5, pytest.approx(np.std([1, 0], ddof=1)), 1)
    assert got["T", "x"] == (0.0, 0.0, 0)
    assert got["A", "x"] == (3.0, pytest.approx(np.std([4, 2], ddof=1)), 2)
    scaled = {(r.sample, r.taxon): r.scaled for r in ecology.minmax_scale(df, "taxon", "v", samples).collect()}
    assert scaled["s1", "x"] == 1.0 and scaled["s2", "x"] == 0.5 and scaled["s1", "c"] is None


def test_heatmap_rows_are_complete(spark):
    df = spark.createDataFrame([("s1", "x", 4.0), ("s2", "x", 2.0), ("s3", "y", 1.0)], "sample string, taxon string, v double")
    samples = spark.createDataFrame([("s1", "A", "June20", "SA"), ("s2", "T", "Jan21", "SA"), ("s3", "A", "Jan21", "C")], "sample string, species string, time string, stand string")
    order = spark.createDataFrame([("x", 1), ("y", 2)], "taxon string, taxon_order int")
    got = values(ecology.scaled_long(df, samples, order.select("taxon"), order, "v"), "sample", "taxon", "abundance", "taxon_order")
    assert got == [("s1", "x", 1.0, 1), ("s1", "y", 0.0, 2), ("s2", "x", 0.5, 1), ("s2", "y", 0.0, 2)]


def test_prevalence(spark):
    df = spark.createDataFrame([("s1", "a", 5), ("s2", "a", 5), ("s1", "b", 5), ("s3", "c", 1)], "sample string, feature string, n long")
    assert values(ecology.prevalence_filter(df, 0.5, 2), "sample", "feature", "n") == [("s1", "a", 5), ("s1", "b", 5), ("s2", "a", 5)]
    assert values(ecology.prevalence_filter(df, 0.51), "feature") == [("a",), ("a",)]


def test_rollup_names_missing_ranks(spark):
    df = spark.createDataFrame([("s", "f1", 1), ("s", "f2", 2), ("s", "f3", 4)], "sample string, feature string, n long")
    tax = spark.createDataFrame([("f1", "G"), ("f2", None)], "feature string, genus string")
    assert values(taxonomy.rollup_rank(df, tax, "genus")) == [("s", "G", 1), ("s", "Unassigned", 6)]


def test_running_totals_with_a_hot_value(spark):
    rng = random.Random(1)
    xs = [0.0] * 400 + [rng.random() for _ in range(800)]
    df = spark.createDataFrame([("g", x) for x in xs] + [(None, 1.0)], "g string, x double")
    got = {(r.g, r.x): (r.n, r.before_n) for r in ranking.value_counts(df, "x", ["g"]).collect()}
    for x in set(xs):
        assert got["g", x] == (xs.count(x), sum(1 for y in xs if y < x))
    assert got[None, 1.0] == (1, 0)


def test_dense_index_and_levels(spark):
    df = spark.createDataFrame([(k,) for k in "cabbac"], "k string")
    assert values(ranking.dense_index(df, "k")) == [("a", 0), ("b", 1), ("c", 2)]
    assert values(ranking.level_index(df, ["k"])) == [("a", 1), ("a", 1), ("b", 2), ("b", 2), ("c", 3), ("c", 3)]


def test_clusters_split_separate_profiles(spark):
    rows = [(f"t{i}", f"s{j}", float((i < 3) == (j < 4)) + 0.01 * i) for i in range(6) for j in range(8)]
    df = spark.createDataFrame(rows, "taxon string, sample string, scaled double")
    got = dict(values(distances.feature_clusters(df, 2), "taxon", "cluster"))
    assert len({got[f"t{i}"] for i in range(3)}) == 1 and len(set(got.values())) == 2
