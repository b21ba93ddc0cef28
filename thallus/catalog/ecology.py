"""Depth, diversity, distances, group summaries and contrasts."""

from pyspark.sql import functions as F

from ..functions import classes
from ..operators import differential, distances, ecology, ordination, relational, summaries, taxonomy
from ..plans import analyses
from ..runtime import durable
from .registry import query
from .tables import DEPTH, SEED, SPECIES, TIMES

LEVELS = {"species": SPECIES, "time": TIMES}
# (treatment x taxon) grid of means over the observed samples, zeros included
_MEANS = """SELECT g.time, g.species, k.guild, coalesce(s.total, 0) / g.n AS mean FROM
    (SELECT time, species, count(*) AS n FROM observed GROUP BY 1, 2) g CROSS JOIN (SELECT DISTINCT guild FROM guilds JOIN observed USING (sample)) k
    LEFT JOIN (SELECT time, species, guild, sum(abundance) AS total FROM guilds JOIN observed USING (sample) GROUP BY 1, 2, 3) s
    ON s.time = g.time AND s.species = g.species AND s.guild = k.guild"""


@query("guild_share_by_group", _MEANS, doubles="mean")
def guild_share_by_group(t):
    """Flagship: import, annotate, rarefy, relativize, guild shares, treatment means."""
    return analyses.guild_means(t.community)


# -- depth, rarefaction, diversity -------------------------------------------------

@query("seq_depth", "SELECT sample, CAST(sum(n) AS BIGINT) AS depth FROM counts GROUP BY 1")
def _(t):
    return ecology.seq_depth(t.counts)


@query("rarefy", "SELECT sample, feature, n FROM rare")
def _(t):
    return ecology.rarefy(t.fungal, DEPTH, SEED)


_CURVE_TERM = """CASE WHEN depth - n >= size THEN 1 - exp(lgamma(CAST(depth - n + 1 AS DOUBLE)) + lgamma(CAST(depth - size + 1 AS DOUBLE))
    - lgamma(CAST(depth - n - size + 1 AS DOUBLE)) - lgamma(CAST(depth + 1 AS DOUBLE))) ELSE 1 END"""


@query("rarefaction_curve", f"""WITH {{fixtures}}, depths AS (SELECT sample, CAST(sum(n) AS BIGINT) AS depth FROM fungal GROUP BY 1),
    sizes AS (SELECT sample, depth, unnest(list_distinct(list_append(generate_series(1, depth, 100), depth))) AS size FROM depths)
    SELECT sample, size, sum({_CURVE_TERM}) AS richness FROM fungal JOIN sizes USING (sample) GROUP BY 1, 2""", places=5, doubles="richness")
def _(t):
    return ecology.rarefaction_curve(t.fungal)


@query("relativize", "SELECT sample, feature, n, rel FROM rel", doubles="rel")
def _(t):
    return ecology.relativize(t.rare)


@query("alpha_diversity", """SELECT sample, -sum(rel * ln(rel)) AS shannon, 1 - sum(rel * rel) AS simpson, 1 / sum(rel * rel) AS inv_simpson, count(*) AS richness FROM rel GROUP BY 1""", doubles="shannon simpson inv_simpson")
def _(t):
    return ecology.alpha_diversity(t.rare)


_BRAY = """SELECT a.sample AS s1, b.sample AS s2, 1 - 2 * sum(least(a.n, b.n)) / (any_value(x.total) + any_value(y.total)) AS d FROM counts a
    JOIN counts b ON a.feature = b.feature AND a.sample < b.sample
    JOIN (SELECT sample, CAST(sum(n) AS DOUBLE) AS total FROM counts GROUP BY 1) x ON x.sample = a.sample
    JOIN (SELECT sample, CAST(sum(n) AS DOUBLE) AS total FROM counts GROUP BY 1) y ON y.sample = b.sample GROUP BY 1, 2"""


# all pairs of samples: those that share no feature are at distance 1
_BRAY_ALL = f"""WITH {{fixtures}}, near AS ({_BRAY}), ids AS (SELECT DISTINCT sample FROM counts)
    SELECT x.sample AS s1, y.sample AS s2, coalesce(near.d, 1) AS d FROM ids x JOIN ids y ON x.sample < y.sample
    LEFT JOIN near ON near.s1 = x.sample AND near.s2 = y.sample /* FROM counts */"""


@query("bray_curtis", _BRAY_ALL, doubles="d")
def _(t):
    return distances.bray_curtis(t.counts, complete=True)


@query("bray_curtis_near", f"SELECT s1, s2, d FROM ({_BRAY}) WHERE d <= 0.85 /* FROM counts */", doubles="d")
def _(t):
    return distances.bray_curtis(t.counts, max_d=0.85)


@query("nearest_samples", f"""WITH {{fixtures}}, p AS ({_BRAY}), b AS (SELECT s1 AS sample, s2 AS other, d FROM p UNION ALL SELECT s2, s1, d FROM p)
    SELECT sample, other, d, CAST(row_number() OVER (PARTITION BY sample ORDER BY d, other) AS INTEGER) AS rank FROM b QUALIFY rank <= 3 /* FROM counts */""", doubles="d")
def _(t):
    return distances.nearest_samples(t.counts, 3)


@query("autotransform", """WITH {fixtures}, top AS (SELECT max(n) AS m FROM genera),
    v AS (SELECT sample, taxon, CASE WHEN m > 50 THEN sqrt(n) ELSE CAST(n AS DOUBLE) END AS v, m FROM genera, top),
    s AS (SELECT *, v / max(v) OVER (PARTITION BY taxon) AS s FROM v)
    SELECT sample, taxon AS feature, CASE WHEN m > 9 THEN s / sum(s) OVER (PARTITION BY sample) ELSE v END AS value FROM s""", doubles="value")
def _(t):
    return ecology.wisconsin_autotransform(t.genera.withColumnRenamed("taxon", "feature"))


# paths of up to four steps: two squarings; what shares a feature keeps its distance
_NEAR = _BRAY.replace("counts", "yearly")


@query("stepacross", f"""WITH {{fixtures}}, near AS ({_NEAR}), ids AS (SELECT DISTINCT sample FROM yearly),
    e1 AS (SELECT s1 AS a, s2 AS b, d FROM near UNION ALL SELECT s2, s1, d FROM near),
    p2 AS (SELECT a, b, min(d) AS d FROM (SELECT a, b, d FROM e1 WHERE a < b UNION ALL SELECT x.a, y.b, min(x.d + y.d) FROM e1 x JOIN e1 y ON x.b = y.a WHERE x.a < y.b GROUP BY 1, 2) GROUP BY 1, 2),
    e2 AS (SELECT a, b, d FROM p2 UNION ALL SELECT b, a, d FROM p2),
    far AS (SELECT x.sample AS s1, y.sample AS s2 FROM ids x JOIN ids y ON x.sample < y.sample ANTI JOIN near ON near.s1 = x.sample AND near.s2 = y.sample),
    p4 AS (SELECT s1, s2, min(x.d + y.d) AS d FROM far JOIN e2 x ON x.a = s1 JOIN e2 y ON y.a = x.b AND y.b = s2 GROUP BY 1, 2)
    SELECT s1, s2, d FROM near UNION ALL SELECT s1, s2, least(p4.d, p2.d) FROM far LEFT JOIN p4 USING (s1, s2) LEFT JOIN p2 ON p2.a = s1 AND p2.b = s2 /* FROM yearly */""", doubles="d")
def _(t):
    return ordination.step_across(distances.bray_curtis(t.yearly), t.yearly)


@query("pcoa")
def _(t):
    near = distances.bray_curtis(ecology.wisconsin_autotransform(t.rare), "value")
    return ordination.pcoa(near, t.rare, 3)


@query("ordination")
def _(t):
    return analyses.ordination(t.community)


_SCALED = """ranges AS (SELECT taxon, CASE WHEN count(*) < (SELECT count(DISTINCT sample) FROM counts) THEN least(min(n), 0) ELSE min(n) END AS lo, max(n) AS hi FROM genera GROUP BY 1),
    scaled AS (SELECT sample, taxon, n, CAST(n - lo AS DOUBLE) / nullif(hi - lo, 0) AS scaled FROM genera JOIN ranges USING (taxon))"""


@query("minmax_scale", f"WITH {{fixtures}}, {_SCALED} SELECT taxon, sample, n, scaled FROM scaled /* FROM genera FROM counts */", doubles="scaled")
def _(t):
    return ecology.minmax_scale(t.genera, "taxon", "n", t.counts)


_EUCLID = f"""WITH {{fixtures}}, {_SCALED}, taxa AS (SELECT DISTINCT taxon FROM scaled WHERE scaled IS NOT NULL),
    grid AS (SELECT t.taxon, s.sample, coalesce(v.scaled, 0) AS v FROM taxa t CROSS JOIN (SELECT DISTINCT sample FROM counts) s LEFT JOIN scaled v ON v.taxon = t.taxon AND v.sample = s.sample)
    SELECT a.taxon AS s1, b.taxon AS s2, sqrt(sum((a.v - b.v) * (a.v - b.v))) AS d FROM grid a JOIN grid b ON a.sample = b.sample AND a.taxon < b.taxon GROUP BY 1, 2"""


@query("euclid_features", _EUCLID, doubles="d")
def _(t):
    return distances.feature_distance(ecology.minmax_scale(t.genera, "taxon", "n", t.counts))


@query("pcoa_distances", _EUCLID, doubles="d")
def _(t):
    """All axes of a Euclidean distance table rebuild it."""
    scaled = durable(ecology.minmax_scale(t.genera, "taxon", "n", t.counts).where("scaled IS NOT NULL"))
    axes = ordination.pcoa(distances.feature_distance(scaled), scaled, k=16, ident="taxon")
    one, two = (axes.select(F.col("taxon").alias(s), "axis", F.col("score").alias(f"x{s}")) for s in ("s1", "s2"))
    return one.join(two, "axis").where("s1 < s2").groupBy("s1", "s2").agg(F.sqrt(F.sum((F.col("xs1") - F.col("xs2")) ** 2)).alias("d"))


@query("feature_clusters")
def _(t):
    species = taxonomy.rollup_rank(t.counts, t.tax, "species")
    return distances.feature_clusters(ecology.minmax_scale(species, "taxon", "n", t.counts), 6)


# -- roll-ups and group summaries --------------------------------------------------

@query("taxon_rollup", "SELECT sample, coalesce(family, 'Unassigned') AS taxon, CAST(sum(n) AS BIGINT) AS n FROM rare LEFT JOIN tax USING (feature) GROUP BY 1, 2")
def _(t):
    return taxonomy.rollup_rank(t.rare, t.tax, "family")


@query("guild_sum", "SELECT sample, guild, abundance FROM guilds", doubles="abundance")
def _(t):
    return t.guilds


@query("group_mean", _MEANS, doubles="mean")
def _(t):
    return ecology.group_mean(t.guilds, t.observed, ["time", "species"], "guild", "abundance")


_ZERO_MOMENTS = """SELECT g.species, k.taxon, coalesce(s.total, 0) / g.n AS mean,
    sqrt((coalesce(s.squares, 0) - coalesce(s.total, 0) * coalesce(s.total, 0) / g.n) / nullif(g.n - 1, 0)) AS sd, coalesce(s.k, 0) AS occurrences FROM
    (SELECT species, count(*) AS n FROM eligible GROUP BY 1) g CROSS JOIN (SELECT DISTINCT taxon FROM genera JOIN eligible USING (sample)) k
    LEFT JOIN (SELECT species, taxon, CAST(sum(n) AS DOUBLE) AS total, CAST(sum(n * n) AS DOUBLE) AS squares, count(*) AS k FROM genera JOIN eligible USING (sample) GROUP BY 1, 2) s
    ON s.species = g.species AND s.taxon = k.taxon"""


@query("group_mean_sd", _ZERO_MOMENTS, doubles="mean sd")
def _(t):
    return ecology.group_mean_sd(t.genera, relational.eligible_samples(t.samples), ["species"], "taxon", "n")


@query("occurrence_counts", """SELECT g.time, g.species, k.feature, coalesce(s.k, 0) AS occurrences FROM
    (SELECT DISTINCT time, species FROM eligible) g CROSS JOIN (SELECT DISTINCT feature FROM counts JOIN eligible USING (sample)) k
    LEFT JOIN (SELECT time, species, feature, count(*) AS k FROM counts JOIN eligible USING (sample) GROUP BY 1, 2, 3) s
    ON s.time = g.time AND s.species = g.species AND s.feature = k.feature""")
def _(t):
    return ecology.occurrences(t.counts, relational.eligible_samples(t.samples), ["time", "species"], "feature")


_CELLS = "SELECT feature, time, species, count(*) AS k FROM counts JOIN eligible USING (sample) GROUP BY 1, 2, 3"


@query("marginal_totals", f"SELECT feature, time, species, CAST(sum(k) AS BIGINT) AS k FROM ({_CELLS}) GROUP BY GROUPING SETS ((feature, time), (feature, species))")
def _(t):
    joined = t.counts.join(relational.eligible_samples(t.samples), "sample")
    cells = joined.groupBy("feature", "time", "species").agg(F.count(F.lit(1)).alias("k"))
    return ecology.margins(cells, "feature", [["time"], ["species"]], "k")


def _contrast(rank: str, min_n: int, strict: bool) -> str:
    enough = ">" if strict else ">="
    time = f"CASE WHEN \"June20\" = 0 AND \"Jan21\" >= {min_n} THEN 'Jan21' WHEN \"June20\" {enough} {min_n} AND \"Jan21\" = 0 THEN 'June20' END"
    species = f"CASE WHEN \"A\" = 0 AND \"T\" >= {min_n} THEN 'T' WHEN \"A\" {enough} {min_n} AND \"T\" = 0 THEN 'A' END"
    return f"""WITH {{fixtures}}, wide AS (SELECT taxon, count(*) FILTER (time = 'June20') AS "June20", count(*) FILTER (time = 'Jan21') AS "Jan21",
        count(*) FILTER (species = 'A') AS "A", count(*) FILTER (species = 'T') AS "T"
        FROM (SELECT sample, {rank} AS taxon FROM counts LEFT JOIN tax USING (feature) GROUP BY 1, 2) JOIN eligible USING (sample) GROUP BY 1),
        tagged AS (SELECT *, {time} AS time_filter, {species} AS species_filter FROM wide)
        SELECT *, CASE WHEN time_filter IS NOT NULL AND species_filter IS NOT NULL THEN 'TimeSpecies' WHEN time_filter IS NOT NULL THEN 'Time'
        WHEN species_filter IS NOT NULL THEN 'Species' ELSE 'NonSig' END AS combined FROM tagged"""


@query("contrast_class", _contrast("feature", 5, True))
def _(t):
    as_taxa = t.counts.select("feature").distinct().withColumn("genus", F.col("feature"))
    return ecology.presence_contrast(t.counts, t.samples, as_taxa, "genus", 5, strict_first=True)


@query("diff_presence", _contrast("coalesce(species, 'Unassigned')", 5, False))
def _(t):
    return ecology.presence_contrast(t.counts, t.samples, t.tax, "species")


@query("prevalence_filter", """WITH {fixtures}, deep AS (SELECT * FROM counts SEMI JOIN (SELECT sample FROM counts GROUP BY 1 HAVING sum(n) >= 290) USING (sample))
    SELECT * FROM deep SEMI JOIN (SELECT feature FROM deep GROUP BY 1 HAVING count(DISTINCT sample) >= 0.14 * (SELECT count(DISTINCT sample) FROM deep)) USING (feature)""")
def _(t):
    return ecology.prevalence_filter(t.counts, 0.14, 290)


_OLS = """WITH {fixtures}, rolled AS (SELECT sample, coalesce(t.species, 'Unassigned') AS taxon, CAST(sum(n) AS BIGINT) AS n FROM rare LEFT JOIN tax t USING (feature) GROUP BY 1, 2),
    base AS (SELECT r.taxon, ln(n) AS y, CASE WHEN e.species = 'T' THEN 1.0e0 ELSE 0e0 END AS a, CASE WHEN e.time = 'Jan21' THEN 1.0e0 ELSE 0e0 END AS b FROM rolled r JOIN eligible e USING (sample)),
    kept AS (SELECT * FROM base SEMI JOIN (SELECT taxon FROM base GROUP BY 1 HAVING count(*) >= 0.02 * (SELECT count(DISTINCT sample) FROM rare SEMI JOIN eligible USING (sample))) USING (taxon)),
    m AS (SELECT taxon, count(*) AS n, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, regr_sxx(a, a) AS caa, regr_sxx(b, b) AS cbb, regr_sxy(a, b) AS cab, regr_sxy(y, a) AS cay, regr_sxy(y, b) AS cby,
      regr_sxx(y, y) AS cyy FROM kept GROUP BY 1),
    s AS (SELECT *, caa * cbb - cab * cab AS det FROM m WHERE caa * cbb - cab * cab > 1e-6 AND n > 3),
    f AS (SELECT *, (cay * cbb - cby * cab) / det AS ba, (cby * caa - cay * cab) / det AS bb FROM s),
    g AS (SELECT *, cyy - ba * cay - bb * cby AS rss FROM f)
    SELECT taxon, 'species[T]' AS coefficient, ba AS estimate, sqrt(rss / (n - 3) * cbb / det) AS std_error FROM g
    UNION ALL SELECT taxon, 'time[Jan21]', bb, sqrt(rss / (n - 3) * caa / det) FROM g"""


@query("taxon_ols", _OLS, doubles="estimate std_error")
def _(t):
    table = differential.log_counts(t.rare, relational.eligible_samples(t.samples), t.tax, ["species", "time"], "species")
    fits = differential.taxon_ols(table, ["species", "time"], LEVELS)
    full = fits.where("df > 0 and estimate is not null and std_error is not null")
    return full.where("coefficient <> '(Intercept)'").select("taxon", "coefficient", "estimate", "std_error")


@query("diff_abundance")
def _(t):
    return differential.diff_abundance(t.rare, t.samples, t.tax, rank="species", levels=LEVELS)


@query("pseudo_sensitivity")
def _(t):
    return differential.diff_sensitivity(t.rare, t.samples, t.tax, rank="species", levels=LEVELS)


@query("heatmap_table", """WITH {fixtures}, rolled AS (SELECT sample, coalesce(genus, 'Unassigned') AS taxon, sum(rel) AS v FROM rel LEFT JOIN tax USING (feature) GROUP BY 1, 2),
    picked AS (SELECT * FROM rolled WHERE taxon IN ('ring', 'bolt', 'widget', 'gizmo')),
    ranges AS (SELECT taxon, CASE WHEN count(*) < (SELECT count(DISTINCT sample) FROM rel) THEN 0 ELSE min(v) END AS lo, max(v) AS hi FROM picked GROUP BY 1),
    places AS (SELECT 'ring' AS taxon, 1 AS taxon_order UNION ALL SELECT 'bolt', 2 UNION ALL SELECT 'widget', 3 UNION ALL SELECT 'gizmo', 4),
    grid AS (SELECT o.sample, r.taxon, o.species, o.time, (coalesce(p.v, 0) - lo) / nullif(hi - lo, 0) AS abundance, taxon_order FROM observed o CROSS JOIN ranges r
      LEFT JOIN picked p ON p.sample = o.sample AND p.taxon = r.taxon JOIN places ON places.taxon = r.taxon)
    SELECT sample, taxon, species, time, concat(time, '_', species, '_', sample) AS sample_mod, abundance, taxon_order,
    CAST(dense_rank() OVER (ORDER BY CASE time WHEN 'June20' THEN 1 ELSE 2 END, species, taxon_order) AS BIGINT) AS level FROM grid""", doubles="abundance")
def _(t):
    order = t.literal([("ring", 1), ("bolt", 2), ("widget", 3), ("gizmo", 4)], "taxon string, taxon_order int")
    return analyses.heatmap(t.community, order.select("taxon"), order)


_PROFILE_GROUPS = ("A_June20", "T_June20", "A_Jan21", "T_Jan21")
_PROFILE = ", ".join(
    [f"coalesce(sum(rel) FILTER (grp = '{g}'), 0) / nullif((SELECT count(*) FROM cs WHERE grp = '{g}'), 0) AS \"mean_{g}\"" for g in _PROFILE_GROUPS]
    + [f"count(*) FILTER (grp = '{g}') AS \"count_{g}\"" for g in _PROFILE_GROUPS]
)
_PRESENT = " + ".join(f"(\"mean_{g}\" IS NOT NULL)::INT" for g in _PROFILE_GROUPS)
_TOTAL = " + ".join(f"coalesce(\"mean_{g}\", 0)" for g in _PROFILE_GROUPS)


@query("group_profile", f"""WITH {{fixtures}}, cs AS (SELECT sample, concat(species, '_', time) AS grp FROM samples SEMI JOIN rel USING (sample) WHERE stand = 'C'),
    p AS (SELECT feature, {_PROFILE} FROM rel LEFT JOIN cs USING (sample) GROUP BY 1)
    SELECT p.*, ({_TOTAL}) / nullif({_PRESENT}, 0) AS global_mean, t.genus, t.family FROM p LEFT JOIN tax t USING (feature)""", doubles="mean_A_June20 mean_T_June20 mean_A_Jan21 mean_T_Jan21 global_mean")
def _(t):
    controls = t.samples.where("stand = 'C'")
    return ecology.group_profile(t.rel, controls, t.tax.select("feature", "genus", "family"), _PROFILE_GROUPS)


# -- shares ------------------------------------------------------------------------

_MYC = """SELECT species, time, CASE WHEN am > 20 AND ecm < 20 THEN 'AM' WHEN am > 20 AND ecm > 20 THEN 'DM' WHEN am < 20 AND ecm > 20 THEN 'EM'
    WHEN am < 20 AND ecm < 20 THEN 'NM' ELSE 'Invalid' END AS class FROM meas WHERE ecm IS NOT NULL"""


def _classed(t):
    return t.meas.where("ecm is not null").withColumn("class", classes.threshold_class(F.col("am"), F.col("ecm"), 20.0))


@query("count_by_class", f"SELECT species, time, class, count(*) AS n FROM ({_MYC}) GROUP BY 1, 2, 3")
def _(t):
    return ecology.count_by(_classed(t), ["species", "time", "class"])


@query("share_in_group", f"""SELECT species, time, class, n, n / CAST(sum(n) OVER (PARTITION BY species, time) AS DOUBLE) AS share
    FROM (SELECT species, time, class, count(*) AS n FROM ({_MYC}) GROUP BY 1, 2, 3)""", doubles="share")
def _(t):
    return ecology.share_in_group(ecology.count_by(_classed(t), ["species", "time", "class"]), ["species", "time"], "n")


@query("rel_freq", f"SELECT class, n, n / CAST(sum(n) OVER () AS DOUBLE) AS rel_freq FROM (SELECT class, count(*) AS n FROM ({_MYC}) GROUP BY 1)", doubles="rel_freq")
def _(t):
    return ecology.rel_freq(ecology.count_by(_classed(t), ["class"]), "n")


@query("stacked_shares", f"""SELECT CASE time WHEN 'June20' THEN '7Months' ELSE '12Months' END AS time, species, guild, mean AS abundance, 'Sequencing' AS method FROM ({_MEANS})
    UNION ALL SELECT time, species, guild, avg(percent) / 100, 'Microscopy' FROM microscopy WHERE percent IS NOT NULL GROUP BY 1, 2, 3""", doubles="abundance")
def _(t):
    return analyses.guild_colonization(t.community, t.microscopy)


@query("table_summary", """SELECT 'sample' AS axis, sample AS id, CAST(sum(n) AS BIGINT) AS total, count(*) AS cells FROM counts GROUP BY 2
    UNION ALL SELECT 'feature', feature, CAST(sum(n) AS BIGINT), count(*) FROM counts GROUP BY 2""")
def _(t):
    return ecology.table_summary(t.counts)


@query("kept_by_step", " UNION ALL ".join(
    f"SELECT {i} AS step_no, '{name}' AS step, count(DISTINCT sample) AS samples, count(DISTINCT feature) AS features, CAST(sum(n) AS BIGINT) AS reads FROM {table}"
    for i, (name, table) in enumerate([("input", "counts"), ("fungal", "fungal"), ("rarefied", "rare")])
))
def _(t):
    return ecology.kept_by_step({"input": t.counts, "fungal": t.fungal, "rarefied": t.rare})


@query("differential_taxa")
def _(t):
    return analyses.differential_taxa(t.community, "species", levels=LEVELS)


@query("trend_line", """SELECT time, count(*) AS n, regr_slope(te, ecm) AS slope, regr_intercept(te, ecm) AS intercept, regr_r2(te, ecm) AS r2 FROM (
    SELECT sample, coalesce(max(abundance) FILTER (guild = 'Ectomycorrhizal'), 0) AS ecm, coalesce(max(abundance) FILTER (guild = 'TotalEndophyte'), 0) AS te FROM guilds GROUP BY 1)
    JOIN eligible USING (sample) WHERE species = 'T' GROUP BY 1""", doubles="slope intercept r2")
def _(t):
    wide = relational.pivot_unique(t.guilds, ["sample"], "guild", "abundance", ["Ectomycorrhizal", "TotalEndophyte"], fill=0.0)
    joined = wide.join(relational.eligible_samples(t.samples).where("species = 'T'"), "sample")
    return summaries.trend_line(joined, "Ectomycorrhizal", "TotalEndophyte", ["time"])
