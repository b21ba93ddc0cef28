"""The analyses that chain several operators, over sequencing data and dated events."""

from pyspark.sql import functions as F

from ..operators import differential, ecology, hypothesis, models, ranking, relational
from ..plans import analyses
from .registry import query
from .sql import t_tail_sql
from .tables import SPECIES, TIMES

CUT = 0.001


def partial(i: str, j: str, given: tuple[str, ...]) -> str:
    """Sum of products of i and j about their means, without what ``given`` explains of them."""
    if not given:
        return f"s_{min(i, j)}{max(i, j)}"
    a, rest = given[-1], given[:-1]
    return f"({partial(i, j, rest)} - {partial(i, a, rest)} * {partial(j, a, rest)} / {partial(a, a, rest)})"


# -- classes of the sequencing data ------------------------------------------------

_CLASSES = f"""SELECT sample, pot, species, time, CASE WHEN am > {CUT} AND ecm < {CUT} THEN 'AM' WHEN am > {CUT} AND ecm > {CUT} THEN 'DM' WHEN am < {CUT} AND ecm > {CUT} THEN 'EM'
    WHEN am < {CUT} AND ecm < {CUT} THEN 'NM' ELSE 'Invalid' END AS class FROM (SELECT sample, coalesce(max(abundance) FILTER (guild = 'Arbuscular Mycorrhizal'), 0) AS am,
    coalesce(max(abundance) FILTER (guild = 'Ectomycorrhizal'), 0) AS ecm FROM guilds GROUP BY 1) JOIN eligible USING (sample)"""


@query("sequencing_class_shares", f"""SELECT species, time, class, n, n / CAST(sum(n) OVER (PARTITION BY species, time) AS DOUBLE) AS share
    FROM (SELECT species, time, class, count(*) AS n FROM ({_CLASSES}) GROUP BY 1, 2, 3)""", doubles="share")
def _(t):
    classed = analyses.guild_classes(t.community, CUT)
    return ecology.share_in_group(ecology.count_by(classed, ["species", "time", "class"]), ["species", "time"], "n")


@query("sequencing_class_transitions", f"""SELECT pot, max(class) FILTER (time = 'June20') AS "June20", max(class) FILTER (time = 'Jan21') AS "Jan21" FROM ({_CLASSES}) WHERE species = 'T' GROUP BY 1""")
def _(t):
    classed = analyses.guild_classes(t.community, CUT).where("species = 'T'")
    return relational.state_transition(classed, "pot", "time", "class", TIMES)


# -- diversity ---------------------------------------------------------------------

_RICH = "SELECT e.*, richness FROM (SELECT sample, CAST(count(*) AS DOUBLE) AS richness FROM rare GROUP BY 1) JOIN eligible e USING (sample)"


@query("richness_by_treatment", f"SELECT time, species, avg(richness) AS mean_rich, stddev_samp(richness) AS sd_rich FROM ({_RICH}) GROUP BY 1, 2", doubles="mean_rich sd_rich")
def _(t):
    joined = analyses.eligible_diversity(t.community)
    return joined.groupBy("time", "species").agg(F.avg("richness").alias("mean_rich"), F.stddev_samp("richness").alias("sd_rich"))


_TERMS = {"time": "a", "species": "b", "field_soil": "c"}


def _soil_rows() -> str:
    rows = []
    for term, c in _TERMS.items():
        others = tuple(v for v in "abc" if v != c)
        ss = f"{partial(c, 'y', others)} ** 2 / {partial(c, c, others)}"
        rows.append(f"SELECT '{term}' AS term, {ss} AS sum_sq, 1e0 AS df, ({ss}) / (rss / (n - 4)) AS f_value, n FROM f")
    rows.append("SELECT 'Residuals', rss, n - 4, NULL, n FROM f")
    return " UNION ALL ".join(rows)


_SUMS = ", ".join(f"regr_sxy({i}, {j}) AS s_{i}{j}" for i, j in ("aa", "bb", "cc", "yy", "ab", "ac", "bc", "ay", "by", "cy"))


@query("richness_field_soil", f"""WITH {{fixtures}}, r AS (SELECT richness AS y, CASE WHEN time = 'Jan21' THEN 1e0 ELSE 0e0 END AS a, CASE WHEN species = 'T' THEN 1e0 ELSE 0e0 END AS b, field_soil AS c FROM ({_RICH}) WHERE field_soil IS NOT NULL),
    m AS (SELECT CAST(count(*) AS DOUBLE) AS n, {_SUMS} FROM r), f AS (SELECT *, {partial('y', 'y', ('a', 'b', 'c'))} AS rss FROM m), g AS ({_soil_rows()})
    SELECT term, sum_sq, df, f_value, CASE WHEN f_value IS NOT NULL THEN {t_tail_sql('sqrt(f_value)', 'n - 4')} END AS p_value FROM g /* FROM rare FROM eligible */""", doubles="sum_sq df f_value p_value")
def _(t):
    return models.anova(analyses.eligible_diversity(t.community), "richness", ["time", "species", "field_soil"])


# -- tests per guild ---------------------------------------------------------------

_LONG = """SELECT k.guild, e.pot, e.species, e.time, concat(e.species, '_', e.time) AS grp, round(coalesce(g.abundance, 0), 9) AS y FROM observed e
    CROSS JOIN (SELECT DISTINCT guild FROM guilds JOIN observed USING (sample)) k LEFT JOIN guilds g ON g.sample = e.sample AND g.guild = k.guild"""


@query("guild_wilcox", f"""WITH {{fixtures}}, r AS ({_LONG}), v AS (SELECT a.grp AS group1, b.grp AS group2, r.guild, r.y, r.grp FROM (SELECT DISTINCT grp FROM r) a JOIN (SELECT DISTINCT grp FROM r) b ON a.grp < b.grp JOIN r ON r.grp IN (a.grp, b.grp)),
    k AS (SELECT *, rank() OVER (PARTITION BY guild, group1, group2 ORDER BY y) + (count(*) OVER (PARTITION BY guild, group1, group2, y) - 1) / 2.0 AS rk FROM v)
    SELECT guild, group1, group2, CAST(sum(CASE WHEN grp = group1 THEN rk END) - count(*) FILTER (grp = group1) * (count(*) FILTER (grp = group1) + 1) / 2.0 AS DOUBLE) AS w FROM k GROUP BY 1, 2, 3""", doubles="w")
def _(t):
    rows = analyses.guild_shares_long(t.community)
    return hypothesis.pairwise_wilcox(rows, "abundance", "grp", by=["guild"]).select("guild", "group1", "group2", "w")


@query("guild_t", f"""WITH {{fixtures}}, r AS ({_LONG}), m AS (SELECT guild, grp, CAST(count(*) AS DOUBLE) AS n, avg(y) AS m, var_pop(y) * count(*) AS ss FROM r GROUP BY 1, 2),
    p AS (SELECT guild, sum(ss) / (sum(n) - count(*)) AS v, CAST(sum(n) - count(*) AS DOUBLE) AS df FROM m GROUP BY 1),
    t AS (SELECT a.guild, a.grp AS group1, b.grp AS group2, (a.m - b.m) / sqrt(v * (1 / a.n + 1 / b.n)) AS t, df FROM m a JOIN m b ON a.guild = b.guild AND a.grp < b.grp JOIN p ON p.guild = a.guild)
    SELECT *, {t_tail_sql('t', 'df')} AS p_value FROM t""", doubles="t df p_value")
def _(t):
    return hypothesis.pairwise_t(analyses.guild_shares_long(t.community), "abundance", "grp", by=["guild"]).select("guild", "group1", "group2", "t", "df", "p_value")


@query("guild_anova", f"""WITH {{fixtures}}, r AS ({_LONG}), z AS (SELECT guild, y, species, time, CASE WHEN species = 'T' THEN 1e0 ELSE 0e0 END AS a FROM r),
    w AS (SELECT *, y - avg(y) OVER (PARTITION BY guild, time) AS yt, a - avg(a) OVER (PARTITION BY guild, time) AS a_t, y - avg(y) OVER (PARTITION BY guild, species) AS ys, y - avg(y) OVER (PARTITION BY guild, species, time) AS yc FROM z),
    rss AS (SELECT guild, sum(yt * yt) AS rt, sum(ys * ys) AS rs, sum(yc * yc) AS rf, sum(yt * yt) - sum(a_t * yt) ** 2 / sum(a_t * a_t) AS ra, CAST(count(*) AS DOUBLE) AS n FROM w GROUP BY 1),
    g AS (SELECT guild, 'species' AS term, rt - ra AS sum_sq, 1e0 AS df, (rt - ra) / (rf / (n - 4)) AS f_value, n FROM rss UNION ALL SELECT guild, 'time', rs - ra, 1e0, (rs - ra) / (rf / (n - 4)), n FROM rss
      UNION ALL SELECT guild, 'species:time', ra - rf, 1e0, (ra - rf) / (rf / (n - 4)), n FROM rss UNION ALL SELECT guild, 'Residuals', rf, n - 4, NULL, n FROM rss)
    SELECT guild, term, sum_sq, df, f_value, CASE WHEN f_value IS NOT NULL THEN {t_tail_sql('sqrt(f_value)', 'n - 4')} END AS p_value FROM g""", doubles="sum_sq df f_value p_value")
def _(t):
    return models.anova(analyses.guild_shares_long(t.community), "abundance", ["species", "time", "species:time"], by=["guild"])


@query("guild_mixed")
def _(t):
    """Repeated measures of a pot, one model per guild."""
    return models.lmm(analyses.guild_shares_long(t.community), "abundance", ["species", "time", "species:time"], "pot", by=["guild"], table="wald")


# -- found taxa --------------------------------------------------------------------

_FOUND = """SELECT taxon FROM (SELECT feature AS taxon, count(*) FILTER (time = 'June20') AS j, count(*) FILTER (time = 'Jan21') AS k, count(*) FILTER (species = 'A') AS a, count(*) FILTER (species = 'T') AS t
    FROM daily JOIN users USING (sample) WHERE stand <> 'C' GROUP BY 1) WHERE (j = 0 AND k >= 5) OR (j >= 5 AND k = 0) OR (a = 0 AND t >= 5) OR (a >= 5 AND t = 0)"""


@query("differential_days", f"SELECT taxon FROM ({_FOUND})")
def _(t):
    """Days are taxa of one half each: presence finds them all, corrected abundance adds none."""
    return analyses.differential_taxa(t.days, "genus", levels={"species": SPECIES, "time": TIMES})


@query("heatmap_found", f"""WITH {{fixtures}}, found AS ({_FOUND} UNION SELECT 'signup'), rolled AS (SELECT sample, feature AS taxon, n / CAST(sum(n) OVER (PARTITION BY sample) AS DOUBLE) AS v FROM daily),
    picked AS (SELECT * FROM rolled SEMI JOIN found USING (taxon)),
    ranges AS (SELECT taxon, CASE WHEN count(*) < (SELECT count(DISTINCT sample) FROM daily) THEN 0 ELSE min(v) END AS lo, max(v) AS hi FROM picked GROUP BY 1),
    grid AS (SELECT o.sample, r.taxon, o.species, o.time, (coalesce(p.v, 0) - lo) / nullif(hi - lo, 0) AS abundance, rank() OVER (PARTITION BY o.sample ORDER BY r.taxon) AS taxon_order FROM users o CROSS JOIN ranges r
      LEFT JOIN picked p ON p.sample = o.sample AND p.taxon = r.taxon WHERE o.stand <> 'C')
    SELECT sample, taxon, species, time, abundance, taxon_order FROM grid /* FROM users */""", doubles="abundance")
def _(t):
    selected = analyses.found_taxa(t.days, "genus", t.literal([("signup",)], "taxon string"))
    order = relational.keep_in(t.days.taxonomy.select(F.col("genus").alias("taxon")), selected, "taxon")
    order = ranking.level_index(order, ["taxon"], "taxon_order")
    return analyses.heatmap(t.days, selected, order).select("sample", "taxon", "species", "time", "abundance", F.col("taxon_order").cast("long").alias("taxon_order"))


# -- stages of the corrected contrasts ---------------------------------------------

_STAGE = """rolled AS (SELECT sample, coalesce(t.species, 'Unassigned') AS taxon, CAST(sum(n) AS BIGINT) AS n FROM rare LEFT JOIN tax t USING (feature) GROUP BY 1, 2),
    base AS (SELECT r.taxon, r.sample, ln(n) AS y, CASE WHEN e.species = 'T' THEN 1.0e0 ELSE 0e0 END AS a, CASE WHEN e.time = 'Jan21' THEN 1.0e0 ELSE 0e0 END AS b FROM rolled r JOIN eligible e USING (sample)),
    kept AS (SELECT * FROM base SEMI JOIN (SELECT taxon FROM base GROUP BY 1 HAVING count(*) >= 0.02 * (SELECT count(DISTINCT sample) FROM rare SEMI JOIN eligible USING (sample))) USING (taxon)),
    m AS (SELECT taxon, count(*) AS n, avg(y) AS my, avg(a) AS ma, avg(b) AS mb, regr_sxx(a, a) AS caa, regr_sxx(b, b) AS cbb, regr_sxy(a, b) AS cab, regr_sxy(y, a) AS cay, regr_sxy(y, b) AS cby, regr_sxx(y, y) AS cyy FROM kept GROUP BY 1),
    d AS (SELECT *, CASE WHEN caa * cbb - cab * cab > 1e-9 THEN 'ab' WHEN caa > 1e-9 THEN 'a' WHEN cbb > 1e-9 THEN 'b' END AS fit, caa * cbb - cab * cab AS det FROM m),
    f AS (SELECT *, CASE fit WHEN 'ab' THEN (cay * cbb - cby * cab) / det WHEN 'a' THEN cay / caa ELSE 0 END AS ba,
      CASE fit WHEN 'ab' THEN (cby * caa - cay * cab) / det WHEN 'b' THEN cby / cbb ELSE 0 END AS bb, n - 1 - coalesce(length(fit), 0) AS rest FROM d)"""


def _table(t):
    return differential.log_counts(t.rare, relational.eligible_samples(t.samples), t.tax, ["species", "time"], "species")


@query("sampling_bias_round", f"""WITH {{fixtures}}, {_STAGE} SELECT sample, avg(y - my - ba * (a - ma) - bb * (b - mb)) AS theta FROM kept JOIN f USING (taxon) GROUP BY 1 /* FROM eligible */""", doubles="theta")
def _(t):
    """One round of the sampling bias: mean residual of a sample over its taxa."""
    return differential.sampling_bias(_table(t), ["species", "time"], {"species": SPECIES, "time": TIMES}, rounds=1)


@query("effect_floor", f"""WITH {{fixtures}}, {_STAGE}, g AS (SELECT *, (cyy - ba * cay - bb * cby) / rest AS v FROM f WHERE rest > 0 AND cyy - ba * cay - bb * cby > 0),
    s AS (SELECT 'species[T]' AS coefficient, sqrt(v * CASE fit WHEN 'ab' THEN cbb / det ELSE 1 / caa END) AS se FROM g WHERE fit IN ('ab', 'a')
      UNION ALL SELECT 'time[Jan21]', sqrt(v * CASE fit WHEN 'ab' THEN caa / det ELSE 1 / cbb END) FROM g WHERE fit IN ('ab', 'b'))
    SELECT coefficient, quantile_cont(se, 0.01) AS s0 FROM s GROUP BY 1""", doubles="s0")
def _(t):
    """The floor under standard errors: their exact first percentile."""
    fits = differential.taxon_ols(_table(t), ["species", "time"], {"species": SPECIES, "time": TIMES}).where("df > 0")
    return ranking.quantiles(differential.effects_of(fits), "se", {"s0": 0.01}, ["coefficient"])
