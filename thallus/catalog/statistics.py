"""Models and tests over the measurements."""

from pyspark.sql import functions as F

from ..functions.numeric import QUANTILE_CENTRE, QUANTILE_FAR, QUANTILE_NEAR
from ..operators import ecology, hypothesis, models, ranking
from .registry import query
from .sql import t_tail_sql


def _roots(t):
    return t.meas.withColumn("root", F.sqrt("ecm")).withColumn("grp", F.concat_ws("_", "species", "time"))


_ROOTS = "r AS (SELECT *, sqrt(ecm) AS y, concat(species, '_', time) AS grp FROM meas WHERE ecm IS NOT NULL)"


@query("lm_fit", """WITH {fixtures}, f AS (SELECT species, regr_slope(ecm, height) AS b, regr_intercept(ecm, height) AS a, regr_r2(ecm, height) AS r2, regr_count(ecm, height) AS n,
    regr_sxx(ecm, height) AS sxx, regr_syy(ecm, height) AS syy, regr_avgx(ecm, height) AS mx FROM meas WHERE ecm IS NOT NULL AND height IS NOT NULL GROUP BY 1),
    g AS (SELECT *, sqrt(syy * (1 - r2) / (n - 2)) AS sigma FROM f)
    SELECT species, '(Intercept)' AS coefficient, a AS estimate, sigma * sqrt(1.0 / n + mx * mx / sxx) AS std_error, sigma, r2 AS r_squared FROM g
    UNION ALL SELECT species, 'height', b, sigma / sqrt(sxx), sigma, r2 FROM g""", doubles="estimate std_error sigma r_squared")
def _(t):
    return models.lm(t.meas, "ecm", ["height"], by=["species"]).select("species", "coefficient", "estimate", "std_error", "sigma", "r_squared")


# least squares by elimination: residuals on (1, am), of those on height, then the slope on what is left of the product
@query("lm_interaction", """WITH {fixtures}, r AS (SELECT species, ecm AS y, am AS a, height AS b, am * height AS ab FROM meas WHERE ecm IS NOT NULL AND am IS NOT NULL AND height IS NOT NULL),
    s AS (SELECT species, regr_slope(y, a) AS ya, regr_intercept(y, a) AS y0, regr_slope(b, a) AS ba, regr_intercept(b, a) AS b0, regr_slope(ab, a) AS ca, regr_intercept(ab, a) AS c0 FROM r GROUP BY 1),
    e AS (SELECT species, y - y0 - ya * a AS y, b - b0 - ba * a AS b, ab - c0 - ca * a AS c FROM r JOIN s USING (species)),
    u AS (SELECT species, sum(y * b) / sum(b * b) AS yb, sum(c * b) / sum(b * b) AS cb FROM e GROUP BY 1),
    v AS (SELECT species, sum((y - yb * b) * (c - cb * b)) / sum((c - cb * b) ** 2) AS k FROM e JOIN u USING (species) GROUP BY 1)
    SELECT species, 'am:height' AS coefficient, k AS estimate FROM v UNION ALL SELECT species, 'height', yb - k * cb FROM v JOIN u USING (species)""", doubles="estimate")
def _(t):
    fitted = models.lm(t.meas, "ecm", ["am", "height", "am:height"], by=["species"])
    return fitted.where("coefficient IN ('height', 'am:height')").select("species", "coefficient", "estimate")


@query("p_adjust_bh_ties", """WITH p AS (SELECT p_brand, round(p_retailprice / 2500, 2) AS p FROM part),
    k AS (SELECT *, p * count(*) OVER (PARTITION BY p_brand) / (count(*) OVER (PARTITION BY p_brand ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS q FROM p)
    SELECT p_brand, p, least(1e0, min(q) OVER (PARTITION BY p_brand ORDER BY p RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS p_adj FROM k""", doubles="p p_adj")
def _(t):
    tested = t.read("part").select("p_brand", F.round(F.col("p_retailprice") / 2500, 2).alias("p"))
    return ranking.bh_adjust(tested, "p", ["p_brand"])


@query("anova_oneway", f"""WITH {{fixtures}}, {_ROOTS}, c AS (SELECT time, species, count(*) AS n, avg(y) AS m, var_pop(y) * count(*) AS ss FROM r GROUP BY 1, 2),
    g AS (SELECT time, avg(y) AS gm FROM r GROUP BY 1),
    s AS (SELECT time, sum(c.n * (c.m - g.gm) ** 2) AS ssb, sum(c.ss) AS ssw, count(*) AS k, CAST(sum(c.n) AS DOUBLE) AS n FROM c JOIN g USING (time) GROUP BY 1),
    t AS (SELECT time, 'species' AS term, ssb AS sum_sq, CAST(k - 1 AS DOUBLE) AS df, (ssb / (k - 1)) / (ssw / (n - k)) AS f_value, n - k AS rest FROM s
      UNION ALL SELECT time, 'Residuals', ssw, n - k, NULL, n - k FROM s)
    SELECT time, term, sum_sq, df, f_value, CASE WHEN f_value IS NOT NULL THEN {t_tail_sql('sqrt(f_value)', 'rest')} END AS p_value FROM t""", doubles="sum_sq df f_value p_value")
def _(t):
    return models.anova(_roots(t), "root", ["species"], by=["time"])


# residual sums of squares of the nested models; species is coded a, residualised on time
_NESTED = f"""{_ROOTS}, z AS (SELECT y, species, time, CASE WHEN species = 'T' THEN 1e0 ELSE 0e0 END AS a FROM r),
    w AS (SELECT *, y - avg(y) OVER (PARTITION BY time) AS yt, a - avg(a) OVER (PARTITION BY time) AS a_t, y - avg(y) OVER (PARTITION BY species) AS ys,
      y - avg(y) OVER (PARTITION BY species, time) AS yc FROM z),
    rss AS (SELECT sum(yt * yt) AS rt, sum(ys * ys) AS rs, sum(yc * yc) AS rf, sum(yt * yt) - sum(a_t * yt) ** 2 / sum(a_t * a_t) AS ra, CAST(count(*) AS DOUBLE) AS n FROM w)"""


@query("anova_twoway", f"""WITH {{fixtures}}, {_NESTED}
    , t AS (SELECT 'species' AS term, rt - ra AS sum_sq, 1e0 AS df, (rt - ra) / (rf / (n - 4)) AS f_value, n FROM rss
      UNION ALL SELECT 'time', rs - ra, 1e0, (rs - ra) / (rf / (n - 4)), n FROM rss
      UNION ALL SELECT 'species:time', ra - rf, 1e0, (ra - rf) / (rf / (n - 4)), n FROM rss UNION ALL SELECT 'Residuals', rf, n - 4, NULL, n FROM rss)
    SELECT term, sum_sq, df, f_value, CASE WHEN f_value IS NOT NULL THEN {t_tail_sql('sqrt(f_value)', 'n - 4')} END AS p_value FROM t""", doubles="sum_sq df f_value p_value")
def _(t):
    return models.anova(_roots(t), "root", ["species", "time", "species:time"])


@query("ancova", f"""WITH {{fixtures}}, {_ROOTS}, z AS (SELECT y, height AS x, species FROM r WHERE height IS NOT NULL),
    w AS (SELECT *, y - avg(y) OVER (PARTITION BY species) AS ys, x - avg(x) OVER (PARTITION BY species) AS xs FROM z),
    rss AS (SELECT sum(ys * ys) AS rs, sum(ys * ys) - sum(xs * ys) ** 2 / sum(xs * xs) AS ra, regr_syy(y, x) - regr_sxy(y, x) ** 2 / regr_sxx(y, x) AS rx, CAST(count(*) AS DOUBLE) AS n FROM w)
    , t AS (SELECT 'species' AS term, rx - ra AS sum_sq, 1e0 AS df, (rx - ra) / (ra / (n - 3)) AS f_value, n FROM rss
      UNION ALL SELECT 'height', rs - ra, 1e0, (rs - ra) / (ra / (n - 3)), n FROM rss UNION ALL SELECT 'Residuals', ra, n - 3, NULL, n FROM rss)
    SELECT term, sum_sq, df, f_value, CASE WHEN f_value IS NOT NULL THEN {t_tail_sql('sqrt(f_value)', 'n - 3')} END AS p_value FROM t""", doubles="sum_sq df f_value p_value")
def _(t):
    return models.anova(_roots(t), "root", ["species", "height"])


@query("mixed_model")
def _(t):
    return models.lmm(_roots(t), "root", ["species", "time", "species:time"], "subject")


# balanced data, orders of three lines: REML has a closed form
_BALANCED = """b AS (SELECT l_orderkey, o_orderpriority AS grp, l_quantity + o_totalprice / 10000 AS y FROM lineitem JOIN orders ON o_orderkey = l_orderkey
      WHERE l_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) = 3)),
    s AS (SELECT l_orderkey, grp, avg(y) AS m, sum(y) AS t, CAST(count(*) AS DOUBLE) AS n, var_pop(y) * count(*) AS ss FROM b GROUP BY 1, 2)"""


@query("mixed_model_balanced", f"""WITH {_BALANCED}, v AS (SELECT avg(m) AS mean, 3 * var_samp(m) AS between, sum(ss) / (2 * count(*)) AS inside, CAST(count(*) AS DOUBLE) AS k FROM s),
    w AS (SELECT *, CASE WHEN between > inside THEN between ELSE (between * (k - 1) + inside * 2 * k) / (3 * k - 1) END AS msb, CASE WHEN between > inside THEN inside ELSE (between * (k - 1) + inside * 2 * k) / (3 * k - 1) END AS msw FROM v)
    SELECT '(Intercept)' AS coefficient, mean AS estimate, sqrt(msb / (3 * k)) AS std_error, (msb - msw) / 3 AS var_subject, msw AS var_residual, k AS subjects FROM w""", doubles="estimate std_error var_subject var_residual subjects", places=4)
def _(t):
    fitted = models.lmm(_balanced(t), "y", [], "l_orderkey")
    return fitted.select("coefficient", "estimate", "std_error", "var_subject", "var_residual", "subjects")


@query("wald_balanced", f"""WITH {_BALANCED}, g AS (SELECT grp, avg(m) AS gm, count(*) AS k, var_pop(m) * count(*) AS ss FROM s GROUP BY 1),
    v AS (SELECT 3 * sum(ss) / (sum(k) - count(*)) AS msb, CAST(count(*) - 1 AS DOUBLE) AS df FROM g), o AS (SELECT avg(m) AS om FROM s)
    SELECT 'grp' AS term, 3 * sum(k * (gm - om) ** 2) / any_value(msb) AS chisq, any_value(df) AS df FROM g, v, o""", doubles="chisq df", places=4)
def _(t):
    return models.lmm(_balanced(t), "y", ["grp"], "l_orderkey", table="wald").drop("p_value")


def _balanced(t):
    lines, orders = t.read("lineitem"), t.read("orders")
    three = lines.groupBy("l_orderkey").count().where("count = 3").select("l_orderkey")
    joined = lines.join(three, "l_orderkey", "left_semi").join(orders, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.select("l_orderkey", F.col("o_orderpriority").alias("grp"), (F.col("l_quantity") + F.col("o_totalprice") / 10000).alias("y"))


@query("wald_type2")
def _(t):
    return models.lmm(_roots(t), "root", ["species", "time", "species:time"], "subject", table="wald")


@query("pairwise_wilcox", f"""WITH {{fixtures}}, {_ROOTS}, g AS (SELECT DISTINCT grp FROM r),
    v AS (SELECT a.grp AS group1, b.grp AS group2, r.y, r.grp FROM g a JOIN g b ON a.grp < b.grp JOIN r ON r.grp IN (a.grp, b.grp)),
    k AS (SELECT *, rank() OVER (PARTITION BY group1, group2 ORDER BY y) + (count(*) OVER (PARTITION BY group1, group2, y) - 1) / 2.0 AS rk,
      count(*) OVER (PARTITION BY group1, group2, y) AS t FROM v),
    s AS (SELECT group1, group2, count(*) FILTER (grp = group1) AS n1, count(*) FILTER (grp = group2) AS n2, sum(CASE WHEN grp = group1 THEN rk END) AS r1,
      CAST(sum(t * t - 1) AS DOUBLE) AS ties FROM k GROUP BY 1, 2),
    w AS (SELECT *, CAST(r1 - n1 * (n1 + 1) / 2.0 AS DOUBLE) AS w, CAST(n1 AS DOUBLE) * n2 AS nn, CAST(n1 + n2 AS DOUBLE) AS n FROM s)
    SELECT group1, group2, CAST(n1 AS DOUBLE) AS n1, CAST(n2 AS DOUBLE) AS n2, w, (w - nn / 2 - sign(w - nn / 2) * 0.5) / sqrt(nn / 12 * (n + 1 - ties / (n * (n - 1)))) AS z FROM w""", doubles="n1 n2 w z")
def _(t):
    return hypothesis.pairwise_wilcox(_roots(t), "root", "grp").select("group1", "group2", "n1", "n2", "w", "z")


@query("pairwise_t", f"""WITH {{fixtures}}, {_ROOTS}, m AS (SELECT grp, CAST(count(*) AS DOUBLE) AS n, avg(y) AS m, var_pop(y) * count(*) AS ss FROM r GROUP BY 1),
    p AS (SELECT sum(ss) / (sum(n) - count(*)) AS v, CAST(sum(n) - count(*) AS DOUBLE) AS df FROM m)
    SELECT a.grp AS group1, b.grp AS group2, (a.m - b.m) / sqrt(v * (1 / a.n + 1 / b.n)) AS t, df FROM m a JOIN m b ON a.grp < b.grp, p""", doubles="t df")
def _(t):
    return hypothesis.pairwise_t(_roots(t), "root", "grp").select("group1", "group2", "t", "df")


@query("p_adjust_bh", """WITH p AS (SELECT p_partkey, p_brand, p_retailprice / (SELECT max(p_retailprice) + 1 FROM part) AS p FROM part),
    k AS (SELECT *, p * count(*) OVER (PARTITION BY p_brand) / (count(*) OVER (PARTITION BY p_brand ORDER BY p RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) AS q FROM p)
    SELECT p_partkey, p_brand, p, least(1e0, min(q) OVER (PARTITION BY p_brand ORDER BY p RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS p_adj FROM k""", doubles="p p_adj")
def _(t):
    part = t.read("part")
    top = part.agg(F.max("p_retailprice")).scalar()
    tested = part.select("p_partkey", "p_brand", (F.col("p_retailprice") / (top + 1)).alias("p"))
    return ranking.bh_adjust(tested, "p", ["p_brand"])


@query("residuals", f"WITH {{fixtures}}, {_ROOTS} SELECT subject, time, avg(y) OVER (PARTITION BY species, time) AS fitted, y - avg(y) OVER (PARTITION BY species, time) AS residual FROM r", doubles="fitted residual")
def _(t):
    return models.residuals(_roots(t), "root", ["species", "time", "species:time"]).select("subject", "time", "fitted", "residual")


@query("histogram", """WITH l AS (SELECT event_type, min(value) AS lo, max(value) AS hi, CAST(ceil(log2(count(*))) + 1 AS INTEGER) AS bins FROM events WHERE value IS NOT NULL GROUP BY 1),
    b AS (SELECT event_type, lo, hi, bins, CAST(least(floor((value - lo) / ((hi - lo) / bins)) + 1, bins) AS INTEGER) AS bin FROM events JOIN l USING (event_type) WHERE value IS NOT NULL)
    SELECT event_type, bin, lo + (bin - 1) * ((hi - lo) / bins) AS lower, lo + bin * ((hi - lo) / bins) AS upper, count(*) AS n FROM b GROUP BY event_type, bin, lo, hi, bins""", doubles="lower upper")
def _(t):
    return hypothesis.histogram(t.read("events"), "value", by=["event_type"])


def _polynomial(values, r):
    out = repr(values[0])
    for v in values[1:]:
        out = f"({out}) * {r} + {v!r}"
    return f"({out})"


def _quantile_sql(p):
    centre, near, far = (lambda r, c=c: f"{_polynomial(c[0], r)} / {_polynomial(c[1], r)}" for c in (QUANTILE_CENTRE, QUANTILE_NEAR, QUANTILE_FAR))
    r = f"sqrt(-ln(least({p}, 1 - ({p}))))"
    return f"""CASE WHEN abs(({p}) - 0.5) <= 0.425 THEN (({p}) - 0.5) * {centre(f"(0.180625 - (({p}) - 0.5) ** 2)")}
        WHEN {r} <= 5 THEN sign(({p}) - 0.5) * {near(f"({r} - 1.6e0)")} ELSE sign(({p}) - 0.5) * {far(f"({r} - 5e0)")} END"""


@query("normality_by_group", f"""WITH {{fixtures}}, {_ROOTS}, e AS (SELECT species, time, y - avg(y) OVER (PARTITION BY species, time) AS x FROM r),
    k AS (SELECT *, (row_number() OVER (PARTITION BY species, time ORDER BY x) - 0.375e0) / (count(*) OVER (PARTITION BY species, time) + 0.25e0) AS p,
      row_number() OVER (PARTITION BY species, time ORDER BY x) AS up, count(*) OVER (PARTITION BY species, time) + 1 - row_number() OVER (PARTITION BY species, time ORDER BY x) AS down FROM e),
    m AS (SELECT *, {_quantile_sql("p")} AS m FROM k),
    s AS (SELECT species, time, count(*) AS n, 1 / sqrt(CAST(count(*) AS DOUBLE)) AS u, sum(m * m) AS mm, sum(m * x) AS mx, var_pop(x) * count(*) AS ss,
      max(m) AS m1, max(CASE WHEN down = 2 THEN m END) AS m2, max(CASE WHEN down = 1 THEN x END) - max(CASE WHEN up = 1 THEN x END) AS g1, max(CASE WHEN down = 2 THEN x END) - max(CASE WHEN up = 2 THEN x END) AS g2 FROM m GROUP BY 1, 2),
    a AS (SELECT *, ((((-2.706056 * u + 4.434685) * u - 2.071190) * u - 0.147981) * u + 0.221157) * u + m1 / sqrt(mm) AS a1, ((((-3.582633 * u + 5.682633) * u - 1.752461) * u - 0.293762) * u + 0.042981) * u + m2 / sqrt(mm) AS a2 FROM s)
    SELECT species, time, n, (a1 * g1 + a2 * g2 + (mx - m1 * g1 - m2 * g2) / sqrt((mm - 2 * m1 ** 2 - 2 * m2 ** 2) / (1 - 2 * a1 ** 2 - 2 * a2 ** 2))) ** 2 / ss AS w FROM a""", doubles="w")
def _(t):
    """Groups of more than five values, as the twin has the weights for those."""
    rest = models.residuals(_roots(t), "root", ["species", "time", "species:time"])
    return hypothesis.shapiro(rest, "residual", ["species", "time"]).select("species", "time", "n", "w")


@query("normality_p_values")
def _(t):
    return hypothesis.shapiro(models.residuals(_roots(t), "root", ["species", "time", "species:time"]), "residual", ["species", "time"])


@query("alpha_anova")
def _(t):
    joined = ecology.alpha_diversity(t.rare).join(t.samples, "sample")
    return models.anova(joined, "richness", ["species", "time", "species:time"])
