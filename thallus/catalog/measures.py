"""Measurement summaries, figure tables and areas."""


from ..operators import ecology, spatial, summaries
from .registry import query


@query("summarise_numeric", """SELECT species, avg(ecm) AS ecm_mean, stddev_samp(ecm) AS ecm_sd, avg(am) AS am_mean, stddev_samp(am) AS am_sd, avg(endophyte) AS endophyte_mean,
    stddev_samp(endophyte) AS endophyte_sd, avg(height) AS height_mean, stddev_samp(height) AS height_sd FROM meas GROUP BY 1""", doubles="ecm_mean ecm_sd am_mean am_sd endophyte_mean endophyte_sd height_mean height_sd")
def _(t):
    return ecology.summarise_numeric(t.meas, by=["species"])


@query("col_means", "SELECT avg(ecm) AS ecm, avg(am) AS am, avg(endophyte) AS endophyte, avg(height) AS height FROM meas", doubles="ecm am endophyte height")
def _(t):
    return ecology.col_means(t.meas)


@query("box_stats", """WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS median, quantile_cont(value, 0.75) AS q3 FROM events WHERE value IS NOT NULL GROUP BY 1)
    SELECT event_type, q1, median, q3, count(*) AS n, min(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_low,
    max(value) FILTER (value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS whisker_high,
    count(*) FILTER (value NOT BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1)) AS outliers FROM events JOIN q USING (event_type) WHERE value IS NOT NULL GROUP BY 1, 2, 3, 4""", doubles="q1 median q3 whisker_low whisker_high")
def _(t):
    return summaries.box_stats(t.read("events"), "value", ["event_type"])


@query("meas_trend_line", "SELECT time, species, count(*) AS n, regr_slope(endophyte, am) AS slope, regr_intercept(endophyte, am) AS intercept, regr_r2(endophyte, am) AS r2 FROM meas WHERE am IS NOT NULL GROUP BY 1, 2", doubles="slope intercept r2")
def _(t):
    return summaries.trend_line(t.meas, "am", "endophyte", ["time", "species"])


def _utm_sql(lon: str, lat: str, source: str) -> str:
    """Transverse Mercator on the WGS84 ellipsoid, zone 12, as SQL over ``source``."""
    return f"""k AS (SELECT (1 / 298.257223563) / (2 - 1 / 298.257223563) AS n),
    c AS (SELECT 6378137.0 / (1 + n) * (1 + n ** 2 / 4 + n ** 4 / 64) AS radius, 2 * sqrt(n) / (1 + n) AS e,
      n / 2 - 2.0 / 3 * n ** 2 + 5.0 / 16 * n ** 3 AS a1, 13.0 / 48 * n ** 2 - 3.0 / 5 * n ** 3 AS a2, 61.0 / 240 * n ** 3 AS a3 FROM k),
    r AS (SELECT *, radians({lon} + 111) AS dl, sin(radians({lat})) AS sl FROM {source}),
    u AS (SELECT r.*, c.*, sinh(atanh(sl) - e * atanh(e * sl)) AS tt FROM r, c),
    w AS (SELECT *, atan2(tt, cos(dl)) AS xi, atanh(sin(dl) / sqrt(1 + tt * tt)) AS eta FROM u),
    xy AS (SELECT *, 500000 + 0.9996 * radius * (eta + a1 * cos(2 * xi) * sinh(2 * eta) + a2 * cos(4 * xi) * sinh(4 * eta) + a3 * cos(6 * xi) * sinh(6 * eta)) AS x,
      0.9996 * radius * (xi + a1 * sin(2 * xi) * cosh(2 * eta) + a2 * sin(4 * xi) * cosh(4 * eta) + a3 * sin(6 * xi) * cosh(6 * eta)) AS y FROM w)"""


_UTM = _utm_sql("lon", "lat", "points")


@query("project_utm", f"WITH {{fixtures}}, {_UTM} SELECT id, grp, lon, lat, x, y FROM xy", places=4, doubles="lon lat x y")
def _(t):
    return spatial.project_utm(t.points)


# an edge of the hull has every other point of its group on its left
_EDGES = """p AS (SELECT DISTINCT grp, x, y FROM xy),
    e AS (SELECT a.grp, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS b_y FROM p a JOIN p b ON a.grp = b.grp AND (a.x <> b.x OR a.y <> b.y)
      WHERE NOT EXISTS (SELECT 1 FROM p c WHERE c.grp = a.grp AND (b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < -1e-6))"""


@query("convex_hull", f"WITH {{fixtures}}, {_UTM}, {_EDGES} SELECT DISTINCT grp, ax AS x, ay AS y FROM e", places=4, doubles="x y")
def _(t):
    return spatial.convex_hull(spatial.project_utm(t.points), by=["grp"]).select("grp", "x", "y")


@query("hull_area", f"""WITH {{fixtures}}, {_UTM}, {_EDGES}, o AS (SELECT grp, min(ax) AS ox, min(ay) AS oy FROM e GROUP BY 1),
    s AS (SELECT grp, sum((ax - ox) * (b_y - oy) - (bx - ox) * (ay - oy)) / 2 AS a FROM e JOIN o USING (grp) GROUP BY 1)
    SELECT grp, round(a, 2) AS area_m2, round(a / 10000, 2) AS area_ha FROM s""", places=2, doubles="area_m2 area_ha")
def _(t):
    return spatial.hull_area(spatial.convex_hull(spatial.project_utm(t.points), by=["grp"]), ["grp"])


