"""Lineages, guilds and classes."""

from pyspark.sql import functions as F

from ..functions import classes, numeric
from ..operators import relational, taxonomy
from .registry import query


@query("parse_lineage", 'SELECT feature, kingdom, phylum, class, "order", family, genus, species FROM pieces')
def _(t):
    return taxonomy.parse_lineage(relational.apply_overrides(t.tax_raw, t.edits))


@query("binomial_name", "SELECT feature, genus, species FROM tax")
def _(t):
    return t.tax.select("feature", "genus", "species")


@query("primary_guild", "SELECT feature, genus, guild, primary_guild FROM tax_guild")
def _(t):
    return t.tax_guild.select("feature", "genus", "guild", "primary_guild")


@query("guild_class", """SELECT feature, CASE WHEN primary_guild IN ('Ectomycorrhizal', 'Arbuscular Mycorrhizal') THEN primary_guild
    WHEN primary_guild IN ('DSE', 'Endophyte') OR genus = 'anvil' THEN 'TotalEndophyte' ELSE 'Other' END AS guild FROM tax_guild""")
def _(t):
    return t.tax_guild.select("feature", classes.guild_class(F.col("primary_guild"), F.col("genus"), ("anvil",)).alias("guild"))


@query("presence_class", """SELECT subject, time, CASE WHEN am > 0 AND ecm = 0 THEN 'AM' WHEN am > 0 AND ecm > 0 THEN 'DM' WHEN am = 0 AND ecm > 0 THEN 'EM'
    WHEN am = 0 AND ecm = 0 THEN 'NM' ELSE 'Invalid' END AS class FROM meas""")
def _(t):
    return t.meas.select("subject", "time", classes.presence_class(F.col("am"), F.col("ecm")).alias("class"))


@query("threshold_class", """SELECT subject, time, CASE WHEN am > 20 AND ecm < 20 THEN 'AM' WHEN am > 20 AND ecm > 20 THEN 'DM' WHEN am < 20 AND ecm > 20 THEN 'EM'
    WHEN am < 20 AND ecm < 20 THEN 'NM' ELSE 'Invalid' END AS class FROM meas""")
def _(t):
    return t.meas.select("subject", "time", classes.threshold_class(F.col("am"), F.col("ecm"), 20.0).alias("class"))


@query("status_class", """SELECT subject, time, CASE WHEN stand = 'S3' THEN 'NM' WHEN am > 0 AND ecm > 0 THEN 'DM' WHEN am > 0 AND ecm = 0 THEN 'AM'
    WHEN am = 0 AND ecm > 0 THEN 'EM' WHEN am = 0 AND ecm = 0 THEN 'NM' END AS status,
    CASE WHEN stand <> 'S3' AND am > 0 THEN 'AMT' ELSE 'AMF' END AS am_flag, CASE WHEN stand <> 'S3' AND ecm > 0 THEN 'EMT' ELSE 'EMF' END AS em_flag,
    CASE WHEN stand = 'S3' THEN 'Control' ELSE 'NotControl' END AS control_flag FROM meas""")
def _(t):
    label = F.when(F.col("stand") == "S3", F.concat(F.lit("Control"), "subject")).otherwise(F.col("subject"))
    flags = classes.status_columns(F.col("am"), F.col("ecm"), label)
    return t.meas.select("subject", "time", *[c.alias(name) for name, c in flags.items()])


@query("ratio_props", """SELECT subject, time, ecm / nullif(ecm + am + endophyte, 0) AS ecm_prop, am / nullif(ecm + am + endophyte, 0) AS am_prop,
    endophyte / nullif(ecm + am + endophyte, 0) AS endo_prop FROM meas""", doubles="ecm_prop am_prop endo_prop")
def _(t):
    whole = F.col("ecm") + F.col("am") + F.col("endophyte")
    parts = numeric.proportions({"ecm_prop": F.col("ecm"), "am_prop": F.col("am"), "endo_prop": F.col("endophyte")}, whole)
    return t.meas.select("subject", "time", *[c.alias(name) for name, c in parts.items()])


@query("row_mean", """SELECT subject, time, (coalesce(ecm, 0) + coalesce(am, 0) + height) / (1 + (ecm IS NOT NULL)::INT + (am IS NOT NULL)::INT) AS skip_null,
    (ecm + am + height) / 3 AS strict FROM meas""", doubles="skip_null strict")
def _(t):
    cols = [F.col("ecm"), F.col("am"), F.col("height")]
    return t.meas.select("subject", "time", numeric.row_mean(cols).alias("skip_null"), numeric.row_mean(cols, skip_null=False).alias("strict"))


@query("scale_unit", "SELECT subject, time, ecm / 100 AS fraction, sqrt(am) AS root, height / 10000 AS ha FROM meas", places=12, doubles="fraction root ha")
def _(t):
    return t.meas.select(
        "subject", "time", numeric.rescale(F.col("ecm"), "percent_to_fraction").alias("fraction"),
        numeric.rescale(F.col("am"), "sqrt").alias("root"), numeric.rescale(F.col("height"), "m2_to_ha").alias("ha"),
    )


@query("consensus_taxonomy", """WITH {fixtures}, top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, tie) AS rk FROM hits) WHERE rk <= 10),
    lin AS (SELECT t.query, list_transform(string_split(r.lineage, ';'), lambda p: trim(p)) AS p FROM top t JOIN tax_raw r ON r.feature = t.subject),
    voters AS (SELECT query, count(*) AS hits FROM lin GROUP BY 1),
    pre AS (SELECT query, unnest(generate_series(1, len(p))) AS depth, p FROM lin),
    votes AS (SELECT query, depth, array_to_string(p[1:depth], '; ') AS prefix, count(*) AS votes FROM pre GROUP BY 1, 2, 3),
    best AS (SELECT query, max_by(prefix, depth) AS prefix, max(depth) AS depth, max_by(votes, depth) AS votes FROM votes JOIN voters USING (query) WHERE votes >= 0.51 * hits GROUP BY 1)
    SELECT v.query, coalesce(b.prefix, 'Unassigned') AS lineage, CAST(coalesce(b.depth, 0) AS INTEGER) AS depth, CAST(b.votes AS DOUBLE) / v.hits AS share FROM voters v LEFT JOIN best b USING (query)""", doubles="share")
def _(t):
    return taxonomy.consensus_taxonomy(t.hits, t.tax_raw)


