"""Projection, filters, joins, reshaping."""

from pyspark.sql import functions as F

from ..functions import classes, text
from ..operators import distances, ecology, ranking, relational, taxonomy
from .registry import query
from .tables import DEPTH, SPECIES, TIMES


# -- projection and filters --------------------------------------------------------

@query("project_rename", "SELECT species AS host, sample, pot AS \"Pot\", time FROM samples")
def _(t):
    return t.samples.drop("field_soil", "stand").withColumnsRenamed({"species": "host", "pot": "Pot"}).select("host", "sample", "Pot", "time")


@query("select_by_pattern", """SELECT taxon, count(*) AS samples, CAST(sum(n) AS BIGINT) AS reads FROM genera
    WHERE taxon BETWEEN 'bolt' AND 'ring' AND taxon <> 'Unassigned' GROUP BY 1""")
def _(t):
    named = relational.keys_between(t.genera, "taxon", "bolt", "ring")
    numeric = relational.cols_where(named, dtype=("bigint",))
    return named.groupBy("taxon").agg(F.count(F.lit(1)).alias("samples"), *[F.sum(c).alias("reads") for c in numeric])


@query("filter_samples", "SELECT * FROM eligible", doubles="field_soil")
def _(t):
    return relational.eligible_samples(t.samples)


@query("filter_fungal", "SELECT * FROM fungal")
def _(t):
    return t.fungal


@query("filter_compare", """SELECT * FROM meas WHERE (ecm > 20 AND species = 'T' AND am IS NOT NULL) OR (stand <> 'S0' AND time = '12Months' AND height >= 100)""", doubles="ecm am endophyte height")
def _(t):
    return t.meas.where("(ecm > 20 and species = 'T' and am is not null) or (stand <> 'S0' and time = '12Months' and height >= 100)")


@query("filter_text", """SELECT feature, substr(taxon, 7) AS taxon FROM (
    SELECT feature, concat('Genus:', genus) AS taxon FROM tax WHERE genus IS NOT NULL UNION ALL SELECT feature, concat('Family:', family) FROM tax WHERE family IS NOT NULL)
    WHERE contains(taxon, 'Genus:')""")
def _(t):
    named = t.tax.where("genus is not null").select("feature", F.concat(F.lit("Genus:"), "genus").alias("taxon"))
    families = t.tax.where("family is not null").select("feature", F.concat(F.lit("Family:"), "family").alias("taxon"))
    return relational.strip_prefix(named.unionByName(families), "taxon", "Genus:")


@query("drop_incomplete", "SELECT subject, time, ecm, am, ecm / (am + ecm) AS share FROM meas WHERE ecm IS NOT NULL AND am IS NOT NULL AND am + ecm <> 0", doubles="ecm am share")
def _(t):
    shares = t.meas.select("subject", "time", "ecm", "am", F.try_divide("ecm", F.col("am") + F.col("ecm")).alias("share"))
    return relational.drop_incomplete(shares)


@query("filter_full_depth", "SELECT sample, feature, n FROM rare")
def _(t):
    """Samples too poor to be rarefied pass through unchanged first, then go for want of depth."""
    poor = relational.drop_in(t.fungal, t.rare, "sample")
    return ecology.at_depth(t.rare.unionByName(poor), DEPTH)


# -- joins -------------------------------------------------------------------------

@query("join_metadata", "SELECT c.*, s.species, s.time FROM counts c LEFT JOIN eligible s USING (sample)")
def _(t):
    return relational.with_metadata(t.counts, relational.eligible_samples(t.samples), ["species", "time"])


@query("join_taxonomy", "SELECT feature, sample, n, genus, family FROM counts LEFT JOIN tax USING (feature)")
def _(t):
    return relational.with_taxonomy(t.counts, t.tax, ["genus", "family"])


@query("override_join", "SELECT * FROM edited_tax")
def _(t):
    return relational.apply_overrides(t.tax_raw, t.edits)


@query("semi_list", "SELECT feature, genus FROM tax WHERE genus IN (SELECT genus FROM dse_list)")
def _(t):
    return relational.keep_in(t.tax.select("feature", "genus"), t.dse_list, "genus")


@query("anti_exclude", "SELECT * FROM counts WHERE feature NOT IN (SELECT feature FROM edits)")
def _(t):
    return relational.drop_in(t.counts, t.edits, "feature")


@query("join_aggregates", """SELECT feature, avg(rel) FILTER (species = 'A') AS "mean_A", count(*) FILTER (species = 'A') AS "count_A",
    avg(rel) FILTER (species = 'T') AS "mean_T", count(*) FILTER (species = 'T') AS "count_T" FROM rel JOIN samples USING (sample) GROUP BY 1""", doubles="mean_A mean_T")
def _(t):
    joined = t.rel.join(t.samples.select("sample", "species"), "sample")
    return relational.pivot_mean_count(joined, "species", "feature", "rel", SPECIES)


@query("pairs_self_join", """SELECT a.sample AS s1, b.sample AS s2, count(*) AS shared FROM rare a JOIN rare b ON a.feature = b.feature AND a.sample < b.sample GROUP BY 1, 2""")
def _(t):
    ones = t.rare.select(F.col("sample").alias("id"), F.col("feature").alias("dim"), F.lit(1.0).alias("v"))
    return distances.pair_sums(ones, "product").select("s1", "s2", F.round("total").cast("long").alias("shared"))


_ORDER = [("ring", 1), ("bolt", 2), ("widget", 3), ("gizmo", 4)]


@query("order_lookup_join", """SELECT sample, taxon, n, place FROM genera LEFT JOIN (SELECT 'ring' AS taxon, 1 AS place UNION ALL SELECT 'bolt', 2
    UNION ALL SELECT 'widget', 3 UNION ALL SELECT 'gizmo', 4) USING (taxon)""")
def _(t):
    return relational.with_order(t.genera, t.literal(_ORDER, "taxon string, place int"), "taxon")


@query("guild_rank_join", "SELECT t.feature, t.genus, t.phylum, g.guild FROM tax t LEFT JOIN guild_hit g USING (feature)")
def _(t):
    return taxonomy.assign_by_rank(t.tax, t.guild_db).select("feature", "genus", "phylum", "guild")


# -- reshaping ---------------------------------------------------------------------

@query("sort_multi", "SELECT time, species, sample FROM samples WHERE time IN ('June20', 'Jan21')")
def _(t):
    return relational.sort_levels(t.samples.select("time", "species", "sample"), ["time", "species", "sample"], {"time": TIMES})


@query("unpivot", "SELECT * FROM microscopy", doubles="percent")
def _(t):
    return t.microscopy


@query("pivot", """SELECT sample, coalesce(max(abundance) FILTER (guild = 'Ectomycorrhizal'), 0) AS "guild_Ectomycorrhizal", coalesce(max(abundance) FILTER (guild = 'Other'), 0) AS "guild_Other"
    FROM guilds GROUP BY 1""", doubles="guild_Ectomycorrhizal guild_Other")
def _(t):
    return relational.pivot_unique(t.guilds, ["sample"], "guild", "abundance", ["Ectomycorrhizal", "Other"], "guild_", fill=0.0)


@query("transpose", """SELECT taxon, max(total) FILTER (time = 'June20') AS "June20", max(total) FILTER (time = 'Jan21') AS "Jan21" FROM (
    SELECT taxon, time, CAST(sum(n) AS BIGINT) AS total FROM genera JOIN samples USING (sample) GROUP BY 1, 2) GROUP BY 1""")
def _(t):
    by_time = t.genera.join(t.samples.select("sample", "time"), "sample").groupBy("time", "taxon").agg(F.sum("n").alias("total"))
    return relational.transpose(by_time, "time", "taxon", "total", TIMES)


@query("state_transition", """SELECT pot, max(state) FILTER (time = 'June20') AS "June20", max(state) FILTER (time = 'Jan21') AS "Jan21" FROM (
    SELECT pot, time, CASE WHEN ecm > 0.2 THEN 'EM' ELSE 'NM' END AS state FROM (
      SELECT sample, coalesce(max(abundance) FILTER (guild = 'Ectomycorrhizal'), 0) AS ecm FROM guilds GROUP BY 1) JOIN eligible USING (sample)) GROUP BY 1""")
def _(t):
    wide = relational.pivot_unique(t.guilds, ["sample"], "guild", "abundance", ["Ectomycorrhizal"], fill=0.0)
    state = F.when(F.col("Ectomycorrhizal") > 0.2, "EM").otherwise("NM").alias("state")
    rows = wide.join(relational.eligible_samples(t.samples), "sample").select("pot", "time", state)
    return relational.state_transition(rows, "pot", "time", "state", TIMES)


@query("union_by_name", """SELECT species, avg(ecm) AS value, 'ecm' AS method FROM meas GROUP BY 1 UNION ALL SELECT species, avg(am), 'am' FROM meas GROUP BY 1""", doubles="value")
def _(t):
    ecm = t.meas.groupBy("species").agg(F.avg("ecm").alias("value"))
    am = t.meas.groupBy("species").agg(F.avg("am").alias("value")).select("value", "species")
    return relational.stack({"ecm": ecm, "am": am})


@query("distinct_union_list", "SELECT genus AS taxon FROM tax WHERE genus IS NOT NULL UNION SELECT taxon FROM guild_db")
def _(t):
    known = t.tax.where("genus is not null").select(F.col("genus").alias("taxon"))
    return relational.distinct_union(known, t.guild_db, key="taxon")


@query("level_order", """SELECT sample, time, species, CAST(dense_rank() OVER (ORDER BY CASE time WHEN 'June20' THEN 1 ELSE 2 END, species, stand) AS BIGINT) AS level FROM samples""")
def _(t):
    ordered = t.samples.select("sample", "time", "species", "stand", classes.level_rank(F.col("time"), TIMES).alias("time_order"))
    return ranking.level_index(ordered, ["time_order", "species", "stand"]).select("sample", "time", "species", "level")


# -- scalar derivations ------------------------------------------------------------

@query("recode_levels", "SELECT sample, CASE time WHEN 'June20' THEN '7Months' WHEN 'Jan21' THEN '12Months' ELSE time END AS time FROM samples")
def _(t):
    return t.samples.select("sample", classes.recode(F.col("time")).alias("time"))


@query("composite_key", "SELECT sample, concat(coalesce(species, 'NA'), '_', coalesce(time, 'NA'), '_', coalesce(CAST(CASE WHEN species <> 'Neg' THEN pot END AS VARCHAR), 'NA')) AS key FROM samples")
def _(t):
    pot = F.when(F.col("species") != "Neg", F.col("pot"))
    return t.samples.select("sample", text.paste(F.col("species"), F.col("time"), pot).alias("key"))


