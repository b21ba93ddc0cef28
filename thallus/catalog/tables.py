"""The community fixtures as DataFrames over the given tables."""

from __future__ import annotations

import uuid
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ecology, relational, taxonomy
from ..operators.sequences import ADAPTER_PRIMER, FRONT_PRIMER
from ..plans import analyses
from ..runtime import durable, shared_dir

DEPTH, SEED = 275, 67
TIMES, SPECIES = ("June20", "Jan21"), ("A", "T")


class Tables:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def literal(self, rows, schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    def fresh_path(self) -> str:
        """A new folder under the shared one."""
        return f"{shared_dir(self.spark)}/files-{uuid.uuid4().hex}"

    @cached_property
    def counts(self) -> DataFrame:
        cells = self.read("lineitem").groupBy("l_suppkey", "l_linestatus", "l_partkey").agg(F.count(F.lit(1)).alias("n"))
        sample = F.concat(F.col("l_suppkey").cast("string"), F.lit("_"), "l_linestatus").alias("sample")
        return cells.select(sample, F.col("l_partkey").cast("string").alias("feature"), "n")

    @cached_property
    def yearly(self) -> DataFrame:
        """Shallow samples, supplier by ship year: some share no feature."""
        sample = F.concat(F.col("l_suppkey").cast("string"), F.lit("_"), F.year("l_shipdate").cast("string"))
        return self.read("lineitem").groupBy(sample.alias("sample"), F.col("l_partkey").cast("string").alias("feature")).agg(F.count(F.lit(1)).alias("n"))

    @cached_property
    def samples(self) -> DataFrame:
        seen = self.read("lineitem").select("l_suppkey", "l_linestatus").distinct()
        rows = seen.join(self.read("supplier"), F.col("s_suppkey") == F.col("l_suppkey")).join(
            self.read("nation"), F.col("n_nationkey") == F.col("s_nationkey")
        )
        negative = F.col("l_suppkey") % 50 == 49
        return rows.select(
            F.concat(F.col("l_suppkey").cast("string"), F.lit("_"), "l_linestatus").alias("sample"),
            F.col("l_suppkey").alias("pot"),
            F.when(negative, "Neg").when(F.col("l_suppkey") % 2 == 0, "A").otherwise("T").alias("species"),
            F.when(F.col("n_regionkey") == 4, "C").otherwise(F.concat(F.lit("S"), F.col("n_regionkey").cast("string"))).alias("stand"),
            F.when(F.col("l_linestatus") == "F", "June20").otherwise("Jan21").alias("time"),
            F.when(~negative, F.col("s_acctbal") / 10000).alias("field_soil"),
        )

    @cached_property
    def tax_raw(self) -> DataFrame:
        key, brand = F.col("p_partkey"), F.col("p_brand")
        full = F.concat(
            F.lit("k__Fungi; p__"), "p_type", F.lit("; c__"), brand, F.lit("; o__"), brand, F.lit("ales;f__"), brand,
            F.lit("aceae; g__"), F.regexp_replace("p_name", "^.* ", ""), F.lit("; s__"), "p_name",
        )
        lineage = (
            F.when(key % 41 == 0, "Unassigned").when(key % 29 == 0, "k__Plantae; p__Streptophyta")
            .when(key % 11 == 0, F.concat(F.lit("k__Fungi; p__"), "p_type", F.lit(";o__"), brand)).otherwise(full)
        )
        return self.read("part").select(key.cast("string").alias("feature"), lineage.alias("lineage"))

    @cached_property
    def edits(self) -> DataFrame:
        edited = self.read("part").where(F.col("p_partkey") % 37 == 0)
        return edited.select(F.col("p_partkey").cast("string").alias("feature"), F.lit("k__Metazoa; p__Nematoda").alias("edited"))

    @cached_property
    def guild_db(self) -> DataFrame:
        return self.literal(
            [("ring", "Genus", "|Ectomycorrhizal|"), ("bolt", "Genus", "Saprotroph-|Arbuscular Mycorrhizal|"), ("gizmo", "Genus", "|Endophyte|"),
             ("gear", "Genus", "Undefined"), ("PROMO", "Phylum", "-|Saprotroph|-|Plant Pathogen|")],
            "taxon string, rank_name string, guild string",
        )

    @cached_property
    def dse_list(self) -> DataFrame:
        return self.literal([("widget",), ("widget",), ("widget ",)], "genus string")

    @cached_property
    def meas(self) -> DataFrame:
        def percent(kind: str):
            rate = 100.0 * F.avg(F.when(F.col("event_type") == kind, 1.0).otherwise(0.0))
            return F.when(F.col("user_id") % 13 != 0, rate)

        events = self.read("events")
        half = F.lit("2024-01-16 00:00:00").cast(events.schema["ts"].dataType)
        time = F.when(F.col("ts") < half, "7Months").otherwise("12Months").alias("time")
        grouped = events.groupBy("user_id", time).agg(
            percent("click").alias("ecm"), percent("error").alias("am"), percent("view").alias("endophyte"), F.avg("value").alias("height")
        )
        return grouped.select(
            F.col("user_id").cast("string").alias("subject"),
            F.when(F.col("user_id") % 2 == 0, "A").otherwise("T").alias("species"),
            F.concat(F.lit("S"), (F.col("user_id") % 4).cast("string")).alias("stand"),
            "time", "ecm", "am", "endophyte", "height",
        )

    @cached_property
    def daily(self) -> DataFrame:
        """Events of a user in one half of the time, by day; sign-ups by that name."""
        feature = F.when(F.col("event_type") == "signup", "signup").otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("feature")
        return self._halves().groupBy("sample", feature).agg(F.count(F.lit(1)).alias("n"))

    @cached_property
    def users(self) -> DataFrame:
        user = F.col("user_id")
        return self._halves().select("sample", "user_id", "time").distinct().select(
            "sample", user.alias("pot"), F.when(user % 2 == 0, "A").otherwise("T").alias("species"),
            F.when(user % 11 == 0, "C").otherwise("S").alias("stand"), "time",
        )

    def _halves(self) -> DataFrame:
        events = self.read("events")
        early = F.col("ts") < F.lit("2024-01-16 00:00:00").cast(events.schema["ts"].dataType)
        time = F.when(early, "June20").otherwise("Jan21")
        return events.withColumn("time", time).withColumn("sample", F.concat(F.col("user_id").cast("string"), F.lit("_"), "time"))

    @cached_property
    def days(self) -> analyses.Community:
        """Days and sign-ups as taxa of the users."""
        daily = durable(self.daily)
        taxa = daily.select("feature").distinct().withColumn("genus", F.col("feature"))
        return analyses.Community(daily, ecology.relativize(daily), self.users, taxa, daily)

    @cached_property
    def points(self) -> DataFrame:
        return self.read("embeddings").select(
            F.col("vec_id").alias("id"), F.col("label").alias("grp"),
            (F.lit(-111.75) + 0.05 * F.col("embedding")[0].cast("double")).alias("lon"),
            (F.lit(38.52) + 0.05 * F.col("embedding")[1].cast("double")).alias("lat"),
        )

    @cached_property
    def hits(self) -> DataFrame:
        return self.read("lineitem").select(
            F.col("l_orderkey").alias("query"), F.col("l_partkey").cast("string").alias("subject"),
            F.col("l_extendedprice").alias("score"), F.col("l_linenumber").alias("tie"),
        )

    @cached_property
    def seqs(self) -> DataFrame:
        return self.read("documents").select(F.col("doc_id").alias("read_id"), F.col("source").alias("sample"), F.col("text").alias("seq"))

    @cached_property
    def dna(self) -> DataFrame:
        """Texts spelled in bases between primers: exact, damaged, turned around, or without the end primer."""
        letters = F.regexp_replace(F.lower("text"), "[^a-z]", "")
        core = F.translate(letters, "abcdefghijklmnopqrstuvwxyz", "ACGTACGTACGTACGTACGTACGTAC")
        kind = F.col("doc_id") % 5
        end = ADAPTER_PRIMER[::-1].translate(str.maketrans("ACGT", "TGCA"))
        front = F.when(kind == 1, "T" + FRONT_PRIMER[1:8] + "A" + FRONT_PRIMER[9:]).when(kind == 2, "TTTT" + FRONT_PRIMER[4:]).otherwise(FRONT_PRIMER)
        read = F.concat(front, core, F.when(kind == 4, "").otherwise(end))
        turned = F.translate(F.reverse(read), "ACGT", "TGCA")
        return self.read("documents").select(
            F.col("doc_id").alias("read_id"), F.col("source").alias("sample"), F.when(kind == 3, turned).otherwise(read).alias("seq")
        )

    # -- derived ---------------------------------------------------------------------

    @cached_property
    def tax(self) -> DataFrame:
        return durable(taxonomy.taxonomy_table(relational.apply_overrides(self.tax_raw, self.edits)))

    @cached_property
    def community(self) -> analyses.Community:
        return analyses.import_community(self.counts, self.samples, self.tax_raw, self.edits, self.guild_db, self.dse_list, DEPTH, SEED, store=True)

    @cached_property
    def tax_guild(self) -> DataFrame:
        return self.community.taxonomy

    @cached_property
    def fungal(self) -> DataFrame:
        return relational.filter_features(self.counts, self.tax, F.col("kingdom") == "Fungi")

    @cached_property
    def rare(self) -> DataFrame:
        return self.community.rarefied

    @cached_property
    def rel(self) -> DataFrame:
        return self.community.relative

    @cached_property
    def observed(self) -> DataFrame:
        """Eligible samples that rarefaction kept."""
        return relational.keep_in(relational.eligible_samples(self.samples), self.rare.select("sample"), "sample")

    @cached_property
    def guilds(self) -> DataFrame:
        return ecology.guild_sum(self.rel, self.tax_guild)

    @cached_property
    def genera(self) -> DataFrame:
        """Raw counts per sample and genus, stored: scaling reads them several times."""
        return durable(taxonomy.rollup_rank(self.counts, self.tax, "genus"))

    @cached_property
    def microscopy(self) -> DataFrame:
        """Measurements, one row per subject, time and guild."""
        return relational.unpivot(self.meas, ["subject", "species", "stand", "time"], ["ecm", "am", "endophyte"], "guild", "percent")
