import pytest
from conftest import values

from pyspark.sql import functions as F

from thallus import sources
from thallus.functions import text
from thallus.operators import relational, taxonomy
from thallus.plans import analyses
from thallus.runtime import durable


def write(path, content, encoding="utf-8"):
    path.write_text(content, encoding=encoding)
    return str(path)


def test_tsv_blanks_quotes_and_trailing_space(spark, tmp_path):
    path = write(tmp_path / "m.txt", 'genus\tsource\tvalue\nCadophora\t"a, b"\t1.5\nLeptodontidium \t\t\n')
    schema = "genus string, source string, value double"
    rows = values(sources.read_tsv(spark, path, schema))
    assert rows == [("Cadophora", "a, b", 1.5), ("Leptodontidium ", "", None)]
    trimmed = sources.read_tsv(spark, path, schema, trim=True)
    assert ("Leptodontidium",) in values(trimmed, "genus")


def test_feature_table_with_preamble(spark, tmp_path):
    path = write(tmp_path / "t.tsv", "# Constructed from biom file\n#OTU ID\ts_bc1\ts_bc2\ts_bc3\nf1\t0\t2.0\t0\nf2\t3\t0\t1\nf3\t0\t0\t0\n")
    df = sources.read_feature_table(spark, path)
    assert values(df, "sample", "feature", "n") == [("s_bc1", "f2", 3), ("s_bc2", "f1", 2), ("s_bc3", "f2", 1)]
    assert values(df.select(text.normalize_id(F.col("sample")).alias("s")).distinct()) == [("bc1",), ("bc2",), ("bc3",)]


def test_feature_table_round_trip_and_layout(spark, tmp_path):
    counts = spark.createDataFrame([("b", "f1", 2), ("a", "f2", 3), ("c", "f2", 10), ("d", "f1", 1)], "sample string, feature string, n long")
    lines = {r.feature: r.value for r in sources.feature_table_lines(counts).collect()}
    assert lines["f1"] == "f1\t0\t2\t0\t1"
    assert lines["f2"] == "f2\t3\t0\t10\t0"
    assert lines[""].split("\n")[1] == "#OTU ID\ta\tb\tc\td"
    path = str(tmp_path / "wide")
    sources.write_feature_table(counts, path)
    assert values(sources.read_feature_table(spark, path)) == values(counts)


def test_points_with_byte_order_mark(spark, tmp_path):
    path = write(tmp_path / "c.csv", "﻿SampleID,Stand,TreeID,DateSampled,Longitude,Latitude,Altitude\nA201,A,201,9/9/2019,-111.748162,38.526738,2697.626\n")
    df = sources.read_points(spark, path)
    assert df.columns[0] == "SampleID"
    assert values(df, "SampleID", "lon", "lat", "alt") == [("A201", -111.748162, 38.526738, 2697.626)]


def test_fastq_counts_include_empty_files(spark, tmp_path):
    write(tmp_path / "a.fastq", "@r\nACGT\n+\nIIII\n" * 3)
    write(tmp_path / "b.fastq", "")
    assert values(sources.count_fastq_records(spark, str(tmp_path / "*.fastq")), "file", "reads") == [("a.fastq", 3), ("b.fastq", 0)]


def test_manifest_names_and_exclusion(spark):
    lists = spark.createDataFrame([("demultiplex_bc1001_bc1002", "june"), ("demultiplex_bc1069_bc1069", "jan")], "name string, batch string")
    dirs = spark.createDataFrame([("june", "/w/june"), ("jan", "/w/jan")], "batch string, dir string")
    excluded = spark.createDataFrame([("demultiplex.bc1069--bc1069",)], "name string")
    assert values(relational.build_manifest(lists, dirs, excluded)) == [
        ("demultiplex.bc1001--bc1002", "/w/june/demultiplex.bc1001--bc1002.fastq")
    ]


def test_lineages_by_position(spark):
    rows = [
        ("f1", "k__Fungi; p__Ascomycota; c__Pezizomycetes; o__Pezizales; f__Pezizaceae"),
        ("f2", "k__Metazoa; p__Nematoda"), ("f3", "Unassigned"),
        ("f4", "k__Fungi; p__Ascomycota;o__Helotiales"), ("f5", "k__Fungi;p__B;c__C;o__O;f__F;g__Tuber;s__sp one"), ("f6", None),
    ]
    tax = taxonomy.taxonomy_table(spark.createDataFrame(rows, "feature string, lineage string"))
    got = {r.feature: r for r in tax.collect()}
    assert got["f1"].family == "Pezizaceae" and got["f1"].genus is None
    assert got["f3"].kingdom is None and got["f6"].kingdom is None
    assert got["f4"]["class"] == "Helotiales" and got["f4"].order is None
    assert got["f5"].species == "Tuber_sp_one"


def test_lineages_are_split_once_on_many_tasks(spark):
    df = spark.createDataFrame([("f", "k__Fungi;p__B")], "feature string, lineage string")
    plan = taxonomy.parse_lineage(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1 and "RepartitionByExpression" in plan


def test_stored_community_does_not_split_lineages_again(spark):
    frames = {
        "counts": (("s", "f", 9), "sample string, feature string, n long"), "samples": (("s", "A"), "sample string, species string"),
        "tax_raw": (("f", "k__Fungi;p__B"), "feature string, lineage string"), "edits": (("x", "k__Metazoa"), "feature string, edited string"),
        "guild_db": (("B", "Phylum", "|Endophyte|"), "taxon string, rank_name string, guild string"), "endophytes": (("widget",), "genus string"),
    }
    community = analyses.import_community(**{name: spark.createDataFrame([row], schema) for name, (row, schema) in frames.items()}, depth=5, store=True)
    assert "split(" not in community.taxonomy._jdf.queryExecution().optimizedPlan().toString()
    assert [(r.feature, r.kingdom, r.primary_guild) for r in community.taxonomy.collect()] == [("f", "Fungi", "Endophyte")]
    assert values(community.rarefied, "sample", "feature", "n") == [("s", "f", 5)]


def test_too_many_ranks_is_an_error(spark):
    import pytest

    df = spark.createDataFrame([("f", "a;b;c;d;e;f;g;h")], "feature string, lineage string")
    with pytest.raises(Exception, match="too many ranks"):
        taxonomy.parse_lineage(df).collect()


def test_guild_by_most_specific_rank_and_override(spark):
    tax = spark.createDataFrame(
        [("f1", "Fungi", "Asco", "Tuber"), ("f2", "Fungi", "Asco", "Exophiala"), ("f3", "Fungi", "Basidio", None)],
        "feature string, kingdom string, phylum string, genus string",
    ).withColumns({c: F.lit(None).cast("string") for c in ("class", "order", "family", "species")})
    lookup = spark.createDataFrame(
        [("Asco", "Phylum", "|Saprotroph|"), ("Tuber", "Genus", "-|Plant|-|Ectomycorrhizal|"), ("Fungi", "Kingdom", "none")],
        "taxon string, rank_name string, guild string",
    )
    listed = spark.createDataFrame([("Exophiala",), ("Exophiala",)], "genus string")
    out = taxonomy.primary_guild(taxonomy.assign_by_rank(tax, lookup), listed)
    assert values(out, "feature", "guild", "primary_guild") == [
        ("f1", "-|Plant|-|Ectomycorrhizal|", "Ectomycorrhizal"), ("f2", "|Saprotroph|", "DSE"), ("f3", "none", None)
    ]


def test_taxa_are_not_broadcast_to_meet_the_guilds(spark, monkeypatch):
    columns = ["feature", *text.RANKS]
    rows = [(f"f{i}", "Fungi", *[None] * 4, "Tuber" if i % 3 == 0 else "Cadophora", None) for i in range(30)] + [("f0", "Fungi", *[None] * 6), (None, None, *[None] * 6)]
    tax = durable(spark.createDataFrame(rows, ", ".join(f"`{c}` string" for c in columns)))
    lookup = spark.createDataFrame([("Tuber", "Genus", "|Ectomycorrhizal|"), ("Fungi", "Kingdom", "none")], "taxon string, rank_name string, guild string")
    want = sorted([(f, {"Tuber": "|Ectomycorrhizal|"}.get(g, "none")) for f, _, _, _, _, _, g, _ in rows[:30]] + [("f0", "|Ectomycorrhizal|"), (None, None)], key=repr)
    for most, join in ((taxonomy.LOOKUP_ROWS, "BroadcastHashJoin [name"), (1, "SortMergeJoin [name")):
        monkeypatch.setattr(taxonomy, "LOOKUP_ROWS", most)
        out = taxonomy.assign_by_rank(tax, lookup)
        by_rank = [line for line in out._jdf.queryExecution().sparkPlan().toString().split("\n") if "Join [name" in line]
        assert len(by_rank) == 1 and join in by_rank[0] and "BuildLeft" not in by_rank[0]
        assert values(out, "feature", "guild") == want


def test_consensus_needs_a_majority(spark):
    hits = spark.createDataFrame([("q", s, 10.0 - i, i) for i, s in enumerate("aaabbc")] + [("r", "a", 1.0, 1), ("r", "d", 1.0, 2)], "query string, subject string, score double, tie int")
    raw = spark.createDataFrame([("a", "k__F; p__A; g__X"), ("b", "k__F;p__A; g__Y"), ("c", "k__F; p__B"), ("d", "k__M")], "feature string, lineage string")
    got = {r.query: (r.lineage, r.depth) for r in taxonomy.consensus_taxonomy(hits, raw).collect()}
    assert got == {"q": ("k__F; p__A", 2), "r": ("Unassigned", 0)}
    assert taxonomy.consensus_taxonomy(hits, raw, max_hits=3).where("query = 'q'").first().lineage == "k__F; p__A; g__X"


def test_feature_table_is_stored_compressed_and_sorted_before_it_is_wide(spark, tmp_path):
    counts = spark.range(400).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("sample"), F.concat(F.lit("f"), (F.col("id") * 7 % 300).cast("string")).alias("feature"), (F.col("id") + 1).alias("n"))
    path = tmp_path / "wide"
    sources.write_feature_table(counts, str(path))
    assert sum(f.stat().st_size for f in path.iterdir() if f.name.startswith("part-")) < 400 * 300 * 2 / 10
    assert values(sources.read_feature_table(spark, str(path))) == values(counts)


def test_feature_table_cells_as_written(spark, tmp_path):
    path = write(tmp_path / "t.tsv", "#OTU ID\ta\tb\tc\nfä\t0\t00\t7\nonly\n\n# note\nf2\t0.0\t1e2\t0\n")
    assert values(sources.read_feature_table(spark, path), "sample", "feature", "n") == [("b", "f2", 100), ("c", "fä", 7)]
    from pyspark.errors import PySparkException

    for bad in ("f\t\t1\t0\n", "f\t0\t0\t\n", "f\t0\tx\t0\n"):
        broken = write(tmp_path / "broken.tsv", "#OTU ID\ta\tb\tc\n" + bad)
        with pytest.raises(PySparkException):
            sources.read_feature_table(spark, broken).collect()


def test_consensus_makes_no_row_per_prefix(spark):
    hits = spark.createDataFrame([("q", "a", 3.0, 1), ("q", "b", 2.0, 2), ("q", "n", 1.0, 3), ("r", "n", 1.0, 1), (None, "a", 1.0, 1), ("t", "a", 1.0, 1), ("t", "c", 1.0, 2)],
                                 "query string, subject string, score double, tie int")
    raw = spark.createDataFrame([("a", "k__F; p__A;g__X"), ("b", "k__F;p__A ; g__Y"), ("c", "k__P"), ("n", None)], "feature string, lineage string")
    df = taxonomy.consensus_taxonomy(hits, raw)
    got = {r.query: (r.lineage, r.depth, r.share and round(r.share, 6)) for r in df.collect()}
    assert got == {"q": ("k__F; p__A", 2, 0.666667), None: ("k__F; p__A; g__X", 3, 1.0), "t": ("Unassigned", 0, None)}
    assert "Generate" not in df._jdf.queryExecution().optimizedPlan().toString()
