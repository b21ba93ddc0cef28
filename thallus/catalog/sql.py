"""The same fixtures as SQL, for the checking engine; a query's text gets those it names."""

from __future__ import annotations

import re

from ..functions.text import RANKS
from ..operators.sequences import ADAPTER_PRIMER, FRONT_PRIMER

END_PRIMER = ADAPTER_PRIMER[::-1].translate(str.maketrans("ACGT", "TGCA"))


def quoted(rank: str) -> str:
    return f'"{rank}"' if rank == "order" else rank


_PIECES = ", ".join(
    f"regexp_replace(string_split(lineage, ';')[{i}], '.+__', '') AS {quoted(r)}" for i, r in enumerate(RANKS, start=1)
)

FIXTURES: dict[str, str] = {
    "counts": """SELECT concat(CAST(l_suppkey AS VARCHAR), '_', l_linestatus) AS sample,
        CAST(l_partkey AS VARCHAR) AS feature, count(*) AS n FROM lineitem GROUP BY 1, 2""",
    "yearly": """SELECT concat(CAST(l_suppkey AS VARCHAR), '_', CAST(year(l_shipdate) AS VARCHAR)) AS sample,
        CAST(l_partkey AS VARCHAR) AS feature, count(*) AS n FROM lineitem GROUP BY 1, 2""",
    "samples": """SELECT concat(CAST(d.l_suppkey AS VARCHAR), '_', d.l_linestatus) AS sample, d.l_suppkey AS pot,
        CASE WHEN d.l_suppkey % 50 = 49 THEN 'Neg' WHEN d.l_suppkey % 2 = 0 THEN 'A' ELSE 'T' END AS species,
        CASE WHEN n.n_regionkey = 4 THEN 'C' ELSE concat('S', CAST(n.n_regionkey AS VARCHAR)) END AS stand,
        CASE WHEN d.l_linestatus = 'F' THEN 'June20' ELSE 'Jan21' END AS time,
        CASE WHEN d.l_suppkey % 50 = 49 THEN NULL ELSE s.s_acctbal / 10000 END AS field_soil
        FROM (SELECT DISTINCT l_suppkey, l_linestatus FROM lineitem) d
        JOIN supplier s ON s.s_suppkey = d.l_suppkey JOIN nation n ON n.n_nationkey = s.s_nationkey""",
    "tax_raw": """SELECT CAST(p_partkey AS VARCHAR) AS feature,
        CASE WHEN p_partkey % 41 = 0 THEN 'Unassigned' WHEN p_partkey % 29 = 0 THEN 'k__Plantae; p__Streptophyta'
        WHEN p_partkey % 11 = 0 THEN concat('k__Fungi; p__', p_type, ';o__', p_brand)
        ELSE concat('k__Fungi; p__', p_type, '; c__', p_brand, '; o__', p_brand, 'ales;f__', p_brand, 'aceae; g__',
        regexp_replace(p_name, '^.* ', ''), '; s__', p_name) END AS lineage FROM part""",
    "edits": "SELECT CAST(p_partkey AS VARCHAR) AS feature, 'k__Metazoa; p__Nematoda' AS edited FROM part WHERE p_partkey % 37 = 0",
    "guild_db": """SELECT 'ring' AS taxon, 'genus' AS rank_name, '|Ectomycorrhizal|' AS guild
        UNION ALL SELECT 'bolt', 'genus', 'Saprotroph-|Arbuscular Mycorrhizal|' UNION ALL SELECT 'gizmo', 'genus', '|Endophyte|'
        UNION ALL SELECT 'gear', 'genus', 'Undefined' UNION ALL SELECT 'PROMO', 'phylum', '-|Saprotroph|-|Plant Pathogen|'""",
    "dse_list": "SELECT 'widget' AS genus UNION ALL SELECT 'widget' UNION ALL SELECT 'widget '",
    "meas": """SELECT CAST(user_id AS VARCHAR) AS subject, CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'T' END AS species,
        concat('S', CAST(user_id % 4 AS VARCHAR)) AS stand,
        CASE WHEN ts < TIMESTAMP '2024-01-16 00:00:00' THEN '7Months' ELSE '12Months' END AS time,
        CASE WHEN user_id % 13 = 0 THEN NULL ELSE 100.0 * avg(CASE WHEN event_type = 'click' THEN 1e0 ELSE 0e0 END) END AS ecm,
        CASE WHEN user_id % 13 = 0 THEN NULL ELSE 100.0 * avg(CASE WHEN event_type = 'error' THEN 1e0 ELSE 0e0 END) END AS am,
        CASE WHEN user_id % 13 = 0 THEN NULL ELSE 100.0 * avg(CASE WHEN event_type = 'view' THEN 1e0 ELSE 0e0 END) END AS endophyte,
        avg(value) AS height FROM events GROUP BY 1, 2, 3, 4, user_id % 13""",
    "daily": """SELECT concat(CAST(user_id AS VARCHAR), '_', CASE WHEN ts < TIMESTAMP '2024-01-16 00:00:00' THEN 'June20' ELSE 'Jan21' END) AS sample,
        CASE WHEN event_type = 'signup' THEN 'signup' ELSE strftime(ts, '%Y-%m-%d') END AS feature, count(*) AS n FROM events GROUP BY 1, 2""",
    "users": """SELECT DISTINCT concat(CAST(user_id AS VARCHAR), '_', CASE WHEN ts < TIMESTAMP '2024-01-16 00:00:00' THEN 'June20' ELSE 'Jan21' END) AS sample, user_id AS pot,
        CASE WHEN user_id % 2 = 0 THEN 'A' ELSE 'T' END AS species, CASE WHEN user_id % 11 = 0 THEN 'C' ELSE 'S' END AS stand,
        CASE WHEN ts < TIMESTAMP '2024-01-16 00:00:00' THEN 'June20' ELSE 'Jan21' END AS time FROM events""",
    "points": """SELECT vec_id AS id, label AS grp, -111.75 + 0.05 * CAST(embedding[1] AS DOUBLE) AS lon,
        38.52 + 0.05 * CAST(embedding[2] AS DOUBLE) AS lat FROM embeddings""",
    "hits": "SELECT l_orderkey AS query, CAST(l_partkey AS VARCHAR) AS subject, l_extendedprice AS score, l_linenumber AS tie FROM lineitem",
    "seqs": "SELECT doc_id AS read_id, source AS sample, text AS seq FROM documents",
    "dna_parts": f"""SELECT doc_id, source, CASE doc_id % 5 WHEN 1 THEN 'T{FRONT_PRIMER[1:8]}A{FRONT_PRIMER[9:]}' WHEN 2 THEN 'TTTT{FRONT_PRIMER[4:]}'
        ELSE '{FRONT_PRIMER}' END || translate(regexp_replace(lower(text), '[^a-z]', '', 'g'), 'abcdefghijklmnopqrstuvwxyz', 'ACGTACGTACGTACGTACGTACGTAC')
        || CASE WHEN doc_id % 5 = 4 THEN '' ELSE '{END_PRIMER}' END AS built FROM documents""",
    "dna": """SELECT doc_id AS read_id, source AS sample,
        CASE WHEN doc_id % 5 = 3 THEN translate(reverse(built), 'ACGT', 'TGCA') ELSE built END AS seq FROM dna_parts""",
    "edited_tax": "SELECT feature, coalesce(e.edited, r.lineage) AS lineage FROM tax_raw r LEFT JOIN edits e USING (feature)",
    "pieces": f"SELECT feature, {_PIECES} FROM edited_tax",
    "tax": """SELECT feature, CASE WHEN kingdom <> 'Unassigned' THEN kingdom END AS kingdom, phylum, class, "order", family, genus,
        replace(CASE WHEN genus IS NOT NULL AND species IS NOT NULL THEN concat(genus, '_', species) ELSE species END, ' ', '_') AS species FROM pieces""",
    "guild_hit": """SELECT feature, max_by(guild, no) AS guild FROM (
        SELECT feature, 1 AS no, 'kingdom' AS rank_name, kingdom AS taxon FROM tax UNION ALL SELECT feature, 2, 'phylum', phylum FROM tax
        UNION ALL SELECT feature, 3, 'class', class FROM tax UNION ALL SELECT feature, 4, 'order', "order" FROM tax
        UNION ALL SELECT feature, 5, 'family', family FROM tax UNION ALL SELECT feature, 6, 'genus', genus FROM tax)
        JOIN guild_db USING (rank_name, taxon) GROUP BY feature""",
    "tax_guild": r"""SELECT t.*, g.guild, CASE WHEN t.genus IN (SELECT genus FROM dse_list) THEN 'DSE'
        WHEN contains(g.guild, '|') THEN regexp_replace(g.guild, '.*\|(.*?)\|.*', '\1') END AS primary_guild
        FROM tax t LEFT JOIN guild_hit g USING (feature)""",
    "fungal": "SELECT c.* FROM counts c SEMI JOIN (SELECT feature FROM tax WHERE kingdom = 'Fungi') t USING (feature)",
    "rare": """SELECT sample, feature, count(*) AS n FROM (
        SELECT sample, feature, row_number() OVER (PARTITION BY sample ORDER BY md5(concat_ws('|', sample, feature, CAST(i AS VARCHAR), '67'))) AS rk
        FROM (SELECT f.sample, f.feature, unnest(generate_series(1, f.n)) AS i FROM fungal f
              JOIN (SELECT sample FROM fungal GROUP BY 1 HAVING sum(n) >= 275) USING (sample))) WHERE rk <= 275 GROUP BY 1, 2""",
    "rel": "SELECT sample, feature, n, CAST(n AS DOUBLE) / CAST(sum(n) OVER (PARTITION BY sample) AS DOUBLE) AS rel FROM rare",
    "eligible": "SELECT * FROM samples WHERE stand <> 'C' AND species <> 'Neg'",
    "observed": "SELECT * FROM eligible SEMI JOIN rare USING (sample)",
    "guilds": """SELECT sample, CASE WHEN primary_guild IN ('Ectomycorrhizal', 'Arbuscular Mycorrhizal') THEN primary_guild
        WHEN primary_guild IN ('DSE', 'Endophyte') OR genus = 'Ilyonectria' THEN 'TotalEndophyte' ELSE 'Other' END AS guild, sum(rel) AS abundance
        FROM rel LEFT JOIN tax_guild USING (feature) GROUP BY 1, 2""",
    "genera": "SELECT sample, coalesce(genus, 'Unassigned') AS taxon, CAST(sum(n) AS BIGINT) AS n FROM counts LEFT JOIN tax USING (feature) GROUP BY 1, 2",
    "microscopy": """SELECT subject, species, stand, time, guild, percent FROM (
        SELECT *, unnest(['ecm', 'am', 'endophyte']) AS guild, unnest([ecm, am, endophyte]) AS percent FROM meas)""",
}


def with_fixtures(body: str) -> str:
    """``body`` after a WITH clause of the fixtures it needs, in dependency order.

    ``{fixtures}`` inside the body marks where the clause goes when the body has CTEs of
    its own (``WITH {fixtures}, mine AS ...``).
    """
    needed: list[str] = []

    def visit(text: str) -> None:
        for name, definition in FIXTURES.items():
            if name not in needed and re.search(rf"\b(?:FROM|JOIN)\s+{name}\b", text):
                visit(definition)
                needed.append(name)

    visit(body)
    clause = ", ".join(f"{n} AS ({FIXTURES[n]})" for n in needed)
    if "{fixtures}" in body:
        return body.replace("{fixtures}", clause)
    return f"WITH {clause} {body}" if clause else body


def t_tail_sql(t: str, df: str) -> str:
    """Two-sided tail of Student's t: Simpson's rule over 2,000 intervals of the density."""
    steps = f"list_sum(list_transform(range(0, 2001), lambda i: (CASE WHEN i IN (0, 2000) THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * pow(1 + ((i * abs({t}) / 2000e0) ** 2) / ({df}), -(({df}) + 1) / 2e0)))"
    return f"(1 - 2 * exp(lgamma((({df}) + 1) / 2e0) - lgamma(({df}) / 2e0)) / sqrt(({df}) * pi()) * {steps} * abs({t}) / 2000e0 / 3)"
