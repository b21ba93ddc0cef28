"""Sequence tables."""

from pyspark.sql import functions as F

from ..operators import relational, sequences
from ..operators.sequences import FRONT_PRIMER, MAX_LENGTH, MIN_LENGTH
from .registry import query
from .sql import END_PRIMER

_FRONTS = f"list_filter(generate_series(1, len(s) - {len(FRONT_PRIMER) - 1}), lambda p: hamming(substr(s, p, {len(FRONT_PRIMER)}), '{FRONT_PRIMER}') <= 2)"
_ENDS = f"list_filter(generate_series(1, len(s) - {len(END_PRIMER) - 1}), lambda p: hamming(substr(s, p, {len(END_PRIMER)}), '{END_PRIMER}') <= 2)"
# both directions of every read, the first direction with both primers wins
TRIMMED = f"""WITH {{fixtures}}, ways AS (SELECT read_id, sample, 0 AS turned, seq AS s FROM dna UNION ALL SELECT read_id, sample, 1, translate(reverse(seq), 'ACGT', 'TGCA') FROM dna),
    spans AS (SELECT *, list_min({_FRONTS}) + {len(FRONT_PRIMER)} AS lo, list_max({_ENDS}) AS hi FROM ways),
    good AS (SELECT * FROM spans WHERE lo <= hi),
    trimmed AS (SELECT read_id, sample, min_by(substr(s, lo, hi - lo), turned) AS seq FROM good GROUP BY 1, 2)"""


@query("trim_primers", f"{TRIMMED} SELECT read_id, sample, seq FROM trimmed")
def _(t):
    return sequences.trim_primers(t.dna)


@query("length_filter", f"{TRIMMED} SELECT read_id, sample, seq FROM trimmed WHERE length(seq) BETWEEN {MIN_LENGTH} AND {MAX_LENGTH}")
def _(t):
    return sequences.length_filter(sequences.trim_primers(t.dna))


@query("dereplicate", "SELECT sample, md5(seq) AS feature, count(*) AS n FROM seqs GROUP BY 1, 2")
def _(t):
    return sequences.dereplicate(t.seqs)


@query("representative_sequences", "SELECT DISTINCT md5(seq) AS feature, seq FROM seqs")
def _(t):
    return sequences.representatives(t.seqs)


_ANY, _NONE = ("license", "with", "from"), ("this", "than", "ther")


@query("text_query_filter", f"SELECT read_id, sample, length(seq) AS letters FROM seqs WHERE regexp_matches(seq, '(?i)\\b({'|'.join(_ANY)})\\b') AND NOT regexp_matches(seq, '(?i)\\b({'|'.join(_NONE)})\\b')")
def _(t):
    kept = relational.filter_reference(t.seqs, "seq", _ANY, _NONE)
    return kept.select("read_id", "sample", F.length("seq").cast("long").alias("letters"))
