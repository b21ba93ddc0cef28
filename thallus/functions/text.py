"""String columns: ids, lineages, guild labels, sequences."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rank order and label formats that the input files use.
RANKS = ("kingdom", "phylum", "class", "order", "family", "genus", "species")
UNASSIGNED = "Unassigned"
RANK_PREFIX = r".+__"
LAST_PIPED = r".*\|(.*?)\|.*"
BARCODE_PATTERN, BARCODE_REPLACEMENT = ".*bc", "bc"


def normalize_id(col: Column, pattern: str = BARCODE_PATTERN, repl: str = BARCODE_REPLACEMENT) -> Column:
    """Rewrite an id by regex.  Greedy default: everything up to the last barcode mark goes."""
    return F.regexp_replace(col, pattern, repl)


def lineage_pieces(lineage: Column, sep: str = ";") -> Column:
    """Array of rank names by position, each without its ``x__`` prefix."""
    return F.transform(F.split(lineage, sep), lambda piece: F.regexp_replace(piece, RANK_PREFIX, ""))


def binomial(genus: Column, species: Column) -> Column:
    """``Genus_species`` when both are known, blanks as underscores."""
    both = genus.isNotNull() & species.isNotNull()
    return F.replace(F.when(both, F.concat_ws("_", genus, species)).otherwise(species), F.lit(" "), F.lit("_"))


def last_piped(label: Column) -> Column:
    """Text between the last pair of pipes; NULL when there is no pipe."""
    return F.when(label.contains("|"), F.regexp_replace(label, LAST_PIPED, "$1"))


def without_prefix(col: Column, prefix: str) -> Column:
    """``col`` without a leading ``prefix`` (kept as is when absent)."""
    return F.when(col.startswith(prefix), F.substring(col, len(prefix) + 1, 2**31 - 1 - len(prefix))).otherwise(col)


def paste(*cols: Column, sep: str = "_") -> Column:
    """Join columns with ``sep``; a missing value becomes the text ``NA``."""
    return F.concat_ws(sep, *[F.coalesce(c.cast("string"), F.lit("NA")) for c in cols])


def manifest_name(name: Column) -> Column:
    """First underscore to a dot, the next one to a double dash."""
    return F.regexp_replace(F.regexp_replace(name, "^([^_]*)_", "$1."), "^([^_]*)_", "$1--")


def reverse_complement(seq: Column) -> Column:
    return F.translate(F.reverse(seq), "ACGT", "TGCA")
