"""Sequence tables: primers, lengths, dereplication."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import reverse_complement

# The primer pair and limits of the sequencing recipe.
FRONT_PRIMER, ADAPTER_PRIMER = "ACCCGCTGAACTTAAGC", "TCCTGAGGGAAACTTCG"
MAX_MISMATCH, MIN_LENGTH, MAX_LENGTH = 2, 700, 1600

BYTES_PER_SCAN = 1 << 24


def _primer_ends(letters: np.ndarray, starts: np.ndarray, ends: np.ndarray, primer: bytes, max_mm: int) -> tuple[np.ndarray, np.ndarray]:
    """First and last place in each read (of reads laid end to end) where ``primer`` fits; -1 for none."""
    first, last = np.full(len(starts), -1), np.full(len(starts), -1)
    places = len(letters) - len(primer) + 1
    if places < 1:
        return first, last
    wrong = np.zeros(places, dtype=np.uint8)
    for offset, letter in enumerate(primer):
        wrong += letters[offset: offset + places] != letter
    at = np.flatnonzero(wrong <= max_mm)
    read = np.searchsorted(starts, at, side="right") - 1
    whole = at + len(primer) <= ends[read]
    at, read = at[whole], read[whole]
    last[read] = at - starts[read]
    first[read[::-1]] = (at - starts[read])[::-1]
    return first, last


def trim_primers(
    reads: DataFrame, front: str = FRONT_PRIMER, adapter: str = ADAPTER_PRIMER, max_mm: int = MAX_MISMATCH
) -> DataFrame:
    """Sequence between the front primer and the reverse complement of the adapter primer.

    A read that lacks either primer is tried as its reverse complement, then dropped.  The
    first front match and the last adapter match count.  Only positions leave the pandas
    function, which scans its reads together; cutting and turning stay in the JVM.
    """
    pairing = str.maketrans("ACGT", "TGCA")
    turned_front, end = (p[::-1].translate(pairing).encode() for p in (front, adapter))

    @F.pandas_udf("struct<turned: boolean, from: int, to: int>")
    def between(seqs: pd.Series) -> pd.DataFrame:
        parts = []
        texts = [b"" if s is None else s.encode("ascii", "replace") for s in seqs]
        while texts:
            size, taken = 0, 0
            while taken < len(texts) and (not taken or size + len(texts[taken]) <= BYTES_PER_SCAN):
                size += len(texts[taken])
                taken += 1
            parts.append(_spans(texts[:taken]))
            texts = texts[taken:]
        out = pd.concat(parts, ignore_index=True) if parts else pd.DataFrame(columns=["turned", "from", "to"])
        return out.astype({"turned": "bool", "from": "Int32", "to": "Int32"})

    def _spans(texts: list[bytes]) -> pd.DataFrame:
        letters = np.frombuffer(b"".join(texts), dtype=np.uint8)
        ends = np.cumsum([len(x) for x in texts])
        starts = ends - np.array([len(x) for x in texts])
        low, high = _primer_ends(letters, starts, ends, front.encode(), max_mm)[0], _primer_ends(letters, starts, ends, end, max_mm)[1]
        forward = (low >= 0) & (low + len(front) <= high)
        # in a turned read the adapter comes first and the front primer last, both on the other strand
        t_low = _primer_ends(letters, starts, ends, adapter.encode(), max_mm)[0]
        t_high = _primer_ends(letters, starts, ends, turned_front, max_mm)[1]
        turned = ~forward & (t_low >= 0) & (t_low + len(adapter) <= t_high)
        kept = forward | turned
        return pd.DataFrame({
            "turned": turned,
            "from": pd.array(np.where(turned, t_low + len(adapter), low + len(front)), dtype="Int64"),
            "to": pd.array(np.where(turned, t_high, high), dtype="Int64"),
        }).assign(**{"from": lambda d: d["from"].where(kept), "to": lambda d: d["to"].where(kept)})

    found = reads.withColumn("_span", between("seq")).where(F.col("_span.from").isNotNull())
    inner = F.substr("seq", F.col("_span.from") + 1, F.col("_span.to") - F.col("_span.from"))
    cut = found.withColumn("seq", inner)
    return cut.withColumn("seq", F.when(F.col("_span.turned"), reverse_complement(F.col("seq"))).otherwise(F.col("seq"))).drop("_span")


def length_filter(reads: DataFrame, low: int = MIN_LENGTH, high: int = MAX_LENGTH) -> DataFrame:
    return reads.where(F.length("seq").between(low, high))


def dereplicate(reads: DataFrame) -> DataFrame:
    """``(sample, feature, n)`` with the md5 of the sequence as feature id."""
    return reads.groupBy("sample", F.md5("seq").alias("feature")).agg(F.count(F.lit(1)).alias("n"))


def representatives(reads: DataFrame) -> DataFrame:
    """One sequence per feature id."""
    return reads.select(F.md5("seq").alias("feature"), "seq").distinct()
