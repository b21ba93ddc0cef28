"""What several corpus operators share: batches of texts, word hashes, ranks, components."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import Scratch

BATCH_BYTES = 4 << 20
RANK_ROWS = 20_000
M1, M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_33 = np.uint64(33)


def documents(spark: SparkSession, folder: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def text_slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about ``limit`` bytes of text (one longer text makes a slice of its own)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes + 16)
        start = 0
        while start < batch.num_rows:
            done = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
            yield batch.slice(start, stop - start)
            start = stop


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit (a public finalizer)."""
    values = values ^ (values >> _33)
    values = values * M1
    values ^= values >> _33
    values = values * M2
    values ^= values >> _33
    return values


class WordHashes(dict):
    """word (bytes) -> 64-bit hash; forgets all when it holds ``limit`` words."""

    def __init__(self, limit: int = 400_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: Sequence[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[str], scratch: Scratch, name: str = "rank", rows: int = RANK_ROWS) -> DataFrame:
    """``df`` stored, with each row's place (from 0) in the order of its ``by`` group.

    ``order`` starts with a column of evenly spread 64-bit numbers.  A group is cut into equal
    ranges of that number, about ``rows`` rows each; a window only ever spans one range, and
    the range totals give the offsets.  A group that holds a third of all rows is thus ranked
    by many tasks.  There must be ``by`` columns, and they must not be null.
    """
    held = scratch.keep(df)
    sizes = held.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    cuts = sizes.select(*by, (F.floor(F.col("_n") / rows) + 1).alias("_cuts"))
    unit = (F.col(order[0]).cast("double") + 2.0**63) / 2.0**64
    placed = held.join(cuts, list(by)).withColumn("_range", F.least(F.floor(unit * F.col("_cuts")), F.col("_cuts") - 1))
    totals = placed.groupBy(*by, "_range").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*by, "_range", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_offset"))
    inside = Window.partitionBy(*by, "_range").orderBy(*order)
    out = placed.join(totals, [*by, "_range"])
    return out.select(*df.columns, (F.col("_offset") + F.row_number().over(inside) - 1).alias(name))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root): the smallest node that each node of ``edges`` (a, b) reaches.

    Alternates two steps until neither changes anything: every node hangs its larger
    neighbours on its smallest one, then its smaller neighbours and itself likewise.  Groups
    are only ever minimised and joined on, never collected, and each round is stored.
    """
    links = scratch.keep(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    before = None
    while True:
        both = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lowest = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.join(lowest, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("e"))
        new = scratch.keep(small.select(F.col("e.a").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct())
        now = new.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        scratch.drop(links)
        links = new
        if now == before:
            break
        before = now
    roots = links.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionAll(roots.select(F.col("root").alias("node"), "root").distinct())
