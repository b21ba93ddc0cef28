"""A uniform random shuffle into shards whose sizes are exact.

How many rows of each input partition go to each shard is drawn first: row by row of a matrix
whose margins are the partition and shard sizes (a multivariate hypergeometric draw; it is what
a uniform shuffle of all rows would show).  Rows are permuted inside their partition, cut at the
drawn counts, exchanged, and permuted again inside their shard.  Given the matrix, no task needs
to know of any other.

The driver sees one count per input partition and draws partitions x shards numbers; rows stay
in Spark and in SQL expressions.  Law ``rows``: shard sizes differ by at most one row.

Edge cases: a null text has size 8 and the checksum of an empty one; null ids, equal texts and
repeated rows are rows like others (each row has a number of its own); with fewer rows than
shards the first shards get one each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import math
import random

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import Scratch
from .common import ranked

SHARDS, SEED = 24, 20


def _log_choose(n: int, k: int) -> float:
    return math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1)


def hypergeometric(marked: int, others: int, drawn: int, luck: random.Random) -> int:
    """How many of ``drawn`` items out of marked + others are marked: inversion outwards from the mode."""
    low, high = max(0, drawn - others), min(drawn, marked)
    if low == high:
        return low
    mode = min(high, max(low, (drawn + 1) * (marked + 1) // (marked + others + 2)))
    peak = math.exp(_log_choose(marked, mode) + _log_choose(others, drawn - mode) - _log_choose(marked + others, drawn))
    left = luck.random() - peak
    down, up, p_down, p_up = mode, mode, peak, peak
    while left > 0 and (down > low or up < high):
        if up < high:
            p_up *= (marked - up) * (drawn - up) / ((up + 1) * (others - drawn + up + 1))
            up += 1
            left -= p_up
            if left <= 0:
                return up
        if down > low:
            p_down *= down * (others - drawn + down) / ((marked - down + 1) * (drawn - down + 1))
            down -= 1
            left -= p_down
            if left <= 0:
                return down
    return mode


def communication_matrix(partitions: dict[int, int], shards: int, seed: int) -> list[tuple[int, int, int, int]]:
    """(partition, shard, from, to): the cut of each partition's permuted rows."""
    luck = random.Random(seed)
    total = sum(partitions.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    cuts = []
    for part in sorted(partitions):
        rows, at, free = partitions[part], 0, sum(room)
        for shard in range(shards):
            if not rows:
                break
            k = hypergeometric(room[shard], free - room[shard], rows, luck)
            free -= room[shard]
            rows -= k
            room[shard] -= k
            if k:
                cuts.append((part, shard, at, at + k))
            at += k
    return cuts


def shuffled(rows: DataFrame, scratch: Scratch, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """``rows`` (without the columns of their texts) with ``shard`` and ``slot``.

    The rows are stored with their partition and number, so a task that runs again sees the same.
    """
    spark = rows.sparkSession
    numbered = scratch.keep(rows.select("*", F.spark_partition_id().cast("long").alias("_part"), F.monotonically_increasing_id().alias("_nth")))
    sizes = {r["_part"]: r["n"] for r in numbered.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    cuts = json.dumps([dict(zip(("p", "s", "lo", "hi"), c, strict=True)) for c in communication_matrix(sizes, shards, seed)])
    kind = "array<struct<p:bigint,s:int,lo:bigint,hi:bigint>>"
    matrix = spark.range(1).select(F.inline(F.from_json(F.lit(cuts), kind)))
    owners = matrix.groupBy(F.col("p").alias("_part")).agg(F.collect_list(F.struct("s", "lo", "hi")).alias("_cuts"))
    # permute locally
    local = ranked(numbered.withColumn("_key", F.xxhash64("_nth", F.lit(seed))), ["_part"], ["_key", "_nth"], scratch, "_at")
    own = F.filter("_cuts", lambda c: (c["lo"] <= F.col("_at")) & (F.col("_at") < c["hi"]))[0]
    dealt = local.join(owners, "_part").withColumn("shard", own["s"])
    # exchange, and permute again
    dealt = dealt.withColumn("_key", F.xxhash64("_nth", F.lit(seed + 1)))
    return ranked(dealt.select(*rows.columns, "shard", "_key", "_nth"), ["shard"], ["_key", "_nth"], scratch, "slot").select(*rows.columns, "shard", "slot")


def text_size(text: Column) -> Column:
    """UTF-8 bytes of a text plus 8 for its row."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")
