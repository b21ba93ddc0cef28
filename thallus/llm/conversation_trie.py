"""Prefix trie of conversations, totals by time-forward processing.

Conversations are sequences of (role, text); each distinct prefix is a node.  A node's key is the
exclusive-or of one 128-bit hash per (place, role, SHA-256 of the text) on its path, so keys come
out of running aggregates: turns are range-partitioned by (conversation, turn), slices get offsets,
and a conversation that holds a third of all rows is numbered and hashed by many tasks.

Totals of subtrees travel upwards.  A node with one member heads a chain, whose totals are known at
once; it enters its parent as one leaf.  The nodes that are shared are cut into shards: a shard is a
highest subtree with at most ``SHARD_ROWS`` (conversation, turn) pairs below it.  A task reads its
shards in reverse level order, sorted by Spark; each node takes the totals that wait under its key in
a priority queue, and sends its own on to its parent.  What the shard roots send is summed per parent,
and the few nodes above them are processed likewise.  Beyond ``QUEUE_ROWS`` messages the queue writes
sorted runs to a file without a name that lives and dies with its task; nobody else reads it.

Edge cases: rows without a conversation id belong to none and take no part; null roles and texts are
empty; null turns come first, equal turns are ordered by role, then SHA-256 of the text, repeated
rows are turns of their own; a conversation whose rebuilt form has no turns is a member of the root
only; an empty table has no nodes; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import SLICE, running_totals
from ..runtime import Scratch

#: a shard has at most so many (conversation, turn) pairs, or this part of all of them if that is more:
#: then no level has more than 1 / SHARD_SHARE nodes above the shards
SHARD_ROWS, SHARD_SHARE = 20_000, 1 / 50_000
QUEUE_ROWS, RUN_ROWS = 200_000, 4096
#: nodes above the shards that may be broadcast to find the shards' roots; more are joined by a shuffle
BROADCAST_NODES = 100_000
KEY = ["p", "k1", "k2"]
MAX_HEAD = 5


class SpillingQueue:
    """Smallest tuple first.  Holds ``limit`` tuples in memory; the others wait in sorted runs on disk."""

    def __init__(self, limit: int = QUEUE_ROWS):
        self.limit, self.heap, self.heads, self.spilled = limit, [], [], 0

    def push(self, item: tuple) -> None:
        heapq.heappush(self.heap, item)
        if len(self.heap) > self.limit:
            run = self._written(sorted(self.heap))
            self.heap, self.spilled = [], self.spilled + 1
            heapq.heappush(self.heads, (next(run), self.spilled, run))

    def _written(self, rows: list[tuple]) -> Iterator[tuple]:
        file = tempfile.TemporaryFile()
        for at in range(0, len(rows), RUN_ROWS):
            pickle.dump(rows[at : at + RUN_ROWS], file, protocol=pickle.HIGHEST_PROTOCOL)
        end = file.tell()
        file.seek(0)

        def read() -> Iterator[tuple]:
            with file:
                while file.tell() < end:
                    yield from pickle.load(file)

        return read()

    def pop_through(self, key: tuple) -> Iterator[tuple]:
        """Takes out all tuples that begin with ``key`` or less."""
        width = len(key)
        while True:
            own = self.heap[0] if self.heap else None
            if self.heads and (own is None or self.heads[0][0] < own):
                item, number, run = self.heads[0]
                if item[:width] > key:
                    return
                following = next(run, None)
                if following is None:
                    heapq.heappop(self.heads)
                else:
                    heapq.heapreplace(self.heads, (following, number, run))
                yield item
            elif own is not None and own[:width] <= key:
                yield heapq.heappop(self.heap)
            else:
                return


_TOTALS = "p int, k1 long, k2 long, n_children long, n_leaves long, saved_tokens long"


def time_forward(batches: Iterator[pa.RecordBatch], limit: int = QUEUE_ROWS) -> Iterator[pa.RecordBatch]:
    """Totals of nodes that arrive in reverse level order, (p descending, k1, k2).

    Columns: p, k1, k2, pk1, pk2, top (its totals leave the task), own (its own saved tokens), and what
    it has received already: children, leaves, saved.
    """
    queue = SpillingQueue(limit)
    for batch in batches:
        rows: list[tuple] = []
        for p, k1, k2, pk1, pk2, top, saved, children, leaves, more in zip(*[batch.column(c).to_pylist() for c in _NODE], strict=True):
            saved += more
            for message in queue.pop_through((-p, k1, k2)):
                children, leaves, saved = children + 1, leaves + message[3], saved + message[4]
            leaves = leaves or 1
            rows.append((p, k1, k2, children, leaves, saved))
            if not top:
                queue.push((1 - p, pk1, pk2, leaves, saved))
        columns = list(zip(*rows, strict=True)) or [()] * 6
        kinds = [pa.int32(), *[pa.int64()] * 5]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [f.split()[0] for f in _TOTALS.split(", ")])


_NODE = ["p", "k1", "k2", "pk1", "pk2", "top", "own", "children", "leaves", "saved"]


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of each node's ids; rows arrive sorted by (node, id), so only a running hash is held."""
    open_key, running, done = None, None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        p, k1, k2, ids = (batch.column(c).to_numpy(zero_copy_only=False) for c in (*KEY, "conv"))
        starts = np.flatnonzero(np.r_[True, (p[1:] != p[:-1]) | (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1])])
        for a, b in zip(starts, [*starts[1:], len(p)], strict=True):
            key, text = (int(p[a]), int(k1[a]), int(k2[a])), ",".join(map(str, ids[a:b].tolist())).encode()
            if key == open_key:
                running.update(b"," + text)
                continue
            if open_key is not None:
                done.append((*open_key, running.hexdigest()))
            open_key, running = key, hashlib.sha256(text)
        yield _digest_rows(done)
        done = []
    if open_key is not None:
        yield _digest_rows([(*open_key, running.hexdigest())])


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 4
    kinds = (pa.int32(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], [*KEY, "ends_sha256"])


def _element(place: Column, one: Column, two: Column) -> tuple[Column, Column]:
    return F.xxhash64(place.cast("int"), one, two), F.xxhash64(F.lit(1), place.cast("int"), two, one)


def ordered_turns(rows: DataFrame, scratch: Scratch, ident: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv, i (from 0), two hashes of (role, text), chars (code points of the text), and the slice of the order."""
    said = F.coalesce(F.col(text), F.lit(""))
    turns = rows.where(F.col(ident).isNotNull()).select(
        F.col(ident).cast("long").alias("conv"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.sha2(said, 256).alias("digest"), F.char_length(said).cast("long").alias("chars"), F.lit(1).cast("long").alias("one"),
    )
    numbered = running_totals(turns, ["turn", "role", "digest"], ["one"], ["conv"])
    hashes = [F.xxhash64("role", "digest").alias("c1"), F.xxhash64(F.lit(1), "role", "digest").alias("c2")]
    return scratch.keep(numbered.select("conv", F.col("before_one").cast("int").alias("i"), *hashes, "chars", SLICE))


def rebuilt_prefixes(turns: DataFrame, base: Column, borrowed: Column, scratch: Scratch) -> DataFrame:
    """conv, p, len, node key (k1, k2), parent key (pk1, pk2), chars: every prefix of every rebuilt conversation, p = 0 included.

    A conversation is rebuilt as the first ``borrowed`` (at most MAX_HEAD) turns of conversation ``base``,
    then its own turns after as many; both are expressions of ``conv``.
    """
    first = F.sort_array(F.collect_list(F.when(F.col("i") < MAX_HEAD, F.struct("i", "c1", "c2", "chars"))))
    convs = scratch.keep(turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n"), first.alias("first")))
    lent = convs.select(F.col("conv").alias("base"), F.col("first").alias("lent"))
    empty = F.slice("first", 1, 0)
    joined = convs.select("conv", "n", "first", base.alias("base"), borrowed.cast("int").alias("h")).join(lent, "base", "left")
    joined = joined.withColumn("head", F.slice(F.coalesce("lent", empty), F.lit(1), F.col("h")))
    hashed = F.transform("head", lambda x, j: F.struct(*[e.alias(f"e{m}") for m, e in enumerate(_element(j + 1, x["c1"], x["c2"]), 1)], x["chars"].alias("chars")))
    joined = joined.select("conv", "h", hashed.alias("head"), F.size("head").alias("b"), (F.size("head") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("len"))

    def folded(name: str, part: Column) -> Column:
        return F.aggregate(F.transform(part, lambda x: x[name]), F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(x))

    heads = scratch.keep(joined.select("*", folded("e1", F.col("head")).alias("x1"), folded("e2", F.col("head")).alias("x2")))
    nothing = F.lit(None).cast("long")
    roots = heads.select("conv", F.lit(0).alias("p"), "len", F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), nothing.alias("pk1"), nothing.alias("pk2"), F.lit(0).cast("long").alias("chars"))
    dealt = heads.select("conv", "len", "head", F.posexplode("head").alias("j", "e"))
    keys = [folded(f"e{m}", F.slice("head", F.lit(1), F.col("j") + shift)).alias(name) for shift, name, m in ((1, "k1", 1), (1, "k2", 2), (0, "pk1", 1), (0, "pk2", 2))]
    begun = dealt.select("conv", (F.col("j") + 1).alias("p"), "len", *keys, F.col("e.chars").alias("chars"))

    own = turns.join(heads.select("conv", "h", "b", "len", "x1", "x2"), "conv").where("i >= h").withColumn("p", (F.col("i") - F.col("h") + F.col("b") + 1).cast("int"))
    e1, e2 = _element(F.col("p"), F.col("c1"), F.col("c2"))
    own = scratch.keep(own.select("conv", "p", "len", "x1", "x2", "chars", SLICE, e1.alias("e1"), e2.alias("e2")))
    totals = own.groupBy("conv", SLICE).agg(F.bit_xor("e1").alias("t1"), F.bit_xor("e2").alias("t2"))
    earlier = Window.partitionBy("conv").orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("conv", SLICE, *[F.coalesce(F.bit_xor(f"t{m}").over(earlier), F.lit(0)).alias(f"o{m}") for m in (1, 2)])
    inside = Window.partitionBy("conv", SLICE).orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    placed = own.join(offsets, ["conv", SLICE]).select("*", F.bit_xor("e1").over(inside).alias("s1"), F.bit_xor("e2").over(inside).alias("s2"))
    placed = placed.withColumns({f"k{m}": F.col(f"x{m}").bitwiseXOR(F.col(f"o{m}")).bitwiseXOR(F.col(f"s{m}")) for m in (1, 2)})
    grown = placed.select("conv", "p", "len", "k1", "k2", *[F.col(f"k{m}").bitwiseXOR(F.col(f"e{m}")).alias(f"pk{m}") for m in (1, 2)], "chars")
    return scratch.keep(roots.unionByName(begun).unionByName(grown))


def _processed(nodes: DataFrame, limit: int, *shard: str) -> DataFrame:
    dealt = nodes.repartition(*shard) if shard else nodes.repartition(1)
    return dealt.sortWithinPartitions(F.desc("p"), "k1", "k2").select(*_NODE).mapInArrow(lambda b: time_forward(b, limit), _TOTALS)


def trie(paths: DataFrame, scratch: Scratch, shard_rows: int = SHARD_ROWS, shard_share: float = SHARD_SHARE, queue_rows: int = QUEUE_ROWS) -> DataFrame:
    """One row per node of ``rebuilt_prefixes``: conv_id, depth, parent_conv_id, n_convs, n_children,
    n_leaves, saved_tokens, ends_sha256."""
    last = F.col("p") == F.col("len")
    nodes = scratch.keep(paths.groupBy(*KEY).agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("conv_id"), F.max("pk1").alias("pk1"), F.max("pk2").alias("pk2"), F.max("chars").alias("chars"),
        F.count_if(last).alias("n_ends"), F.min(F.when(last, F.col("conv"))).alias("end_conv"), F.sum(F.col("len") - F.col("p") + 1).alias("below"),
    ))
    pairs = nodes.agg(F.coalesce(F.sum("n_convs"), F.lit(0))).first()[0]
    most = max(shard_rows, int(pairs * shard_share))
    single = nodes.where("n_convs = 1")
    chains = single.where("p > 0").groupBy((F.col("p") - 1).alias("p"), F.col("pk1").alias("k1"), F.col("pk2").alias("k2")).agg(F.count(F.lit(1)).alias("chains"))
    shared = scratch.keep(
        nodes.where("n_convs > 1").join(chains, KEY, "left")
        .select(*nodes.columns, F.coalesce("chains", F.lit(0)).alias("children"), ((F.col("n_convs") - 1) * F.col("chars")).alias("own"))
    )
    above = scratch.keep(shared.where(F.col("below") > most))
    marks = above.select(*KEY, F.lit(True).alias("above"))
    marks = F.broadcast(marks) if above.count() <= BROADCAST_NODES else marks
    entries = paths.join(marks, KEY, "left").where("above IS NULL").groupBy("conv").agg(F.min_by(F.struct("k1", "k2"), "p").alias("entry"))
    light = shared.where(F.col("below") <= most).join(entries.withColumnRenamed("conv", "conv_id"), "conv_id")
    light = light.withColumns({"r1": F.col("entry.k1"), "r2": F.col("entry.k2")})
    light = scratch.keep(light.select(
        *KEY, "pk1", "pk2", "r1", "r2", ((F.col("k1") == F.col("r1")) & (F.col("k2") == F.col("r2"))).alias("top"), "own", "children", F.col("children").alias("leaves"), F.lit(0).cast("long").alias("saved"),
    ))
    within = scratch.keep(_processed(light, queue_rows, "r1", "r2"))
    roots = light.where("top AND p > 0").select(*KEY, "pk1", "pk2").join(within, KEY)
    sent = roots.groupBy((F.col("p") - 1).alias("p"), F.col("pk1").alias("k1"), F.col("pk2").alias("k2")).agg(
        F.count(F.lit(1)).alias("m_children"), F.sum("n_leaves").alias("m_leaves"), F.sum("saved_tokens").alias("m_saved"))
    zero = F.lit(0)
    heads = above.join(sent, KEY, "left").select(
        *KEY, "pk1", "pk2", (F.col("p") == 0).alias("top"), "own", (F.col("children") + F.coalesce("m_children", zero)).alias("children"),
        (F.col("children") + F.coalesce("m_leaves", zero)).alias("leaves"), F.coalesce("m_saved", zero).alias("saved"),
    )
    across = scratch.keep(_processed(heads, queue_rows))
    known = shared.select(*KEY, "conv_id", "pk1", "pk2", "n_convs", "n_ends", "end_conv").join(within.unionByName(across), KEY)
    known = scratch.keep(known)
    lone = single.select(
        *KEY, "conv_id", "pk1", "pk2", "n_convs", "n_ends", "end_conv", (F.col("below") > 1).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), F.lit(0).cast("long").alias("saved_tokens"),
    )
    parents = known.select((F.col("p") + 1).alias("p"), F.col("k1").alias("pk1"), F.col("k2").alias("pk2"), F.col("conv_id").alias("parent"))
    joined = known.unionByName(lone).join(parents, ["p", "pk1", "pk2"], "left")
    several = known.where("n_ends > 1").select(*KEY)
    ending = paths.where(last).select(*KEY, "conv").join(several, KEY).repartition(*KEY).sortWithinPartitions(*KEY, "conv")
    listed = ending.mapInArrow(_digests, "p int, k1 long, k2 long, ends_sha256 string")
    joined = joined.join(listed, KEY, "left")
    few = F.sha2(F.coalesce(F.col("end_conv").cast("string"), F.lit("")), 256)
    return joined.select(
        "conv_id", F.col("p").cast("long").alias("depth"), F.when(F.col("p") > 0, F.coalesce("parent", "conv_id")).alias("parent_conv_id"),
        "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", few).alias("ends_sha256"),
    )


def conversation_trie(rows: DataFrame, scratch: Scratch, base: Column, borrowed: Column, **limits) -> DataFrame:
    """The trie of the conversations of ``rows``, rebuilt by ``base`` and ``borrowed`` (expressions of ``conv``)."""
    return trie(rebuilt_prefixes(ordered_turns(rows, scratch), base, borrowed, scratch), scratch, **limits)
