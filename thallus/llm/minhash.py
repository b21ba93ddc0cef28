"""Near-duplicate documents by SetSketch registers.

A document is the set of its distinct runs of five words.  Register i holds the exponentially
spaced, truncated minimum of one exponential variate per element: floor(1 - log_b(minimum)),
kept within 0..q+1.  Registers merge by maximum and agree with a probability close to the
Jaccard similarity (b is close to 1), so runs of registers are banded into buckets.  Candidates
pass a joint likelihood test on their registers, which drops a pair only if the data speak
against the threshold by more than ``SLACK`` nats, and are then verified on the full sets.

Texts with equal sets form one class and enter once.  A candidate of
whose shingles too many occur in no other candidate can reach no one's threshold and leaves.
Inside a bucket no list of pairs is made: a few leaders (centres first) are compared with the
members of other components, links are merged into components, leaders that have met everybody
leave, and the number of leaders grows fourfold, until every bucket holds one component.  So a bucket of
near copies costs about one comparison each, and still no pair of different components goes
unexamined.  Before a leader and a member become a pair, their sizes, the shingles they can have in
common and the parities of their shingles must leave room for the threshold: exact bounds that
lose no link.

Edge cases: texts without words (null, empty, blanks) link with nothing; fewer words than a
shingle make one shingle of the whole text; equal texts are linked; rows that share a doc_id are
one document; a null doc_id links with nothing and is kept; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Scratch
from .common import WordHashes, components, mix, text_slices
from .text_stats import WINDOW, windows

#: bands of eight: two texts of similarity 0.85 miss each other with 4e-5, of 0.5 meet with 0.12
REGISTERS, BANDS = 256, 32
BASE, RATE, TOP = 1.001, 20.0, 65_534  # the sketch's b, a and q
SLACK = 20.0
SEED = 5
THRESHOLD = (80, 100)
#: Ids of candidates and keys of buckets are broadcast up to this size (KEY_BYTES each), joined by a shuffle beyond it.
BROADCAST_BYTES, KEY_BYTES = 64 << 20, 24
#: Each round takes so many times the leaders of the one before.
MORE_LEADERS = 4
#: Longs of a text's parities: bit i tells whether an odd number of its shingles has hash i modulo 64 * PARITIES.
PARITIES = 8


def shingles(text: str | None, known: WordHashes, words: int = WINDOW) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``words`` words (A-Z lower-cased)."""
    hashes = known.of((text or "").encode().lower().split())
    if 0 < len(hashes) < words:
        total = np.full(1, np.uint64(len(hashes)))
        for h in hashes:
            total = mix(total * np.uint64(0x9E3779B97F4A7C15) + h)
        return total
    return np.unique(windows(hashes, words))


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """uint16 registers, one row per (non-empty) set."""
    draw = np.random.default_rng(SEED)
    turn = draw.integers(0, 1 << 63, REGISTERS, dtype=np.uint64)
    odd = draw.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    elements = np.concatenate(sets)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    lowest = np.empty((len(sets), REGISTERS), np.uint64)
    for i in range(REGISTERS):
        lowest[:, i] = np.minimum.reduceat((elements ^ turn[i]) * odd[i], starts)
    with np.errstate(divide="ignore"):
        least = -np.log1p(-(lowest.astype(np.float64) + 0.5) / 2.0**64) / RATE
        level = np.floor(1 - np.log(least) / np.log(BASE))
    return np.clip(level, 0, TOP + 1).astype("<u2")


def band_keys(levels: np.ndarray) -> np.ndarray:
    """int64 bucket keys, one per band."""
    parts = levels.astype(np.uint64).reshape(len(levels), BANDS, -1)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(parts.shape[2]):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return key.view(np.int64)


def sketches(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, set_key, registers, bands (the last three null for an empty set)."""

    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        known = WordHashes()
        for part in text_slices(batches, text):
            sets = [shingles(t, known) for t in part.column(text).to_pylist()]
            full = [s for s in sets if len(s)]
            levels = registers(full) if full else np.zeros((0, REGISTERS), "<u2")
            keys = band_keys(levels)
            at = np.cumsum([len(s) > 0 for s in sets]) - 1
            own = [int(a) if len(s) else None for a, s in zip(at, sets, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(key), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                    pa.array([levels[i].tobytes() if i is not None else None for i in own], pa.binary()),
                    pa.array([keys[i] if i is not None else None for i in own], pa.list_(pa.int64())),
                ],
                [key, "n_shingles", "set_key", "registers", "bands"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(sketch, f"{key} {kind}, n_shingles long, set_key binary, registers binary, bands array<long>")


def plausible(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, threshold: float, slack: float = SLACK) -> np.ndarray:
    """Whether the registers' joint likelihood leaves room for a similarity of ``threshold``."""
    up, down = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    same = a.shape[1] - up - down
    u, v = (n_a / (n_a + n_b))[:, None], (n_b / (n_a + n_b))[:, None]
    most = np.minimum(u / v, v / u)
    grid = np.linspace(0, 1, 41)[None, :] * most
    above = threshold + np.linspace(0, 1, 21)[None, :] * np.maximum(most - threshold, 0)

    def p(x: np.ndarray) -> np.ndarray:
        return -np.log(1 - np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    def likelihood(j: np.ndarray) -> np.ndarray:
        more, less = p(u - v * j), p(v - u * j)
        tiny = 1e-12
        return up * np.log(more + tiny) + down * np.log(less + tiny) + same * np.log(np.maximum(1 - more - less, tiny))

    return likelihood(grid).max(axis=1) - likelihood(above).max(axis=1) <= slack


def parities(elements: np.ndarray) -> np.ndarray:
    """int64 parities of a set.  Two sets differ in at least as many elements as their parities differ in bits."""
    odd = np.bincount((elements % np.uint64(64 * PARITIES)).astype(np.int64), minlength=64 * PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _sets(docs: DataFrame, key: str, text: str) -> DataFrame:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for part in text_slices(batches, text, 1 << 20):
            found = [shingles(t, known) for t in part.column(text).to_pylist()]
            ends = pa.array(np.cumsum([0, *map(len, found)]).astype(np.int32))
            odd = pa.array([parities(f) for f in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([part.column(key), pa.ListArray.from_arrays(ends, pa.array(np.concatenate(found).view(np.int64))), odd], ["id", "elements", "odd"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(make, f"id {kind}, elements array<long>, odd array<long>")


def _verified(pairs: DataFrame, reps: DataFrame, sets: DataFrame, threshold: tuple[int, int], scratch: Scratch) -> DataFrame:
    """Those (a, b) whose full sets reach the threshold."""
    num, den = threshold
    side = lambda s: reps.select(F.col("id").alias(s), F.col("n_shingles").alias(f"n_{s}"), F.col("registers").alias(f"r_{s}"))
    sized = pairs.join(side("a"), "a").join(side("b"), "b").where(den * F.least("n_a", "n_b") >= num * F.greatest("n_a", "n_b"))

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            for at in range(0, part.num_rows, 2048):
                some = part.slice(at, 2048)
                r_a, r_b = (np.frombuffer(b"".join(some.column(c).to_pylist()), "<u2").reshape(-1, REGISTERS) for c in ("r_a", "r_b"))
                n_a, n_b = (some.column(c).to_numpy().astype(float) for c in ("n_a", "n_b"))
                keep = pa.array(plausible(r_a, r_b, n_a, n_b, num / den))
                yield some.select(["a", "b"]).filter(keep)

    likely = sized.select("a", "b", "n_a", "n_b", "r_a", "r_b").mapInArrow(estimate, pairs.schema).distinct()
    of = lambda s: sets.select(F.col("id").alias(s), F.col("elements").alias(f"e_{s}"))
    both = likely.join(of("a"), "a").join(of("b"), "b")
    common = F.size(F.array_intersect("e_a", "e_b"))
    return scratch.keep(both.where(den * common >= num * (F.size("e_a") + F.size("e_b") - common)).select("a", "b"))


def _measured(keys: DataFrame) -> DataFrame:
    """A stored column of keys, broadcast if it is counted to be small."""
    return F.broadcast(keys) if keys.count() * KEY_BYTES <= BROADCAST_BYTES else keys


def _mixed(members: DataFrame, root: str = "id") -> DataFrame:
    """Buckets that hold different values of ``root``."""
    return members.groupBy("bucket").agg(F.min(root).alias("lo"), F.max(root).alias("hi")).where("lo <> hi").select("bucket")


def _crowded(members: DataFrame, root: str = "id") -> DataFrame:
    """Members of the buckets that hold different values of ``root``."""
    return members.join(_mixed(members, root), "bucket", "left_semi")


def near_duplicates(docs: DataFrame, scratch: Scratch, threshold: tuple[int, int] = THRESHOLD, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_shingles, component_id, kept: documents linked at ``threshold`` (a fraction) or above."""
    num, den = threshold
    odd = [f"odd{k}" for k in range(PARITIES)]
    docs = docs.select(key, text)
    sketched = scratch.keep(sketches(docs, key, text))
    usable = sketched.where(F.col(key).isNotNull() & (F.col("n_shingles") > 0))
    classes = scratch.keep(usable.groupBy("set_key").agg(F.min(key).alias("id")))
    reps = usable.join(classes, "set_key").where(F.col(key) == F.col("id"))
    reps = scratch.keep(reps.select("id", "n_shingles", "registers", "bands"))
    banded = reps.select("id", F.explode("bands").alias("bucket"))
    buckets = scratch.keep(_mixed(banded))
    members = scratch.keep(banded.join(_measured(buckets), "bucket", "left_semi").distinct())
    # only candidates are compared: texts and registers of all others stay where they are
    ids = scratch.keep(members.select("id").distinct())
    candidates = _measured(ids)
    sets = scratch.keep(_sets(docs.join(candidates.select(F.col("id").alias(key)), key, "left_semi"), key, text))
    known = scratch.keep(reps.join(candidates, "id", "left_semi").select("id", "n_shingles", "registers"))
    scratch.drop(reps, buckets)
    # ``core``: shingles that some other candidate has too; no intersection of a text is larger
    lonely = sets.select("id", F.explode("elements").alias("e")).groupBy("e").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("n"))
    lonely = lonely.where("n = 1").groupBy("id").agg(F.count(F.lit(1)).alias("alone"))
    size, one = F.size("elements"), (F.min("odd") == F.max("odd")) & (F.min(F.size("elements")) == F.max(F.size("elements")))
    # an id with several texts: bounds that hold for each of them, and no parities
    cores = sets.groupBy("id").agg(F.min(size).cast("long").alias("n"), F.sum(size).alias("all"), F.when(one, F.min("odd")).alias("odd"))
    cores = cores.join(lonely, "id", "left").withColumn("core", F.col("all") - F.coalesce("alone", F.lit(0)))
    cores = cores.select("id", "n", "core", *[F.get("odd", F.lit(k)).alias(p) for k, p in enumerate(odd)])
    told = members.join(cores, "id")
    about = told.groupBy("bucket").agg(F.count(F.lit(1)).alias("met"), F.min("n").alias("least_n"))
    told = told.join(about, "bucket")
    degree = told.groupBy("id").agg(F.sum("met").alias("degree"))
    # the best similarity in this bucket: the whole core in common with a text as small as any here
    told = told.where(den * F.col("core") >= num * (F.col("n") + F.greatest("least_n", "core") - F.col("core")))
    told = told.select("bucket", "id", "n", "core", *odd).join(degree, "id")
    live = scratch.keep(_crowded(told.select("bucket", "id", F.col("id").alias("root"), "degree", "n", "core", *odd)))
    scratch.drop(members)
    scratch.tidy()
    links, tested, roots, leaders_per_bucket = None, None, None, 1
    while live.limit(1).count():
        # texts of small components first, and among them those that meet many others: the centre of a family
        together = live.groupBy("bucket", "root").agg(F.count(F.lit(1)).alias("together"))
        place = F.pmod(F.xxhash64("id", F.lit(leaders_per_bucket)), F.lit(leaders_per_bucket))
        order = F.struct("together", (-F.col("degree")).alias("degree"), "id", "root", "n", "core", *odd)
        leaders = live.join(together, ["bucket", "root"]).groupBy("bucket", place.alias("_place")).agg(F.min(order).alias("l"))
        leaders = scratch.keep(leaders.select("bucket", *[f"l.{c}" for c in ("id", "root", "n", "core", *odd)]))
        other = leaders.select("bucket", *[F.col(c).alias(f"l_{c}") for c in ("id", "root", "n", "core", *odd)]).withColumnRenamed("l_id", "l")
        common = F.least("core", "l_core")
        both = F.col("n") + F.col("l_n")
        differ = sum((F.bit_count(F.col(p).bitwiseXOR(F.col(f"l_{p}"))) for p in odd), F.lit(0))
        near = (den * common >= num * (both - common)) & F.coalesce(den * (both - differ) >= num * (both + differ), F.lit(True))
        met = live.join(other, "bucket").where((F.col("root") != F.col("l_root")) & near)
        pairs = met.select(F.least("id", "l").alias("a"), F.greatest("id", "l").alias("b")).distinct()
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = scratch.keep(pairs)
        found = _verified(pairs, known, sets, threshold, scratch)
        tested = pairs if tested is None else scratch.keep(tested.unionAll(pairs))
        if found.limit(1).count():
            links = found if links is None else scratch.keep(links.unionAll(found))
            roots = scratch.keep(components(links, scratch))
        rest = live.join(leaders, ["bucket", "id"], "left_anti")
        if roots is not None:
            rest = rest.drop("root").join(roots, rest["id"] == roots["node"], "left")
        rest = rest.select("bucket", "id", F.coalesce("root", "id").alias("root"), "degree", "n", "core", *odd)
        after = scratch.keep(_crowded(rest, "root"))
        scratch.drop(live, leaders)
        scratch.tidy()
        live, leaders_per_bucket = after, leaders_per_bucket * MORE_LEADERS
    # rows that share a key are one document: their classes belong together
    named = usable.join(classes, "set_key").select(key, "id").distinct()
    lowest = named.groupBy(key).agg(F.min("id").alias("b"), F.max("id").alias("top")).where("b <> top").select(key, "b")
    same = scratch.keep(named.join(lowest, key).where("id <> b").select(F.col("id").alias("a"), "b"))
    if same.limit(1).count():
        roots = scratch.keep(components(same if links is None else links.unionAll(same), scratch))
    placed = sketched.select(key, "n_shingles", "set_key").join(classes, "set_key", "left")
    if roots is not None:
        placed = placed.join(roots, placed["id"] == roots["node"], "left").withColumn("id", F.coalesce("root", "id"))
    component = F.when(F.col(key).isNotNull(), F.coalesce("id", key))
    out = placed.select(key, "n_shingles", component.alias("component_id"))
    scratch.drop(sets, known, ids)
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))
