"""Hard negatives by shared candidate lists per cluster of anchors, walked to a certified end.

Anchors are clustered by direction (spherical k-means, fitted on at most ``FIT_ROWS`` of them, all
assigned).  For a cluster with centre c and widest angle w, a candidate x at angle t from c scores at
most |a| |x| cos(max(0, t - w)) with any member a.  Each task sorts its candidates once per cluster by
|x| cos(max(0, t - w)); every member walks that one list in steps and leaves it when no later candidate
can reach the worst score it still needs.  A walk over ``SEED_ROWS`` sampled rows first gives each
member a certified score to start from, so most of a list is never walked; the walk over all rows
then decides alone.  Per anchor and task at most ``k`` rows leave, ranks are taken over all tasks.

Anchors are broadcast in blocks of ``BLOCK_BYTES`` at most, one after the other: candidates are read
where they lie, once per block and walk, and never shuffled; there is no join of all pairs.

Scores are exact integers.  Edge cases: rows without id, label or vector, or with a null, NaN or
infinite component take no part, nor do rows with a component of 2^27 or more (their scores would
not fit 64 bits); vectors meet only vectors of their length; a zero vector scores 0 with all; a row is
another row than an anchor if its id differs; repeated rows count each, equal anchors once; an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ranking import running_totals
from ..runtime import Scratch

FIT_ROWS, CLUSTER_MEMBERS, MAX_CLUSTERS, FIT_ROUNDS = 4096, 64, 512, 10
SEED_ROWS, STEP_ROWS = 8192, 256
BLOCK_BYTES = 16 << 20
LARGEST = 2.0**27
#: sums of products below this are exact in double precision; beyond it 64-bit integers are used
EXACT = 2.0**53
_FOUND = "anchor long, slot int, score long, id long"


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), width)


def _by_width(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch]]:
    """The rows of each vector length."""
    widths = pa.compute.list_value_length(batch.column("vector")).to_numpy(zero_copy_only=False)
    for width in np.unique(widths):
        yield int(width), (batch if (widths == width).all() else batch.filter(pa.array(widths == width)))


def _directions(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = x.astype(np.float64)
    norm = np.sqrt((x * x).sum(axis=1))
    return x / np.maximum(norm, 1e-300)[:, None], norm


def _centres(sample: dict[int, np.ndarray], share: float) -> dict[int, np.ndarray]:
    """Spherical k-means per vector length; ``share`` is the part of all anchors that the sample is."""
    out = {}
    for width, x in sample.items():
        u, norm = _directions(x)
        u = u[norm > 0]
        k = int(min(max(1, round(len(x) / share / CLUSTER_MEMBERS)), MAX_CLUSTERS, max(len(u), 1)))
        if not len(u) or not width:
            out[width] = np.zeros((1, width))
            continue
        c = u[np.linspace(0, len(u) - 1, k).astype(int)]
        for _ in range(FIT_ROUNDS):
            near = (u @ c.T).argmax(axis=1)
            sums = np.zeros_like(c)
            np.add.at(sums, near, u)
            length = np.sqrt((sums * sums).sum(axis=1))
            c = np.where(length[:, None] > 0, sums / np.maximum(length, 1e-300)[:, None], c)
        out[width] = c
    return out


class _Cluster:
    """Members of one cluster inside one block, with the state of their walks."""

    def __init__(self, width: int, centre: np.ndarray, rows: dict[str, np.ndarray]):
        self.width, self.centre, self.number = width, centre, rows["anchor"]
        self.x, self.id, self.label = rows["vector"], rows["id"], rows["label"]
        u, self.norm = _directions(self.x)
        self.wide = float(np.arccos(np.clip(u @ centre, -1, 1)).max()) if width else 0.0
        self.largest = float(np.abs(self.x).max()) if self.x.size else 0.0


def _blocks_of(table: pa.Table, centres: dict[int, np.ndarray]) -> list[_Cluster]:
    clusters = []
    width = pa.compute.list_value_length(table["vector"]).to_numpy()
    group = table["cluster"].to_numpy()
    for w, c in sorted(set(zip(width.tolist(), group.tolist()))):
        part = table.filter(pa.array((width == w) & (group == c)))
        rows = {n: part[n].to_numpy() for n in ("anchor", "id", "label")}
        rows["vector"] = _matrix(part["vector"].combine_chunks(), w)
        clusters.append(_Cluster(w, centres[w][c], rows))
    return clusters


def _scores(a: np.ndarray, x: np.ndarray, exact: bool) -> np.ndarray:
    return a.astype(np.float64) @ x.astype(np.float64).T if exact else (a @ x.T)


def _merged(best: np.ndarray, best_id: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first ``k`` per row, higher scores first, ties by smaller id; dead entries score the lowest."""
    all_score, all_id = np.concatenate([best, score], axis=1), np.concatenate([best_id, ids], axis=1)
    order = np.lexsort((all_id, -all_score), axis=1)[:, :k]
    return np.take_along_axis(all_score, order, axis=1), np.take_along_axis(all_id, order, axis=1)


def _walk(batches: Iterator[pa.RecordBatch], clusters: list[_Cluster], same_label: bool, floors: dict[int, np.ndarray], caps: dict[int, np.ndarray], slots: int, k: int) -> Iterator[pa.RecordBatch]:
    """Each member's first ``k`` rows of this task per slot, at scores from floors to caps of that slot."""
    low = np.iinfo(np.int64).min // 4
    state = []
    for c in clusters:
        shape = (len(c.number), slots)
        state.append((np.full((*shape, k), low, np.int64), np.full((*shape, k), np.iinfo(np.int64).max), floors.get(id(c), np.full(shape, low)).copy(), caps.get(id(c), np.full(shape, -low))))
    for batch in batches:
        for width, part in _by_width(batch):
            x, label, ids = _matrix(part.column("vector"), width), part.column("label").to_numpy(), part.column("id").to_numpy()
            u, norm = _directions(x)
            largest = float(np.abs(x).max()) if x.size else 0.0
            for c, (best, best_id, floor, cap) in zip(clusters, state, strict=True):
                if c.width != width:
                    continue
                apart = np.arccos(np.clip(u @ c.centre, -1, 1)) if width else np.zeros(len(x))
                bound = norm * np.cos(np.maximum(0.0, apart - c.wide))
                order = np.argsort(-bound, kind="stable")
                exact = c.largest * largest * max(width, 1) < EXACT
                live = np.arange(len(c.number))
                for start in range(0, len(order), STEP_ROWS):
                    # what a member still needs: the least over its open slots; a slot with floor above cap is closed
                    need = np.where(floor[live] <= cap[live], floor[live], -low).min(axis=1)
                    live = live[c.norm[live] * bound[order[start]] * (1 + 1e-9) + 1e-6 >= need]
                    if not len(live):
                        break
                    step = order[start : start + STEP_ROWS]
                    score = _scores(c.x[live], x[step], exact).astype(np.int64)
                    alike = c.label[live][:, None] == label[step][None, :]
                    fit = alike & (c.id[live][:, None] != ids[step][None, :]) if same_label else ~alike
                    for s in range(slots):
                        good = fit & (score >= floor[live, s][:, None]) & (score <= cap[live, s][:, None])
                        rows = np.flatnonzero(good.any(axis=1))
                        if not len(rows):
                            continue
                        at = live[rows]
                        best[at, s], best_id[at, s] = _merged(best[at, s], best_id[at, s], np.where(good[rows], score[rows], low), np.broadcast_to(ids[step], (len(rows), len(step))), k)
                        floor[at, s] = np.maximum(floor[at, s], best[at, s, k - 1])
    for c, (best, best_id, _, _) in zip(clusters, state, strict=True):
        member, slot, place = np.nonzero(best > low)
        columns = (c.number[member], slot.astype(np.int32), best[member, slot, place], best_id[member, slot, place])
        yield pa.RecordBatch.from_arrays([pa.array(v) for v in columns], [f.split()[0] for f in _FOUND.split(", ")])


def _first(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class _Miner:
    """The walks of one block of anchors."""

    def __init__(self, rows: DataFrame, seeds: DataFrame, clusters: list[_Cluster], scratch: Scratch):
        self.rows, self.seeds, self.clusters, self.scratch = rows, seeds, clusters, scratch
        self.place = {int(n): (at, i) for at, c in enumerate(clusters) for i, n in enumerate(c.number)}

    def _run(self, rows: DataFrame, same_label: bool, floors: list[np.ndarray], caps: list[np.ndarray], slots: int, k: int) -> DataFrame:
        shared = rows.sparkSession.sparkContext.broadcast((self.clusters, floors, caps))  # one block: bounded by BLOCK_BYTES

        def go(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            clusters, low, high = shared.value
            yield from _walk(batches, clusters, same_label, {id(c): f for c, f in zip(clusters, low)}, {id(c): f for c, f in zip(clusters, high)}, slots, k)

        return _first(rows.mapInArrow(go, _FOUND), k)

    def _filled(self, slots: int, value: int) -> list[np.ndarray]:
        return [np.full((len(c.number), slots), value, np.int64) for c in self.clusters]

    def best(self, same_label: bool, slots: int, k: int, floors: list[np.ndarray] | None = None, caps: list[np.ndarray] | None = None) -> DataFrame:
        """anchor, slot, score, id, rank over all rows, after a walk over the sampled ones."""
        low = np.iinfo(np.int64).min // 4
        floors, caps = floors or self._filled(slots, low), caps or self._filled(slots, -low)
        for r in self._run(self.seeds, same_label, floors, caps, slots, k).where(F.col("rank") == k).select("anchor", "slot", "score").collect():  # a row per member and slot at most
            at, i = self.place[r["anchor"]]
            floors[at][i, r["slot"]] = max(floors[at][i, r["slot"]], r["score"])
        return self.scratch.keep(self._run(self.rows, same_label, floors, caps, slots, k))


def mined(rows: DataFrame, anchors: Column, scratch: Scratch, positives: int = 5, negatives: int = 5, share: tuple[int, int] = (80, 100),
          key: str = "vec_id", vector: str = "embedding", label: str = "label", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``rows`` holds vectors of whole numbers, integer labels and ids; ``anchors`` picks the anchors by
    the columns id and label.  Per anchor and positive: the first rows of other labels whose score is at
    most the positive's, and ``share`` of it at least.
    """
    usable = F.col(key).isNotNull() & F.col(label).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < LARGEST))
    held = scratch.keep(rows.where(F.coalesce(usable, F.lit(False))).select(F.col(key).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<bigint>").alias("vector")))
    picked = scratch.keep(held.where(anchors).distinct())
    size = picked.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vector")).alias("width")).first()
    spark, count = rows.sparkSession, size["n"]
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    if not count:
        return empty
    spread = max(1, math.ceil(count / FIT_ROWS))
    drawn = picked.where(F.pmod(F.xxhash64("id", "vector"), F.lit(spread)) == 0) if spread > 1 else picked
    sample: dict[int, list] = {}
    for r in drawn.select("vector").collect():  # about FIT_ROWS anchors
        sample.setdefault(len(r["vector"]), []).append(r["vector"])
    centres = _centres({w: np.array(v, dtype=np.float64).reshape(len(v), w) for w, v in sample.items()}, 1 / spread)
    for r in picked.select(F.size("vector").alias("w")).distinct().collect():
        centres.setdefault(r["w"], np.zeros((1, r["w"])))
    shared = spark.sparkContext.broadcast(centres)  # MAX_CLUSTERS vectors a length at most

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for width, part in _by_width(batch):
                u, _ = _directions(_matrix(part.column("vector"), width))
                near = (u @ shared.value[width].T).argmax(axis=1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(near)], [*part.schema.names, "cluster"])

    clustered = picked.mapInArrow(assign, "id long, label long, vector array<bigint>, cluster int").withColumns({"width": F.size("vector"), "one": F.lit(1).cast("long")})
    per_block = max(1, block_bytes // (8 * size["width"] + 64 * (positives * negatives + 2)))
    numbered = running_totals(clustered, ["width", "cluster", "id", "label", "vector"], ["one"]).withColumnRenamed("before_one", "anchor")
    numbered = scratch.keep(numbered.select("anchor", "id", "label", "vector", "cluster", F.floor(F.col("anchor") / per_block).alias("block")))
    every = held.count()
    rare = max(1, every // SEED_ROWS)
    seeds = scratch.keep(held.where(F.pmod(F.xxhash64("id", "label", "vector"), F.lit(rare)) == 0))
    out = None
    for b in range(math.ceil(count / per_block)):
        table = numbered.where(F.col("block") == b).select("anchor", "id", "label", "vector", "cluster").toArrow()  # one block
        miner = _Miner(held, seeds, _blocks_of(table, centres), scratch)
        near = miner.best(True, 1, positives)
        low = np.iinfo(np.int64).min // 4
        floors, caps = miner._filled(positives, -low), miner._filled(positives, low)  # closed
        for r in near.select("anchor", "rank", "score").where("score >= 0").collect():  # ``positives`` rows per member
            at, i = miner.place[r["anchor"]]
            caps[at][i, r["rank"] - 1] = r["score"]
            floors[at][i, r["rank"] - 1] = -((-share[0] * r["score"]) // share[1])
        far = miner.best(False, positives, negatives, floors, caps)
        names = numbered.where(F.col("block") == b).select("anchor", F.col("id").alias("anchor_id"))
        pairs = near.select("anchor", (F.col("rank") - 1).alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
        part = far.withColumnsRenamed({"id": "negative_id", "score": "negative_score"}).join(pairs, ["anchor", "slot"]).join(names, "anchor")
        part = part.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")
        out = part if out is None else out.unionByName(part)
    return out


def quantised(rows: DataFrame, scale: int, vector: str = "embedding") -> DataFrame:
    """``rows`` with floor(scale * x) for each component; a row with a component that is no number, or too large, loses its vector."""
    wide = F.transform(vector, lambda x: F.floor(F.when(F.abs(x.cast("double") * scale) < LARGEST, x.cast("double") * scale)))
    return rows.withColumn(vector, F.when(F.forall(wide, lambda x: x.isNotNull()), wide))
