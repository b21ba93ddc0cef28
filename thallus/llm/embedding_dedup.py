"""Near-duplicate vectors by an exact metric range join.

On unit vectors a cosine of at least c is a Euclidean distance of at most e = sqrt(2 - 2c).
Inside a label, pivots (a hash sample of its vectors) partition the space; every vector has the
cell of its nearest pivot as its home and is copied to each other cell that the triangle
inequality cannot rule out: if x has home p and lies within e of y, then y is at most e on the
wrong side of the plane between p and any other pivot, and at most e farther from p than the
farthest vector of the cell.  Cells then join independently, home vectors against all vectors of
the cell, in blocks of bounded size; a block returns counts and a spanning set of links, never
its pairs.

Edge cases: vectors that are null, empty, zero or hold null or non-finite components, and rows
with a null label or id, link with nothing and are kept; vectors of different length do not
link; equal vectors of one label form one class and are all linked; rows that share a vec_id
count as vectors of their own but as one in the components; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Scratch
from .common import components

COSINE = 0.93
CELL_ROWS, MAX_PIVOTS, BLOCK_ROWS = 1024, 4096, 2048
MARGIN = 1e-9


def _unit(column: pa.Array) -> np.ndarray:
    rows = np.array(column.to_pylist(), dtype=np.float64)
    return rows / np.linalg.norm(rows, axis=1)[:, None]


def _usable(vector, label, key):
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(label.isNotNull() & key.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _with_cells(vectors: DataFrame, pivots: dict, radius: dict | None, reach: float) -> DataFrame:
    """home cell and its distance (``radius`` None), or all cells that a vector may have partners in."""
    shared = vectors.sparkSession.sparkContext.broadcast((pivots, radius))  # at most about MAX_PIVOTS vectors

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, far = shared.value
        for part in batches:
            groups = np.array(part.column("space").to_pylist(), dtype=object)
            home, distance = np.zeros(part.num_rows, np.int32), np.zeros(part.num_rows)
            cells: list[list[int]] = [[0]] * part.num_rows
            for space in set(groups.tolist()):
                rows = np.flatnonzero(groups == space)
                if space not in places:
                    continue
                own, x = places[space], _unit(part.column("vector").take(pa.array(rows)))
                d = np.sqrt(np.maximum(2 - 2 * x @ own.T, 0))
                near = d.argmin(axis=1)
                home[rows], distance[rows] = near, d[np.arange(len(rows)), near]
                if far is None:
                    continue
                apart = np.sqrt(np.maximum(2 - 2 * own @ own.T, 0))
                within = d <= np.array([far.get((space, k), -9.0) for k in range(len(own))])[None, :] + reach + MARGIN
                for other in range(len(own)):  # the plane between a cell's pivot and every other one
                    gap = (d * d - d[:, other : other + 1] ** 2) / np.maximum(2 * apart[None, :, other], 1e-12)
                    gap[:, apart[:, other] < 1e-9] = 0
                    within &= gap <= reach + MARGIN
                within[np.arange(len(rows)), near] = True
                for r, w in zip(rows, within, strict=True):
                    cells[r] = np.flatnonzero(w).tolist()
            if far is None:
                yield pa.RecordBatch.from_arrays([part.column("space"), pa.array(home), pa.array(distance)], ["space", "home", "distance"])
            else:
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(home), pa.array(cells, pa.list_(pa.int32()))], [*part.schema.names, "home", "cells"])

    if radius is None:
        return vectors.select("space", "vector").mapInArrow(place, "space string, home int, distance double")
    kind = ", ".join(f"{c} {t}" for c, t in vectors.dtypes)
    return vectors.mapInArrow(place, f"{kind}, home int, cells array<int>")


def _block(table: pa.Table, cosine: float) -> pa.Table:
    """Links of one block: (id, n_links, other), ``other`` a spanning set of the block's components."""
    role = table["role"].to_numpy()
    home, rest = table.filter(pa.array(role == 0)), table.filter(pa.array(role == 1))
    out = {"id": pa.int64(), "n": pa.int64(), "other": pa.int64()}
    if not home.num_rows or not rest.num_rows:
        return pa.table({c: pa.array([], t) for c, t in out.items()})
    a, b = home["id"].to_numpy(), rest["id"].to_numpy()
    close = _unit(home["vector"].combine_chunks()) @ _unit(rest["vector"].combine_chunks()).T >= cosine
    close &= home["class"].to_numpy()[:, None] != rest["class"].to_numpy()[None, :]
    n = close @ rest["copies"].to_numpy().astype(np.float64)
    left, right = np.nonzero(close)
    label = np.concatenate([a, b])
    i, j = left, right + len(a)
    while len(i):
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        if (label == before).all():
            break
    linked = np.unique(np.concatenate([i, j])).astype(np.int64)
    ids = np.concatenate([a, b])
    made = pa.table({
        "id": pa.array(np.concatenate([a, ids[linked]]), pa.int64()), "n": pa.array(np.concatenate([n, np.zeros(len(linked))]).astype(np.int64)),
        "other": pa.array(np.concatenate([a, label[linked]]), pa.int64()),
    })
    return made.filter(pa.array((made["n"].to_numpy() > 0) | (made["id"].to_numpy() != made["other"].to_numpy())))


def near_vectors(rows: DataFrame, scratch: Scratch, cosine: float = COSINE, key: str = "vec_id", vector: str = "embedding", label: str = "label",
                 cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """key, n_links, component_id, kept."""
    reach = math.sqrt(2 - 2 * cosine)
    space = F.concat_ws("/", F.col(label).cast("string"), F.size(vector).cast("string"))
    good = _usable(F.col(vector), F.col(label), F.col(key))
    code = F.when(good, F.sha2(F.concat_ws("/", space, F.col(vector).cast("string")), 256))
    coded = scratch.keep(rows.select(F.col(key).cast("long").alias("id"), F.when(good, F.col(vector)).alias("vector"), F.when(good, space).alias("space"), code.alias("code")))
    classes = scratch.keep(coded.where("code IS NOT NULL").groupBy("code").agg(F.min("id").alias("class"), F.count(F.lit(1)).alias("copies")))
    reps = coded.join(classes, "code").where(F.col("id") == F.col("class")).dropDuplicates(["code"])
    reps = scratch.keep(reps.select("code", "id", F.col("id").alias("class"), "copies", "space", "vector"))
    sizes = {r["space"]: r["n"] for r in reps.groupBy("space").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > cell_rows).collect()}
    total = sum(sizes.values())
    wanted = {s: max(2, math.ceil(min(n / cell_rows, MAX_PIVOTS * n / total))) for s, n in sizes.items()}
    pivots = {}
    if wanted:
        steps = F.create_map(*[F.lit(x) for s in wanted for x in (s, max(1, sizes[s] // wanted[s]))])
        drawn = reps.where(F.col("space").isin(list(wanted))).where(F.pmod(F.xxhash64("code"), steps[F.col("space")]) == 0)
        found: dict[str, list] = {}
        for r in drawn.select("space", "vector").collect():
            found.setdefault(r["space"], []).append(r["vector"])
        for s, v in found.items():
            x = np.unique(np.array(v, np.float64), axis=0)
            pivots[s] = x / np.linalg.norm(x, axis=1)[:, None]
    far = {}
    if pivots:
        spread = _with_cells(reps.where(F.col("space").isin(list(pivots))), pivots, None, reach).groupBy("space", "home").agg(F.max("distance").alias("far"))
        far = {(r["space"], r["home"]): r["far"] for r in spread.collect()}
    placed = scratch.keep(_with_cells(reps, pivots, far, reach))
    members = placed.select("id", "class", "copies", "space", "vector", "home", F.explode("cells").alias("cell"))
    per_cell = members.groupBy("space", "cell").agg(F.count(F.lit(1)).alias("m"), F.count(F.when(F.col("home") == F.col("cell"), 1)).alias("h"))
    blocks = per_cell.select("space", "cell", F.ceil(F.col("m") / block_rows).alias("mb"), F.ceil(F.col("h") / block_rows).alias("hb")).where("hb > 0")
    dealt = members.join(blocks, ["space", "cell"])
    columns = ["id", "class", "copies", "vector", "space", "cell"]
    own = F.xxhash64("id")
    as_home = dealt.where("home = cell").select(*columns, F.lit(0).alias("role"), F.pmod(own, F.col("hb")).alias("hb"), F.explode(F.sequence(F.lit(0), F.col("mb") - 1)).alias("mb"))
    as_rest = dealt.select(*columns, F.lit(1).alias("role"), F.explode(F.sequence(F.lit(0), F.col("hb") - 1)).alias("hb"), F.pmod(own, F.col("mb")).alias("mb"))
    grouped = as_home.unionByName(as_rest).groupBy("space", "cell", "hb", "mb")
    blocks_done = scratch.keep(grouped.applyInArrow(lambda t: _block(t, cosine), "id long, n long, other long"))
    roots = components(blocks_done.where("id <> other").select(F.col("id").alias("a"), F.col("other").alias("b")), scratch)
    counts = blocks_done.groupBy("id").agg(F.sum("n").alias("n"))
    named = coded.join(classes, "code", "left").select("id", "class", "copies")
    named = named.join(counts.withColumnRenamed("id", "class"), "class", "left").join(roots.withColumnRenamed("node", "class"), "class", "left")
    links = F.coalesce("n", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))
    out = named.select(F.col("id").alias(key), links.cast("long").alias("n_links"), F.coalesce("root", "class", "id").alias("component_id"))
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))
