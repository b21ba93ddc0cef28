"""A factorisation machine that tells good documents from bad ones.

Inputs are hashed words (weighted by log count, unit length), structure statistics and numeric
metadata.  Each input has a weight and a low-rank vector; all pairwise interactions are summed
in linear time as half of (square of the sum minus sum of the squares).  The machine is fitted
on a bounded sample of labelled rows on the driver and then scores every text in one narrow pass.

Edge cases: a null or empty text scores by its (zero) statistics alone; null metadata counts as
0; labels that are null or neither 0 nor 1 are ignored, and of several labels of one id the
smaller counts; repeated rows score alike; without labels of both kinds every score is the
share of label 1 (or 1 without any label); an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import WordHashes, text_slices
from .text_stats import COUNTS, counts_of, ratios

SAMPLE_ROWS = 16_384
BUCKETS, RANK, EPOCHS, BATCH = 1 << 15, 8, 8, 256
RATE, DECAY, SEED = 0.02, 1e-5, 11
FOLDS = 5
THRESHOLD = 0.3
METADATA = ("n_chars",)


def fold(key: Column, folds: int = FOLDS) -> Column:
    """crc32 of the key's text modulo ``folds``; 0 is held out."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(folds))


def features(texts: list[str | None], extra: np.ndarray, known: WordHashes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashed words as (row starts, buckets, weights), and the dense inputs before scaling."""
    starts, buckets, weights, stats = [0], [], [], []
    for text in texts:
        stats.append(counts_of(text, known))
        words = (text or "").encode().lower().split()
        found, n = np.unique(known.of(words) & np.uint64(BUCKETS - 1), return_counts=True)
        w = 1 + np.log(n)
        buckets.append(found.astype(np.int32))
        weights.append((w / max(np.sqrt((w * w).sum()), 1e-9)).astype(np.float32))
        starts.append(starts[-1] + len(found))
    dense = np.column_stack([ratios(np.array(stats, np.int64).reshape(-1, len(COUNTS))), np.log1p(np.maximum(extra, 0))])
    cat = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return np.array(starts), cat(buckets, np.int32), cat(weights, np.float32), dense


class FactorisationMachine:
    """Weights and vectors of the hashed words and, after them, of the dense inputs."""

    def __init__(self, n_dense: int, seed: int = SEED):
        draw = np.random.default_rng(seed)
        self.n_dense = n_dense
        self.bias = 0.0
        self.weight = np.zeros(BUCKETS + n_dense, np.float32)
        self.vector = draw.normal(0, 0.01, (BUCKETS + n_dense, RANK)).astype(np.float32)
        self.middle, self.width = np.zeros(n_dense), np.ones(n_dense)

    def scaled(self, dense: np.ndarray) -> np.ndarray:
        return np.clip((dense - self.middle) / self.width, -6, 6).astype(np.float32)

    def flat(self, starts, buckets, weights, dense):
        """One sparse table: every row's words followed by its dense inputs."""
        rows, n = len(starts) - 1, np.diff(starts)
        ends = np.cumsum(n + self.n_dense)
        begin = ends - n - self.n_dense
        index, value = np.empty(ends[-1] if rows else 0, np.int64), np.empty(ends[-1] if rows else 0, np.float32)
        at = np.repeat(begin - starts[:-1], n) + np.arange(len(buckets))
        index[at], value[at] = buckets, weights
        tail = (begin + n)[:, None] + np.arange(self.n_dense)
        index[tail], value[tail] = BUCKETS + np.arange(self.n_dense), self.scaled(dense)
        return np.append(begin, ends[-1:] if rows else 0), index, value

    def margins(self, begin, index, value):
        """Linear part plus half of (square of the sum minus sum of the squares), and the sums."""
        scaled = self.vector[index] * value[:, None]
        sums = np.add.reduceat(scaled, begin[:-1])
        pairs = 0.5 * (sums * sums - np.add.reduceat(scaled * scaled, begin[:-1])).sum(axis=1)
        return self.bias + np.add.reduceat(self.weight[index] * value, begin[:-1]) + pairs, sums

    def fit(self, starts, buckets, weights, dense, labels: np.ndarray, seed: int = SEED) -> None:
        """Logistic loss, adaptive steps per parameter."""
        self.middle, self.width = np.median(dense, axis=0), np.maximum(dense.std(axis=0), 1e-3)
        share = labels.mean()
        self.bias = float(np.log(share / (1 - share)))
        begin, index, value = self.flat(starts, buckets, weights, dense)
        draw = np.random.default_rng(seed)
        seen_w, seen_v, seen_b = np.full(len(self.weight), 1e-6, np.float32), np.full(self.vector.shape, 1e-6, np.float32), 1e-6
        for _ in range(EPOCHS):
            order = draw.permutation(len(labels))
            for at in range(0, len(order), BATCH):
                rows = order[at : at + BATCH]
                n = begin[rows + 1] - begin[rows]
                own = np.append(0, np.cumsum(n))
                take = np.repeat(begin[rows] - own[:-1], n) + np.arange(own[-1])
                ix, x = index[take], value[take]
                margin, sums = self.margins(own, ix, x)
                error = (1 / (1 + np.exp(-margin)) - labels[rows]).astype(np.float32) / len(rows)
                each = np.repeat(error, n)
                touched, where = np.unique(ix, return_inverse=True)
                g_w = np.bincount(where, each * x, len(touched)).astype(np.float32) + DECAY * self.weight[touched]
                part = (each * x)[:, None] * (np.repeat(sums, n, axis=0) - self.vector[ix] * x[:, None])
                g_v = np.column_stack([np.bincount(where, part[:, k], len(touched)) for k in range(RANK)]).astype(np.float32)
                g_v += DECAY * self.vector[touched]
                seen_w[touched] += g_w * g_w
                seen_v[touched] += g_v * g_v
                self.weight[touched] -= 5 * RATE * g_w / np.sqrt(seen_w[touched])
                self.vector[touched] -= RATE * g_v / np.sqrt(seen_v[touched])
                seen_b += float(error.sum()) ** 2
                self.bias -= RATE * float(error.sum()) / np.sqrt(seen_b)

    def scores(self, starts, buckets, weights, dense) -> np.ndarray:
        if len(starts) < 2:
            return np.zeros(0)
        margin, _ = self.margins(*self.flat(starts, buckets, weights, dense))
        return 1 / (1 + np.exp(-np.clip(margin.astype(np.float64), -30, 30)))


def _extra(part: pa.RecordBatch, metadata: tuple[str, ...]) -> np.ndarray:
    columns = [part.column(m).cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False) for m in metadata]
    return np.nan_to_num(np.column_stack(columns)) if columns else np.zeros((part.num_rows, 0))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text",
        metadata: tuple[str, ...] = METADATA, sample_rows: int = SAMPLE_ROWS) -> FactorisationMachine | float:
    """The machine fitted on at most ``sample_rows`` labelled rows outside fold 0 (chosen by hash), or a constant score."""
    known = labels.select(key, label).where(F.col(key).isNotNull() & F.col(label).isin(0, 1) & (fold(F.col(key)) != 0))
    known = known.groupBy(key).agg(F.min(label).alias("_label"))
    chosen = known.orderBy(F.xxhash64(key), key).limit(sample_rows)
    metadata = tuple(m for m in metadata if m in docs.columns)

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for part in text_slices(batches, text):
            starts, buckets, weights, dense = features(part.column(text).to_pylist(), _extra(part, metadata), words)
            ends = pa.array(starts.astype(np.int32))
            rows = pa.array(list(dense.astype(np.float64)), pa.list_(pa.float64()))
            lists = [pa.ListArray.from_arrays(ends, pa.array(buckets)), pa.ListArray.from_arrays(ends, pa.array(weights))]
            yield pa.RecordBatch.from_arrays([part.column("_label"), *lists, rows], ["label", "buckets", "weights", "dense"])

    rows = docs.select(key, text, *metadata).join(chosen, key).mapInArrow(prepare, "label int, buckets array<int>, weights array<float>, dense array<double>")
    sample = rows.toArrow().combine_chunks()
    y = sample["label"].to_numpy().astype(np.float64)
    if not len(y) or y.min() == y.max():
        return float(y.mean()) if len(y) else 1.0
    starts = np.append(0, np.cumsum(pa.compute.list_value_length(sample["buckets"]).to_numpy()))
    flat = lambda c: pa.compute.list_flatten(sample[c]).to_numpy()
    dense = flat("dense").reshape(len(y), -1)
    machine = FactorisationMachine(dense.shape[1])
    machine.fit(starts, flat("buckets"), flat("weights"), dense, y)
    return machine


def scored(docs: DataFrame, machine: FactorisationMachine | float, text: str = "text", metadata: tuple[str, ...] = METADATA, out: str = "score") -> DataFrame:
    """``docs`` with ``out``, the probability of label 1."""
    if not isinstance(machine, FactorisationMachine):
        return docs.withColumn(out, F.lit(machine))
    metadata = tuple(m for m in metadata if m in docs.columns)
    names = [c for c in docs.columns if c != out]
    schema = T.StructType([*[f for f in docs.schema if f.name != out], T.StructField(out, T.DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # fixed size: BUCKETS x (RANK + 1)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for part in text_slices(batches, text):
            values = shared.value.scores(*features(part.column(text).to_pylist(), _extra(part, metadata), words))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(values)], [*names, out])

    return docs.mapInArrow(score, schema)
