"""Mixing documents to target domain weights, with soft membership.

A softmax classifier, fitted on a bounded sample of a labelled table, predicts each document's
domain posteriors.  Document rates r >= 0 are then fitted so that the expected tokens of each
domain, the sum of r * posterior * tokens, match their targets in least squares: projected
gradient from r = 1, each gradient scaled by the inverse of the domains' Gram matrix over the rows
that the step before did not clip (a projected Newton step, as big as the number of domains).  A rate
depends on the posteriors and the steps so far, so a round is one pass that sums a few numbers per
partition; only those reach the driver.  How far the expected totals end from their targets is
part of the result: with rates bounded above, targets may be out of reach.

Edge cases: null or empty texts have no tokens and get a rate like others; a null doc_id stays
null and is never labelled; repeated rows get equal rates; labels of an unknown domain are
ignored; without labelled rows all documents belong equally to all domains; an empty table gives
no rows; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import Scratch
from .common import WordHashes, text_slices
from .quality_classifier import BUCKETS, features

SAMPLE_ROWS = 12_288
#: relative miss that counts as met; a round that moves no total by STILL of all tokens is the last, as is round ROUNDS
ROUNDS, CLOSE, STILL = 200, 1e-4, 1e-7
EPOCHS, BATCH, RATE, SEED = 6, 256, 0.3, 13


class Posteriors:
    """Softmax over hashed words and structure statistics."""

    def __init__(self, domains: Sequence[str]):
        self.domains, self.weight = list(domains), None

    def _flat(self, starts, buckets, weights, dense):
        z = np.clip((dense - self.middle) / self.width, -6, 6).astype(np.float32)
        return starts, buckets, weights, np.column_stack([z, np.ones(len(z), np.float32)])

    def _margins(self, starts, buckets, weights, z):
        total = z @ self.weight[BUCKETS:]
        summed = np.concatenate([np.zeros((1, len(self.domains)), np.float32), np.cumsum(self.weight[buckets] * weights[:, None], axis=0, dtype=np.float64)])
        return total + summed[starts[1:]] - summed[starts[:-1]]

    def fit(self, starts, buckets, weights, dense, labels: np.ndarray) -> None:
        self.middle, self.width = np.median(dense, axis=0), np.maximum(dense.std(axis=0), 1e-3)
        self.weight = np.zeros((BUCKETS + dense.shape[1] + 1, len(self.domains)), np.float32)
        seen = np.full(self.weight.shape, 1e-6, np.float32)
        _, _, _, z = self._flat(starts, buckets, weights, dense)
        draw = np.random.default_rng(SEED)
        truth = np.eye(len(self.domains), dtype=np.float32)[labels]
        for _ in range(EPOCHS):
            order = draw.permutation(len(labels))
            for at in range(0, len(order), BATCH):
                rows = order[at : at + BATCH]
                n = starts[rows + 1] - starts[rows]
                own = np.append(0, np.cumsum(n))
                take = np.repeat(starts[rows] - own[:-1], n) + np.arange(own[-1])
                m = self._margins(own, buckets[take], weights[take], z[rows])
                p = np.exp(m - m.max(axis=1, keepdims=True))
                error = (p / p.sum(axis=1, keepdims=True) - truth[rows]).astype(np.float32) / len(rows)
                touched, where = np.unique(buckets[take], return_inverse=True)
                each = np.repeat(error, n, axis=0) * weights[take][:, None]
                g = np.column_stack([np.bincount(where, each[:, k], len(touched)) for k in range(error.shape[1])]).astype(np.float32)
                for index, grad in ((touched, g), (np.arange(BUCKETS, len(self.weight)), z[rows].T @ error)):
                    seen[index] += grad * grad
                    self.weight[index] -= RATE * grad / np.sqrt(seen[index])

    def predict(self, starts, buckets, weights, dense) -> np.ndarray:
        if self.weight is None or not len(dense):
            return np.full((len(dense), len(self.domains)), 1 / len(self.domains))
        m = self._margins(*self._flat(starts, buckets, weights, dense))
        p = np.exp(m - m.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def fit_posteriors(docs: DataFrame, labelled: DataFrame, domains: Sequence[str], key: str = "doc_id", text: str = "text", sample_rows: int = SAMPLE_ROWS) -> Posteriors:
    """``labelled`` has key and ``domain``; at most ``sample_rows`` of its rows (by hash) are learned from."""
    number = {d: k for k, d in enumerate(domains)}
    known = labelled.where(F.col(key).isNotNull() & F.col("domain").isin(list(domains))).groupBy(key).agg(F.min("domain").alias("domain"))
    n = known.count()
    # the share of hashes that gives about four standard deviations less than the bound: no sort, no single task
    share = min(1.0, max(sample_rows - 4 * sample_rows**0.5, 1) / max(n, 1)) if n > sample_rows else 1.0
    chosen = F.broadcast(known.where(F.pmod(F.xxhash64(key), F.lit(1 << 30)) < int(share * (1 << 30))))  # bounded by sample_rows

    def prepare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for part in text_slices(batches, text):
            starts, buckets, weights, dense = features(part.column(text).to_pylist(), np.zeros((part.num_rows, 0)), words)
            ends = pa.array(starts.astype(np.int32))
            lists = [pa.ListArray.from_arrays(ends, pa.array(buckets)), pa.ListArray.from_arrays(ends, pa.array(weights))]
            yield pa.RecordBatch.from_arrays([part.column("domain"), *lists, pa.array(list(dense), pa.list_(pa.float64()))], ["domain", "buckets", "weights", "dense"])

    rows = docs.select(key, text).join(chosen, key).mapInArrow(prepare, "domain string, buckets array<int>, weights array<float>, dense array<double>")
    sample = rows.toArrow().combine_chunks()
    model = Posteriors(domains)
    if sample.num_rows:
        starts = np.append(0, np.cumsum(pa.compute.list_value_length(sample["buckets"]).to_numpy()))
        flat = lambda c: pa.compute.list_flatten(sample[c]).to_numpy()
        model.fit(starts, flat("buckets"), flat("weights"), flat("dense").reshape(sample.num_rows, -1), np.array([number[d] for d in sample["domain"].to_pylist()]))
    return model


def with_posteriors(docs: DataFrame, model: Posteriors, text: str = "text") -> DataFrame:
    """``docs`` with ``n_tokens`` (words) and ``posteriors``, one number per domain."""
    names = [c for c in docs.columns if c not in ("n_tokens", "posteriors")]
    added = [T.StructField("n_tokens", T.LongType()), T.StructField("posteriors", T.ArrayType(T.DoubleType()))]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # fixed size: BUCKETS x domains

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHashes()
        for part in text_slices(batches, text):
            texts = part.column(text).to_pylist()
            found = features(texts, np.zeros((len(texts), 0)), words)
            tokens = pa.array([len((t or "").encode().split()) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), tokens, pa.array(list(shared.value.predict(*found)), pa.list_(pa.float64()))], [*names, "n_tokens", "posteriors"])

    return docs.mapInArrow(predict, T.StructType([*[docs.schema[c] for c in names], *added]))


def rates_of(posteriors: np.ndarray, steps: np.ndarray, most: float | None) -> tuple[np.ndarray, np.ndarray]:
    """Rates after the projected steps so far, and which of them the last step did not clip."""
    rate, free = np.ones(len(posteriors)), np.ones(len(posteriors), bool)
    for g in steps:
        wanted = rate - posteriors @ g
        rate = np.clip(wanted, 0, most)
        free = rate == wanted
    return rate, free


@dataclass(frozen=True)
class Fit:
    """Steps of the rates, expected tokens per domain, the largest relative miss, and rounds."""

    steps: np.ndarray
    expected: np.ndarray
    miss: float
    rounds: int

    @property
    def met(self) -> bool:
        return self.miss <= CLOSE


def fit_rates(rows: DataFrame, targets: np.ndarray, most: float | None = None, rounds: int = ROUNDS, close: float = CLOSE) -> Fit:
    """``rows`` has n_tokens and posteriors and is stored.

    Stops when every domain's expected tokens are within ``close`` of its target, or when the totals no
    longer move: then the least-squares optimum is reached and ``miss`` says what it leaves.  A step
    that made things worse is followed by shorter ones.
    """
    k, steps, miss = len(targets), np.zeros((0, len(targets))), np.inf
    expected, last, damp, still = np.zeros(k), None, 1.0, 0

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(k + 2 * k * k)
        for part in batches:
            if part.num_rows:
                p = pa.compute.list_flatten(part.column("posteriors")).to_numpy().reshape(-1, k)
                tokens = part.column("n_tokens").to_numpy().astype(float)
                rate, free = rates_of(p, steps, most)
                sums[:k] += (p * (tokens * rate)[:, None]).sum(axis=0)
                sums[k : k + k * k] += (p.T @ (p * (tokens * free)[:, None])).ravel()
                sums[k + k * k :] += (p.T @ (p * tokens[:, None])).ravel()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(sums))), pa.array(sums)], ["at", "total"])

    done = 0
    while done < rounds:
        done += 1
        got = rows.select("n_tokens", "posteriors").mapInArrow(totals, "at long, total double").groupBy("at").agg(F.sum("total").alias("total"))
        sums = np.zeros(k + 2 * k * k)
        for r in got.collect():  # a few numbers per pair of domains
            sums[r["at"]] = r["total"]
        expected, gram, whole = sums[:k], sums[k : k + k * k].reshape(k, k), sums[k + k * k :].reshape(k, k)
        off = expected - targets
        miss = float((np.abs(off) / np.maximum(targets, 1)).max())
        if miss <= close:
            break
        if last is not None:
            moved = np.abs(expected - last).max()
            still = still + 1 if moved <= STILL * max(targets.sum(), 1) else 0
            if still == 2:
                break
            worse = (off @ off) > ((last - targets) @ (last - targets))
            damp = damp / 2 if worse else min(1.0, damp * 1.5)
        last = expected
        # rows at a bound may be needed again: a small part of the whole matrix keeps the step finite
        scaled = gram + (1e-3 + 0.1 * (1 - damp)) * whole
        steps = np.vstack([steps, damp * np.linalg.lstsq(scaled, off, rcond=1e-12)[0]])
    return Fit(steps, expected, miss, done)


def with_rates(rows: DataFrame, steps: np.ndarray, most: float | None = None, seed: int = SEED) -> DataFrame:
    """``rows`` with ``rate`` and ``copies``: the rate rounded up or down at random, by a hash of the row's id."""
    names = [c for c in rows.columns if c != "rate"]

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            k = max(steps.shape[1], 1)
            p = pa.compute.list_flatten(part.column("posteriors")).to_numpy().reshape(-1, k)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), pa.array(rates_of(p, steps, most)[0])], [*names, "rate"])

    rated = rows.mapInArrow(rate, T.StructType([*[rows.schema[c] for c in names], T.StructField("rate", T.DoubleType())]))
    luck = (F.xxhash64("doc_id", F.lit(seed)).cast("double") + 2.0**63) / 2.0**64
    return rated.withColumn("copies", F.floor(F.col("rate") + luck).cast("long"))


def domain_totals(rows: DataFrame, k: int) -> np.ndarray:
    """Expected tokens of each domain at rate 1."""
    sums = rows.select([F.sum(F.col("n_tokens") * F.col("posteriors")[i]).alias(str(i)) for i in range(k)]).first()
    return np.array([v or 0.0 for v in sums])


def mixed(docs: DataFrame, labelled: DataFrame, weights: Mapping[str, float], scratch: Scratch, full: str, scale: float, most: float | None = None) -> DataFrame:
    """doc_id, n_tokens (blank-separated words), posteriors, rate, copies for target ``weights``, and ``miss``:
    the largest relative distance of a domain's expected tokens from its target, the same in every row.

    The total is set so that domain ``full`` gets ``scale`` times the tokens it has.
    """
    domains = list(weights)
    model = fit_posteriors(docs, labelled, domains)
    rows = scratch.keep(with_posteriors(docs.select("doc_id", "text"), model).drop("text"))
    shares = np.array([weights[d] for d in domains]) / sum(weights.values())
    has = domain_totals(rows, len(domains))
    targets = shares * (scale * has[domains.index(full)] / shares[domains.index(full)])
    fit = fit_rates(rows, targets, most)
    return with_rates(rows, fit.steps, most).withColumn("miss", F.lit(fit.miss))
