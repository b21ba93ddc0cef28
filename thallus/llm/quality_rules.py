"""Quality rules with an isolation forest over their statistics.

Random splits isolate unusual rows early, so a short mean path marks an anomaly.  The forest is
grown from a bounded, documented sample of labelled rows (small trees, so that a few per cent
of odd rows stay rare in each); the threshold is set from the
scores of all labelled rows, through a histogram that Spark counts.

Edge cases: a null or empty text has no words and fails the base rules; a null doc_id stays null
and is never labelled; ties of the score fall on the same side of the threshold; repeated rows
are judged alike; without labelled rows of both kinds the forest drops nothing; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Scratch
from .text_stats import COUNTS, ratios, rule_statistics

SAMPLE_ROWS = 16_384
TREES, TREE_ROWS, SEED = 200, 64, 7
#: columns of ``ratios`` that the forest sees: symbols, other marks and doubled marks per word; the base rules judge the rest
FEATURES = [2, 7, 10]
BINS = 2000
GOOD_LOST = 0.002
MIN_WORDS, REPEAT_PERCENT = 10, 20


def path_norm(n: np.ndarray) -> np.ndarray:
    """Mean path of an unsuccessful search among n rows."""
    n = np.maximum(n, 1).astype(float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + np.euler_gamma) - 2 * (n - 1) / n, np.where(n == 2, 1.0, 0.0))


class IsolationForest:
    """Trees as flat arrays: split feature (-1: leaf), split value, left child (right is next), path at a leaf."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, tree_rows: int = TREE_ROWS, seed: int = SEED):
        draw = np.random.default_rng(seed)
        self.roots, feature, value, left, path = [], [], [], [], []
        size = min(tree_rows, len(rows))
        depth_limit = int(np.ceil(np.log2(max(size, 2)))) + 4
        for _ in range(trees):
            self.roots.append(len(feature))
            feature.append(-1), value.append(0.0), left.append(0), path.append(0.0)
            todo = [(self.roots[-1], rows[draw.choice(len(rows), size, replace=False)], 0)]
            while todo:
                node, own, depth = todo.pop()
                low, high = own.min(axis=0), own.max(axis=0)
                varied = np.flatnonzero(high > low)
                if len(own) <= 1 or depth >= depth_limit or not len(varied):
                    path[node] = depth + float(path_norm(np.array(len(own))))
                    continue
                k = int(draw.choice(varied))
                cut = float(draw.uniform(low[k], high[k]))
                goes = own[:, k] < cut
                if not goes.any():
                    goes = own[:, k] <= cut
                feature[node], value[node], left[node] = k, cut, len(feature)
                for part in (own[goes], own[~goes]):
                    todo.append((len(feature), part, depth + 1))
                    feature.append(-1), value.append(0.0), left.append(0), path.append(0.0)
        self.feature, self.value = np.array(feature), np.array(value)
        self.left, self.path = np.array(left), np.array(path)
        self.norm = float(path_norm(np.array(max(size, 2))))

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """Between 0 and 1; near 1 is isolated early."""
        total = np.zeros(len(rows))
        at_row = np.arange(len(rows))
        for root in self.roots:
            node = np.full(len(rows), root)
            while True:
                feature = self.feature[node]
                inner = feature >= 0
                if not inner.any():
                    break
                right = rows[at_row, np.maximum(feature, 0)] >= self.value[node]
                node = np.where(inner, self.left[node] + right, node)
            total += self.path[node]
        return np.power(2.0, -total / (len(self.roots) * self.norm))


def threshold(bins: list[tuple[int, int, int]], good_lost: float = GOOD_LOST) -> int:
    """The lowest bin from which on rows go: ``bins`` has (bin, good rows, bad rows).

    Of the cuts that lose at most ``good_lost`` of the good labelled rows, the one with the best
    balance of bad rows caught against good rows lost.
    """
    good, bad = sum(b[1] for b in bins), sum(b[2] for b in bins)
    best, where, lost, caught = 0.0, BINS + 1, 0, 0
    if not good or not bad:
        return where
    for b, g, w in sorted(bins, reverse=True):
        lost, caught = lost + g, caught + w
        if lost > good_lost * good:
            break
        if caught / bad - lost / good > best:
            best, where = caught / bad - lost / good, b
    return where


def judged(docs: DataFrame, labels: DataFrame, scratch: Scratch, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """doc_id, the counts, base_failed, score (null where no forest could be grown) and kept."""
    stats = scratch.keep(rule_statistics(docs))
    known = labels.select("doc_id", "quality").where("doc_id IS NOT NULL AND quality IN (0, 1)")
    known = known.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    passed = stats.where(~_base_failed()).join(known, "doc_id")
    sample = passed.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows).select(*COUNTS).toPandas()
    if len(sample) < 2:
        return stats.select("*", _base_failed().alias("base_failed"), F.lit(None).cast("double").alias("score"), (~_base_failed()).alias("kept"))
    forest = IsolationForest(ratios(sample[list(COUNTS)].to_numpy())[:, FEATURES])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            rows = ratios(np.column_stack([part.column(c).to_numpy() for c in COUNTS]))[:, FEATURES]
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(forest.scores(rows))], [*part.schema.names, "score"])

    kind = ", ".join(f"{c} {t}" for c, t in stats.dtypes)
    scored = scratch.keep(stats.mapInArrow(score, f"{kind}, score double"))
    bin_of = F.floor(F.col("score") * BINS)
    tally = scored.where(~_base_failed()).join(known, "doc_id").groupBy(bin_of.alias("b"))
    tally = tally.agg(F.sum("quality").alias("good"), F.sum(1 - F.col("quality")).alias("bad")).collect()  # at most BINS rows
    cut = threshold([(r["b"], r["good"], r["bad"]) for r in tally])
    return scored.select("*", _base_failed().alias("base_failed"), (~_base_failed() & (bin_of < cut)).alias("kept"))


def _base_failed():
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
