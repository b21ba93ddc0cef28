"""Packing documents into fixed-length sequences as a cutting-stock problem.

Every document is a run of tokens and a closing id.  Runs longer than a sequence are cut at
multiples of it, and the pieces are counted in a histogram of length classes.  The driver solves
the cutting-stock linear program over that histogram, whose size is set by ``classes`` and not by
the data: columns are patterns (how many pieces of each class share a sequence), a knapsack
dynamic program over the current prices finds the next pattern worth adding, and the solution is
rounded down, with best-fit patterns for what is left.  Patterns then meet documents by rank: the
pieces of a class are ranked in parallel, and each pattern owns an interval of ranks.

Edge cases: a null or empty text is a document of one token (the closing id); equal texts and
repeated rows are packed row by row, so each row's tokens lie in exactly one set of pieces; a
null doc_id stays null; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
import string
import struct
import zlib
from collections.abc import Iterator
from itertools import chain, filterfalse

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import Scratch
from .common import ranked, text_slices

SEQUENCE = 2048
CLASSES = 256
WORDS_HELD = 500_000
MARKS = string.punctuation.encode()
_encoders: dict[str, WordEncoder] = {}


class WordEncoder:
    """Token ids (little-endian 32-bit) of a text, for vocabularies that drop white space and lower-case.

    Nothing crosses white space there, so each distinct word goes through the library once.  A-Z
    are lower-cased before that, but not in texts where this could make a special string or, with
    combining marks (lead bytes CC and CD), a letter that only the lower case has.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.held, self.older = Tokenizer.from_file(path), {}, {}
        self.special = [t.content.lower().encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        suffix, vocabulary = getattr(self.tokenizer.model, "end_of_word_suffix", None), self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if suffix and token.endswith(suffix)]] = True

    def _ids(self, words: list[bytes]) -> list[list[int]]:
        found = self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        return [e.ids for e in found]

    def _together(self, words: list[bytes]) -> list[bytes]:
        """Words of letters as one text: each ends with its only closing token, or they go one by one."""
        ids = np.array(self._ids([b" ".join(words)])[0], "<u4")
        stops = ((np.flatnonzero(self.ends[ids]) + 1) * 4).tolist()
        if len(stops) != len(words):
            return self._apart(words)
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip([0, *stops], stops, strict=False)]

    def _apart(self, words: list[bytes]) -> list[bytes]:
        return [struct.pack(f"<{len(i)}I", *i) for i in self._ids(words)]

    def learn(self, words: set[bytes]) -> None:
        """Marks after a letter or digit are runs of their own, so they and what stands before them are learnt instead."""
        cut = {}
        for w in words:
            core = w.rstrip(MARKS)
            if core != w and core[-1:].isalnum() and not any(s in w for s in self.special):
                cut[w] = core
        new = (words - cut.keys()).union(cut.values(), (w[len(core) :] for w, core in cut.items())) - self.held.keys()
        again = new & self.older.keys()
        self.held.update((w, self.older[w]) for w in again)
        letters, others = [], []
        for w in new - again:
            (letters if w.decode().isalpha() else others).append(w)
        for some, method in ((letters, self._together), (others, self._apart)):
            for at in range(0, len(some), 1024):
                part = some[at : at + 1024]
                self.held.update(zip(part, method(part), strict=True))
        self.held.update((w, self.held[core] + self.held[w[len(core) :]]) for w, core in cut.items())

    def words(self, text: bytes | None) -> list[bytes]:
        low = (text or b"").lower()
        return (text if any(s in low for s in (b"\xcc", b"\xcd", *self.special)) else low).split()

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        split = [self.words(t) for t in texts]
        if len(self.held) > WORDS_HELD:
            self.held, self.older = {}, self.held  # words in use come back from the older half
        new = set(filterfalse(self.held.__contains__, chain.from_iterable(split)))
        again = new & self.older.keys()
        self.held.update((w, self.older[w]) for w in again)
        self.learn(new - again)
        return [b"".join(map(self.held.__getitem__, words)) for words in split]


def _encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def pieces(docs: DataFrame, tokenizer: str, closing: int = 1, size: int = SEQUENCE, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: key, start, length, ids_crc32, doc_tokens; cuts at multiples of ``size``."""
    end = np.array([closing], "<u4").tobytes()
    step = 4 * size

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer)
        for part in text_slices(batches, text):
            owner, start, length, crc, total = [], [], [], [], []
            for row, ids in enumerate(encoder.encode(part.column(text).cast(pa.large_binary()).to_pylist())):
                ids += end
                for at in range(0, len(ids), step):
                    piece = ids[at : at + step]
                    owner.append(row)
                    start.append(at // 4)
                    length.append(len(piece) // 4)
                    crc.append(zlib.crc32(piece))
                    total.append(len(ids) // 4)
            long = [pa.array(v, pa.int64()) for v in (start, length, crc, total)]
            yield pa.RecordBatch.from_arrays([part.column(key).take(pa.array(owner)), *long], [key, "start", "length", "ids_crc32", "doc_tokens"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInArrow(cut, f"{key} {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def _priced(prices: np.ndarray, counts: np.ndarray, room: int) -> tuple[float, dict[int, int]]:
    """Knapsack over class sizes 1..room: the best-priced pattern, as {class: pieces}."""
    best, choice = np.zeros(room + 1), np.zeros(room + 1, np.int64)
    worth = np.where(counts > 0, prices, -1.0)[1 : room + 1]
    for width in range(1, room + 1):
        values = worth[:width] + best[width - 1 :: -1][:width]
        k = int(np.argmax(values))
        if values[k] > best[width - 1] + 1e-12:
            best[width], choice[width] = values[k], k + 1
        else:
            best[width], choice[width] = best[width - 1], 0
    pattern, width = {}, room
    while width > 0:
        c = int(choice[width])
        if c:
            pattern[c] = pattern.get(c, 0) + 1
        width -= c or 1
    return best[room], pattern


def cutting_stock(counts: dict[int, int], room: int, rounds: int = 3000) -> list[tuple[dict[int, int], int]]:
    """[(pattern, how often)] that uses every piece once; class c takes c of ``room`` units.

    Revised simplex on the covering program; ``rounds`` ends the search for columns, with the
    program's then best solution (more sequences at worst, never a lost piece).
    """
    used = sorted(c for c, n in counts.items() if n > 0)
    if not used:
        return []
    row = {c: i for i, c in enumerate(used)}
    demand = np.array([float(counts[c]) for c in used])
    # start: sequences of one class each
    basis = [{c: room // c} for c in used]
    inverse = np.diag([1.0 / (room // c) for c in used])
    amounts = inverse @ demand
    available = np.zeros(room + 1)
    available[used] = 1
    for _ in range(rounds):
        duals = inverse.sum(axis=0)
        prices = np.zeros(room + 1)
        prices[used] = duals
        value, pattern = _priced(prices, available, room)
        if value <= 1 + 1e-9:
            break
        column = np.zeros(len(used))
        for c, k in pattern.items():
            column[row[c]] = k
        direction = inverse @ column
        positive = direction > 1e-9
        if not positive.any():
            break
        ratios = np.full(len(used), np.inf)
        ratios[positive] = amounts[positive] / direction[positive]
        out = int(np.argmin(ratios))
        step = ratios[out]
        amounts -= step * direction
        amounts[out] = step
        amounts[amounts < 0] = 0
        pivot = inverse[out] / direction[out]
        inverse -= np.outer(direction, pivot)
        inverse[out] = pivot
        basis[out] = pattern
    left, plan = dict(counts), []
    for pattern, amount in zip(basis, amounts, strict=True):
        times = min([math.floor(amount + 1e-7), *(left[c] // k for c, k in pattern.items())])
        if times > 0:
            plan.append((pattern, times))
            for c, k in pattern.items():
                left[c] -= k * times
    return plan + _best_fit(left, room)


def _best_fit(left: dict[int, int], room: int) -> list[tuple[dict[int, int], int]]:
    """The remainder of the rounding: largest class first, then always the largest that still fits."""
    plan = []
    left = {c: n for c, n in left.items() if n > 0}
    while left:
        pattern, space = {}, room
        for c in sorted(left, reverse=True):
            k = min(left[c], space // c)
            if k:
                pattern[c] = k
                space -= k * c
        times = min(left[c] // k for c, k in pattern.items())
        plan.append((pattern, times))
        for c, k in pattern.items():
            left[c] -= k * times
        left = {c: n for c, n in left.items() if n > 0}
    return plan


def pack(parts: DataFrame, scratch: Scratch, size: int = SEQUENCE, classes: int = CLASSES) -> DataFrame:
    """``parts`` (from :func:`pieces`) with sequence_id and offset.

    The driver sees one count for each of ``classes`` lengths and hands back intervals of ranks,
    about as many as there are classes times pieces in a pattern.
    """
    spark, unit = parts.sparkSession, size // classes
    classed = parts.withColumn("_class", F.ceil(F.col("length") / unit).cast("long"))
    spread = classed.withColumn("_spread", F.xxhash64(*parts.columns)).withColumn("_nth", F.monotonically_increasing_id())
    placed = scratch.keep(ranked(spread, ["_class"], ["_spread", "_nth"], scratch, "_rank"))
    counts = {r["_class"]: r["n"] for r in placed.groupBy("_class").agg(F.count(F.lit(1)).alias("n")).collect()}
    shares, first, taken = [], 0, dict.fromkeys(counts, 0)
    for pattern, times in cutting_stock(counts, classes):
        for c, k in pattern.items():
            shares.append((c, taken[c], taken[c] + k * times, k, first))
            taken[c] += k * times
        first += times
    # an interval of ranks is looked up by the array of its class: no range join, no copies of rows
    owners = spark.createDataFrame(shares, "_class long, lo long, hi long, k long, first long")
    owners = owners.groupBy("_class").agg(F.sort_array(F.collect_list(F.struct("lo", "hi", "k", "first"))).alias("_owners"))
    own = F.filter("_owners", lambda o: (o["lo"] <= F.col("_rank")) & (F.col("_rank") < o["hi"]))[0]
    found = placed.join(F.broadcast(owners), "_class").withColumn("_own", own)  # at most ``classes`` rows
    sequence = (F.col("_own.first") + F.floor((F.col("_rank") - F.col("_own.lo")) / F.col("_own.k"))).cast("long")
    found = found.withColumn("sequence_id", sequence)
    before = Window.partitionBy("sequence_id").orderBy(F.desc("_class"), "_rank").rowsBetween(Window.unboundedPreceding, -1)
    return found.select(*parts.columns, "sequence_id", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long").alias("offset"))
