"""Repeated and nearly repeated lines, by a deletion-neighbourhood join.

Two lines are near if one word inserted, deleted or changed turns one into the other (A-Z
lower-cased, blanks ignored).  Each candidate emits its variants with one word left out as
hashed keys: equal variants with the same gap are one changed word, a line equal to another's
variant is one word more or less.  A key hands back the earliest line of the right kind, so a
bucket is minimised, never paired; the edit distance to that line is then verified.  Only lines
that share an exact half with a different line can be near (one edit leaves a half untouched), so
only those emit variants, and only variants without a word outside of a half that they share.
Keys are counted first; rows that say whose they are exist for keys of several lines only.

A line of at least ``min_words`` words is dropped where an equal line stands earlier (by doc_id,
then line number), or where its first occurrence has an earlier near line (whether or not that
one is kept).  Lines of fewer than ``near_words`` words are only compared for equality; shorter
or blank lines always stay.

Edge cases: null and empty texts stay as they are; rows that share a doc_id are one document,
judged by line number; rows with a null doc_id neither drop nor lose lines; a document may lose
all its lines (its text is then empty); an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import Scratch
from .common import WordHashes, mix, text_slices

MIN_WORDS, NEAR_WORDS = 4, 8
#: a side of at most so many (narrow) rows is broadcast; beyond, both sides are shuffled
BROADCAST_ROWS = 250_000
_B = 0x9E3779B97F4A7C15
_BACK = np.uint64(pow(_B, -1, 1 << 64))
_ROW, _GAP, _LENGTH = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def _powers(n: int) -> np.ndarray:
    return np.concatenate(([np.uint64(1)], np.cumprod(np.full(max(n - 1, 0), np.uint64(_B)))))[:n]


def sums(hashes: np.ndarray) -> np.ndarray:
    """Rolling sums of all prefixes, from the empty one on."""
    return np.concatenate(([np.uint64(0)], np.cumsum(hashes * _powers(len(hashes)))))


def _named(total: np.ndarray, length: int, salt: int = 0) -> np.ndarray:
    return mix(total * _ROW + np.uint64((length * int(_LENGTH) + salt * int(_GAP)) % (1 << 64)))


def line_keys(hashes: np.ndarray, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the lines at words start..stop-1, and three keys of the halves each may share with a near line.

    With a line of as many words, or one more or less, an edit leaves the first or the last half of
    the shorter line as it is.  A line of n words gives its first and its last n // 2 words, and what
    else such a half can be: the first n // 2 - 1 if n is even, the last n // 2 + 1 if it is odd.
    """
    total = sums(hashes)
    back = np.concatenate(([np.uint64(1)], np.cumprod(np.full(len(hashes), _BACK))))
    of = lambda a, b: (total[b] - total[a]) * back[a]
    n = stop - start
    whole = _named_all(of(start, stop), n, 0)
    h, even = n // 2, n % 2 == 0
    first, last = (_named_all(of(start, start + h), h, 1), _named_all(of(stop - h, stop), h, 2))
    shorter = _named_all(of(start, start + np.maximum(h - 1, 0)), np.maximum(h - 1, 0), 1)
    longer = _named_all(of(stop - (n - h), stop), n - h, 2)
    return whole, np.column_stack([first, last, np.where(even, shorter, longer)])


def outside(n: int, shared: int) -> np.ndarray:
    """Places of a line of ``n`` words where an edit may be, by the halves it shares (a bit for each of ``line_keys``)."""
    h, even = n // 2, n % 2 == 0
    first = h - 1 if even and shared & 4 else h if shared & 1 else n
    last = h if shared & 2 else n - h if not even and shared & 4 else n
    place = np.arange(n)
    return place[(place >= first) | (place < n - last)]


def _named_all(total: np.ndarray, length: np.ndarray, salt: int) -> np.ndarray:
    return mix(total * _ROW + length.astype(np.uint64) * _LENGTH + np.uint64(salt * int(_GAP) % (1 << 64)))


def variants(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.uint64]:
    """Keys without the word at each place of ``at``: with the gap's place, without it; and the key of the whole line."""
    n, total = len(hashes), sums(hashes)
    without = total[at] + (total[-1:] - total[at + 1]) * _BACK
    gap = at.astype(np.uint64) + np.uint64(1)
    return mix(_named(without, n, 3) + gap * _GAP), _named(without, n - 1, 4), _named(total[-1:], n, 4)[0]


def within_one_edit(a: list[int], b: list[int]) -> bool:
    if abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else (a[k + 1 :] == b[k:] if len(a) > len(b) else a[k:] == b[k + 1 :])


def _signed(values) -> pa.Array:
    return pa.array(np.asarray(values, np.uint64).view(np.int64))


def _lines(docs: DataFrame, key: str, text: str, min_words: int, near_words: int) -> DataFrame:
    """(line, doc, no, halves): one row per line long enough; ``line`` is the hash of its words."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for part in text_slices(batches, text):
            owner, number, length, words = [], [], [], []
            for row, value in enumerate(part.column(text).to_pylist()):
                for no, raw in enumerate((value or "").encode().lower().split(b"\n")):
                    own = raw.split()
                    if len(own) >= min_words:
                        words += own
                        owner.append(row)
                        number.append(no)
                        length.append(len(own))
            if not owner:
                continue
            n = np.array(length)
            stop = np.cumsum(n)
            line, halves = line_keys(known.of(words), stop - n, stop)
            ends = np.concatenate(([0], np.cumsum(np.where(n >= near_words, 3, 0)))).astype(np.int32)
            shared = pa.ListArray.from_arrays(pa.array(ends), _signed(halves[n >= near_words].ravel()))
            yield pa.RecordBatch.from_arrays(
                [_signed(line), part.column(key).take(pa.array(owner, pa.int32())), pa.array(number, pa.int32()), shared], ["line", "doc", "no", "halves"]
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).where(F.col(key).isNotNull()).mapInArrow(split, f"line long, doc {kind}, no int, halves array<long>")


def _words(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(line, words) for the line numbers in ``wanted``."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for part in text_slices(batches, text):
            line, hashes = [], []
            for value, wanted in zip(part.column(text).to_pylist(), part.column("wanted").to_pylist(), strict=True):
                lines = (value or "").encode().lower().split(b"\n")
                for no in wanted:
                    if no < len(lines):
                        own = known.of(lines[no].split())
                        line.append(_named(sums(own)[-1:], len(own))[0])
                        hashes.append(own.view(np.int64))
            yield pa.RecordBatch.from_arrays([_signed(line), pa.array(hashes, pa.list_(pa.int64()))], ["line", "words"])

    return docs.select(text, "wanted").mapInArrow(find, "line long, words array<long>")


def _emitted(some: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """key, role and row of every variant (0 changed, 2 shorter) and whole line (1) of a batch."""
    keys, role, owner = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)]
    for row, (words, shared) in enumerate(zip(some.column("words").to_pylist(), some.column("shared").to_pylist(), strict=True)):
        changed, shorter, whole = variants(np.array(words, np.int64).view(np.uint64), outside(len(words), shared))
        shorter = np.unique(shorter)
        keys += [changed, shorter, np.array([whole])]
        role.append(np.repeat(np.array([0, 2, 1], np.int32), [len(changed), len(shorter), 1]))
        owner.append(np.full(len(changed) + len(shorter) + 1, row))
    return np.concatenate(keys), np.concatenate(role), np.concatenate(owner)


def _variant_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in batches:
        for at in range(0, part.num_rows, 512):
            yield pa.RecordBatch.from_arrays([_signed(_emitted(part.slice(at, 512))[0])], ["key"])


def _variant_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in batches:
        for at in range(0, part.num_rows, 512):
            some = part.slice(at, 512)
            keys, role, owner = _emitted(some)
            took = some.select(["line", "first"]).take(pa.array(owner))
            yield pa.RecordBatch.from_arrays([_signed(keys), pa.array(role), *took.columns], ["key", "role", "line", "first"])


def _sized(df: DataFrame, scratch: Scratch) -> DataFrame:
    """``df`` stored, and marked for a broadcast if it was counted to be small."""
    held = scratch.keep(df)
    return F.broadcast(held) if held.count() <= BROADCAST_ROWS else held


def dropped_lines(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS) -> DataFrame:
    """(doc, dropped, n_near): line numbers (from 0) to drop from each document that loses any."""
    kind = docs.schema[key].dataType.simpleString()
    lines = scratch.keep(_lines(docs, key, text, min_words, near_words))
    seen = lines.groupBy("line").agg(F.min(F.struct("doc", "no")).alias("first"), F.count(F.lit(1)).alias("n"))
    seen = scratch.keep(seen)
    halves = lines.where(F.size("halves") > 0).select("line", F.posexplode("halves").alias("place", "half"))
    common = halves.groupBy("half").agg(F.min("line").alias("lo"), F.max("line").alias("hi")).where("lo <> hi").select("half")
    sharing = halves.join(_sized(common, scratch), "half").groupBy("line").agg(F.expr("bit_or(shiftleft(1, place))").alias("shared"))
    near = scratch.keep(_sized(sharing, scratch).join(seen.select("line", "first"), "line"))
    wanted = near.select(F.col("first.doc").alias(key), F.col("first.no").alias("no")).groupBy(key).agg(F.collect_set("no").alias("wanted"))
    found = _words(docs.select(key, text).join(_sized(wanted, scratch), key), key, text).dropDuplicates(["line"])
    words = scratch.keep(found.join(near, "line"))
    scratch.tidy()
    # a line emits no key twice: a key counted twice is one of two lines
    met_twice = words.select("words", "shared").mapInArrow(_variant_keys, "key long").groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    rows = words.select("line", "first", "words", "shared").mapInArrow(_variant_rows, f"key long, role int, line long, first struct<doc: {kind}, no: int>")
    rows = scratch.keep(rows.join(_sized(met_twice, scratch), "key", "left_semi"))
    best = [F.min(F.when(F.col("role") == r, F.struct("first", "line"))).alias(f"m{r}") for r in (0, 1, 2)]
    told = rows.groupBy("key").agg(*best)
    met = rows.join(told, "key").select("line", "first", F.when(F.col("role") == 0, F.col("m0")).when(F.col("role") == 1, F.col("m2")).otherwise(F.col("m1")).alias("m"))
    earlier = met.where(F.col("m.first") < F.col("first")).groupBy("line").agg(F.min("m").alias("m")).select("line", F.col("m.line").alias("other"))
    of = words.select(F.col("line").alias("other"), F.col("words").alias("other_words"))
    compared = earlier.join(words.select("line", "words"), "line").join(of, "other")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            ok = [within_one_edit(a, b) for a, b in zip(part.column("words").to_pylist(), part.column("other_words").to_pylist(), strict=True)]
            yield part.select(["line"]).filter(pa.array(ok, pa.bool_()))

    close = scratch.keep(compared.select("line", "words", "other_words").mapInArrow(verify, "line long"))
    verdict = seen.join(close.withColumn("near", F.lit(True)), "line", "left").where("n > 1 OR near").select("line", "first", "near")
    out = lines.select("line", "doc", "no").join(verdict, "line").where(F.coalesce("near", F.lit(False)) | (F.struct("doc", "no") != F.col("first")))
    return out.groupBy("doc").agg(F.sort_array(F.collect_set("no")).alias("dropped"), F.count_if("near").alias("n_near"))


def without_repeated_lines(docs: DataFrame, scratch: Scratch, key: str = "doc_id", text: str = "text", **bounds) -> DataFrame:
    """``docs`` with the dropped lines taken out of their texts, and ``lines_dropped``."""
    dropped = scratch.keep(dropped_lines(docs, scratch, key, text, **bounds).select(F.col("doc").alias(key), F.col("dropped").alias("_dropped")))
    joined = docs.join(dropped, key, "left")
    left = F.array_join(F.filter(F.split(text, "\n"), lambda _, i: ~F.array_contains("_dropped", i)), "\n")
    changed = F.when(F.col("_dropped").isNotNull(), left).otherwise(F.col(text))
    count = F.coalesce(F.size("_dropped"), F.lit(0))
    return joined.select(*[changed.alias(text) if c == text else F.col(c) for c in docs.columns], F.when(F.col("_dropped").isNull(), 0).otherwise(count).alias("lines_dropped"))
