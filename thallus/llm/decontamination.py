"""Benchmark decontamination: broadcast window hashes, scan of all token windows, exact check of hits.

Texts are normalised to words: A-Z in lower case, everything but digits, letters and characters
beyond ASCII separates.  Windows are ``n`` consecutive words of an item (an item of fewer words is
one window).  Documents are scanned where they lie: every word is hashed once, every window is the
hash of ``n`` word hashes, looked up in the broadcast set; on a hit the words themselves are
compared.  Only one row per document and the hits leave the scan.

The broadcast set is measured first.  Beyond ``BLOCK_BYTES`` it is dealt by hash into blocks and
the documents are scanned once per block, so what is broadcast never grows with the benchmark.
All of it is DataFrame functions.

Edge cases: a null or wordless text has no words, hits nothing and is clean; a null or wordless
item has no windows; items of equal id count as one item, an item with a null id marks words but is
not counted or listed; rows are judged by (id, text), so repeated rows all get the same result, and
rows of equal id but different text each get their own; an empty table gives no rows, an empty
benchmark hits nothing; other columns are kept by ``decontaminated`` whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import Scratch

WINDOW_WORDS = 10
#: a block of the broadcast set, measured as text bytes plus what a row takes besides
BLOCK_BYTES, ROW_BYTES = 32 << 20, 48
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: characters between words, in normalised and in given texts (fixed by the contract)
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
GAP_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"


def normal_words(text: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower()), GAP), "")


def _hashes(words: Column, n: int) -> Column:
    """Hash of every window of ``n`` of the (hashed) words; NULL with fewer words."""
    starts = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n))
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(n)]))


def _hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _once(df: DataFrame, value: Column, name: str, *others: Column) -> DataFrame:
    """``value`` as a column computed once per row: a generator keeps it from being copied into later expressions."""
    return df.select(*others, F.explode_outer(F.array(value)).alias(name))


def windows(benchmark: DataFrame, n: int = WINDOW_WORDS, ident: str = "item_id", text: str = "text") -> DataFrame:
    """len, hash, phrase, items: each distinct window with the ids of the items that hold it."""
    worded = _once(benchmark, normal_words(F.col(text)), "words", F.col(ident).alias("item")).where(F.size("words") > 0)
    size = F.least(F.size("words"), F.lit(n))
    cut = worded.select("item", size.alias("len"), F.explode(F.transform(F.sequence(F.lit(0), F.size("words") - size), lambda i: F.slice("words", i + 1, size))).alias("part"))
    key = F.lit(None).cast("long")
    for k in range(1, n + 1):
        key = F.when(F.col("len") == k, F.xxhash64(*[F.xxhash64(F.get("part", F.lit(j))) for j in range(k)])).otherwise(key)
    rows = cut.select("len", key.alias("hash"), F.array_join("part", " ").alias("phrase"), "item")
    return rows.groupBy("len", "hash", "phrase").agg(F.collect_set("item").alias("items"))


def _scan(docs: DataFrame, block: DataFrame, lengths: list[int], heads: bool) -> DataFrame:
    """doc, print, n_words, at, len, phrase: the hits of one block, and a row without phrase per document if ``heads``."""
    parts = F.array(*[
        F.struct(F.lit(n).alias("len"), (F.concat(F.coalesce(_hashes(F.col("hashed"), n), F.array().cast("array<bigint>")), F.array(F.lit(None).cast("long")))
                                         if heads and k == 0 else _hashes(F.col("hashed"), n)).alias("hashes"))
        for k, n in enumerate(lengths)
    ])
    worded = _once(docs, normal_words(F.col("text")), "words", F.col("doc"), F.xxhash64("text").alias("print"))
    hashed = _once(worded, _hashed(F.col("words")), "hashed", F.col("doc"), F.col("print"), F.col("words"))
    cut = hashed.select("doc", "print", "words", F.inline(parts))
    # an outer generator: an inner one would first count its input in a filter, and so hash everything twice
    dealt = cut.select("doc", "print", "words", "len", F.posexplode_outer("hashes").alias("at", "hash"))
    known = F.broadcast(block.select(F.col("len").alias("w_len"), F.col("hash").alias("w_hash"), "phrase"))
    same = (F.col("hash") == F.col("w_hash")) & (F.col("len") == F.col("w_len"))
    same &= F.array_join(F.slice("words", F.col("at") + 1, F.col("len")), " ") == F.col("phrase")
    out = ["doc", "print", F.size("words").cast("long").alias("n_words"), "at", F.col("len").cast("int").alias("len"), "phrase"]
    if not heads:
        return dealt.join(known, same).select(*out)
    head = F.col("at").isNotNull() & F.col("hash").isNull()
    return dealt.join(known, same, "left").where(head | F.col("phrase").isNotNull()).select(*out)


def scanned(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, n: int = WINDOW_WORDS, ident: str = "doc_id", text: str = "text",
            item: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(heads, runs, items): doc, print, n_words of every row; the maximal hit runs [start, stop) of
    words; the items met, both per (doc, print).  Stored tables, so the texts are read once per block."""
    rows = docs.select(F.col(ident).alias("doc"), F.col(text).alias("text"))
    known = scratch.keep(windows(benchmark, n, item, item_text))
    size = F.octet_length("phrase") + 8 * F.size("items") + ROW_BYTES
    measured = known.groupBy("len").agg(F.sum(size).alias("bytes")).orderBy(F.desc("len")).collect()  # n rows at most
    lengths = [r["len"] for r in measured] or [n]
    blocks = max(1, math.ceil(sum(r["bytes"] for r in measured) / block_bytes))
    found = []
    for b in range(blocks):
        block = known.where(F.pmod("hash", F.lit(blocks)) == b) if blocks > 1 else known
        found.append((block, scratch.keep(_scan(rows, block, lengths, heads=b == 0))))
    heads = found[0][1].where("phrase IS NULL").select("doc", "print", "n_words")
    hits = [(block, hit.where("phrase IS NOT NULL")) for block, hit in found]
    key = ["doc", "print"]

    def all_of(tables: list[DataFrame]) -> DataFrame:
        out = tables[0]
        for t in tables[1:]:
            out = out.unionByName(t)
        return out

    places = all_of([hit.select(*key, "at", "len") for _, hit in hits]).groupBy(*key, "at").agg(F.max("len").alias("len"))
    stop = F.col("at") + F.col("len")
    order = Window.partitionBy(*key).orderBy("at")
    reached = F.max(stop).over(order.rowsBetween(Window.unboundedPreceding, -1))
    starts = places.withColumn("stop", stop).withColumn("fresh", F.when(F.coalesce(F.col("at") > reached, F.lit(True)), 1).otherwise(0))
    numbered = starts.withColumn("run", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = numbered.groupBy(*key, "run").agg(F.min("at").alias("start"), F.max("stop").alias("stop"))
    met = [
        hit.select(*key, "phrase").distinct().join(F.broadcast(block.select("phrase", "items")), "phrase").select(*key, F.explode("items").alias("item"))
        for block, hit in hits
    ]
    return heads, runs, all_of(met)


def contamination(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, n: int = WINDOW_WORDS, ident: str = "doc_id", text: str = "text",
                  item: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per document: ident, n_words, n_hit (words inside a hit window), n_items, items (ids as sorted strings)."""
    heads, runs, items = scanned(docs, benchmark, scratch, n, ident, text, item, item_text, block_bytes)
    covered = runs.groupBy("doc", "print").agg(F.sum(F.col("stop") - F.col("start")).cast("long").alias("n_hit"))
    named = items.groupBy("doc", "print").agg(F.sort_array(F.collect_set(F.col("item").cast("string"))).alias("items"))
    per_text = covered.join(named.withColumnsRenamed({"doc": "n_doc", "print": "n_print"}), F.col("doc").eqNullSafe(F.col("n_doc")) & (F.col("print") == F.col("n_print")), "left")
    per_text = per_text.select(F.col("doc").alias("h_doc"), F.col("print").alias("h_print"), "n_hit", "items")
    joined = heads.join(per_text, F.col("doc").eqNullSafe(F.col("h_doc")) & (F.col("print") == F.col("h_print")), "left")
    met = F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(F.col("doc").alias(ident), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(met).cast("long").alias("n_items"), met.alias("items"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, scratch: Scratch, remove: str = "spans", n: int = WINDOW_WORDS, ident: str = "doc_id", text: str = "text",
                   item: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``docs`` without its contaminated documents (``remove='documents'``), or with every hit word
    and the gap after it cut from its text (``'spans'``; a clean text stays as it was, byte for byte)."""
    if remove not in ("spans", "documents"):
        raise ValueError("remove is 'spans' or 'documents'")
    _, runs, _ = scanned(docs, benchmark, scratch, n, ident, text, item, item_text, block_bytes)
    cuts = runs.groupBy(F.col("doc").alias("c_doc"), F.col("print").alias("c_print")).agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("cuts"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.xxhash64(F.col(text)).alias("print"))
    same = F.col(f"row.{ident}").eqNullSafe(F.col("c_doc")) & (F.col("print") == F.col("c_print"))
    if remove == "documents":
        return rows.join(cuts, same, "left_anti").select("row.*")
    joined = rows.join(cuts, same, "left")
    given = F.col(f"row.{text}")
    # each piece is a word with the gap after it; what lies between two cuts is kept
    pieces = F.regexp_extract_all(given, F.lit(f"{GAP_ANY_CASE.replace('[', '[^', 1)}+{GAP_ANY_CASE}*"), F.lit(0))
    ends = F.concat(F.col("cuts.start"), F.array(F.lit(None).cast("int")))
    kept = F.transform(
        F.array(pieces),
        lambda p: F.concat(
            F.regexp_extract(given, f"^{GAP_ANY_CASE}*", 0),
            F.array_join(F.transform(
                F.sequence(F.lit(0), F.size("cuts")),
                lambda k: F.array_join(F.slice(
                    p, F.when(k == 0, 0).otherwise(F.get(F.col("cuts.stop"), k - 1)) + 1,
                    F.coalesce(F.get(ends, k), F.size(p)) - F.when(k == 0, 0).otherwise(F.get(F.col("cuts.stop"), k - 1))), ""),
            ), ""),
        ),
    )[0]
    cleaned = F.when(F.col("cuts").isNull(), given).otherwise(kept)
    return joined.select(*[cleaned.alias(c) if c == text else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
