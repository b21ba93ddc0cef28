"""Decontamination, conversation trie and hard negatives against brute force, and their edge cases."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from thallus.llm import conversation_trie, decontamination, hard_negatives
from thallus.llm.queries import QUERIES
from thallus.runtime import Scratch

FOLDER = "/root/testdata/sf0.001"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# -- decontamination ---------------------------------------------------------------

def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(UPPER))


def hits(docs, items, n):
    cut = {}
    for item, text in items:
        words = words_of(text)
        k = min(len(words), n)
        for i in range(len(words) - k + 1 if k else 0):
            cut.setdefault(tuple(words[i : i + k]), set()).add(item)
    out = []
    for doc, text in docs:
        words, hit, met = words_of(text), set(), set()
        for k in {len(w) for w in cut}:
            for i in range(len(words) - k + 1):
                if tuple(words[i : i + k]) in cut:
                    hit |= set(range(i, i + k))
                    met |= cut[tuple(words[i : i + k])]
        out.append((doc, len(words), len(hit), sorted(str(m) for m in met if m is not None)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_bytes", [1 << 25, 400])
def test_contamination_equals_brute_force(spark, block_bytes):
    draw = random.Random(5)
    word = lambda: draw.choice(["Ab", "bc", "ça", "Éd", "x9", "zz", "q"])
    line = lambda k: draw.choice([" ", "-", "\n", "_"]).join(word() for _ in range(k))
    items = [(i, line(draw.choice([1, 2, 3, 4, 5, 9]))) for i in range(6)] + [(6, None), (7, "..."), (3, line(4)), (None, line(3))]
    docs = [(d, line(draw.choice([0, 1, 3, 8, 40]))) for d in range(40)] + [(100, None), (100, line(12)), (None, line(15)), (101, "")]
    docs += docs[:2]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("words", F.lit(1)).withColumn("print", F.lit("x"))
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("phrase", F.lit(2))
    got = decontamination.contamination(frame, bench, Scratch(spark), n=4, block_bytes=block_bytes).collect()
    assert sorted([(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in got], key=repr) == hits(docs, items, 4)
    assert all(r.n_items == len(r["items"]) for r in got)


def test_spans_and_documents_are_removed(spark):
    passage = "one Two three four five six seven eight nine ten"
    docs = [(1, f"Keep, this. {passage.upper()}! And this"), (2, "clean  text."), (3, passage), (4, None), (1, f"{passage}. {passage} eleven")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"row": F.lit("r"), "cuts": F.lit(0)})
    bench = spark.createDataFrame([(9, passage)], "item_id long, text string")
    cut = decontamination.decontaminated(frame, bench, Scratch(spark))
    assert cut.columns == frame.columns
    assert sorted((r.doc_id, r.text) for r in cut.collect() if r.text is not None) == [(1, "Keep, this. And this"), (1, "eleven"), (2, "clean  text."), (3, "")]
    assert cut.where("text is null").count() == 1
    left = decontamination.decontaminated(frame, bench, Scratch(spark), remove="documents")
    assert sorted(r.doc_id for r in left.collect()) == [2, 4]
    nothing = bench.where("false")
    assert decontamination.contamination(frame, nothing, Scratch(spark)).where("n_hit > 0").count() == 0
    assert decontamination.contamination(frame.where("false"), bench, Scratch(spark)).count() == 0
    with pytest.raises(ValueError):
        decontamination.decontaminated(frame, bench, Scratch(spark), remove="lines")


# -- conversation trie -------------------------------------------------------------

def trie_of(rows):
    convs = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            said = text or ""
            convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", hashlib.sha256(said.encode()).hexdigest(), said))
    own = {c: [(r[2], r[4]) for r in sorted(rows)] for c, rows in convs.items()}
    built = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        built[c] = own.get(c - c % 100 if c >= 0 else c + (-c) % 100, [])[:h] + turns[h:]
    members, ends, kids = {}, {}, {}
    for c, turns in built.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
            if d:
                kids.setdefault(tuple(turns[: d - 1]), set()).add(tuple(turns[:d]))
        ends.setdefault(tuple(turns), []).append(c)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = kids.get(node, ())
        leaves[node] = sum(leaves[k] for k in below) if below else 1
        saved[node] = sum(saved[k] for k in below) + (len(members[node]) - 1) * (len(node[-1][1]) if node else 0)
    return sorted(
        (min(m), len(node), min(members[node[:-1]]) if node else None, len(m), len(kids.get(node, ())), leaves[node], saved[node],
         hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest())
        for node, m in members.items()
    ) if built else []


def made_conversations(seed, n):
    draw = random.Random(seed)
    rows = []
    for c in [*range(0, n), *range(200, 200 + n), 1000, 1001]:
        for t in range(draw.choice([1, 1, 2, 3, 6, 9])):
            rows.append((c, draw.choice([t, t, t, None]), draw.choice(["user", "user", None]), draw.choice(["a", "a", "bb", "é😀", None])))
    return [*rows, *rows[:3], (None, 0, "user", "x")]


@pytest.mark.parametrize("limits", [{}, {"shard_rows": 8, "shard_share": 0.0, "queue_rows": 2}])
def test_trie_equals_brute_force(spark, limits):
    rows = made_conversations(3, 40)
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"conv": F.lit(1), "p": F.lit("x"), "k1": F.lit(0)})
    conv = F.col("conv")
    out = conversation_trie.conversation_trie(frame, Scratch(spark), conv - conv % 100, F.crc32(conv.cast("string").cast("binary")) % 6, **limits)
    order = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted((tuple(r[c] for c in order) for r in out.collect()), key=repr) == sorted(trie_of(rows), key=repr)


def test_trie_of_one_and_of_none(spark):
    frame = spark.createDataFrame([(7, 0, "user", "hello"), (7, 1, "bot", "hi")], "conv_id long, turn long, role string, text string")
    conv = F.col("conv")
    for part in (frame, frame.where("false")):
        out = conversation_trie.conversation_trie(part, Scratch(spark), conv, F.lit(0)).collect()
        assert sorted((r.depth, r.n_children, r.n_leaves, r.saved_tokens) for r in out) == ([(0, 1, 1, 0), (1, 1, 1, 0), (2, 0, 1, 0)] if part is frame else [])


def test_queue_spills_and_keeps_its_order():
    draw = random.Random(1)
    items = [(draw.randrange(50), draw.randrange(9), k) for k in range(2000)]
    queue = conversation_trie.SpillingQueue(limit=64)
    for item in items:
        queue.push(item)
    assert queue.spilled > 20
    out = []
    for level in range(50):
        got = list(queue.pop_through((level,)))
        assert all(i[0] == level for i in got)
        out += got
    assert out == sorted(items)


# -- hard negatives ----------------------------------------------------------------

def mined_by_hand(rows, k=5):
    usable = [r for r in rows if None not in r and r[2] is not None and all(x is not None for x in r[2])]
    anchors, out = sorted({(i, lab, tuple(v)) for i, lab, v in usable if i % 100 == 0}), []
    for a, lab, v in anchors:
        score = lambda w: sum(x * y for x, y in zip(v, w, strict=True))  # noqa: E731,B023
        near = sorted((-score(w), i) for i, other, w in usable if other == lab and i != a and len(w) == len(v))[:k]
        for s, p in near:
            far = sorted((-score(w), i) for i, other, w in usable if other != lab and len(w) == len(v) and -80 * s <= 100 * score(w) <= -100 * s)
            out += [(a, p, r + 1, i, -s, -t) for r, (t, i) in enumerate(far[:k])]
    return sorted(out)


@pytest.mark.parametrize("spread,block_bytes", [(3, 1 << 24), (9, 6000)])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, spread, block_bytes):
    monkeypatch.setattr(hard_negatives, "SEED_ROWS", 60)
    monkeypatch.setattr(hard_negatives, "CLUSTER_MEMBERS", 3)
    draw = random.Random(spread)
    centres = [[draw.randrange(-40, 40) for _ in range(6)] for _ in range(5)]
    rows = [(i * 10, draw.randrange(4), [x + draw.randrange(-spread, spread + 1) for x in draw.choice(centres)]) for i in range(400)]
    rows += [(4100, 1, [0] * 6), (4200, 2, [1, 2]), (4201, 2, [3, 1]), (4202, 1, [3, 1]), (4300, None, [1] * 6), (4400, 1, None), (None, 1, [1] * 6), (4500, 1, [1, None, 1, 1, 1, 1]), (4600, 0, [])]
    rows += [rows[5], rows[10]]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<long>").withColumns({"anchor": F.lit(1), "slot": F.lit("x")})
    out = hard_negatives.mined(frame, F.col("id") % 100 == 0, Scratch(spark), block_bytes=block_bytes)
    order = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = sorted(tuple(r[c] for c in order) for r in out.collect())
    want = mined_by_hand(rows)
    assert got == sorted(want) and len(got) > 100


def test_walks_end_early_on_clustered_vectors(spark):
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(2)
    centres = rng.normal(size=(40, 16)) * 100
    x = (centres[rng.integers(0, 40, 4000)] + rng.normal(size=(4000, 16))).astype(np.int64)
    label, ids = (np.arange(4000) % 3).astype(np.int64), np.arange(4000)
    steps = []
    scored = hard_negatives._scores
    hard_negatives._scores = lambda a, b, e: steps.append(a.shape[0] * b.shape[0]) or scored(a, b, e)
    try:
        member = np.flatnonzero((x @ centres[0]) > 0.9 * (centres[0] ** 2).sum())[:20]
        u, _ = hard_negatives._directions(x[member])
        cluster = hard_negatives._Cluster(16, u.mean(axis=0) / np.linalg.norm(u.mean(axis=0)), {"anchor": member, "id": ids[member], "label": label[member], "vector": x[member]})
        batch = pa.RecordBatch.from_arrays([pa.array(ids), pa.array(label), pa.array(list(x), pa.list_(pa.int64()))], ["id", "label", "vector"])
        list(hard_negatives._walk(iter([batch]), [cluster], True, {}, {}, 1, 5))
    finally:
        hard_negatives._scores = scored
    assert sum(steps) < 0.2 * len(member) * 4000


def test_components_without_a_number(spark):
    rows = [(1, 1, [0.5, 1.0]), (2, 1, [float("nan"), 1.0]), (3, 1, [float("inf"), 1.0]), (4, 1, [None, 1.0]), (5, 1, [-0.001, 2.0]), (6, 1, [1e30, 1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    got = {r.vec_id: r.embedding for r in hard_negatives.quantised(frame, 256).collect()}
    assert got == {1: [128, 256], 2: None, 3: None, 4: None, 5: [-1, 512], 6: None}


@pytest.mark.parametrize("name", ["op11_decontamination", "op12_conversation_trie", "op13_hard_negatives"])
def test_queries_run(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0
