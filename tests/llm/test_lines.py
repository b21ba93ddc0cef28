"""Line dedup: halves that near lines share, and the shuffled way beyond the broadcast bound."""

import random

import numpy as np

from thallus.llm import line_dedup
from thallus.runtime import Scratch


def halves_of(words):
    hashes = np.array(words, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return hashes, line_dedup.line_keys(hashes, np.array([0]), np.array([len(hashes)]))[1][0]


def test_near_lines_meet_outside_their_shared_halves():
    luck = random.Random(1)
    for _ in range(3000):
        a = [luck.randint(1, 2) for _ in range(luck.randint(8, 13))]
        b, place = list(a), luck.randint(0, len(a) - 1)
        if luck.random() < 0.4:
            b.insert(luck.randint(0, len(a)), luck.randint(1, 3))
        else:
            b[place] = 3
        (ha, ka), (hb, kb) = halves_of(a), halves_of(b)
        shared = [sum(1 << j for j in range(3) if k[j] in other) for k, other in ((ka, kb), (kb, ka))]
        (ca, sa, wa), (cb, sb, wb) = (line_dedup.variants(h, line_dedup.outside(len(h), bits)) for h, bits in zip((ha, hb), shared, strict=True))
        assert set(ca.tolist()) & set(cb.tolist()) or wa in sb or wb in sa


def test_shuffled_sides_give_the_same_lines(spark, monkeypatch):
    words = "the quick brown fox jumps over the lazy dog near a river bank".split()
    texts = ["\n".join(" ".join(words[:k] + [f"w{i % 3}"] + words[k + 1 :]) for k in (1, 6, 11)) for i in range(6)] + [" ".join(words), None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = lambda: {(r["doc"], tuple(r["dropped"]), r["n_near"]) for r in line_dedup.dropped_lines(docs, Scratch(spark)).collect()}
    usual = found()
    monkeypatch.setattr(line_dedup, "BROADCAST_ROWS", 0)
    assert usual and found() == usual
