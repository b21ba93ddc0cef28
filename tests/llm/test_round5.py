"""Token totals of words with parts in common, families of near copies."""

import random

import numpy as np
import public_tokenizers
import tokenizers

from thallus.llm import minhash, token_counts
from thallus.runtime import Scratch


def test_totals_share_the_parts_of_words(monkeypatch):
    """Letters are walked once whatever marks follow, a common beginning only once, and totals are the library's."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    counter, walked, pairs = token_counts.PrefixCounter(path), [], []
    walk, longer = counter._walk, counter.longer
    counter._walk = lambda data: walked.append(data) or walk(data)

    class Seen(dict):
        def get(self, key, default=None):
            pairs.append(key)
            return longer.get(key, default)

    counter.longer = Seen()
    text = "x a. a, thtion thtion. thtion, thtionery thtion,\nthtion."
    assert counter.totals([text, None, "", text])[0] == len(tokenizers.Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids)
    assert walked.count(b" thtion") == 1 and walked.count(b".") == 1
    assert walked.index(b" thtionery") > walked.index(b" thtion") and len(pairs) < sum(map(len, walked)) - 6
    # words pushed out and taken up again, odd letters, contractions, runs of blanks, special strings
    monkeypatch.setattr(token_counts, "UNITS_HELD", 7)
    luck, few, library = random.Random(5), token_counts.PrefixCounter(path), tokenizers.Tokenizer.from_file(path)
    letters = [*"abcstTéÄøɏɐƀʰªº'.,!#\n  12—", "<|endoftext|>", " the", "'ll"]
    texts = ["".join(luck.choices(letters, k=luck.randint(0, 40))) for _ in range(800)]
    assert few.totals(texts) == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]
    assert [few.total(t) for t in texts[:200]] == [int(few.counts(t)[-1]) if t else 0 for t in texts[:200]]


def alike(texts):
    """Components of ids by brute force: (id, text) rows, linked at 85 %."""
    sets, root = [], {i: i for i, _ in texts}
    for i, t in texts:
        words = t.lower().split()
        sets.append((i, {tuple(words[k : k + 5]) for k in range(len(words) - 4)}))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if 100 * len(a & b) >= 85 * len(a | b):
                low, high = sorted((top(i), top(j)))
                root[high] = low
    return {i: top(i) for i in root}


def test_parities_bound_the_difference():
    draw = np.random.default_rng(3)
    for _ in range(200):
        a, b = (np.unique(draw.integers(0, 1 << 63, draw.integers(1, 900), dtype=np.uint64)) for _ in range(2))
        b = np.union1d(b[: draw.integers(0, len(b))], a[: draw.integers(1, len(a) + 1)])
        bits = int(np.bitwise_count((minhash.parities(a) ^ minhash.parities(b)).view(np.uint64)).sum())
        assert bits <= len(np.setxor1d(a, b)) and (bits - len(np.setxor1d(a, b))) % 2 == 0


def test_unlike_members_of_a_family_make_no_pairs(spark, monkeypatch):
    """Texts of a family whose shingles all occur in others, but that differ too much, are told apart before they are paired."""
    draw, paired, verified = random.Random(11), [], minhash._verified

    def watched(pairs, *rest):
        paired.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(minhash, "_verified", watched)
    blocks = [[" ".join(f"w{draw.randrange(10**9)}" for _ in range(6)) for _ in range(2)] for _ in range(40)]
    texts = [(i, " ".join(b[draw.random() < 0.09] for b in blocks)) for i in range(120)]
    texts += [(200 + i, t + " more") for i, t in texts[:10]]
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), Scratch(spark), (85, 100)).collect()}
    assert got == alike(texts)
    assert sum(paired) <= 150, paired


def test_an_id_with_several_texts_keeps_the_links_of_each(spark):
    draw = random.Random(12)
    words = [f"w{draw.randrange(10**9)}" for _ in range(1200)]
    short, long = " ".join(words[:100]), " ".join(words[200:900])
    texts = [(5, short), (5, long), (9, short + " end"), (12, long + " end"), (20, " ".join(words[900:1100]))]
    got = {(r.doc_id, r.component_id) for r in minhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), Scratch(spark), (85, 100)).collect()}
    assert got == {(5, 5), (9, 5), (12, 5), (20, 20)}
