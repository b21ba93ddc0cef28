"""Token totals, near copies in many buckets, verified candidates."""

import random

import public_tokenizers
import pytest
import tokenizers
from thallus.llm import minhash, token_counts
from thallus.runtime import Scratch


def test_totals_list_no_prefixes():
    """The total is the library's and the last prefix count, and no list of prefix counts is made for it."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    library, counter, other = tokenizers.Tokenizer.from_file(path), token_counts.PrefixCounter(path), token_counts.PrefixCounter(path)
    draw, parts = random.Random(4), ["'re", "'ll", " ", "\n", "  ", "　", " \n", "日本", "foo", "Bar", "12", "…", "é", "x", "\x0b"]
    texts = ["", "one plain line", "two  blanks\n\n and\tmore \n"] + ["".join(draw.choices(parts, k=draw.randint(1, 14))) for _ in range(400)]
    for text in texts:
        listed = other.counts(text)
        assert counter.total(text) == len(library.encode(text, add_special_tokens=False).ids) == (int(listed[-1]) if len(listed) else 0)
    assert counter.total(None) == 0 and not (counter.held or counter.after or counter.known)
    special = "a <|endoftext|> b"
    assert counter.total(special) == len(library.encode(special, add_special_tokens=False).ids)


@pytest.mark.parametrize("limit", [0, 64 << 20])
def test_only_candidates_are_compared(spark, monkeypatch, limit):
    """Texts and registers of texts that share no bucket stay out of the verification, on both paths of the join."""
    draw, seen, verified = random.Random(7), [], minhash._verified

    def watched(pairs, known, sets, threshold, scratch):
        seen.append((known.count(), sets.count()))
        return verified(pairs, known, sets, threshold, scratch)

    monkeypatch.setattr(minhash, "_verified", watched)
    monkeypatch.setattr(minhash, "BROADCAST_BYTES", limit)
    plain = [" ".join(f"w{draw.randrange(10**9)}" for _ in range(120)) for _ in range(60)]
    rows = [(k, t) for k, t in enumerate(plain)] + [(100, plain[0] + " more"), (101, plain[7].replace(" ", " x ", 1)), (102, plain[3]), (None, plain[5])]
    got = {r.doc_id: (r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark), (85, 100)).collect()}
    assert seen and all(known == sets == 4 for known, sets in seen)
    joined = {100: 0, 101: 7, 102: 3}
    assert got == {k: (joined.get(k, k), k not in joined) for k, _ in rows}


def test_many_singles_in_one_bucket_take_few_rounds(spark, monkeypatch):
    """Texts that meet in every bucket but link with none: leaders grow fourfold a round."""
    rounds, verified = [], minhash._verified
    monkeypatch.setattr(minhash, "_verified", lambda *a: rounds.append(1) or verified(*a))
    monkeypatch.setattr(minhash, "band_keys", lambda levels: minhash.np.zeros((len(levels), 2), minhash.np.int64))
    words = lambda name, n: " ".join(f"{name}{k}" for k in range(n))
    rows = [(7 * a + b, f"{words(f'a{a}x', 8)} {words('s', 60)} {words(f'b{b}x', 8)}") for a in range(7) for b in range(7)][:40]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), Scratch(spark), (85, 100)).collect()
    assert len(got) == 40 and all(r.component_id == r.doc_id and r.kept for r in got)
    assert 1 < len(rounds) <= 5  # twofold, at least six
