"""Operators for training corpora, against brute force, library results and the laws they promise."""

import hashlib
import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer  # noqa: E402

import corpus_pipeline  # noqa: E402
from thallus.llm import (  # noqa: E402
    embedding_dedup, line_dedup, minhash, mixing, packing, quality_classifier, quality_rules, sharding, suffix_dedup, text_stats, token_counts,
)
from thallus.llm.common import WordHashes, components, ranked  # noqa: E402
from thallus.runtime import Scratch  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, row string"
LABELS = "doc_id long, quality int, toxic int"


def words_of(n, seed, vocabulary=400):
    luck = random.Random(str(seed))
    return [f"w{luck.randrange(vocabulary)}x" for _ in range(n)]


@pytest.fixture(scope="module")
def corpus(spark):
    texts = [None, "", "  \n ", "one", "Two Words"]
    for k in range(30):
        lines = [" ".join(words_of(12, (k, j))) for j in range(6)]
        texts.append("\n".join(lines))
        if k % 3 == 0:
            texts.append("\n".join(lines))  # equal
        if k % 4 == 0:
            edited = words_of(12, (k, 2))
            edited[5] = "changed"
            texts.append("\n".join([*lines[:2], " ".join(edited), *lines[3:]]))
    passage = " ".join(words_of(120, "shared"))
    texts += [f"{' '.join(words_of(40, n))} {passage} {' '.join(words_of(30, -n))}" for n in range(1, 5)]
    texts += [" ".join(words_of(9000, "long")), "bad### " * 30, "!!".join(words_of(40, 3)), "é漢字 'll <|endoftext|> don't\t\xa0x  y"]
    rows = [(n, t, "en", "s", len(t or ""), "clash", "clash") for n, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[8], (None, texts[9], None, None, None, None, None)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(n, int(n % 4 > 0), int(n % 9 == 0)) for n in range(60)] + [(None, 1, 0), (3, None, None)], LABELS)


def pairs_of(corpus):
    return [(r["doc_id"], r["text"]) for r in corpus.select("doc_id", "text").collect()]


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return frozenset([tuple(w)] if 0 < len(w) < 5 else [tuple(w[k : k + 5]) for k in range(len(w) - 4)])


def smallest_reachable(nodes, links):
    root = {n: n for n in nodes}
    for _ in nodes:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return root


@pytest.mark.parametrize("threshold", [(80, 100), (85, 100)])
def test_near_duplicates(spark, corpus, empty, threshold):
    num, den = threshold
    sets = {i: shingle_set(t) for i, t in pairs_of(corpus) if i is not None}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    want = smallest_reachable(sets, links)
    got = minhash.near_duplicates(corpus, Scratch(spark), threshold).collect()
    assert len(got) == corpus.count()
    for r in got:
        assert r["component_id"] == (None if r["doc_id"] is None else want[r["doc_id"]])
        assert r["kept"] == (r["doc_id"] == r["component_id"])
        assert r["doc_id"] is None or r["n_shingles"] == len(sets[r["doc_id"]])
    assert minhash.near_duplicates(empty, Scratch(spark)).count() == 0


def test_family_of_near_copies(spark):
    base = words_of(160, "family")
    rows = [(n, " ".join([*base[: n % 150], f"edit{n}", *base[n % 150 + 1 :]])) for n in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: shingle_set(t) for i, t in rows}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = smallest_reachable(sets, links)
    assert {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, Scratch(spark), (85, 100)).collect()} == want


def test_registers_merge_and_estimate():
    luck = np.random.default_rng(1)
    a, b = (luck.integers(0, 1 << 63, 4000, dtype=np.uint64) for _ in range(2))
    union = minhash.registers([np.concatenate([a, b])])
    assert (np.maximum(minhash.registers([a]), minhash.registers([b])) == union).all()
    near = np.concatenate([a[:3800], b[:200]])
    one, two, far = minhash.registers([a]), minhash.registers([near]), minhash.registers([b])
    n = np.array([4000.0])
    assert minhash.plausible(one, two, n, n, 0.85)[0] and not minhash.plausible(one, far, n, n, 0.85)[0]


def test_repeated_strings(spark, corpus, empty):
    rows = pairs_of(corpus)
    datas = [(t or "").encode() for _, t in rows]
    seen = Counter(d[p : p + 400] for d in datas for p in range(len(d) - 399))
    want = Counter()
    for (i, _), d in zip(rows, datas, strict=True):
        inside = np.zeros(len(d), bool)
        for p in range(len(d) - 399):
            if seen[d[p : p + 400]] > 1:
                inside[p : p + 400] = True
        spans = int((inside & ~np.concatenate(([False], inside[:-1]))[: len(d)]).sum())
        want[i, len(d), int(inside.sum()), spans, hashlib.sha256(np.frombuffer(d, np.uint8)[~inside].tobytes()).hexdigest()] += 1
    path = f"{spark.conf.get('spark.checkpoint.dir')}/corpus"
    corpus.write.mode("overwrite").parquet(path)
    got = suffix_dedup.without_repeats(spark.read.parquet(path), Scratch(spark))
    assert Counter(tuple(r) for r in got.collect()) == want
    assert sum(k[2] > 0 for k in want) > 20
    assert suffix_dedup.without_repeats(empty, Scratch(spark)).count() == 0


def test_suffix_ranks(spark):
    luck = random.Random(3)
    string = [luck.randrange(1, 4) for _ in range(60)]
    rows = spark.createDataFrame([(0, p, c) for p, c in enumerate(string)], "row long, place long, name long")
    got = sorted((r["rank"], r["place"]) for r in suffix_dedup.suffix_ranks(rows, Scratch(spark), 5).collect())
    assert [p for _, p in got] == sorted(range(60), key=lambda p: string[p:])


def test_rules(spark, corpus, empty, labels):
    def brute(text):
        w = text.encode().split() if text else []
        grams = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
        inside = {p for k in range(len(w) - 4) if grams[tuple(w[k : k + 5])] > 1 for p in range(k, k + 5)}
        lines = [x for x in (text or "").split("\n") if x.encode().split()]
        return len(w), sum(len(x.decode()) for x in w), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(inside)

    got = quality_rules.judged(corpus, labels, Scratch(spark)).collect()
    want = Counter((i, *brute(t)) for i, t in pairs_of(corpus))
    assert Counter((r["doc_id"], *(r[c] for c in text_stats.COUNTS[:5])) for r in got) == want
    assert all(r["base_failed"] == (r["n_words"] < 10 or 5 * r["n_repeat_words"] > r["n_words"]) and not (r["base_failed"] and r["kept"]) for r in got)
    assert quality_rules.judged(empty, labels, Scratch(spark)).count() == 0
    without = quality_rules.judged(corpus, labels.limit(0), Scratch(spark)).collect()
    assert all(r["kept"] != r["base_failed"] for r in without)


def test_forest_isolates():
    luck = np.random.default_rng(2)
    rows = luck.normal(0, 1, (2000, 3))
    forest = quality_rules.IsolationForest(rows)
    odd, usual = forest.scores(np.full((1, 3), 8.0))[0], forest.scores(rows)
    assert odd > np.quantile(usual, 0.999)
    assert quality_rules.threshold([(10, 1000, 0), (50, 0, 40), (20, 1, 10)]) == 20


def test_lines(spark, corpus, empty):
    occurrences = [(i, n, line.encode().lower().split()) for i, t in pairs_of(corpus) if i is not None for n, line in enumerate((t or "").split("\n"))]
    occurrences = [(i, n, [w.decode() for w in words]) for i, n, words in occurrences if len(words) >= 4]
    first = {}
    for i, n, words in sorted(occurrences):
        first.setdefault(tuple(words), (i, n))

    def distance_one(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))

    near = {a for a in first if len(a) >= 8 and any(len(b) >= 8 and first[b] < first[a] and distance_one(a, b) for b in first)}
    want = defaultdict(set)
    for i, n, words in occurrences:
        if tuple(words) in near or first[tuple(words)] != (i, n):
            want[i].add(n)
    got = line_dedup.dropped_lines(corpus, Scratch(spark)).collect()
    assert near and {r["doc"]: set(r["dropped"]) for r in got} == want
    cleaned = line_dedup.without_repeated_lines(corpus, Scratch(spark)).collect()
    texts = dict(pairs_of(corpus))
    for r in cleaned:
        if r["doc_id"] is not None and texts[r["doc_id"]] is not None:
            assert r["text"] == "\n".join(x for n, x in enumerate(texts[r["doc_id"]].split("\n")) if n not in want.get(r["doc_id"], ()))
    assert len(cleaned) == corpus.count() and line_dedup.dropped_lines(empty, Scratch(spark)).count() == 0


def test_token_counts(spark, corpus, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    n = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    got = token_counts.prefix_token_counts(corpus, path)
    for r in got.select("text", token_counts.total_tokens(F.col("prefix_tokens")).alias("n")).collect():
        assert r["n"] == n(r["text"] or "")
    assert token_counts.prefix_token_counts(empty, path).count() == 0
    counter, luck = token_counts.PrefixCounter(path), random.Random(4)
    parts = [*"ab1é'sreS-!?漢٣² \n\t\xa0 ​\x1c", "'re", "'ll", "  ", "\n\n", "the", "aaaa", "\U0001F600", "<|endoftext|>"]
    for _ in range(300):
        text = "".join(luck.choices(parts, k=luck.randrange(12)))
        assert counter.counts(text).tolist() == [n(text[: k + 1]) for k in range(len(text))]
    one = spark.createDataFrame([("the quick brown fox jumps",)], "text string")
    r = token_counts.prefix_token_counts(one, path).select(token_counts.tokens_of_prefix(F.col("prefix_tokens"), F.lit(9)), token_counts.longest_prefix(F.col("prefix_tokens"), F.lit(2)))
    assert tuple(r.first()) == (2, max(k for k in range(1, 26) if n("the quick brown fox jumps"[:k]) <= 2))


def test_packing(spark, corpus, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    scratch = Scratch(spark)
    got = packing.pack(scratch.keep(packing.pieces(corpus, path)), scratch).collect()
    ids_of = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in pairs_of(corpus)}
    want = Counter()
    for i, _ in pairs_of(corpus):
        for at in range(0, len(ids_of[i]), 2048):
            want[i, at, zlib.crc32(ids_of[i][at : at + 2048].tobytes()), len(ids_of[i])] += 1
    assert Counter((r["doc_id"], r["start"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    for _, own in itertools.groupby(sorted(got, key=lambda r: (r["sequence_id"], r["offset"])), key=lambda r: r["sequence_id"]):
        at = 0
        for r in own:
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
    assert packing.pack(scratch.keep(packing.pieces(empty, path)), scratch).count() == 0


def test_word_encoder(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    library, encoder = Tokenizer.from_file(path), packing.WordEncoder(path)
    monkeypatch.setattr(packing, "WORDS_HELD", 5)
    texts = ["<|ENDOFTEXT|> A", "x<|endoftext|>y <|StartOfText|>", "H\u0331 h\u0331 A\u030a \u0130I ΣΑΣ", "end, &&& it's. 5.! …, é,; a1b2,' 日本語ab ʰx ², x\u0301,", None, "", *(f"Again w{k} It'S {k % 3}" for k in range(20))]
    for some in (texts, texts[::-1], texts):
        for text, ids in zip(some, encoder.encode([t and t.encode() for t in some]), strict=True):
            assert np.frombuffer(ids, "<u4").tolist() == library.encode(text or "", add_special_tokens=False).ids, text


def test_cutting_stock():
    counts = {100: 40, 156: 40, 128: 11, 7: 300, 250: 3}
    plan = packing.cutting_stock(counts, 256)
    used = Counter()
    for pattern, times in plan:
        assert sum(c * k for c, k in pattern.items()) <= 256
        for c, k in pattern.items():
            used[c] += k * times
    assert used == counts
    assert sum(t for _, t in plan) <= -(-sum(c * n for c, n in counts.items()) // 256) + 3


def test_vectors(spark):
    luck = np.random.default_rng(5)
    centres = luck.normal(0, 1, (12, 16))
    rows = [(n, [float(x) for x in centres[n % 12] + luck.normal(0, 0.2, 16)], n % 2) for n in range(400)]
    rows += [(400, rows[0][1], 0), (401, None, 0), (402, [0.0] * 16, 0), (403, [float("nan")] * 16, 0), (404, rows[0][1], None), (405, [1.0, 2.0], 0), (None, rows[0][1], 0), (406, [], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r for r in embedding_dedup.near_vectors(table, Scratch(spark), cell_rows=40, block_rows=30).collect()}
    usable = {i: (np.array(v), g) for i, v, g in rows if i is not None and v and g is not None and np.isfinite(v).all() and np.any(v)}
    links = [(a, b) for (a, (x, g)), (b, (y, h)) in itertools.combinations(usable.items(), 2) if g == h and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.93]
    n = Counter(itertools.chain(*links))
    root = smallest_reachable(usable, links)
    assert len(got) == len(rows) and len(links) > 300
    for i, r in got.items():
        assert (r["n_links"], r["component_id"]) == (n[i], root.get(i, i)) and r["kept"] == (i == r["component_id"])
    assert embedding_dedup.near_vectors(table.limit(0), Scratch(spark)).count() == 0


def test_classifier(spark, empty, labels):
    rows = [(n, " ".join(words_of(50, n)) if n % 4 else " ".join(w + "###" for w in words_of(50, n)), "en", "s", n, "", "") for n in range(600)]
    docs = spark.createDataFrame([*rows, (600, None, None, None, None, None, None)], SCHEMA)
    known = spark.createDataFrame([(n, int(n % 4 > 0), 0) for n in range(600)], LABELS)
    machine = quality_classifier.fit(docs, known)
    got = quality_classifier.scored(docs, machine, out="p").select("doc_id", "p").collect()
    held = [r for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and r["doc_id"] < 600]
    assert len(got) == 601 and len(held) > 80 and all((r["p"] >= 0.3) == (r["doc_id"] % 4 > 0) for r in held)
    assert quality_classifier.scored(empty, machine).count() == 0
    assert quality_classifier.fit(docs, labels.limit(0)) == 1.0


def test_interactions_in_linear_time():
    machine = quality_classifier.FactorisationMachine(2)
    machine.vector[:] = np.random.default_rng(0).normal(0, 1, machine.vector.shape)
    begin, index, value = np.array([0, 4]), np.array([1, 5, 9, 40]), np.array([1.0, 2.0, 0.5, -1.0], np.float32)
    direct = sum(machine.vector[i] @ machine.vector[j] * x * y for (i, x), (j, y) in itertools.combinations(zip(index, value, strict=True), 2))
    assert machine.margins(begin, index, value)[0][0] == pytest.approx(direct, rel=1e-4)


def test_mixing(spark, corpus, empty, labels):
    domains = {"a": 0.7, "b": 0.3}
    known = labels.select("doc_id", F.when(F.col("quality") == 1, "a").when(F.col("quality") == 0, "b").alias("domain"))
    got = mixing.mixed(corpus, known, domains, Scratch(spark), full="a", scale=1.2).collect()
    p, tokens = np.array([r["posteriors"] for r in got]), np.array([r["n_tokens"] for r in got])
    assert len(got) == corpus.count() and np.allclose(p.sum(axis=1), 1)
    rate, has = np.array([r["rate"] for r in got]), tokens @ p
    expected = (tokens * rate) @ p
    target = np.array([0.7, 0.3]) * 1.2 * has[0] / 0.7
    assert (rate >= 0).all() and np.abs(expected / target - 1).max() < 0.02
    assert all(abs(r["copies"] - r["rate"]) < 1 for r in got)
    assert mixing.mixed(empty, known, domains, Scratch(spark), full="a", scale=1.0).count() == 0


def test_mixing_meets_reachable_targets_and_says_so(spark):
    draw = np.random.default_rng(4)
    p = draw.dirichlet([0.3, 0.05, 0.02], 3000)
    tokens = draw.integers(1, 3000, 3000)
    rows = spark.createDataFrame([(int(t), [float(x) for x in q]) for t, q in zip(tokens, p, strict=True)], "n_tokens long, posteriors array<double>")
    has = tokens @ p
    goal = np.array([0.93, 0.04, 0.03])
    targets = goal * (1.1 * has[0] / 0.93)
    fit = mixing.fit_rates(rows, targets)
    rate, _ = mixing.rates_of(p, fit.steps, None)
    assert fit.met and fit.rounds < 40 and np.abs((tokens * rate) @ p / targets - 1).max() <= 1e-3 and (rate >= 0).all()
    # bounded rates that cannot reach the targets end at the least squares, and the miss is told
    capped = mixing.fit_rates(rows, has * np.array([1.5, 1.0, 0.5]), most=1.0)
    rate, _ = mixing.rates_of(p, capped.steps, 1.0)
    off = (tokens * rate) @ p - has * np.array([1.5, 1.0, 0.5])
    direct, best = np.ones(3000), np.inf
    for _ in range(4000):  # plain projected gradient
        e = (tokens * direct) @ p - has * np.array([1.5, 1.0, 0.5])
        best = min(best, float(e @ e))
        direct = np.clip(direct - (p @ e) / (tokens @ (p * p).sum(axis=1)), 0, 1)
    assert not capped.met and capped.miss > 0.1 and off @ off <= best * 1.02


def test_rows_that_share_an_id_are_one_document(spark):
    a, b = (" ".join(words_of(40, n)) for n in ("one", "two"))
    rows = spark.createDataFrame([(1, a), (5, a), (5, b), (7, b), (9, "alone in the world of words")], "doc_id long, text string")
    got = sorted((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(rows, Scratch(spark)).collect())
    assert got == [(1, 1, True), (5, 1, False), (5, 1, False), (7, 1, False), (9, 9, True)]


def test_token_totals_equal_the_last_prefix(spark, corpus):
    path = public_tokenizers.path("byte_bpe_50k.json")
    rows = corpus.select("doc_id", "text")
    totals = token_counts.token_totals(rows, path).select("text", "n_tokens")
    tables = token_counts.prefix_token_counts(rows, path).select("text", token_counts.total_tokens(F.col("prefix_tokens")).alias("n_tokens"))
    assert sorted(map(str, totals.collect())) == sorted(map(str, tables.collect()))


def test_sharding(spark, corpus, empty):
    rows = corpus.select("doc_id", sharding.text_size(F.col("text")).alias("size"))
    got = sharding.shuffled(rows, Scratch(spark), 7).collect()
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter(tuple(r) for r in rows.collect())
    assert len(slots) == 7 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert sharding.shuffled(empty.select("doc_id"), Scratch(spark)).count() == 0


def test_hypergeometric_law():
    luck = random.Random(1)
    drawn = Counter(sharding.hypergeometric(5, 7, 4, luck) for _ in range(20000))
    from math import comb

    for k in range(5):
        assert drawn[k] / 20000 == pytest.approx(comb(5, k) * comb(7, 4 - k) / comb(12, 4), abs=0.015)


def test_ranks_and_components(spark):
    rows = spark.range(3000).select(F.col("id"), (F.col("id") % 2).alias("g"), F.xxhash64("id").alias("h"))
    got = ranked(rows, ["g"], ["h", "id"], Scratch(spark), rows=100).collect()
    for g in (0, 1):
        own = sorted((r["h"], r["id"], r["rank"]) for r in got if r["g"] == g)
        assert [r for _, _, r in own] == list(range(1500))
    edges = spark.createDataFrame([(k, k + 1) for k in range(40)] + [(100, 90), (95, 100)], "a long, b long")
    roots = {r["node"]: r["root"] for r in components(edges, Scratch(spark)).collect()}
    assert roots == dict.fromkeys(range(41), 0) | dict.fromkeys((90, 95, 100), 90)
    assert WordHashes(2).of([b"a", b"b", b"c", b"a"])[0] == WordHashes().of([b"a"])[0]


def test_pipeline(spark, corpus, labels, tmp_path):
    corpus.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        after = corpus_pipeline.durable(stage(spark, docs, str(tmp_path)))
        assert name == "packing" or after.dtypes == docs.dtypes
        assert name in ("packing", "lines") or after.select("doc_id", "text").exceptAll(docs.select("doc_id", "text")).count() == 0
        docs = after
    assert docs.count() > 0
