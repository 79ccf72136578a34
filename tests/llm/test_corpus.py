"""Packing, mixing, language-model scores and the pipeline."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lintel.llm import mixing, packing, ppm
from tests.llm import brute

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_ids_are_the_tokenizers(spark, sf_dir):
    texts = [r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").collect()]
    texts += ["it's DON'T 'sx !'s", "a <|endoftext|> b<|", "é é É Ŝ Ⅷ １２ ß ÿ × ÷", "\x00\x1f x\x1cy", "x y​z", "", " ", "12345 a1b2", "...!!! ???", "ＡＢ 漢字 😀"]
    want = [e.ids + [2] for e in Tokenizer.from_file(PATH).encode_batch(texts, add_special_tokens=False)]
    ids, begin = packing.WordTokenizer.of(PATH).encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(begin[:-1], begin[1:])] == want


def test_packing(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()] + [(None, "a b"), (9001, None), (9002, ""), (9003, "x " * 9000)]
    got = packing.packed(brute.messy(spark, rows), PATH).collect()
    sequences, documents = defaultdict(list), defaultdict(list)
    for r in got:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        sequences[r.sequence_id].append(r)
        documents[r.doc_id].append(r)
    for parts in sequences.values():
        parts.sort(key=lambda r: r.offset)
        assert [r.offset for r in parts] == np.cumsum([0, *(r.length for r in parts[:-1])]).tolist()
        size = sum(r.length for r in parts)
        assert size == packing.LENGTH or size < packing.LENGTH and size & (size - 1) == 0
    tokenizer = Tokenizer.from_file(PATH)
    for i, t in rows:
        parts = sorted(documents[i], key=lambda r: r.start)
        ids = np.concatenate([np.frombuffer(r.ids, "<u4") for r in parts]).tolist()
        assert ids == tokenizer.encode(t or "", add_special_tokens=False).ids + [2] and {r.doc_tokens for r in parts} == {len(ids)}
    assert packing.packed(brute.messy(spark, rows[:1]).where("false"), PATH).count() == 0


def test_retrieval_follows_bm25():
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 50, rng.integers(5, 60)).astype(np.uint16) for _ in range(40)]
    frequency = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=50)
    mean = np.mean([len(d) for d in docs])
    index = packing.Index(docs, frequency, 40, mean)
    counts = [Counter(d.tolist()) for d in docs]
    weight = lambda t, k: math.log1p((40 - frequency[t] + 0.5) / (frequency[t] + 0.5)) * counts[k][t] * 2.2 / (counts[k][t] + 1.2 * (0.25 + 0.75 * len(docs[k]) / mean))
    for seed in (0, 7):
        terms = sorted(counts[seed], key=lambda t: -weight(t, seed))[: packing.QUERY_TERMS]
        want = [sum(weight(t, k) for t in terms) for k in range(40)]
        assert np.allclose(index.scores(seed), want, rtol=1e-4)
    sizes = np.array([len(d) for d in docs])
    order = packing.order_by_retrieval(sizes, index, 64)
    assert sorted(order) == list(range(40)) and order[0] == 0


def hashed(seed, epoch, i):
    return hashlib.md5(f"{seed}:{epoch}:{'' if i is None else i}".encode()).hexdigest()


@pytest.mark.parametrize("ranges", [4096, 10, 1])
def test_mixing(spark, monkeypatch, ranges):
    monkeypatch.setattr(mixing, "RANGE_ROWS", ranges)
    rng = random.Random(1)
    tree = {"web": (0.6, {"en": (0.7, {"s0": (1.0, None), "s1": (2.0, None)}), "de": (0.3, {"s0": (1.0, None)})}), "book": (0.4, {"en": (1.0, {"s2": (1.0, None), "s3": (0.0, None)})})}
    where = [("web", "en", "s0")] * 6 + [("web", "en", "s1"), ("web", "de", "s0"), ("book", "en", "s2"), ("book", "en", "s3"), ("web", "en", "s9"), (None, "en", "s0")]
    rows = [(i if i % 37 else None, "w " * rng.randrange(0, 30), *rng.choice(where)) for i in range(600)]
    rows += [rows[5], rows[5]]
    df = spark.createDataFrame(rows, "doc_id long, text string, d string, l string, s string").repartition(4)
    for share, epochs in ((0.5, 1), (1.3, 2), (5.0, 2)):
        got = mixing.mixed(df, tree, [F.col(c) for c in "dls"], mixing.token_count(F.col("text")), share=share, epochs=epochs, seed=3)
        have = Counter()
        for _, t, *leaf in rows:
            have[tuple(leaf)] += len(t.split())
        leaves = [("web", "en", "s0"), ("web", "en", "s1"), ("web", "de", "s0"), ("book", "en", "s2"), ("book", "en", "s3")]
        wanted = mixing.budgets(tree, {k: have[k] * epochs for k in leaves}, share * sum(have[k] for k in leaves))
        want = []
        for leaf in leaves:
            at = 0
            for e in range(epochs):
                mine = sorted((hashed(3, e, i), i is not None, i or 0, len(t.split())) for i, t, *own in rows if tuple(own) == leaf)
                for _, known, i, n in mine:
                    if at < min(wanted[leaf], (e + 1) * have[leaf]):
                        want.append((i if known else None, "/".join(leaf), n, e, at))
                    at += n
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))
    assert mixing.mixed(df.where("false"), tree, [F.col(c) for c in "dls"], F.lit(1).cast("long")).count() == 0


def test_budgets_go_to_siblings_first():
    tree = {"a": (0.5, {"x": (0.5, None), "y": (0.5, None)}), "b": (0.5, {"z": (1.0, None)})}
    got = mixing.budgets(tree, {("a", "x"): 10, ("a", "y"): 100, ("b", "z"): 100}, 100)
    assert got == {("a", "x"): 10, ("a", "y"): 40, ("b", "z"): 50}
    got = mixing.budgets(tree, {("a", "x"): 10, ("a", "y"): 20, ("b", "z"): 100}, 100)
    assert got == {("a", "x"): 10, ("a", "y"): 20, ("b", "z"): 70}
    assert sum(mixing.budgets(tree, {("a", "x"): 1}, 100).values()) == 1


def test_ppm(spark):
    rows = [(i, t if t is None else t[:200]) for i, t in brute.prose(8, 60)] + [(500, "ÄÖ zzz QQQ"), (501, "x\0y")]
    learn = [i is not None and i % 3 != 1 for i, _ in rows]
    df = brute.messy(spark, rows).withColumn("learn", F.col("doc_id") % 3 != 1)
    got = ppm.scores(df, "learn").collect()
    tokens = lambda t: re.findall(rb"[^\x20\x09-\x0D]+", brute.lowered(t)) + [b"\n"]
    counts = Counter(x for (_, t), use in zip(rows, learn) if use for x in tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = []
    for (i, t), use, score in zip(rows, learn, brute.ppm([t for _, t in rows], learn)):
        own = tokens(t)
        want.append((i, use, len(own), sum(counts[x] > 0 for x in own), n, round(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in own), 6), round(score, 6)))
    mine = [(r.doc_id, r.learn, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in got]
    for a, b in zip(sorted(mine, key=repr), sorted(want, key=repr)):
        assert a[:5] == b[:5] and abs(a[5] - b[5]) < 1e-5 and abs(a[6] - b[6]) < 1e-5
    assert ppm.scores(df.where("false"), "learn").count() == 0


def test_ppm_sums_to_one():
    rng = np.random.default_rng(0)
    gram = np.unique(rng.integers(97, 101, (300, 6)).astype(np.uint64) @ (np.uint64(256) ** np.arange(6, dtype=np.uint64)))
    count = rng.integers(1, 5, len(gram))
    low = np.bincount((gram & np.uint64(0xFFFF)).astype(np.int64), count, 65536).astype(np.int64).reshape(256, 256)
    trie = ppm.Trie(*ppm.summed(gram, count), low)
    for context in (gram[0] >> np.uint64(8), gram[9] >> np.uint64(8), np.uint64(0x6161616199), np.uint64(1)):
        every = (context << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        assert abs((10 ** trie.log10(every)).sum() - 1) < 1e-9


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    kept = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == columns, name
        kept.append(docs.count())
    assert kept == sorted(kept, reverse=True) and kept[1] < kept[0] and kept[4] < kept[3]
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    assert {r.doc_id for r in last.select("doc_id").distinct().collect()} == ids
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.select(F.sum("length")).first()[0] == last.select(F.sum("length")).first()[0]


def test_documents_are_dealt_by_their_heaviest_common_terms():
    rng = np.random.default_rng(1)
    docs = [np.append(rng.integers(3, 40, rng.integers(0, 50)), 2).astype(np.uint16) for _ in range(60)]
    frequency = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=64)
    mean = np.mean([len(d) for d in docs])
    begin = np.concatenate([[0], np.cumsum([len(d) for d in docs])])
    first, second = packing.leading_terms(np.concatenate(docs), begin, frequency, 60, mean, 0.3)
    for d, a, b in zip(docs, first, second):
        count = Counter(x for x in d.tolist() if x != 2 and frequency[x] >= 18)
        weight = {t: np.float32(math.log1p((60 - frequency[t] + 0.5) / (frequency[t] + 0.5)) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(d) / mean))) for t, n in count.items()}
        want = sorted(weight, key=lambda t: (-weight[t], t))[:2] + [2, 2]
        assert [a, b] == want[:2]


def test_large_groups_are_spread_and_others_stay_together():
    places = packing.Places(np.array([0, 100, 300]), {(2, 7)})
    own = np.arange(2000)
    spread = places.of(np.full(2000, 2), np.full(2000, 7), own)
    assert 0.25 <= spread.min() < 0.3 and spread.max() > 0.95 and len(set(places.of(np.full(9, 2), np.full(9, 8), own[:9]))) == 1
    assert (places.of(np.full(9, 1), np.arange(9), own[:9]) < 0.25).all()


def test_a_window_goes_on_down_the_seeds_ranking():
    score = np.array([0.5, 3, 0, 2, 2, -1, 1] + [0.1] * 200)
    want = [k for _, k in sorted((-x, k) for k, x in enumerate(score) if x > 0)]
    assert list(packing.ranked(score)) == want
    # one seed and many short neighbours: all come before the unlike document, however many there are
    docs = [np.array([5, 6, 2], np.uint16)] * 120 + [np.array([9, 2], np.uint16)] + [np.array([5, 2], np.uint16)] * 40
    frequency = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=16)
    index = packing.Index(docs, frequency, len(docs), 3.0)
    order = packing.order_by_retrieval(np.array([len(d) for d in docs]), index, 512)
    assert order[-1] == 120 and sorted(order) == list(range(161))


def test_order_by_hand():
    rng = np.random.default_rng(5)
    docs = [rng.integers(3, 30, rng.integers(1, 40)).astype(np.uint16) for _ in range(50)]
    sizes = np.array([len(d) for d in docs])
    frequency = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=30)
    index = packing.Index(docs, frequency, 50, sizes.mean())
    unused, want, place = set(range(50)), [], 0

    def take(d):
        nonlocal place
        unused.discard(d)
        want.append(d)
        full = place % 128 + sizes[d] >= 128
        place += int(sizes[d])
        return full

    while unused:
        if place % 128 == 0 and take(min(unused)):
            continue
        score = index.scores(want[-1], None)
        rank = sorted((d for d in unused if score[d] > 0), key=lambda d: (-score[d], d)) + sorted(d for d in unused if score[d] <= 0)
        for d in rank:
            if take(d):
                break
    assert packing.order_by_retrieval(sizes, index, 128, None) == want


def test_tokenising_gives_memory_back_after_each_piece(monkeypatch):
    path, calls = public_tokenizers.path("word_bpe_49k.json"), []
    monkeypatch.setattr(packing, "TOKENISED", 1000)
    monkeypatch.setattr(packing.common, "give_back", lambda: calls.append(1))
    texts = ["some words of a text " * 40] * 5
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(range(5)), pa.array(texts)], ["i", "own", "t"])
    out = []
    for k, rows in enumerate(packing.tokenised(iter([batch]), path, 49408)):
        out.append(rows)
        assert len(calls) == min(k + 2, 6)  # before the first piece, and after each
    assert [r.column("n").to_pylist() for r in out] == [[201]] * 5 + [[-1]]
