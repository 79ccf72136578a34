"""Near-duplicate lines against edit similarity of all pairs."""

import random
import time
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from lintel.llm import fuzzy_lines
from tests.llm import brute


def test_one_replaced_word_is_found_at_any_length(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9)))
    rows, want = [], 0
    for k in range(150):
        a = [word() for _ in range(rng.choice([5, 8, 10, 20]))]
        b = list(a)
        b[rng.randrange(len(b))] = word()
        a, b = " ".join(a), " ".join(b)
        want += 10 * brute.levenshtein(a, b) <= 2 * max(len(a), len(b))
        rows += [(2 * k, a), (2 * k + 1, b)]
    out = fuzzy_lines.without_near_lines(brute.messy(spark, rows), n_removed="i")
    found = sum(r.i for r in out.collect())
    assert want > 100 and 0.97 * want <= found <= want


def pairs_of(forms):
    """All alike pairs, by lengths, counts of characters and edit distance."""
    size, count = np.array([len(x) for x in forms], np.int64), fuzzy_lines.letters(forms)
    for x in range(len(forms)):
        near = x + 1 + np.flatnonzero(fuzzy_lines.keyed_alike(size[x + 1 :], size[x]))
        near = near[np.abs(count[near] - count[x]).sum(1) <= 2 * (np.maximum(size[near], size[x]) * 2 // 10)]
        yield from ((x, int(y)) for y in near if fuzzy_lines.alike(forms[x], forms[y]))


def test_recall_of_alike_pairs(sf_dir):
    texts = pq.read_table(f"{sf_dir}/documents.parquet").column("text").to_pylist()
    forms = sorted({fuzzy_lines.normal_form(x) for t in texts if t for x in t.split("\n")} - {""})
    lines = fuzzy_lines.Forms(pa.array(forms))
    items, sim, own, key = fuzzy_lines.signatures(lines, np.arange(len(forms)))
    blocks, sketch = defaultdict(set), defaultdict(list)
    for x, k in zip(items[own].tolist(), key.tolist()):
        blocks[x].add(k)
    for x, h in zip(items.tolist(), sim):
        sketch[x].append(h)
    pairs, met = list(pairs_of(forms)), 0
    for a, b in pairs:
        hit = max(len(forms[a]), len(forms[b])) <= fuzzy_lines.EXACT and bool(fuzzy_lines.deletion_keys(forms[a]) & fuzzy_lines.deletion_keys(forms[b]))
        near = any(np.bitwise_count(x ^ y).sum() <= fuzzy_lines.APART for x in sketch[a] for y in sketch[b])
        met += hit or near and bool(blocks[a] & blocks[b])
    assert pairs and met >= 0.97 * len(pairs)


def test_short_pairs_are_all_found():
    rng = random.Random(8)
    for _ in range(1500):
        a = "".join(rng.choice("abc d") for _ in range(rng.randrange(4, 13)))
        b = list(a)
        for _ in range(rng.randrange(0, 3)):
            k = rng.randrange(len(b))
            b[k : k + 1] = rng.choice(["", "x", b[k] + "y"])
        b = "".join(b)
        if 4 <= len(b) <= fuzzy_lines.EXACT and fuzzy_lines.alike(a, b):
            assert fuzzy_lines.deletion_keys(a) & fuzzy_lines.deletion_keys(b)


def test_lines_of_any_number_of_words_take_part(spark):
    han = "这是一个没有空格的很长的句子它在许多文件里重复出现"
    rows = [(1, f"les.\n\n{han}"), (2, f"les.\n\n{han}"), (3, f"one of its own\n \n{han}吗"), (4, "les.")]
    out = fuzzy_lines.without_near_lines(brute.messy(spark, rows), n_removed="i", min_words=1)
    got = {r.doc_id: (r.text, r.i) for r in out.collect()}
    assert got == {1: (f"les.\n\n{han}", 0), 2: ("", 2), 3: ("one of its own\n ", 1), 4: ("", 1)}


def test_a_hot_block_is_compared_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(fuzzy_lines, "BLOCK", 40)
    rng = random.Random(9)
    line = [f"word{k}" for k in range(30)]
    rows = [(k, " ".join(f"z{k}" if w == j else x for w, x in enumerate(line))) for k, j in ((k, rng.randrange(30)) for k in range(150))]
    out = fuzzy_lines.without_near_lines(brute.messy(spark, rows), n_removed="i")
    assert sorted(r.doc_id for r in out.where("i = 0").collect()) == [0]


def families(p, seed=5, many=5, size=60):
    """Distinct lines of 30 random words of a few kinds, of which each word is replaced with chance p."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9)))
    base = [[word() for _ in range(30)] for _ in range(many)]
    return sorted({" ".join(word() if rng.random() < p else w for w in b) for b in base for _ in range(size)})


def groups(pairs, n):
    """How many groups of n lines the pairs leave."""
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        up[top(a)] = top(b)
    return len({top(x) for x in range(n)})


@pytest.mark.parametrize(("p", "block"), [(0.08, 2048), (0.12, 2048), (0.12, 25), (0.16, 25)])
def test_large_blocks_lose_no_link(spark, monkeypatch, p, block):
    """Groups are those of all near pairs of all blocks, in blocks above SMALL and above BLOCK lines."""
    monkeypatch.setattr(fuzzy_lines, "BLOCK", block)
    lines = families(p)
    items, sim, own, key = fuzzy_lines.signatures(fuzzy_lines.Forms(pa.array(lines)), np.arange(len(lines)))
    held, sketch = [set() for _ in lines], dict(zip(items.tolist(), sim))
    for x, k in zip(items[own].tolist(), key.tolist()):
        held[x].add(k)
    alike = list(pairs_of(lines))
    met = [(a, b) for a, b in alike if held[a] & held[b] and np.bitwise_count(sketch[a] ^ sketch[b]).sum() <= fuzzy_lines.APART]
    assert len(met) >= 0.9 * len(alike)
    out = fuzzy_lines.without_near_lines(brute.messy(spark, list(enumerate(lines))), n_removed="i")
    left = out.where("i = 0").count()
    assert left == groups(met, len(lines)) and left <= 1.1 * groups(alike, len(lines)) + 1


def test_counted_characters_rule_out_no_alike_pair():
    rng = random.Random(6)
    text, pairs = {}, []
    for k in range(0, 1200, 2):
        a = "".join(rng.choice("abcd é字") for _ in range(rng.randrange(1, 80)))
        b = list(a)
        for _ in range(rng.randrange(len(a) // 3 + 1)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = rng.choice(["", "x", "字"])
        text |= {k: a, k + 1: "".join(b)}
        pairs.append((k, k + 1))
    u, v = np.array(pairs + [(a, rng.randrange(1200)) for a, _ in pairs]).T
    can = fuzzy_lines.may_be_alike(text, u, v)
    alike = np.array([fuzzy_lines.alike(text[x], text[y]) for x, y in zip(u.tolist(), v.tolist())])
    assert alike.sum() > 200 and not (alike & ~can).any() and can.sum() < len(u)


def test_lengths_that_may_be_alike_have_a_class_in_common():
    """Lines that hold the same tokens share a block at any two lengths that the similarity allows."""
    token = fuzzy_lines.mix64(np.arange(1, 9, dtype=np.uint64))
    for span in (fuzzy_lines.WORD_SPAN, fuzzy_lines.TRIGRAM_SPAN):
        for longer in [*range(5, 60, 5), 92, 184, 185, 230, 368, 369, 735, 800, 1471]:
            sizes = np.array([longer, longer - fuzzy_lines.allowed(longer)])
            own, key = fuzzy_lines.blocks(np.tile(token, 2), np.full(16, 9), np.repeat([0, 1], 8), sizes, span, 512, 1, 1)
            assert set(key[own == 0].tolist()) & set(key[own == 1].tolist()), (span, longer)


def test_long_runs_without_spaces_are_cut_alike():
    rng = random.Random(10)
    text = "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(400))
    pieces = fuzzy_lines.cut(text)
    assert "".join(pieces) == text and max(map(len, pieces)) <= fuzzy_lines.TOKEN
    other = fuzzy_lines.cut("天地玄黄" + text[:200] + "宇" + text[200:])
    assert len(set(pieces) & set(other)) >= 0.8 * len(set(pieces))


def test_the_forest_of_a_chunk_is_the_smallest():
    rng = np.random.default_rng(0)
    for n in (2, 20, 90, 300):
        base = rng.integers(0, 1 << 63, (3, 2)).astype(np.uint64)
        h = base[rng.integers(0, 3, n)] ^ np.uint64(1) << rng.integers(0, 64, (n, 2)).astype(np.uint64)
        pairs = sorted((int(np.bitwise_count(h[i] ^ h[j]).sum()), i, j) for i in range(n) for j in range(i + 1, n))
        up = list(range(n))

        def top(x, up=up):
            while up[x] != x:
                x = up[x]
            return x

        want = []
        for d, i, j in pairs:
            if d <= fuzzy_lines.APART and top(i) != top(j):
                up[top(i)] = top(j)
                want.append((i, j))
        assert sorted(zip(*fuzzy_lines.chunk_links(h, np.full(n, 100)))) == sorted(want)


def test_edit_distances_side_by_side(monkeypatch):
    """Pairs of all lengths together are judged as one by one, also when long ones are first tried by their words."""
    rng = random.Random(3)
    text, pairs = {}, []
    for k in range(0, 3000, 2):
        kinds = "abcd é字😀"[: rng.choice([4, 7, 8])]
        a = "".join(rng.choice(kinds) for _ in range(rng.randrange(1, rng.choice([2, 4, 10, 60, 150, 400]))))
        b = list(a)
        for _ in range(rng.randrange(len(a) // 3 + 2)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randrange(2)] = rng.choice(["", "x", "字"])
        text |= {k: a, k + 1: "".join(b)}
        pairs.append((k, k + 1))
    u, v = np.array(pairs + [(a, rng.randrange(3000)) for a, _ in pairs]).T
    want = [fuzzy_lines.alike(text[a], text[b]) for a, b in zip(u.tolist(), v.tolist())]
    assert 500 < sum(want) < len(want) and fuzzy_lines.alike_of(text, u, v).tolist() == want
    monkeypatch.setattr(fuzzy_lines, "LONG", 50)
    assert fuzzy_lines.alike_of(text, u, v).tolist() == want
    a, b = zip(*[(text[x], text[y]) for x, y in pairs if text[y]])
    for top in (0, 1, 3, 10, 50):
        most = np.array([rng.randrange(top + 1) for _ in a])
        assert fuzzy_lines.within(a, b, most).tolist() == [fuzzy_lines.edit_distance(x, y) <= m for x, y, m in zip(a, b, most.tolist())]


def test_unlike_lines_of_the_same_words_are_told_apart_quickly():
    """Lines that share much, as those of large blocks do, cost a fraction of one distance after another."""
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randrange(3, 9))) for _ in range(120)]
    text = {k: " ".join(rng.sample(words, 95)) for k in range(60)}
    u, v = np.triu_indices(60, 1)

    def took(run):
        start = time.process_time()
        return run(), time.process_time() - start

    got, fast = took(lambda: fuzzy_lines.alike_of(text, u, v).tolist())
    some = range(0, len(u), 10)
    want, slow = took(lambda: [fuzzy_lines.alike(text[int(u[k])], text[int(v[k])]) for k in some])
    assert [got[k] for k in some] == want and fast < 10 * slow / 2
