"""Exact substrings, near-duplicate documents and near-duplicate lines."""

import random
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lintel.llm import chosen_path, components, fuzzy_lines, suffix_levels
from tests.llm import brute


@pytest.mark.parametrize("seed", [1, 2])
def test_removed_spans(spark, seed):
    rows = [*brute.prose(seed, 90), (200, "x" * 100), (201, "x" * 60), (-5, "x" * 70), (7, None), (300, "ab" * 150), (301, "ab" * 90)]
    got = [(r.doc_id, r.n_bytes, list(r.spans), bytes(r.kept)) for r in suffix_levels.removed_spans(brute.messy(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted(brute.removed(rows), key=repr)


def test_a_clash_of_hashes_removes_nothing(monkeypatch):
    rng = np.random.default_rng(2)
    rows = rng.integers(0, 3, (400, 5)).astype(np.uint8)
    want = np.unique(rows, axis=0, return_inverse=True)[1].reshape(-1)
    for hashes in (suffix_levels.row_hashes, lambda r: np.zeros(len(r), np.uint64), lambda r: (r[:, 0] % 2).astype(np.uint64)):
        monkeypatch.setattr(suffix_levels, "row_hashes", hashes)
        code = suffix_levels.row_codes(rows)
        assert ((code[:, None] == code[None]) == (want[:, None] == want[None])).all()
        ids = rng.integers(0, 50, 400)
        assert (suffix_levels.least_of(code, ids) == [ids[want == w].min() for w in want]).all()


def test_one_passage_in_all_documents(spark):
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(300))
    rows = [(k, f"{k} own words {rng.random()} " + passage[rng.randrange(20) :] + f" end {k}") for k in range(60)] + [(70, passage * 3), (71, passage + passage[:40])]
    got = [(r.doc_id, r.n_bytes, list(r.spans), bytes(r.kept)) for r in suffix_levels.removed_spans(brute.messy(spark, rows)).collect()]
    assert sorted(got, key=repr) == sorted(brute.removed(rows), key=repr)


def test_batches_in_later_runs_give_the_same(spark, tmp_path):
    rows = [r for r in brute.prose(11, 90) if r[0] is not None]
    rows += [(200, "x" * 100), (201, "x" * 60), (300, rows[3][1] + " more"), (301, "ab" * 150), (302, "ab" * 90)]
    want = sorted(brute.removed(rows), key=repr)
    got = []
    for k, (low, high) in enumerate(((-1, 30), (30, 60), (60, 95), (95, 250), (250, 999))):
        part = [r for r in rows if low <= r[0] < high]
        family = suffix_levels.Family(spark, str(tmp_path / "family"))
        got += [(r.doc_id, r.n_bytes, list(r.spans), bytes(r.kept)) for r in family.add(brute.messy(spark, part)).collect()]
        assert sorted(size for size, _ in family.levels()) == [1 << j for j in range(4) if k + 1 >> j & 1]
    assert sorted(got, key=repr) == want
    with pytest.raises(ValueError):
        family.add(brute.messy(spark, [(5, "late")]))


def test_removed_spans_of_nothing(spark):
    df = brute.messy(spark, [(1, "a")])
    assert suffix_levels.removed_spans(df.where("false")).count() == 0
    assert suffix_levels.removed_spans(df).first().kept == bytearray(b"a")


def test_levels_merge_geometrically():
    rng = np.random.default_rng(0)
    levels, seen, ids = suffix_levels.Levels(), {}, 0
    for batch in range(13):
        wide = rng.integers(0, 300, 50).astype(np.uint64)
        doc = np.arange(ids, ids + 50)
        ids += 50
        got = levels.add(wide, wide, doc)
        assert got.tolist() == [seen.setdefault(w, d) < d for w, d in zip(wide.tolist(), doc.tolist())]
        assert sorted(size for size, *_ in levels.levels) == [1 << k for k in range(5) if batch + 1 >> k & 1]


def test_near_groups(spark):
    rows = brute.prose(3, 150, 0.5)
    rng = random.Random(1)
    base = [f"w{k}" for k in range(80)]
    for k in range(60):
        w = list(base)
        for _ in range(rng.randrange(0, 3)):
            w[rng.randrange(80)] = f"z{k}"
        rows.append((1000 + k, " ".join(w)))
    rows += [(2000, "a b"), (2001, "A  b"), (2002, "Ä")]
    got = [(r.doc_id, r.class_id, r.n_links) for r in chosen_path.near_groups(brute.messy(spark, rows)).collect()]
    assert sorted(got) == sorted(brute.near_groups(rows))


def test_blocks_of_a_large_group(spark):
    rng = random.Random(2)
    rows = []
    for k in range(120):
        w = [f"w{j}" for j in range(90)]
        w[rng.randrange(90)] = f"z{k}"
        rows.append((k, " ".join(w)))
    got = [(r.doc_id, r.class_id, r.n_links) for r in chosen_path.near_groups(brute.messy(spark, rows), block=16).collect()]
    assert sorted(got) == sorted(brute.near_groups(rows))


def test_large_buckets_are_split_until_they_are_small(spark, monkeypatch):
    # a common head and tail with an own middle: unlike texts that share many tokens, and near copies among them
    rng = random.Random(5)
    rows = []
    for k in range(150):
        own = [f"o{k}x{j}" for j in range(12)]
        rows.append((k, " ".join([f"h{j}" for j in range(12)] + own)))
        if k % 5 == 0:
            rows.append((1000 + k, " ".join([f"h{j}" for j in range(12)] + own + ["more"])))
    want = sorted(brute.near_groups(rows))
    for effort, last in ((1, 8), (1, 4), (0, 3)):
        monkeypatch.setattr(chosen_path, "EFFORT", effort)
        monkeypatch.setattr(chosen_path, "LAST", last)
        got = [(r.doc_id, r.class_id, r.n_links) for r in chosen_path.near_groups(brute.messy(spark, rows), block=20).collect()]
        assert sorted(got) == want


def test_a_bucket_hands_back_what_it_did_not_compare():
    rng = np.random.default_rng(3)
    sketch = rng.integers(0, 1 << 63, (60, 4)).astype(np.uint64)
    links, rest = chosen_path.bucket_links(sketch, 2)
    assert not links and 0 < len(rest) < 60 and chosen_path.bucket_links(np.repeat(sketch[:1], 60, 0), 2)[1].size == 0
    assert len(chosen_path.bucket_links(np.repeat(sketch[:1], 60, 0))[0]) == 59


def test_one_of_each(spark):
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (3, "other words"), (None, "a b c d e f"), (4, None), (5, None)]
    df = brute.messy(spark, rows)
    out = chosen_path.one_of_each(df)
    assert sorted(map(repr, (r.doc_id for r in out.collect()))) == ["1", "3", "4", "5", "None"] and out.columns == df.columns
    assert chosen_path.near_groups(df.where("false")).count() == 0


def test_runs_reach_the_recall():
    assert chosen_path.runs_for(0.99) <= chosen_path.RUNS
    rng, hits = np.random.default_rng(0), 0
    for k in range(300):  # pairs exactly at the threshold
        common = rng.integers(0, 1 << 63, 80).astype(np.uint64)
        own = [np.sort(np.concatenate([common, rng.integers(0, 1 << 63, 10).astype(np.uint64)])) for _ in range(2)]
        token, row = np.concatenate(own), np.repeat([0, 1], 90)
        owner, leaf = chosen_path.paths_of(token, row, 2)
        hits += bool(set(leaf[owner == 0]) & set(leaf[owner == 1]))
    assert hits >= 0.97 * 300


def test_components(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(k, k + 1) for k in range(1000, 1060)] + [(5, 5), (None, 3), (7, None)]
    up = {}
    top = lambda x: x if up.setdefault(x, x) == x else top(up[x])
    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = sorted((top(a), top(b)))
            up[y] = x
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {x: top(x) for x in up if top(x) != x}


def test_edit_distance():
    rng = random.Random(6)
    for _ in range(400):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(0, 90))) for _ in range(2))
        if rng.random() < 0.5:
            b = a[:10] + b[:3] + a[10:]
        far = brute.levenshtein(a, b)
        assert fuzzy_lines.edit_distance(a, b) == far
        assert all((fuzzy_lines.edit_distance(a, b, most) <= most) == (far <= most) for most in (0, 3, 8))


def test_most_edits_are_never_too_few():
    rng = random.Random(8)
    for _ in range(600):
        a = [rng.choice(["ab", "c", "abc", "dd", ""]) for _ in range(rng.randrange(1, 14))]
        b = [w for w in a if rng.random() < 0.85]
        for _ in range(rng.randrange(0, 3)):
            b.insert(rng.randrange(len(b) + 1), rng.choice(["x", "ab"]))
        a, b = " ".join(a), " ".join(b)
        assert fuzzy_lines.most_edits(a, b) >= brute.levenshtein(a, b)


def test_simhash_counts_by_bits():
    rng = np.random.default_rng(3)
    word, line = rng.integers(0, 1 << 63, 1500).astype(np.uint64), np.sort(rng.integers(0, 4, 1500))
    for k, h in enumerate(fuzzy_lines.simhash(word, line, 5)):
        own = word[line == k]
        want = sum(1 << b for b in range(64) if 2 * int((own >> np.uint64(b) & np.uint64(1)).sum()) > len(own)) if len(own) else 0
        assert int(h) == want


def by_hand(rows):
    """Texts after line dedup, by all pairs of lines."""
    occurrences, done = defaultdict(list), set()
    for i, t in rows:
        if t is not None and (i, t) not in done:
            done.add((i, t))
            for n, line in enumerate(t.split("\n")):
                form = fuzzy_lines.normal_form(line)
                if len(form.split(" ")) >= fuzzy_lines.MIN_WORDS:
                    occurrences[form].append((i is None, i or 0, n, t))
    forms = sorted(occurrences)
    sim = fuzzy_lines.described(pa.array(forms))[2]
    up = list(range(len(forms)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for x in range(len(forms)):
        for y in np.flatnonzero(fuzzy_lines.keyed_alike(sim, sim[x])):
            longer = max(len(forms[x]), len(forms[y]))
            if y > x and 10 * brute.levenshtein(forms[x], forms[y]) <= 2 * longer:
                up[top(y)] = top(x)
    groups, drop = defaultdict(list), defaultdict(set)
    for x, form in enumerate(forms):
        groups[top(x)] += occurrences[form]
    for held in groups.values():
        for o in held:
            if o != min(held):
                drop[None if o[0] else o[1], o[3]].add(o[2])
    return [(i, None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in drop[i, t]), len(drop[i, t])) for i, t in rows]


def test_fuzzy_lines(spark):
    rows = brute.prose(5, 80, 0.4)
    rng = random.Random(3)
    line = [f"word{k}" for k in range(40)]
    for k in range(40):
        w = list(line)
        w[rng.randrange(40)] = f"z{k}"
        rows.append((500 + k, "a short one\n" + " ".join(w) + "\nlast"))
    rows += [(600, "a b c d e\nA  b c d e\n\nx"), (None, "a b c d e\nquite new line of words"), rows[2]]
    df = brute.messy(spark, rows)
    out = fuzzy_lines.without_near_lines(df, n_removed="i")
    assert sorted(map(repr, ((r.doc_id, r.text, r.i) for r in out.collect()))) == sorted(map(repr, by_hand(rows)))
    assert sorted(out.columns) == sorted(df.columns) and fuzzy_lines.without_near_lines(df.where("false")).count() == 0
