"""The pipeline's stages against plain versions, each on what the one before it kept."""

import hashlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lintel.llm import fuzzy_lines, mixing, queries
from tests.llm import brute
from tests.llm.test_near_lines import pairs_of

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def outputs(spark, sf_dir, tmp_path_factory):
    """Rows after each stage, the input first."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = {"documents": docs.collect()}
    base = tmp_path_factory.mktemp("stages")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(str(base / name))
        docs = spark.read.parquet(str(base / name))
        out[name] = docs.collect()
    return out


def ids(rows):
    return sorted(r.doc_id for r in rows)


def test_columns_stay(outputs):
    want = outputs["documents"][0].__fields__
    assert all(outputs[name][0].__fields__ == want for name, _ in corpus_pipeline.STAGES[:-1])


def test_quality_rules(outputs, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = sorted(r[0] for r in con.execute(f"SELECT doc_id FROM ({queries.OP1_SQL}) WHERE kept").fetchall())
    assert ids(outputs["quality_rules"]) == want and len(want) < len(outputs["documents"])


def test_line_dedup(outputs):
    rows = [(r.doc_id, r.text) for r in outputs["quality_rules"]]
    where = defaultdict(list)
    for i, t in rows:
        for n, line in enumerate(t.split("\n")):
            form = fuzzy_lines.normal_form(line)
            if form:
                where[form].append((i, n))
    forms = sorted(where)
    up = list(range(len(forms)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs_of(forms):
        up[top(a)] = top(b)
    groups, drop = defaultdict(list), set()
    for k, form in enumerate(forms):
        groups[top(k)] += where[form]
    for held in groups.values():
        drop |= {o for o in held if o != min(held)}
    want = {}
    for i, t in rows:
        left = "\n".join(line for n, line in enumerate(t.split("\n")) if (i, n) not in drop)
        if left.split() or not any((i, n) in drop for n in range(t.count("\n") + 1)):
            want[i] = left
    got = {r.doc_id: r.text for r in outputs["line_dedup"]}
    assert drop and all(r.n_chars == len(r.text) for r in outputs["line_dedup"])
    assert sum(got.get(i) == t for i, t in want.items()) >= 0.98 * len(want) and abs(len(got) - len(want)) <= 0.02 * len(want)


def test_near_duplicates(spark, sf_dir, outputs):
    for name in ("line_dedup", "documents"):  # what line dedup leaves has hardly any, the documents themselves have
        rows = [(r.doc_id, r.text) for r in outputs[name]]
        want = sorted(i for i, low, _ in brute.near_groups(rows) if i == low)
        if name == "line_dedup":
            got = ids(outputs["near_duplicates"])
        else:
            got = ids(STAGES["near_duplicates"](spark, spark.read.parquet(f"{sf_dir}/documents.parquet"), sf_dir).collect())
            assert len(want) < len(rows)
        assert got == want


def test_mixture(outputs):
    domain = {f"src{k}": d for d, numbers in queries.DOMAINS.items() for k in numbers}
    leaf = {r.doc_id: (domain.get(r.source, "other"), r.lang if r.lang in queries.LANGUAGE_WEIGHTS and r.lang != "other" else "other", r.source if r.source in domain else "other") for r in outputs["near_duplicates"]}
    words = {r.doc_id: len(brute.WORD.findall(r.text)) for r in outputs["near_duplicates"]}
    have = Counter()
    for i, n in words.items():
        have[leaf[i]] += n
    budget = mixing.budgets(queries.mixture(), dict(have), corpus_pipeline.MIX_SHARE * sum(have.values()))
    at, want = Counter(), []
    for i in sorted(words, key=lambda i: hashlib.md5(f"{queries.MIX_SEED}:0:{i}".encode()).hexdigest()):
        if at[leaf[i]] < min(budget.get(leaf[i], 0), have[leaf[i]]):
            want.append(i)
        at[leaf[i]] += words[i]
    assert ids(outputs["mixture"]) == sorted(want) and len(want) < len(words)


def test_packing(outputs):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = defaultdict(list)
    for r in outputs["packing"]:
        pieces[r.doc_id].append((r.start, np.frombuffer(r.ids, "<u4").tolist()))
    assert sorted(pieces) == ids(outputs["mixture"])
    for r in outputs["mixture"]:
        assert sum((p for _, p in sorted(pieces[r.doc_id])), []) == tokenizer.encode(r.text, add_special_tokens=False).ids + [2]


def test_odd_rows(spark):
    """Nulls in any column, repeated rows and an empty table pass through all stages."""
    text = "one two three four five six seven eight nine ten " * 2 + " ".join(f"w{k}" for k in range(80))
    rows = [(1, text, None, None, None), (1, text, "en", "src1", 5), (None, text + " x", "en", "src1", 5), (2, None, "en", "src1", 5), (3, "", None, "src3", None), (4, " ".join(f"v{k}" for k in range(90)), "xx", None, 1)]
    for some in (rows, []):
        docs = spark.createDataFrame(some, "doc_id long, text string, lang string, source string, n_chars long")
        for name, stage in corpus_pipeline.STAGES:
            before = docs.columns
            docs = stage(spark, docs, "").cache()
            assert name == "packing" or docs.columns == before
            docs.count()
        assert docs.where(F.col("length") < 1).count() == 0
