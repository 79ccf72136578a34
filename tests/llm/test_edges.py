"""Very long texts, clashing columns, ids that are no integers, empty tables."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lintel.llm import chosen_path, discriminant, fuzzy_lines, mixing, packing, ppm, suffix_levels, webp_encode
from tests.llm import brute

LONG = " ".join(f"w{k * 7919 % 300_007}" for k in range(300_000))


@pytest.fixture(scope="module")
def docs(spark):
    return brute.messy(spark, [(1, LONG), (2, LONG), (3, "a b c"), (None, None)])


def test_long_texts_in_joins(docs):
    assert sorted((r.doc_id, r.class_id, r.n_links) for r in chosen_path.near_groups(docs).collect()) == [(1, 1, 1), (2, 1, 1), (3, 3, 0)]
    got = {r.doc_id: (len(r.text or ""), r.i) for r in fuzzy_lines.without_near_lines(docs, n_removed="i").collect()}
    assert got == {1: (len(LONG), 0), 2: (0, 1), 3: (5, 0), None: (0, 0)}
    got = {r.doc_id: (r.n_bytes, list(r.spans)) for r in suffix_levels.removed_spans(docs).collect()}
    assert got == {1: (len(LONG), []), 2: (len(LONG), [0, len(LONG)]), 3: (5, []), None: (0, [])}


def test_long_texts_alone(docs):
    got = {r.doc_id: r for r in ppm.scores(docs.withColumn("learn", F.col("doc_id") == 1), "learn").collect()}
    assert got[1].score == got[2].score < got[3].score < 0 and got[1].n_tokens == 300_001
    packed = packing.packed(docs, public_tokenizers.path("word_bpe_49k.json"), shard_tokens=1 << 20).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("all")).collect()
    assert len(packed) == 4 and all(r.n == r["all"] for r in packed)
    assert {r.payload_bytes for r in webp_encode.store_texts(docs, columns=["doc_id"]).select("webp.payload_bytes").collect()} == {64, -(-len(LONG) // 64) * 64}


def test_ids_that_are_no_integers(spark):
    df = spark.createDataFrame([("7", "x y " * 40), ("b", "x y " * 40)], "doc_id string, text string")
    assert [(r.doc_id, r.class_id) for r in chosen_path.near_groups(df).collect()] == [(7, 7)]
    assert sorted((r.doc_id or 0, len(r.spans)) for r in suffix_levels.removed_spans(df).collect()) == [(0, 0), (7, 0)]
    assert sorted(r.doc_id or 0 for r in discriminant.scored(df, spark.createDataFrame([], "doc_id string, quality int"), F.lit(True)).collect()) == [0, 7]
    assert fuzzy_lines.without_near_lines(df, n_removed="n").select(F.sum("n")).first()[0] == 1


def test_mixing_with_clashing_columns(spark):
    df = spark.createDataFrame([(1, "a b c", "x", 1, 2, 3, "h", 5)], "doc_id long, text string, leaf string, epoch int, bucket int, position int, h string, n int")
    got = mixing.mixed(df, {"x": (1.0, None)}, [F.col("leaf")], mixing.token_count(F.col("text"))).collect()
    assert [tuple(r) for r in got] == [(1, "x", 3, 0, 0)]
