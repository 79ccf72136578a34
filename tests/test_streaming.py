"""Incremental scans, the limit of requests, counters kept by increments."""

import random

import pandas as pd
from pyspark.sql import functions as F

from lintel.operators import delta
from lintel.streaming import counters, incremental


def test_watch(spark, tmp_path):
    src, sink = str(tmp_path / "in"), str(tmp_path / "out")
    for k, body in enumerate(["eval(x)", "hashlib.sha1(x)"]):
        spark.createDataFrame([(f"a{k}.js", body)], "path string, content string").write.mode("append").parquet(src)
        incremental.watch(spark, src, sink, str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(sink)
    assert sorted(r.rule_id for r in got.collect()) == ["RULE-CRYPTO-002", "xss"] and got.select("batch").distinct().count() == 2


def test_watch_tells_what_it_leaves_out(spark, tmp_path):
    src, sink, gone = (str(tmp_path / x) for x in ("in", "out", "gone"))
    rows = [("a.js", "eval(x)"), ("big.js", "eval(x) " * 150_000), ("b.js", "eval(x)\0"), ("vendor/c.js", "eval(x)"), ("d.unknown", "eval(x)")]
    spark.createDataFrame(rows, "path string, content string").write.parquet(src)
    incremental.watch(spark, src, sink, str(tmp_path / "cp"), gone).awaitTermination()
    assert {r.file_path for r in spark.read.parquet(sink).collect()} == {"a.js"}
    assert {(r.path, r.reason) for r in spark.read.parquet(gone).collect()} == {("big.js", "too large"), ("b.js", "binary file"), ("vendor/c.js", "excluded or over the cap")}


def _events(spark):
    base = pd.Timestamp("2024-01-01")
    rows = [(k, 1, (base + pd.Timedelta(seconds=s)).to_pydatetime()) for k, s in enumerate([0, 10, 20, 59, 60, 61])] + [(9, 2, base.to_pydatetime())]
    return spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp")


def test_limit(spark):
    got = {r.event_id: r.allowed for r in incremental.rate_limited(_events(spark), 2, 60).collect()}
    assert got == {0: True, 1: True, 2: False, 3: False, 4: True, 5: True, 9: True}


def test_limit_stream(spark, tmp_path):
    _events(spark).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema("event_id long, user_id long, ts timestamp").parquet(str(tmp_path / "e"))
    out = incremental.rate_limited_stream(stream, 2, 60)
    out.writeStream.format("memory").queryName("limited").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got = {r.event_id: r.allowed for r in spark.table("limited").collect()}
    assert got == {r.event_id: r.allowed for r in incremental.rate_limited(_events(spark), 2, 60).collect()}
    assert spark.table("limited").where(F.col("allowed")).count() == 5


def test_counters_equal_a_recount(spark, tmp_path):
    rng = random.Random(4)
    severities = ["critical", "high", "medium", "low", "info", "odd", None]
    rows = [(rng.choice("abc"), f"f{rng.randrange(40)}", v, rng.choice(severities), rng.random() < 0.25) for v in range(400)]
    late = rng.sample(rows, 150)
    batches = [rows[:100], rows[200:300], rows[100:200], rows[:50] + late, rows[300:], [("d", "x", 1, "low", True)]]
    src, sink = str(tmp_path / "in"), str(tmp_path / "out")
    for b in batches:
        rng.shuffle(b)
        spark.createDataFrame(b, counters.CHANGES).write.mode("append").parquet(src)
        stream = spark.readStream.schema(counters.CHANGES).parquet(src)
        counters.maintain(stream, sink, str(tmp_path / "cp")).awaitTermination()
    last = {}
    for scan, finding, version, severity, gone in rows:
        last[scan, finding] = (version, scan, severity, gone)
    alive = spark.createDataFrame([(s, v) for _, s, v, gone in last.values() if not gone], "scan_id string, severity string")
    want = {r.scan_id: tuple(r)[1:] for r in delta.scan_counters(alive).select("scan_id", *counters.COUNTS).collect()}
    got = {r.scan_id: tuple(r)[1:] for r in counters.latest(spark, sink).collect()}
    assert got == want | {"d": (0,) * 6} and sum(x[0] for x in want.values()) > 50


def test_counters_ask_the_store_by_bucket(spark, tmp_path):
    """As many groups as buckets, not as scans, and steps of one large scan from all of them."""
    src = str(tmp_path / "in")
    spark.range(3000).selectExpr("IF(id < 1000, 'big', CAST(id AS string)) AS scan_id", "CAST(id AS string) AS finding_id", "1L AS version", "'low' AS severity", "id % 10 = 0 AS gone").write.parquet(src)
    stream = spark.readStream.schema(counters.CHANGES).parquet(src)
    done = counters.maintain(stream, str(tmp_path / "out"), str(tmp_path / "cp"), buckets=16)
    done.awaitTermination()
    assert done.lastProgress.stateOperators[0].numRowsTotal == 16
    got = counters.latest(spark, str(tmp_path / "out"))
    assert got.count() == 2001 and tuple(got.where("scan_id = 'big'").first()) == ("big", 900, 0, 0, 0, 900, 0)
