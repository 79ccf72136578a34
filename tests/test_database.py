"""A database by JDBC; Derby comes with Spark."""

import datetime

import pytest
from pyspark.sql import functions as F

from lintel.operators import delta, detect
from lintel.plans import oracle, queries
from lintel.sources import database, shards
from lintel.sources import files as sources
from lintel.sources.shared import shared_dir

DAY = datetime.datetime(2024, 1, 2, 3, 4, 5)


@pytest.fixture(scope="module")
def db(spark):
    return database.of_session(spark)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_upsert_and_pushdown(spark, db):
    db.drop("things")
    db.create("things", {"k": "BIGINT NOT NULL PRIMARY KEY", "kind": "VARCHAR(20)", "v": "DOUBLE PRECISION"})
    df = spark.range(2000).select(F.col("id").alias("k"), F.concat(F.lit("k"), F.col("id") % 3).alias("kind"), (F.col("id") * 0.5).alias("v"))
    assert db.upsert(df, "things", ("k",)) == 2000
    new = spark.range(1500, 2500).select(F.col("id").alias("k"), F.lit("new").alias("kind"), F.lit(1.0).alias("v"))
    for _ in range(2):  # writing it again changes nothing
        assert db.upsert(new.repartition(3), "things", ("k",)) == 1000
    t = db.frame("things")
    assert t.count() == 2500 and t.where("kind = 'new'").count() == 1000
    by = t.where("v >= 100").groupBy("kind").agg(F.count("*").alias("n"), F.max("k").alias("last"))
    plan = _plan(by)
    assert "PushedAggregates: [COUNT(*), MAX(K)]" in plan and "PushedFilters: [V IS NOT NULL, V >= 100.0]" in plan and "PushedGroupByExpressions: [KIND]" in plan
    assert {tuple(r) for r in by.collect()} == {("k0", 433, 1497), ("k1", 433, 1498), ("k2", 434, 1499)}
    parts = db.ranges("things", "k", 4)
    assert parts.rdd.getNumPartitions() == 4 and parts.agg(F.sum("k")).first()[0] == sum(range(2500))
    assert not [x for x in db.tables() if x.startswith("STAGE_")]
    with pytest.raises(Exception):
        db.upsert(new.unionByName(new), "things", ("k",))  # keys that are not distinct
    assert t.count() == 2500 and not [x for x in db.tables() if x.startswith("STAGE_")]


def test_scans_are_saved_whole(spark, db, monkeypatch):
    for t in ("scans", "findings"):
        db.drop(t)
    f = sources.parsed(spark.createDataFrame([("a.py", "pickle.load(f)\nget(u, verify=False)\n", 10, "python")], "path string, content string, size long, language string"))
    found = detect.scan(f)
    db.save_scan(found, "1", "r", DAY, DAY)
    db.save_scan(found, "1", "r", DAY, DAY)
    db.save_scan(found.limit(0), "2", "r", DAY + datetime.timedelta(1), DAY + datetime.timedelta(1))
    scans = db.load_scans()
    counts = [f"{s}_count" for s in ("critical", "high", "medium", "low", "info")]
    assert {(r.scan_id, r.total_vulnerabilities, sum(r[c] for c in counts)) for r in scans.collect()} == {("1", 2, 2), ("2", 0, 0)}
    assert {r[0] for r in scans.select(F.date_format("created_at", "yyyy-MM-dd HH:mm:ss")).collect()} == {"2024-01-02 03:04:05", "2024-01-03 03:04:05"}
    back = db.load_findings("1")
    assert back.where("size(damaged) > 0").count() == 0
    same = [c for c in database.FINDINGS if c in found.columns and c != "scan_id"]
    assert sorted(map(repr, back.select("fingerprint", "refs.cwe", "refs.urls", "fix.replacement", "line_start", "title").collect())) == sorted(map(repr, found.select("fingerprint", "refs.cwe", "refs.urls", "fix.replacement", "line_start", "title").collect())) and len(same) > 12
    assert tuple(delta.baseline_of(scans, "2").first()) == ("2", "1", None)
    page = db.findings_page("1", 1, 2)
    assert "FETCH NEXT 1 ROWS ONLY" in _plan(page) and [r.line_start for r in page.collect()] == [sorted((r.severity, r.line_start) for r in found.collect())[1][1]]
    whole = db.transaction

    def dies(statements):
        if len(statements) > 2:
            statements = statements[:3] + [("INSERT INTO nowhere VALUES (1)",)]
        return whole(statements)

    monkeypatch.setattr(db, "transaction", dies)
    with pytest.raises(Exception):
        db.save_scan(found.limit(1), "1", "other", DAY, DAY)
    monkeypatch.undo()
    assert db.load_findings("1").count() == 2 and scans.where("scan_id = '1'").first().repository_id == "r"


def test_damaged_columns(spark):
    rows = [(1, '{"cwe":["CWE-1"],"extra":1}', None), (2, "{broken", '{"kind":"x"}'), (3, '{"cwe":"no list"}', "[]"), (4, None, "null"), (5, "", '{"summary":{"a":1}}')]
    got = {r.i: r for r in database.decoded(spark.createDataFrame(rows, "i int, refs string, fix string")).collect()}
    assert got[1].refs.cwe == ["CWE-1"] and got[1].damaged == [] and got[1].refs_text is None
    assert got[2].refs is None and got[2].damaged == ["refs"] and got[2].refs_text == "{broken" and got[2].fix.kind == "x"
    assert got[3].damaged == ["refs", "fix"] and got[3].refs_text == '{"cwe":"no list"}'
    assert got[4].damaged == ["fix"] and got[5].damaged[0] == "refs"


def test_shards(spark, tmp_path):
    db = shards.Shards(spark, str(tmp_path), 3)
    db.create("things", {"k": "BIGINT NOT NULL", "kind": "VARCHAR(20)", "v": "DOUBLE PRECISION", "at": "TIMESTAMP", "PRIMARY KEY": "(k)"})
    assert db.frame("things").count() == 0
    df = spark.range(2000).select(F.col("id").alias("k"), F.concat(F.lit("k"), F.col("id") % 3).alias("kind"), (F.col("id") * 0.5).alias("v"), F.lit(DAY).alias("at"))
    assert db.upsert(df, "things", ("k",)) == 2000
    before = db.frame("things")
    new = spark.range(1500, 2500).select(F.col("id").alias("k"), F.lit("new").alias("kind"), F.lit(1.0).alias("v"))
    assert db.upsert(new.repartition(3), "things", ("k",)) == 1000
    assert before.where("kind = 'new'").count() == 0  # what was begun before
    with pytest.raises(Exception):
        db.upsert(new.unionByName(new), "things", ("k",))  # keys that are not distinct
    t = db.frame("things")
    assert t.count() == 2500 and t.where("kind = 'new'").count() == 1000
    assert {tuple(r) for r in db.grouped("things", ("kind",), {"last": "k"}, "v >= 100").collect()} == {("k0", 433, 1497), ("k1", 433, 1498), ("k2", 434, 1499)}
    assert t.where("at is null").count() == 500 and {r[0] for r in t.where("k < 2000").select(F.date_format("at", "yyyy-MM-dd HH:mm:ss")).collect()} == {"2024-01-02 03:04:05"}
    assert db.upsert(new, "things", ("k",)) == 1000 and db.frame("things").count() == 2500
    db.drop("things")
    assert not db.tables() and not list(tmp_path.iterdir())


def test_sessions_with_executors_need_no_server(spark, sf_dir, same_rows, monkeypatch):


    shared_dir(spark)
    monkeypatch.setattr(spark.sparkContext, "master", "spark://somewhere:7077")
    assert isinstance(database.of_session(spark), shards.Shards)
    same_rows(queries.database_findings(spark, sf_dir), oracle.oracle_sql()["database_findings"])
