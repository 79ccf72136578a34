"""Whole scans, stored scans and options."""

from dataclasses import replace

from pyspark.sql import functions as F

from lintel.operators import delta, report
from lintel.plans import api
from lintel.sources import document_sink, store, walk
from lintel.sources import files as sources


def test_scan_path(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.py").write_text("get(u, verify=False)\nhashlib.sha1(x)\n")
    (tmp_path / "b.py").write_bytes(b"a\0")
    (tmp_path / "package.json").write_text('{"dependencies": {\n"lodash": "4.0.0"\n}')
    r = api.scan_path(spark, str(tmp_path), api.ScanOptions(path_prefix="repo"))
    assert sorted((x.rule_id, x.file_path, x.line_start) for x in r.findings.collect()) == [("RULE-CRYPTO-002", "repo/a/x.py", 2), ("RULE-TLS-001", "repo/a/x.py", 1), ("dependency", "repo/package.json", 2)]
    assert [e.file for e in r.errors.collect()] == ["repo/b.py"]
    assert tuple(r.totals().first()) == (2, 6)
    m = r.metrics().first()
    assert m.total_files == 2 and m.language_breakdown == {"json": 1, "python": 1} and [f.path for f in m.largest_files] == ["repo/package.json", "repo/a/x.py"]
    assert "RULE-TLS-001" in r.sarif() and r.report()["summary"]["total"] == 3


def test_relative_roots_and_left_out_files(spark, tmp_path, monkeypatch):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.py").write_text("hashlib.sha1(x)\n")
    (tmp_path / "src" / "big.py").write_text("x" * 3000)
    (tmp_path / "src" / "c.py").write_text("y = 1\n")
    from pyspark.sql import functions as F

    from lintel.sources import files as sources

    here = sources.qualified(spark, str(tmp_path / "src" / ".."))
    assert here.startswith("file:/")
    r = api.scan_path(spark, str(tmp_path) + "/./src/", api.ScanOptions(max_bytes=2000, max_files=1))
    assert [x.file_path for x in r.findings.collect()] == ["a.py"]
    assert sorted(tuple(x) for x in r.skipped.collect()) == [("big.py", "too large"), ("c.py", "excluded or over the cap")]
    assert r.findings.where(F.col("file_path").contains("file:")).count() == 0


def test_links_and_excluded_folders(spark, tmp_path):
    import os

    outside = tmp_path / "outside"
    (outside / "deep").mkdir(parents=True)
    (outside / "secret.py").write_text("pickle.load(f)\n")
    root = tmp_path / "root"
    for folder in ("a/b", "node_modules/x", "vendored", "many"):
        (root / folder).mkdir(parents=True)
    for name in ("a/b/x.py", "node_modules/x/y.py", "vendored/z.py", "top.py"):
        (root / name).write_text("pickle.load(f)\n")
    for k in range(200):
        (root / "many" / str(k)).mkdir()
        (root / "many" / str(k) / "m.txt").write_text("x" * k)
    os.symlink(outside / "secret.py", root / "link.py")
    os.symlink(outside, root / "a" / "out")
    os.symlink(root, root / "a" / "loop")
    os.mkfifo(root / "pipe.py")
    r = api.scan_path(spark, str(root), api.ScanOptions(exclude=("node_modules/", "vendor/")))
    assert sorted(f.file_path for f in r.findings.collect()) == ["a/b/x.py", "top.py"]
    assert walk.listed(spark, str(root)).count() == 204
    (root / "node_modules").chmod(0)
    opened = []
    reader = walk.WalkReader({"path": str(root), "exclude": '["node_modules/", "many"]'})
    real = os.scandir
    try:
        os.scandir = lambda p: opened.append(str(p)) or real(p)
        got = [x for part in reader.partitions() for x in reader.read(part)]
    finally:
        os.scandir = real
        (root / "node_modules").chmod(0o755)
    assert sorted(p for p, _ in got) == ["a/b/x.py", "top.py", "vendored/z.py"] and not any("node_modules" in p or "many" in p for p in opened)
    lost = walk.with_contents(spark.createDataFrame([("gone.py", 3), ("link.py", 3), ("top.py", 15)], "path string, size long"), str(root)).collect()
    assert {x.path: x.content for x in lost} == {"gone.py": None, "link.py": None, "top.py": b"pickle.load(f)\n"}


def test_document(spark, tmp_path):
    (tmp_path / "x.py").write_text("hashlib.sha1(x)\npickle.load(f)\n")
    r = api.scan_path(spark, str(tmp_path))
    d = r.document()
    assert d["summary"]["total"] == 2 == len(d["vulnerabilities"]) and not d["truncated"] and d["lines_scanned"] == 3
    assert [v["line_start"] for v in d["vulnerabilities"]] == [1, 2] and d["vulnerabilities"][0]["cwe"] == ["CWE-328"]
    short = r.document(1, r.findings.where("line_start = 1"))
    assert short["truncated"] and len(short["vulnerabilities"]) == 1 and short["summary"]["total"] == 2
    assert [v["line_start"] for v in short["delta"]["new"]] == [2] and short["delta"]["unchanged"] == 1 and short["delta"]["resolved_fingerprints"] == []
    (tmp_path / "x.py").write_text("x = 1\n")
    assert api.scan_path(spark, str(tmp_path)).document()["vulnerabilities"] == []


def test_documents_written_by_executors(spark, tmp_path):
    import json

    for k in range(30):
        (tmp_path / f"x{k:02d}.py").write_text("pickle.load(f)  # é \"q\"\n" * (k % 3 + 1))
    r = api.scan_path(spark, str(tmp_path))
    r = replace(r, findings=r.findings.persist())
    (tmp_path / "out").mkdir()
    base = r.findings.where("line_start = 1").unionByName(r.findings.limit(1).withColumn("fingerprint", F.lit("gone")))
    for most, baseline in ((7, base),):
        path = tmp_path / "out" / "d.json"
        r.write_json(str(path), most, baseline)
        want = json.loads(json.dumps(r.document(most, baseline), default=str))
        assert json.loads(path.read_text()) == want and len(want["vulnerabilities"]) == (60 if most is None else most)
    for most in (5,):
        path = tmp_path / "out" / "d.sarif"
        r.write_sarif(str(path), most)
        assert json.loads(path.read_text()) == json.loads("".join(report.sarif_parts(r.findings, most=most)))
    empty = api.scan_files(sources.directory(spark, str(tmp_path)).where("false"))
    empty.write_sarif(str(path))
    assert json.loads(path.read_text())["runs"][0]["results"] == []
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["d.json", "d.sarif"]
    r.findings.unpersist()


def test_a_document_that_fails_leaves_the_old_one(spark, tmp_path):
    import pytest

    path = tmp_path / "d.txt"
    rows = spark.range(0, 5000, numPartitions=6).select(F.lit(0).alias("section"), F.col("id").cast("string").alias("value"), "id")
    document_sink.write_document(rows.unionByName(rows.withColumn("section", F.lit(1))), str(path), ["a", "b", "c"], [F.desc("id")], "-")
    down = "-".join(str(k) for k in range(4999, -1, -1))
    assert path.read_text() == f"a{down}b{down}c"
    with pytest.raises(Exception):
        document_sink.write_document(rows.withColumn("value", F.when(F.col("id") == 4000, F.raise_error(F.lit("lost"))).otherwise("x")), str(path), ["a", "b"], ["id"])
    assert path.read_text() == f"a{down}b{down}c"


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    from lintel import __main__ as cli

    p = tmp_path / "x.py"
    p.write_text("get(u, verify=False)\npickle.load(f)\n")
    out = tmp_path / "out.json"
    assert cli.main(["scan", str(tmp_path), "--rules", "RULE-DESER-001", "--output", str(out), "--fail-on-critical"]) == 1
    assert '"RULE-DESER-001"' in out.read_text() and '"RULE-TLS-001"' not in out.read_text()
    assert cli.main(["scan", str(tmp_path), "--format", "text", "--rules", "RULE-TLS-001"]) == 0
    out.unlink()
    assert cli.main(["fix", str(tmp_path)]) == 0 and "verify=False" in p.read_text()
    assert cli.main(["fix", str(tmp_path), "--write"]) == 0 and p.read_text() == "get(u, verify=True)\npickle.load(f)\n"
    assert cli.main(["report", str(tmp_path), "--format", "md", "--client", "Acme"]) == 0
    assert cli.main(["rules"]) == 0 and cli.main(["version"]) == 0
    said = capsys.readouterr().out
    assert "+ get(u, verify=True)" in said and "Client: Acme" in said and "RULE-SSRF-001" in said


def test_stored_scans(spark, tmp_path):
    import datetime

    import pytest

    f = spark.createDataFrame([("a", "critical"), ("b", "low")], "fingerprint string, severity string")
    day = datetime.datetime(2024, 1, 1)
    store.save_scan(spark, f, str(tmp_path), "1", "r", day, day)
    store.save_scan(spark, f.limit(0), str(tmp_path), "2", "r", day + datetime.timedelta(1), day + datetime.timedelta(1))
    scans = store.load_scans(spark, str(tmp_path))
    assert {(r.scan_id, r.total_vulnerabilities, r.critical_count) for r in scans.collect()} == {("1", 2, 1), ("2", 0, 0)}
    assert tuple(delta.baseline_of(scans, "2").first()) == ("2", "1", None)
    (tmp_path / "broken" / "scans").mkdir(parents=True)
    (tmp_path / "broken" / "scans" / "1.json").write_text('{"scan_id": "1", "folder": "findings/1/x"}')
    with pytest.raises(Exception):
        store.load_findings(spark, str(tmp_path / "broken")).count()


def test_a_save_that_dies_leaves_the_scan(spark, tmp_path, monkeypatch):
    import datetime

    import pytest
    from pyspark.sql import functions as F

    root, day = str(tmp_path / "a b'c"), datetime.datetime(2024, 1, 1)
    f = spark.createDataFrame([("a", "critical"), ("b", "low")], "fingerprint string, severity string")
    store.save_scan(spark, f, root, "x/1", "r", day, day)
    begun = store.load_findings(spark, root, "x/1")

    def state():
        rows = store.load_findings(spark, root, "x/1").collect()
        return sorted((r.fingerprint, r.scan_id) for r in rows), [(r.repository_id, r.total_vulnerabilities, str(r.created_at)) for r in store.load_scans(spark, root).collect()]

    was = state()
    assert was == ([("a", "x/1"), ("b", "x/1")], [("r", 2, "2024-01-01 00:00:00")])
    with pytest.raises(Exception):  # dies while findings are written
        store.save_scan(spark, f.withColumn("severity", F.raise_error(F.lit("lost"))), root, "x/1", "other", day, day)
    assert state() == was

    def dies(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(store, "_replace", dies)
    with pytest.raises(KeyboardInterrupt):  # dies before the record is replaced
        store.save_scan(spark, f.limit(1), root, "x/1", "other", day, day)
    monkeypatch.undo()
    assert state() == was
    store.save_scan(spark, f.limit(0), root, "x/1", "r2", day, day)
    assert state() == ([], [("r2", 0, "2024-01-01 00:00:00")]) and begun.count() == 2
    assert store.remove_unnamed(spark, root) == [] and len(store.remove_unnamed(spark, root, -1)) >= 2 and state()[0] == []
    assert not [p for p in (tmp_path / "a b'c" / "scans").iterdir() if "json." in p.name and not p.name.endswith(".crc")]


def test_stored_baselines_are_not_shuffled(spark, tmp_path):
    import re

    f = spark.range(300).selectExpr("md5(CAST(id AS STRING)) AS fingerprint", "id AS line_start")
    store.save_findings(f, str(tmp_path), "1")
    old = store.load_findings(spark, str(tmp_path), "1").select("fingerprint", "line_start")
    new = spark.range(100, 400).selectExpr("md5(CAST(id AS STRING)) AS fingerprint", "id AS line_start")
    rows = delta.classified(new, old).groupBy("change").agg(F.count("*").alias("n"))
    assert {tuple(r) for r in rows.collect()} == {("new", 100), ("resolved", 100), ("unchanged", 200)}
    plan = delta.classified(new, old)._jdf.queryExecution().executedPlan().toString()
    below = plan[: plan.index("FileScan parquet")].split("\n")
    # from the stored scan up to the join there is no exchange
    depth, steps = len(re.match(r"[ :+-]*", below[-1])[0]), []
    for line in reversed(below[:-1]):
        if (d := len(re.match(r"[ :+-]*", line)[0])) < depth:
            depth = d
            steps.append(line)
            if "Join" in line:
                break
    assert "Join" in steps[-1] and not any("Exchange" in x for x in steps) and plan.count("Exchange hashpartitioning") == 1, plan


def test_options():
    o = api.ScanOptions(rules=("xss",)).requested(exclude=("gen/",))
    assert o.rules == ("xss",) and o.exclude[-1] == "gen/"
    assert o.requested(rules=("secrets",)).rules == ("secrets",)


def test_store(spark, tmp_path):
    root = str(tmp_path)
    assert store.load_findings(spark, root) is None
    for k, marks in (("1", "ab"), ("2", "bc"), ("2", "bcd")):
        store.save_findings(spark.createDataFrame([(m,) for m in marks], "fingerprint string"), root, k)
    new, gone, same = delta.compared(store.load_findings(spark, root, "2").select("fingerprint"), store.load_findings(spark, root, "1").select("fingerprint"))
    assert sorted(x.fingerprint for x in new.collect()) == ["c", "d"] and [x.fingerprint for x in gone.collect()] == ["a"] and same.first()[0] == 1
