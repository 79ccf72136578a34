"""Rules, suppression, fingerprints, fixes: small cases with known answers."""

import pytest
from pyspark.sql import functions as F

from lintel.functions import regex as R
from lintel.functions import text as X
from lintel.operators import delta, dependency, detect, metrics, report, structure
from lintel.plans import catalog as C
from lintel.sources import files as sources


def files_of(spark, *pairs):
    df = spark.createDataFrame(list(pairs), "path string, content string").withColumn("size", F.octet_length("content").cast("long"))
    return sources.parsed(df.withColumn("language", X.language(F.col("path"))))


def rules(df):
    return sorted(r.rule_id for r in df.collect())


@pytest.mark.parametrize(
    ("path", "line", "rule"),
    [
        ("a.go", 'db.Query("SELECT * FROM t WHERE n=" + name)', "sql_injection"),
        ("a.py", 'cursor.execute("SELECT %s" % name)', "sql_injection"),
        ("a.js", 'query("SELECT " + name)', "sql_injection"),
        ("a.ts", "execute(`SELECT ${name}`)", "sql_injection"),
        ("a.java", "stmt.executeQuery(sql + name)", "sql_injection"),
        ("a.php", 'mysqli_query($c, "a" . $b)', "sql_injection"),
        ("a.rb", 'User.where("n = #{name}")', "sql_injection"),
        ("a.js", "el.innerHTML = name", "xss"),
        ("a.go", "resp = fetch(userURL)", "RULE-SSRF-001"),
        ("a.py", "open(request.path)", "RULE-PATH-001"),
        ("a.py", "token = random.randint(1, 2)", "RULE-RAND-001"),
        ("a.py", "hashlib.sha1(x)", "RULE-CRYPTO-002"),
        ("a.java", 'Cipher.getInstance("DES")', "RULE-CRYPTO-003"),
        ("a.py", "get(u, verify=False)", "RULE-TLS-001"),
        ("a.py", 'h = {"Authorization": "Basic dXNlcjpwYXNz"}', "secrets"),
        ("a.go", 'header := "Basic QWxhZGRpbjpvcGVuIHNlc2FtZQ=="', "secrets"),
        ("a.txt.py", 'Authorization: "Basic dXNlcjpwYXNz"', "secrets"),
    ],
)
def test_rule_fires(spark, path, line, rule):
    found = rules(detect.raw_findings(files_of(spark, (path, line))))
    assert rule is None or rule in found


@pytest.mark.parametrize("line", ['log("cannot DELETE row")', "redis.Eval(ctx, script)", 'x = "hello"', 'Authorization: Basic realm="x"', 'header := "Basic realm=Restricted"', 'x = "basic information"'])
def test_safe_lines(spark, line):
    assert rules(detect.raw_findings(files_of(spark, ("a.go", line)))) == []


def test_word_edges_are_ascii(spark):
    got = {r.line for r in detect.pattern_findings(files_of(spark, ("a.md.py", "édes\ndesé\na_des\nxdes\ndes"))).collect()}
    assert got == {"édes", "desé", "des"}


def test_spans_are_bytes(spark):
    line = '"😀é" x.innerHTML = 1'
    r = detect.language_findings(files_of(spark, ("a.js", line)), C.XSS).first()
    assert line.encode()[r.match_start : r.match_end].decode() == r.match_text == ".innerHTML ="


def test_suppression(spark):
    body = "// lintel:ignore-next-line xss\nel.innerHTML = a\nel.innerHTML = b // lintel:ignore xss, RULE-XSS-001\nel.outerHTML = c // lintel:ignore sql_injection -- all inputs\n"
    f = files_of(spark, ("a.js", body), ("b.js", "# lintel:ignore-file all\neval(x)"), ("c.js", 's = "lintel:ignore all"; eval(x)'))
    left = sorted((r.path, r.line_no, r.rule_id) for r in detect.suppressed(detect.raw_findings(f)).collect())
    assert left == [("a.js", 2, "RULE-XSS-001"), ("a.js", 4, "RULE-XSS-001"), ("a.js", 4, "xss"), ("c.js", 2 - 1, "xss")]


def test_fingerprints(spark):
    a = {r.fingerprint for r in detect.scan(files_of(spark, ("a.js", "eval(x)"))).collect()}
    b = {r.fingerprint for r in detect.scan(files_of(spark, ("./a.js", "\n\n  eval(x)"))).collect()}
    c = [r.fingerprint for r in detect.scan(files_of(spark, ("a.js", "eval(x)\neval(x)"))).collect()]
    assert a == b and len(set(c)) == 2 and a < set(c)


def test_every_rule_has_score_fix_and_category(spark):
    ids = {r[0] for r in C.rule_table()}
    assert ids == set(C.CVSS) == set(C.FIXES)


def test_references_are_routed(spark):
    df = spark.range(1).select(detect.routed(F.lit("CWE-1"), F.array(F.lit("CWE-1"), F.lit("https://owasp.org/x"), F.lit("https://a.b"), F.lit(" "))).alias("r"))
    r = df.first().r
    assert (r.cwe, r.owasp, r.urls) == (["CWE-1"], ["https://owasp.org/x"], ["https://a.b"])


@pytest.mark.parametrize(
    ("line", "fixed"),
    [
        ("InsecureSkipVerify: true,", "InsecureSkipVerify: false,"),
        ("é rejectUnauthorized : false", "é rejectUnauthorized : true"),
        ("get(u, verify = False)", "get(u, verify = True)"),
        ("o($c, CURLOPT_SSL_VERIFYPEER, 0)", "o($c, CURLOPT_SSL_VERIFYPEER, 1)"),
        ("verify=False, verify=False", "verify=True, verify=False"),
        ("ssl._create_unverified_context()", None),
    ],
)
def test_tls_fix(spark, line, fixed):
    f = files_of(spark, ("a.py", f"x\n{line}\r\ny"))
    found = detect.scan(f, ["RULE-TLS-001"])
    rows = report.fixed_files(f, found).collect()
    assert [r.new_content for r in rows] == ([] if fixed is None else [f"x\n{fixed}\r\ny"])
    assert found.first().fix.kind == ("guidance" if fixed is None else "safe_replace")


def test_sarif(spark):
    assert '"results": []' in report.to_sarif(detect.scan(files_of(spark, ("a.py", "x = 1"))))
    doc = report.to_sarif(detect.scan(files_of(spark, ("a.py", "get(u, verify=False)\neval(x)\nhashlib.sha1(x)"))))
    assert '"fixes"' in doc and "endLine" not in doc and doc.count('"level": "warning"') == 1


def test_report(spark):
    f = detect.scan(files_of(spark, ("a.py", "hashlib.sha1(x)\npickle.load(f)")))
    m = report.model(f)
    assert [x["severity"] for x in m["findings"]] == ["critical", "medium"] and [r["priority"] for r in m["roadmap"]] == [1, 2]
    assert "pickle.load" in report.to_markdown(m) and "&gt;" in report.to_html(m)
    md, html = report.to_markdown(m, brand=report.Brand(client="Acme Inc.")), report.to_html(m, brand=report.Brand(client="Acme <Inc.>", primary="red"))
    for want in ("# Security Assessment Report", "| Severity | Count |", "## Remediation Roadmap", "**Suggested Fix**", "CWE-502", "9.8 (Critical)", "Acme Inc.", "Executive Summary", "5.3 (Medium)"):
        assert want in md, want
    for want in ("Executive Summary", "Remediation Roadmap", "Suggested Fix", "CWE-502", "9.8 (Critical)", "a.py:2", "<style", "Acme &lt;Inc.&gt;", report.DEFAULT_COLOURS[0]):
        assert want in html, want
    assert "<script" not in html and 'src="http' not in html and [x["index"] for x in m["findings"]] == [1, 2]
    short = report.model(f, 1)
    assert short["truncated"] and not m["truncated"] and "1 worst of 2" in report.to_markdown(short) and "1 worst of 2" in report.to_html(short)
    empty = report.model(f.limit(0))
    assert "No findings" in report.to_markdown(empty) and "No findings" in report.to_html(empty)


def test_gate(spark):
    bad = detect.scan(files_of(spark, ("a.py", "pickle.load(f)")))
    assert report.gate(bad).first().failed and not report.gate(bad, False).first().failed and not report.gate(bad.limit(0)).first().failed


def test_delta(spark):
    now, old = (spark.createDataFrame([(x, 1) for x in v], "fingerprint string, n int") for v in ("aab", "ac"))
    new, gone, same = delta.compared(now, old)
    assert [r.fingerprint for r in new.collect()] == ["b"] and [r.fingerprint for r in gone.collect()] == ["c"] and same.first().unchanged == 1
    assert tuple(delta.compared_counts(now, old).first()) == (1, 1, 2)
    assert delta.compared(now, None)[0].count() == 2


def test_findings_of_one_fingerprint_stay_whole(spark):
    now = spark.createDataFrame([("f", "a.py", 9), ("f", "b.py", 3)], "fingerprint string, file_path string, line_start int")
    assert [tuple(r) for r in delta.compared(now, None)[0].collect()] == [("f", "b.py", 3)]


def test_a_scan_reads_each_side_once(spark, sf_dir):
    from lintel.plans import queries

    for name, reads in (("findings", 1), ("delta_counts", 2)):
        df = queries.queries()[name](spark, sf_dir)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        plan = plan[: plan.index("== Initial Plan ==")] if "== Initial Plan ==" in plan else plan
        assert plan.count("FileScan parquet") == reads and "Join" not in plan.replace("SortMergeJoin", "" if reads == 2 else "Join").replace("BroadcastHashJoin", "")


def test_baseline_of(spark):
    rows = [(1, 7, "completed", 1, 2), (2, 7, "failed", 2, None), (3, 7, "completed", 3, 4), (4, 8, "completed", 1, 2)]
    scans = spark.createDataFrame(rows, "scan_id int, repository_id int, status string, created_at int, completed_at int")
    one = lambda *a: tuple(delta.baseline_of(scans, *a).first())
    assert one(3) == (3, 1, None) and one(1) == (1, None, None) and one(3, 1) == (3, 1, None)
    assert [one(3, b)[2] for b in (2, 3, 4, 9)] == ["baseline is not completed", "baseline is the scan itself", "baseline is of another repository", "baseline not found"]


def test_versions(spark):
    pairs = [("1.2", "1.2.0", 0), ("10.0", "9.9", 1), ("latest", "1", -1), ("4.17.21-rc1", "4.17.21", 0), ("", "0", 0)]
    df = spark.createDataFrame([p[:2] for p in pairs], "a string, b string")
    assert [r[0] for r in df.select(X.compare_versions(F.col("a"), F.col("b"))).collect()] == [p[2] for p in pairs]


def test_dependencies(spark):
    f = files_of(spark, ("p/package.json", '{\n"dependencies": {\n"lodash": "^4.17.20",\n"Lodash": "1.0"\n}\n}'), ("setup.py", "Django==4.2\nrequests >= 2.31.0\n# flask==1.0"))
    got = sorted((r.title, r.line_no) for r in dependency.dependency_findings(f).collect())
    assert got == [("Vulnerable dependency: django", 1), ("Vulnerable dependency: lodash", 3)]


def test_walk(spark, tmp_path):
    for name in ("main.go", "script.py", "ignored.txt", "node_modules/lib.js", "a/x.go", "big.py"):
        p = tmp_path / name
        p.parent.mkdir(exist_ok=True)
        p.write_text("x" * (1 << 21) if name == "big.py" else "x\n")
    (tmp_path / "bin.py").write_bytes(b"a\0b")
    kept = sources.admitted(sources.directory(spark, str(tmp_path)))
    text, errors = sources.readable(kept)
    assert sorted(r.path for r in text.select("path").collect()) == ["a/x.go", "main.go", "script.py"]
    assert [r.file for r in errors.collect()] == ["bin.py"]
    assert [r.path for r in sources.capped(text.select("path"), 2).collect()] == ["a/x.go", "main.go"]
    assert sources.prefixed(text, "repo/./x/..").where("path = 'repo/main.go'").count() == 1


def test_lines_and_classes(spark):
    f = files_of(spark, ("a.go", "/* a\n b */ x\n// c\n\ncode\n/* open\nrest"), ("b.sh", "#!/bin/sh\n# c\nls"), ("c.html", "<!-- a\nb\n-->\n<p>"), ("d.css", "/* x */"), ("e.py", ""), ("f.py", "#c\r\nx\r\n"))
    got = {r.path: (r.code, r.comment, r.blank) for r in metrics.line_classes(f).collect()}
    assert got == {"a.go": (1, 5, 1), "b.sh": (2, 1, 0), "c.html": (1, 3, 0), "d.css": (1, 0, 0), "e.py": (0, 0, 1), "f.py": (1, 1, 1)}


def test_empty_metrics(spark):
    none = files_of(spark, ("a.py", "x")).limit(0)
    assert metrics.complexity_score(none).first()[0] == 100 and metrics.duplication_score(none).first()[0] == 100
    assert metrics.totals(none).first().total_files == 0


def test_structure(spark):
    f = files_of(spark, ("a.py", "import os\n@deco\ndef one(a): pass\n  def _two(): pass"), ("b.js", 'import {a} from "m"\nexport async function go() {}'))
    assert sorted((r.name, r.is_exported) for r in structure.functions(f).collect()) == [("_two", False), ("go", True), ("go", True), ("one", True)]
    assert sorted(r.name for r in structure.imports(f).collect()) == ["m", "os"]


def test_go_structure(spark):
    body = 'import (\n\t"fmt"\n\tq "a/b"\n)\nimport "os"\n\nfunc (s *T) Run(a int) error {\n\tif a > 1 && ok || x {\n\t\treturn nil // if for\n\t}\n\tfor {\n\t\tswitch a {\n\t\tcase 1:\n\t\tdefault:\n\t\t}\n\t}\n\treturn "if" + `case`\n}\n\nfunc small() { return }\n'
    f = files_of(spark, ("a.go", body))
    got = sorted((r.name, r.start_line, r.end_line, r.is_exported, r.complexity) for r in structure.functions(f).collect())
    assert got == [("Run", 7, 18, True, 7), ("small", 20, 20, False, 1)]
    assert sorted((r.name, r.line_no) for r in structure.imports(f).collect()) == [("a/b", 3), ("fmt", 2), ("os", 5)]
    m = metrics.function_metrics(structure.functions(f)).first()
    assert (m.total_functions, m.average_function_size, m.largest_function, m.exported_functions, m.average_complexity) == (2, 6.5, 12, 1, 4.0)


def test_strings(spark):
    line = r"""s = 'one' + "t\"wo" + `th${r}` + "" + 'é' + 'open"""
    got = [(r.value, r.column, r.is_raw, r.is_template) for r in structure.string_literals(files_of(spark, ("a.js", line))).collect()]
    assert got == [("one", 5, False, False), ('t\\"wo', 13, False, False), ("th${r}", 23, True, True), ("é", 39, False, False)]


def test_markers_and_colours(spark):
    assert {r.type for r in detect.security_markers(files_of(spark, ("a.py", "eval(x); password = 1"))).collect()} == {"eval", "auth"}
    df = spark.createDataFrame([("#ffffff",), ("#0A0b0c",), ("#fff",), ("red",)], "c string")
    assert [r[0] for r in df.select(X.darkened(F.col("c"), 0.5)).collect()] == ["#7f7f7f", "#050506", "#fff", "red"]


@pytest.mark.parametrize(
    ("url", "ok"),
    [
        ("https://github.com/a/b", True), ("ssh://git@github.com/a/b", True), ("https://GitHub.com/a/b", True), ("http://github.com/a/b", False), ("git://github.com/a", False), ("file:///etc", False),
        ("https://tok@github.com/a", False), ("ssh://git:pw@github.com/a", False), ("https://github.com.evil.com/a", False), ("https://evil.com/github.com", False), ("https://github.com/a/../b", False), ("", False), ("git@github.com:a/b", False), (" https://github.com/a ", True),
    ],
)
def test_urls(spark, url, ok):
    assert spark.createDataFrame([(url,)], "u string").select(sources.supported_url(F.col("u"), ("github.com",))).first()[0] is ok


def test_page_is_alphabetical(spark):
    rows = [("medium", 1), ("critical", 2), ("low", 3), ("info", 4), ("high", 5)]
    df = spark.createDataFrame([(s, n, "p", str(n)) for s, n in rows], "severity string, line_start int, file_path string, fingerprint string")
    assert [r.severity for r in delta.page(df, 3).collect()] == ["critical", "high", "info"] and delta.page(df, 3, 2).count() == 2


def test_strings_of_long_lines(spark):
    """No stack for each character, no second look at a line for each of its literals."""
    words = "x" * 400_000
    many = "".join(f"é 'a{k}' " for k in range(5000))
    got = structure.string_literals(files_of(spark, ("a.js", f'{words}"{words}\\"" `'), ("b.js", many))).collect()
    assert [(r.column, len(r.value)) for r in got if r.path == "a.js"] == [(400_001, 400_002)]
    at, want = 1, []
    for k in range(5000):
        want.append((f"a{k}", at + 3))
        at += len(f"é 'a{k}' ".encode())
    assert sorted((r.value, r.column) for r in got if r.path == "b.js") == sorted(want)


def test_values_are_made_once(spark):
    """A line is trimmed once for all control words, and a manifest's lines are numbered once for all its sections."""
    f = files_of(spark, ("a.js", "if x for y"))
    plan = metrics.file_complexity(f)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 1
    plan = f.select(dependency._section(lambda r: r["t"].contains("a"), lambda r: r["t"] == "}").alias("s"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 1


def test_edges_are_ascii_under_folding(spark):
    """A character that folds to an ASCII letter is no part of a word."""
    rows = spark.createDataFrame([("\u017fDES x",), ("\u212aDES",), ("sDES x",), ("DES",)], "line string")
    assert [r.m for r in rows.select(R.matches(F.col("line"), r"(?i)\bDES\b").alias("m")).collect()] == [True, True, False, True]


def test_fixed_runs():
    """What every match of an expression has: nothing from groups, classes, repeats or alternatives."""
    assert R.fixed(r"(?i)on\w+\s*=\s*[\"'][^\"']*\+") == ("on", "=", "+")
    assert R.fixed(r"(?i)response\.getWriter\(\)\.print(ln)?x{2,}y?") == ("response.getwriter().print",)
    assert R.fixed("a|bc") == () and R.fixed("(a|b)c") == ("c",)


def test_lines_of_prose_are_not_searched():
    """The literals that lines are picked by: a long run of the expression, not a syllable that prose is full of."""
    every = {p: need for _, _, p, need, _, _ in detect._tries(C.PATTERN_RULES, C.LANGUAGE_RULES, True)}
    assert not any(x in ("on", "print") for p, need in every.items() for x in need if not p.startswith(("(?i)print", "(?i)echo")))
    assert every[r"(?i)response\.getWriter\(\)\.print"] == ("response.getwriter().print",)
