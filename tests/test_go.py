"""Go by its tokens."""

import pyarrow as pa
import pytest

from lintel.functions import go_code
from lintel.operators import structure
from lintel.plans import corpus
from lintel.sources import files as sources


@pytest.mark.parametrize("k", range(len(corpus.GO_FILES)))
def test_files_by_hand(k):
    code, functions, calls, imports = corpus.GO_FILES[k]
    s = go_code.structure(code) or {"functions": [], "calls": [], "imports": []}
    assert [(*f[:5], " ".join(f[5]), f[6]) for f in s["functions"]] == functions
    assert [(n, r or "", *x) for n, r, *x in s["calls"]] == calls
    assert [(p, a or "", n) for p, a, n in s["imports"]] == imports


@pytest.mark.parametrize("code", ["package x\nfunc f() {", "x y", 'package p; var s = "open\n', "", "package p /* x", "package p\nvar a = [1)", "package p\nvar r = 'a", "prose only"])
def test_no_go(code):
    assert go_code.structure(code) is None


def test_complexity_and_statement_ends():
    body = "func f(x int) {\n\tg\n\t(1)\n\tif a &&\n\t\tb {\n\t}\n\tgoto L // if for\nL:\n\tselect {\n\tcase <-c:\n\tcase d <- 1:\n\t}\n\ts := `case\n||`\n}"
    (f,) = go_code.structure(f"package p\n{body}\n")["functions"]
    assert f[:5] == ("f", 2, 16, False, 5)
    assert go_code.structure(f"package p\n{body}\n")["calls"] == []
    many = "package p\n" + "func f() { if x { g(1) } }\n" * 3000
    s = go_code.structure(many)
    assert len(s["functions"]) == len(s["calls"]) == 3000 and s["functions"][-1][1:3] == (3001, 3001)


def test_files_that_are_no_go_are_read_by_lines(spark):
    rows = [("a.go", "package a\nimport \"x\"\nfunc A(\n) { if b { } }"), ("b.go", "half of a file\nimport \"y\"\nfunc B() {\n\tif c {}\n}"), ("c.go", "package c\nfunc C() {\n"), ("d.go", None), ("e.go", "")]
    f = sources.parsed(spark.createDataFrame(rows, "path string, content string").selectExpr("*", "1L AS size", "'go' AS language"))
    got = sorted((r.path, r["name"], r.start_line, r.end_line, r.complexity) for r in structure.functions(f).collect())
    assert got == [("a.go", "A", 3, 4, 2), ("b.go", "B", 3, 5, 2), ("c.go", "C", 2, 3, 1)]
    assert sorted((r.path, r["name"], r.line_no) for r in structure.imports(f).collect()) == [("a.go", "x", 2), ("b.go", "y", 2)]
    assert structure.call_sites(f).count() == 0


def test_files_are_read_in_small_parts(spark, monkeypatch):
    """Whatever a batch holds, a part is a few files, and what is read leaves without its text."""
    parts = []
    monkeypatch.setattr(structure.go_code, "structure", lambda code, kinds: parts.append(kinds) or {k: [("f", None, 1, 1, False)] for k in kinds})
    run = structure._go_structure("calls")
    texts = ["package a\n"] * 300 + ["package b\n" + "x" * structure._BYTES] * 3 + [None]
    batch = pa.RecordBatch.from_pydict({"path": pa.array(map(str, range(304))), "language": pa.array(["go"] * 304), "content": pa.array(texts, pa.string())})
    out = list(run([batch]))
    assert [x.num_rows for x in out] == [64, 64, 64, 64, 44, 1, 1, 1, 1] and set(parts) == {("calls",)}
    assert [i for x in out for i in x.column("path").to_pylist()] == list(map(str, range(304))) and all(x.column("content").null_count == x.num_rows for x in out)
