"""Dependencies from manifests, and the known vulnerable among them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintel.functions import regex as R
from lintel.functions import text as X
from lintel.plans import catalog as C

_DEP = "array<struct<name:string,version:string,line:int>>"


def manifest_kind(path: Column) -> Column:
    """The ecosystem of a manifest, null for other files."""
    low, out = F.lower(path), F.lit(None).cast("string")
    for end, kind in reversed(C.MANIFESTS):
        out = F.when(low.endswith(end), kind).otherwise(out)
    return out


def _dep(name: Column, version: Column, line: Column) -> Column:
    return F.struct(name.alias("name"), version.alias("version"), line.cast("int").alias("line"))


def _numbered() -> Column:
    """(line, its number, trimmed) of each line."""
    return F.transform("lines", lambda x, i: F.struct(x.alias("x"), (i + 1).alias("n"), X.trimmed(x).alias("t")))


def _section(opens, closes) -> Column:
    """The lines inside a section: those whose last opening or closing line before them opens.

    Openings and closings are few, so each line looks for the last of them; no
    rows are copied from line to line.
    """
    return X.bound(_numbered(), lambda rows: X.bound(_spans(rows, opens, closes), lambda spans: F.filter(rows, lambda r: F.exists(spans, lambda s: (r["n"] > s["a"]) & (r["n"] < s["b"])))))


def _spans(rows: Column, opens, closes) -> Column:
    """Where sections are open: the numbers of the lines before and after each."""
    marks = F.transform(F.filter(rows, lambda r: opens(r) | closes(r)), lambda r: F.struct(r["n"].alias("n"), opens(r).alias("open")))
    # from here on a section is open or not up to the next mark
    spans = lambda ms: F.transform(ms, lambda m, i: F.struct(m["n"].alias("a"), F.coalesce(F.get(ms, i + 1)["n"], F.size("lines") + 1).alias("b"), m["open"].alias("open")))
    return F.filter(X.bound(marks, spans), lambda s: s["open"])


def _npm() -> Column:
    pattern = C.NPM_PAIR
    rows = _section(lambda r: r["t"].contains('"dependencies"') | r["t"].contains('"devDependencies"'), lambda r: r["t"] == "}")
    rows = F.filter(rows, lambda r: R.matches(r["x"], pattern))
    return F.transform(rows, lambda r: _dep(R.found(r["x"], pattern, 1), F.regexp_replace(F.regexp_replace(R.found(r["x"], pattern, 2), r"^\^", ""), "^~", ""), r["n"]))


def _go() -> Column:
    pattern = C.GO_PAIR
    opens = lambda r: r["t"].startswith("require (")
    rows = F.filter(_section(opens, lambda r: r["t"] == ")"), lambda r: R.matches(r["t"], pattern))
    block = F.transform(rows, lambda r: _dep(R.found(r["t"], pattern, 1), R.found(r["t"], pattern, 2), r["n"]))
    parts = lambda r: F.split(X.collapsed(r["t"]), " ")
    single = F.filter(_numbered(), lambda r: r["t"].startswith("require ") & ~opens(r) & (F.size(parts(r)) >= 3))
    return F.concat(block, F.transform(single, lambda r: _dep(F.element_at(parts(r), 2), F.regexp_replace(F.element_at(parts(r), 3), "^v", ""), r["n"])))


def _pip() -> Column:
    pattern = C.PIP_PAIR
    rows = F.filter(_numbered(), lambda r: R.matches(r["t"], pattern))
    return F.transform(rows, lambda r: _dep(F.lower(R.found(r["t"], pattern, 1)), R.found(r["t"], pattern, 2), r["n"]))


def _gem() -> Column:
    pattern = C.GEM_PAIR
    rows = F.filter(_numbered(), lambda r: ~r["t"].startswith("#") & R.matches(r["x"], pattern))
    version = lambda r: X.trimmed(F.regexp_replace(F.regexp_replace(R.found(r["x"], pattern, 2), "^~>", ""), "^>=", ""))
    return F.transform(rows, lambda r: _dep(R.found(r["x"], pattern, 1), version(r), r["n"]))


def _found() -> Column:
    """The dependencies of a file, null where it is no manifest that is read."""
    kind = manifest_kind(F.col("path"))
    return F.when(kind == "javascript", _npm().cast(_DEP)).when(kind == "go", _go().cast(_DEP)).when(kind == "python", _pip().cast(_DEP)).when(kind == "ruby", _gem().cast(_DEP))


def dependencies(files: DataFrame) -> DataFrame:
    """(path, language, lines, name, version, line_no) of all manifests among the files."""
    some = files.where(manifest_kind(F.col("path")).isin("javascript", "go", "python", "ruby"))
    rows = some.select("path", "language", "lines", F.explode(_found()).alias("d"))
    return rows.select("path", "language", "lines", "d.name", "d.version", F.col("d.line").alias("line_no"))


def _known() -> Column:
    names = ("name", "range", "cve", "severity", "description")
    return F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in zip(names, (r[0], r[1], r[3], r[4], r[5]))]) for r in C.KNOWN_VULNERABLE])


def vulnerable() -> Column:
    """An array of (name, version, line, cve, severity, description) of a file's known vulnerable dependencies.

    The list of known ones is a literal of nine, so this is a part of the file's
    row and neither a join nor a second pass; empty where there is no manifest.
    """
    each = lambda d: F.transform(
        F.filter(_known(), lambda k: (k["name"] == d["name"]) & X.in_range(d["version"], k["range"])),
        lambda k: F.struct(d["name"].alias("name"), d["version"].alias("version"), d["line"].alias("line"), k["cve"].alias("cve"), k["severity"].alias("severity"), k["description"].alias("description")),
    )
    return F.coalesce(F.flatten(F.transform(_found(), each)), F.array().cast(VULNERABLE))


VULNERABLE = "array<struct<name:string,version:string,line:int,cve:string,severity:string,description:string>>"


def dependency_findings(files: DataFrame) -> DataFrame:
    """Findings of the dependency rule alone; they have no span on their line."""
    from lintel.operators.detect import findings_of

    return findings_of(files, patterns=(), languages=(), secrets=False)
