"""Imports, functions, calls and string literals of source files.

Go is read by its tokens (`functions.go_code`). What does not parse as a Go file, such as a
part of one, is read as its formatter would write it: a function begins with `func` at the start
of a line and ends with the next line that starts with a brace, or on its own line; calls are
then unknown.
"""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from lintel.functions import go_code
from lintel.functions import regex as R
from lintel.functions import text as X
from lintel.operators.detect import all_lines
from lintel.plans import catalog as C
from lintel.sources.files import parsed


def _matched(files: DataFrame, table: dict, trim: tuple) -> DataFrame:
    """A row for each expression of a line's language that matches it."""
    rows = all_lines(files.where(F.col("language").isin(list(table))))
    text = F.when(F.col("language").isin(list(trim)), X.trimmed(F.col("line"))).otherwise(F.col("line"))
    tries = [(lang, p) for lang, ps in table.items() for p in ps]
    hits = F.array(*[F.when((F.col("language") == lang) & R.matches(text, p), R.found(text, p, 1)) for lang, p in tries])
    return rows.select("path", "language", "line_no", "line", F.explode(F.array_compact(hits)).alias("name"))


#: What a Go file holds of each kind.
_KINDS = {
    "imports": "struct<name:string,alias:string,line_no:int>",
    "functions": "struct<name:string,start_line:int,end_line:int,is_exported:boolean,complexity:int,parameters:array<string>,return_type:string>",
    "calls": "struct<name:string,receiver:string,line_no:int,column:int,is_method:boolean>",
}
#: Files of Go that Python holds at a time, and bytes of them; a file is never cut.
_FILES, _BYTES = 64, 1 << 20


def _go_structure(kind: str):
    """Batches of (path, language, content) with what files have of a kind, null if they are no Go; a batch is worked off in small parts."""
    item = to_arrow_type(_parse_datatype_string(_KINDS[kind]))
    names = [f.name for f in item]

    def run(batches):
        for batch in batches:
            at, sizes = 0, pc.fill_null(pc.binary_length(batch.column("content")), 0).to_pylist()
            while at < batch.num_rows:
                end, size = at + 1, sizes[at]
                while end < min(at + _FILES, batch.num_rows) and size + sizes[end] <= _BYTES:
                    size += sizes[end]
                    end += 1
                part = batch.slice(at, end - at)
                texts = part.column("content").to_pylist()
                found = [go_code.structure(c or "", (kind,)) for c in texts]
                rows = pa.array([None if f is None else [dict(zip(names, x)) for x in f[kind]] for f in found], pa.list_(item))
                # only files that cannot be read go on with their contents
                rest = pa.array([c if f is None else None for c, f in zip(texts, found)], part.column("content").type)
                yield pa.RecordBatch.from_arrays([part.column("path"), part.column("language"), rest, rows], ["path", "language", "content", "go"])
                at = end

    return run


def _go(files: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """(path, language and what files of Go have of a kind, the files that only look like Go)."""
    named = files.where(F.col("language") == "go")
    clause = F.coalesce(F.col("content").rlike(r"(?m)^\s*package\s"), F.lit(False))  # none, so nothing to parse
    read = named.where(clause).select("path", "language", "content").mapInArrow(_go_structure(kind), f"path string, language string, content string, go array<{_KINDS[kind]}>")
    odd = parsed(named.where(~clause).select("path", "language", "content").unionByName(read.where("go IS NULL").drop("go")))
    return read.select("path", "language", F.inline("go")), odd


def call_sites(files: DataFrame) -> DataFrame:
    """(path, name, receiver, line_no, column, is_method) of the calls by name in Go files."""
    return _go(files, "calls")[0].drop("language")


def go_functions(files: DataFrame) -> DataFrame:
    """(path, name, start_line, end_line, is_exported, complexity, parameters, return_type) of Go files."""
    return _go(files, "functions")[0].drop("language")


def go_imports(files: DataFrame) -> DataFrame:
    """(path, name, alias, line_no) of Go files."""
    return _go(files, "imports")[0].drop("language")


def _go_imports(files: DataFrame) -> DataFrame:
    """Single imports, and the lines between `import (` and the next closing bracket."""
    row = F.transform("lines", lambda x, i: F.struct(x.alias("x"), (i + 1).cast("int").alias("n")))
    marks = F.filter(row, lambda r: r["x"].startswith("import (") | r["x"].startswith(")"))
    spans = F.filter(F.transform(marks, lambda m, i: F.struct(m["n"].alias("a"), F.coalesce(F.get(marks, i + 1)["n"], F.size("lines") + 1).alias("b"), m["x"].startswith("i").alias("open"))), lambda s: s["open"])
    inside = lambda r: F.exists(spans, lambda s: (r["n"] > s["a"]) & (r["n"] < s["b"]))
    name = lambda r: F.when(R.matches(r["x"], C.GO_IMPORT), R.found(r["x"], C.GO_IMPORT, 1)).when(inside(r) & R.matches(r["x"], C.GO_IMPORT_LINE), R.found(r["x"], C.GO_IMPORT_LINE, 1))
    found = F.filter(F.transform(row, lambda r: F.struct(name(r).alias("name"), r["n"].alias("n"))), lambda f: f["name"].isNotNull())
    rows = files.where((F.col("language") == "go") & F.col("content").contains("import")).select("path", "language", F.explode(found).alias("f"))
    return rows.select("path", "language", "f.name", F.col("f.n").alias("line_no"))


def imports(files: DataFrame) -> DataFrame:
    """(path, language, name, line_no)."""
    read, odd = _go(files, "imports")
    found = _matched(files, C.IMPORTS, ("python", "java")).select("path", "language", "name", "line_no")
    return found.unionByName(read.drop("alias")).unionByName(_go_imports(odd))


def _go_functions(files: DataFrame) -> DataFrame:
    """Functions and methods of Go with their last line and cyclomatic complexity.

    One more than the branches in them: if, for, case, default, && and ||, strings
    and comments left out.
    """
    row = F.transform("lines", lambda x, i: F.struct(x.alias("x"), (i + 1).cast("int").alias("n")))
    starts = F.filter(row, lambda r: R.matches(r["x"], C.GO_FUNCTION))
    closes = F.transform(F.filter(row, lambda r: r["x"].startswith("}")), lambda r: r["n"])
    last = lambda r: F.when(R.matches(r["x"], C.GO_ONE_LINE), r["n"]).otherwise(F.coalesce(F.array_min(F.filter(closes, lambda c: c > r["n"])), F.size("lines")))
    spans = F.transform(starts, lambda r: F.struct(r["x"].alias("x"), r["n"].alias("n"), last(r).alias("end")))
    rows = files.where((F.col("language") == "go") & F.col("content").contains("func")).select("path", "language", F.explode(F.transform(spans, lambda s: F.struct(s["x"].alias("x"), s["n"].alias("n"), s["end"].alias("end"), F.array_join(F.slice("lines", s["n"], s["end"] - s["n"] + 1), "\n").alias("code")))).alias("f"))
    name = R.found(F.col("f.x"), C.GO_FUNCTION, 1)
    plain = F.regexp_replace("f.code", R.to_java(C.GO_PLAIN), " ")
    return rows.select("path", "language", name.alias("name"), F.col("f.n").alias("start_line"), F.col("f.end").alias("end_line"), name.rlike(r"^\p{Lu}").alias("is_exported"), (F.regexp_count(plain, F.lit(R.to_java(C.GO_BRANCH))) + 1).alias("complexity"))


def functions(files: DataFrame) -> DataFrame:
    """(path, language, name, start_line, end_line, is_exported, complexity).

    Java's control words are no methods. Only for Go are the end and the complexity
    known; they are 0 for others.
    """
    rows = _matched(files, C.FUNCTIONS, ("ruby",))
    rows = rows.where(~((F.col("language") == "java") & F.col("name").isin(list(C.NOT_METHODS))))
    exported = (
        F.when(F.col("language").isin("javascript", "typescript"), F.col("line").contains("export")).when(F.col("language") == "java", F.col("line").contains("public")).when(F.col("language") == "php", False).otherwise(~F.col("name").startswith("_"))
    )
    rows = rows.select("path", "language", "name", F.col("line_no").alias("start_line"), F.lit(0).alias("end_line"), exported.alias("is_exported"), F.lit(0).alias("complexity"))
    read, odd = _go(files, "functions")
    return rows.unionByName(read.drop("parameters", "return_type")).unionByName(_go_functions(odd))


#: What lies between literals, then a literal; each match begins where the last one ended, so an open quote ends the line's literals.
#: Repeats are possessive: Java matches those in a loop, where others take stack for each character.
_LITERAL = r"""(?s)\G((?:[^"'`\\]++|\\.)*+)("(?:[^"\\]++|\\.)*+"|'(?:[^'\\]++|\\.)*+'|`(?:[^`\\]++|\\.)*+`)"""
#: Literals to a block, as a power of two: sums of blocks stand for all literals before.
_BLOCK = 7


def _strings(line: Column) -> Column:
    """The literals of a line, with the byte columns of their quotes; empty ones are left out."""
    before, quoted = (F.regexp_extract_all(line, F.lit(_LITERAL), F.lit(k)) for k in (1, 2))
    total = lambda part: F.aggregate(part, F.lit(0), lambda a, x: a + x)
    sizes = lambda pairs: F.transform(pairs, lambda p: F.octet_length(p["b"]) + F.octet_length(p["q"]))
    blocks = lambda size: F.transform(F.sequence(F.lit(0), F.shiftright(F.size(size), _BLOCK)), lambda i: total(F.slice(size, F.shiftleft(i, _BLOCK) + 1, 1 << _BLOCK)))

    def placed(pairs: Column, size: Column, sums: Column) -> Column:
        rest = lambda k: k.bitwiseAND((1 << _BLOCK) - 1)
        start = lambda k: total(F.slice(sums, F.lit(1), F.shiftright(k, _BLOCK))) + total(F.slice(size, k - rest(k) + 1, rest(k)))
        return F.transform(pairs, lambda p, k: F.struct(F.substring(p["q"], 2, F.length(p["q"]) - 2).alias("value"), (start(k) + F.octet_length(p["b"]) + 1).alias("column"), p["q"].startswith("`").alias("raw")))

    each = X.bound(F.arrays_zip(before.alias("b"), quoted.alias("q")), lambda pairs: X.bound(sizes(pairs), lambda size: X.bound(blocks(size), lambda sums: placed(pairs, size, sums))))
    return F.filter(each, lambda x: x["value"] != "")


def string_literals(files: DataFrame) -> DataFrame:
    """(path, line_no, value, column, is_raw, is_template); columns are bytes from 1."""
    rows = all_lines(files).where(F.col("line").rlike("[\"'`]"))
    rows = rows.select("path", "line_no", F.explode(_strings(F.regexp_replace("line", "\r$", ""))).alias("s"))
    return rows.select("path", "line_no", "s.value", "s.column", F.col("s.raw").alias("is_raw"), (F.col("s.raw") & F.col("s.value").contains("${")).alias("is_template"))
