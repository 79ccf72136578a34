"""Code metrics: line classes, languages, sizes, complexity, duplication, functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lintel.functions import text as X
from lintel.plans import catalog as C


def _classes() -> Column:
    """struct(code, comment, blank) of a file: a fold over its lines that carries an open block comment."""
    lang = F.col("language")
    slash, markup = lang.isin(list(C.SLASH_COMMENTS)), lang.isin("html", "xml")
    hash_, shell = lang.isin("python", "ruby"), lang == "shell"
    kind = "struct<open:boolean,code:bigint,comment:bigint,blank:bigint>"
    zero = F.struct(F.lit(False).alias("open"), *[F.lit(0).cast("bigint").alias(c) for c in ("code", "comment", "blank")]).cast(kind)

    def step(acc, t):
        blank = t == ""
        opens = (slash & ~acc["open"] & t.startswith("/*")) | (markup & t.startswith("<!--"))
        closes = F.when(slash, t.contains("*/")).otherwise(t.contains("-->"))
        comment = ~blank & (
            (slash & (acc["open"] | t.startswith("//"))) | opens | (markup & acc["open"]) | (hash_ & t.startswith("#")) | (shell & t.startswith("#") & ~t.startswith("#!"))
        )
        still = F.when(blank | ~(slash | markup), acc["open"]).when(opens, ~closes | (markup & acc["open"])).when(acc["open"], ~closes).otherwise(False)
        return F.struct(
            still.alias("open"), (acc["code"] + (~blank & ~comment).cast("bigint")).alias("code"),
            (acc["comment"] + comment.cast("bigint")).alias("comment"), (acc["blank"] + blank.cast("bigint")).alias("blank"),
        ).cast(kind)

    return F.aggregate(F.transform("lines", X.trimmed), zero, step)


def line_classes(files: DataFrame) -> DataFrame:
    """(path, language, code, comment, blank)."""
    return files.select("path", "language", _classes().alias("c")).select("path", "language", "c.code", "c.comment", "c.blank")


def file_complexity(files: DataFrame) -> DataFrame:
    """(path, complexity): control words and deep lines for each hundred lines."""

    def of(line):
        words = X.bound(X.trimmed(line), lambda t: sum((t.contains(w).cast("double") for w in C.COMPLEXITY_WORDS), F.lit(0.0)))
        indent = F.length(line) - F.length(F.ltrim(line, F.lit(" \t")))
        return words + F.when(indent > 16, 0.5).otherwise(0.0)

    total = F.aggregate(F.transform("lines", of), F.lit(0.0), lambda a, x: a + x)
    return files.select("path", (total / F.col("line_count") * 100).alias("complexity"))


def complexity_score(files: DataFrame) -> DataFrame:
    """100 less five times the mean complexity, within 0 to 100; 100 without files."""
    mean = F.avg("complexity")
    return file_complexity(files).agg(F.coalesce(F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - mean * 5)), F.lit(100.0)).alias("complexity_score"))


def duplication_score(files: DataFrame) -> DataFrame:
    """The share of distinct lines among trimmed lines of ten bytes or more, in percent; 100 without any."""
    lines = files.select(F.explode(F.transform("lines", X.trimmed)).alias("t")).where(F.octet_length("t") >= 10)
    per = lines.groupBy("t").agg(F.count("*").alias("n"))
    return per.agg(F.coalesce((1 - F.sum(F.col("n") - 1) / F.sum("n")) * 100, F.lit(100.0)).alias("duplication_score"))


def languages(files: DataFrame) -> DataFrame:
    return files.groupBy("language").agg(F.count("*").alias("files"), F.sum("line_count").cast("long").alias("lines"))


def largest_files(files: DataFrame, n: int = 10) -> DataFrame:
    """The longest files; among equals the later path."""
    return files.select("path", "line_count", "size").orderBy(F.desc("line_count"), F.desc("path")).limit(n)


def totals(files: DataFrame) -> DataFrame:
    """One row: files, lines, classes and the mean size."""
    c = files.select("size", "line_count", _classes().alias("c"))
    return c.agg(
        F.count("*").alias("total_files"), F.coalesce(F.sum("line_count"), F.lit(0)).cast("long").alias("total_lines"),
        *[F.coalesce(F.sum(f"c.{k}"), F.lit(0)).cast("long").alias(f"{k}_lines") for k in ("code", "comment", "blank")],
        F.coalesce(F.avg("size"), F.lit(0.0)).alias("average_file_size"),
    )


def function_metrics(functions: DataFrame) -> DataFrame:
    """One row over (start_line, end_line, is_exported, complexity); a function without an end has one line."""
    lines = F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(1))
    return functions.agg(
        F.count("*").alias("total_functions"), F.coalesce(F.avg(lines), F.lit(0.0)).alias("average_function_size"), F.coalesce(F.max(lines), F.lit(0)).alias("largest_function"),
        F.count_if("is_exported").alias("exported_functions"), F.coalesce(F.avg("complexity"), F.lit(0.0)).alias("average_complexity"),
    )


def summary(files: DataFrame, functions: DataFrame) -> DataFrame:
    """One row with everything: totals, scores, language map, largest files, function figures.

    Every part is one row, so the parts are put side by side by broadcasts.
    """
    by_language = F.map_from_entries(F.array_sort(F.collect_list(F.struct("language", "files"))))
    parts = [
        complexity_score(files), duplication_score(files), languages(files).agg(by_language.alias("language_breakdown")),
        largest_files(files).agg(F.array_sort(F.collect_list(F.struct("path", "line_count", "size")), lambda a, b: F.when(a["line_count"] != b["line_count"], b["line_count"] - a["line_count"]).when(a["path"] > b["path"], -1).otherwise(1)).alias("largest_files")),
        function_metrics(functions).select(F.struct("*").alias("functions")),
    ]
    out = totals(files)
    for p in parts:
        out = out.crossJoin(F.broadcast(p))
    return out
