"""Scalar functions on lines, paths, versions, colours and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lintel.plans import catalog

# Unicode's white space.
_SPACES = "\\t\\n\\u000b\\f\\r \\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"


def bound(value: Column, use) -> Column:
    """`use` of a value that is made once, however often `use` or a lambda in it asks for it."""
    return F.transform(F.array(value), use)[0]


def trimmed(text: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.regexp_replace(text, f"^[{_SPACES}]+|[{_SPACES}]+$", "")


def collapsed(text: Column) -> Column:
    """Words joined by one space."""
    return F.trim(F.regexp_replace(text, f"[{_SPACES}]+", " "))


def extension(path: Column) -> Column:
    """From the last dot of the last part, lower-cased; empty without one."""
    return F.lower(F.regexp_extract(path, r"(\.[^./]*)$", 1))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def language(path: Column) -> Column:
    """By extension, else by name, else null."""
    by_ext = F.create_map(*[F.lit(x) for kv in catalog.EXTENSIONS.items() for x in kv])
    by_name = F.create_map(*[F.lit(x) for kv in catalog.FILE_NAMES.items() for x in kv])
    return F.coalesce(F.try_element_at(by_ext, extension(path)), F.try_element_at(by_name, F.lower(base_name(path))))


def clean_path(path: Column) -> Column:
    """Without empty parts, "." and resolvable ".."; "." if nothing is left."""
    parts = F.filter(F.split(path, "/"), lambda x: (x != "") & (x != "."))
    rooted = path.startswith("/")
    step = lambda acc, x: F.when(
        (x == "..") & (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("..")) != ".."),
        F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))),
    ).when((x == "..") & rooted, acc).otherwise(F.concat(acc, F.array(x)))
    joined = F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")
    return F.when(rooted, F.concat(F.lit("/"), joined)).when(joined == "", F.lit(".")).otherwise(joined)


def snippet(around: Column, line: Column) -> Column:
    """A line's neighbourhood, from two lines before it, numbered, the line itself marked."""
    first = F.greatest(line - 2, F.lit(1))
    row = lambda x, i: F.format_string("%s%4d | %s\n", F.when(i + first == line, F.lit("> ")).otherwise(F.lit("  ")), i + first, x)
    return F.array_join(F.transform(around, row), "")


def version_parts(version: Column) -> Column:
    """Dotted numbers; what does not begin with digits counts as 0."""
    number = lambda x: F.coalesce(F.regexp_extract(x, r"^\s*([+-]?[0-9]+)", 1).try_cast("bigint"), F.lit(0).cast("bigint"))
    return F.transform(F.split(version, r"\."), number)


def compare_versions(a: Column, b: Column) -> Column:
    """-1, 0 or 1; missing parts count as 0."""
    x, y = version_parts(a), version_parts(b)
    n = F.greatest(F.size(x), F.size(y))
    zeros = lambda v: F.concat(v, F.array_repeat(F.lit(0).cast("bigint"), n - F.size(v)))
    return F.when(zeros(x) < zeros(y), -1).when(zeros(x) > zeros(y), 1).otherwise(0)


def in_range(version: Column, range_: Column) -> Column:
    """Whether a version is in `<v`, `<=v`, `>v`, `>=v`, or is the very string."""
    bound = F.regexp_replace(range_, "^[<>]=?", "")
    c = compare_versions(version, bound)
    by_sign = (
        F.when(range_.startswith("<="), c <= 0).when(range_.startswith("<"), c < 0).when(range_.startswith(">="), c >= 0).when(range_.startswith(">"), c > 0).otherwise(version == range_)
    )
    return F.when((version == "") | (range_ == ""), F.lit(False)).otherwise(by_sign)


def severity_weight(severity: Column) -> Column:
    out = F.lit(0)
    for name, w in catalog.WEIGHT.items():
        out = F.when(severity == name, w).otherwise(out)
    return out


def cvss_band(score: Column) -> Column:
    return F.when(score >= 9, "Critical").when(score >= 7, "High").when(score >= 4, "Medium").when(score > 0, "Low").otherwise("None")


def cvss_label(score: Column) -> Column:
    return F.when(score <= 0, "—").otherwise(F.format_string("%.1f (%s)", score, cvss_band(score)))


def bar_percent(count: Column, total: Column) -> Column:
    return F.when(total <= 0, F.lit(0).cast("bigint")).otherwise(F.floor(count * 100 / total).cast("bigint"))


def dash(text: Column) -> Column:
    return F.when(trimmed(text) == "", "—").otherwise(text)


def title_case(text: Column) -> Column:
    """Underscores as spaces; the first letter of each word raised, the others as they are."""
    words = F.filter(F.split(F.replace(text, F.lit("_"), F.lit(" ")), " "), lambda w: w != "")
    return F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substr(w, F.lit(2)))), " ")


def darkened(colour: Column, factor: float) -> Column:
    """A #rrggbb colour with each channel times a factor; others unchanged."""
    channel = lambda at: F.lpad(F.lower(F.hex((F.conv(F.substring(colour, at, 2), 16, 10).cast("int") * factor).cast("int").cast("bigint"))), 2, "0")
    return F.when(F.regexp_like(colour, F.lit("^#[0-9a-fA-F]{6}$")), F.concat(F.lit("#"), channel(2), channel(4), channel(6))).otherwise(colour)


def data_uri(content: Column, mime: Column) -> Column:
    """Bytes as a data address, null where the type is no image."""
    return F.when(F.lower(mime).startswith("image/"), F.concat(F.lit("data:"), F.lower(mime), F.lit(";base64,"), F.replace(F.base64(content), F.lit("\r\n"), F.lit(""))))
