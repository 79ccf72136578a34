"""Line expressions with the semantics of linear-time regular expressions, for the JVM.

The catalogue's expressions mean: `.` stops at a line feed only, `\\s` is space,
tab, line feed, form feed and carriage return, `\\b` sees ASCII word characters,
and `(?i)` folds by Unicode. Java's defaults differ in all four.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPACE = r"\t\n\f\r "
# `\w` is ASCII whatever the flags; as a class with ranges it would under `(?i)` also take what folds to ASCII, and is several times slower
_EDGE = r"(?:(?<!\w)(?=\w)|(?<=\w)(?!\w))"


def to_java(pattern: str) -> str:
    """The same expression for Java."""
    flags = "(?d)"
    if pattern.startswith("(?i)"):
        flags, pattern = "(?diu)", pattern[4:]
    out, inside, i = [], False, 0
    while i < len(pattern):
        c = pattern[i]
        two = pattern[i : i + 2]
        if c == "\\":
            out.append((_SPACE if inside else f"[{_SPACE}]") if two == r"\s" else _EDGE if two == r"\b" and not inside else two)
            i += 2
            continue
        if inside:
            inside = c != "]"
        elif c == "[":
            inside = True
        elif c == "{" and not pattern[i + 1 : i + 2].isdigit():
            c = r"\{"
        out.append(c)
        i += 1
    return flags + "".join(out)


def fixed(pattern: str) -> tuple[str, ...]:
    """The runs of characters that every match has, lower-cased; none where there are alternatives outside groups.

    What is in groups or classes or may be repeated is left out, so these are
    not all, but a folded line without one of them does not match.
    """
    runs, depth = [""], 0
    for m in re.finditer(r"(\\.|\[\^?[^\]]*\]|.)([*+?]|\{[0-9,]+\})?", pattern.removeprefix("(?i)"), re.S):
        token, times = m.groups()
        depth += (token == "(") - (token == ")")
        if token == "|" and not depth:
            return ()
        plain = token[1:] if token[0] == "\\" and not token[1].isalnum() else token if len(token) == 1 and token not in "()|.^$\\" else ""
        if depth or not plain or times not in (None, "+"):
            runs.append("")
            continue
        runs[-1] += plain.lower()
        if times:
            runs.append("")
    return tuple(dict.fromkeys(r for r in runs if r))


def matches(text: Column, pattern: str) -> Column:
    """Whether the expression matches anywhere."""
    return F.regexp_like(text, F.lit(to_java(pattern)))


def found(text: Column, pattern: str, group: int = 0) -> Column:
    """The first match or a group of it; empty where there is none."""
    return F.regexp_extract(text, to_java(pattern), group)


def start(text: Column, pattern: str) -> Column:
    """How many bytes come before the first match."""
    java = to_java(pattern)
    flags, rest = java[: java.index(")") + 1], java[java.index(")") + 1 :]
    return F.octet_length(F.regexp_extract(text, f"^((?s:.*?))(?:{flags}{rest})", 1))


def folded(text: Column) -> Column:
    """Lower case as far as `(?i)` sees it, for literals that a match must have."""
    return F.replace(F.replace(F.lower(text), F.lit("\u017f"), F.lit("s")), F.lit("\u212a"), F.lit("k"))


def has_all(text: Column, literals) -> Column:
    """Whether the folded text has all of the literals."""
    out = F.lit(True)
    for x in literals:
        out = out & text.contains(x)
    return out


def has_any(text: Column, literals) -> Column:
    """Whether the folded text has one of the literals."""
    out = F.lit(False)
    for x in literals:
        out = out | text.contains(x)
    return out
