"""From files to findings: rules, suppression, fingerprints and what is known of each rule.

A file is one row with its lines as an array. All rules see it in one pass: lines
that hold none of the literals a match needs are dropped inside the array, so only
candidate lines become rows, next to the file's vulnerable dependencies; each is
then tried against the expressions, which are literals in the plan and compiled
once a task. What a file suppresses goes along with its rows. No join on patterns
or paths, no second read; the one shuffle is by path and fingerprint, for the
numbering of equal findings of a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintel.functions import regex as R
from lintel.functions import text as X
from lintel.plans import catalog as C

DIRECTIVE = "lintel"


def candidate_lines(files: DataFrame, literals, fold: bool = True) -> DataFrame:
    """(path, language, line_no, line, around) of lines with one of the literals.

    `around` has the lines from two before to two after, so that a row never
    carries its whole file.
    """
    text = R.folded if fold else (lambda x: x)
    # the folded line is bound to a variable, or each literal would fold it again
    good = lambda i: F.exists(F.array(text(F.element_at("lines", i))), lambda x: R.has_any(x, literals))
    at = F.filter(F.sequence(F.lit(1), F.size("lines")), good)
    rows = F.transform(at, lambda i: F.struct(i.alias("line_no"), F.element_at("lines", i).alias("line"), around("lines", i).alias("around")))
    return files.select("path", "language", F.explode(rows).alias("c")).select("path", "language", "c.line_no", "c.line", "c.around")


def around(lines, line_no: Column) -> Column:
    """A line's neighbourhood of up to five lines."""
    first = F.greatest(line_no - 2, F.lit(1))
    return F.slice(lines, first, line_no + 2 - first + 1)


def previous() -> Column:
    """The line before, null for a file's first."""
    n = F.col("line_no")
    return F.when(n > 1, F.get("around", F.least(n, F.lit(3)) - 2))


def all_lines(files: DataFrame) -> DataFrame:
    """(path, language, line_no, line)."""
    return files.select("path", "language", F.posexplode("lines").alias("at", "line")).select("path", "language", (F.col("at") + 1).alias("line_no"), "line")


def _applies(languages) -> Column:
    return F.col("language").isin(list(languages)) if languages else F.lit(True)


def _hits(rows: DataFrame, tries: list[tuple[Column, str]]) -> DataFrame:
    """Rows with `pattern`, the number of each expression that matches: (condition, expression).

    Conditions may use `folded`, the line as literals see it; an expression is
    run only where its condition holds.
    """
    line = F.col("line")
    if "folded" not in rows.columns:
        rows = rows.withColumn("folded", R.folded(line))
    # no expression of a rule matches nothing, so one search tells whether it matches and what; None stands for a row as it is
    text = lambda p: F.nullif(R.found(line, p), F.lit("")) if p else F.lit("")
    hits = F.array(*[F.when(cond, F.struct(F.lit(k).alias("pattern"), text(p).alias("text"))) for k, (cond, p) in enumerate(tries)])
    # a projection of its own: below a lambda the expressions would not be compiled
    rows = rows.withColumn("hits", hits)
    rows = rows.withColumn("hit", F.explode(F.filter("hits", lambda h: h["text"].isNotNull()))).drop("hits")
    rows = rows.withColumns({"pattern": F.col("hit.pattern"), "match_text": F.col("hit.text")})
    first = F.lit(0)
    for k, (_, p) in enumerate(tries):
        first = F.when(F.col("pattern") == k, R.start(line, p)).otherwise(first) if p else first
    rows = rows.withColumn("match_start", first)
    return rows.withColumn("match_end", F.col("match_start") + F.octet_length("match_text")).drop("hit")


def _by_pattern(values: list) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.col("pattern") + 1)


def _needed(pattern: str, literals: tuple) -> tuple:
    """What stands for an expression when lines are looked for: one long run that it always has, or any of its literals.

    Where one of these is so short that prose is full of it, a sign that each match has.
    """
    runs = R.fixed(pattern)
    signs = [r for r in runs if not any(c.isalnum() for c in r)]
    long = max(runs, key=len, default="")
    if len(long) > 3:
        return (long,)
    return (max(signs, key=lambda r: (len(r), r != "=")),) if signs and min(map(len, literals)) < 3 else literals


def _tries(patterns, languages, secrets: bool) -> list[tuple]:
    """(rule, condition, expression, literals, languages, whether the description ends with the line)."""
    out = [(r, F.lit(True) if not r.exclude else ~R.matches(F.col("line"), r.exclude), r.regex, _needed(r.regex, r.need), r.languages, False) for r in patterns]
    for rule in languages:
        out += [(rule, F.lit(True), p, _needed(p, rule.needed(p)), langs, True) for langs, p in rule.patterns()]
    if secrets:
        out.append((C.SECRETS, F.lit(True), C.SECRETS_REGEX, ("basic",), (), False))
    return out


def _wanted(tries: list[tuple], content: Column) -> Column:
    """The literals that expressions for a file's language need and that its content, folded, has."""
    by_language: dict[tuple, set] = {}
    for _, _, _, need, langs, _ in tries:
        by_language.setdefault(tuple(langs), set()).update(need)
    none = F.array().cast("array<string>")
    every = F.concat(*[F.when(_applies(langs), F.array(*[F.lit(x) for x in sorted(need)])).otherwise(none) for langs, need in by_language.items()])
    return F.filter(every, lambda x: content.contains(x))


def findings_of(files: DataFrame, patterns=None, languages=None, secrets: bool = True, dependencies: bool = True, prefix: str = DIRECTIVE) -> DataFrame:
    """Findings of the given rules (None: all of a kind), with `off`, the rules that their file turns off."""
    from lintel.operators.dependency import VULNERABLE, vulnerable

    tries = _tries(C.PATTERN_RULES if patterns is None else patterns, C.LANGUAGE_RULES if languages is None else languages, secrets)
    bad = F.array().cast(VULNERABLE)
    none = F.lit(None).cast(VULNERABLE.removeprefix("array<")[:-1])
    at = F.array().cast("array<int>")
    # a file is folded once and its folded lines go along with the plain ones: no line's folding looks beyond its end
    files = files.select("path", "language", "content", "lines", off_of(prefix).alias("off"), R.folded(F.col("content")).alias("low"))
    if tries:
        # a line can only have literals that its file has
        files = files.withColumn("some", _wanted(tries, F.col("low")))
        low = F.when(F.size("some") > 0, F.split("low", "\n", -1)).otherwise(F.array().cast("array<string>"))
        files = files.withColumn("low", low)
        good = lambda i: X.bound(F.element_at("low", i), lambda line: F.exists("some", lambda x: line.contains(x)))
        at = F.filter(F.when(F.size("low") > 0, F.sequence(F.lit(1), F.size("low"))).otherwise(at), good)
    row = lambda i, low, dep: F.struct(i.alias("line_no"), F.element_at("lines", i).alias("line"), low.alias("folded"), around("lines", i).alias("around"), dep.alias("dep"))
    rows = F.transform(at, lambda i: row(i, F.element_at("low", i), none)) if tries else None
    deps = F.transform(vulnerable() if dependencies else bad, lambda d: row(d["line"], F.lit(""), d))
    rows = files.select("path", "language", "off", F.explode(deps if rows is None else F.concat(rows, deps)).alias("c")).select("path", "language", "off", "c.*")
    line, dep, folded = F.col("line"), F.col("dep"), F.col("folded")
    every = [(dep.isNull() & _applies(langs) & R.has_any(folded, need) & R.has_all(folded, [x for x in R.fixed(p) if (x,) != need]) & cond, p) for _, cond, p, need, langs, _ in tries]
    hits = _hits(rows, [*every, (dep.isNotNull(), None)])
    is_dep = F.col("pattern") == len(tries)
    col = lambda name, other: F.when(is_dep, other).otherwise(_by_pattern([getattr(t[0], name) for t in tries])) if tries else other
    with_line = F.when(_by_pattern([t[5] for t in tries]), X.trimmed(line)).otherwise("") if tries else F.lit("")
    name, version = F.col("dep.name"), F.col("dep.version")
    said = F.concat(name, F.lit(" version "), version, F.lit(" is vulnerable to "), F.col("dep.cve"), F.lit(": "), F.col("dep.description"))
    return hits.select(
        "path", "language", "line_no", "line", previous().alias("previous"), "pattern", col("id", F.lit("dependency")).alias("rule_id"), col("title", F.concat(F.lit("Vulnerable dependency: "), name)).alias("title"), col("severity", F.col("dep.severity")).alias("severity"),
        col("category", F.lit("dependency")).alias("category"), col("cwe", F.lit("CWE-1104")).alias("cwe"), col("confidence", F.lit(0.9)).alias("confidence"),
        F.when(is_dep, said).otherwise(F.concat(_by_pattern([t[0].description for t in tries]), with_line) if tries else said).alias("description"),
        "match_start", F.when(is_dep, 0).otherwise(F.col("match_end")).alias("match_end"), F.when(is_dep, F.concat_ws(" ", name, version)).otherwise(F.col("match_text")).alias("match_text"),
        X.snippet(F.col("around"), F.col("line_no")).alias("code_snippet"), "off",
    )


def pattern_findings(files: DataFrame) -> DataFrame:
    """Findings of the fourteen line rules."""
    return findings_of(files, languages=(), secrets=False, dependencies=False)


def language_findings(files: DataFrame, rule: C.LanguageRule) -> DataFrame:
    """Findings of a rule that goes by language, one for each expression that matches."""
    return findings_of(files, patterns=(), languages=(rule,), secrets=False, dependencies=False)


def secret_findings(files: DataFrame) -> DataFrame:
    """Basic credentials in a header or a string; an own design within the known edges of the rule."""
    return findings_of(files, patterns=(), languages=(), dependencies=False)


def raw_findings(files: DataFrame, prefix: str = DIRECTIVE) -> DataFrame:
    """All rules' findings, in one pass over the files."""
    return findings_of(files, prefix=prefix)


def directive(line: Column, name: str) -> Column:
    """The rules a suppression names: lower-cased tokens up to a "--", [] if it is none.

    Only the first occurrence counts, after a comment sign, followed by a blank
    or the line's end.
    """
    low = F.lower(line)
    at = F.instr(low, name)
    before = F.substr(low, F.lit(1), F.greatest(at - 1, F.lit(0)))
    after = F.substr(low, at + F.lit(len(name)))
    good = (at > 0) & R.has_any(before, ["//", "#", "/*", "<!--"]) & ((after == "") | after.startswith(" ") | after.startswith("\t"))
    value = F.substring_index(F.regexp_extract(after, "^([^\r\n]*)", 1), "--", 1)
    return F.when(good, F.filter(F.split(value, "[, \t]+"), lambda x: x != "")).otherwise(F.array().cast("array<string>"))


def off_of(prefix: str = DIRECTIVE) -> Column:
    """The rules that a file turns off as a whole, [] for none."""
    name = f"{prefix}:ignore-file"
    off = F.array_distinct(F.flatten(F.transform("lines", lambda x: directive(x, name))))
    return F.when(F.lower("content").contains(name), off).otherwise(F.array().cast("array<string>"))


def file_suppressions(files: DataFrame, prefix: str = DIRECTIVE) -> DataFrame:
    """(path, off): the rules that a file turns off as a whole; files without a directive are left out."""
    return files.select("path", off_of(prefix).alias("off")).where(F.size("off") > 0)


def _turns_off(rules: Column) -> Column:
    return F.array_contains(rules, "all") | F.array_contains(rules, F.lower("rule_id"))


def suppressed(findings: DataFrame, prefix: str = DIRECTIVE) -> DataFrame:
    """Findings without those turned off for their file, on their line or on the line before."""
    here = _turns_off(directive(F.col("line"), f"{prefix}:ignore"))
    above = _turns_off(directive(F.coalesce("previous", F.lit("")), f"{prefix}:ignore-next-line"))
    return findings.where(~here & ~above & ~_turns_off(F.col("off"))).drop("off")


def selected(findings: DataFrame, wanted=()) -> DataFrame:
    """Findings of rules or categories by name, trimmed and in any case; all if none is named."""
    names = [w.strip().lower() for w in wanted]
    return findings.where(F.lower("rule_id").isin(names) | F.lower("category").isin(names)) if names else findings


def fingerprints(findings: DataFrame) -> DataFrame:
    """With `fingerprint`: rule, path and collapsed line, and for repeats in a file their number."""
    sep = F.char(F.lit(0))
    base = F.substring(F.sha2(F.concat(F.lower("rule_id"), sep, X.clean_path(F.col("path")), sep, X.collapsed(F.col("line"))), 256), 1, 32)
    window = Window.partitionBy("path", "base").orderBy("line_no", "rule_id", F.coalesce("match_start", F.lit(0)), "pattern")
    again = F.row_number().over(window) - 1
    out = findings.withColumn("base", base).withColumn("again", again)
    repeat = F.substring(F.sha2(F.concat("base", sep, F.col("again").cast("string")), 256), 1, 32)
    return out.withColumn("fingerprint", F.when(F.col("again") > 0, repeat).otherwise(F.col("base"))).drop("base", "again")


def mapped_category(category: Column) -> Column:
    names = F.create_map(*[F.lit(x) for kv in C.CATEGORIES.items() for x in kv])
    return F.coalesce(F.try_element_at(names, category), F.lit("other"))


def routed(cwe: Column, others: Column) -> Column:
    """struct(cwe, owasp, urls) of references, each by its shape and once."""
    every = F.filter(F.transform(F.concat(F.array(cwe), others), X.trimmed), lambda x: x != "")
    is_cwe = lambda x: F.regexp_like(x, F.lit("^CWE-[0-9]+$"))
    is_owasp = lambda x: ~is_cwe(x) & x.startswith("http") & x.contains("owasp.org")
    return F.struct(
        F.array_distinct(F.filter(every, is_cwe)).alias("cwe"),
        F.array_distinct(F.filter(every, is_owasp)).alias("owasp"),
        F.array_distinct(F.filter(every, lambda x: ~is_cwe(x) & ~is_owasp(x))).alias("urls"),
    )


def tls_rewrite(match: Column) -> Column:
    """The switch turned on again by the first expression that fits, else null."""
    out = F.lit(None).cast("string")
    for pattern, value in reversed(C.TLS_SWITCHES):
        out = F.when(R.matches(match, pattern), F.regexp_replace(match, R.to_java(pattern), f"$1{value}")).otherwise(out)
    return out


def enriched(findings: DataFrame) -> DataFrame:
    """With score, vector, category, references and fix; the rule table is a few rows and is joined in place."""
    spark = findings.sparkSession
    rows = [(k, float(s), v, *C.FIXES[k], [x for r in C.rule_table() if r[0] == k for x in r[6]]) for k, (s, v) in C.CVSS.items()]
    dim = spark.createDataFrame(rows, "rule_id string, cvss_score double, cvss_vector string, summary string, example string, links array<string>")
    out = findings.join(F.broadcast(dim), "rule_id", "left")
    flip = F.when(F.col("rule_id") == "RULE-TLS-001", tls_rewrite(F.col("match_text")))
    fix = F.when(
        F.col("summary").isNotNull(),
        F.struct(F.col("summary").alias("summary"), F.when(flip.isNotNull(), "safe_replace").otherwise("guidance").alias("kind"), F.col("match_text").alias("before"), F.coalesce(flip, "example").alias("after"), flip.alias("replacement")),
    )
    spanned = F.col("match_end") > 0
    return out.select(
        "fingerprint", "rule_id", "title", "severity", mapped_category(F.col("category")).alias("category"), F.col("path").alias("file_path"), F.col("line_no").alias("line_start"), F.lit(0).alias("line_end"),
        F.when(spanned, F.col("match_start") + 1).alias("column_start"), F.when(spanned, F.col("match_end") + 1).alias("column_end"), "code_snippet", "description", "confidence",
        F.coalesce("cvss_score", F.lit(0.0)).alias("cvss_score"), F.coalesce("cvss_vector", F.lit("")).alias("cvss_vector"), routed(F.col("cwe"), F.coalesce("links", F.array().cast("array<string>"))).alias("refs"), fix.alias("fix"),
    )


def scan(files: DataFrame, wanted=(), prefix: str = DIRECTIVE) -> DataFrame:
    """The findings of parsed files, complete."""
    return enriched(fingerprints(selected(suppressed(raw_findings(files, prefix), prefix), wanted)))


def security_markers(files: DataFrame) -> DataFrame:
    """(path, line_no, type, description, column, snippet) of security-sensitive calls."""
    names = list(C.MARKERS)
    rows = _hits(candidate_lines(files, ["(", "=", ":"], fold=False), [(F.lit(True), p) for p in C.MARKERS.values()])
    kind = _by_pattern(names)
    return rows.select("path", "line_no", kind.alias("type"), F.concat(F.lit("Potential "), F.replace(kind, F.lit("_"), F.lit(" ")), F.lit(" usage")).alias("description"), (F.col("match_start") + 1).alias("column"), X.trimmed(F.col("line")).alias("snippet"))
