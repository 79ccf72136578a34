"""Roll-ups, report model, sinks and the application of fixes."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import escape

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintel.functions import text as X
from lintel.plans import catalog as C
from lintel.sources.document_sink import write_document


def histogram(findings: DataFrame) -> DataFrame:
    """One row: total and counts by severity."""
    return findings.agg(F.count("*").alias("total"), *[F.count_if(F.col("severity") == s).alias(s) for s in C.SEVERITIES])


def gate(findings: DataFrame, fail_on_critical: bool = True) -> DataFrame:
    """One row: whether a scan fails; only critical findings make it, and only if asked to."""
    return findings.agg((F.lit(fail_on_critical) & (F.count_if(F.col("severity") == "critical") > 0)).alias("failed"))


def by_category(findings: DataFrame) -> DataFrame:
    return findings.groupBy("category").agg(F.count("*").alias("n"))


def by_rule(findings: DataFrame) -> DataFrame:
    return findings.groupBy("rule_id").agg(F.count("*").alias("n"), F.avg("confidence").alias("average_confidence"))


def roadmap(findings: DataFrame) -> DataFrame:
    """(priority, severity, count, sla) of severities that occur, worst first; five rows at most are ordered."""
    sla = F.create_map(*[F.lit(x) for kv in C.SLA.items() for x in kv])
    per = findings.groupBy("severity").agg(F.count("*").alias("count")).where(F.col("severity").isin(C.SEVERITIES))
    return per.select(F.row_number().over(Window.orderBy(F.desc(X.severity_weight(F.col("severity"))))).alias("priority"), "severity", "count", F.element_at(sla, F.col("severity")).alias("sla"))


def ordered(findings: DataFrame) -> DataFrame:
    """Worst first, then path and line, with an anchor; a range-partitioned sort, numbered by none."""
    anchor = F.concat(F.lit("f-"), F.substring("fingerprint", 1, 12))
    return findings.withColumn("anchor", anchor).withColumn("weight", X.severity_weight(F.col("severity"))).orderBy(F.desc("weight"), "file_path", "line_start", "rule_id", "fingerprint")


def fixed_line(line: Column, fixes: Column) -> Column:
    """A line with (start, end, before, replacement) spans of bytes rewritten from right to left.

    A span whose bytes are no longer those that were found is left alone.
    """
    descending = F.array_sort(fixes, lambda a, b: F.when(a["start"] > b["start"], -1).when(a["start"] < b["start"], 1).otherwise(0))
    raw = lambda s: F.encode(s, "UTF-8")

    def step(acc, f):
        size = F.octet_length(acc)
        same = F.substr(acc, f["start"], f["end"] - f["start"]) == raw(f["before"])
        head, tail = F.substr(acc, F.lit(1), f["start"] - 1), F.substr(acc, f["end"], F.greatest(size - f["end"] + 1, F.lit(0)))
        return F.when(same, F.concat(head, raw(f["replacement"]), tail)).otherwise(acc)

    return F.decode(F.aggregate(descending, raw(line), step), "UTF-8")


def fixed_files(files: DataFrame, findings: DataFrame) -> DataFrame:
    """(path, new_content, changed_lines) of files with safe replacements. Nothing is written."""
    safe = findings.where((F.col("fix.kind") == "safe_replace") & F.col("column_start").isNotNull())
    spans = F.struct(F.col("line_start").alias("line"), F.col("column_start").alias("start"), F.col("column_end").alias("end"), F.col("fix.before").alias("before"), F.col("fix.replacement").alias("replacement"))
    per = safe.groupBy(F.col("file_path").alias("path")).agg(F.collect_set(spans).alias("spans"))
    both = files.join(per, "path")
    new = F.transform("lines", lambda x, i: F.when(F.exists("spans", lambda s: s["line"] == i + 1), fixed_line(x, F.filter("spans", lambda s: s["line"] == i + 1))).otherwise(x))
    out = both.withColumn("new", new)
    changed = F.size(F.filter(F.zip_with("lines", "new", lambda a, b: a != b), lambda x: x))
    return out.select("path", F.array_join("new", "\n").alias("new_content"), changed.alias("changed_lines"))


def sarif_level(severity: Column) -> Column:
    return F.when(severity.isin("critical", "high"), "error").when(severity.isin("low", "info"), "note").otherwise("warning")


def _sarif(key: str) -> Column:
    """A finding as a SARIF result; fixes only where a replacement and its span are known."""
    first = F.greatest(F.col("line_start"), F.lit(1))
    region = F.struct(first.alias("startLine"), F.when(F.col("line_end") >= first, F.col("line_end")).alias("endLine"))
    uri = F.struct(F.col("file_path").alias("uri"))
    deleted = F.struct(first.alias("startLine"), F.col("column_start").alias("startColumn"), F.col("column_end").alias("endColumn"))
    change = F.struct(uri.alias("artifactLocation"), F.array(F.struct(deleted.alias("deletedRegion"), F.struct(F.col("fix.replacement").alias("text")).alias("insertedContent"))).alias("replacements"))
    fixes = F.array(F.struct(F.struct(F.col("fix.summary").alias("text")).alias("description"), F.array(change).alias("artifactChanges")))
    return F.struct(
        F.col("rule_id").alias("ruleId"), sarif_level(F.col("severity")).alias("level"), F.create_map(F.lit(key), F.col("fingerprint")).alias("partialFingerprints"), F.struct(F.col("description").alias("text")).alias("message"),
        F.array(F.struct(F.struct(uri.alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))).alias("locations"),
        F.when((F.col("fix.kind") == "safe_replace") & F.col("column_start").isNotNull(), fixes).alias("fixes"),
    )


def sarif_results(findings: DataFrame, key: str = "lintel/v1") -> DataFrame:
    """One SARIF result a row, as JSON."""
    return findings.select("fingerprint", F.to_json(_sarif(key)).alias("result"))


_SCHEMA = "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/sarif-schema-2.1.0.json"


def scan_order(findings: DataFrame) -> DataFrame:
    """A scan's findings in a fixed order: path, line, rule, column, fingerprint."""
    return findings.orderBy("file_path", "line_start", "rule_id", F.coalesce("column_start", F.lit(0)), "fingerprint")


def sarif_parts(findings: DataFrame, name: str = "Lintel", version: str = "0", most: int | None = None) -> Iterator[str]:
    """A SARIF 2.1.0 document piece by piece; the driver holds one partition at a time.

    With `most` only so many results are written, in the order of the scan, and the
    run's property `truncated` tells whether some are left out.
    """
    results = sarif_results(scan_order(findings) if most is None else scan_order(findings).limit(most + 1))
    driver = {"name": name, "version": version}
    yield f'{{\n  "$schema": "{_SCHEMA}",\n  "version": "2.1.0",\n  "runs": [\n    {{"tool": {json.dumps({"driver": driver})}, "results": ['
    n = 0
    for row in results.toLocalIterator():
        if n == most:
            n += 1
            break
        yield ("," if n else "") + "\n" + json.dumps(json.loads(row.result))
        n += 1
    yield f'], "properties": {{"truncated": {json.dumps(most is not None and n > most)}}}}}\n  ]\n}}\n'


def to_sarif(findings: DataFrame, name: str = "Lintel", version: str = "0", most: int | None = None) -> str:
    """The document as one string, for scans of a repository; larger ones are written by `sarif_parts`."""
    return json.dumps(json.loads("".join(sarif_parts(findings, name, version, most))), indent=2)


def _rows(findings: DataFrame, section: int, value: Column, most: int | None = None) -> DataFrame:
    """Rows of a document's section in the order of the scan, the first `most` of them."""
    some = findings if most is None else scan_order(findings).limit(most)
    order = [F.col("file_path"), F.col("line_start"), F.col("rule_id"), F.coalesce("column_start", F.lit(0)), F.col("fingerprint")]
    return some.select(F.lit(section).alias("section"), value.alias("value"), *[c.alias(n) for c, n in zip(order, _ORDER)])


_ORDER = ["by_path", "by_line", "by_rule", "by_column", "by_print"]


def write_sarif(findings: DataFrame, path: str, name: str = "Lintel", version: str = "0", most: int | None = None) -> None:
    """A SARIF 2.1.0 document written by the executors, with the results of `sarif_parts`."""
    more = most is not None and findings.limit(most + 1).count() > most
    head = f'{{\n"$schema": "{_SCHEMA}",\n"version": "2.1.0",\n"runs": [{{"tool": {json.dumps({"driver": {"name": name, "version": version}})}, "results": [\n'
    tail = f'\n], "properties": {{"truncated": {json.dumps(more)}}}}}]\n}}\n'
    write_document(_rows(findings, 0, F.to_json(_sarif("lintel/v1")), most), path, [head, tail], _ORDER)


def write_json(findings: DataFrame, path: str, files_scanned: int = 0, lines_scanned: int = 0, metrics: dict | None = None, most: int | None = None, delta: tuple | None = None) -> None:
    """The JSON document of `document`, written by the executors; `delta` is (new, resolved, one row with `unchanged`)."""
    total = histogram(findings).first().asDict()
    value = F.to_json(F.struct(*_json_columns()))
    top = {"files_scanned": files_scanned, "lines_scanned": lines_scanned, "summary": total, "total_findings": total["total"], "truncated": most is not None and total["total"] > most, "metrics": metrics or {}}
    texts = [json.dumps(top, default=str)[:-1] + ', "vulnerabilities": [\n', "\n]}\n"]
    rows = _rows(findings, 0, value, most)
    if delta is not None:
        new, resolved, same = delta
        one = F.to_json(F.array("fingerprint"))
        gone = resolved.select(F.lit(2).alias("section"), F.substring(one, F.lit(2), F.length(one) - 2).alias("value"), F.col("fingerprint").alias(_ORDER[0]))
        rows = rows.unionByName(_rows(new, 1, value, most)).unionByName(gone, allowMissingColumns=True)
        texts[1:] = [f'\n], "delta": {{"unchanged": {same.first()[0]}, "new": [\n', '\n], "resolved_fingerprints": [\n', "\n]}}\n"]
    write_document(rows, path, texts, _ORDER)


def json_rows(findings: DataFrame) -> DataFrame:
    """One JSON object a finding."""
    return findings.select("fingerprint", F.to_json(F.struct("rule_id", "title", "severity", "category", "file_path", "line_start", "cvss_score", "confidence", "fingerprint")).alias("json"))


def text_rows(findings: DataFrame) -> DataFrame:
    """One line of plain text a finding."""
    line = F.format_string("[%s] %s:%d %s (%s)", F.upper("severity"), F.col("file_path"), F.col("line_start"), F.col("title"), F.col("rule_id"))
    return findings.select("fingerprint", line.alias("line"))


def capped(findings: DataFrame, most: int = 200) -> DataFrame:
    """The first findings of a scan's order with their number, and in each row whether there are more.

    A top-k: no more than `most` + 1 rows are numbered.
    """
    first = scan_order(findings).limit(most + 1)
    order = Window.orderBy("file_path", "line_start", "rule_id", F.coalesce("column_start", F.lit(0)), "fingerprint")
    numbered = first.withColumn("index", F.row_number().over(order)).withColumn("truncated", F.count("*").over(Window.partitionBy()) > most)
    return numbered.where(F.col("index") <= most)


def _json_columns() -> list:
    return [
        *["rule_id", "fingerprint", "title", "description", "severity", "category", "file_path", "line_start", "line_end", "code_snippet", "confidence"], F.col("refs.cwe").alias("cwe"), F.col("refs.owasp").alias("owasp"),
        *["cvss_score", "cvss_vector", "fix", "column_start", "column_end"],
    ]


def json_fields(findings: DataFrame) -> DataFrame:
    """Findings with the names of the JSON document."""
    return findings.select(*_json_columns())


def document(findings: DataFrame, files_scanned: int = 0, lines_scanned: int = 0, metrics: dict | None = None, most: int | None = None, new: DataFrame | None = None, unchanged: int = 0, resolved: list[str] | None = None) -> dict:
    """A scan as one JSON document: summary, figures and findings, [] for none.

    With `most`, only so many findings are in it, in the order of the scan, and
    `truncated` says so; the summary counts all. `new` adds the comparison with a
    baseline, held to the same number.
    """
    total = histogram(findings).first().asDict()

    def some(df: DataFrame) -> list[dict]:
        rows = json_fields(scan_order(df)).select(F.to_json(F.struct("*")).alias("j"))
        return [json.loads(r.j) for r in (rows if most is None else rows.limit(most)).collect()]

    out = {"files_scanned": files_scanned, "lines_scanned": lines_scanned, "summary": total, "total_findings": total["total"], "truncated": most is not None and total["total"] > most, "metrics": metrics or {}, "vulnerabilities": some(findings)}
    if new is not None:
        out["delta"] = {"new": some(new), "unchanged": unchanged, "resolved_fingerprints": sorted(resolved or [])}
    return out


#: Colours of a report where a brand names none.
DEFAULT_COLOURS = ("#1f3a5f", "#c0392b")


@dataclass(frozen=True)
class Brand:
    """Who reports on what; colours that are no #rrggbb are replaced by the defaults."""

    company: str = ""
    assessor: str = ""
    project: str = ""
    client: str = ""
    primary: str = DEFAULT_COLOURS[0]
    accent: str = DEFAULT_COLOURS[1]
    logo: str = ""  # a data address; others are not shown, for a page has no remote parts

    def colours(self) -> tuple[str, str]:
        return tuple(c if re.fullmatch("#[0-9a-fA-F]{6}", c) else d for c, d in zip((self.primary, self.accent), DEFAULT_COLOURS))


def model(findings: DataFrame, most: int | None = 1000) -> dict:
    """Aggregates over all findings, and the worst `most` of them (None: all), numbered from 1, for the templates.

    That many rows come to the driver; `truncated` says whether there are more.
    """
    total = histogram(findings).first().asDict()
    rows = ordered(findings)
    rows = [r.asDict(recursive=True) | {"index": k + 1} for k, r in enumerate((rows if most is None else rows.limit(most)).collect())]
    return {
        "summary": total, "roadmap": [r.asDict() for r in roadmap(findings).orderBy("priority").collect()], "findings": rows, "truncated": most is not None and total["total"] > most,
        "by_category": {r.category: r.n for r in by_category(findings).collect()},
    }


def _label(score: float) -> str:
    """A score with its band, a dash for none."""
    band = "Critical" if score >= 9 else "High" if score >= 7 else "Medium" if score >= 4 else "Low"
    return f"{score:.1f} ({band})" if score > 0 else "—"


def _words(text: str) -> str:
    return " ".join(w[:1].upper() + w[1:] for w in text.replace("_", " ").split())


def _overview(report: dict, brand: Brand) -> str:
    """The summary in a sentence."""
    s = report["summary"]
    worst = next((k for k in C.SEVERITIES if s[k]), None)
    what = f"{s['total']} finding{'s' if s['total'] != 1 else ''}"
    if worst is None:
        return f"The scan{' of ' + brand.project if brand.project else ''} found nothing to report."
    return f"The scan{' of ' + brand.project if brand.project else ''} has {what}, of which {s[worst]} {'is' if s[worst] == 1 else 'are'} {worst}. The roadmap below orders the work by severity."


def _facts(f: dict) -> list[tuple[str, str]]:
    """What is known of a finding, as names and values."""
    refs = f.get("refs") or {}
    return [
        ("Location", f"{f['file_path']}:{f['line_start']}"), ("Rule", f["rule_id"]), ("Category", _words(f["category"])), ("CVSS", _label(f["cvss_score"])), ("Vector", f.get("cvss_vector") or "—"),
        ("CWE", ", ".join(refs.get("cwe") or []) or "—"), ("Confidence", f"{round(100 * f['confidence'])} %"),
    ]


def _links(f: dict) -> list[str]:
    refs = f.get("refs") or {}
    return [*(refs.get("owasp") or []), *(refs.get("urls") or [])]


def _fence(text: str) -> str:
    """More backticks than the text has in a row."""
    return "`" * max(3, 1 + max((len(m) for m in re.findall("`+", text)), default=0))


def to_markdown(report: dict, title: str = "Security Assessment Report", brand: Brand = Brand()) -> str:
    """A report as Markdown: summary, roadmap, and each finding with its facts, evidence, suggested fix and references."""
    s = report["summary"]
    who = [f"{k}: {v}" for k, v in (("Client", brand.client), ("Project", brand.project), ("Assessor", brand.assessor), ("Company", brand.company)) if v]
    out = [f"# {title}", "", *[f"- {w}" for w in who], *([""] if who else []), "## Executive Summary", "", _overview(report, brand), "", "| Severity | Count |", "| --- | --- |", *[f"| {_words(k)} | {s[k]} |" for k in C.SEVERITIES], f"| Total | {s['total']} |", ""]
    if not report["findings"]:
        return "\n".join([*out, "No findings.", ""])
    out += ["## Remediation Roadmap", "", "| Priority | Severity | Count | When |", "| --- | --- | --- | --- |", *[f"| {r['priority']} | {_words(r['severity'])} | {r['count']} | {r['sla']} |" for r in report["roadmap"]], "", "## Findings", ""]
    for f in report["findings"]:
        cell = lambda v: v.replace("|", "\\|")
        code = f["code_snippet"].rstrip("\n")
        out += [f"### {f['index']}. {f['title']} ({_words(f['severity'])})", "", "| | |", "| --- | --- |", *[f"| {k} | {cell(v)} |" for k, v in _facts(f)], "", f["description"], "", "**Evidence**", "", _fence(code), code, _fence(code), ""]
        fix = f.get("fix")
        if fix:
            after = fix["after"] or ""
            out += ["**Suggested Fix**", "", fix["summary"], "", _fence(after), after, _fence(after), ""]
        if _links(f):
            out += ["**References**", "", *[f"- {x}" for x in _links(f)], ""]
    if report["truncated"]:
        out += [f"Only the {len(report['findings'])} worst of {s['total']} findings are listed.", ""]
    return "\n".join(out)


def to_html(report: dict, title: str = "Security Assessment Report", brand: Brand = Brand()) -> str:
    """A report as one HTML page without scripts or remote parts; everything taken from findings is escaped."""
    s, e = report["summary"], escape
    primary, accent = brand.colours()
    style = f"body{{font-family:sans-serif;margin:2em auto;max-width:60em}}h1,h2{{color:{primary}}}h3{{border-left:4px solid {accent};padding-left:.5em}}table{{border-collapse:collapse}}td,th{{border:1px solid #ccc;padding:.2em .6em;text-align:left}}pre{{background:#f6f6f6;padding:.8em;overflow:auto}}"
    table = lambda rows: "<table>" + "".join("<tr>" + "".join(f"<td>{e(str(c))}</td>" for c in r) + "</tr>" for r in rows) + "</table>"
    who = [(k, v) for k, v in (("Client", brand.client), ("Project", brand.project), ("Assessor", brand.assessor), ("Company", brand.company)) if v]
    logo = f'<img alt="" src="{e(brand.logo)}">' if brand.logo.startswith("data:image/") else ""
    parts = [f"{logo}<h1>{e(title)}</h1>", table(who) if who else "", "<h2>Executive Summary</h2>", f"<p>{e(_overview(report, brand))}</p>", table([("Severity", "Count"), *[(_words(k), s[k]) for k in C.SEVERITIES], ("Total", s["total"])])]
    if report["findings"]:
        parts += ["<h2>Remediation Roadmap</h2>", table([("Priority", "Severity", "Count", "When"), *[(r["priority"], _words(r["severity"]), r["count"], r["sla"]) for r in report["roadmap"]]]), "<h2>Findings</h2>"]
    else:
        parts.append("<p>No findings.</p>")
    for f in report["findings"]:
        fix = f.get("fix")
        parts += [f'<section id="{e(f["anchor"])}"><h3>{f["index"]}. {e(f["title"])} ({e(_words(f["severity"]))})</h3>', table(_facts(f)), f"<p>{e(f['description'])}</p><h4>Evidence</h4><pre>{e(f['code_snippet'])}</pre>"]
        if fix:
            parts.append(f"<h4>Suggested Fix</h4><p>{e(fix['summary'])}</p><pre>{e(fix['after'] or '')}</pre>")
        if _links(f):
            parts.append("<h4>References</h4><ul>" + "".join(f"<li>{e(x)}</li>" for x in _links(f)) + "</ul>")
        parts.append("</section>")
    if report["truncated"]:
        parts.append(f"<p>Only the {len(report['findings'])} worst of {s['total']} findings are listed.</p>")
    return f'<!DOCTYPE html><html lang="en"><head><meta charset="utf-8"><title>{e(title)}</title><style>{style}</style></head><body>{"".join(parts)}</body></html>'
