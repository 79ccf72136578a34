"""Command line: scan, fix, report, rules, version."""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import SparkSession

from lintel.operators import report
from lintel.plans import api
from lintel.plans import catalog as C

VERSION = "0.3"


def _session() -> SparkSession:
    spark = SparkSession.builder.appName("lintel").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _scan(args) -> api.ScanResult:
    options = api.ScanOptions(max_files=args.max_files, path_prefix=args.path_prefix).requested(tuple(x for x in args.rules.split(",") if x.strip()), tuple(args.exclude))
    if args.commit or args.since:
        return api.scan_commit(_session(), str(Path(args.path).resolve()), args.commit or "HEAD", args.since, options)
    return api.scan_path(_session(), args.path, options)


def _put(text: str, to: str | None) -> None:
    if to:
        Path(to).write_text(text, encoding="utf-8")
    else:
        print(text)


def scan(args) -> int:
    """Prints or writes a scan; 1 if it has critical findings and is asked to fail on them."""
    r = _scan(args)
    if args.output and args.format != "text":  # written by the executors
        where = str(Path(args.output).resolve())
        r.write_sarif(where, args.most, VERSION) if args.format == "sarif" else r.write_json(where, args.most)
    elif args.format == "sarif":
        _put(report.to_sarif(r.findings, version=VERSION, most=args.most), args.output)
    elif args.format == "text":
        _put("\n".join(x.line for x in report.text_rows(report.scan_order(r.findings)).toLocalIterator()), args.output)
    else:
        _put(json.dumps(r.document(args.most), indent=2, default=str), args.output)
    s = report.histogram(r.findings).first().asDict()
    skipped = r.skipped.count()
    print(f"{s['total']} findings: " + ", ".join(f"{s[k]} {k}" for k in C.SEVERITIES) + (f"; {skipped} files left out" if skipped else ""), file=sys.stderr)
    return int(bool(args.fail_on_critical and s["critical"]))


def fix(args) -> int:
    """Shows the lines that safe replacements change, and writes the files back if told to.

    Each file is compared with what was scanned just before it is written; one that
    has changed since is left alone.
    """
    if args.commit or args.since:
        raise SystemExit("fix works on files, not on a commit")
    r = _scan(args)
    root, applied, skipped = Path(args.path), 0, 0
    old = r.files.select("path", "content")
    for row in report.fixed_files(r.files, r.findings).join(old, "path").orderBy("path").toLocalIterator():
        before, after = row.content.split("\n"), row.new_content.split("\n")
        for k, (a, b) in enumerate(zip(before, after)):
            if a != b:
                print(f"{row.path}:{k + 1}\n- {a}\n+ {b}")
        target = root / row.path
        if args.write and target.read_bytes() != row.content.encode():
            skipped += row.changed_lines
            continue
        applied += row.changed_lines
        if args.write:
            target.write_bytes(row.new_content.encode())
    print(f"{applied} line(s) {'changed' if args.write else 'can be changed'}" + (f", {skipped} left alone (the source has changed)" if skipped else "") + ".")
    return 0


def make_report(args) -> int:
    """Renders a report as HTML or Markdown."""
    brand = report.Brand(company=args.company, project=args.project, client=args.client, assessor=args.assessor)
    model = _scan(args).report(args.most or 1000)
    _put(report.to_markdown(model, brand=brand) if args.format == "md" else report.to_html(model, brand=brand), args.output)
    return 0


def rules(args) -> int:
    """Lists the rules."""
    for rule, title, severity, category, cwe, confidence, _ in C.rule_table():
        print(f"{rule:18} {severity:9} {category:24} {cwe:9} {confidence:.2f}  {title}")
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lintel")
    commands = parser.add_subparsers(dest="command", required=True)
    for name, run, formats in (("scan", scan, ("json", "sarif", "text")), ("fix", fix, ()), ("report", make_report, ("html", "md"))):
        p = commands.add_parser(name, help=run.__doc__)
        p.add_argument("path")
        p.add_argument("--rules", default="", help="rules or categories, by commas; all if none is named")
        p.add_argument("--exclude", action="append", default=[])
        p.add_argument("--max-files", type=int, default=None)
        p.add_argument("--path-prefix", default="")
        p.add_argument("--commit", help="scan the files at this commit, branch or tag of the repository at the path" if formats else argparse.SUPPRESS)
        p.add_argument("--since", help="only what was added or changed since this commit" if formats else argparse.SUPPRESS)
        if formats:
            p.add_argument("--format", choices=formats, default=formats[0])
            p.add_argument("--output")
            p.add_argument("--most", type=int, default=None, help="findings in the output at most")
        p.set_defaults(run=run)
    commands.choices["scan"].add_argument("--fail-on-critical", action="store_true")
    commands.choices["fix"].add_argument("--write", action="store_true")
    for x in ("company", "project", "client", "assessor"):
        commands.choices["report"].add_argument(f"--{x}", default="")
    commands.add_parser("rules").set_defaults(run=rules)
    commands.add_parser("version").set_defaults(run=lambda a: print(VERSION) or 0)
    args = parser.parse_args(argv)
    return args.run(args)


if __name__ == "__main__":
    sys.exit(main())
