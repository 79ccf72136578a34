"""Whole scans by one call: options in, DataFrames out."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.functions import text as X
from lintel.operators import delta, detect, history, metrics, report, structure
from lintel.sources import files as sources
from lintel.sources import walk


@dataclass(frozen=True)
class ScanOptions:
    """What a scan looks at and for. `rules` names rules or categories; none means all."""

    rules: tuple[str, ...] = ()
    exclude: tuple[str, ...] = sources.EXCLUDED_DIRS
    exclude_extensions: tuple[str, ...] = sources.EXCLUDED_EXTENSIONS
    max_bytes: int = sources.MAX_BYTES
    max_files: int | None = None
    path_prefix: str = ""
    directive: str = detect.DIRECTIVE

    def requested(self, rules=(), exclude=()) -> ScanOptions:
        """With a request's rules instead of these, if it has any, and its exclusions besides."""
        return ScanOptions(tuple(rules) or self.rules, (*self.exclude, *exclude), self.exclude_extensions, self.max_bytes, self.max_files, self.path_prefix, self.directive)


@dataclass(frozen=True)
class ScanResult:
    """Parsed files, findings, errors and what was left out (path, reason), all lazy."""

    files: DataFrame
    findings: DataFrame
    errors: DataFrame
    skipped: DataFrame

    def metrics(self) -> DataFrame:
        return metrics.summary(self.files, structure.functions(self.files))

    def totals(self) -> DataFrame:
        """One row: files and lines scanned."""
        return self.files.agg(F.count("*").alias("files_scanned"), F.coalesce(F.sum("line_count"), F.lit(0)).cast("long").alias("lines_scanned"))

    def delta(self, baseline: DataFrame | None):
        return delta.compared(self.findings, baseline)

    def report(self, most: int | None = 1000) -> dict:
        return report.model(self.findings, most)

    def document(self, most: int | None = None, baseline: DataFrame | None = None) -> dict:
        """The scan as one JSON document, with what is new against a baseline if there is one; `write_json` is for large ones."""
        files, lines = self.totals().first()
        extra = {}
        if baseline is not None:
            new, gone, same = self.delta(baseline)
            extra = {"new": new, "unchanged": same.first()[0], "resolved": [r.fingerprint for r in gone.select("fingerprint").collect()]}
        return report.document(self.findings, files, lines, self.metrics().first().asDict(recursive=True), most, **extra)

    def write_json(self, path: str, most: int | None = None, baseline: DataFrame | None = None) -> None:
        """The same document as a file that the executors write, whatever its size."""
        files, lines = self.totals().first()
        report.write_json(self.findings, path, files, lines, self.metrics().first().asDict(recursive=True), most, None if baseline is None else self.delta(baseline))

    def write_sarif(self, path: str, most: int | None = None, version: str = "0") -> None:
        report.write_sarif(self.findings, path, version=version, most=most)

    def sarif(self) -> str:
        return report.to_sarif(self.findings)


def scan_files(files: DataFrame, options: ScanOptions = ScanOptions(), read=None) -> ScanResult:
    """A scan of (path, content binary, size); `read` adds the contents to the rows that are admitted, if they have none."""
    kept = sources.admitted(files, options.exclude, options.exclude_extensions, options.max_bytes)
    named = files
    if options.max_files is not None:  # unreadable files count, too
        kept = sources.capped(kept, options.max_files)
    skipped = sources.left_out(named, kept, options.max_bytes)
    kept = read(kept).withColumn("language", X.language(F.col("path"))) if read else kept
    if options.path_prefix:
        kept, skipped = (sources.prefixed(x, options.path_prefix) for x in (kept, skipped))
    text, errors = sources.readable(kept)
    parsed = sources.parsed(text)
    return ScanResult(parsed, detect.scan(parsed, options.rules, options.directive), errors, skipped)


def scan_path(spark: SparkSession, root: str, options: ScanOptions = ScanOptions()) -> ScanResult:
    """A scan of a directory in any store that Spark reads.

    In a folder that driver and executors see only regular files are read: no link
    is followed, and excluded folders are not opened.
    """
    base = sources.qualified(spark, root)
    if not base.startswith("file:"):
        return scan_files(sources.directory(spark, root), options)
    folder = base.removeprefix("file:").rstrip("/") or "/"
    return scan_files(walk.listed(spark, folder, options.exclude), options, lambda kept: walk.with_contents(kept, folder))


def scan_commit(spark: SparkSession, repository: str, commit: str = "HEAD", since: str | None = None, options: ScanOptions = ScanOptions()) -> ScanResult:
    """A scan of the files at a commit (an id, a branch, a tag or HEAD) of a repository that Spark reads where it lies.

    With `since`, another commit, only files that differ from it are scanned, and only
    findings on lines that were added or changed since are kept.
    """
    small, references = history.objects(spark, repository, ("commit", "tag")), history.references(spark, repository)
    ids = [history.resolved(references, small, c) for c in ((commit,) if since is None else (commit, since))]
    if None in ids:
        raise ValueError(f"no such commit: {(commit, since)[ids.index(None)]}")
    commits, entries = history.commits(small), history.entries(history.objects(spark, repository, ("tree",)))
    blobs = history.objects(spark, repository, ("blob",), max_bytes=options.max_bytes)
    files = history.files_at(entries, commits, ids[0])
    if since is None:
        return scan_files(history.scan_files(files, blobs), options)
    changed = history.changes(entries, commits, ids[1], ids[0])
    files = files.join(changed.select("path"), "path", "left_semi")
    out = scan_files(history.scan_files(files, blobs), options)
    if options.path_prefix:
        changed = sources.prefixed(changed, options.path_prefix)
    return replace(out, findings=history.on_changed_lines(out.findings, history.diff(changed, blobs)))
