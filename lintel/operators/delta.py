"""Differences between scans, and what is asked of stored scans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def visible(findings: DataFrame) -> DataFrame:
    """Neither false positives nor suppressed."""
    return findings.where(~F.col("is_false_positive") & ~F.col("suppressed"))


def once(findings: DataFrame) -> DataFrame:
    """Each fingerprint once, as one whole finding: the greatest by its other columns in their order."""
    others = [c for c in findings.columns if c != "fingerprint"]
    if not others:
        return findings.distinct()
    one = findings.groupBy("fingerprint").agg(F.max(F.struct(*[F.col(f"`{c}`") for c in others])).alias("__one"))
    return one.select(*["fingerprint" if c == "fingerprint" else F.col(f"__one.`{c}`") for c in findings.columns])


def classified(current: DataFrame, baseline: DataFrame | None) -> DataFrame:
    """(fingerprint, change, now, before): each fingerprint's findings on either side; one full join.

    `change` is new, resolved or unchanged; without a baseline all is new.
    """
    now, old = once(current), once(current.limit(0) if baseline is None else baseline)
    rows = lambda df, name: df.select("fingerprint", F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias(name))
    both = rows(now, "now").join(rows(old, "before"), "fingerprint", "full")
    change = F.when(F.col("before").isNull(), "new").when(F.col("now").isNull(), "resolved").otherwise("unchanged")
    return both.select("fingerprint", change.alias("change"), "now", "before")


def changed_paths(files: DataFrame, before: DataFrame) -> DataFrame:
    """(path) of the files that a scan before did not see as they are; of files that share a path, all together."""
    content = F.sort_array(F.collect_list(F.coalesce(F.sha2("content", 256), F.lit(""))))
    now, was = (f.groupBy("path").agg(content.alias(name)) for f, name in ((files, "now"), (before, "was")))
    return now.join(was, "path", "left").where(~F.col("now").eqNullSafe(F.col("was"))).select("path")


def compared(current: DataFrame, baseline: DataFrame | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new, resolved, one row with `unchanged`) by fingerprint, each fingerprint once.

    Without a baseline all is new. Of findings that share a fingerprint one whole
    finding stands for all (`once`).
    """
    rows = classified(current, baseline)
    return rows.where("change = 'new'").select("now.*"), rows.where("change = 'resolved'").select("before.*"), rows.agg(F.count_if(F.col("change") == "unchanged").alias("unchanged"))


def compared_counts(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """(new, resolved, unchanged) as counts; every finding counts, repeated fingerprints too."""
    now = findings.groupBy("fingerprint").agg(F.count("*").alias("n"))
    both = now.join(baseline.select("fingerprint").distinct().withColumn("old", F.lit(True)), "fingerprint", "full")
    count = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0)).cast("long")
    return both.agg(count(F.col("old").isNull()).alias("new"), F.count_if(F.col("n").isNull()).alias("resolved"), count(F.col("old").isNotNull()).alias("unchanged"))


def baseline_of(scans: DataFrame, scan_id, baseline_id=None) -> DataFrame:
    """One row (scan_id, baseline_id, problem): what a scan is to be compared with.

    A named baseline must exist, be completed and be of the same repository and not
    the scan itself; otherwise `problem` says what is wrong. Without a name it is
    the scan's previous completed one, null for none.
    """
    scan = scans.where(F.col("scan_id") == scan_id)
    if baseline_id is None:
        known = previous_scans(scans).where(F.col("scan_id") == scan_id).select(F.col("previous_id").alias("baseline_id"))
        asked = known.limit(1).withColumn("problem", F.lit(None).cast("string"))
        return scan.select("scan_id").limit(1).crossJoin(asked)
    other = scans.where(F.col("scan_id") == baseline_id).select(F.col("scan_id").alias("baseline_id"), F.col("repository_id").alias("__repo"), F.col("status").alias("__status"))
    both = scan.select("scan_id", "repository_id").join(other, F.lit(True), "left")
    problem = F.when(F.col("__status").isNull(), "baseline not found").when(F.col("baseline_id") == F.col("scan_id"), "baseline is the scan itself").when(~F.col("repository_id").eqNullSafe(F.col("__repo")), "baseline is of another repository").when(F.col("__status") != "completed", "baseline is not completed")
    return both.select("scan_id", "baseline_id", problem.alias("problem"))


def valid_baseline(fingerprints: DataFrame, most: int = 10_000) -> DataFrame:
    """With `valid`: 32 lower-case hexadecimal digits; `within` tells whether there are few enough."""
    ok = F.regexp_like("fingerprint", F.lit("^[0-9a-f]{32}$"))
    return fingerprints.agg(F.count("*").alias("entries"), F.count_if(ok).alias("valid")).withColumn("accepted", (F.col("entries") <= most) & (F.col("entries") == F.col("valid")))


def previous_scans(scans: DataFrame) -> DataFrame:
    """(scan_id, previous_id): of the same repository the completed scan that began before and completed last.

    A running maximum over each repository's scans by their beginning.
    """
    done = F.when((F.col("status") == "completed") & F.col("completed_at").isNotNull(), F.struct("completed_at", "scan_id"))
    # scans that began at the same time are not before each other, so the maximum runs over distinct times
    per = scans.groupBy("repository_id", "created_at").agg(F.max(done).alias("best"))
    before = Window.partitionBy("repository_id").orderBy("created_at").rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("previous", F.max("best").over(before)).select("repository_id", "created_at", F.col("previous.scan_id").alias("previous_id"))
    return scans.join(per, ["repository_id", "created_at"]).select("scan_id", "previous_id")


def bounds(size: int = 50, number: int = 1, most: int = 200) -> tuple[int, int]:
    """(rows to skip, rows to take) of a page; sizes are held within 1 to `most`, 50 stands for none."""
    size = 50 if size <= 0 else min(size, most)
    return size * (max(number, 1) - 1), size


def page(findings: DataFrame, size: int = 50, number: int = 1) -> DataFrame:
    """A page by severity's name, then line; sizes are held within 1 to 200."""
    skip, take = bounds(size, number)
    return findings.orderBy("severity", "line_start", "file_path", "fingerprint").offset(skip).limit(take)


def queried(df: DataFrame, equal: dict | None = None, least: dict | None = None, before: dict | None = None, order: tuple = (), limit: int | None = None, offset: int = 0) -> DataFrame:
    """All given conditions, None leaves one out; then the order ("-x" descends), the offset and the limit."""
    conditions: list[Column] = [F.col(k) == v for k, v in (equal or {}).items() if v is not None]
    conditions += [F.col(k) >= v for k, v in (least or {}).items() if v is not None]
    conditions += [F.col(k) < v for k, v in (before or {}).items() if v is not None]
    out = df.where(reduce(lambda a, b: a & b, conditions, F.lit(True)))
    if order:
        out = out.orderBy(*[F.desc(c[1:]) if c.startswith("-") else F.asc(c) for c in order])
    if offset:
        out = out.offset(offset)
    return out if limit is None else out.limit(limit)


def counted(df: DataFrame, **conditions) -> DataFrame:
    """One row `n`: how many rows the same conditions leave, whatever the page."""
    return queried(df, **conditions).agg(F.count("*").alias("n"))


def vulnerability_statistics(findings: DataFrame, scans: DataFrame) -> DataFrame:
    """Counts by repository, day, severity and category."""
    joined = findings.join(scans.select("scan_id", "repository_id"), "scan_id")
    return joined.groupBy("repository_id", F.date_trunc("day", "created_at").alias("date"), "severity", "category").agg(
        F.count("*").alias("count"), F.count_if("is_false_positive").alias("false_positive_count"), F.count_if("suppressed").alias("suppressed_count"), F.count_if(F.col("fixed_at").isNotNull()).alias("fixed_count")
    )


def repository_scan_summary(repositories: DataFrame, scans: DataFrame) -> DataFrame:
    """Each repository with its last scan, if it has one."""
    last = scans.select(F.col("scan_id").alias("last_scan_id"), F.col("status").alias("last_scan_status"), F.col("total_vulnerabilities").alias("last_scan_vulnerabilities"), F.col("critical_count").alias("last_scan_critical"), F.col("high_count").alias("last_scan_high"))
    return repositories.join(last, "last_scan_id", "left").select("repository_id", "full_name", "total_scans", "last_scan_id", "last_scan_status", "last_scan_vulnerabilities", "last_scan_critical", "last_scan_high")


def scan_counters(findings: DataFrame) -> DataFrame:
    """True counts by scan, recomputed from its findings."""
    return findings.groupBy("scan_id").agg(F.count("*").alias("total_vulnerabilities"), *[F.count_if(F.col("severity") == s).alias(f"{s}_count") for s in ("critical", "high", "medium", "low", "info")])
