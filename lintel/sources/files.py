"""Files as rows (path, content, size, language, lines, line_count)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.functions import text as X

#: Defaults of a scan.
EXCLUDED_DIRS = ("node_modules/", "vendor/", ".git/", "dist/", "build/")
EXCLUDED_EXTENSIONS = (".min.js", ".lock", ".sum")
MAX_BYTES = 1 << 20
MAX_FILES = 1000


def qualified(spark: SparkSession, root: str) -> str:
    """A root as its store names it: absolute, with scheme."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def directory(spark: SparkSession, root: str) -> DataFrame:
    """(path relative to `root`, content binary, size) of a directory tree.

    The listing and the length filter are Spark's; symbolic links are the
    store's concern. `root` may be relative.
    """
    base = qualified(spark, root).rstrip("/") + "/"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    rel = F.substr(raw["path"], F.instr(raw["path"], base) + F.lit(len(base)))
    return raw.select(rel.alias("path"), "content", F.col("length").alias("size"))


def left_out(files: DataFrame, kept: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, reason) of the files of known languages that a scan did not take: their size, an exclusion, or the cap."""
    rest = files.withColumn("language", X.language(F.col("path"))).where("language IS NOT NULL").select("path", "size")
    rest = rest.join(kept.select("path"), "path", "left_anti")
    return rest.select("path", F.when(F.col("size") > max_bytes, "too large").otherwise("excluded or over the cap").alias("reason"))


def admitted(files: DataFrame, exclude: tuple = EXCLUDED_DIRS, extensions: tuple = EXCLUDED_EXTENSIONS, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Files a scan looks at, with their language.

    A directory goes if its path begins with a pattern without its slash, a file
    if its path has the pattern anywhere. Both, the extension, the size and the
    language are decided before a byte of content is split.
    """
    kept = files.where(F.col("size") <= max_bytes)
    dirs = F.expr("transform(sequence(1, size(split(path, '/')) - 1), k -> array_join(slice(split(path, '/'), 1, k), '/'))")
    dirs = F.when(F.col("path").contains("/"), dirs).otherwise(F.array().cast("array<string>"))
    for p in exclude:
        stem = p.rstrip("/")
        kept = kept.where(~F.col("path").contains(p) & ~F.exists(dirs, _begins(stem)))
    for e in extensions:
        kept = kept.where(~F.col("path").endswith(e))
    return kept.withColumn("language", X.language(F.col("path"))).where("language IS NOT NULL")


def _begins(stem: str):
    return lambda d: d.startswith(stem)


def capped(files: DataFrame, most: int = MAX_FILES) -> DataFrame:
    """The first files in the order of a walk, directory by directory.

    A global order by path parts with a limit: a top-k, not a sort of all.
    """
    return files.orderBy(F.split("path", "/")).limit(most)


def prefixed(files: DataFrame, prefix: str) -> DataFrame:
    return files.withColumn("path", X.clean_path(F.concat_ws("/", F.lit(prefix), F.col("path"))))


def is_binary(content: Column) -> Column:
    """A NUL in the first 8000 bytes, or over 30 % control bytes in them."""
    head = F.decode(F.substring(content, 1, 8000), "ISO-8859-1")
    control = F.length(head) - F.length(F.regexp_replace(head, "[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f]", ""))
    return head.contains("\0") | (control > F.lit(0.3) * F.length(head))


def readable(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(text files, scan errors) of contents that are binary or, null, could not be read."""
    text = files.where(~is_binary(F.col("content"))).withColumn("content", F.col("content").cast("string"))
    message = F.when(F.col("content").isNull(), "cannot be read").otherwise("binary file")
    errors = files.where(F.coalesce(is_binary(F.col("content")), F.lit(True))).select(F.col("path").alias("file"), message.alias("message"), F.lit("parse").alias("phase"))
    return text, errors


def parsed(files: DataFrame) -> DataFrame:
    """With their lines; a trailing line end gives a last empty line, an empty file one line."""
    return files.withColumn("lines", F.split("content", "\n", -1)).withColumn("line_count", F.size("lines"))


def manifest_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change) between two manifests (path, hash): added, deleted or modified."""
    a, b = old.select("path", F.col("hash").alias("was")), new.select("path", F.col("hash").alias("is"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "deleted").when(F.col("was") != F.col("is"), "modified")
    return a.join(b, "path", "full").select("path", change.alias("change")).where("change IS NOT NULL")


def most_recent(commits: DataFrame, n: int) -> DataFrame:
    """The latest rows by `committed_at`, then id."""
    return commits.orderBy(F.desc("committed_at"), "commit_id").limit(n)


def supported_url(url: Column, hosts: tuple) -> Column:
    """Whether a repository address may be cloned: https or ssh, no credentials, a listed host, no "..".

    A user name is fine with ssh, a password never is.
    """
    u = X.trimmed(url)
    parts = r"^([a-zA-Z][a-zA-Z0-9+.-]*)://(?:([^/?#@]*)@)?([^/?#:]*)(?::\d*)?([^?#]*)"
    scheme, user = F.lower(F.regexp_extract(u, parts, 1)), F.regexp_extract(u, parts, 2)
    host, path = F.lower(F.regexp_extract(u, parts, 3)), F.regexp_extract(u, parts, 4)
    named = F.regexp_like(u, F.lit(r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#@]*@"))
    secret = named & ((scheme == "https") | user.contains(":"))
    return scheme.isin("https", "ssh") & ~secret & host.isin([h.lower() for h in hosts]) & ~path.contains("..")


def repository(url: Column) -> Column:
    """struct(name, full_name, provider) of a repository address."""
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#]*)", 1))
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/?([^?#]*)", 1)
    full = F.regexp_replace(path, r"\.git$", "")
    provider = F.when(host.contains("github"), "github").when(host.contains("gitlab"), "gitlab").when(host.contains("bitbucket"), "bitbucket").otherwise("generic")
    return F.struct(F.element_at(F.split(full, "/", -1), -1).alias("name"), full.alias("full_name"), provider.alias("provider"))


