"""Commits, files at a commit, and what changed between two, from a repository's objects.

All of it works on tables of objects (oid, type, content) and references (name, oid,
target), however they come; `objects` and `references` read them from a repository.
Trees are walked a level at a time by joins on object ids, so a walk takes as many
rounds as the deepest path has parts, and the comparison of two commits never enters a
folder that both have under the same id.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.functions import edits
from lintel.sources import git_store
from lintel.sources.files import is_binary
from lintel.sources.shared import stored

#: Patches of more characters are left out.
MOST_PATCH = 100_000
#: The modes of folders, links and repositories within a tree.
FOLDER, LINK, REPOSITORY = "40000", "120000", "160000"


def objects(spark: SparkSession, repository: str, types: tuple = (), max_bytes: int | None = None) -> DataFrame:
    """The objects of a repository, each once."""
    git_store.register(spark)
    reader = spark.read.format("git").option("path", repository).option("types", ",".join(types))
    if max_bytes is not None:
        reader = reader.option("max_bytes", max_bytes)
    return reader.load().dropDuplicates(["oid"])


def references(spark: SparkSession, repository: str) -> DataFrame:
    git_store.register(spark)
    return spark.read.format("git_refs").option("path", repository).load()


def _signed(text: Column, who: str) -> list[Column]:
    """(name, address, time) of a header line about a person."""
    p = rf"(?m)^{who} (.*?) ?<([^>]*)> (-?\d+) [+-]\d+$"
    seconds = F.regexp_extract(text, p, 3)
    return [F.regexp_extract(text, p, 1), F.regexp_extract(text, p, 2), F.when(seconds != "", F.timestamp_seconds(seconds.try_cast("long")))]


def _parts(objects: DataFrame, kind: str) -> DataFrame:
    """(oid, head, body) of the objects of a kind that are text."""
    text = F.decode(F.col("content"), "UTF-8")
    rows = objects.where(F.col("type") == kind).select("oid", text.alias("t"), F.instr(text, "\n\n").alias("at"))
    head = F.when(F.col("at") > 0, F.substring("t", F.lit(1), F.col("at"))).otherwise(F.col("t"))
    body = F.when(F.col("at") > 0, F.substring("t", F.col("at") + 2, F.length("t"))).otherwise("")
    return rows.select("oid", head.alias("head"), body.alias("body"))


def commits(objects: DataFrame) -> DataFrame:
    """(oid, tree, parents, author, email, authored_at, committed_at, message)."""
    c = _parts(objects, "commit")
    name, email, at = _signed(F.col("head"), "author")
    tree = F.regexp_extract("head", r"^tree ([0-9a-f]{40})", 1)
    parents = F.regexp_extract_all("head", F.lit(r"(?m)^parent ([0-9a-f]{40})$"), F.lit(1))
    return c.select("oid", tree.alias("tree"), parents.alias("parents"), name.alias("author"), email.alias("email"), at.alias("authored_at"), _signed(F.col("head"), "committer")[2].alias("committed_at"), F.regexp_replace("body", r"^\s+|\s+$", "").alias("message"))


def branches(references: DataFrame, commits: DataFrame) -> DataFrame:
    """(name, sha, last_commit, author)."""
    b = references.where(F.col("name").startswith("refs/heads/")).select(F.substring("name", F.lit(12), F.length("name")).alias("name"), F.col("oid").alias("sha"))
    return b.join(commits.select(F.col("oid").alias("sha"), F.col("authored_at").alias("last_commit"), "author"), "sha", "left").select("name", "sha", "last_commit", "author")


def tags(references: DataFrame, objects: DataFrame) -> DataFrame:
    """(name, sha, message, tagger, date): an annotated tag's own, else the author and the time of its commit."""
    t = references.where(F.col("name").startswith("refs/tags/")).select(F.substring("name", F.lit(11), F.length("name")).alias("name"), F.col("oid").alias("sha"))
    name, _, at = _signed(F.col("head"), "tagger")
    own = _parts(objects, "tag").select(F.col("oid").alias("sha"), name.alias("tagger"), at.alias("date"), F.regexp_replace("body", r"^\s+|\s+$", "").alias("message"))
    light = commits(objects).select(F.col("oid").alias("sha"), F.col("author").alias("tagger"), F.col("authored_at").alias("date"), F.lit("").alias("message"))
    return t.join(own.unionByName(light), "sha", "left").select("name", "sha", F.coalesce("message", F.lit("")).alias("message"), "tagger", "date")


def history(commits: DataFrame, start: str, most: int) -> DataFrame:
    """The `most` latest commits that `start` descends from, itself included, by the time they were committed.

    A commit is among them only if it is at most that many steps away, so there are
    at most `most` rounds, of which each keeps the latest `most` rows of what is reached.
    """
    known = stored(commits)
    reached = known.where(F.col("oid") == start)
    front = reached
    for _ in range(most - 1):
        parents = front.select(F.explode("parents").alias("oid")).distinct()
        front = stored(known.join(parents, "oid", "left_semi").join(reached.select("oid"), "oid", "left_anti"))
        if front.isEmpty():
            break
        latest = reached.unionByName(front).orderBy(F.desc("committed_at"), "oid").limit(most)
        reached = stored(latest)
        front = front.join(reached.select("oid"), "oid", "left_semi")
    return reached


def _entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The entries of trees, which are lines of mode, name and id without a line end."""
    for batch in batches:
        out = []
        for oid, raw in zip(batch["oid"], batch["content"]):
            at, raw = 0, bytes(raw)
            while at < len(raw):
                blank, end = raw.index(b" ", at), raw.index(b"\0", at)
                out.append((oid, raw[at:blank].decode(), raw[blank + 1 : end].decode("utf-8", "replace"), raw[end + 1 : end + 21].hex()))
                at = end + 21
        yield pd.DataFrame(out, columns=["tree", "mode", "name", "oid"])


def entries(objects: DataFrame) -> DataFrame:
    """(tree, mode, name, oid) of all trees."""
    return objects.where("type = 'tree'").select("oid", "content").mapInPandas(_entries, "tree string, mode string, name string, oid string")


def _below(path: Column, name: Column) -> Column:
    return F.when(path == "", name).otherwise(F.concat_ws("/", path, name))


def files_at(entries: DataFrame, commits: DataFrame, commit: str, path: str | None = None, links: bool = False) -> DataFrame:
    """(path, mode, oid) of a commit's files, or of those at or below a path.

    Links are no files unless asked for; repositories within the repository never are.
    """
    known = stored(entries)
    front = stored(commits.where(F.col("oid") == commit).select(F.lit("").alias("path"), F.col("tree")))
    found = None
    while not front.isEmpty():
        rows = front.join(known, "tree").select(_below(F.col("path"), F.col("name")).alias("path"), "mode", "oid")
        if path is not None:  # only what lies above or below it
            rows = rows.where((F.col("path") == path) | F.lit(path).startswith(F.concat("path", F.lit("/"))) | F.col("path").startswith(path.rstrip("/") + "/"))
        rows = stored(rows)
        leaves = rows.where(~F.col("mode").isin(FOLDER, REPOSITORY, *([] if links else [LINK])))
        found = leaves if found is None else found.unionByName(leaves)
        front = rows.where(F.col("mode") == FOLDER).select("path", F.col("oid").alias("tree"))
    return commits.sparkSession.createDataFrame([], "path string, mode string, oid string") if found is None else found


def with_content(files: DataFrame, objects: DataFrame, oid: str = "oid", content: str = "content") -> DataFrame:
    """Files with the contents of their blobs, and whether these are binary."""
    blobs = objects.where("type = 'blob'").select(F.col("oid").alias(oid), F.col("content").alias(content))
    return files.join(blobs, oid, "left")


def scan_files(files: DataFrame, objects: DataFrame) -> DataFrame:
    """(path, content, size) as `api.scan_files` takes them; contents that were too large to be read are null."""
    blobs = objects.where("type = 'blob'").select("oid", "content", "size")
    return files.join(blobs, "oid").select("path", "content", "size")


def resolved(references: DataFrame, objects: DataFrame, name: str) -> str | None:
    """The id of the commit that HEAD, a branch, a tag or an id means; None if there is none."""
    order = {n: k for k, n in enumerate((name, f"refs/heads/{name}", f"refs/tags/{name}"))}
    found = sorted(references.where(F.col("name").isin(list(order))).collect(), key=lambda r: order[r["name"]])
    oid = next((r.oid for r in found if r.oid), name)
    tag = _parts(objects, "tag").where(F.col("oid") == oid).select(F.regexp_extract("head", r"^object ([0-9a-f]{40})", 1).alias("oid")).first()
    oid = tag.oid if tag else oid
    return oid if objects.where((F.col("type") == "commit") & (F.col("oid") == oid)).select("oid").first() else None


def changes(entries: DataFrame, commits: DataFrame, old: str, new: str) -> DataFrame:
    """(path, change, old_oid, new_oid) of the files that differ: added, deleted or modified.

    Two trees of one id are never entered. What turns from a file into a folder is
    deleted, and the folder's files are added. A changed mode alone is a modification.
    """
    known = stored(entries)
    tree = lambda c, name: commits.where(F.col("oid") == c).select(F.col("tree").alias(name))
    front = stored(tree(old, "a").join(tree(new, "b"), F.col("a") != F.col("b")).select(F.lit("").alias("path"), "a", "b"))
    found = None
    while not front.isEmpty():
        side = lambda c: front.join(known, F.col(c) == F.col("tree")).select(_below(F.col("path"), F.col("name")).alias("path"), F.struct("mode", "oid").alias(f"{c}_is"))  # noqa: E731, B023
        rows = stored(side("a").join(side("b"), "path", "full").where(~F.col("a_is").eqNullSafe(F.col("b_is"))))
        file = lambda c: F.when(~F.col(f"{c}_is.mode").isin(FOLDER, REPOSITORY), F.col(f"{c}_is.oid"))
        folder = lambda c: F.when(F.col(f"{c}_is.mode") == FOLDER, F.col(f"{c}_is.oid"))
        leaves = rows.select("path", file("a").alias("old_oid"), file("b").alias("new_oid")).where("old_oid IS NOT NULL OR new_oid IS NOT NULL")
        found = leaves if found is None else found.unionByName(leaves)
        front = rows.select("path", folder("a").alias("a"), folder("b").alias("b")).where("NOT a <=> b")
    if found is None:
        found = commits.sparkSession.createDataFrame([], "path string, old_oid string, new_oid string")
    change = F.when(F.col("old_oid").isNull(), "added").when(F.col("new_oid").isNull(), "deleted").otherwise("modified")
    return found.select("path", change.alias("change"), "old_oid", "new_oid")


_DIFF = "path string, change string, hunks array<struct<old_start:long,removed:long,new_start:long,added:long>>, patch string"


def _diffed(most: int):
    def lines(raw: bytes) -> list[str]:
        """With their line feeds; only these end a line."""
        out = raw.decode("utf-8", "replace").split("\n")
        return [f"{x}\n" for x in out[:-1]] + [x for x in out[-1:] if x]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, change, old, new, binary in batch.itertuples(index=False):
                if binary:
                    out.append((path, change, None, None))
                    continue
                a, b = lines(bytes(old or b"")), lines(bytes(new or b""))
                script = edits.edits(a, b)
                text = edits.unified(a, b, script)
                out.append((path, change, [{"old_start": i + 1, "removed": n, "new_start": k + 1, "added": m} for i, n, k, m in script], text if len(text) < most else None))
            yield pd.DataFrame(out, columns=["path", "change", "hunks", "patch"])

    return run


def diff(changed: DataFrame, objects: DataFrame, most: int = MOST_PATCH) -> DataFrame:
    """(path, change, hunks, patch): shortest edit scripts of changed files; both null for binary ones.

    A hunk is (first old line, lines removed, first new line, lines added). A patch of `most`
    characters or more is null, its hunks are there.
    """
    both = with_content(with_content(changed, objects, "old_oid", "old"), objects, "new_oid", "new")
    binary = F.coalesce(is_binary(F.col("old")), F.lit(False)) | F.coalesce(is_binary(F.col("new")), F.lit(False))
    return both.select("path", "change", "old", "new", binary.alias("is_binary")).mapInPandas(_diffed(most), _DIFF)


def changed_lines(diffs: DataFrame) -> DataFrame:
    """(path, line_no) of the lines that a commit adds or changes."""
    h = diffs.where("change <> 'deleted'").select("path", F.explode("hunks").alias("h")).where("h.added > 0")
    return h.select("path", F.explode(F.sequence(F.col("h.new_start").cast("int"), (F.col("h.new_start") + F.col("h.added") - 1).cast("int"))).alias("line_no"))


def on_changed_lines(findings: DataFrame, diffs: DataFrame) -> DataFrame:
    """The findings on lines that were added or changed."""
    lines = changed_lines(diffs).select(F.col("path").alias("__path"), F.col("line_no").alias("__line"))
    return findings.join(lines, (F.col("file_path") == F.col("__path")) & (F.col("line_start") == F.col("__line")), "left_semi")
