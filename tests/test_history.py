"""Repositories as a source, walks of trees, edit scripts."""

import json
import os
import random
import shutil
import subprocess
import zlib

import pytest
from pyspark.sql import functions as F

from lintel import __main__ as cli
from lintel.functions import edits
from lintel.operators import delta, history
from lintel.plans import api
from lintel.sources import git_store

needs_git = pytest.mark.skipif(shutil.which("git") is None, reason="the fixture is made by git")


def _git(repo, *args, data=None):
    env = {"PATH": os.environ["PATH"], "HOME": str(repo), "GIT_AUTHOR_NAME": "Ann é", "GIT_AUTHOR_EMAIL": "a@x.org", "GIT_COMMITTER_NAME": "Bo", "GIT_COMMITTER_EMAIL": "b@x.org", "GIT_AUTHOR_DATE": f"{_git.now} +0200", "GIT_COMMITTER_DATE": f"{_git.now + 5} +0200", "GIT_CONFIG_NOSYSTEM": "1"}
    return subprocess.run(["git", "-C", str(repo), *args], env=env, capture_output=True, check=True, input=data).stdout


_git.now = 1_700_000_000


def _commit(repo, message):
    _git.now += 1000
    _git(repo, "add", "-A")
    _git(repo, "commit", "-q", "--allow-empty", "-m", message)
    return _git(repo, "rev-parse", "HEAD").decode().strip()


def _fill(repo):
    """A repository with packs of deltas, loose objects, links, branches, tags and a merge."""
    rng = random.Random(3)
    subprocess.run(["git", "init", "-q", "-b", "main", str(repo)], check=True)
    (repo / "src" / "deep" / "er").mkdir(parents=True)
    body = [f"line {k} {rng.random()}\n" for k in range(400)]
    (repo / "src" / "big.py").write_text("".join(body))
    (repo / "src" / "deep" / "er" / "x.py").write_text("pickle.load(f)\n")
    (repo / "same").mkdir()
    for k in range(30):
        (repo / "same" / f"f{k}.txt").write_text(f"{k}\n")
    (repo / "bin.dat").write_bytes(bytes(range(256)) * 40)
    os.symlink("/etc/passwd", repo / "link.py")
    made = [_commit(repo, "first\n\nbody of it\n\n")]
    for k in range(6):
        body[rng.randrange(400)] = f"changed {k}\n"
        (repo / "src" / "big.py").write_text("".join(body))
        made.append(_commit(repo, f"change {k}"))
    _git(repo, "tag", "v1")
    _git(repo, "tag", "-a", "v2", "-m", "second\n\nnote")
    _git(repo, "gc", "-q", "--aggressive")
    _git(repo, "checkout", "-q", "-b", "side", made[3])
    (repo / "side.go").write_text("package x\n")
    side = _commit(repo, "side")
    _git(repo, "checkout", "-q", "main")
    _git(repo, "merge", "-q", "--no-ff", "-m", "merge", "side")
    (repo / "src" / "deep" / "er" / "x.py").write_text("import a\npickle.load(f)\nhashlib.sha1(x)\n")
    (repo / "same" / "f3.txt").unlink()
    (repo / "src" / "deep" / "new.py").write_text("y = yaml.load(f)")
    (repo / "bin.dat").write_bytes(b"\0" * 99)
    shutil.rmtree(repo / "src" / "deep" / "er")
    (repo / "src" / "deep" / "er").write_text("now a file\n")
    made += [side, _commit(repo, "last")]
    return made


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    path = tmp_path_factory.mktemp("git") / "r"
    return path, _fill(path)


@needs_git
@pytest.mark.parametrize("split", [1 << 30, 700])
def test_objects(spark, repo, split):
    path, _ = repo
    git_store.register(spark)
    df = spark.read.format("git").option("path", str(path)).option("split_bytes", split).load()
    got = {r.oid: (r.type, r.size, bytes(r.content)) for r in df.collect()}
    named = _git(path, "cat-file", "--batch-check", "--batch-all-objects").decode().split("\n")[:-1]
    want = {x.split()[0]: (x.split()[1], int(x.split()[2])) for x in named}
    assert {k: v[:2] for k, v in got.items()} == want and len(want) > 30
    assert all(git_store.object_id(v[0], v[2]) == k for k, v in got.items())
    packed = _git(path, "verify-pack", "-v", *[str(p) for p in path.glob(".git/objects/pack/*.idx")]).decode()
    assert "chain length = 2" in packed and df.rdd.getNumPartitions() >= (2 if split > 1000 else 8)
    few = spark.read.format("git").option("path", str(path)).option("types", "commit,tag").option("max_bytes", 1).load().collect()
    assert {r.oid for r in few} == {k for k, v in want.items() if v[0] in ("commit", "tag")} and all(r.content is None for r in few)


@needs_git
def test_commits_branches_tags(spark, repo):
    path, made = repo
    objects, refs = history.objects(spark, str(path), ("commit", "tag")), history.references(spark, str(path))
    commits = history.commits(objects)
    got = {r.oid: r for r in commits.withColumn("t", F.unix_timestamp("authored_at")).withColumn("u", F.unix_timestamp("committed_at")).collect()}
    log = _git(path, "log", "--all", "--format=%H%x00%T%x00%P%x00%an%x00%ae%x00%at%x00%ct%x00%B%x01").decode().split("\x01")[:-1]
    assert len(got) == len(log) == 10
    for x in log:
        oid, tree, parents, name, email, at, ct, message = x.strip("\n").split("\0")
        r = got[oid]
        assert (r.tree, list(r.parents), r.author, r.email, r.t, r.u, r.message) == (tree, parents.split(), name, email, int(at), int(ct), message.strip())
    b = {r.name: (r.sha, r.author) for r in history.branches(refs, commits).collect()}
    assert b == {"main": (made[-1], "Ann é"), "side": (made[-2], "Ann é")}
    t = {r.name: (r.message, r.tagger) for r in history.tags(refs, objects).collect()}
    assert t == {"v1": ("", "Ann é"), "v2": ("second\n\nnote", "Bo")}
    head = refs.where("name = 'HEAD'").first()
    assert (head.oid, head.target) == (made[-1], "refs/heads/main")
    for most in (1, 3, 50):
        want = _git(path, "log", "--format=%H", f"-{most}", "HEAD").decode().split()
        assert {r.oid for r in history.history(commits, made[-1], most).collect()} == set(want)


@needs_git
def test_files_and_changes(spark, repo):
    path, made = repo
    objects = history.objects(spark, str(path))
    commits, entries = history.commits(objects), history.entries(objects)
    for c in (made[0], made[-1]):
        want = {}
        for row in _git(path, "ls-tree", "-r", "-z", c).decode().split("\0")[:-1]:
            head, name = row.split("\t")
            if not head.startswith("120000"):
                want[name] = head.split()[2]
        assert {r.path: r.oid for r in history.files_at(entries, commits, c).collect()} == want
    assert "link.py" in {r.path for r in history.files_at(entries, commits, made[0], links=True).collect()}
    one = history.with_content(history.files_at(entries, commits, made[0], "src/deep"), objects).collect()
    assert [(r.path, bytes(r.content)) for r in one] == [("src/deep/er/x.py", b"pickle.load(f)\n")]
    assert history.files_at(entries, commits, "0" * 40).count() == 0
    for a, b in ((made[0], made[-1]), (made[-1], made[2]), (made[1], made[1])):
        want = {x.split("\t")[1]: {"A": "added", "D": "deleted", "M": "modified"}[x[0]] for x in _git(path, "diff", "--name-status", "--no-renames", a, b).decode().splitlines()}
        got = history.changes(entries, commits, a, b)
        assert {r.path: r.change for r in got.collect()} == want
    got = history.diff(history.changes(entries, commits, made[0], made[-1]), objects)
    rows = {r.path: r for r in got.collect()}
    assert rows["bin.dat"].hunks is None and rows["src/deep/new.py"].patch == "@@ -0,0 +1 @@\n+y = yaml.load(f)\n\\ No newline at end of file\n"
    want = _git(path, "diff", "--no-renames", "--minimal", "--no-color", made[0], made[-1], "--", "src/big.py").decode()
    assert rows["src/big.py"].patch == "".join(x if not x.startswith("@@") else x[: x.index("@@", 2) + 2] + "\n" for x in want.splitlines(keepends=True)[4:])
    found = api.scan_files(history.scan_files(history.files_at(entries, commits, made[-1]), objects)).findings
    assert [(r.file_path, r.line_start) for r in history.on_changed_lines(found, got).collect()] == [("src/deep/new.py", 1)]


@needs_git
def test_scan_of_a_commit(spark, repo):
    path, made = repo
    find = lambda *a: sorted((r.file_path, r.line_start) for r in api.scan_commit(spark, str(path), *a).findings.collect())
    assert find("v2") == [("src/deep/er/x.py", 1)]
    with pytest.raises(ValueError):
        api.scan_commit(spark, str(path), "nothing")
    out = path.parent / "out.sarif"
    assert cli.main(["scan", str(path), "--since", made[0], "--format", "sarif", "--output", str(out)]) == 0
    results = json.loads(out.read_text())["runs"][0]["results"]
    assert [x["locations"][0]["physicalLocation"]["artifactLocation"]["uri"] for x in results] == ["src/deep/new.py"]
    skipped = api.scan_commit(spark, str(path), options=api.ScanOptions(max_bytes=10)).skipped
    assert ("src/big.py", "too large") in {tuple(r) for r in skipped.collect()}


def _lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last, row = row, [0]
        for k, y in enumerate(b):
            row.append(last[k] + 1 if x == y else max(last[k + 1], row[k]))
    return row[-1]


def test_edit_scripts_are_shortest():
    rng = random.Random(7)
    for _ in range(400):
        n = rng.choice([2, 3, 6, 20])
        a, b = ([f"{rng.randrange(n)}\n" for _ in range(rng.randrange(0, 40))] for _ in range(2))
        if rng.random() < 0.3:
            b = a[:]
            for _ in range(rng.randrange(4)):
                b.insert(rng.randrange(len(b) + 1), "new\n")
        script = edits.edits(a, b)
        assert edits.patched(a, b, script) == b
        assert sum(e[1] for e in script) == len(a) - _lcs(a, b) and sum(e[3] for e in script) == len(b) - _lcs(a, b)
        assert all(x[0] + x[1] < y[0] or x[2] + x[3] < y[2] for x, y in zip(script, script[1:]))


@needs_git
def test_patches_apply(tmp_path):
    rng = random.Random(9)
    for _ in range(25):
        a = [f"{rng.randrange(9)}\n" for _ in range(rng.randrange(0, 60))]
        b = [x for x in a if rng.random() < 0.8] + [f"{rng.randrange(9)}\n" for _ in range(rng.randrange(3))]
        if b and rng.random() < 0.5:
            b[-1] = b[-1].rstrip("\n")
        if a == b:
            continue
        (tmp_path / "f").write_text("".join(a))
        text = "--- a/f\n+++ b/f\n" + edits.unified(a, b, edits.edits(a, b))
        subprocess.run(["git", "apply", "--unidiff-zero", "--allow-empty", "-"], cwd=tmp_path, input=text.encode(), check=True, capture_output=True)
        assert ((tmp_path / "f").read_text() if (tmp_path / "f").exists() else "") == "".join(b)
        (tmp_path / "f").unlink(missing_ok=True)


def test_long_edit_script():
    a = [f"{k % 5000}\n" for k in range(20_000)]
    b = [f"{k * 7 % 5000}\n" for k in range(20_000)]
    script = edits.edits(a, b)
    assert edits.patched(a, b, script) == b


def test_deltas():
    base = bytes(range(200)) * 3
    delta = bytes([0xD8, 0x04, 9]) + bytes([0x91, 5, 4]) + bytes([5]) + b"hello"
    assert git_store.apply_delta(base, delta) == base[5:9] + b"hello"
    with pytest.raises(ValueError):
        git_store.apply_delta(base[1:], delta)


def test_loose_objects_without_git(spark, tmp_path):
    blob = b"text\n"
    oid = git_store.object_id("blob", blob)
    folder = tmp_path / "objects" / oid[:2]
    folder.mkdir(parents=True)
    (folder / oid[2:]).write_bytes(zlib.compress(b"blob 5\0" + blob))
    (tmp_path / "packed-refs").write_text(f"# pack-refs\n{oid} refs/tags/t\n")
    (tmp_path / "HEAD").write_text("ref: refs/heads/none\n")
    assert [(r.oid, bytes(r.content)) for r in history.objects(spark, str(tmp_path)).collect()] == [(oid, blob)]
    assert {tuple(r) for r in history.references(spark, str(tmp_path)).collect()} == {("refs/tags/t", oid, None), ("HEAD", None, "refs/heads/none")}


def test_only_files_that_changed_are_scanned_again(spark):
    """Of files that share a path all count together, and repeated contents by their number."""
    schema = "path string, content string"
    before = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x"), ("c", "y"), ("d", "x"), ("gone", "x")], schema)
    now = spark.createDataFrame([("a", "x"), ("b", "z"), ("c", "y"), ("c", "x"), ("d", "x"), ("d", "x"), ("new", "")], schema)
    assert sorted(r.path for r in delta.changed_paths(now, before).collect()) == ["b", "d", "new"]
