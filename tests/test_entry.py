"""The entry with and without the training-data subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[1]
CODE = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), len(s), set(s) <= set(q), 'pipeline' in q)"


def _run(folder):
    out = subprocess.run([sys.executable, "-B", "-c", CODE], cwd=folder, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"})
    assert out.returncode == 0, out.stderr
    return out.stdout.split()


def test_entry_without_the_subpackage(tmp_path):
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    shutil.copytree(ROOT / "lintel", tmp_path / "lintel", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    n, m, inside, pipeline = _run(tmp_path)
    assert int(n) >= 60 and int(m) >= 60 and inside == "True" and pipeline == "False"


def test_nothing_else_imports_the_subpackage():
    for p in (ROOT / "lintel").rglob("*.py"):
        if "llm" not in p.parts:
            assert "lintel.llm" not in p.read_text(), p


def test_the_other_tests_stand_without_both_folders(tmp_path):
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    for name in ("lintel", "tests"):
        shutil.copytree(ROOT / name, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    code = [sys.executable, "-B", "-m", "pytest", "tests", "-q", "-p", "no:cacheprovider", "-k", "versions or bounds or options or have_sql or subpackage"]
    out = subprocess.run(code, cwd=tmp_path, capture_output=True, text=True)
    assert out.returncode == 0 and " passed" in out.stdout, out.stdout + out.stderr
