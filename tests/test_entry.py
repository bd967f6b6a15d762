import shutil
import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry

ROOT = Path(entry.__file__).parent


def test_entry(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and set(df.columns) == {"l_suppkey", "fidelity", "passed_items", "total_items"}


def test_names():
    assert set(entry.oracle_sql()) <= set(entry.queries())


LLM = "plumbline/llm", "tests/llm"


@pytest.mark.parametrize("gone", [LLM, (*LLM, "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_works_without_the_corpus_parts(tmp_path, gone):
    """A copy of the repository without these still imports and has the other queries."""
    shutil.copytree(ROOT, tmp_path / "copy", ignore=shutil.ignore_patterns(".git", "__pycache__", ".*_cache"))
    for name in gone:
        p = tmp_path / "copy" / name
        shutil.rmtree(p) if p.is_dir() else p.unlink()
    code = "import __spark_entry__ as e; q = e.queries(); o = e.oracle_sql(); print(len(q), set(o) <= set(q), any(k.startswith('op') for k in q), 'pipeline' in q)"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "copy", capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"}, check=True)
    n, subset, op, pipe = out.stdout.split()
    assert int(n) > 60 and (subset, op, pipe) == ("True", str("plumbline/llm" not in gone), "False")
    if "plumbline/llm" in gone:
        run = subprocess.run([sys.executable, "-m", "pytest", "--collect-only", "-q", "tests"], cwd=tmp_path / "copy", capture_output=True, text=True)
        assert run.returncode == 0, run.stdout[-2000:]


def test_library_does_not_import_the_corpus_parts():
    for p in (ROOT / "plumbline").rglob("*.py"):
        if "llm" not in p.parts:
            assert "plumbline.llm" not in p.read_text()
