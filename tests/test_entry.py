"""The driver's contract, and that the library stands without the llm subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["month", "category", "n"] and df.count() > 0


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_library_without_llm(tmp_path):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns("llm", "corpus_pipeline.py", ".git", "__pycache__"))
    (copy / "listloom" / "llm" / "__pycache__").mkdir(parents=True)  # what a deletion may leave
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 40 and 'pipeline' not in q and not any(k.startswith('op') for k in q); assert e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=copy, check=True)


def test_nothing_imports_llm():
    for p in (ROOT / "listloom").rglob("*.py"):
        if "llm" not in p.relative_to(ROOT).parts:
            assert "llm" not in p.read_text(), p
