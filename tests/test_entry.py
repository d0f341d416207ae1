"""The entry module, with and without the training-data subpackage."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import __spark_entry__ as entry

ROOT = Path(__file__).resolve().parent.parent


def test_contract(spark):
    assert entry.entry(spark).count() >= 1
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_without_training_data_operators(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 100 and not [x for x in q if x.startswith('op') or x == 'pipeline']; e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path / "repo")}, check=True)


def test_nothing_else_imports_them():
    for p in (ROOT / "storyspark").rglob("*.py"):
        if "llm" not in p.parts:
            assert "llm" not in p.read_text(), p
