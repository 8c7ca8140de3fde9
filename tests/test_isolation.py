"""The library stands without its pipeline subpackage."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
CODE = """
import __spark_entry__ as entry
names, sql = entry.queries(), entry.oracle_sql()
assert len(names) > 50 and sql.keys() <= names.keys() and "pipeline" not in names and not any(n.startswith("op") for n in names)
import tests.test_queries
"""


@pytest.mark.parametrize("with_pipeline", [False, True])
def test_entry_imports_without_the_subpackage(tmp_path, with_pipeline):
    keep = shutil.ignore_patterns("llm", "__pycache__")
    for folder in ("tapeworks", "tests"):
        shutil.copytree(ROOT / folder, tmp_path / folder, ignore=keep)
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if with_pipeline and (ROOT / "corpus_pipeline.py").exists():
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
    done = subprocess.run([sys.executable, "-c", CODE], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
