"""The entry points with and without the training-data subpackage."""

from __future__ import annotations

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

from tidemark.registry import ORACLE, QUERIES

ROOT = Path(__file__).resolve().parents[1]
ASK = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_training_data(tmp_path, pipeline):
    hidden = shutil.ignore_patterns("llm", "__pycache__")
    shutil.copytree(ROOT / "tidemark", tmp_path / "tidemark", ignore=hidden)
    for name in ["__spark_entry__.py", *(["corpus_pipeline.py"] if pipeline else [])]:
        if (ROOT / name).exists():
            shutil.copy(ROOT / name, tmp_path)
    run = subprocess.run([sys.executable, "-c", ASK], cwd=tmp_path, capture_output=True, text=True, check=True)
    listed, with_sql = (line.split() for line in run.stdout.splitlines())
    assert listed == sorted(QUERIES) and with_sql == sorted(ORACLE)


def test_a_failing_import_is_no_missing_module(tmp_path):
    shutil.copytree(ROOT / "tidemark", tmp_path / "tidemark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    (tmp_path / "corpus_pipeline.py").write_text("import no_such_module\n")
    run = subprocess.run([sys.executable, "-c", ASK], cwd=tmp_path, capture_output=True, text=True)
    assert run.returncode and "no_such_module" in run.stderr
