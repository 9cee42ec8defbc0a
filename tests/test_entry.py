"""The entry point with and without the training-data folders."""

import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
LIST = "import __spark_entry__ as e; q = e.queries(); print(len(q), len(e.oracle_sql())); assert not any(n.startswith('op') or n == 'pipeline' for n in q)"


@pytest.mark.parametrize("pipeline", [True, False])
def test_queries_without_training_data_folders(tmp_path, pipeline):
    shutil.copytree(ROOT / "kairograph", tmp_path / "kairograph", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    if pipeline and (ROOT / "corpus_pipeline.py").exists():
        shutil.copy(ROOT / "corpus_pipeline.py", tmp_path)
    done = subprocess.run([sys.executable, "-c", LIST], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert done.returncode == 0, done.stderr
