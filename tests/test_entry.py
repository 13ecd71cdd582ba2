"""The entry without the training-data operators."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAY = "import __spark_entry__ as e; q = e.queries(); assert set(e.oracle_sql()) <= set(q); print(len(q), [n for n in q if n == 'pipeline' or n.startswith('op')])"


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_without_the_subpackage(tmp_path, pipeline):
    """With the subpackage gone, whether or not the pipeline's file is left, all other queries register."""
    from palaver.queries import QUERIES

    shutil.copytree(os.path.join(ROOT, "palaver"), tmp_path / "palaver", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ["__spark_entry__.py", *(["corpus_pipeline.py"] if pipeline and os.path.exists(os.path.join(ROOT, "corpus_pipeline.py")) else [])]:
        shutil.copy(os.path.join(ROOT, name), tmp_path)
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", SAY], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=120)
    assert out.stdout.split(None, 1) == [str(len(QUERIES)), "[]\n"], out.stderr
