import os
import shutil
import subprocess
import sys

import pytest
from conftest import ROOT


@pytest.mark.parametrize("pipeline", [True, False])
def test_without_the_training_data_operators(tmp_path, pipeline):
    """The entry works in a copy without the removable part, whether the pipeline's file is left or not."""
    for name in ("corpusmill", "__spark_entry__.py", "corpus_pipeline.py"):
        if os.path.isdir(f"{ROOT}/{name}"):
            shutil.copytree(f"{ROOT}/{name}", tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif os.path.exists(f"{ROOT}/{name}") and (pipeline or name != "corpus_pipeline.py"):
            shutil.copy(f"{ROOT}/{name}", tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), any(n.startswith('op') or n == 'pipeline' for n in q), set(e.oracle_sql()) <= set(q))"
    env = os.environ | {"PYTHONPATH": str(tmp_path)}
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, check=True).stdout.split()
    assert int(got[-3]) > 40 and got[-2:] == ["False", "True"]
