"""The entry points with and without the training-data part."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
ASK = "import __spark_entry__ as e; print(*sorted(e.queries())); print(*sorted(e.oracle_sql()))"


@pytest.mark.parametrize("left", [(), ("corpus_pipeline.py",)])
def test_answers_without_the_training_data_part(tmp_path, left):
    for name in ("__spark_entry__.py", *left):
        if os.path.exists(os.path.join(ROOT, name)):
            shutil.copy(os.path.join(ROOT, name), tmp_path)
    shutil.copytree(os.path.join(ROOT, "epiflux"), tmp_path / "epiflux", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    done = subprocess.run([sys.executable, "-c", ASK], cwd=tmp_path, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    names, oracles = (line.split() for line in done.stdout.splitlines())
    assert "gaussian_smooth" in names and set(oracles) <= set(names)
    assert not any(name == "pipeline" or name.startswith("op") and "_" in name and name[2].isdigit() for name in names)
