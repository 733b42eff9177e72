"""The entry module where the optional subpackage, its tests or the pipeline aren't there."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SAYS = "import __spark_entry__ as e; q = e.queries(); assert q and not [x for x in q if x == 'pipeline' or x.startswith('op') and x[2].isdigit()]; assert e.oracle_sql().keys() <= q.keys()"


@pytest.mark.parametrize("also", [[], ["corpus_pipeline.py"]])
def test_entry_without_the_subpackage(tmp_path, also):
    there = tmp_path / "repo"
    shutil.copytree(ROOT, there, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", *also))
    assert not (there / "lattica" / "llm").exists()
    run = subprocess.run([sys.executable, "-c", SAYS], cwd=there, capture_output=True, text=True, timeout=120)
    assert run.returncode == 0, run.stderr


def test_other_import_errors_are_not_hidden(tmp_path):
    there = tmp_path / "repo"
    shutil.copytree(ROOT, there, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm"))
    (there / "corpus_pipeline.py").write_text("import not_a_module\n")
    run = subprocess.run([sys.executable, "-c", SAYS], cwd=there, capture_output=True, text=True, timeout=120)
    assert run.returncode and "not_a_module" in run.stderr
