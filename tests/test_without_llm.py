"""The library works when the training-data add-on is not there."""

import shutil
import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parents[1]


def run(folder, code):
    return subprocess.run([sys.executable, "-c", code], cwd=folder, capture_output=True, text=True)


def test_entry_without_the_add_on(tmp_path):
    shutil.copytree(REPO / "factloom", tmp_path / "factloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    done = run(tmp_path, "import __spark_entry__ as e; q = e.queries(); assert q and set(e.oracle_sql()) <= set(q) and not any(n.startswith('op') and '_' in n and n[2].isdigit() for n in q) and 'pipeline' not in q")
    assert done.returncode == 0, done.stderr


def test_a_broken_add_on_is_not_hidden(tmp_path):
    shutil.copytree(REPO / "factloom", tmp_path / "factloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(REPO / "__spark_entry__.py", tmp_path)
    (tmp_path / "corpus_pipeline.py").write_text("import a_module_that_is_missing\n")
    assert "a_module_that_is_missing" in run(tmp_path, "import __spark_entry__").stderr
