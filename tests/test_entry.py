"""The driver's contract, with and without the training-data subpackage."""

import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.abspath(entry.__file__))


def test_names():
    names = entry.queries()
    assert set(entry.oracle_sql()) <= set(names) and "bm25_top10" in names


def test_entry(spark):
    assert entry.entry(spark).columns == ["query_id", "doc_id", "rank", "score"]


def test_without_the_subpackage(tmp_path):
    copy = tmp_path / "copy"
    shutil.copytree(os.path.join(ROOT, "lodestar"), copy / "lodestar", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(os.path.join(ROOT, "__spark_entry__.py"), copy)
    said = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any(n.startswith('op') or n == 'pipeline' for n in e.queries()))"], cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)}, capture_output=True, text=True)
    assert said.stdout.split()[1] == "False" and int(said.stdout.split()[0]) > 50, said.stderr
