"""The driver contract, with and without the training-data operators."""

import os
import shutil
import subprocess
import sys

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_entry_gives_rows(spark):
    df = entry.entry(spark)
    assert df.columns == ["key", "value"] and df.count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_imports_without_the_training_data_operators(tmp_path):
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns("llm", ".git", "corpus_pipeline.py", "__pycache__", ".tmp"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'live_pairs' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q); e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
