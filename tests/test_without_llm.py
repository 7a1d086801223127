"""The rest of the repository stands without the training-data folders, with the pipeline file and without it."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
LOOK = """
import __spark_entry__ as e
names = set(e.queries())
assert "bind_span" in names and "pipeline" not in names and not any(n.startswith("op") and n[2].isdigit() for n in names), names
assert set(e.oracle_sql()) <= names
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert set(e.entry(spark).columns) == {"doc_id", "item_id", "char_start", "char_end"}
spark.stop()
"""


@pytest.mark.parametrize("also", ["", "corpus_pipeline.py"])
def test_folders_gone(tmp_path, also):
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", *([also] if also else [])))
    assert not (copy / "lodestone" / "llm").exists() and not (copy / "tests" / "llm").exists()
    done = subprocess.run([sys.executable, "-c", LOOK], cwd=copy, env={"PATH": os.environ["PATH"], "HOME": str(tmp_path), **{k: v for k, v in os.environ.items() if k.startswith("JAVA")}}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-3000:]
