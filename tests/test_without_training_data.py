"""The library works without its training-data subpackage, whether or not the pipeline's file is left behind."""

import os
import shutil
import subprocess
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import __spark_entry__ as e
names = set(e.queries())
assert len(names) >= 100 and set(e.oracle_sql()) < names and len(e.oracle_sql()) >= 89, names
assert not any(n.startswith("op") and n[2].isdigit() or n == "pipeline" for n in names), names
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert e.entry(spark).count() > 0
"""


@pytest.mark.parametrize("pipeline_left", [True, False])
def test_queries_without_the_subpackage(tmp_path, pipeline_left):
    copy = tmp_path / "copy"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", *([] if pipeline_left else ["corpus_pipeline.py"])))
    assert not (copy / "corpusloom/llm").exists() and (copy / "corpus_pipeline.py").exists() == pipeline_left
    done = subprocess.run([sys.executable, "-c", CODE], cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)}, capture_output=True, text=True, timeout=300)
    assert done.returncode == 0, done.stderr[-2000:]
