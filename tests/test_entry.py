"""The driver's contract, and that the library stands without the training-data subpackage."""

import os
import shutil
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent


def test_names_match():
    import __spark_entry__

    names = set(__spark_entry__.queries())
    assert "t01_knn_l2" in names and set(__spark_entry__.oracle_sql()) <= names


SMOKE = """
import __spark_entry__ as e
from pyspark.sql import SparkSession
q = e.queries()
assert 't01_knn_l2' in q and 'pipeline' not in q and not any(n.startswith('op') for n in q) and set(e.oracle_sql()) <= set(q)
spark = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').config('spark.sql.shuffle.partitions', '2').getOrCreate()
assert e.entry(spark).count() == 10
assert q['d04_upsert'](spark, '/root/testdata/sf0.001').count() > 0 and q['r01_feed'](spark, '/root/testdata/sf0.001').count() > 0
"""


def test_the_rest_stands_alone(tmp_path):
    """Without the subpackage and the pipeline the other queries are there and run."""
    for f in ROOT.iterdir():
        if f.suffix == ".py" and f.name != "corpus_pipeline.py":
            shutil.copy(f, tmp_path)
    shutil.copytree(ROOT / "quillspark", tmp_path / "quillspark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"PYTHONPATH": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", SMOKE], cwd=tmp_path, env=env, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr[-800:]
