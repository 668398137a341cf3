"""The text operators run on workers that do not have the package."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent.parent

JOB = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
from pyspark.sql import SparkSession
from tidemark.llm import jaccard_join
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
docs = spark.createDataFrame([(1, "a b c d e f"), (2, "A b c d e f"), (3, "x")], "doc_id long, text string")
print("classes", sorted(r.class_id for r in jaccard_join.similar_documents(docs).collect()))
"""


def test_a_job_from_another_folder(tmp_path):
    done = subprocess.run([sys.executable, "-c", JOB], cwd=tmp_path, capture_output=True, text=True, timeout=240)
    assert "classes [1, 1, 3]" in done.stdout, done.stderr[-2000:]
