"""Functions of the package run on workers that do not have it."""

import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent

JOB = f"""
import sys
sys.path.insert(0, {str(ROOT)!r})
import datetime as dt
from pyspark.sql import SparkSession
from tidemark.operators import forecast
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
rows = [("a", dt.date(2024, 1, 1) + dt.timedelta(days=i), float(i % 7)) for i in range(60)]
df = spark.createDataFrame(rows, "k string, date date, value double")
print("status", forecast.fit_harmonic(df, ["k"], forecast.Harmonic(periods=(7,))).first().status)
"""


def test_a_job_from_another_folder(tmp_path):
    done = subprocess.run([sys.executable, "-c", JOB], cwd=tmp_path, capture_output=True, text=True, timeout=180)
    assert "status ok" in done.stdout, done.stderr[-2000:]
