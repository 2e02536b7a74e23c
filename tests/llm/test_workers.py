"""All queries of this package in a session whose Python workers cannot import it."""

import os
import subprocess
import sys
from pathlib import Path

import pytest

REPO = Path(__file__).resolve().parents[2]
DATA = Path(os.environ.get("WORKERS_SF_DIR", "/root/testdata/sf0.001"))

SCRIPT = """
import sys, time
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "2")
         .config("spark.default.parallelism", "2").config("spark.ui.enabled", "false")
         .config("spark.driver.memory", "6g").config("spark.checkpoint.dir", sys.argv[3]).getOrCreate())
spark.sparkContext.setLogLevel("OFF")

def importable(_):
    import importlib.util
    return [importlib.util.find_spec("voicelode") is not None]

assert spark.sparkContext.parallelize([0], 1).mapPartitions(importable).collect() == [False]
sys.path.insert(0, sys.argv[1])
import corpus_pipeline
from voicelode.llm import queries
failed = []
for name, query in (queries.QUERIES | {"pipeline": corpus_pipeline.run}).items():
    if len(sys.argv) > 4 and name not in sys.argv[4:]:
        continue
    start = time.time()
    try:
        query(spark, sys.argv[2]).write.format("noop").mode("overwrite").save()
        print("ran", name, round(time.time() - start, 1), flush=True)
    except Exception as problem:
        failed.append(name)
        lines = [line for line in str(problem).splitlines() if "Error" in line]
        print("failed", name, (lines or [str(problem)])[:3], flush=True)
sys.exit(bool(failed))
"""


@pytest.mark.skipif(not DATA.exists(), reason="no test data")
def test_workers_do_not_need_the_package(tmp_path):
    # the workers' search path is the environment's and the working folder
    path = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p and Path(p).resolve() != REPO]
    done = subprocess.run(
        [sys.executable, "-c", SCRIPT, str(REPO), str(DATA), str(tmp_path / "scratch")],
        cwd=tmp_path, env=os.environ | {"PYTHONPATH": os.pathsep.join(path)}, capture_output=True, text=True,
    )
    assert done.returncode == 0, done.stdout + done.stderr[-2000:]
    assert done.stdout.count("ran ") == 14
