"""Every training-data query and the pipeline, started from a folder where workers cannot import the package."""

import os
import subprocess
import sys


def test_tasks_need_no_copy_of_the_package(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"""
import sys
sys.path.append({root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", {"file://" + str(tmp_path / "shared")!r}).getOrCreate()
from __spark_entry__ import queries
for name, query in queries().items():
    if name.startswith("op") or name == "pipeline":
        query(spark, "/root/testdata/sf0.001").write.format("noop").mode("overwrite").save()
print("all done")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=900)
    assert "all done" in done.stdout, done.stderr[-2000:]
