import os
import subprocess
import sys


REPO = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
SCRIPT = """
import sys
sys.path.insert(0, {repo!r})
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[4]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "4")
         .config("spark.checkpoint.dir", {folder!r}).getOrCreate())
import __spark_entry__
for name, query in __spark_entry__.queries().items():
    if name.startswith("op") or name == "pipeline":
        print(name, query(spark, "/root/testdata/sf0.001").count() > 0)
"""


def test_executors_need_no_package(tmp_path):
    """Workers that can't import the package run every query."""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    text = SCRIPT.format(repo=REPO, folder=str(tmp_path / "shared"))
    done = subprocess.run([sys.executable, "-c", text], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=400)
    assert done.returncode == 0, done.stderr[-2000:]
    said = done.stdout.split()
    assert said.count("True") == 11 and "False" not in said
