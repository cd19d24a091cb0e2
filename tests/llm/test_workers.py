import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parents[2]

CODE = """
import sys
sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as e
print("rows", e.queries()["op9_toxicity"](spark, "/root/testdata/sf0.001").count(), e.queries()["op10_ann"](spark, "/root/testdata/sf0.001").count())
"""


def test_workers_find_the_package_from_anywhere(tmp_path):
    """A driver that only extends its own sys.path."""
    import os

    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", CODE.format(root=str(ROOT))], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    assert "rows 200 500" in out.stdout, out.stderr[-2000:]
