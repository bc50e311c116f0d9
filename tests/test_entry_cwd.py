"""The driver contract works from any working directory (package shipped to Python workers)."""

import os
import subprocess
import sys

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

SCRIPT = f"""
import importlib.util
spec = importlib.util.spec_from_file_location("__spark_entry__", {os.path.join(REPO, "__spark_entry__.py")!r})
m = importlib.util.module_from_spec(spec); spec.loader.exec_module(m)
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
s.sparkContext.setLogLevel("ERROR")
print("ROWS", m.queries()["feed_parse"](s, "/root/testdata/sf0.001").count())
"""


def test_queries_from_foreign_cwd(tmp_path):
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=str(tmp_path), capture_output=True, text=True, timeout=600,
                         env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})
    rows = [ln for ln in out.stdout.splitlines() if ln.startswith("ROWS")]
    assert rows and int(rows[0].split()[1]) > 0, out.stderr[-2000:]
