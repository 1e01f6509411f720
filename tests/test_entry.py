"""The driver imports the entry module from elsewhere: Python-backed
operators must run without the package on the workers' path."""

import subprocess
import sys
from pathlib import Path

REPO = Path(__file__).resolve().parent.parent

SCRIPT = f"""
import importlib.util
from pyspark.sql import SparkSession
spark = (SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2")
         .config("spark.ui.enabled", "false").getOrCreate())
spec = importlib.util.spec_from_file_location("entry_mod", "{REPO}/__spark_entry__.py")
m = importlib.util.module_from_spec(spec)
spec.loader.exec_module(m)
print("entry", m.entry(spark).count())
for name in ("safe_apply", "with_reward"):
    print(name, m.queries()[name](spark, "/root/testdata/sf0.001").count())
"""


def test_entry_runs_from_another_directory(tmp_path):
    out = subprocess.run([sys.executable, "-c", SCRIPT], cwd=tmp_path, capture_output=True, text=True, timeout=600)
    assert out.returncode == 0, out.stderr[-2000:]
    lines = dict(line.split() for line in out.stdout.splitlines() if line.split()[0] in
                 ("entry", "safe_apply", "with_reward"))
    assert int(lines["entry"]) > 0 and int(lines["safe_apply"]) > 0 and int(lines["with_reward"]) > 0
