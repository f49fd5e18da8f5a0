import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SCRIPT = """
import importlib.util, sys
spec = importlib.util.spec_from_file_location("__spark_entry__", sys.argv[1] + "/__spark_entry__.py")
entry = importlib.util.module_from_spec(spec); spec.loader.exec_module(entry)
from pyspark.sql import SparkSession
s = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.sql.session.timeZone", "UTC").getOrCreate()
q, o = entry.queries(), entry.oracle_sql()
assert set(o) <= set(q)
print("ROWS", entry.entry(s).count(), q["p3_found"](s, sys.argv[2]).count())
"""


def test_entry_from_another_folder(tmp_path, sf):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", SCRIPT, ROOT, sf], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    rows = done.stdout.split("ROWS")[-1].split()
    assert done.returncode == 0 and int(rows[0]) > 0 and int(rows[1]) > 0, done.stderr[-2000:]
