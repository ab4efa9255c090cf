"""Queries on executors that are other processes than the driver."""

import importlib.util
import os
import subprocess
import sys
from pathlib import Path

CODE = """
import sys
from millrace.plans.registry import QUERIES
from millrace.session import session
from millrace.sources import catalog
spark = session("local-cluster[1,1,1024]", 2, **{"spark.executor.memory": "1g"})
for name in ("jdbc_query", "jdbc_join_push_down"):
    print("got", sorted(tuple(r) for r in QUERIES[name](spark, sys.argv[1]).collect()))
rows = [(1, "a'b", 2**40, 1.5, True), (None, None, None, None, None)]
url = catalog.packed_database(spark, {"t": spark.createDataFrame(rows, "k int, s string, b long, x double, y boolean")})
assert sorted(map(tuple, catalog.jdbc(spark, url, "SELECT * FROM t").collect()), key=str) == rows
print("got all")
"""


def test_remote_queries_on_an_executor(tmp_path, sf_dir):
    """A database in the driver's memory would be missing there."""
    (tmp_path / "home").mkdir()
    for p in Path(importlib.util.find_spec("pyspark").origin).parent.iterdir():  # executors log to work in Spark's home
        if p.name != "work":
            (tmp_path / "home" / p.name).symlink_to(p)
    env = os.environ | {"SPARK_HOME": str(tmp_path / "home"), "SPARK_SCALA_VERSION": "2.13", "SPARK_LOCAL_IP": "127.0.0.1", "PYSPARK_PYTHON": sys.executable}
    run = subprocess.run([sys.executable, "-c", CODE, sf_dir], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=240)
    got = [line for line in run.stdout.splitlines() if line.startswith("got")]
    assert len(got) == 3, run.stderr[-3000:]
    assert "ASIA" in got[1] and got[0].count("(") == 3 and got[1].count("(") == 5
