"""The library on a Spark that nobody has configured."""

import os
import subprocess
import sys
from pathlib import Path

SF = "/root/testdata/sf0.001"

SCRIPT = """
import sys
import __spark_entry__
from terrafold.session import local

spark = local(2, "2g")
assert spark.conf.get("spark.checkpoint.dir", None) is None
for name in sys.argv[2:]:
    print(name, __spark_entry__.queries()[name](spark, sys.argv[1]).count())
"""


def plain_spark(tmp_path, *names):
    """Rows of each query in a process whose configuration folder is empty."""
    env = os.environ | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": str(Path(__file__).resolve().parents[1])}
    done = subprocess.run([sys.executable, "-c", SCRIPT, SF, *names], env=env, cwd=tmp_path, capture_output=True, text=True, timeout=600)
    assert done.returncode == 0, done.stderr[-3000:]
    return {k: int(v) for k, v in (line.split() for line in done.stdout.splitlines())}


def test_territory_queries_without_settings(tmp_path):
    rows = plain_spark(tmp_path, "agg5_latest_period", "join9_join10_nearest", "snk8_src28_geojson")
    assert all(n > 0 for n in rows.values())


def test_a_named_folder_is_kept(spark):
    from terrafold.session import checkpoint_dir

    named = spark.conf.get("spark.checkpoint.dir", None)
    assert checkpoint_dir(spark) == (named.rstrip("/") if named else spark.sparkContext.getCheckpointDir())
