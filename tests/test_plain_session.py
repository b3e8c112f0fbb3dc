"""Streams work in a session that names no shared folder."""

import os
import subprocess
import sys
from pathlib import Path

ROOT = Path(__file__).resolve().parent.parent
CODE = """
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert not spark.sparkContext.getConf().get("spark.checkpoint.dir", None) and not spark.conf.get("spark.checkpoint.dir", None)
"""


def run(code, tmp_path):
    env = {k: v for k, v in os.environ.items() if k not in ("SPARK_CONF_DIR", "PYSPARK_SUBMIT_ARGS")} | {"SPARK_CONF_DIR": str(tmp_path), "PYTHONPATH": str(ROOT)}
    subprocess.run([sys.executable, "-c", CODE + code], cwd=tmp_path, env=env, check=True, timeout=300)


def test_drained_stream(tmp_path):
    run("import __spark_entry__ as e\nassert e.queries()['str_endpoint'](spark, '/root/testdata/sf0.001').count() > 0", tmp_path)
