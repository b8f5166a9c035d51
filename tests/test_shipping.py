"""The package reaches the tasks of a session that was started somewhere else."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
CODE = """
import sys
sys.path.insert(0, {root!r})
import __spark_entry__
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
print("rows", __spark_entry__.queries()["e5_smooth"](spark, "/root/testdata/sf0.001").count())
"""


def test_tasks_import_the_package_from_a_foreign_folder(tmp_path):
    from __spark_entry__ import queries

    name = next(n for n in queries() if n.startswith("e6_steps"))
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    code = CODE.format(root=ROOT).replace("e5_smooth", name)
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert out.returncode == 0 and "rows" in out.stdout, out.stderr[-2000:]


def test_a_session_without_any_setting(tmp_path):
    """No folder is named by the configuration: the entry point names one of this machine."""
    (tmp_path / "conf").mkdir()
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"} | {"SPARK_CONF_DIR": str(tmp_path / "conf")}
    code = CODE.format(root=ROOT).replace("e5_smooth", "d2_per_segment")
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=600)
    assert out.returncode == 0 and "rows" in out.stdout, out.stderr[-2000:]
