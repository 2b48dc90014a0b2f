"""The folder of written tables: shared, of one application, and gone with it."""

import os
import subprocess
import sys

import pytest

from talliflow import session


def test_tables_stand_in_the_shared_folder(spark):
    path = session.shared_path(spark, "x")
    assert path.startswith(spark.conf.get("spark.checkpoint.dir")) and spark.sparkContext.applicationId in path


class Cluster:
    """A session of a cluster without the setting."""

    class conf:
        get = staticmethod(lambda k, other: other)

    class sparkContext:
        master = "spark://host:7077"


def test_no_machine_local_folder_on_a_cluster():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.shared_path(Cluster, "x")


def test_tables_go_with_their_application(tmp_path):
    code = """
import sys
from pyspark.sql import SparkSession
from talliflow.session import shared_path
s = SparkSession.builder.master("local[1]").config("spark.ui.enabled", "false").config("spark.checkpoint.dir", sys.argv[1]).getOrCreate()
s.range(3).write.parquet(shared_path(s, "a"))
assert s.read.parquet(shared_path(s, "a")).count() == 3
s.stop()
"""
    subprocess.run([sys.executable, "-c", code, str(tmp_path)], check=True, timeout=120, cwd=os.path.dirname(os.path.dirname(__file__)))
    assert not [x for x in os.listdir(tmp_path) if x.startswith("tables")]
