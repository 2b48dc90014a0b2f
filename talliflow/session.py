"""Session helpers: table loading and checkpointing."""

from __future__ import annotations

import atexit
import contextlib
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One Parquet table of a test-data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows of a scan in as many partitions as there are cores, if they come in fewer than half as many.

    A table of one large row group would otherwise leave all cores but one idle in a stage whose cost is Python. Large tables have more
    partitions than cores and stay as they are.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores / 2 else rows


def shared_path(spark: SparkSession, name: str) -> str:
    """A path for a written table in the folder that all executors share, ``spark.checkpoint.dir``.

    Tables of an application stand in one folder, which is deleted when the application ends, as results may be read until
    then. Where the setting is absent a temporary folder is used, on one machine only: on a cluster no executor could read what another wrote.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not base:
        if not context.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        global _LOCAL
        _LOCAL = base = _LOCAL or tempfile.mkdtemp(prefix="spark-shared-")
    folder = f"{base.rstrip('/')}/tables-{context.applicationId}"
    if folder not in _CLEARED:
        _CLEARED.add(folder)
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        atexit.register(_clear, path.getFileSystem(context._jsc.hadoopConfiguration()), path)
    return f"{folder}/{name}"


def _clear(files, path) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone, as after a crash; the folder's owner clears then
        files.delete(path, True)


_LOCAL: str | None = None
_CLEARED: set[str] = set()


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, whose Python workers unpickle functions of it by name."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = Path(__file__).resolve().parent
        archive = shutil.make_archive(f"{tempfile.mkdtemp()}/{root.name}", "zip", root.parent, root.name)
        spark.sparkContext.addPyFile(archive)
        _SHIPPED.add(app)
