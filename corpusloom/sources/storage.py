"""Intermediate tables and files in the folder that driver and executors share.

Lineage is cut by writing Parquet under ``spark.checkpoint.dir`` and reading it back, so that a
lost executor costs a re-read and never a recomputation of everything upstream.  Where that
setting is absent and all runs in one local process, as in tests, a temporary folder is made once per application; on a
cluster its absence is an error, since executors would each write to their own disk.
"""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The root for intermediate data: ``spark.checkpoint.dir`` or a folder of our own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        path = tempfile.mkdtemp(prefix="corpusloom-")
        atexit.register(shutil.rmtree, path, ignore_errors=True)
        _OWN[app] = f"file://{path}"
    return _OWN[app]


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path under the shared folder that no other call uses."""
    return f"{shared_dir(spark)}/corpusloom/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return the table read back."""
    spark = df.sparkSession
    path = path or fresh_path(spark, name)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, path: str) -> None:
    """Delete an intermediate path through Hadoop, whatever store holds it."""
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


class Scratch:
    """The intermediate tables of one operation, in a folder of their own."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, fresh_path(spark, name)
        self.names: set[str] = set()

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Cut the lineage of ``df`` with a table called ``name``."""
        if name in self.names:
            raise ValueError(f"table {name} is there already")
        self.names.add(name)
        return materialize(df, name, f"{self.root}/{name}")

    def close(self, keep: tuple[str, ...] = ()) -> None:
        """Delete all tables but those that a result still reads."""
        for name in self.names - set(keep):
            discard(self.spark, f"{self.root}/{name}")


_SHIPPED: set[str] = set()


# Texts are long: batches of the default 10,000 rows would take tens of megabytes in the JVM and again in Python.
_BATCHES = {"spark.sql.execution.arrow.maxRecordsPerBatch": "2000", "spark.sql.execution.arrow.maxBytesPerBatch": "16777216"}


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers, unless the environment already does so; Arrow batches get a moderate size."""
    for key, value in _BATCHES.items():
        if key not in spark.sparkContext.getConf().toDebugString():
            spark.conf.set(key, value)
    root = Path(__file__).resolve().parents[2]
    app = spark.sparkContext.applicationId
    if app in _SHIPPED or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    _SHIPPED.add(app)
    folder = tempfile.mkdtemp(prefix="corpusloom-zip-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    archive = f"{folder}/corpusloom.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for f in sorted((root / "corpusloom").rglob("*.py")):
            out.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(archive)
