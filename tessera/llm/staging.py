"""Intermediate tables that outlive an executor.

Iterative operators cut their lineage by writing a Parquet table below the folder that
``spark.checkpoint.dir`` names, which every executor and the driver share.  Where the
setting is absent a session on this machine alone (unit tests) uses a folder of its own, and
any other is refused.  Operators drop what they no longer read; the rest of a driver process
is removed when it ends.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_FALLBACK: dict[str, str] = {}
_LEFT: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder shared by the cluster; one of this process where none is configured."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _FALLBACK:
        _FALLBACK["dir"] = tempfile.mkdtemp(prefix="tessera-checkpoint-")
    return "file://" + _FALLBACK["dir"]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a staged table."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def _sweep() -> None:
    for spark, path in _LEFT:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001 - the session may be gone already
            continue


class Stage:
    """Named staged tables of one operator run; ``drop`` frees those no longer read."""

    def __init__(self, spark: SparkSession, operator: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tessera/{operator}-{uuid.uuid4().hex}"
        _LEFT.append((spark, self.root))

    def put(self, name: str, df: DataFrame) -> DataFrame:
        """Write ``df`` and return it as read back, with its lineage cut."""
        path = f"{self.root}/{name}"
        df.write.mode("overwrite").option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        remove(self.spark, f"{self.root}/{name}")

    def keep(self, *names: str) -> None:
        """Delete all tables but those named."""
        jvm = self.spark.sparkContext._jvm
        root = jvm.org.apache.hadoop.fs.Path(self.root)
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for status in fs.listStatus(root):
            if status.getPath().getName() not in names:
                fs.delete(status.getPath(), True)
