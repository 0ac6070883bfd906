"""Folders for stored indexes that a plan reads again.

They lie below the folder that ``spark.checkpoint.dir`` names, which a cluster's nodes share;
a session on one machine without that setting uses a folder of its own process.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import SparkSession

_OWN: list[tempfile.TemporaryDirectory] = []
_MADE: list[tuple[SparkSession, str]] = []


def folder(spark: SparkSession, name: str) -> str:
    """A new path, removed when the process ends."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        if not _OWN:
            _OWN.append(tempfile.TemporaryDirectory(prefix="tessera-"))
        root = "file://" + _OWN[0].name
    path = f"{root.rstrip('/')}/tessera/{name}-{uuid.uuid4().hex}"
    _MADE.append((spark, path))
    return path


@atexit.register
def _sweep() -> None:
    for spark, path in _MADE:
        with contextlib.suppress(Exception):  # the session may be gone already
            p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
