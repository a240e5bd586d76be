"""A folder that driver and executors share, for what lives as long as the driver."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

_OWN: dict[str, str] = {}


def scratch_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; where that is unset and all runs in one
    process, as in tests, a temporary folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master) is None:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors reach")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return _OWN[app]


def remove_tree(spark: SparkSession, uri: str) -> None:
    """Delete a folder through the file system that Spark uses for it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(uri)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path there, deleted when the driver ends."""
    uri = f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}"

    def drop() -> None:
        try:
            remove_tree(spark, uri)
        except Exception:  # noqa: BLE001 - the session may be gone already
            pass

    atexit.register(drop)
    return uri
