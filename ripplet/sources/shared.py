"""Folders that all executors see, and files in them read by ranges."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path below ``spark.checkpoint.dir``; where that is unset, a temporary one in local mode, an error on a cluster."""
    below = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not below and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir: name a folder that all executors share")
    return f"{below or tempfile.mkdtemp(prefix='spark-')}/{name}-{uuid.uuid4()}"


def file_system(path: str):
    """Arrow's file system of a path or URI, and the path in it."""
    from pyarrow import fs

    if local := re.match(r"file:/*(/.*)", path):
        return fs.LocalFileSystem(), local[1]
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
