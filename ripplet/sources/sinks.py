"""Encoded images as files of their own, or packed into few large ones."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplet.sources.shared import file_system


def write_table(files: DataFrame, path: str) -> None:
    """``files(image_id, content)`` as a Parquet table, the form for many images."""
    files.write.mode("overwrite").parquet(path)


def _shared(spark: SparkSession, path: str) -> None:
    """Refuse a path that each executor would take for one on its own disk."""
    if "://" not in path and not path.startswith("file:") and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError(f"{path}: name the file system, executors have disks of their own")


def write_files(files: DataFrame, path: str, suffix: str = "jp2") -> None:
    """One file for each image, ``<image_id>.<suffix>`` under a shared folder of any file system that Arrow writes to; outside local mode the path needs a scheme."""
    _shared(files.sparkSession, path)

    def write(rows) -> None:
        system, root = file_system(path)
        system.create_dir(root, recursive=True)
        for r in rows:
            with system.open_output_stream(f"{root}/{r.image_id}.{suffix}", compression=None) as out:
                out.write(bytes(r.content))

    files.select(F.col("image_id"), F.col("content")).foreachPartition(write)


def write_packs(files: DataFrame, path: str) -> DataFrame:
    """Many images in one file for each task: ``(image_id, path, start, size)``, where each image lies.

    A pack is named after the task attempt that wrote it and counts only where a row names it. The rows
    are a table in the folder, so an image is written once.
    """
    _shared(files.sparkSession, path)
    kind = "image_id long, path string, start long, size long"

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, out, at = TaskContext.get(), None, 0
        system, root = file_system(path)
        name = f"{path}/packs/{task.partitionId():05d}-{task.taskAttemptId()}.pack"
        for batch in batches:
            if out is None:
                system.create_dir(f"{root}/packs", recursive=True)
                out = system.open_output_stream(file_system(name)[1], compression=None)
            starts, sizes = [], []
            for content in batch.column(1).to_pylist():
                out.write(content or b"")
                starts.append(at)
                sizes.append(len(content or b""))
                at += sizes[-1]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([name] * len(sizes)), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64())], ["image_id", "path", "start", "size"])
        if out is not None:
            out.close()

    files.select(F.col("image_id").cast("long").alias("image_id"), "content").mapInArrow(write, kind).write.parquet(f"{path}/places")
    return files.sparkSession.read.schema(kind).parquet(f"{path}/places")
