"""Image files as a stream: new files under a folder become rows of headers or samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplet.plans import codec
from ripplet.sources.codestream import scan_blocks, scan_headers

#: The schema of the ``binaryFile`` source, which a stream must be given.
FILE = "path string, modificationTime timestamp, length long, content binary"


def file_stream(spark: SparkSession, path: str, per_batch: int = 1000) -> DataFrame:
    """``(image_id, path, content)`` of files as they arrive; the id is a hash of the path."""
    files = spark.readStream.format("binaryFile").schema(FILE).option("maxFilesPerTrigger", per_batch).load(path)
    return files.select(F.xxhash64("path").alias("image_id"), "path", "content")


def header_stream(spark: SparkSession, path: str, per_batch: int = 1000) -> DataFrame:
    """Headers and errors of arriving files, a stateless stream."""
    return scan_headers(file_stream(spark, path, per_batch))


def decode_to(spark: SparkSession, path: str, out: str, checkpoint: str, reduce: int = 0, errors: str | None = None):
    """Decode arriving files and append their samples to Parquet, batch by batch; a repeated batch overwrites its own folder.

    With ``errors`` the broken files of a batch go there as ``(image_id, error)``. A batch's files are
    parsed once for both.
    """

    def batch(files: DataFrame, number: int) -> None:
        scanned = scan_blocks(files, reduce).persist()
        levels = scanned.agg(F.max("header.levels")).first()[0] or 0
        codec.decode_scanned(scanned, levels, reduce).write.mode("overwrite").parquet(f"{out}/batch={number}")
        if errors:
            scanned.where("error is not null").select("image_id", "error").write.mode("overwrite").parquet(f"{errors}/batch={number}")
        scanned.unpersist()

    return file_stream(spark, path).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
