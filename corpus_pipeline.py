"""From raw documents to packed training sequences.

Each stage is one operator over all rows its predecessor kept, written as Parquet and read again in
between. SQL cannot express the classifiers, signatures and tokens, so ``ORACLE_SQL`` is None and
``tests/llm/test_pipeline.py`` compares every stage with a plain version.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ripplet.llm import decontam, langid, linededup, packing, simhash
from ripplet.llm.common import documents, ensure_checkpoint_dir


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no known language go: no letter, or no language with a probability of 0.3."""
    return langid.keep_identified(docs, langid.fit(docs, sample=3000), least=0.3)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-equal lines the first stays; documents of which nothing is left go."""
    return linededup.deduplicated(docs, similarity=0.8)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that are within 4 bits or share 0.8 of their five-word shingles the one with the least id stays."""
    return simhash.keep_one(docs, words=5, radius=4, similarity=0.8)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold at least half of a benchmark item go."""
    return decontam.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), coverage=0.5)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their token ids, in sequences of 2048."""
    return packing.pack(docs, capacity=2048, end=1)


STAGES = [("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("benchmark_leaks", benchmark_leaks), ("sequences", sequences)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; what a stage keeps is written to the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    folder, docs = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4()}", documents(spark, sf_dir)
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}-{name}")
            docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
