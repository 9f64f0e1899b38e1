"""The queries ``opN_<name>``: each applies its operator, with production parameters, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ripplet.llm import decontam, fingerprint, langid, lexical, linededup, merkle, oracle, packing, pii, quality, secret_scan, sharding, simhash, warc
from ripplet.llm.common import documents, shared_folder


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's fingerprint of four-word shingles, and the component of those within 4 bits. Null and wordless texts have fingerprint zero; repeated rows come out as often as they came in."""
    return simhash.near_duplicates(documents(spark, sf_dir), words=4, radius=4, seed=42)


def op2_subword_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's quality score by a model of the rows outside the held-out fold. Null and empty texts are scored by the model's bias; an id's label is its first one."""
    docs = documents(spark, sf_dir)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), label="quality", sample=6000)
    return quality.score(docs, model, threshold=0.3)


def op3_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents and benchmark items of which a document holds half or more. Null texts hold nothing."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.matches(documents(spark, sf_dir), benchmark, coverage=0.5).drop("th")


def op4_byte_cnn_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's language by a model of the rows outside the held-out fold; `und` without a letter."""
    docs = documents(spark, sf_dir)
    return langid.identify(docs, langid.fit(docs, sample=3000))


def op5_credential_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's base spans of secrets, and the spans that linking adds. Null texts are empty ones."""
    found = secret_scan.scan(documents(spark, sf_dir))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans", "linked")


def op6_pii_deobfuscation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's base spans of personal data, and those that were disguised. Null texts are empty ones."""
    found = pii.scan(documents(spark, sf_dir))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2("base", 256).alias("base_sha256"), "spans", "hidden")


def op7_kk_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens; a null or empty text is its end token."""
    return packing.digest(packing.pack(documents(spark, sf_dir), capacity=2048, end=1))


def op8_bfd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's shard of 24 by the law `bytes`; equal texts stay together, null ones too."""
    return sharding.shard(documents(spark, sf_dir), n_shards=24)


def op9_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's line count and the lines that it loses to near-equal ones. Null texts have no lines."""
    return linededup.report(documents(spark, sf_dir), similarity=0.8)


def op10_simhash_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's fingerprint, that of its edited text, and how alike they are. Null texts are empty ones."""
    return fingerprint.fingerprint_edits(documents(spark, sf_dir), radius=3, every=50)


def op11_geometric_block_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of each benchmark item."""
    return lexical.rank(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), k=10)


def op12_slot_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf, roots and proof of each document, and the check of tampered texts."""
    docs = documents(spark, sf_dir)
    return merkle.manifest(docs, merkle.tampered(docs, every=5))


def op13_two_level_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives of all pages in the shared folder, read back by their index."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return warc.archive(pages, shared_folder(spark, "warc")).drop("url")


QUERIES = [
    op1_simhash_near_dedup, op2_subword_quality, op3_template_decontamination, op4_byte_cnn_language, op5_credential_linking, op6_pii_deobfuscation, op7_kk_packing,
    op8_bfd_sharding, op9_fuzzy_lines, op10_simhash_fingerprints, op11_geometric_block_search, op12_slot_merkle_manifest, op13_two_level_warc,
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return dict(oracle.SQL)
