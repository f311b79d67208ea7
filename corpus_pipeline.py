"""The corpus pipeline: quality, near duplicates, benchmark passages, secrets, packing.

Every stage works on all rows its predecessor kept and returns the columns of documents; the last one
returns the packed pieces. Stages are written to the shared checkpoint folder and reread.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rarefold.llm import decontaminate, minhash, packing, quality, secrets
from rarefold.llm.common import staged, table
from rarefold.llm.queries import tokenizer_file


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the robust outlier test."""
    return quality.keep_good(docs)


#: 38 bands of 5 miss a pair at similarity 0.80 with probability 3e-7; op 4's own contract is 0.85.
NEAR = minhash.NearDuplicates(percent=80, bands=38)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, linked from similarity 0.80 on."""
    return minhash.deduplicate(docs, NEAR)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets replaced by a mark and n_chars recounted."""
    return secrets.redact_documents(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: the training sequences."""
    return packing.pack_documents(docs, tokenizer_file("word_bpe_49k.json"))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can express neither the covariance estimate nor the tokenizer; tests hold each stage against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
