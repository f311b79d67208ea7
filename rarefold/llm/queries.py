"""Registered queries of the corpus operators: thin wrappers over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rarefold.llm import captures, collocations, decontaminate, licenses, lmscore, minhash, packing, periodic, quality, repeats, secrets, sharding, tokencount, warc
from rarefold.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str):
    def add(f):
        QUERIES[name] = f
        return f

    return add


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer file; the files are an installed package on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_swap_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json"))


@query("op2_revisit_resolution")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.resolve_revisits(captures.captures(table(spark, sf_dir, "pages")))
    return out.select("record_id", "url", "status", "response_id", F.md5("payload").alias("payload_md5"), F.md5(warc.header_text(F.col("headers"))).alias("headers_md5"))


ORACLES["op2_revisit_resolution"] = captures.SQL


@query("op3_cross_entropy_difference")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return lmscore.cross_entropy_difference(table(spark, sf_dir, "documents"), good)


ORACLES["op3_cross_entropy_difference"] = lmscore.SQL


@query("op4_circulant_minhash")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents")).drop("tkey", "comp")


ORACLES["op4_circulant_minhash"] = minhash.SQL


@query("op5_run_length_index")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digest(table(spark, sf_dir, "documents"))


@query("op6_robust_outliers")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    out = quality.judge(docs, drop_text=True)
    return out.select("doc_id", *quality.STATS, "base_failed", "kept")


@query("op7_viterbi_counts")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokencount.count_tokens(table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


@query("op8_prefix_shards")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(table(spark, sf_dir, "documents"))


@query("op9_seed_alignment")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op10_secret_scan")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan_documents(table(spark, sf_dir, "documents")))


@query("op11_stripe_collocations")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


ORACLES["op11_stripe_collocations"] = collocations.SQL


@query("op13_diagonal_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest(periodic.periodic_runs(table(spark, sf_dir, "documents"), tails=True))


@query("op12_diagonal_licenses")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("spans")
