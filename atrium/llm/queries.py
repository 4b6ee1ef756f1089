"""The queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers as tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, common, fingerprints, jaccard, lexical, licenses, merkle, mixing, neighbours, quality, repair, repeats, suffixes, warc


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(_documents(spark, sf_dir))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.new_path(spark, "warc")
    warc.write_warc(warc.archive_records(spark.read.parquet(f"{sf_dir}/pages.parquet")), path)
    full = warc.read_warc(spark, path).where("record_type = 'response'").select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"), "record_type", "refers_to")
    short = warc.read_warc(spark, path, payload=False).where("record_type = 'revisit'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return full.unionByName(short)


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_documents(spark, sf_dir))


def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_classes(_documents(spark, sf_dir))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    return quality.quality_rules(docs, quality.train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_tokens(_documents(spark, sf_dir), tokenizers.path("byte_bpe_multi_50k.tiktoken"), tokenizers.PATTERN, ids=False)


def op7_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.new_path(spark, "token-shards")
    repair.write_shards(_documents(spark, sf_dir), path, tokenizers.path("word_bpe_49k.json"))
    return repair.read_shards(spark, path, ids=False)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_earlier_words(_documents(spark, sf_dir))


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeated_bytes(_documents(spark, sf_dir), shorter=200)


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.merkle_manifest(_documents(spark, sf_dir))


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search_items(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), _documents(spark, sf_dir))


def op13_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest_items(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_fingerprints": op1_fingerprints,
        "op2_warc": op2_warc,
        "op3_licenses": op3_licenses,
        "op4_jaccard": op4_jaccard,
        "op5_quality": op5_quality,
        "op6_bpe": op6_bpe,
        "op7_repair": op7_repair,
        "op8_substring_dedup": op8_substring_dedup,
        "op9_suffix_dedup": op9_suffix_dedup,
        "op10_mixing": op10_mixing,
        "op11_merkle": op11_merkle,
        "op12_lexical": op12_lexical,
        "op13_neighbours": op13_neighbours,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_warc": warc.WARC_SQL, "op10_mixing": mixing.MIX_SQL, "op11_merkle": merkle.MERKLE_SQL, "op12_lexical": lexical.LEXICAL_SQL}
