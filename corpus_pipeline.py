"""The corpus pipeline: each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from atrium.llm import bpe, jaccard, mixing, quality, suffixes
from atrium.llm.common import stored

#: (name, function): functions take (spark, docs, sf_dir); all but the last return the columns of documents.
STAGES = [
    ("quality rules", quality.pipeline_stage),
    ("n-gram Jaccard join", jaccard.pipeline_stage),
    ("suffix-array dedup", suffixes.pipeline_stage),
    ("mixing sources", mixing.pipeline_stage),
    ("byte-level BPE", bpe.pipeline_stage),
]

#: SQL can't express the classifier and the tokenizer: tests/llm/test_pipeline.py holds run() against a plain Python version, given the classifier's verdicts.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, name.replace(" ", "-"))
    return docs
