"""Corpus pipeline: quality rules, line dedup, n-gram Jaccard join, mixing, BPE; each stage reads what the one before wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from parlance.llm import bpe, jaccard_join, line_dedup, mixing, quality_rules
from parlance.llm.common import written

#: (name, function (spark, docs, sf_dir) -> DataFrame); all but the last return the columns of documents.
STAGES = [
    ("quality_rules", quality_rules.stage),
    ("line_dedup", line_dedup.stage),
    ("jaccard_join", jaccard_join.stage),
    ("mix_sources", mixing.stage),
    ("bpe", bpe.stage),
]
#: The BPE stage has no SQL form; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
