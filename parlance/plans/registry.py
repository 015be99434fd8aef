"""How plan modules collect their queries."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def collector() -> tuple[dict, dict, Callable]:
    queries: dict = {}
    oracles: dict[str, str] = {}

    def query(sql: str | None = None, name: str | None = None) -> Callable:
        def add(f: Callable) -> Callable:
            queries[name or f.__name__] = f
            if sql:
                oracles[name or f.__name__] = sql
            return f

        return add

    return queries, oracles, query


def tokenizer_path() -> str | None:
    """The vocabulary is an input: $PARLANCE_TOKENIZER, else a public file where one is installed."""
    if path := os.environ.get("PARLANCE_TOKENIZER"):
        return path
    try:
        import public_tokenizers
    except ImportError:
        return None
    return public_tokenizers.path("byte_bpe_50k.json")
