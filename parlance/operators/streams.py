"""Batch forms of stream logic: sequence numbers, blocks, folds of chunks, frames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sequence_number(stream: str, order: str) -> Column:
    return (F.row_number().over(Window.partitionBy(stream).orderBy(order)) - 1).cast("bigint")


def call_index(kind: Column, stream: str, order: str, call: str) -> Column:
    """The running number of tool calls, -1 before the first."""
    return F.sum((kind == call).cast("bigint")).over(Window.partitionBy(stream).orderBy(order)) - 1


def block_index(df: DataFrame, kind: str, stream: str, order: str) -> DataFrame:
    """`block_index`: a number that goes up where the kind changes."""
    w = Window.partitionBy(stream).orderBy(order)
    return df.withColumn("block_index", F.sum(F.coalesce((F.col(kind) != F.lag(kind).over(w)).cast("bigint"), F.lit(0).cast("bigint"))).over(w))


def concat_in_order(order: str, text: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, text))), lambda x: x[text]), "")


def chunked(df: DataFrame, key: str, text: str, size: int) -> DataFrame:
    """(key, seq, content): a text in pieces of `size` code points; an empty one is one empty piece."""
    n = F.greatest(F.ceil(F.length(text) / F.lit(size)), F.lit(1)).cast("int")
    rows = df.select(key, F.explode(F.sequence(F.lit(0), n - 1)).alias("seq"), text)
    return rows.select(key, F.col("seq").cast("bigint").alias("seq"), F.substring(F.col(text), F.col("seq") * size + 1, F.lit(size)).alias("content"))


def sse_frame(event: Column | None, data: Column) -> Column:
    """`event: N` where named, `data: J`, a blank line."""
    plain = F.concat(F.lit("data: "), data, F.lit("\n\n"))
    return plain if event is None else F.concat(F.lit("event: "), event, F.lit("\n"), plain)


SSE_DONE = "data: [DONE]\n\n"


def error_body(message: Column, kind: Column) -> Column:
    return F.to_json(F.struct(F.struct(message.alias("message"), kind.alias("type"), F.lit(None).cast("string").alias("param"), F.lit(None).cast("string").alias("code")).alias("error")), {"ignoreNullFields": "false"})
