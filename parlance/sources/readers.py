"""Sources as DataFrames, batch and streaming; sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.streams import SSE_DONE, sse_frame
from ..streaming.processing import CHUNK

CORPUS = "name string, op string, protocol string, body string, chunks array<string>, tokenizer string, value string, text string, ids array<int>, numbers array<string>, skip_special_tokens boolean, encoding string"


def requests(spark: SparkSession, path: str, protocol: str, streaming: bool = False) -> DataFrame:
    """One JSON request a line, kept as text: (protocol, body). Decoding is the converter's job."""
    reader = spark.readStream if streaming else spark.read
    return reader.text(path).select(F.lit(protocol).alias("protocol"), F.col("value").alias("body"))


def corpus(spark: SparkSession, path: str) -> DataFrame:
    """Cases of a JSONL corpus; bodies and chunks stay JSON text."""
    return spark.read.text(path).select(F.from_json("value", CORPUS).alias("c")).select("c.*")


def chunks(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    return (spark.readStream if streaming else spark.read).schema(CHUNK).json(path)


def mock_backend(spark: SparkSession) -> DataFrame:
    """A stream as a backend would send it."""
    rows = [(1, 0, "ready", None, None, 12, 0, "fp", None), (1, 1, "text", "Hello", 1, None, None, None, None), (1, 2, "text", " there", 1, None, None, None, None), (1, 3, "finish", None, None, None, None, None, "stop")]
    return spark.createDataFrame(rows, CHUNK)


def sse(events: DataFrame, sentinel: bool) -> DataFrame:
    """Events (stream_id, event_seq, event_name, data) as frames (stream_id, event_seq, frame); with a sentinel row a stream."""
    frame = F.when(F.col("event_name").isNull(), sse_frame(None, F.col("data"))).otherwise(sse_frame(F.col("event_name"), F.col("data")))
    out = events.select("stream_id", "event_seq", frame.alias("frame"))
    if not sentinel:
        return out
    done = events.groupBy("stream_id").agg((F.max("event_seq") + 1).alias("event_seq")).select("stream_id", "event_seq", F.lit(SSE_DONE).alias("frame"))
    return out.unionByName(done)


def write_dead_letters(converted: DataFrame, path: str) -> None:
    """Requests that were refused, with kind and detail."""
    converted.filter("error IS NOT NULL").write.mode("append").json(path)
