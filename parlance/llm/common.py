"""What the operators share: tables, words, written cuts of the lineage."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the contracts name it: U+0020 and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
_made: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def words(text: Column) -> Column:
    """The words of a text as an array; null counts as empty."""
    one_space = F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES))
    return F.array_remove(F.split(one_space, " "), "")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; one is made only where the session names none and there is but one machine."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not configured:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        configured = "file://" + tempfile.mkdtemp(prefix="parlance-")
        spark.conf.set("spark.checkpoint.dir", configured)
    return configured.rstrip("/")


#: Shuffle files of an execution go when it ends, not when the driver happens to collect garbage.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows of an Arrow batch while a table is written: a batch of whole texts stands in the JVM's and in Python's memory.
_ROWS, MOST_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000


@contextlib.contextmanager
def _cleaned(spark: SparkSession) -> Iterator[None]:
    rows = int(spark.conf.get(_ROWS))
    before = {_CLEAN: spark.conf.get(_CLEAN, None), _ROWS: spark.conf.get(_ROWS)}
    spark.conf.set(_CLEAN, "true")
    spark.conf.set(_ROWS, str(min(rows, MOST_ROWS) if rows > 0 else MOST_ROWS))
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def written(df: DataFrame) -> DataFrame:
    """Cuts the lineage: the rows written as a table in the shared folder, read back from there.

    A lost executor then costs no more than the tasks that ran on it. discard() removes the table; what is left goes
    when the driver ends. The shuffle files behind the rows go at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/parlance-{uuid.uuid4().hex}"
    with _cleaned(spark):
        df.write.option("compression", "zstd").parquet(path)
    _made[path] = spark
    out = spark.read.schema(df.schema).parquet(path)
    out.written_at = path
    return out


def discard(*frames: DataFrame | None) -> None:
    """Removes tables that written() made, once nothing reads them any more."""
    for frame in frames:
        path = getattr(frame, "written_at", None) if frame is not None else None
        if path in _made:
            _remove(_made.pop(path), path)


class Shared:
    """Arrays of bytes for all tasks: broadcast compressed, opened once a worker, taken back with close()."""

    def __init__(self, spark: SparkSession, *parts: bytes) -> None:
        self.held = spark.sparkContext.broadcast([zlib.compress(p, 1) for p in parts])
        self.name = uuid.uuid4().hex

    def get(self) -> list[bytes]:
        if self.name not in _open:
            while len(_open) > 1:
                _open.pop(next(iter(_open)))
            _open[self.name] = [zlib.decompress(p) for p in self.held.value]
        return _open[self.name]

    def close(self) -> None:
        self.held.destroy()


_open: dict[str, list[bytes]] = {}


def bitmap_of(keys: DataFrame, bits: int = 24) -> np.ndarray:
    """A bitmap of 2**bits bits with the top bits of each 64-bit `key` set. Its size doesn't depend on the number of
    keys; as more collide it only lets more through."""
    bit = keys.select(F.shiftrightunsigned("key", 64 - bits).alias("bit"))
    packed = bit.groupBy(F.shiftright("bit", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(bit & 63 as int)))").alias("bits"))
    out = np.zeros(1 << (bits - 6), dtype=np.int64)
    got = packed.toPandas()
    out[got["word"].to_numpy(dtype=np.int64)] = got["bits"].to_numpy(dtype=np.int64)
    return out.view(np.uint64)


def in_bitmap(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """For 64-bit keys (uint64): whether their bit is set."""
    bits = int(len(bitmap) * 64).bit_length() - 1
    at = keys >> np.uint64(64 - bits)
    return (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def _remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def drop_written() -> None:
    """Removes all tables that written() made and discard() has not."""
    while _made:
        path, spark = _made.popitem()
        try:
            _remove(spark, path)
        except Exception:  # the session may have ended
            return


atexit.register(drop_written)
