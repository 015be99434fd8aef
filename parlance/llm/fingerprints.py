"""Operator 7, document fingerprints: a homomorphic multiset hash.

A text's paragraphs (cut at newlines, and behind sentence ends so that a one-line text has several) are hashed
to wide vectors, and the vectors are summed modulo powers of two. The sum doesn't depend on the
paragraphs' order; inserting a paragraph adds its vector, deleting it subtracts it. Two groups of lanes:

* `EQUAL` lanes of 64 bits, uniform: equal sums mean equal multisets but for a chance of about 2**-256;
* `LIKE` lanes of 64 bits, each +1 or -1: the mean square of two texts' lanes, and of their difference,
  estimates |a|, |b| and |a - b| as squared lengths of multisets, so likeness = 1 - |a - b| / (|a| + |b|), an estimate
  known to about 2 / sqrt(LIKE) at worst (RMS error 0.03 on texts of 40 paragraphs). Of texts without repeats it is
  twice the common paragraphs over all paragraphs. Written lanes are as narrow as their values allow.

Texts of equal paragraphs in another order have equal fingerprints: that is the method.

Edge cases: null texts are empty; an empty text has the zero vector, likeness of two empty texts is 1; repeated
rows and ties of doc_id are ordered by text; null doc_ids come last; one row is its own next; an empty table
gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, written

EQUAL, LIKE = 4, 256
_CUT = re.compile(r"(?<=\n)|(?<=[.!?] )")
_DIGEST = (EQUAL * 64 + LIKE) // 8  # bytes of hash a paragraph needs, in one XOF call


def paragraphs(text: str) -> list[str]:
    return [x for x in _CUT.split(text) if x]


class Fingerprint:
    """The sums; `add` and `remove` take paragraphs in any order."""

    __slots__ = ("wide", "like", "n")

    def __init__(self, units: list[str] = ()) -> None:
        self.wide, self.like, self.n = np.zeros(EQUAL, dtype=np.uint64), np.zeros(LIKE, dtype=np.int64), 0
        self.add(list(units))

    def _sums(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = np.frombuffer(b"".join(hashlib.shake_128(u.encode()).digest(_DIGEST) for u in units), dtype=np.uint8).reshape(len(units), _DIGEST)
        wide = np.ascontiguousarray(raw[:, : EQUAL * 8]).view("<u8").sum(axis=0, dtype=np.uint64)
        ones = np.unpackbits(raw[:, EQUAL * 8 :], axis=1).sum(axis=0, dtype=np.int64)
        return wide, 2 * ones - len(units)

    def add(self, units: list[str]) -> Fingerprint:
        if units:
            wide, like = self._sums(units)
            self.wide, self.like, self.n = self.wide + wide, self.like + like, self.n + len(units)
        return self

    def remove(self, units: list[str]) -> Fingerprint:
        if units:
            wide, like = self._sums(units)
            self.wide, self.like, self.n = self.wide - wide, self.like - like, self.n - len(units)
        return self

    def copy(self) -> Fingerprint:
        out = Fingerprint()
        out.wide, out.like, out.n = self.wide.copy(), self.like.copy(), self.n
        return out

    def hex(self) -> str:
        most = int(np.abs(self.like).max())
        width = next(w for w in (1, 2, 4, 8) if most < 1 << (8 * w - 1))  # a function of the sums, so equal sums are written alike
        return (bytes([width]) + self.n.to_bytes(8, "little") + self.wide.astype("<u8").tobytes() + self.like.astype(f"<i{width}").tobytes()).hex()


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    """0 to 1; from the two fingerprints alone. 1 if they are equal, and only then."""
    if a.n == b.n and (a.wide == b.wide).all():
        return 1.0
    apart, x, y = (float((v.astype(np.float64) ** 2).mean()) for v in (a.like - b.like, a.like, b.like))
    return min(max(0.0, 1 - apart / max(x + y, 1.0)), 1 - 1e-9)


def edited(text: str, following: str) -> str:
    """The last third of the text replaced by as much of the beginning of the following one, or all of that."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


def _edit(own: Fingerprint, text: str, following: str) -> tuple[str, Fingerprint]:
    """The edited text and its fingerprint, from the text's by taking out and adding only paragraphs that change."""
    new = edited(text, following)
    keep = len(text) - len(text) // 3
    # paragraphs that end before the cut stay; a cut that looks back two characters can't move
    safe = 0
    for m in _CUT.finditer(text, 0, max(0, keep)):
        safe = m.start()
    return new, own.copy().remove(paragraphs(text[safe:])).add(paragraphs(new[safe:]))


_OUT = "pid int, edge int, doc_id bigint, text string, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _row(doc_id: int | None, text: str, own: Fingerprint, following: str, other: Fingerprint) -> dict:
    new, changed = _edit(own, text, following)
    return {"doc_id": doc_id, "n_chars": len(text), "edited_sha256": hashlib.sha256(new.encode()).hexdigest(), "fingerprint": own.hex(), "edited_fingerprint": changed.hex(), "near_edited": likeness(own, changed), "near_next": likeness(own, other)}


def _schema() -> pa.Schema:
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string(), "double": pa.float64()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in _OUT.split(", "))])


def with_next(docs: DataFrame) -> DataFrame:
    """Each document's figures with the next one's, by descending doc_id.

    Documents are range-partitioned and sorted by doc_id, and every task carries one document to the next. Of each
    partition only the first and the last document are left over: they are written with the rest, and a second,
    small step pairs the last of one partition with the first of the next."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema, pid, held, first = _schema(), None, None, None
        out: list[dict] = []
        for batch in batches:
            for doc_id, text, p in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                text, own, pid = text or "", None, p
                own = Fingerprint(paragraphs(text))
                if held is None:
                    first = (doc_id, text)
                else:
                    out.append({"edge": 0, "pid": pid} | _row(*held, text, own))
                held = (doc_id, text, own)
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            out = []
        if held is not None:
            yield pa.RecordBatch.from_pylist([{"pid": pid, "edge": 1, "doc_id": first[0], "text": first[1]}, {"pid": pid, "edge": 2, "doc_id": held[0], "text": held[1]}], schema=schema)

    dealt = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id").desc_nulls_last())
    dealt = dealt.sortWithinPartitions(F.col("doc_id").desc_nulls_last(), "text").select("doc_id", "text", F.spark_partition_id().alias("pid"))
    done = written(dealt.mapInArrow(walk, _OUT))

    # two rows a partition, however many rows the table has
    order = Window.orderBy("pid")
    heads = done.filter("edge = 1").select("pid", F.col("text").alias("head"))
    tails = done.filter("edge = 2").select("pid", "doc_id", "text")
    edges = tails.join(heads, "pid").withColumn("next", F.coalesce(F.lead(F.struct("head")).over(order), F.first(F.struct("head")).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))))

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _schema()
        for batch in batches:
            for doc_id, text, following in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                text, following = text or "", following or ""
                yield pa.RecordBatch.from_pylist([{"edge": 0} | _row(doc_id, text, Fingerprint(paragraphs(text)), following, Fingerprint(paragraphs(following)))], schema=schema)

    last = edges.select("doc_id", "text", F.col("next.head").alias("head")).mapInArrow(close, _OUT)
    return done.filter("edge = 0").unionByName(last).drop("pid", "edge", "text")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_next(table(spark, sf_dir, "documents", "doc_id", "text"))
