"""Operator 11, a prefix trie of conversations, merged family first.

A family is a base conversation and those whose ids share it (c - c % 5). Families are cogrouped by base id: one exchange
brings a family's turns together, the base's first. Each conversation is rebuilt (the base's first h turns, then its own
behind its first h) and walked into the family's small trie. Only the family's combined nodes are shuffled on, to be
merged by prefix.

A prefix is named by a chain of 128-bit hashes over its turns' SHA-256 digests; texts stay where they are read.
Subtree sums go through the families as well: each merged node is counted in the family of its smallest member, folded
up that family's trie from its deepest level, and the parts are summed by node. So no prefix, however common, brings
its conversations together, and a task holds a family's shared levels and its current path, not whole conversations.

The digest of a node's ends is one SHA-256 over a sorted list, which can't be split: the list is written in pieces by
tasks that each take a range of it, and only the pieces pass through one task, one at a time.

Edge cases: null roles and texts are empty; turns that tie (null turns too) go by their digest, so repeated rows are
turns of their own; rows without a conv_id belong to no conversation; a conversation that ends up without turns
ends at the root; an empty table has no nodes; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, table, written


@dataclass(frozen=True)
class Families:
    #: Ids with the same id - id % `ids` are a family.
    ids: int = 5
    #: A conversation takes crc32(its id) % `heads` turns of its base; levels below `heads` are merged in the family.
    heads: int = 9
    #: Bytes of a piece of a node's ends.
    piece: int = 1 << 20
    #: Parents with at least this share of all children (1 / `hot`, so `hot` of them at most) are broadcast.
    hot: int = 4096


ROOT = bytes(16)
_TURN = "base bigint, conv_id bigint, digest binary, n_bytes bigint"
_NODE = "base bigint, key binary, parent binary, depth bigint, first bigint, n bigint, n_bytes bigint, ends array<bigint>"
_ARROW = {"bigint": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<bigint>": pa.list_(pa.int64())}
#: Rows of a batch that a task sends.
BATCH = 8192


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    fields = [x.split() for x in ddl.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, type=_ARROW[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], [name for name, _ in fields])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def _sent(rows: Iterator[tuple], ddl: str) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) == BATCH:
            yield _batch(held, ddl)
            held = []
    yield _batch(held, ddl)


def base_of(conv_id: Column, how: Families) -> Column:
    return (conv_id - conv_id % how.ids).cast("bigint")


def turns_of(conversations: DataFrame, how: Families) -> DataFrame:
    """(base, conv_id, digest, n_bytes) in the order in which families are walked; one exchange by base."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    said = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    t = conversations.filter("conv_id is not null").select(base_of(F.col("conv_id"), how).alias("base"), F.col("conv_id").cast("bigint").alias("conv_id"), "turn", F.unhex(F.sha2(said, 256)).alias("digest"), F.octet_length(text).cast("bigint").alias("n_bytes"))
    dealt = t.repartition("base").sortWithinPartitions("base", F.col("conv_id") != F.col("base"), "conv_id", F.col("turn").asc_nulls_first(), "digest")
    return dealt.select(*(x.split()[0] for x in _TURN.split(", ")))


class _Family:
    """A family's trie down to the levels that its members share by being rebuilt; deeper nodes go out as they come."""

    def __init__(self, base: int, how: Families) -> None:
        self.base, self.how = base, how
        self.head: list[tuple[bytes, int]] = []
        self.shared: dict[bytes, list] = {}
        self.conv: int | None = None
        self.deep: list | None = None

    def open(self, conv: int) -> Iterator[tuple]:
        yield from self.end()
        self.conv, self.at = conv, 0
        self.skip = 0 if conv == self.base else zlib.crc32(str(conv).encode()) % self.how.heads
        self.key, self.depth = ROOT, 0
        self._visit(None, 0)
        for digest, n_bytes in self.head[: self.skip]:
            yield from self._step(digest, n_bytes)

    def turn(self, digest: bytes, n_bytes: int) -> Iterator[tuple]:
        if self.conv == self.base and len(self.head) < self.how.heads - 1:
            self.head.append((digest, n_bytes))
        self.at += 1
        if self.at > self.skip:
            yield from self._step(digest, n_bytes)

    def _step(self, digest: bytes, n_bytes: int) -> Iterator[tuple]:
        if self.deep is not None:
            yield tuple(self.deep)
            self.deep = None
        parent, self.depth = self.key, self.depth + 1
        self.key = hashlib.blake2b(parent + digest, digest_size=16).digest()
        self._visit(parent, n_bytes)

    def _visit(self, parent: bytes | None, n_bytes: int) -> None:
        if self.depth < self.how.heads:
            node = self.shared.setdefault(self.key, [self.base, self.key, parent, self.depth, self.conv, 0, n_bytes, []])
            node[4], node[5] = min(node[4], self.conv), node[5] + 1
        else:
            self.deep = [self.base, self.key, parent, self.depth, self.conv, 1, n_bytes, []]

    def end(self) -> Iterator[tuple]:
        """The current conversation ends at its last node."""
        if self.conv is None:
            return
        (self.shared[self.key] if self.deep is None else self.deep)[7].append(self.conv)
        if self.deep is not None:
            yield tuple(self.deep)
            self.deep = None

    def close(self) -> Iterator[tuple]:
        yield from self.end()
        yield from map(tuple, self.shared.values())


def family_nodes(conversations: DataFrame, how: Families = Families()) -> DataFrame:
    """Each family's nodes: key and parent's key, depth, smallest member, members, bytes of the last text, members that end."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        family: _Family | None = None
        for base, conv, digest, n_bytes in _rows(batches):
            if family is None or family.base != base:
                if family is not None:
                    yield from family.close()
                family = _Family(base, how)
            if family.conv != conv:
                yield from family.open(conv)
            yield from family.turn(digest, n_bytes)
        if family is not None:
            yield from family.close()

    return turns_of(conversations, how).mapInArrow(lambda batches: _sent(walk(batches), _NODE), _NODE)


def merged_nodes(nodes: DataFrame) -> DataFrame:
    """The families' nodes merged by prefix."""
    return nodes.groupBy("key").agg(
        F.min("first").alias("conv_id"), F.sum("n").alias("n_convs"), F.max("depth").alias("depth"), F.max("parent").alias("parent"),
        F.max("n_bytes").alias("n_bytes"), F.sum(F.size("ends")).alias("n_ends"),
    )


_PART = "key binary, n_leaves bigint, saved bigint"


def subtree_parts(nodes: DataFrame, merged: DataFrame, how: Families = Families()) -> DataFrame:
    """(key, n_leaves, saved): what each family adds to the subtree sums of the nodes in it; rows of one key add up.

    A merged node stands once in the family of its smallest member. A leaf is a node at which all its members end."""
    own = merged.select(base_of(F.col("conv_id"), how).alias("base"), "depth", "key", "parent", (F.col("n_convs") == F.col("n_ends")).cast("bigint").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("n_bytes")).alias("saved"))
    links = nodes.select("base", "depth", "key", "parent", F.lit(0).cast("bigint").alias("n_leaves"), F.lit(0).cast("bigint").alias("saved"))
    dealt = own.unionByName(links).repartition("base").sortWithinPartitions("base", F.col("depth").desc())

    def up(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        at: tuple[int, int] | None = None
        level: dict[bytes, list] = {}
        below: dict[bytes, list[int]] = {}

        def close() -> Iterator[tuple]:
            nonlocal below, level
            above: dict[bytes, list[int]] = {}
            for key, (parent, leaves, saved) in level.items():
                more = below.get(key, (0, 0))
                leaves, saved = leaves + more[0], saved + more[1]
                if leaves or saved:
                    yield key, leaves, saved
                    if parent is not None:
                        held = above.setdefault(parent, [0, 0])
                        held[0] += leaves
                        held[1] += saved
            level, below = {}, above

        for base, depth, key, parent, leaves, saved in _rows(batches):
            if at != (base, depth):
                yield from close()
                if at is not None and at[0] != base:
                    below = {}
                at = (base, depth)
            held = level.setdefault(key, [parent, 0, 0])
            held[1] += leaves
            held[2] += saved
        yield from close()

    return dealt.mapInArrow(lambda batches: _sent(up(batches), _PART), _PART)


_PIECE = "key binary, first bigint, ids string"
_ENDS = "key binary, ends_sha256 string"


def ends_digests(nodes: DataFrame, how: Families = Families()) -> DataFrame:
    """(key, ends_sha256) of the nodes at which conversations end."""
    ends = nodes.filter(F.size("ends") > 0).select("key", F.explode("ends").alias("conv_id"))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        key, first, held, size = None, 0, [], 0
        for k, conv in _rows(batches):
            if held and (k != key or size >= how.piece):
                yield key, first, ",".join(held)
                held, size = [], 0
            if not held:
                key, first = k, conv
            held.append(str(conv))
            size += len(held[-1]) + 1
        if held:
            yield key, first, ",".join(held)

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        key, run = None, hashlib.sha256()
        for k, _, ids in _rows(batches):
            if k == key:
                run.update(b",")
            else:
                if key is not None:
                    yield key, run.hexdigest()
                key, run = k, hashlib.sha256()
            run.update(ids.encode())
        if key is not None:
            yield key, run.hexdigest()

    ranged = ends.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id").mapInArrow(lambda batches: _sent(pieces(batches), _PIECE), _PIECE)
    return ranged.repartition("key").sortWithinPartitions("key", "first").mapInArrow(lambda batches: _sent(digests(batches), _ENDS), _ENDS)


def trie(conversations: DataFrame, how: Families = Families()) -> DataFrame:
    """All nodes: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, key (hex)."""
    nodes = written(family_nodes(conversations, how))
    merged = written(merged_nodes(nodes))
    blank = {c: F.lit(None).cast(kind) for c, kind in (x.split() for x in "key binary, conv_id bigint, depth bigint, parent binary, n_convs bigint, n_children bigint, n_leaves bigint, saved bigint, ends_sha256 string".split(", "))}

    def rows(df: DataFrame, **own: Column | str) -> DataFrame:
        return df.select(*((F.col(own[c]) if isinstance(own.get(c), str) else own.get(c, empty)).alias(c) for c, empty in blank.items()))

    figures = (
        rows(merged, key="key", conv_id="conv_id", depth="depth", parent="parent", n_convs="n_convs")
        .unionByName(rows(merged.filter("parent is not null"), key="parent", n_children=F.lit(1).cast("bigint")))
        .unionByName(rows(subtree_parts(nodes, merged, how), key="key", n_leaves="n_leaves", saved="saved"))
        .unionByName(rows(ends_digests(nodes, how), key="key", ends_sha256="ends_sha256"))
        .groupBy("key")
        .agg(*(F.max(c).alias(c) for c in ("conv_id", "depth", "parent", "n_convs", "ends_sha256")), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_children", "n_leaves", "saved")))
    )
    figures = written(figures)
    discard(nodes, merged)
    least = figures.count() // how.hot  # a parent with more children is one of `hot` at most
    parents = figures.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), "n_children").filter("n_children > 0")
    hot = parents.filter(F.col("n_children") > least).drop("n_children")
    rest = parents.filter(F.col("n_children") <= least).drop("n_children")
    found = figures.join(F.broadcast(hot), "parent").unionByName(figures.join(F.broadcast(hot), "parent", "left_anti").join(rest, "parent", "left"))
    return found.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"), F.lower(F.hex("key")).alias("key"),
    )


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")).drop("key")
