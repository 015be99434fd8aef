"""What the similarity joins share: hashed word sets, a frequency sketch of fixed size, connected components."""

from __future__ import annotations

import functools
import hashlib
import math
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, written

_ODD = 0x9E3779B97F4A7C15
_MIX = [np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
PIECE = 1 << 18
#: Longer words are hashed by blake2b: a polynomial modulo 2**64 has known collisions among long strings (from 1,024 letters on).
LONG_WORD = 64
_FOLDED = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


@functools.lru_cache(maxsize=2)
def _letters(fold: bool) -> np.ndarray:
    table = np.array([int.from_bytes(hashlib.blake2b(bytes([i]), digest_size=8).digest(), "little") for i in range(256)], dtype=np.uint64)
    if fold:
        table[65:91] = table[97:123]
    return table


_tables: list[np.ndarray] = [np.zeros(0, np.uint64)] * 2


def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    """The first `size` powers of _ODD and of its inverse, from one pair of tables that grows."""
    if len(_tables[0]) < size:
        n = 1 << max(16, (size - 1).bit_length())
        _tables[:] = (np.cumprod(np.full(n, x, dtype=np.uint64)) for x in (_ODD, pow(_ODD, -1, 2**64)))
    return _tables[0][:size], _tables[1][:size]


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


def _piece_hashes(b: np.ndarray, fold: bool) -> tuple[np.ndarray, np.ndarray]:
    power, inverse = _powers(len(b))
    space = _SPACE[b]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_letters(fold)[b] * power)))
    hashes = mixed((sums[ends] - sums[starts]) * inverse[starts])
    for i in np.flatnonzero(ends - starts > LONG_WORD).tolist():
        word = b[starts[i] : ends[i]].tobytes()
        hashes[i] = int.from_bytes(hashlib.blake2b(word.translate(_FOLDED) if fold else word, digest_size=8).digest(), "little")
    return starts, hashes


def placed_words(data: bytes, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Where a text's words start, and their 64-bit hashes; A-Z folded. A long text is taken in pieces cut at white space."""
    b = np.frombuffer(data, dtype=np.uint8)
    if len(b) <= PIECE:
        return _piece_hashes(b, fold) if len(b) else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64))
    out, at = [], 0
    while at < len(b):
        end = at + PIECE
        while end < len(b):
            gaps = np.flatnonzero(_SPACE[b[max(at, end - PIECE) : end]])
            if len(gaps):
                end = max(at, end - PIECE) + int(gaps[-1]) + 1
                break
            end += PIECE
        starts, hashes = _piece_hashes(b[at:end], fold)
        out.append((starts + at, hashes))
        at = end
    return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def word_hashes(data: bytes, fold: bool = True) -> np.ndarray:
    return placed_words(data, fold)[1]


def shingles(words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of k words, in order: a polynomial of the words' mixed hashes, mixed."""
    n, m = len(words), mixed(words + _MIX[2])
    h = m[: n - k + 1].copy()
    for j in range(1, k):
        h = h * _MIX[3] + m[j : n - k + 1 + j]
    return mixed(h)


def distinct(h: np.ndarray) -> np.ndarray:
    """Sorted and without repeats; several times as fast as numpy's hashing unique on such arrays."""
    h = np.sort(h)
    return h[np.concatenate(([True], h[1:] != h[:-1]))] if len(h) else h


def shingle_set(words: np.ndarray, k: int) -> np.ndarray:
    """The distinct k-word shingles, ascending; with fewer words the whole sequence is the only one."""
    n = len(words)
    if not n:
        return np.zeros(0, dtype=np.uint64)
    if n < k:
        h = np.array([n], dtype=np.uint64)
        for i in range(n):
            h = mixed(h * _MIX[2] + words[i : i + 1])
        return h
    return distinct(shingles(words, k))


def set_key(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


# --- what all documents say about a token, in a fixed size -------------------------------------------------------

SEEN_BITS, CELL_BITS = 27, 24  # bits of the bitmap of tokens seen twice; cells of the counts
SEGMENTS = 128
_BITS, _CELLS = (1 << SEEN_BITS) // SEGMENTS, (1 << CELL_BITS) // SEGMENTS
STATS = pa.schema([("segment", pa.int32()), ("at", pa.binary()), ("counts", pa.binary())])
STATS_DDL = "segment int, at binary, counts binary"


class Stats:
    """One task's tokens: bit numbers and how often each was seen, as lists. What is merged and broadcast has a fixed
    size and doesn't grow with the documents; fuller cells only make rarity less sharp."""

    MOST = 1 << 22  # bit numbers held at a time; once `full`, rows() hands them over

    def __init__(self) -> None:
        self.at, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.uint8)
        self.waiting: list[np.ndarray] = []
        self.n = 0

    @property
    def full(self) -> bool:
        return len(self.at) > self.MOST

    def add(self, tokens: np.ndarray) -> None:
        """Tokens of one set, or of several; each set's are distinct."""
        self.waiting.append((tokens >> np.uint64(64 - SEEN_BITS)).astype(np.uint32))
        self.n += len(tokens)
        if self.n > max(1 << 18, len(self.at) // 2):
            self._merge()

    def _merge(self) -> None:
        if not self.n:
            return
        new = np.sort(np.concatenate(self.waiting))
        self.waiting, self.n = [], 0
        first = np.flatnonzero(np.concatenate(([True], new[1:] != new[:-1])))
        at, counts = np.concatenate((self.at, new[first])), np.concatenate((self.counts, np.minimum(np.diff(np.append(first, len(new))), 255).astype(np.uint8)))
        order = np.argsort(at, kind="stable")  # two ascending runs
        at, counts = at[order], counts[order]
        first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
        self.at, self.counts = at[first], np.minimum(np.add.reduceat(counts, first, dtype=np.uint16), 255).astype(np.uint8)

    def rows(self) -> Iterator[dict]:
        """What is held, by segment: the steps from one bit number to the next, and the counts."""
        self._merge()
        at, counts = self.at, self.counts
        self.at, self.counts = at[:0], counts[:0]
        ends = np.searchsorted(at, np.arange(1, SEGMENTS + 1, dtype=np.int64) * _BITS)
        for i, (x, y) in enumerate(zip(np.concatenate(([0], ends[:-1])), ends, strict=True)):
            if y > x:
                steps = np.diff(at[x:y], prepend=np.uint32(i * _BITS)).astype("<u4")
                yield {"segment": i, "at": zlib.compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes(), 1), "counts": zlib.compress(counts[x:y].tobytes(), 1)}


class Rarity:
    """What the merged statistics say of a token."""

    def __init__(self, cells: bytes, shared: bytes) -> None:
        self.cells, self.shared = np.frombuffer(cells, dtype=np.uint8), np.frombuffer(shared, dtype=np.uint8)

    def frequency(self, tokens: np.ndarray) -> np.ndarray:
        """0: certainly in one set only. Else what the token's cell holds: its frequency or more."""
        at = tokens >> np.uint64(64 - SEEN_BITS)
        more = (self.shared[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1
        code = self.cells[(tokens >> np.uint64(64 - CELL_BITS)).astype(np.int64)].astype(np.float64)
        return np.where(more == 1, np.maximum(np.where(code < 128, code, 128 * 2 ** ((code - 128) / 8)), 2.0), 0.0)


def merged_stats(parts: DataFrame) -> tuple[bytes, bytes]:
    """All tasks' statistics in one: the bitmap of bits seen twice, and for each cell the largest count of its bits (from
    128 on as logarithms), so that tokens seen once don't blur it. Segments are added up as they stream in;
    2**CELL_BITS + 2**SEEN_BITS / 8 bytes come to the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, steps, n in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if i not in held:
                    held[i] = np.zeros(_BITS, np.uint32)
                planes = np.frombuffer(zlib.decompress(steps), dtype=np.uint8).reshape(4, -1)
                at = np.cumsum(np.ascontiguousarray(planes.T).view("<u4").ravel(), dtype=np.int64)
                held[i][at] += np.frombuffer(zlib.decompress(n), dtype=np.uint8)
        for i, counts in held.items():
            cells = counts.reshape(_CELLS, -1).max(axis=1)
            code = np.where(cells < 128, cells, np.minimum(255, 128 + 8 * np.log2(np.maximum(cells, 128) / 128))).astype(np.uint8)
            twice = np.packbits(counts > 1, bitorder="little")
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([code.tobytes()], pa.binary()), pa.array([twice.tobytes()], pa.binary())], ["segment", "cells", "twice"])

    cells, shared = bytearray(1 << CELL_BITS), bytearray(1 << (SEEN_BITS - 3))
    for i, c, t in parts.repartition(SEGMENTS, "segment").mapInArrow(add, "segment int, cells binary, twice binary").toLocalIterator():
        cells[i * _CELLS : (i + 1) * _CELLS], shared[i * _BITS // 8 : (i + 1) * _BITS // 8] = c, t
    return bytes(cells), bytes(shared)


# --- prefixes by the partner's size --------------------------------------------------------------------------


def shared_least(n: Column, m: Column, percent: int) -> Column:
    """The least overlap of two sets of n and m whose Jaccard similarity is `percent` or more."""
    return F.floor((percent * (n + m) + 99 + percent) / F.lit(100 + percent))


def reach(n: Column, pos: Column, level: Column, percent: int) -> Column:
    """The largest partner for which a set of n looks at its token number `pos` (from 0) at that level: larger
    partners must share more, so their prefix is shorter."""
    return F.floor((n - pos + level - 1) * (100 + percent) / F.lit(percent)) - n


def usable(n: Column, i: Column, most_n: Column, m: Column, j: Column, most_m: Column, percent: int) -> Column:
    """Whether a token at i of n and j of m counts for the pair: in both prefixes of the pair's own level and sizes."""
    level = F.least(most_n, most_m)
    both = shared_least(n, m, percent)
    return (percent * F.greatest(n, m) <= 100 * F.least(n, m)) & (i < n - both + level) & (j < m - both + level)


_NARROW, _STEP = 128, 1.008  # sizes up to _NARROW have a bucket of their own, beyond it each is wider by _STEP


def bucket(n: Column) -> Column:
    return F.when(n <= _NARROW, n).otherwise(_NARROW + F.floor(F.log(n / F.lit(_NARROW)) / F.lit(math.log(_STEP)))).cast("int")


def met(size_buckets: Column, n: Column, pos: Column, level: Column, percent: int) -> Column:
    """Of the size buckets that a list holds, those whose sizes may be partners of its member (n, pos, level)."""
    least, most = F.ceil(percent * n / F.lit(100)), F.least(F.floor(100 * n / F.lit(percent)), reach(n, pos, level, percent))
    low = lambda c: F.when(c <= _NARROW, c.cast("double")).otherwise(_NARROW * F.pow(F.lit(_STEP), c - _NARROW) - 1)
    high = lambda c: F.when(c < _NARROW, c.cast("double")).otherwise(_NARROW * F.pow(F.lit(_STEP), c - _NARROW + 1) + 1)
    return F.filter(size_buckets, lambda c: (high(c) >= least) & (low(c) <= most))


# --- connected components ------------------------------------------------------------------------------------


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node reachable from each node of the undirected edges.

    Alternates large-star and small-star steps, each a shuffle of the edges; a written table cuts the lineage.
    A hub's edges are never gathered in one row: its smallest neighbour is an aggregate."""
    now = written(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct())
    if now.isEmpty():
        return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    before = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        old, now = now, written(small.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
        discard(old)
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    out = now.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out.written_at = now.written_at
    return out


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    return len(np.intersect1d(a, b, assume_unique=True))


def in_batches(make: Callable[[dict[str, list]], Iterator[tuple]], names: list[str], kinds: list[pa.DataType]) -> Callable:
    """A mapInArrow function: `make` turns a batch's columns into rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(make({n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=k) for i, k in enumerate(kinds)], names)

    return run
