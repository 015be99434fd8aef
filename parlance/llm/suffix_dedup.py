"""Operator 4, suffix-array dedup: bytes under strings of `length` bytes that also start elsewhere are removed.

Candidates first, without loss. Of each window of `length` bytes, the least hash of its `gram`-byte grams is its anchor
(winnowing): equal windows have equal anchors, so only windows whose anchor is found elsewhere can repeat. Consecutive
windows of one anchor form a context: their bytes, from the first window's start to the last one's end. Contexts with
the same bytes repeat as a whole, however many copies there are; they meet as one row. Windows that repeat within
their own document are found there. What is left are different contexts with a common anchor: one copy
of each is dealt into a shard by its anchor.

In a shard the contexts stand one behind the other, and their suffixes are sorted by induced sorting, to a depth of
`length` bytes. Suffixes are of type S or L; the leftmost S suffixes are sorted recursively by names, and
from them all L, then all S suffixes are induced: bucket by bucket, a queue for each first byte hands over
positions in order, and each puts the position before it at the end of its own byte's queue. Queues hold tuples of
position and preceding byte in blocks; beyond `memory` bytes the blocks go to an unnamed scratch file. The shard itself
and its order stay in memory as arrays, so shards are kept small: one ends before the anchor that would take it
beyond `shard_bytes`, and with the defaults the file isn't reached: this is no external sort, see README. Neighbours in the sorted order whose common prefix reaches `length` bytes repeat.

Contexts of an anchor with more than `hot` different ones are cut into parts by the windows' distance to the anchor. Parts
meet by the bytes that all windows at these distances share. Where even such a core has more than `hot` different parts,
they are dealt by the windows' own 128-bit hashes: that splits any group, so no shard holds an unbounded one.

Edge cases: null and empty texts have no bytes and keep the hash of nothing; texts shorter than `length` keep all;
runs of one byte overlap themselves and go; repeated rows repeat each other; an empty table gives an
empty one; other columns are ignored. Removal may split a code point: what is kept are bytes.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Shared, bitmap_of, in_bitmap, table, written
from .sets import _MIX, _letters, _powers, mixed


@dataclass(frozen=True)
class Spans:
    length: int = 400
    gram: int = 96
    #: Windows of one context at most; contexts of one anchor in a shard at most.
    most_windows: int = 1024
    hot: int = 4000
    shard_bytes: int = 2 << 20
    memory: int = 64 << 20
    #: Bits of the bitmaps of anchors: 16 an anchor, between these powers of two.
    bitmap_bits: int = 24
    most_bitmap_bits: int = 27


# --- windows, anchors, contexts ---------------------------------------------------------------------------------


def _rolling(sums: np.ndarray, inverse: np.ndarray, n: int, width: int) -> np.ndarray:
    """Hashes of the n - width + 1 strings of `width` bytes, from running sums."""
    return mixed((sums[width:] - sums[: n - width + 1]) * inverse[: n - width + 1])


def _least(h: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w consecutive values: suffix minima of one block, prefix minima of the next."""
    n = len(h) - w + 1
    padded = np.concatenate([h, np.full(-len(h) % w, np.iinfo(np.uint64).max, dtype=np.uint64)]).reshape(-1, w)
    before = np.minimum.accumulate(padded, axis=1).ravel()
    after = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[w - 1 : w - 1 + n])


@dataclass
class Contexts:
    anchor: np.ndarray  # uint64
    first: np.ndarray  # first window
    windows: np.ndarray
    same: np.ndarray  # a hash of the context's bytes and length
    inner: np.ndarray  # windows that repeat within the text, ascending, if asked for
    grams: np.ndarray  # hashes of the text's grams
    least: np.ndarray  # each context's least gram


def contexts(b: np.ndarray, how: Spans, inner: bool = False) -> Contexts | None:
    """Of one text; very long ones cost some 60 bytes a byte."""
    n, width = len(b), how.length
    if n < width:
        return None
    size = 1 << max(16, int(n).bit_length())
    power, inverse = _powers(size)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_letters(False)[b] * power[:n])))
    grams, span = _rolling(sums, inverse, n, how.gram), width - how.gram + 1
    least = _least(grams, span)
    cut = np.flatnonzero(np.concatenate(([True], least[1:] != least[:-1])))
    run = np.diff(np.append(cut, len(least)))
    if run.max() > how.most_windows:  # long runs in parts
        parts = -(-run // how.most_windows)
        cut = np.repeat(cut, parts) + how.most_windows * (np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts))
        run = np.diff(np.append(cut, len(least)))
    end = cut + run - 1 + width
    same = mixed((sums[end] - sums[cut]) * inverse[cut]) ^ mixed(run.astype(np.uint64) * _MIX[2] + _at(sums, inverse, cut, width))
    again = _inner(sums, inverse, grams, least, cut, run, width) if inner else np.zeros(0, np.int64)
    return Contexts(mixed(least[cut]), cut, run, same, again, grams, least[cut])  # minima crowd near 0; mixed again they spread over all bits


def _parts(data: bytes, c: Contexts, i: int, how: Spans) -> Iterator[tuple[int, bytes, int]]:
    """Context i cut by the distance from a window's start to its first anchor: the part's first window, its bytes, and a
    hash of the bytes that all windows at these distances hold. Equal windows have equal distances, so they meet by it."""
    a, n, span, step = int(c.first[i]), int(c.windows[i]), how.length - how.gram + 1, max(1, how.length // 12)
    found = np.flatnonzero(c.grams[a : a + n - 1 + span] == c.least[i])
    anchor = found[np.searchsorted(found, np.arange(n))]
    far = (anchor - np.arange(n)) // step
    cut = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (far[1:] != far[:-1]))))
    for x, z in zip(cut.tolist(), [*cut[1:].tolist(), n], strict=True):
        at, low = a + int(anchor[x]), int(far[x]) * step
        core = hashlib.blake2b(data[at - low : at - (min(low + step, span) - 1) + how.length], digest_size=8, salt=low.to_bytes(8, "little")).digest()
        yield x, data[a + x : a + z - 1 + how.length], int.from_bytes(core, "little", signed=True)


def _at(sums: np.ndarray, inverse: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Hashes of the strings of `width` bytes that start at these places."""
    return mixed((sums[at + width] - sums[at]) * inverse[at])


def _inner(sums: np.ndarray, inverse: np.ndarray, grams: np.ndarray, least: np.ndarray, cut: np.ndarray, run: np.ndarray, width: int) -> np.ndarray:
    """Windows that repeat within the text, ascending. Their least gram stands at two places, so only such windows are hashed."""
    span = len(grams) - len(least) + 1
    edge = np.full(span - 1, np.iinfo(np.uint64).max, dtype=np.uint64)
    most = ~_least(np.concatenate((edge, ~least, edge)), span)  # of the windows around a gram, the greatest minimum
    found = np.sort(grams[grams == most])
    twice = found[1:][found[1:] == found[:-1]]
    if not len(twice):
        return np.zeros(0, np.int64)
    maybe = np.flatnonzero(np.repeat(np.isin(least[cut], twice, kind="sort"), run))
    hashes = _at(sums, inverse, maybe, width)
    ordered = np.sort(hashes)
    return maybe[np.isin(hashes, ordered[1:][ordered[1:] == ordered[:-1]], kind="sort")]


# --- induced sorting --------------------------------------------------------------------------------------------


class Queue:
    """Positions in order, in blocks; blocks go to a scratch file while the queues hold more than they may."""

    __slots__ = ("blocks", "owner")

    def __init__(self, owner: Queues) -> None:
        self.blocks: list = []
        self.owner = owner

    def put(self, block: np.ndarray) -> None:
        if len(block):
            self.blocks.append(self.owner.kept(block))

    def take(self) -> np.ndarray:
        got, self.blocks = [self.owner.back(x) for x in self.blocks], []
        return np.concatenate(got) if got else np.zeros(0, np.int64)


class Queues:
    def __init__(self, memory: int) -> None:
        self.left, self.file = memory, None
        self.of = [Queue(self) for _ in range(257)]

    def kept(self, block: np.ndarray) -> np.ndarray | tuple[int, int]:
        if block.nbytes <= self.left:
            self.left -= block.nbytes
            return block
        self.file = self.file or tempfile.TemporaryFile()  # unnamed: gone with the task, never read by another
        at = self.file.seek(0, 2)
        self.file.write(block.tobytes())
        return at, len(block)

    def back(self, x: np.ndarray | tuple[int, int]) -> np.ndarray:
        if isinstance(x, tuple):
            self.file.seek(x[0])
            return np.frombuffer(self.file.read(8 * x[1]), dtype=np.int64)
        self.left += x.nbytes
        return x


def _deal(queues: Queues, letters: np.ndarray, positions: np.ndarray) -> None:
    """Each position to the queue of its letter, order kept."""
    if not len(positions):
        return
    order = np.argsort(letters, kind="stable")
    letters, positions = letters[order], positions[order]
    cut = np.flatnonzero(np.concatenate(([True], letters[1:] != letters[:-1])))
    for a, z in zip(cut, np.append(cut[1:], len(letters)), strict=True):
        queues.of[int(letters[a])].put(positions[a:z])


def induced(s: np.ndarray, small: np.ndarray, seeds: np.ndarray, memory: int) -> np.ndarray:
    """All suffixes of s (values 0 to 256) from its sorted leftmost S suffixes; `small`: which positions are of type S."""
    n = len(s)
    s = s.astype(np.uint16)  # numpy sorts these by radix
    low = Queues(memory)
    _deal(low, s[seeds], seeds)
    left, tails = Queues(memory), Queues(memory)
    _deal(left, s[n - 1 :], np.array([n - 1], dtype=np.int64))  # the last suffix is of type L
    for c in range(257):  # L suffixes, ascending
        while len(batch := left.of[c].take()):
            tails.of[c].put(batch)
            before = batch[batch > 0] - 1
            before = before[~small[before]]
            _deal(left, s[before], before)
        batch = low.of[c].take()
        before = batch[batch > 0] - 1
        before = before[~small[before]]
        _deal(left, s[before], before)
    out: list[np.ndarray] = []
    right = Queues(memory)
    for c in range(256, -1, -1):  # S suffixes, descending; queues hold them from large to small
        mine: list[np.ndarray] = []
        while len(batch := right.of[c].take()):
            mine.append(batch)
            before = batch[batch > 0] - 1
            before = before[small[before]]
            _deal(right, s[before], before)
        large = tails.of[c].take()
        before = large[::-1]
        before = before[before > 0] - 1
        before = before[small[before]]
        _deal(right, s[before], before)
        out += [*mine, large[::-1]]
    return np.concatenate(out)[::-1]


def sorted_suffixes(s: np.ndarray, depth: int, memory: int) -> np.ndarray:
    """The suffixes of s in order of their first `depth` values at least; s ends with its only 0."""
    n = len(s)
    s = s.astype(np.int64)
    differs = s[:-1] != s[1:]
    # type S: smaller than the next suffix; runs take the type of their end
    nxt = np.where(differs, np.arange(n - 1), n)
    nxt = np.minimum.accumulate(nxt[::-1])[::-1]
    small = np.zeros(n, dtype=bool)
    at = np.minimum(nxt, n - 2)
    small[:-1] = s[at] < s[at + 1]
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    if not len(lms):
        return induced(s, small, lms, memory)
    # first pass: leftmost S suffixes by first byte only; induction sorts their substrings
    rough = induced(s, small, lms[np.argsort(s[lms].astype(np.uint16), kind="stable")], memory)
    is_lms = np.zeros(n, dtype=bool)
    is_lms[lms] = True
    ordered = rough[is_lms[rough]]
    end = np.append(lms[1:], n - 1)  # a substring reaches to the next leftmost S suffix
    number = np.zeros(n, dtype=np.int64)
    number[lms] = np.arange(len(lms))
    size = (end - lms + 1)[number[ordered]]
    key = _substring_hashes(s, ordered, size)
    new = np.concatenate(([True], (key[1:] != key[:-1]) | (size[1:] != size[:-1])))
    names = np.zeros(len(lms), dtype=np.int64)
    names[number[ordered]] = np.cumsum(new) - 1
    ranks = _ranked(names, depth)
    return induced(s, small, lms[np.argsort(ranks, kind="stable")], memory)


def _substring_hashes(s: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    power, inverse = _powers(1 << max(16, int(len(s)).bit_length()))
    values = mixed(s.astype(np.uint64) + _MIX[4])
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * power[: len(s)])))
    return (sums[at + size] - sums[at]) * inverse[at]


def _ranked(names: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of a name string's suffixes to `depth` names: names of pairs, again and again while any are equal."""
    rank, step = names, 1
    while step < depth and int(rank.max()) + 1 < len(rank):
        after = np.concatenate((rank[step:] + 1, np.zeros(min(step, len(rank)), np.int64)))[: len(rank)]
        pair = rank * (int(rank.max()) + 2) + after
        order = np.argsort(pair, kind="stable")
        p = pair[order]
        new = np.empty_like(rank)
        new[order] = np.cumsum(np.concatenate(([0], (p[1:] != p[:-1]).astype(np.int64))))
        rank, step = new, step * 2
    return rank


def repeated_starts(pieces: list[bytes], how: Spans) -> list[np.ndarray]:
    """For each piece: the starts of its `length`-byte strings that also start elsewhere in the pieces."""
    width = how.length
    base = np.cumsum([0] + [len(p) + 1 for p in pieces])
    s = np.zeros(int(base[-1]) + 1, dtype=np.int64)
    for a, p in zip(base, pieces, strict=False):  # bytes as 1 to 256, 0 between the pieces
        s[a : a + len(p)] = np.frombuffer(p, dtype=np.uint8).astype(np.int64) + 1
    usable = np.zeros(len(s), dtype=bool)
    for a, p in zip(base, pieces, strict=False):
        usable[a : a + max(0, len(p) - width + 1)] = True
    order = sorted_suffixes(s[:-1], width, how.memory)
    order = order[usable[order]]
    twin = np.zeros(max(len(order) - 1, 0), dtype=bool)
    key = _substring_hashes(s, order, np.full(len(order), width))
    for i in np.flatnonzero(key[1:] == key[:-1]).tolist():
        a, b = int(order[i]), int(order[i + 1])
        twin[i] = bool((s[a : a + width] == s[b : b + width]).all())
    found = np.zeros(len(s), dtype=bool)
    found[order[1:][twin]] = True
    found[order[:-1][twin]] = True
    return [np.flatnonzero(found[a : a + len(p)]) for a, p in zip(base, pieces, strict=False)]


# --- the operator ----------------------------------------------------------------------------------------------

MOST_SENT = 1 << 17  # contexts that a task remembers to send them once; then it begins anew
_OCCURRENCE = "tk binary, row bigint, anchor bigint, same bigint, first bigint, windows int"


def _runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending numbers as runs: first ones and lengths."""
    cut = np.flatnonzero(np.concatenate(([True], np.diff(starts) > 1)))
    return starts[cut], np.diff(np.append(cut, len(starts)))


def _text_key(text: Column) -> Column:
    """A text's name: half its SHA-256."""
    return F.unhex(F.left(F.sha2(text.cast("binary"), 256), F.lit(32)))


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select(_text_key(text).alias("tk"), F.xxhash64("doc_id", text).alias("row"), text.alias("text"))


def _occurrences(docs: DataFrame, how: Spans) -> DataFrame:
    """One row a context; rows without an anchor are runs of windows that repeat within their text."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tk, row, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                c = contexts(np.frombuffer(text.encode(), dtype=np.uint8), how, inner=True)
                if c is None:
                    continue
                first, run = _runs(c.inner) if len(c.inner) else (np.zeros(0, np.int64), np.zeros(0, np.int64))
                n, m = len(c.first), len(first)
                hashes = [pa.concat_arrays([pa.array(x.view(np.int64)), pa.nulls(m, pa.int64())]) for x in (c.anchor, c.same)]
                yield pa.RecordBatch.from_arrays([pa.array([tk] * (n + m), pa.binary()), pa.array([row] * (n + m), pa.int64()), *hashes, pa.array(np.concatenate((c.first, first))), pa.array(np.concatenate((c.windows, run)).astype(np.int32))], ["tk", "row", "anchor", "same", "first", "windows"])

    return written(_texts(docs).mapInArrow(walk, _OCCURRENCE))


def _open_contexts(docs: DataFrame, cold: np.ndarray, hot: np.ndarray, firsts: np.ndarray, how: Spans) -> DataFrame:
    """Contexts whose anchor others have too: their bytes; of a hot anchor by parts. Of a context's copies
    the row named in `firsts` sends it, so that copies add no rows; others pass by chance only."""
    maps = Shared(docs.sparkSession, cold.tobytes(), hot.tobytes(), firsts.tobytes())  # 3 * 2**most_bitmap_bits bits at most
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64())

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["anchor", "same", "bytes", "at", "core"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        few, many, first = (np.frombuffer(x, dtype=np.uint64) for x in maps.get())
        sent: set[tuple[int, int]] = set()
        for batch in batches:
            rows: list[tuple] = []
            sent = set() if len(sent) > MOST_SENT else sent
            size = 0
            for row, text in zip(batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64), batch.column(2).to_pylist(), strict=True):
                data = text.encode()
                c = contexts(np.frombuffer(data, dtype=np.uint8), how)
                if c is None:
                    continue
                is_hot = in_bitmap(many, c.anchor)
                anchors, same = c.anchor.view(np.int64), c.same.view(np.int64)
                for i in np.flatnonzero((is_hot | in_bitmap(few, c.anchor)) & in_bitmap(first, c.same ^ row)).tolist():
                    name = int(anchors[i]), int(same[i])
                    if name in sent:
                        continue
                    sent.add(name)
                    a, n = int(c.first[i]), int(c.windows[i])
                    mine = [(*name, part, at, core) for at, part, core in _parts(data, c, i, how)] if is_hot[i] else [(*name, data[a : a + n - 1 + how.length], None, None)]
                    rows += mine
                    size += sum(len(r[2]) for r in mine)
                    if len(rows) > 20_000 or size > 4 << 20:  # not a batch's worth at once
                        yield made(rows)
                        rows, size = [], 0
            yield made(rows)

    out = written(_texts(docs).mapInArrow(walk, "anchor bigint, same bigint, bytes binary, at int, core bigint"))
    maps.close()
    return out


def _shards(cold: DataFrame, how: Spans) -> DataFrame:
    """(anchor, same, lo, n): runs of windows, counted in their context, that another context has too."""

    def solve(held: list[tuple]) -> pa.RecordBatch:
        rows = []
        for (anchor, same, _), starts in zip(held, repeated_starts([h[2] for h in held], how), strict=True):
            if len(starts):
                rows += [(anchor, same, int(lo), int(n)) for lo, n in zip(*_runs(starts), strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int32()))], ["anchor", "same", "lo", "n"])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        group: list[tuple] = []  # the contexts of one anchor so far
        size = 0
        for row in (r for batch in batches for r in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)):
            if group and row[:2] == group[-1][:2]:
                continue
            if group and row[0] != group[-1][0]:
                if len(group) > 1:  # a single one came through the bitmap by chance
                    more = sum(len(r[2]) for r in group)
                    if held and size + more > how.shard_bytes:  # a shard ends between anchors
                        yield solve(held)
                        held, size = [], 0
                    held += group
                    size += more
                group = []
            group.append(row)
        if len(group) > 1:
            held = held + group
        if held:
            yield solve(held)

    # dealt by anchor once; a context that several tasks sent stands next to its copies and is passed over
    dealt = cold.select("anchor", "same", "bytes")
    return dealt.repartition("anchor").sortWithinPartitions("anchor", "same").mapInArrow(walk, "anchor bigint, same bigint, lo bigint, n int")


def _of_hot(open_: DataFrame, how: Spans) -> DataFrame:
    """(anchor, same, lo, n) of the contexts that were sent by parts. Parts of equal bytes repeat as a whole, different ones
    with a common core go to shards; only cores with more than `hot` different parts are dealt by their windows' hashes."""
    parts = open_.filter("core is not null").withColumn("part", F.xxhash64("bytes"))
    names = written(parts.select("anchor", "same", "at", "core", "part", (F.octet_length("bytes") - (how.length - 1)).alias("n")).distinct())
    kinds = written(names.groupBy("core", "part").agg(F.count("*").alias("c")))
    cores = written(kinds.groupBy("core").agg(F.count("*").alias("k")).filter("k > 1"))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchor, same, at, b in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                k = len(b) - how.length + 1
                yield pa.RecordBatch.from_arrays([pa.array([anchor] * k), pa.array([same] * k), pa.array(range(at, at + k), pa.int64()), pa.array([hashlib.blake2b(b[j : j + how.length], digest_size=16).digest() for j in range(k)], pa.binary())], ["anchor", "same", "lo", "window"])

    whole = names.join(kinds.filter("c > 1"), ["core", "part"]).select("anchor", "same", F.col("at").cast("bigint").alias("lo"), "n")
    few = parts.join(cores.filter(f"k <= {how.hot}"), "core", "left_semi").select(F.col("core").alias("anchor"), F.col("part").alias("same"), "bytes")
    few = _shards(few, how).toDF("core", "part", "lo", "m").join(names, ["core", "part"]).select("anchor", "same", (F.col("at") + F.col("lo")).alias("lo"), F.col("m").alias("n"))
    many = written(parts.join(cores.filter(f"k > {how.hot}"), "core", "left_semi").select("anchor", "same", "at", "bytes").mapInArrow(windows, "anchor bigint, same bigint, lo bigint, window binary").distinct())
    twice = many.groupBy("window").agg(F.count("*").alias("c")).filter("c > 1").select("window")
    return whole.unionByName(few).unionByName(many.join(twice, "window").select("anchor", "same", "lo", F.lit(1).alias("n")))


def repeated_windows(docs: DataFrame, how: Spans = Spans()) -> DataFrame:
    """(tk, lo, n): for each text (by its SHA-256) the runs of window starts that start elsewhere too."""
    occ = _occurrences(docs, how)
    found = occ.filter("anchor is not null")
    kinds = written(found.groupBy("anchor", "same").agg(F.count("*").alias("copies"), F.max("windows").alias("windows"), F.min("row").alias("row")))
    groups = kinds.groupBy("anchor").agg(F.count("*").alias("k")).filter("k > 1")
    groups = written(groups)
    n_anchors, n_open, most = groups.agg(F.count("*"), F.coalesce(F.sum("k"), F.lit(0)), F.coalesce(F.max("k"), F.lit(0))).first()
    size = lambda n: min(max(how.bitmap_bits, (16 * n).bit_length()), how.most_bitmap_bits)
    bits = lambda c: bitmap_of(groups.filter(c).select(F.col("anchor").alias("key")), size(n_anchors))
    senders = kinds.join(groups, "anchor", "left_semi").select(F.col("row").bitwiseXOR(F.col("same")).alias("key"))
    open_ = _open_contexts(docs, bits(f"k <= {how.hot}"), bits(f"k > {how.hot}"), bitmap_of(senders, size(n_open)), how)
    shards = _shards(open_.filter("core is null"), how)
    if most > how.hot:
        shards = shards.unionByName(_of_hot(open_, how))
    whole = kinds.filter("copies > 1").select("anchor", "same", F.lit(0).cast("bigint").alias("lo"), F.col("windows").alias("n"))
    parts = shards.join(kinds.filter("copies > 1").select("anchor", "same"), ["anchor", "same"], "left_anti")
    runs = written(whole.unionByName(parts))
    own = occ.filter("anchor is null").select("tk", F.col("first").alias("lo"), F.col("windows").alias("n"))
    placed = found.drop("windows").join(runs, ["anchor", "same"]).select("tk", (F.col("first") + F.col("lo")).alias("lo"), "n")
    return placed.unionByName(own).distinct()


def removal(docs: DataFrame, how: Spans = Spans()) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept) of every row."""
    runs = repeated_windows(docs, how).groupBy("tk").agg(F.collect_list(F.struct("lo", "n")).alias("runs"))  # a text's own
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("tk", _text_key(F.col("text")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, found in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                data = text.encode()
                kept, at, removed, spans = [], 0, 0, 0
                end = -1
                for lo, z in sorted((r["lo"], r["lo"] + r["n"] - 1 + how.length) for r in found or ()):
                    if lo > end:
                        spans += 1
                        if end >= 0:
                            removed += end - at
                            kept.append((at, end))
                        at = lo
                    end = max(end, z)
                if end >= 0:
                    removed += end - at
                    kept.append((at, end))
                rest, last = [], 0
                for a, z in kept:
                    rest.append(data[last:a])
                    last = z
                left = b"".join([*rest, data[last:]])
                rows.append((doc_id, len(data), removed, spans, hashlib.sha256(left).hexdigest(), left))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return keyed.join(runs, "tk", "left").select("doc_id", "text", "runs").mapInArrow(cut, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, kept binary")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removal(table(spark, sf_dir, "documents", "doc_id", "text")).drop("kept")
