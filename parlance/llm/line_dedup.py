"""Operator 9, line dedup: exact set-similarity join of lines; later matches go.

A line is the set of its five-word shingles (A-Z folded). Shingles are ordered by rarity; a line's first
n - ceil(t n) + 1 are its prefix, and lines of Jaccard similarity t or more share one of these. Candidates pass the
length filter and the positional filter (what can still follow the two positions must be enough), then their
whole sets are compared. A line goes if an earlier line of any document matches it: order is (doc_id, a hash of the text,
line number), so the first of all matching lines always stays.

Lines of the same words are one from the start, however many copies there are. Each list's earliest member, then for each
member the hub among the earlier ones of its list, is compared with it: pairs linear in the list; a line that matches an
earlier one is settled. Only lines that aren't settled then meet all earlier lines of their lists, in buckets of
partner sizes for which both still look at the list's shingle, so few lists are paired off and no match is lost.

Rarity: sets.Stats says which shingles certainly occur once; they stand first and need no row in the index. The
rest is ordered by an estimated frequency. Tokens are 64-bit hashes, line keys 128 bits.

Lines of one to four words have one shingle, their whole sequence, if Lines.short is set (the query and the
pipeline's stage set it): equal ones match. Without it they are kept and match nothing.

Edge cases: blank lines are kept and match nothing; null and empty texts have one
blank line; rows that repeat doc_id and text are one document and get the same result; null doc_ids come last;
an empty table gives an empty one; other columns are kept (one named like an added column gives way to it).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Shared, bitmap_of, discard, in_bitmap, table, written
from .sets import _MIX, PIECE, STATS, STATS_DDL, Rarity, Stats, bucket, in_batches, merged_stats, met, mixed, overlap, placed_words, reach, shingles, usable

LINE_BITS = 20  # of a line's number in its buffer, in sort keys
MOST_SEEN = 1 << 17  # keys that a task remembers to send a line once; then it begins anew
MOST_LINES = 1 << LINE_BITS  # of a buffer, blank ones too; texts and batches are cut so that no number has more bits


@dataclass(frozen=True)
class Lines:
    words: int = 5
    percent: int = 80
    bitmap_bits: int = 24
    #: Lines of fewer words count too; the query and the stage set it.
    short: bool = False


#: What the query and the stage run: every line with a word can match.
WHOLE = Lines(short=True)


@dataclass
class LineSets:
    """The sets of a buffer's lines, one behind the other, tokens ascending within a line."""

    line: np.ndarray  # numbers of the lines that have a set
    start: np.ndarray  # where each set starts in `tokens`
    size: np.ndarray
    tokens: np.ndarray
    keys: list[bytes]


def _short_lines(line: np.ndarray, words: np.ndarray, k: int, wanted: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Lines of one to k - 1 words and their only shingle, the whole sequence as in sets.shingle_set."""
    first = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
    size = np.diff(np.append(first, len(line)))
    keep = size < k
    if wanted is not None:
        keep &= wanted[line[first]]
    first, size = first[keep], size[keep]
    h = size.astype(np.uint64)
    for i in range(k - 1):
        more = size > i
        h[more] = mixed(h[more] * _MIX[2] + words[first[more] + i])
    return line[first], h


def line_sets(data: bytes, how: Lines, wanted: np.ndarray | None = None) -> LineSets:
    """wanted: a flag for each line; the others are left out."""
    if data.count(b"\n") >= MOST_LINES:
        raise ValueError(f"a buffer of more than {MOST_LINES} lines")
    starts, words = placed_words(data)
    line = np.searchsorted(np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 10), starts)
    n, k = len(words), how.words
    empty = LineSets(*(np.zeros(0, np.int64) for _ in range(3)), np.zeros(0, np.uint64), [])
    of, h = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    if n >= k:
        within = line[: n - k + 1] == line[k - 1 :]
        if wanted is not None:
            within &= wanted[line[: n - k + 1]]
        of, h = line[: n - k + 1][within], shingles(words, k)[within]
    if n and how.short:
        of, h = (np.concatenate(x) for x in zip((of, h), _short_lines(line, words, k, wanted), strict=True))
    if not len(of):
        return empty
    order = np.argsort((of.astype(np.uint64) << np.uint64(64 - LINE_BITS)) | (h >> np.uint64(LINE_BITS)))
    of, h = of[order], h[order]
    start = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
    sums = [np.add.reduceat(mixed(h ^ _MIX[i]), start) for i in (4, 5)]  # a line's key: sums over its shingles, repeats too
    raw = np.column_stack(sums).tobytes()
    keys = [raw[16 * i : 16 * i + 16] for i in range(len(start))]
    new = np.concatenate(([True], (of[1:] != of[:-1]) | (h[1:] != h[:-1])))
    of, tokens = of[new], h[new]
    start = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
    return LineSets(of[start], start, np.diff(np.append(start, len(of))), tokens, keys)


def _cut(data: bytes) -> int:
    """Where a text that is too long for a buffer, or has too many lines, is cut: a newline; -1: it needs no cut or has no newline to cut at."""
    if len(data) <= 8 * PIECE and data.count(b"\n") < MOST_LINES:
        return -1
    ends = np.flatnonzero(np.frombuffer(data, dtype=np.uint8, count=min(len(data), 4 * PIECE)) == 10)
    return int(ends[min(len(ends), MOST_LINES) - 1]) if len(ends) else data.find(b"\n", 4 * PIECE)


def _buffers(ids: list, texts: list[str | None], hashes: list[int]) -> Iterator[tuple[bytes, np.ndarray, list[tuple]]]:
    """Texts of a batch in buffers of about PIECE bytes and at most MOST_LINES lines: the bytes, the first line of each document, and (doc_id, hash, bytes, first line no)."""
    held: list[bytes] = []
    info: list[tuple] = []
    size = lines = 0
    for doc_id, text, h in zip(ids, texts, hashes, strict=True):
        data, base = (text or "").encode(), 0
        while (cut := _cut(data)) >= 0:  # a very long text: pieces cut at a newline
            piece, data = data[:cut], data[cut + 1 :]
            yield piece, np.zeros(1, np.int64), [(doc_id, h, base)]
            base += piece.count(b"\n") + 1
        own = data.count(b"\n") + 1
        if lines + own > MOST_LINES:
            yield _joined(held, info)
            held, info, size, lines = [], [], 0, 0
        held.append(data)
        info.append((doc_id, h, base))
        size, lines = size + len(data) + 1, lines + own
        if size >= PIECE:
            yield _joined(held, info)
            held, info, size, lines = [], [], 0, 0
    if held:
        yield _joined(held, info)


def _joined(held: list[bytes], info: list[tuple]) -> tuple[bytes, np.ndarray, list[tuple]]:
    first = np.concatenate(([0], np.cumsum([x.count(b"\n") + 1 for x in held])))[:-1]
    return b"\n".join(held), first, info


def _places(first: np.ndarray, info: list[tuple], lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a buffer's lines: the document, the number within it, and a hash of both."""
    at = np.searchsorted(first, lines, side="right") - 1
    number = lines - first[at] + np.array([x[2] for x in info], dtype=np.int64)[at]
    own = np.array([x[1] for x in info], dtype=np.int64).view(np.uint64) ^ mixed(np.array([x[0] or 0 for x in info], dtype=np.int64).view(np.uint64))
    return at, number, mixed(own[at] + number.view(np.uint64) * _MIX[3])


def _occurrences(docs: DataFrame, how: Lines) -> tuple[DataFrame, tuple[bytes, bytes], DataFrame]:
    """(doc_id, rh, line, place, key) of each line that has a set, place being a hash of the first three; what is known of
    the tokens; the table behind both. A task's copies of a line count about once, so copies hardly make tokens frequent."""
    schema = pa.schema([("doc_id", pa.int64()), ("rh", pa.int64()), ("line", pa.int64()), ("place", pa.int64()), ("key", pa.binary()), *STATS])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stats, known = Stats(), set()
        for batch in batches:
            for data, first, info in _buffers(*(batch.column(i).to_pylist() for i in range(3))):
                s = line_sets(data, how)
                if not len(s.line):
                    continue
                once = np.fromiter(dict(zip(reversed(s.keys), range(len(s.keys) - 1, -1, -1), strict=True)).values(), np.int64)
                once = once[[s.keys[i] not in known for i in once.tolist()]]
                known = set() if len(known) > MOST_SEEN else known
                known.update(s.keys[i] for i in once.tolist())
                wanted = np.zeros(len(s.line), dtype=bool)
                wanted[once] = True
                stats.add(s.tokens[np.repeat(wanted, s.size)])
                at, number, place = _places(first, info, s.line)
                ids, hashes = pa.array([x[0] for x in info], pa.int64()), pa.array([x[1] for x in info], pa.int64())
                nothing = [pa.nulls(len(at), f.type) for f in STATS]
                if stats.full:
                    yield pa.RecordBatch.from_pylist([*stats.rows()], schema=schema)
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), hashes.take(pa.array(at)), pa.array(number), pa.array(place.view(np.int64)), pa.array(s.keys, pa.binary()), *nothing], schema=schema)
        for row in stats.rows():
            yield pa.RecordBatch.from_pylist([row], schema=schema)

    out = written(docs.select("doc_id", "text", "rh").mapInArrow(measure, "doc_id bigint, rh bigint, line bigint, place bigint, key binary, " + STATS_DDL))
    return out.filter("segment is null").select("doc_id", "rh", "line", "place", "key"), merged_stats(out.filter("segment is not null").select(*STATS.names)), out


def _first_lines(batch: pa.RecordBatch, bitmap: np.ndarray, how: Lines) -> Iterator[LineSets]:
    """The sets of a batch's lines that may be the first of their kind: all that are, and few others."""
    for data, first, info in _buffers(*(batch.column(i).to_pylist() for i in range(3))):
        lines = np.arange(data.count(b"\n") + 1, dtype=np.int64)
        s = line_sets(data, how, in_bitmap(bitmap, _places(first, info, lines)[2]))
        if len(s.line):
            yield s


def _index(docs: DataFrame, firsts: Shared, stats: tuple[bytes, bytes], how: Lines) -> DataFrame:
    """(token, key, n, pos), and a row with `members` for each line that has any."""
    shared = Shared(docs.sparkSession, *stats)  # of fixed size

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rarity, bitmap = Rarity(*shared.get()), np.frombuffer(firsts.get()[0], dtype=np.uint64)
        seen: set[bytes] = set()
        for batch in batches:
            if len(seen) > MOST_SEEN:
                seen = set()
            columns: list[list] = [[], [], [], [], []]
            for s in _first_lines(batch, bitmap, how):
                f = rarity.frequency(s.tokens)
                alone = np.add.reduceat((f == 0).astype(np.int64), s.start)
                prefix = s.size - -(-how.percent * s.size // 100) + 1
                for i in np.flatnonzero(alone < prefix).tolist():
                    if (key := s.keys[i]) in seen:
                        continue
                    seen.add(key)
                    at = slice(s.start[i], s.start[i] + s.size[i])
                    t, n, p = s.tokens[at], int(s.size[i]), int(prefix[i])
                    order = np.lexsort((t, f[at]))[int(alone[i]) : p]
                    k = len(order)
                    for c, v in zip(columns, ([*t[order].view(np.int64).tolist(), 0], [key] * (k + 1), [n] * (k + 1), [*range(int(alone[i]), p), 0], [None] * k + [t.tobytes()]), strict=True):
                        c += v
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["token", "key", "n", "pos", "members"])

    out = written(docs.select("doc_id", "text", "rh").mapInArrow(emit, "token bigint, key binary, n int, pos int, members binary"))
    shared.close()
    return out


def _matching(pairs: DataFrame, sets: DataFrame, how: Lines) -> DataFrame:
    """The keys `late` of the pairs (late, early) that match."""

    def rows(c: dict[str, list]) -> Iterator[tuple]:
        for late, x, y in zip(c["late"], c["sl"], c["se"], strict=True):
            p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            common = overlap(p, q)
            if 100 * common >= how.percent * (len(p) + len(q) - common):
                yield (late,)

    both = pairs.join(sets.toDF("late", "sl"), "late").join(sets.toDF("early", "se"), "early").select("late", "sl", "se")
    return written(both.mapInArrow(in_batches(rows, ["late"], [pa.binary()]), "late binary").distinct())


def _lists(index: DataFrame, firsts: DataFrame, how: Lines) -> DataFrame:
    """The index without rows that can meet nothing, with each line's first place and `deg`: how much its lists hold.
    Lists are counted by partial aggregates and joined back, so that no task must hold a long one."""
    known = index.groupBy("token").agg(F.count("*").alias("size"), F.min("n").alias("least"), F.min("key").alias("k1"), F.max("key").alias("k2")).filter("k1 <> k2").drop("k1", "k2")
    rows = written(index.join(known, "token").filter(reach(F.col("n"), F.col("pos"), F.lit(1), how.percent) >= F.col("least")).select("token", "key", "n", "pos", "size"))
    named = rows.groupBy("key").agg(F.sum("size").alias("deg")).join(firsts.select("key", "first"), "key")
    out = written(rows.drop("size").join(named, "key"))
    discard(rows)
    return out


def _with_earliest(lists: DataFrame) -> DataFrame:
    return lists.join(lists.groupBy("token").agg(F.min(F.struct("first", "key", "n")).alias("p")), "token")


def _with_hub(lists: DataFrame) -> DataFrame:
    """Each member with the earlier one of its list that has the largest degree. The running maximum is taken within
    ranges of doc_id and over the ranges, so a long list is spread."""
    cuts = lists.agg(F.percentile_approx("first.doc_id", [i / 64 for i in range(1, 64)], 1000)).first()[0] or []  # 63 numbers
    part = F.coalesce(F.size(F.filter(F.array(*map(F.lit, sorted(set(cuts)))), lambda c: c < F.col("first.doc_id"))), F.lit(64)) if cuts else F.lit(0)
    dealt = lists.withColumn("part", F.when(F.col("first.doc_id").isNull(), 64).otherwise(part))
    own = F.struct("deg", "key", "n", "first")
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    inside = dealt.withColumn("p", F.max(own).over(before("token", "part").orderBy("first")))
    heads = dealt.groupBy("token", "part").agg(F.max(own).alias("h")).withColumn("q", F.max("h").over(before("token").orderBy("part"))).drop("h")
    return inside.join(heads, ["token", "part"]).withColumn("p", F.greatest("p", "q")).drop("q", "part").filter("p is not null")


def removed_lines(docs: DataFrame, how: Lines = Lines()) -> DataFrame:
    """(doc_id, rh, lines): for each document that loses any, the numbers of its lines that go. `docs`: doc_id, text, rh."""
    lines, stats, _ = _occurrences(docs, how)
    place = F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "rh", "line", "place")
    firsts = written(lines.groupBy("key").agg(F.min(place).alias("first"), F.count("*").alias("copies")))
    bitmap = Shared(docs.sparkSession, bitmap_of(firsts.select(F.col("first.place").alias("key")), how.bitmap_bits).tobytes())  # 2**bitmap_bits bits
    made = _index(docs, bitmap, stats, how)
    bitmap.close()
    lists = _lists(made.filter("members is null").drop("members"), firsts, how)
    sets = written(made.filter("members is not null").select("key", "members").join(lists.select("key").distinct(), "key", "left_semi").dropDuplicates(["key"]))
    discard(made)
    settled, left = None, lists
    for add in (_with_earliest, _with_hub):
        fits = how.percent * F.greatest("n", "p.n") <= 100 * F.least("n", "p.n")
        pairs = add(lists).filter((F.col("p.first") < F.col("first")) & fits).select(F.col("key").alias("late"), F.col("p.key").alias("early")).distinct()
        if settled is not None:
            pairs = pairs.join(settled, "late", "left_anti")
        found, old = _matching(pairs, sets, how), settled
        settled = found if old is None else written(old.unionByName(found))
        if old is not None:
            discard(old, found)
    left = lists.join(settled.toDF("key"), "key", "left_anti")
    more = _matching(_earlier(left, lists, how), sets, how)
    gone = settled.unionByName(more).distinct().select(F.col("late").alias("key"), F.lit(True).alias("gone"))
    known = written(firsts.join(gone, "key", "left").filter("copies > 1 or gone").withColumn("rest", F.struct(*(F.col("first")[c].alias(c) for c in ("doc_id", "rh", "line")))).select("key", "gone", "rest"))
    discard(firsts, lists, sets, settled, more)
    own = F.struct("doc_id", "rh", "line")
    out = lines.join(known, "key").filter(F.col("gone") | ~own.eqNullSafe(F.col("rest")))
    return out.groupBy("doc_id", "rh").agg(F.collect_set("line").alias("lines"))  # a document's own lines


def _earlier(left: DataFrame, lists: DataFrame, how: Lines) -> DataFrame:
    """(late, early): lines that aren't settled with all earlier ones of their lists that may match them."""
    sizes = left.groupBy("token").agg(F.collect_set(bucket(F.col("n"))).alias("sizes"))  # at most some thousands, whatever the list

    def dealt(rows: DataFrame, sizes: DataFrame) -> DataFrame:
        of = F.explode(met(F.col("sizes"), F.col("n"), F.col("pos"), F.lit(1), how.percent))
        return rows.drop("deg").join(sizes, "token").withColumns({"own": bucket(F.col("n")), "of": of}).drop("sizes")

    all_sizes = lists.join(sizes.select("token"), "token", "left_semi").groupBy("token").agg(F.collect_set(bucket(F.col("n"))).alias("sizes"))
    x = dealt(left, all_sizes).select("token", F.col("own").alias("p"), F.col("of").alias("q"), *(F.col(c).alias(f"a_{c}") for c in ("key", "n", "pos", "first")))
    y = dealt(lists, sizes).select("token", F.col("of").alias("p"), F.col("own").alias("q"), *(F.col(c).alias(f"b_{c}") for c in ("key", "n", "pos", "first")))
    one = F.lit(1)
    may: Column = usable(F.col("a_n"), F.col("a_pos"), one, F.col("b_n"), F.col("b_pos"), one, how.percent)
    return x.join(y, ["token", "p", "q"]).filter((F.col("b_first") < F.col("a_first")) & may).select(F.col("a_key").alias("late"), F.col("b_key").alias("early")).distinct()


def dedup(docs: DataFrame, how: Lines = Lines()) -> DataFrame:
    """The input's columns with `kept_text`, `n_lines` and `n_removed`."""
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("rh"))
    gone = removed_lines(keyed, how).select(F.col("rh").alias("_h"), F.coalesce("doc_id", F.lit(0)).alias("_i"), F.col("doc_id").isNull().alias("_x"), F.col("lines").alias("_gone"))
    rows = docs.select(F.struct("*").alias("_doc"), F.xxhash64("text").alias("_h"), F.coalesce("doc_id", F.lit(0)).alias("_i"), F.col("doc_id").isNull().alias("_x"))
    both = rows.join(gone.hint("shuffle_hash"), ["_h", "_i", "_x"], "left").select("_doc", "_gone")
    added = {"kept_text": pa.string(), "n_lines": pa.int64(), "n_removed": pa.int64()}

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pc.fill_null(pc.struct_field(batch.column(0), "text"), "")
            kept, removed = texts.to_pylist() if batch.column(1).null_count < len(batch) else None, [0] * len(batch)
            for i in np.flatnonzero(pc.is_valid(batch.column(1)).to_numpy(zero_copy_only=False)).tolist() if kept is not None else ():
                drop = set(batch.column(1)[i].as_py())
                removed[i] = len(drop)
                kept[i] = "\n".join([x for j, x in enumerate(kept[i].split("\n")) if j not in drop])
            n_lines = pc.add(pc.cast(pc.count_substring(texts, "\n"), pa.int64()), 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), texts if kept is None else pa.array(kept, pa.string()), n_lines, pa.array(removed, pa.int64())], ["_doc", *added])

    schema = T.StructType([both.schema["_doc"], T.StructField("kept_text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())])
    out = both.mapInArrow(cut, schema)
    return out.select(*(F.col("_doc")[c].alias(c) for c in docs.columns if c not in added), *added)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(table(spark, sf_dir, "documents", "doc_id", "text"), WHOLE)
    return out.select("doc_id", "n_lines", "n_removed", F.length("kept_text").cast("bigint").alias("n_chars_kept"), F.sha2("kept_text", 256).alias("kept_sha256"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: texts without the lines that go; a document that keeps nothing goes too, unless it was blank before."""
    named = docs.select(F.struct(*docs.columns).alias("_row"), "doc_id", "text")
    out = dedup(named, WHOLE).filter((F.col("n_removed") == 0) | (F.trim(F.translate("kept_text", "\n\t\r", "   ")) != ""))
    of = {"text": F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("_row")["text"]), "n_chars": F.when(F.col("n_removed") > 0, F.length("kept_text").cast("bigint")).otherwise(F.col("_row")["n_chars"])}
    return out.select(*(of.get(c, F.col("_row")[c]).alias(c) for c in docs.columns))
