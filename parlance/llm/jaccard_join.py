"""Operator 8, n-gram Jaccard join: adaptive multi-match prefixes, and the classes that its links make.

A document's set: its distinct k-word shingles, ordered by estimated rarity, then hash. Two linked sets of n and m share
o = ceil(t (n + m) / (1 + t)) shingles or more. At level l a set's prefix against a partner of m is its first n - o + l
shingles, and the two prefixes share at least l. Each document takes the level of the least estimated cost: rows in the
index plus candidates, at most (sum of its prefix's frequencies) / l. A pair is verified when it shares min(l, l')
shingles of the prefixes of that level.

Equal sets are one from the start. In each index list the hub, the member with the longest lists, is compared with the
others (linear in the list); what these links connect needs no more pairs. Then, exactly: in lists with more than one
component, members outside the list's largest one meet the members of other components. A list's members
meet only in buckets of partner sizes for which both still look at the list's shingle, so that members of a large group of
near copies which are further from each other than the threshold hardly meet at all: their own edits fill their prefixes.

Set elements are 64-bit hashes; equality of whole sets goes by 128-bit hashes. What is known of shingle frequencies
has a fixed size (sets.Stats) and only steers the order; shingles that certainly occur in one set stand first and need no
row in the index. As the statistics fill up, more rows enter the index, at most the plain prefixes.

Edge cases: null, empty and blank texts have empty sets and link with nothing; fewer words than k: the whole
sequence is one shingle; repeated rows link with each other; a null doc_id is no one's representative unless
all of its class are null; an empty table gives an empty one; other columns are ignored by the join and kept by the stage,
where of rows that are equal in all columns one stays, too.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, Shared, bitmap_of, discard, in_bitmap, table, written
from .sets import STATS, STATS_DDL, Rarity, Stats, bucket, components, in_batches, merged_stats, met, overlap, reach, set_key, shingle_set, usable, word_hashes


@dataclass(frozen=True)
class Join:
    words: int = 4
    percent: int = 85
    most_level: int = 16
    #: How often each list's hub, then that of what is not yet connected, is compared with the others.
    turns: int = 2

    def needed(self, n: int) -> int:
        """Least overlap of a set of n with any similar set."""
        return -(-self.percent * n // 100)

    def shared(self, n: int, m: int) -> int:
        """Least overlap of two similar sets of n and m."""
        return -(-self.percent * (n + m) // (100 + self.percent))

    def links(self, n: int, m: int, common: int) -> bool:
        return 100 * common >= self.percent * (n + m - common)


def _set(text: str | None, how: Join) -> np.ndarray:
    return shingle_set(word_hashes((text or "").encode()), how.words)


def _measured(docs: DataFrame, how: Join) -> tuple[DataFrame, tuple[bytes, bytes], DataFrame]:
    """Rows (doc_id, n, key, rh), what is known of the shingles, from one pass, and the table behind both."""
    schema = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("key", pa.binary()), ("rh", pa.int64()), *STATS])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stats = Stats()
        for batch in batches:
            n, keys = [], []
            for text in batch.column(1).to_pylist():
                s = _set(text, how)
                stats.add(s)
                n.append(len(s))
                keys.append(set_key(s) if len(s) else None)
            if stats.full:
                yield pa.RecordBatch.from_pylist([*stats.rows()], schema=schema)
            nothing = [pa.nulls(len(n), f.type) for f in STATS]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), batch.column(2), *nothing], schema=schema)
        for row in stats.rows():
            yield pa.RecordBatch.from_pylist([row], schema=schema)

    out = written(docs.select("doc_id", "text", "rh").mapInArrow(measure, "doc_id bigint, n bigint, key binary, rh bigint, " + STATS_DDL))
    return out.filter("segment is null").select("doc_id", "n", "key", "rh"), merged_stats(out.filter("segment is not null").select(*STATS.names)), out


def level_of(freq: np.ndarray, n: int, how: Join) -> int:
    """The level of least cost against partners of its own size; freq: of the set's shingles in order."""
    base, most = n - how.shared(n, n), min(how.needed(n), how.most_level)
    sums = np.cumsum(freq[: base + most])
    rows, levels = np.cumsum(freq[: base + most] > 0), np.arange(1, most + 1)
    return int(np.argmin(rows[base + levels - 1] + sums[base + levels - 1] / levels)) + 1


def _index(docs: DataFrame, bits: np.ndarray, stats: tuple[bytes, bytes], how: Join) -> DataFrame:
    """(token, key, n, pos, most): the prefix shingles of each distinct set that others may have too, for its smallest
    partners, who need the longest prefix. A set may stand there more than once."""
    shared = Shared(docs.sparkSession, bits.tobytes(), *stats)  # of fixed size

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = shared.get()
        bitmap, rarity = np.frombuffer(opened[0], dtype=np.uint64), Rarity(*opened[1:])
        for batch in batches:
            wanted = in_bitmap(bitmap, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64))
            tokens, keys, sizes, places, most, seen = [], [], [], [], [], set()
            for text, ok in zip(batch.column(0).to_pylist(), wanted, strict=True):
                if not ok or not len(s := _set(text, how)):
                    continue
                n, f = len(s), rarity.frequency(s)
                if (key := set_key(s)) in seen:
                    continue
                seen.add(key)
                alone, order = int((f == 0).sum()), np.lexsort((s, f))
                top = level_of(f[order], n, how)
                prefix = s[order[alone : n - how.needed(n) + top]]
                if k := len(prefix):
                    tokens.append(prefix.view(np.int64))
                    keys += [key] * k
                    sizes.append(np.full(k, n))
                    places.append(np.arange(alone, alone + k))
                    most.append(np.full(k, top))
            if tokens:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens)), pa.array(keys, pa.binary()), *(pa.array(np.concatenate(x).astype(np.int32)) for x in (sizes, places, most))], ["token", "key", "n", "pos", "most"])

    out = written(docs.select("text", "rh").mapInArrow(emit, "token bigint, key binary, n int, pos int, most int"))
    shared.close()
    return out


def _sets(docs: DataFrame, bits: np.ndarray, how: Join) -> DataFrame:
    """(key, members) of the texts whose hash has its bit set, and of few others."""
    shared = Shared(docs.sparkSession, bits.tobytes())  # of fixed size

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.frombuffer(shared.get()[0], dtype=np.uint64)
        for batch in batches:
            wanted = in_bitmap(bitmap, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64))
            sets = [s for i in np.flatnonzero(wanted).tolist() if len(s := _set(batch.column(0)[i].as_py(), how))]
            yield pa.RecordBatch.from_arrays([pa.array([set_key(s) for s in sets], pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["key", "members"])

    out = written(docs.select("text", "rh").mapInArrow(emit, "key binary, members binary").dropDuplicates(["key"]))
    shared.close()
    return out


def _verified(pairs: DataFrame, sets: DataFrame, how: Join) -> DataFrame:
    """The pairs (a, b) that link."""
    x, y = sets.toDF("a", "sa"), sets.toDF("b", "sb")

    def rows(c: dict[str, list]) -> Iterator[tuple]:
        for a, b, sa, sb in zip(c["a"], c["b"], c["sa"], c["sb"], strict=True):
            p, q = np.frombuffer(sa, np.uint64), np.frombuffer(sb, np.uint64)
            if how.links(len(p), len(q), overlap(p, q)):
                yield a, b

    both = pairs.select("a", "b").join(x, "a").join(y, "b").select("a", "b", "sa", "sb")
    return written(both.mapInArrow(in_batches(rows, ["a", "b"], [pa.binary(), pa.binary()]), "a binary, b binary"))


def _lists(index: DataFrame, how: Join) -> tuple[DataFrame, DataFrame]:
    """The index without rows that can meet nothing, with `deg`: how much each set's lists hold. Lists are counted by
    partial aggregates and joined back, so that no task must hold a long one."""
    known = index.groupBy("token").agg(F.count("*").alias("size"), F.min("n").alias("least"), F.min("key").alias("k1"), F.max("key").alias("k2")).filter("k1 <> k2").drop("k1", "k2")
    met_ = index.join(known, "token").filter(reach(F.col("n"), F.col("pos"), F.col("most"), how.percent) >= F.col("least")).drop("least")
    out = written(met_)
    degrees = out.groupBy("key").agg(F.sum("size").alias("deg"))
    return written(out.drop("size").join(degrees, "key")), out


def _named(lists: DataFrame, classes: DataFrame | None) -> DataFrame:
    """The lists with the members' components and, where a list has several, its largest one."""
    if classes is None:
        return lists.withColumns({"comp": F.col("key"), "big": F.lit(None).cast("binary")})
    named = lists.join(classes.toDF("key", "root"), "key", "left").withColumn("comp", F.coalesce("root", "key")).drop("root")
    parts = named.groupBy("token", "comp").agg(F.count("*").alias("c")).groupBy("token").agg(F.count("*").alias("comps"), F.max(F.struct("c", "comp")).alias("b"))
    return named.join(parts.filter("comps > 1").select("token", F.col("b.comp").alias("big")), "token")


def _star(named: DataFrame, how: Join) -> DataFrame:
    """Pairs of each list's hub with the others: the largest by degree of those outside the list's largest component."""
    hubs = named.filter("big is null or comp <> big").groupBy("token").agg(F.max(F.struct("deg", "key", "n", "comp")).alias("p"))
    fits = how.percent * F.greatest("n", "p.n") <= 100 * F.least("n", "p.n")
    star = named.join(hubs, "token").filter((F.col("comp") != F.col("p.comp")) & fits)
    return star.select(F.least("key", "p.key").alias("a"), F.greatest("key", "p.key").alias("b")).distinct()


def _across(named: DataFrame, how: Join) -> DataFrame:
    """All pairs of different components, one outside the list's largest, that share as many prefix shingles as they must."""
    sizes = named.groupBy("token").agg(F.collect_set(bucket(F.col("n"))).alias("sizes"))  # at most some thousands, whatever the list
    dealt = named.join(sizes, "token").withColumn("outside", F.col("comp") != F.col("big")).withColumn("own", bucket(F.col("n")))
    dealt = written(dealt.withColumn("of", F.explode(met(F.col("sizes"), F.col("n"), F.col("pos"), F.col("most"), how.percent))).drop("sizes", "big", "deg"))
    names = ("key", "n", "pos", "most", "comp", "outside")
    x = dealt.filter("outside").select("token", F.col("own").alias("p"), F.col("of").alias("q"), *(F.col(c).alias(f"a_{c}") for c in names))
    y = dealt.select("token", F.col("of").alias("p"), F.col("own").alias("q"), *(F.col(c).alias(f"b_{c}") for c in names))
    once = ~F.col("b_outside") | (F.col("a_key") < F.col("b_key"))
    counts = usable(*(F.col(c) for c in ("a_n", "a_pos", "a_most", "b_n", "b_pos", "b_most")), how.percent)
    cross = x.join(y, ["token", "p", "q"]).filter((F.col("a_comp") != F.col("b_comp")) & once & counts)
    shared = cross.groupBy(F.least("a_key", "b_key").alias("a"), F.greatest("a_key", "b_key").alias("b")).agg(F.count("*").alias("c"), F.min(F.least("a_most", "b_most")).alias("need"))
    out = written(shared.filter("c >= need").select("a", "b"))
    discard(dealt)
    return out


def similar(docs: DataFrame, how: Join = Join()) -> tuple[DataFrame, DataFrame]:
    """(doc_id, n, key, rh) of every row, and (node, root): the classes of keys whose sets are linked. `docs`: doc_id,
    text, rh; rh is a hash that rows of different texts don't share."""
    rows, stats, _ = _measured(docs, how)
    reps = rows.filter("n > 0").groupBy("key").agg(F.min("rh").alias("rh"))
    index = _index(docs, bitmap_of(reps.select(F.col("rh").alias("key"))), stats, how)
    lists, counted = _lists(index, how)
    discard(index, counted)
    needed = reps.join(lists.select("key").distinct(), "key", "left_semi").select(F.col("rh").alias("key"))
    sets = _sets(docs, bitmap_of(needed), how)
    links, classes = None, None
    for turn in range(how.turns):
        star = _star(_named(lists, classes), how)
        found = _verified(star, sets, how)
        old = links, classes
        links = found if links is None else written(links.unionByName(found))
        classes = components(links)
        if turn:
            discard(found, *old)
    pairs = _across(_named(lists, classes), how)
    more = _verified(pairs, sets, how)
    out = components(links.unionByName(more))
    discard(lists, sets, links, classes, pairs, more)
    return rows, out


def _hashed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.xxhash64("text").alias("rh"))


def class_ids(docs: DataFrame, how: Join = Join()) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row."""
    rows, classes = similar(_hashed(docs), how)
    least = rows.filter("n > 0").groupBy("key").agg(F.min("doc_id").alias("least"))
    least = least.join(classes.toDF("key", "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    ids = least.groupBy("root").agg(F.min("least").alias("component_id"))
    of_key = least.select("key", "root").join(ids, "root").select("key", "component_id")
    out = rows.join(of_key, "key", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return class_ids(table(spark, sf_dir, "documents", "doc_id", "text"))


def one_of_each(docs: DataFrame, how: Join) -> DataFrame:
    """The rows without words, and of each class the row with the smallest doc_id (null last), then row hash."""
    taken = set(docs.columns)
    h, i = (next(x for x in (f"{c}{k or ''}" for k in range(len(taken) + 1)) if x not in taken) for c in ("rowhash", "rowid"))
    keyed = docs.withColumns({h: F.xxhash64(*docs.columns), i: F.coalesce("doc_id", F.lit(0))})
    rows, classes = similar(keyed.select("doc_id", "text", F.col(h).alias("rh")), how)
    least = rows.filter("n > 0").groupBy("key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "rh")).alias("d"))
    least = least.join(classes.toDF("key", "root"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    stays = least.groupBy("root").agg(F.min("d").alias("d")).select(F.col("d.rh").alias(h), F.coalesce("d.doc_id", F.lit(0)).alias(i))
    wordy = F.coalesce(F.col("text"), F.lit("")).rlike(WORD)
    kept = keyed.filter(wordy).join(stays, [h, i], "left_semi").dropDuplicates([h, i])
    return kept.unionByName(keyed.filter(~wordy)).select(*docs.columns)


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: one document of each class stays, the one with the smallest doc_id; five words, 0.8."""
    return one_of_each(docs, Join(words=5, percent=80))
