"""Operator 1, mixing sources to target weights.

Each source's words, document after document, are packed into fixed-length blocks. Output shards draw
multinomial counts of slots per source; a source's slots, numbered through the shards, go through a
pseudorandom permutation of its block indexes, a new one for each pass over the source; blocks join by index.
The longest slot of a source's last pass is cut so that its words meet the target to the word. Slots of all sources are
numbered within their shard and go through a permutation too: (shard, place) orders the mix.

Scale: only (doc_id, source, size) is shuffled. A hot source is dealt over hash buckets for its
running word offsets, and joins on (source, block), so no key holds more than one block's pieces. The recipe
(one row for each source) is the only thing gathered.

Edge cases: null and empty texts have size 0 and take 0; a null source is a source of its own, ranked last; repeated
rows and equal or null doc_ids are documents of their own; an empty table gives an empty mix; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table, words, written


@dataclass(frozen=True)
class Mix:
    block_words: int = 128
    shard_slots: int = 4096
    max_passes: int = 3
    #: Buckets into which a source's documents are dealt for their running offsets.
    buckets: int = 1024
    seed: int = 20240607


def targets(sized: DataFrame, cap: int = 3) -> DataFrame:
    """(source, rank, source_size, target): weights 1, 2, 3 in turn by code point, null last; what a source can't take
    in `cap` passes is shared again by weight. With s sorted by cap * size / weight, the first source whose share
    doesn't reach its cap fixes the level for all behind it. Works on one row a source."""
    by = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    by = by.withColumn("rank", rank).withColumn("weight", (F.col("rank") - 1) % 3 + 1)
    limit = F.lit(cap).cast("double") * F.col("source_size")
    order = Window.orderBy(limit / F.col("weight"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    by = by.withColumn("total", F.sum("source_size").over(everything)).withColumn("weights", F.sum("weight").over(everything))
    left = (F.col("total") - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))).cast("double")
    by = by.withColumn("level", left / (F.col("weights") - F.coalesce(F.sum("weight").over(before), F.lit(0))))
    by = by.withColumn("own", F.when(F.col("level") * F.col("weight") <= limit, F.col("level")))
    by = by.withColumn("cut", F.first("own", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    share = F.when(F.col("own").isNotNull() & (F.first("own", ignorenulls=True).over(order) == F.col("cut")), F.col("cut") * F.col("weight"))
    return by.select("source", "rank", "source_size", F.coalesce(F.least(share, limit), limit, F.lit(0.0)).alias("target"))


def sizes(docs: DataFrame, text: str = "text") -> Column:
    return F.size(words(F.col(text))).cast("bigint")


def offsets(sized: DataFrame, mix: Mix) -> DataFrame:
    """`start`: the words of the source before a document, in the order (bucket, doc_id, text)."""
    bucketed = sized.select("doc_id", "h", "again", "rank", "size", "source_size").withColumn("bucket", F.pmod(F.xxhash64("doc_id", "h", "again"), F.lit(mix.buckets)))
    sums = bucketed.groupBy("rank", "bucket").agg(F.sum("size").alias("n"))
    sums = sums.withColumn("base", F.sum("n").over(Window.partitionBy("rank").orderBy("bucket")) - F.col("n")).drop("n")
    within = Window.partitionBy("rank", "bucket").orderBy("doc_id", "h", "again").rowsBetween(Window.unboundedPreceding, -1)
    placed = bucketed.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    return placed.join(sums, ["rank", "bucket"]).select("doc_id", "h", "again", "rank", "size", "source_size", (F.col("base") + F.col("inner")).alias("start"))


def _network(blocks: int, seed: int) -> tuple[int, int, int]:
    """Half-width in bits of the Feistel network over at least `blocks` numbers, and two keys."""
    bits = max(1, (max(1, blocks - 1).bit_length() + 1) // 2)
    return bits, seed & 0xFFFFFFFF, (seed * 2654435761 + 97) & 0xFFFFFFFF


def _keyed(right: np.ndarray, turn: int, key: int, mask: np.uint64) -> np.ndarray:
    f = (right + np.uint64(key) + np.uint64(turn)) * np.uint64(0x9E3779B97F4A7C15)
    f ^= f >> np.uint64(29)
    f *= np.uint64(0xBF58476D1CE4E5B9)
    return (f >> np.uint64(32)) & mask


def permuted(index: np.ndarray, blocks: int, seed: int, back: bool = False) -> np.ndarray:
    """The pseudorandom permutation of range(blocks) that `seed` names: a Feistel network, walked until back in range.
    `back`: its inverse."""
    bits, k0, k1 = _network(blocks, seed)
    mask = np.uint64((1 << bits) - 1)
    turns = list(enumerate((k0, k1, k0 ^ 0x9E3779B9, k1 ^ 0x85EBCA6B)))
    out = index.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> np.uint64(bits), out[todo] & mask
        for turn, key in reversed(turns) if back else turns:
            if back:
                left, right = right ^ _keyed(left, turn, key, mask), left
            else:
                left, right = right, left ^ _keyed(right, turn, key, mask)
        out[todo] = (left << np.uint64(bits)) | right
        todo = todo[out[todo] >= np.uint64(blocks)]
    return out.astype(np.int64)


def _seed(mix: Mix, *names: int) -> int:
    return zlib.crc32("/".join(map(str, (mix.seed, *names))).encode())


@dataclass(frozen=True)
class _Source:
    """What a source gives: `full` whole passes, then `more` slots, the longest of which, at `cut`, loses `over` words."""

    rank: int
    size: int
    blocks: int
    full: int
    more: int
    cut: int
    over: int

    @property
    def slots(self) -> int:
        return self.full * self.blocks + self.more


def _sources(recipe: list, mix: Mix) -> list[_Source]:
    out = []
    for rank, size, target in recipe:
        size = int(size)
        if not (want := min(int(round(target)), mix.max_passes * size)):
            continue
        blocks = max(1, size // mix.block_words)  # what is left over lengthens the last one
        full, rest = divmod(want, size)
        more = min(blocks, -(-rest // mix.block_words))
        last = int(permuted(np.array([blocks - 1]), blocks, _seed(mix, rank, full), back=True)[0])  # the slot of the long block
        longer = size - blocks * mix.block_words if last < more else 0
        out.append(_Source(rank, size, blocks, full, more, last if last < more else more - 1, more * mix.block_words + longer - rest))
    return out


def _running(rows: DataFrame, by: str, order: str, value: str, wide: int) -> DataFrame:
    """`before`: the sum of `value` in the rows of `by` with a smaller `order`; ranges of `wide` orders are summed first, so
    that no task holds all rows of `by`."""
    dealt = rows.withColumn("_range", F.floor(F.col(order) / wide))
    sums = dealt.groupBy(by, "_range").agg(F.sum(value).alias("_n"))
    sums = sums.select(by, "_range", (F.sum("_n").over(Window.partitionBy(by).orderBy("_range")) - F.col("_n")).alias("_base"))
    inner = F.sum(value).over(Window.partitionBy(by, "_range").orderBy(order)) - F.col(value)
    return dealt.withColumn("_inner", inner).join(sums, [by, "_range"]).withColumn("before", F.col("_base") + F.col("_inner")).drop("_range", "_base", "_inner")


def slots(spark: SparkSession, recipe: list, mix: Mix) -> DataFrame:
    """(shard, place, rank, pass, block, words): the slots of the mix; (shard, place) is a key and orders it.
    `recipe`: one (rank, source_size, target) a source.

    A shard's counts are one multinomial draw with the sources' shares of slots, seeded by the shard; a source that
    has met its target takes no more, and what the draws have left over fills the last shards."""
    sources = _sources(recipe, mix)
    schema = "shard bigint, place bigint, rank int, pass int, block bigint, words bigint"
    if not sources:
        return spark.createDataFrame([], schema)
    need = np.array([s.slots for s in sources], dtype=np.int64)
    n_shards = int(-(-need.sum() // mix.shard_slots))
    share = need / need.sum()

    def draws(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for shard in batch["id"]:
                counts = np.random.default_rng([mix.seed, int(shard)]).multinomial(mix.shard_slots, share)
                i = np.flatnonzero(counts)
                yield pd.DataFrame({"shard": shard, "i": i.astype(np.int32), "n": counts[i]})

    needs = spark.createDataFrame([(i, int(n)) for i, n in enumerate(need)], "i int, need bigint")
    drawn = _running(spark.range(n_shards).mapInPandas(draws, "shard bigint, i int, n bigint"), "i", "shard", "n", 4096).join(needs, "i")
    drawn = drawn.select("shard", "i", F.least("before", "need").alias("from"), F.least(F.col("before") + F.col("n"), "need").alias("to"), "need").filter("to > from")
    # what is left over, cut where a shard is full
    rest = needs.join(drawn.groupBy("i").agg(F.max("to").alias("met")), "i", "left").withColumn("met", F.coalesce("met", F.lit(0))).withColumn("n", F.col("need") - F.col("met")).filter("n > 0")
    full = F.lit(mix.shard_slots)
    rest = rest.withColumn("at", F.sum("n").over(Window.orderBy("i")) - F.col("n"))  # at most one row a source
    rest = rest.select("i", "met", "n", "at", F.explode(F.sequence(F.floor(F.col("at") / full), F.floor((F.col("at") + F.col("n") - 1) / full))).alias("k"))
    begin, end = F.greatest("at", F.col("k") * full), F.least(F.col("at") + F.col("n"), (F.col("k") + 1) * full)
    rest = rest.select((F.lit(n_shards) + F.col("k")).cast("bigint").alias("shard"), "i", (F.col("met") + begin - F.col("at")).alias("from"), (F.col("met") + end - F.col("at")).alias("to"))
    # whole shards are dealt out, some 2**17 slots a task; then each range knows where in its shard it stands
    dealt = drawn.select("shard", "i", "from", "to").unionByName(rest).repartition(max(1, n_shards * mix.shard_slots >> 17), "shard")
    shard = Window.partitionBy("shard")
    n = F.col("to") - F.col("from")
    dealt = dealt.withColumn("at", F.sum(n).over(shard.orderBy("i")) - n).withColumn("all", F.sum(n).over(shard))

    def expand(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for i, at, total, begin, end, number in zip(*(batch[c] for c in ("i", "at", "all", "from", "to", "shard")), strict=True):
                s, slot = sources[i], np.arange(begin, end, dtype=np.int64)
                turn, index = slot // s.blocks, slot % s.blocks
                block = np.empty_like(slot)
                for t in np.unique(turn):
                    of = turn == t
                    block[of] = permuted(index[of], s.blocks, _seed(mix, s.rank, int(t)))
                words = np.where(block == s.blocks - 1, s.size - block * mix.block_words, mix.block_words)
                words[(turn == s.full) & (index == s.cut)] -= s.over
                place = permuted(at + slot - begin, int(total), _seed(mix, int(number)))
                yield pd.DataFrame({"shard": number, "place": place, "rank": s.rank, "pass": turn.astype(np.int32), "block": block, "words": words})

    return dealt.select("shard", "i", "from", "to", "at", "all").mapInPandas(expand, schema)


def keyed(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows with `h` and `again`, which with doc_id tell all rows apart, repeated ones too."""
    again = F.row_number().over(Window.partitionBy("doc_id", "h").orderBy("source"))
    return docs.withColumn("h", F.xxhash64(F.col(text))).withColumn("again", again)


def plan(docs: DataFrame, mix: Mix = Mix(), text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The sized documents with their source's target, and the pieces of the mix: shard and place in the output,
    pass, the document's key and the range of its words."""
    spark = docs.sparkSession
    # one narrow row a document: its text stays where it is
    narrow = docs.select("doc_id", "source", sizes(docs, text).alias("size"), F.xxhash64(F.col(text)).alias("h"))
    again = F.row_number().over(Window.partitionBy("doc_id", "h").orderBy("source"))
    sized = written(narrow.withColumn("again", again))
    rows = targets(sized, mix.max_passes).collect()  # one row a source
    recipe = spark.createDataFrame([(r["source"], r["rank"], r["source_size"], r["target"]) for r in rows], "_source string, rank int, source_size bigint, target double")
    sized = sized.join(recipe, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    length = F.lit(mix.block_words)
    span = offsets(sized, mix).filter("size > 0")
    final = F.greatest(F.floor(F.col("source_size") / length), F.lit(1)) - 1
    block_of = lambda word: F.least(F.floor(word / length), final)
    blocks = span.select("*", F.explode(F.sequence(block_of(F.col("start")), block_of(F.col("start") + F.col("size") - 1))).alias("block"))
    end = F.when(F.col("block") == final, F.col("source_size")).otherwise((F.col("block") + 1) * length)
    pieces = blocks.select("doc_id", "h", "again", "rank", "block", "start", F.greatest(F.col("start"), F.col("block") * length).alias("a"), F.least(F.col("start") + F.col("size"), end).alias("b"))
    taken = slots(spark, [(r["rank"], r["source_size"], r["target"]) for r in rows], mix)
    mixed = taken.hint("merge").join(pieces, ["rank", "block"])  # the optimizer takes the slots, made from a few shards, for few rows
    mixed = mixed.withColumn("b", F.least("b", F.col("block") * length + F.col("words"))).filter("b > a")
    return sized, mixed.select("shard", "place", "pass", "doc_id", "h", "again", "rank", (F.col("a") - F.col("start")).alias("first"), (F.col("b") - F.col("start")).alias("last"))


def same_row(renamed: str = "_") -> Column:
    return F.col("doc_id").eqNullSafe(F.col(f"{renamed}doc_id")) & F.col("h").eqNullSafe(F.col(f"{renamed}h")) & (F.col("again") == F.col(f"{renamed}again"))


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized, pieces = plan(table(spark, sf_dir, "documents", "doc_id", "source", "text"))
    taken = pieces.groupBy("doc_id", "h", "again").agg(F.sum(F.col("last") - F.col("first")).alias("taken")).toDF("_doc_id", "_h", "_again", "taken")
    return sized.join(taken, same_row(), "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: a row for each document and pass that the mix takes; a text taken in part keeps the words taken."""
    _, pieces = plan(docs)
    ranges = pieces.groupBy("doc_id", "h", "again", "pass").agg(F.sort_array(F.collect_list(F.struct("first", "last"))).alias("r"), F.sum(F.col("last") - F.col("first")).alias("n"))
    ranges = ranges.select(F.col("doc_id").alias("_doc_id"), F.col("h").alias("_h"), F.col("again").alias("_again"), "r", "n")
    own = docs.select(F.struct(*docs.columns).alias("_doc"), "doc_id", "source", "text")
    w = words(F.col("text"))
    part = F.array_join(F.transform("r", lambda x: F.array_join(F.slice(F.col("_w"), (x["first"] + 1).cast("int"), (x["last"] - x["first"]).cast("int")), " ")), " ")
    joined = keyed(own).join(ranges, same_row()).withColumn("_w", w)
    joined = joined.withColumn("_text", F.when(F.col("n") == F.size("_w"), F.col("text")).otherwise(part))
    of = {"text": F.col("_text"), "n_chars": F.length("_text").cast("bigint")}
    return joined.select(*(of.get(c, F.col("_doc")[c]).alias(c) for c in docs.columns))
