r"""Operator 2, BPE encoding and decoding with content-defined chunk reuse.

Texts are cut into chunks where a rolling hash of the last bytes says so, so equal passages of different documents
give equal chunks. One pass over the texts marks the chunk hashes that occur more than once; those chunks are
encoded once and their ids are joined to the documents that use them. At each chunk join, ids are
repaired: the text between the last safe point before and the first safe point behind is encoded again, going
outward until both sides agree exactly with token ends. A safe point is a place where the pre-tokenizer always cuts: behind a
non-space and before a single space with a non-space behind it.

Documents without shared chunks are encoded whole, in the pass that finds that out; only the others are shuffled.

Which chunks are shared is told to that pass by a bitmap of fixed size (`Chunking.bitmap_bits`): a bit that
collides only sends a chunk the longer way, the ids are the same.

The encoder is tiktoken's, set up from the tokenizers file's own vocabulary (byte-level BPE: the rank of a merge is
its id), several times as fast as the tokenizers library and held against it by the tests.

Edge cases: null texts are empty (0 tokens); special-token strings in a text become their ids, as in the tokenizers
library by default; repeated rows and null doc_ids are rows of their own; an empty table gives an empty one; other
columns are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import re
import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bitmap_of, table, written

#: The pre-tokenizer's pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SAFE_SPACE = 0x20


@dataclass(frozen=True)
class Chunking:
    window: int = 32
    mean_bytes: int = 1024
    least_bytes: int = 128
    bitmap_bits: int = 24


def _bytes_of_letters() -> dict[str, int]:
    """Byte-level alphabet: printable bytes stand for themselves, the others for letters from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@functools.lru_cache(maxsize=4)
def codec(path: str):  # noqa: ANN201
    """The encoding of a byte-level BPE tokenizers file; one a Python worker."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    pre, model = spec["pre_tokenizer"], spec["model"]
    if model["type"] != "BPE" or pre["type"] != "ByteLevel" or pre.get("add_prefix_space") or spec["normalizer"] or model.get("ignore_merges"):
        raise ValueError(f"not a plain byte-level BPE tokenizer: {path}")
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    letters = _bytes_of_letters()
    ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    return tiktoken.Encoding("byte-level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


def encode(path: str, text: str) -> list[int]:
    return codec(path).encode(text, allowed_special="all")


def decode(path: str, ids: list[int]) -> str:
    return codec(path).decode_bytes(ids).decode("utf-8", "replace")


_ODD = 0x9E3779B97F4A7C15


@functools.lru_cache(maxsize=2)
def _tables(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    letter = np.array([int.from_bytes(hashlib.blake2b(bytes([i]), digest_size=8).digest(), "little") for i in range(256)], dtype=np.uint64)
    power = np.cumprod(np.full(size, _ODD, dtype=np.uint64))
    inverse = np.cumprod(np.full(size, pow(_ODD, -1, 2**64), dtype=np.uint64))
    return letter, power, inverse


def cuts(data: bytes, how: Chunking) -> list[int]:
    """Ends of the chunks of a UTF-8 text; never inside a code point."""
    n, w = len(data), how.window
    if n <= how.least_bytes + w:
        return [n] if n else []
    found: list[np.ndarray] = []
    block = 1 << 20
    letter, power, inverse = _tables(block + w)
    b = np.frombuffer(data, dtype=np.uint8)
    for at in range(0, n, block):  # a polynomial hash of the last w bytes, from running sums of a block
        part = b[max(0, at - w) : at + block]
        sums = np.cumsum(letter[part] * power[: len(part)])
        rolling = (sums[w:] - sums[:-w]) * inverse[: len(part) - w] if len(part) > w else np.zeros(0, dtype=np.uint64)
        hit = np.flatnonzero((rolling >> np.uint64(32)) % np.uint64(how.mean_bytes) == 0)
        found.append(hit + w + 1 + max(0, at - w))
    ends, last = [], 0
    for e in np.concatenate(found).tolist():
        while e < n and data[e] & 0xC0 == 0x80:
            e += 1
        if e - last >= how.least_bytes and n - e >= 1:
            ends.append(e)
            last = e
    return [*ends, n]


def _key(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


def _bit(key: bytes, how: Chunking) -> int:
    return int.from_bytes(key[:8], "little") >> (64 - how.bitmap_bits)


#: White space beyond ASCII (fixed values), and full-width punctuation behind which no letter run goes on.
_WIDE_SPACES = frozenset("\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
_SAFE = re.compile("(?<=[^\\x00-\\x20" + "".join(sorted(_WIDE_SPACES)) + "]) (?=[^\\x00-\\x20])|(?<=[\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5])[\u3001\u3002\uff0c\uff01\uff1f\uff1b\uff1a]")


def _safe_points(text: str) -> list[int]:
    """Where the pre-tokenizer always cuts, in any script: before a single space that follows no white space, and between
    a Han or kana letter and full-width punctuation. Code points."""
    return [m.start() for m in _SAFE.finditer(text)]


@functools.lru_cache(maxsize=2)
def _lengths(path: str) -> np.ndarray:
    """Bytes of each token."""
    enc = codec(path)
    out = np.zeros(enc.n_vocab, dtype=np.int64)
    for i in range(enc.n_vocab):
        try:
            out[i] = len(enc.decode_single_token_bytes(i))
        except KeyError:
            continue
    return out


def _agreed(path: str, chunk: bytes, ids: np.ndarray, whole_left: bool, whole_right: bool) -> tuple[int, int, np.ndarray] | None:
    """The part of a chunk, in bytes, between its first and its last safe point at which its ids have a token end: there
    they agree with those of the whole text. None: it has no two of these."""
    text = chunk.decode()
    points = _safe_points(text)
    if len(chunk) == len(text):
        at = np.array([*([0] if whole_left else []), *points, *([len(chunk)] if whole_right else [])], dtype=np.int64)
    else:
        width = np.cumsum([0, *(len(c.encode()) for c in text)])
        at = width[[*([0] if whole_left else []), *points, *([len(text)] if whole_right else [])]]
    ends = np.concatenate(([0], np.cumsum(_lengths(path)[ids])))
    where = np.searchsorted(ends, at)
    good = np.flatnonzero(ends[np.minimum(where, len(ends) - 1)] == at)
    if len(good) < 2:
        return None
    x, y = good[0], good[-1]
    return int(at[x]), int(at[y]), ids[where[x] : where[y]]


def assemble(path: str, data: bytes, ends: list[int], known: dict[int, np.ndarray]) -> np.ndarray:
    """The ids of a text from those of its chunks, joins repaired. `known`: ids of some chunks, by number.

    Around each join the text is encoded anew, outward until a point on either side where the known ids agree with the
    whole text's; neighbouring unknown chunks go along in the same run. Each byte is encoded once here at most."""
    enc, out = codec(path), []
    run = start = 0
    for i, end in enumerate(ends):
        found = _agreed(path, data[start:end], known[i], start == 0, end == len(data)) if i in known else None
        if found is not None:
            x, y, ids = found
            if start + x > run:
                out.append(np.array(enc.encode(data[run : start + x].decode(), allowed_special="all"), dtype=np.int64))
            out.append(ids)
            run = start + y
        start = end
    if run < len(data):
        out.append(np.array(enc.encode(data[run:].decode(), allowed_special="all"), dtype=np.int64))
    return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)


def _pack(ids: np.ndarray) -> bytes:
    return np.ascontiguousarray(ids, dtype="<u4").tobytes()


def _digests(path: str, ids: np.ndarray | list[int]) -> tuple[int, str, str]:
    enc = codec(path)
    listed = ids.tolist() if isinstance(ids, np.ndarray) else ids
    text = enc.decode_bytes(listed).decode("utf-8", "replace").encode()
    return len(listed), hashlib.sha256(np.array(listed, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(text).hexdigest()


def _shared_bits(docs: DataFrame, how: Chunking) -> np.ndarray:
    """A bitmap of the chunk hashes that occur twice or more; of `bitmap_bits`, however many chunks there are."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys: list[int] = []
            for text in batch.column(0).to_pylist():
                data, last = (text or "").encode(), 0
                for end in cuts(data, how):
                    keys.append(int.from_bytes(_key(data[last:end])[:8], "little", signed=True))
                    last = end
            found, n = np.unique(np.array(keys, dtype=np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], ["key", "n"])

    counted = docs.select("text").mapInArrow(hashes, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1")
    return bitmap_of(counted.select("key"), how.bitmap_bits)


_ROW = "kind int, row_id string, doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, text string"


def encode_documents(docs: DataFrame, path: str, how: Chunking = Chunking()) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row of `docs` (doc_id, text)."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    bitmap = spark.sparkContext.broadcast(_shared_bits(docs, how).tobytes())  # 2**bitmap_bits bits

    def seen() -> np.ndarray:
        return np.frombuffer(bitmap.value, dtype=np.uint64)

    def is_shared(bits: np.ndarray, key: bytes) -> bool:
        b = _bit(key, how)
        return bool((int(bits[b >> 6]) >> (b & 63)) & 1)

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = seen()
        for batch in batches:
            out: dict[str, list] = {c.split()[0]: [] for c in _ROW.split(", ")}
            for doc_id, text, at in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                text = text or ""
                data, last, shared = text.encode(), 0, False
                for end in cuts(data, how):
                    if is_shared(bits, _key(data[last:end])):
                        shared = True
                        break
                    last = end
                figures = (None, None, None) if shared else _digests(path, encode(path, text))
                for c, v in zip(out, (int(shared), at, doc_id, *figures, text if shared else None), strict=True):
                    out[c].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([(c.split()[0], {"int": pa.int32(), "bigint": pa.int64(), "string": pa.string()}[c.split()[1]]) for c in _ROW.split(", ")]))

    # the row's place names it from here on: the table that follows is written, so the names hold
    done = written(docs.withColumn("row_id", F.concat_ws("/", F.spark_partition_id().cast("string"), F.monotonically_increasing_id().cast("string"))).mapInArrow(first, _ROW))
    rest = done.filter("kind = 1").select("row_id", "text")

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shared chunks only: reference, and the text once a batch."""
        bits = seen()
        for batch in batches:
            rows: list[tuple[bytes, str, int, bytes | None]] = []
            sent: set[bytes] = set()
            for row_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                data, last = text.encode(), 0
                for i, end in enumerate(cuts(data, how)):
                    if is_shared(bits, key := _key(data[last:end])):
                        rows.append((key, row_id, i, None if key in sent else data[last:end]))
                        sent.add(key)
                    last = end
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=t) for i, t in enumerate((pa.binary(), pa.string(), pa.int32(), pa.binary()))], ["key", "row_id", "i", "chunk"])

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [_pack(np.array(encode(path, c.decode()), dtype=np.int64)) for c in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, type=pa.binary())], ["key", "ids"])

    refs = written(rest.mapInArrow(chunks, "key binary, row_id string, i int, chunk binary"))
    once = written(refs.filter("chunk is not null").select("key", "chunk").dropDuplicates(["key"]).mapInArrow(encoded, "key binary, ids binary"))
    used = refs.select("key", "row_id", "i").join(once, "key")
    lists = used.groupBy("row_id").agg(F.collect_list(F.struct("i", "ids")).alias("known"))  # a document's own chunks
    whole = done.filter("kind = 1").select("row_id", "doc_id", "text").join(lists, "row_id", "left")

    def put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text, known in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                data = text.encode()
                ids = assemble(path, data, cuts(data, how), {k["i"]: np.frombuffer(k["ids"], dtype="<u4").astype(np.int64) for k in known or ()})
                rows.append((doc_id, *_digests(path, ids)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=t) for i, t in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string()))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    figures = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    joined = whole.select("doc_id", "text", "known").mapInArrow(put_together, figures)
    return done.filter("kind = 0").select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").unionByName(joined)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents", "doc_id", "text"), default_path())


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline, last stage: the documents' token figures."""
    return encode_documents(docs, default_path())
