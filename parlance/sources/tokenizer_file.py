"""A tokenizers file as three small tables, and byte-level BPE over distinct pieces.

The file is an input, never bundled. What it asks for is compared with what is implemented here, step by step and pattern by
pattern; anything else is refused, so that no text is encoded by other rules than the file's."""

from __future__ import annotations

import functools
import heapq
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from ..functions import text as X


def alphabet() -> dict[int, str]:
    """Bytes to letters: printable ones stand for themselves, the others follow from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {b: chr(b) for b in plain}
    return out | {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in out)}


LETTER = alphabet()
BYTE = {c: b for b, c in LETTER.items()}


#: How a file's pre-tokenizer cuts: three patterns one after the other (digits, CJK, words), or the plain byte-level one.
SPLITS = {"three": X.pieces, "byte_level": X.byte_level_pieces}
#: The three patterns as files hold them.
PATTERNS = (
    r"\p{N}{1,3}",
    "[\u4e00-\u9fa5\u3040-\u309f\u30a0-\u30ff]+",
    "[!\"#$%&'()*+,\\-./:;<=>?@\\[\\\\\\]^_`{|}~][A-Za-z]+|[^\r\n\\p{L}\\p{P}\\p{S}]?[\\p{L}\\p{M}]+| ?[\\p{P}\\p{S}]+[\r\n]*|\\s*[\r\n]+|\\s+(?!\\S)|\\s+",
)


def _refuse(why: str) -> None:
    raise ValueError(f"unsupported tokenizer: {why}")


def split_of(pre: dict | None) -> tuple[str, bool]:
    """Which of SPLITS a file's pre_tokenizer asks for, and whether pieces get a space in front; anything else is refused."""
    if not pre:
        _refuse("no pre_tokenizer")
    if pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space"):
        return "byte_level", False
    if pre.get("type") != "Sequence":
        _refuse(f"pre_tokenizer {pre.get('type')}")
    steps = pre.get("pretokenizers") or []
    if len(steps) != len(PATTERNS) + 1:
        _refuse(f"a pre_tokenizer of {len(steps)} steps")
    for step, pattern in zip(steps, PATTERNS, strict=False):
        if step.get("type") != "Split" or step.get("behavior") != "Isolated" or step.get("invert"):
            _refuse("a pre_tokenizer step that isn't an isolating split")
        if (step.get("pattern") or {}).get("Regex") != pattern:
            _refuse(f"the pre_tokenizer pattern {step.get('pattern')}")
    if steps[-1].get("type") != "ByteLevel" or steps[-1].get("use_regex", True):
        _refuse("a pre_tokenizer that doesn't end byte-level")
    return "three", bool(steps[-1].get("add_prefix_space"))


@dataclass(frozen=True)
class Added:
    """An added token: found as it stands, before any cutting; those that aren't `normalized` are looked for first."""

    content: str
    id: int
    special: bool = False
    normalized: bool = True
    single_word: bool = False
    lstrip: bool = False
    rstrip: bool = False


class Finder:
    """Added tokens in a text: leftmost first, of those that start together the longest. A token that must be a word by
    itself is passed over inside one; the white space beside a token goes with it if it says so."""

    def __init__(self, tokens: list[Added]) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for t in reversed(tokens):  # of equal contents the first counts
            self.automaton.add_word(t.content, t)
        self.any = bool(tokens)
        if self.any:
            self.automaton.make_automaton()

    def parts(self, text: str) -> list[tuple[str, int | None]]:
        """The text's parts in order: (text, id of an added token or None)."""
        out: list[tuple[str, int | None]] = []
        done = 0
        for last, t in self.automaton.iter_long(text) if self.any else ():
            start, end = last + 1 - len(t.content), last + 1
            if t.single_word and (re.search(r"\w\Z", text[max(0, start - 1) : start]) or re.match(r"\w", text[end : end + 1])):
                continue
            if t.lstrip:
                start = max(done, len(text[:start].rstrip()))
            if t.rstrip:
                end += len(text[end:]) - len(text[end:].lstrip())
            if done < start:
                out.append((text[done:start], None))
            out.append((text[start:end], t.id))
            done = end
        if done < len(text):
            out.append((text[done:], None))
        return out


@dataclass
class Tokenizer:
    vocab: dict[str, int]
    merges: dict[tuple[str, str], int]
    added: list[Added] = field(default_factory=list)
    #: A key of SPLITS.
    split: str = "three"
    prefix_space: bool = False
    unk: str | None = None
    fuse_unk: bool = False
    byte_fallback: bool = False
    #: What inner letters of a piece begin with, and its last one ends with, in the vocabulary.
    inner: str = ""
    end: str = ""

    @classmethod
    def load(cls, path: str) -> Tokenizer:
        with open(path, encoding="utf-8") as f:
            return cls.of(json.load(f))

    @classmethod
    def of(cls, spec: dict) -> Tokenizer:
        model, normalizer, vocab = spec["model"], spec.get("normalizer"), spec["model"].get("vocab", {})
        if model.get("type") != "BPE" or model.get("dropout") or model.get("ignore_merges"):
            _refuse("its model isn't plain BPE")
        if normalizer and (normalizer.get("type") != "Sequence" or normalizer.get("normalizers")):
            _refuse(f"normalizer {normalizer.get('type')}")
        for part in ("post_processor", "decoder"):
            if spec.get(part) and spec[part].get("type") != "ByteLevel":
                _refuse(f"{part} {spec[part].get('type')}")
        split, prefix_space = split_of(spec.get("pre_tokenizer"))
        unk, inner = model.get("unk_token"), model.get("continuing_subword_prefix") or ""
        if unk is not None and unk not in vocab:
            _refuse(f"unk_token {unk} is not in the vocabulary")
        merges: dict[tuple[str, str], int] = {}
        for rank, m in enumerate(model["merges"]):
            left, right = m.split(" ", 1) if isinstance(m, str) else m
            for token in (left, right, left + right.removeprefix(inner)):
                if token not in vocab:
                    _refuse(f"merge {rank}: {token} is not in the vocabulary")
            merges[left, right] = rank
        keys = ("special", "normalized", "single_word", "lstrip", "rstrip")
        added = [Added(t["content"], t["id"], *(bool(t.get(k)) for k in keys)) for t in spec.get("added_tokens") or [] if t["content"]]
        return cls(vocab, merges, added, split, prefix_space, unk, bool(model.get("fuse_unk")), bool(model.get("byte_fallback")), inner, model.get("end_of_word_suffix") or "")

    def __post_init__(self) -> None:
        self.token = {i: t for t, i in self.vocab.items()}
        self.plain: dict[int, str] = {}
        for t in self.added:
            self.plain.setdefault(t.id, t.content)
        self.special = {t.content for t in self.added if t.special}

    def vocab_size(self) -> int:
        return len(set(self.vocab.values()) | set(self.plain))

    def id_of(self, token: str) -> int | None:
        return next((t.id for t in self.added if t.content == token), self.vocab.get(token))

    @functools.cached_property
    def finders(self) -> tuple[Finder, Finder]:
        return tuple(Finder([t for t in self.added if t.normalized == n]) for n in (False, True))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "finders"}  # automata stay where they were made

    def added_parts(self, text: str) -> list[tuple[str, int | None]]:
        """A text cut at its added tokens: those that aren't normalized first, then the others in what is left."""
        raw, normal = self.finders
        return [y for part, i in raw.parts(text) for y in ([(part, i)] if i is not None else normal.parts(part))]

    def _letters(self, piece: str) -> list[str]:
        """A piece's letters as they stand in the vocabulary. A letter that isn't there becomes the pieces of its bytes, or
        the unknown token (once for a run, if so asked), or goes."""
        out: list[str] = []
        unknown = False
        letters = [LETTER[b] for b in piece.encode()]
        for k, c in enumerate(letters):
            token = (self.inner if out else "") + c + (self.end if k == len(letters) - 1 else "")
            codes = [f"<0x{b:02X}>" for b in c.encode()]
            if token in self.vocab:
                out.append(token)
                unknown = False
            elif self.byte_fallback and all(x in self.vocab for x in codes):
                out += codes
                unknown = False
            elif self.unk is not None:
                if not (unknown and self.fuse_unk):
                    out.append(self.unk)
                unknown = True
        return out

    def encode_piece(self, piece: str) -> list[int]:
        """Merges by rank, leftmost first; a heap holds candidate pairs, stale ones are skipped."""
        if self.prefix_space and not piece.startswith(" "):
            piece = " " + piece
        parts: list[str | None] = list(self._letters(piece))
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(len(parts) - 1) if (r := self.merges.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= len(parts) or parts[j] != b:
                continue
            parts[i], parts[j], after[i] = a + b.removeprefix(self.inner), None, after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < len(parts) and (r := self.merges.get((parts[x], parts[y]))) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return [self.vocab[p] for p in parts if p is not None]

    def token_bytes(self, i: int, skip_special: bool = False) -> bytes:
        """What an id stands for; nothing if it is unknown. A token with a letter that is no byte's stands for itself."""
        if i in self.plain:
            return b"" if skip_special and self.plain[i] in self.special else self.plain[i].encode()
        if i not in self.token:
            return b""
        t = self.token[i]
        return bytes(BYTE[c] for c in t) if all(c in BYTE for c in t) else t.encode()

    def decode(self, ids: list[int], skip_special: bool = False) -> str:
        return b"".join(self.token_bytes(i, skip_special) for i in ids).decode("utf-8", "replace")

    def tables(self, spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
        """vocabulary (token, id), merges (rank, left, right), added tokens (id, content, special)."""
        return (
            spark.createDataFrame(list(self.vocab.items()), "token string, id int"),
            spark.createDataFrame([(r, *m) for m, r in self.merges.items()], "rank int, left string, right string"),
            spark.createDataFrame([(t.id, t.content, t.special) for t in self.added], "id int, content string, special boolean"),
        )


#: Pieces whose ids a worker keeps, and how long they are at most; pieces that are encoded at once, but for a single text of more.
KEPT, LONGEST, AT_ONCE = 1 << 18, 64, 1 << 18
_PART = S.ArrayType(S.StructType([S.StructField("piece", S.StringType()), S.StructField("id", S.IntegerType())]))


def _slices(batch: pa.RecordBatch, most: int) -> Iterator[pa.RecordBatch]:
    """A batch in runs of rows whose lists have `most` items together, or of a single row: batches are cut by rows alone, so the
    working arrays would be as large as 10,000 texts are long."""
    ends, start = batch.column(1).offsets.to_numpy(), 0
    while start < batch.num_rows:
        end = max(start + 1, int(np.searchsorted(ends, ends[start] + most, "right")) - 1)
        yield batch.slice(start, end - start)
        start = end


def encode(df: DataFrame, key: str, text: str, tokenizer: Tokenizer, pieces=None) -> DataFrame:  # noqa: ANN001
    """(key, ids) of every row, without a shuffle: texts are cut at added tokens, then natively into pieces as the tokenizer's
    file says; tasks encode the distinct pieces of a batch and keep them for the next. Null texts have no ids."""
    pieces = pieces or SPLITS[tokenizer.split]
    held = df.sparkSession.sparkContext.broadcast(tokenizer)  # the vocabulary, an input of fixed size
    plain = lambda p: F.transform(pieces(p), lambda x: F.struct(x.alias("piece"), F.lit(None).cast("int").alias("id")))
    source = F.coalesce(text, F.lit(""))
    cut = plain(source)
    if tokenizer.added:
        names = "|".join(rf"\Q{t.content}\E" for t in tokenizer.added)

        @F.pandas_udf(_PART)
        def at_added(s: pd.Series) -> pd.Series:
            return s.map(lambda x: None if x is None else held.value.added_parts(x))

        parts = at_added(F.when(source.rlike(names), source))  # few texts hold any
        cut = F.when(source.rlike(names), F.flatten(F.transform(parts, lambda p: F.when(p["id"].isNotNull(), F.array(p)).otherwise(plain(p["piece"]))))).otherwise(cut)

    most = AT_ONCE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t, known = held.value, {}
        for batch in (part for whole in batches for part in _slices(whole, most)):
            listed = batch.column(1)
            flat = listed.flatten()
            coded = flat.field("piece").dictionary_encode()
            own = []
            for piece in coded.dictionary.to_pylist():
                if (ids := known.get(piece)) is None:
                    if len(known) >= KEPT:
                        known.clear()
                    ids = np.array(t.encode_piece(piece), dtype=np.int32)
                    if len(piece) <= LONGEST:
                        known[piece] = ids
                own.append(ids)
            number = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            added = flat.field("id").to_numpy(zero_copy_only=False)
            for at in np.flatnonzero(~pd.isna(added)):
                number[at] = len(own)
                own.append(np.array([added[at]], dtype=np.int32))
            sizes = np.array([len(x) for x in own], dtype=np.int64)
            ends = np.concatenate(([0], np.cumsum(sizes)))
            count = sizes[number] if len(number) else np.zeros(0, np.int64)
            first = np.repeat(ends[:-1][number] - np.concatenate(([0], np.cumsum(count)[:-1])), count) if len(number) else np.zeros(0, np.int64)
            values = (np.concatenate(own) if own else np.zeros(0, np.int32))[first + np.arange(len(first))]
            total = np.concatenate(([0], np.cumsum(count)))
            offsets = total[listed.offsets.to_numpy() - listed.offsets[0].as_py()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))], [key, "ids"])

    return df.select(key, cut.alias("pieces")).mapInArrow(run, S.StructType([df.schema[key], S.StructField("ids", S.ArrayType(S.IntegerType()))]))


def decode(df: DataFrame, ids: str, tokenizer: Tokenizer, skip_special: bool = False):  # noqa: ANN201
    """A text column from ids; unknown ids are skipped, broken UTF-8 becomes U+FFFD."""
    held = df.sparkSession.sparkContext.broadcast(tokenizer)

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else held.value.decode(x.tolist(), skip_special))

    return run(F.col(ids))
