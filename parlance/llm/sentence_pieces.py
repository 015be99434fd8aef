"""Operator 12, SentencePiece encoding and decoding (BPE models) with a table of last tokens.

Each prefix of a text has one encoding, and so one last token. An automaton over all pieces finds, at each place, the
pieces that end there; the one that may follow the last token of the prefix before it is this prefix's. Following the
table from the end gives the ids. The time is linear in the text, however long its words are.

Two tokens may stand side by side if merging never joins across the place between them. A token's
merges form a tree; on either side of that place stand, one after the other, the nodes of the left token's right edge
and of the right token's left edge, each until its own parent is merged. A pair of them that has a piece of its own
with a better score (the leftmost first among equals) than both parents would have been joined. Where scores don't fall
from the leaves of a tree to its root (runs of spaces have one score in common), the two tokens are merged for real.

Between two characters that stand side by side in no piece nothing is ever merged, so a text is cut there first; the
parts, words or less, are encoded apart and their ids kept, within bounds, for the next time. Characters without a piece
become the pieces of their bytes.

Texts are normalized and ids are turned back by the sentencepiece library; encoding is done here. Edge cases: null texts
are empty (no ids); a text's control strings (<s>) are ordinary text; repeated rows and null doc_ids are rows of their own;
an empty table gives an empty one; other columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import math
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

#: Parts and pairs that a worker keeps (parts twice, those in use and those before them); a part of more characters is not kept.
KEPT_PARTS, KEPT_PAIRS, LONGEST_KEPT = 3 << 17, 1 << 20, 48
#: Characters of a text that are cut into parts at a time, ids that are decoded at a time.
BLOCK = 1 << 20


class _Parts(dict):
    """Parts to their ids, packed."""

    def __init__(self, encode) -> None:  # noqa: ANN001
        self.encode, self.before = encode, {}

    def __missing__(self, part: str) -> bytes:
        ids = self.before.get(part) or array("I", self.encode(part)).tobytes()
        if len(part) <= LONGEST_KEPT:
            if len(self) >= KEPT_PARTS:
                self.before = dict(self)
                self.clear()
            self[part] = ids
        return ids


class Pieces:
    """A BPE model of the sentencepiece library; one a Python worker."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        import sentencepiece

        self.sp = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        normal = [i for i in range(len(sp)) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i))]
        if any(sp.is_unused(i) for i in normal):
            raise ValueError(f"a model with unused pieces: {path}")
        self.piece = {i: sp.id_to_piece(i) for i in normal}
        self.id = {p: i for i, p in self.piece.items()}
        self.score = {p: -sp.get_score(i) for i, p in self.piece.items() if len(p) > 1}  # the least is merged first
        self.size = [len(self.piece.get(i, "")) for i in range(len(sp))]
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        self.fallback = sp.is_byte(self.bytes[0])
        self.automaton = ahocorasick.Automaton()
        for p, i in self.id.items():
            self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        joined = {c: k for k, c in enumerate(sorted({c for p in self.score for c in p}), 1)}
        self.number = np.zeros(0x110000, dtype=np.uint16)  # of each character; 0 for those that no merge takes in
        self.number[[ord(c) for c in joined]] = list(joined.values())
        self.beside = np.zeros((len(joined) + 1, len(joined) + 1), dtype=bool)
        for p in self.score:
            for a, b in itertools.pairwise(p):
                self.beside[joined[a], joined[b]] = True
        self.parts, self.pairs = _Parts(self._part), {}

    @functools.lru_cache(maxsize=1 << 16)  # noqa: B019
    def _tree(self, piece: str) -> tuple[str, str] | None:
        """The two parts that a piece is merged from in the end; () for a character, None if merging doesn't end in it."""
        if len(piece) == 1:
            return ()
        parts = self._merged(list(piece), until=2)
        return tuple(parts) if len(parts) == 2 and self._merged(list(piece)) == [piece] else None

    def _merged(self, parts: list[str], until: int = 1) -> list[str]:
        """Short texts only: the best pair first, the leftmost among equals."""
        while len(parts) > until:
            best = min(((self.score.get(a + b, math.inf), k) for k, (a, b) in enumerate(zip(parts, parts[1:], strict=False))), default=(math.inf, 0))
            if best[0] == math.inf:
                break
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return parts

    @functools.lru_cache(maxsize=1 << 16)  # noqa: B019
    def _edge(self, piece: str, side: int) -> tuple[tuple[str, float], ...] | None:
        """The nodes of a tree's left (0) or right (1) edge from the leaf up, each with its parent's score; None if the
        scores of the tree don't fall towards its leaves."""
        tree = self._tree(piece)
        if tree is None:
            return None
        if not tree:
            return ((piece, math.inf),)
        edges = [self._edge(part, side) for part in tree]
        if None in edges or any(self.score.get(part, -math.inf) >= self.score[piece] for part in tree):
            return None
        return (*edges[side][:-1], (tree[side], self.score[piece]), (piece, math.inf))

    def may_follow(self, left: int, right: int) -> bool:
        if len(self.pairs) >= KEPT_PAIRS:
            self.pairs.clear()
        found = self.pairs[left << 32 | right] = self._may_follow(self.piece[left], self.piece[right])
        return found

    def _may_follow(self, left: str, right: str) -> bool:
        if self._tree(left) is None or self._tree(right) is None:
            return False
        one, two = self._edge(left, 1), self._edge(right, 0)
        if one is None or two is None:
            return self._merged([*left, *right]) == [left, right]
        i = j = 0
        while True:
            (a, ends_a), (b, ends_b) = one[i], two[j]
            joined = self.score.get(a + b, math.inf)
            if joined < ends_a and joined <= ends_b:
                return joined == math.inf
            if ends_a == ends_b == math.inf:
                return True
            if ends_a <= ends_b:
                i += 1
            else:
                j += 1

    def _run(self, text: str) -> list[int]:
        """Characters that all have pieces."""
        if (whole := self.id.get(text)) is not None and self._tree(text) is not None:
            return [whole]
        last, size, piece, pairs = [-1] * len(text), self.size, self.piece, self.pairs
        for end, p in self.automaton.iter(text):
            if last[end] < 0:
                start = end + 1 - size[p]
                if start == 0:
                    fits = self._tree(piece[p]) is not None
                elif (fits := pairs.get(last[start - 1] << 32 | p)) is None:
                    fits = self.may_follow(last[start - 1], p)
                if fits:
                    last[end] = p
        ids, at = [], len(text)
        while at:
            ids.append(last[at - 1])
            at -= size[last[at - 1]]
        ids.reverse()
        return ids

    def _part(self, word: str) -> list[int]:
        if all(map(self.id.__contains__, word)):
            return self._run(word)
        out: list[int] = []
        for known, run in itertools.groupby(word, self.id.__contains__):
            if known:
                out.extend(self._run("".join(run)))
            elif self.fallback:
                out.extend(self.bytes[b] for c in run for b in c.encode())
            else:
                out.append(self.sp.unk_id())
        return out

    def _cut(self, text: str) -> Iterator[list[str]]:
        """A text's parts, a block at a time; what stands behind a block's last cut goes into the next one."""
        at, size = 0, BLOCK
        while at < len(text):
            block = text[at : at + size]
            number = self.number[np.frombuffer(block.encode("utf-32-le"), dtype=np.uint32)]
            cuts = (np.flatnonzero(~self.beside[number[:-1], number[1:]]) + 1).tolist()
            if at + size >= len(text):
                cuts.append(len(block))
            elif not cuts:  # a part longer than the block
                size *= 2
                continue
            yield [block[a:b] for a, b in itertools.pairwise([0, *cuts])]
            at, size = at + cuts[-1], BLOCK

    def encode(self, text: str) -> array:
        out = array("I")
        if not self.fallback:  # characters without a piece that stand side by side are one unknown
            out.extend(self._part(self.sp.normalize(text)))
            return out
        for parts in self._cut(self.sp.normalize(text)):
            out.frombytes(b"".join(map(self.parts.__getitem__, parts)))
        return out

    def decode(self, ids: array) -> str:
        """In blocks that end in front of a piece that isn't a byte. A guard stands before all but the first, since a leading space goes."""
        if len(ids) <= BLOCK:
            return self.sp.decode(ids.tolist())
        guard = next(i for i, p in self.piece.items() if p.isascii() and p.isalpha())
        out, at = [], 0
        while at < len(ids):
            end = min(at + BLOCK, len(ids))
            while end < len(ids) and ids[end] not in self.piece:
                end += 1
            part = self.sp.decode([guard, *ids[at:end]])[len(self.piece[guard]) :] if at else self.sp.decode(ids[:end].tolist())
            out.append(part)
            at = end
        return "".join(out)


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encode_documents(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids, decoded) of every row of `docs` (doc_id, text); a narrow pass, no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):  # what a task holds follows a few texts, not a batch
                part = batch.slice(at, 256)
                coded = [model.encode(text or "") for text in part.column(1).to_pylist()]
                offsets = array("i", itertools.accumulate(map(len, coded), initial=0))
                values = pa.array(memoryview(b"".join(c.tobytes() for c in coded)).cast("i"), type=pa.int32())
                ids = pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), values)
                yield pa.RecordBatch.from_arrays([part.column(0), ids, pa.array([model.decode(c) for c in coded], type=pa.string())], ["doc_id", "ids", "decoded"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, ids array<int>, decoded string")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op12_sentence_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = encode_documents(table(spark, sf_dir, "documents", "doc_id", "text"), default_path())
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
