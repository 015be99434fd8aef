"""Operators 11 to 13 against brute force: nulls, ties, repeated rows, long inputs, empty tables, clashing columns."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from parlance.llm import prefix_trie, sentence_pieces, whitening

TURNS = "conv_id bigint, turn bigint, role string, text string, key binary, base string, depth int, n long"


def _digest(role, text):
    role, text = role or "", text or ""
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()


def _trie(rows):
    """Nodes by brute force: every rebuilt conversation against every prefix."""
    own = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            own[conv].append((turn is not None, turn or 0, _digest(role, text), role or "", text or ""))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    built = {}
    for c in own:
        base = c - (c % 5 if c >= 0 else -(-c % 5))
        h = zlib.crc32(str(c).encode()) % 9
        built[c] = tuple(own[c]) if c == base else tuple(own.get(base, [])[:h] + own[c][h:])
    nodes = {s[:d] for s in built.values() for d in range(len(s) + 1)}
    members = {k: sorted(c for c, s in built.items() if s[: len(k)] == k) for k in nodes}
    out = set()
    for k in nodes:
        below = [x for x in nodes if x[: len(k)] == k]
        kids = [x for x in below if len(x) == len(k) + 1]
        leaves = sum(not any(len(y) == len(x) + 1 and y[: len(x)] == x for y in nodes) for x in below)
        saved = sum((len(members[x]) - 1) * len(x[-1][1].encode()) for x in below if x)
        ends = ",".join(str(c) for c in members[k] if built[c] == k)
        out.add((members[k][0], len(k), members[k[:-1]][0] if k else None, len(members[k]), len(kids), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def _nodes(df):
    return [(r["conv_id"], r["depth"], r["parent_conv_id"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"], r["ends_sha256"]) for r in df.collect()]


@pytest.fixture(scope="module")
def turns():
    rng = random.Random(2)
    rows = []
    for conv in [*range(-9, 30), 41, 43, 44]:  # 40 is missing
        if conv % 7 == 3:
            continue
        for turn in range(rng.choice([1, 2, 3, 9, 14])):
            rows.append((conv, turn, "user" if turn % 2 == 0 else "assistant", rng.choice(["hi", "hé", "", "so\nwhat"]) if turn else "hi"))
    rows += [(50, t, "user", f"same {t}") for t in range(12)] + [(51, t, "user", f"same {t}") for t in range(12)]  # deep copies in one family
    rows += [(60 + 5 * i, t, "user", f"copy {t}") for i in range(40) for t in range(3)]  # a large group of copies
    rows += [(7, None, None, None), (7, None, "user", None), (8, 1, "tie", "a"), (8, 1, "tie", "b"), (9, 0, "user", "twice"), (9, 0, "user", "twice"), (None, 0, "user", "lost")]
    return rows


def test_trie(spark, turns):
    df = spark.createDataFrame([(*r, b"k", "b", 1, 1) for r in turns], TURNS).repartition(5)
    got = _nodes(prefix_trie.trie(df))
    assert len(got) == len(set(got))
    assert set(got) == _trie(turns)


def test_trie_in_small_pieces(spark, turns):
    """Pieces of a few ids, every parent hot."""
    df = spark.createDataFrame(turns, "conv_id bigint, turn bigint, role string, text string").repartition(5)
    assert set(_nodes(prefix_trie.trie(df, prefix_trie.Families(piece=5, hot=1 << 30)))) == _trie(turns)


def test_trie_of_a_long_conversation(spark):
    """Suffix sums of a path far deeper than the shared levels."""
    rows = [(1, t, "user", "x" * (t % 3)) for t in range(3000)] + [(6, t, "user", "x" * (t % 3)) for t in range(2000)]
    got = {(r["conv_id"], r["depth"]): r for r in prefix_trie.trie(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    h = {c: zlib.crc32(str(c).encode()) % 9 for c in (1, 6)}
    assert len({d for _, d in got}) == 3000 - h[1] + 1
    same = h[1] % 3 == h[6] % 3
    assert (got[1, 0]["n_convs"], got[1, 0]["n_leaves"]) == (2, 2 if not same or 2000 - h[6] < 3000 - h[1] and not same else 1)


def test_trie_of_nothing(spark):
    assert prefix_trie.trie(spark.createDataFrame([], TURNS)).collect() == []
    assert _nodes(prefix_trie.trie(spark.createDataFrame([(None, 1, "user", "x")], "conv_id bigint, turn bigint, role string, text string"))) == []


@pytest.fixture(scope="module")
def model():
    return sentence_pieces.pieces(sentence_pieces.default_path())


def test_pieces_equal_the_library(model):
    rng = random.Random(4)
    listed, odd = list(model.piece.values()), ["\n", "\t", "\0", "日本", "▁", "    ", "<s>", "</s>", "<0x0A>", "Ḁ", "😀", "ﬁ", " ", "aaaa", " " * 17]
    for _ in range(3000):
        parts = [rng.choice(odd) if rng.random() < 0.2 else rng.choice(listed).replace("▁", rng.choice([" ", "", "▁"])) for _ in range(rng.choice([1, 2, 6, 25]))]
        text = "".join(parts) * rng.choice([1, 1, 3])
        ids = model.sp.encode(text)
        assert model.encode(text).tolist() == ids, text
        assert model.decode(model.encode(text)) == model.sp.decode(ids)


def test_pieces_of_long_words_and_blocks(model, monkeypatch):
    for text in ("a" * 200_000, "ab" * 50_000, " " * 100_000, "the quick " * 40_000, "\n" * 3000, "日" * 5000, "é😀" * 3000):
        ids = model.sp.encode(text)
        assert model.encode(text).tolist() == ids
    monkeypatch.setattr(sentence_pieces, "KEPT_PARTS", 3)
    monkeypatch.setattr(sentence_pieces, "BLOCK", 7)
    for text in ("  leading and\n\nmore 😀😀 words é Ḁ " * 9, " x", "x", ""):
        assert model.encode(text).tolist() == model.sp.encode(text)
        assert model.decode(model.encode(text)) == model.sp.decode(model.sp.encode(text))


def test_pairs_without_the_shortcut(model):
    """The walk along the two edges says what merging for real says."""
    rng = random.Random(6)
    listed = [p for p in model.piece.values() if len(p) < 9]
    for _ in range(4000):
        a, b = rng.choice(listed), rng.choice(listed)
        if rng.random() < 0.5:
            whole = rng.choice(listed)
            k = rng.randrange(1, len(whole)) if len(whole) > 1 else 1
            a, b = whole[:k], (whole[k:] or b)
            if a not in model.id or b not in model.id:
                continue
        assert model._may_follow(a, b) == (model._merged([*a, *b]) == [a, b]), (a, b)


def test_piece_documents(spark, model):
    rows = [(1, "Hello  wörld"), (1, "Hello  wörld"), (2, None), (3, ""), (None, "x\n"), (4, " "), (5, "word " * 30_000)]
    df = spark.createDataFrame([(*r, [1], "d", 2) for r in rows], "doc_id bigint, text string, ids array<int>, decoded string, n_tokens int").repartition(3)
    got = sorted(((r["doc_id"], r["ids"], r["decoded"]) for r in sentence_pieces.encode_documents(df, sentence_pieces.default_path()).collect()), key=repr)
    assert got == sorted(((i, ids := model.sp.encode(t or ""), model.sp.decode(ids)) for i, t in rows), key=repr)
    assert sentence_pieces.encode_documents(df.limit(0), sentence_pieces.default_path()).collect() == []


def _whitened(rows, k=4):
    """By numpy over Python's whole numbers."""
    fine = [(i, v) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    d = max((len(v) for _, v in fine), default=0)
    x = [(i, tuple([int(np.floor(256 * np.float64(np.float32(c)))) for c in v] + [0] * (d - len(v)))) for i, v in fine]
    fit = sorted({v for _, v in x})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    y = np.array(fit, dtype=float) - np.array(sums) / n
    cov = y.T @ y / n
    values, vectors = np.linalg.eigh(cov)
    out = {}
    for i, v in x:
        dev = sum((n * c - s) ** 2 for c, s in zip(v, sums))
        w = (np.array(v, dtype=float) - np.array(sums) / n) @ vectors
        for j in range(1, k + 1):
            if j <= d and values[-j] > 1e-9 * np.trace(cov):
                out.setdefault((i, j), []).append((n, dev, abs(w[-j]) / np.sqrt(values[-j]), values[-j] / np.trace(cov)))
    return out


def _same(spark, rows, how=whitening.Lanczos(), tolerance=1e-9):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id bigint, embedding array<float>, x string, component int").repartition(3)
    got = defaultdict(list)
    for r in whitening.whiten(df, how).collect():
        got[r["vec_id"], r["component"]].append((r["n"], int(r["deviation"]), abs(r["whitened"]), r["explained"]))
        assert r["identity_error"] < 1e-9
    want = _whitened(rows)
    assert got.keys() == want.keys()
    for key, listed in want.items():
        for a, b in zip(sorted(got[key]), sorted(listed), strict=True):
            assert a[:2] == b[:2] and abs(a[2] - b[2]) < tolerance and abs(a[3] - b[3]) < 1e-9, key
    return got


def test_whitening(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((300, 40)) * np.linspace(3, 0.2, 40)
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(1000 + i, base[0].tolist()) for i in range(100)] + [rows[5], (None, base[6].tolist())]  # copies count once in the fit
    rows += [(2000, None), (2001, [None] * 40), (2002, [float("nan")] + [0.0] * 39), (2003, [float("inf")] + [0.0] * 39), (2004, [-0.0] * 40), (2005, [0.5, 0.25])]
    got = _same(spark, rows)
    assert len(got) == 4 * (300 + 100 + 3)
    signed = {(r["vec_id"], r["component"]): r["whitened"] for r in whitening.whiten(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")).collect()}
    w = np.array([[signed[i, j] for j in (1, 2, 3, 4)] for i in [*range(300), 2004, 2005]])
    assert np.abs(np.cov(w.T, bias=True) - np.eye(4)).max() < 1e-9  # signs are the same for all rows


def test_whitening_in_small_blocks(spark):
    """Many steps, equal eigenvalues, blocks that break down."""
    rng = np.random.default_rng(3)
    wide = rng.standard_normal((200, 30)) * np.geomspace(20, 0.1, 30)
    _same(spark, [(i, v.tolist()) for i, v in enumerate(wide)], whitening.Lanczos(block=3), 1e-7)
    low = rng.standard_normal((60, 5)) @ np.diag([9, 7, 5, 3, 2]) @ np.linalg.qr(rng.standard_normal((25, 5)))[0].T
    got = _same(spark, [(i, (np.round(v * 256) / 256).tolist()) for i, v in enumerate(low)], whitening.Lanczos(block=4), 1e-7)
    assert len(got) == 4 * 60
    corners = [(i, [1.0 if b == i // 2 else 0.0 for b in range(6)]) for i in range(12)]
    out = whitening.whiten(spark.createDataFrame([(i, [*v, float(i % 2)]) for i, v in corners], "vec_id bigint, embedding array<float>"), whitening.Lanczos(block=2)).collect()
    assert len(out) == 48 and out[0]["identity_error"] < 1e-9  # five equal eigenvalues: any basis of their space


def test_whitening_of_little(spark):
    schema = "vec_id bigint, embedding array<float>"
    few = [(1, [1.0, 2.0]), (2, [3.0, -1.0]), (3, [0.0, 0.5])]
    assert {k[1] for k in _same(spark, few)} == {1, 2}
    assert {k[1] for k in _same(spark, [(1, [1.0, 2.0, 3.0]), (2, [2.0, 4.0, 6.0])])} == {1}
    for rows in ([], [(1, None)], [(1, [1.0, 2.0]), (2, [1.0, 2.0])], [(1, [])]):
        assert whitening.whiten(spark.createDataFrame(rows, schema)).collect() == []


def test_exact_deviations():
    of = whitening.Fit(10**9, 3, (3 * 10**11, -7, 0), 1)
    x = np.array([[2**40, -5, 1], [0, 0, 0]])
    assert of.deviation(x) == [sum((of.n * int(c) - s) ** 2 for c, s in zip(v, of.sums)) for v in x]
