"""The pipeline: each of its five stages against brute force on its own input, then all of them as run() puts them together."""

import hashlib
import os
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from parlance.llm import bpe, quality_rules

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def _sentence(rng, n):
    return " ".join(rng.choice("lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt labore magna aliqua".split()) + rng.choice(["", "s", "ed", "or", "us"]) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(12)
    paragraph = [_sentence(rng, rng.choice([12, 18, 25])) for _ in range(60)]
    base = ["\n".join(rng.sample(paragraph, 5) + [_sentence(rng, 20) for _ in range(3)]) for _ in range(26)]
    near = [re.sub(r"\bsit\b", "set", b, count=1) for b in base[:6]]
    bad = ["too short", "", None, "###### $$$$ **** #### %%%% &&&&\n" * 6 + base[0][:200], "same words again. " * 60, " \n\t "]
    part = [base[7] + "\n| Home | About | Contact | Help | More |\n" + base[8].split("\n")[0], base[9] + "\n" + "unended words without any mark at all that go on and on " * 3]
    texts = [*base, *near, base[3], base[3], *bad, *part]
    return [(i, t, "en", ["a", "b", "a", None][i % 4], len(t) if t is not None else None) for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def stages(spark, rows):
    """Each stage's input and output."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs, out = spark.createDataFrame(rows, SCHEMA).repartition(3), {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = stage(spark, docs, "").cache()
        out[name] = (before, docs.collect())
        if name != "bpe":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    return out


def test_quality_rules_stage(stages):
    before, after = stages["quality_rules"]
    how, want = quality_rules.Rules(), {}
    for r in before:
        text = r["text"] or ""
        words = WORD.findall(text)
        seen = Counter(zip(words, words[1:], words[2:], strict=False))
        covered = {j for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        if len(words) < 50 or 100 * len(covered) > 50 * len(words):
            continue
        good, lost = [], 0
        for line in text.split("\n"):
            n = len(re.findall(r"[\x20\x09-\x0D]", line)) + 1
            marks = lambda chars, line=line: sum(c in chars for c in line)
            bad = any(marks(c) >= least and 100 * marks(c) > 30 * n for c, least in (("#*$%&<>", 3), ("!?", 6), ("|»›•·", 3)))
            bad |= n <= 30 and bool(re.search(f"(?i){how.phrases}", line)) or n >= 20 and not re.search(quality_rules.MARKS, line)
            good += [] if bad else [line]
            lost += sum(map(len, WORD.findall(line))) if bad else 0
        if 100 * lost <= 50 * sum(map(len, words)):
            want[r["doc_id"]] = "\n".join(good)
    assert {r["doc_id"]: r["text"] for r in after} == want and len(after) == len(want) < len(before)
    assert any(want[r["doc_id"]] != r["text"] for r in before if r["doc_id"] in want)


def _shingles(words, k):
    return {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} or ({tuple(words)} if words else set())


def _fold(text):
    return WORD.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def test_line_dedup_stage(stages):
    before, after = stages["line_dedup"]
    lines = sorted(((r["doc_id"], i, x) for r in before for i, x in enumerate((r["text"] or "").split("\n"))), key=lambda x: x[:2])
    sets = [_shingles(_fold(x), 5) for _, _, x in lines]
    gone = {lines[b][:2] for b in range(len(lines)) for a in range(b) if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    kept = defaultdict(list)
    for doc, i, x in lines:
        kept[doc] += [] if (doc, i) in gone else [x]
    removed = {doc for doc, _ in gone}
    want = {doc: "\n".join(x) for doc, x in kept.items() if doc not in removed or "\n".join(x).strip()}
    assert {r["doc_id"]: r["text"] for r in after} == want and gone


def test_jaccard_stage(stages):
    before, after = stages["jaccard_join"]
    sets = {r["doc_id"]: _shingles(_fold(r["text"]), 5) for r in before}
    group = {d: d for d in sets}

    def root(d):
        while group[d] != d:
            d = group[d]
        return d

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                group[y] = x
    assert sorted(r["doc_id"] for r in after) == sorted({root(d) for d in sets})


def test_jaccard_stage_on_copies(spark, rows):
    """The lines of copies are gone before it in the pipeline; on documents that still have theirs it keeps one of each."""
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    kept = {r["doc_id"] for r in dict(corpus_pipeline.STAGES)["jaccard_join"](spark, spark.createDataFrame(rows, SCHEMA), "").collect()}
    assert set(range(26)) <= kept and not kept & set(range(26, 34))  # six near copies and two exact ones go


def test_mixing_stage(stages):
    before, after = stages["mix_sources"]
    size = defaultdict(int)
    for r in before:
        size[r["source"]] += len(WORD.findall(r["text"] or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(sorted(size, key=lambda s: (s is None, s or "")))}
    total, full = sum(size.values()), set()
    while True:
        level = (total - sum(3 * size[s] for s in full)) / sum(w for s, w in weight.items() if s not in full)
        above = {s for s in size if s not in full and level * weight[s] > 3 * size[s]}
        if not above:
            break
        full |= above
    taken, whole = defaultdict(int), {r["doc_id"]: r for r in before}
    for r in after:
        words, own = WORD.findall(r["text"]), WORD.findall(whole[r["doc_id"]]["text"])
        taken[r["source"]] += len(words)
        left = iter(own)
        assert all(any(w == x for x in left) for w in words) and r["source"] == whole[r["doc_id"]]["source"]  # its own words, in order
    for s in size:
        assert abs(taken[s] - (3 * size[s] if s in full else level * weight[s])) <= 1


def test_bpe_stage(stages):
    before, after = stages["bpe"]
    library = Tokenizer.from_file(bpe.default_path())

    def figures(text):
        ids = library.encode(text or "", add_special_tokens=False).ids
        return len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()

    assert Counter((r["doc_id"], *figures(r["text"])) for r in before) == Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in after)


def test_run_is_the_stages(spark, rows, stages, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    assert Counter(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).collect())) == Counter(map(tuple, stages["bpe"][1]))


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are absent")
def test_stages_keep_columns_and_reduce(spark):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    counts = [docs.count()]
    columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns
        counts.append(docs.count())
    assert counts[0] > counts[1] >= counts[2] >= counts[3] > 0.5 * counts[0]
