"""Each operator against brute force, on a table with nulls, empty texts, copies, repeated rows and clashing columns."""

import hashlib
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from parlance.llm import bpe, chat_format, common, fingerprints, jaccard_join, license_scan, line_dedup, mixing, quality_classifier, quality_rules, sets, suffix_dedup

SPACES = " \t\n\x0b\x0c\r"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, n long, token string, row string, h string, rank int"


def _text(rng, n):
    vocabulary = ["the", "of", "and", "Tion", "ereau", "stin", "für", "leaux", "niño", "日本"]
    words = [rng.choice(vocabulary) + rng.choice(["", "er", "s", "ing", "en"]) + rng.choice(["", "", "x", "y", "qu"]) for _ in range(n)]
    return re.sub(r" (\w)", lambda m: (".\n" if rng.random() < 0.05 else " ") + m[1], " ".join(words)) + "."


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    base = [_text(rng, rng.choice([3, 40, 120, 300])) for _ in range(24)]
    near = [re.sub(r"\bof\b", "if", b, count=1) for b in base[:8]]
    mixed = [base[1][:600] + " " + _text(rng, 60), base[2] + base[2]]
    texts = [*base, *near, *mixed, base[0], base[0], None, "", " \t\n ", "one two", "one two", "!!", "a" * 1500]
    made = [(i, t, "en", [None, "b", "a", "é"][i % 4]) for i, t in enumerate(texts)]
    made += [made[0], (None, base[3], "en", "a"), (None, None, None, None)]
    return made


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(*r, len(r[1] or ""), "k", 1, "t", "r", "h", 1) for r in rows], DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def words(text):
    return WORD.findall(text or "")


def test_quality_rules(docs, empty, rows):
    out = quality_rules.judge(docs.select("doc_id", "text")).select("text", "verdict.*").collect()
    assert len(out) == len(rows)
    for r in out:
        w, t = words(r["text"]), r["text"] or ""
        seen = Counter(zip(w, w[1:], w[2:]))
        covered = {j for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        lines = [x for x in t.split("\n") if x.strip(SPACES)]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
        assert not (r["base_failed"] and r["kept"])
    assert quality_rules.judge(empty.select("doc_id", "text")).count() == 0


def test_quality_rules_drop_navigation_and_keep_prose(spark):
    prose = _text(random.Random(1), 80)
    menu = " | ".join(f"item{i}" for i in range(80))
    df = spark.createDataFrame([(1, prose), (2, menu), (3, prose + "\n" + " | ".join("abcde"))], "doc_id bigint, text string")
    kept = {r["doc_id"]: (r["verdict"]["kept"], r["verdict"]["cleaned_text"]) for r in quality_rules.judge(df).collect()}
    assert kept[1] == (True, prose) and not kept[2][0] and kept[3] == (True, prose)
    flat = " ".join(words(prose)).replace(".", "")
    lines = [prose, "Alle Rechte vorbehalten", " ".join(flat.split()[:25]), "a heading", "POLÍTICA DE PRIVACIDAD"]
    df = spark.createDataFrame([("\n".join(lines), 1, "x", "y", "z")], "text string, _t int, _lines string, _good string, verdict string")
    out = quality_rules.judge(df).collect()[0]
    assert out["verdict"]["cleaned_text"] == prose + "\na heading" and tuple(out)[:-1] == ("\n".join(lines), 1, "x", "y")
    assert quality_rules.judge(df, name="v").collect()[0]["verdict"] == "z"


def test_mixing_meets_targets(docs, empty, rows):
    mix = mixing.Mix(block_words=16, shard_slots=8, buckets=4)
    sized, pieces = mixing.plan(docs, mix)
    sources = {r["source"]: (r["source_size"], r["target"]) for r in sized.collect()}
    total = sum(len(words(r[1])) for r in rows)
    assert abs(sum(t for _, t in sources.values()) - total) < 1e-6 * total
    assert all(t <= 3 * s + 1e-9 for s, t in sources.values())
    ranks = {r["rank"]: r["source"] for r in sized.select("rank", "source").distinct().collect()}
    taken, per_pass = Counter(), defaultdict(list)
    for p in pieces.collect():
        taken[ranks[p["rank"]]] += p["last"] - p["first"]
        per_pass[p["doc_id"], p["h"], p["again"], p["pass"]].append((p["first"], p["last"]))
    assert all(abs(taken[s] - t) <= 1 for s, (_, t) in sources.items())
    for spans in per_pass.values():  # within a pass no word is taken twice
        spans.sort()
        assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    again = mixing.plan(docs, mix)[1]
    assert sorted(map(tuple, again.collect()), key=str) == sorted(map(tuple, pieces.collect()), key=str)
    assert mixing.plan(empty, mix)[1].count() == 0
    # targets, shared again one source after another
    size = {s: sum(len(words(r[1])) for r in rows if r[3] == s) for s in sources}
    weight = {s: i % 3 + 1 for i, s in enumerate(sorted(size, key=lambda s: (s is None, (s or "").encode("utf-32-be"))))}
    full = set()
    while True:
        level = (total - sum(3 * size[s] for s in full)) / sum(w for s, w in weight.items() if s not in full)
        above = {s for s in size if s not in full and level * weight[s] > 3 * size[s]}
        if not above:
            break
        full |= above
    assert all(abs(sources[s][1] - (3 * size[s] if s in full else level * weight[s])) < 1e-6 for s in size)


def test_permutation_is_one():
    for n in (1, 2, 7, 1000):
        there = mixing.permuted(np.arange(n), n, 99)
        assert sorted(there.tolist()) == list(range(n)) == mixing.permuted(there, n, 99, back=True).tolist()


@pytest.mark.parametrize("recipe", [[(1, 900, 500.0), (2, 37, 111.0), (3, 5000, 5100.0)], [(1, 20, 7.0)], [(1, 16, 16.0), (2, 0, 0.0)]])
def test_slots_have_places_of_their_own(spark, recipe):
    mix = mixing.Mix(block_words=16, shard_slots=8)
    made = mixing.slots(spark, recipe, mix).collect()
    shards = defaultdict(list)
    for r in made:
        shards[r["shard"]].append(r["place"])
    assert all(sorted(x) == list(range(len(x))) for x in shards.values()) and max(map(len, shards.values())) <= 8
    for rank, size, target in recipe:
        own = [r for r in made if r["rank"] == rank]
        assert sum(r["words"] for r in own) == target
        assert len({(r["pass"], r["block"]) for r in own}) == len(own)


def test_bpe_equals_tokenizers(docs, empty, rows):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(bpe.default_path())
    out = bpe.encode_documents(docs, bpe.default_path(), bpe.Chunking(mean_bytes=64, least_bytes=16)).collect()

    def figures(text):
        ids = t.encode(text or "", add_special_tokens=False).ids
        return len(ids), hashlib.sha256(np.array(ids, dtype="<u4").tobytes()).hexdigest(), hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()

    assert Counter((r["doc_id"], *r[1:]) for r in out) == Counter((r[0], *figures(r[1])) for r in rows)
    assert bpe.encode_documents(empty, bpe.default_path()).count() == 0


def test_bpe_joins_are_repaired():
    tokenizers = pytest.importorskip("tokenizers")
    t, rng = tokenizers.Tokenizer.from_file(bpe.default_path()), random.Random(3)
    for text in ("<|endoftext|> a  b\n\n c " * 40, "日本語" * 300 + " é " * 90, "x" * 900, " 　 \n" * 200, _text(rng, 400)):
        data = text.encode()
        ends = bpe.cuts(data, bpe.Chunking(mean_bytes=32, least_bytes=8))
        starts = [0, *ends]
        known = {i: np.array(bpe.encode(bpe.default_path(), data[starts[i] : ends[i]].decode())) for i in range(len(ends)) if rng.random() < 0.6}
        assert bpe.assemble(bpe.default_path(), data, ends, known).tolist() == t.encode(text, add_special_tokens=False).ids


def test_bpe_joins_take_linear_time():
    t, rng = bpe.codec(bpe.default_path()), random.Random(6)
    for letters, gap in (("абвгдежзиклмнопрст", " "), ("的一是不了人我在有他这中大来上国", "，")):
        text = gap.join("".join(rng.choices(letters, k=rng.randint(2, 9))) for _ in range(40_000))
        data = text.encode()
        ends = bpe.cuts(data, bpe.Chunking())
        starts = [0, *ends]
        known = {i: np.array(bpe.encode(bpe.default_path(), data[starts[i] : ends[i]].decode())) for i in range(len(ends))}
        began = time.process_time()
        whole = t.encode(text)
        once = time.process_time() - began
        assert bpe.assemble(bpe.default_path(), data, ends, known).tolist() == whole
        assert time.process_time() - began - once < 3 * once + 1


def test_classifier_learns(spark, empty):
    rng = random.Random(2)
    made = [(i, _text(rng, 60) if i % 4 else " ".join(w + "%%%" for w in words(_text(rng, 60)))) for i in range(400)]
    df = spark.createDataFrame([*made, (1000, None), (1001, "")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i, _ in made] + [(5, None, 1)], "doc_id bigint, quality int, toxic int")
    picked = quality_classifier.sample(df, labels).toPandas()
    model = quality_classifier.fit([np.frombuffer(g, "<i4") for g in picked["grams"]], picked["quality"].tolist())
    out = quality_classifier.score(df, model).collect()
    held = [r for r in out if r["held_out"] and r["doc_id"] < 1000]
    assert held and np.mean([r["predicted"] == int(r["doc_id"] % 4 > 0) for r in held]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in out) and len(out) == 402
    many = quality_classifier.sample(df.union(df).union(df), labels, quality_classifier.Fit(sample=10)).collect()
    assert len(many) == 10
    assert quality_classifier.fit([], []).score(np.zeros(0, np.int32)) == pytest.approx(0.5)
    assert quality_classifier.score(empty, model).count() == 0


def test_dual_coordinate_descent_finds_the_optimum():
    rng = np.random.default_rng(3)
    n, k = 80, 12
    x, y = rng.normal(size=(n, k)), rng.choice([-1, 1], n)
    cost = np.full(n, 0.7)
    w = quality_classifier.dual_coordinate_descent([(np.arange(k), v) for v in x], y, k, cost, 4000, 1)
    full = np.column_stack([x, np.ones(n)])
    primal = lambda w: 0.5 * w @ w + cost @ np.maximum(0, 1 - y * (full @ w))
    v, best = np.zeros(k + 1), np.inf  # a subgradient method with falling steps
    for t in range(1, 40_000):
        short = y * (full @ v) < 1
        v = v - (v - (cost * y * short) @ full) / t
        best = min(best, primal(v))
    assert primal(w) <= best * 1.001


def test_suffix_dedup(docs, empty, rows):
    for how in (suffix_dedup.Spans(length=40, gram=8), suffix_dedup.Spans(length=40, gram=8, hot=1, memory=64)):
        seen = Counter(b[i : i + 40] for b in ((r[1] or "").encode() for r in rows) for i in range(len(b) - 39))
        want = Counter()
        for doc_id, text, *_ in rows:
            b = (text or "").encode()
            gone = {j for i in range(len(b) - 39) if seen[b[i : i + 40]] > 1 for j in range(i, i + 40)}
            spans = sum(1 for j in gone if j - 1 not in gone)
            want[doc_id, len(b), len(gone), spans, hashlib.sha256(bytes(x for j, x in enumerate(b) if j not in gone)).hexdigest()] += 1
        assert Counter(tuple(r)[:5] for r in suffix_dedup.removal(docs, how).collect()) == want
    assert suffix_dedup.removal(empty).count() == 0


def test_suffix_dedup_opens_only_shared_anchors(spark):
    """Anchors are minima: by their top bits alone, a bitmap of few of them lets nearly all through."""
    r = random.Random(4)
    texts = ["".join(r.choices("abcdefgh ", k=3000)) for _ in range(300)]
    found = [suffix_dedup.contexts(np.frombuffer(t.encode(), dtype=np.uint8), suffix_dedup.Spans()).anchor for t in texts]
    few = suffix_dedup.bitmap_of(spark.createDataFrame([(x,) for x in np.concatenate(found[:60]).view(np.int64).tolist()], "key bigint"), 14)
    rest = np.concatenate(found[60:])
    assert suffix_dedup.in_bitmap(few, rest).mean() < 0.2
    # a context alone with its anchor is no shard's
    alone = spark.createDataFrame([(i, 0, b"x" * 900) for i in range(50)], "anchor bigint, same bigint, bytes binary")
    assert suffix_dedup._shards(alone, suffix_dedup.Spans()).count() == 0


def test_suffix_dedup_sends_a_context_once(spark, monkeypatch):
    """However many copies there are and wherever they stand, a context whose anchor others have too goes on once."""
    r = random.Random(6)
    word = lambda: "".join(r.choices("abcdefgh", k=6))
    base = [word() for _ in range(400)]
    near = [" ".join([*base[:i], word(), *base[i + 1 :]]) for i in range(0, 400, 40)]
    docs = spark.createDataFrame([(i, near[i % 10]) for i in range(200)], "doc_id bigint, text string").repartition(20)
    sent, send = [], suffix_dedup._open_contexts
    monkeypatch.setattr(suffix_dedup, "_open_contexts", lambda *a: sent.append(send(*a)) or sent[-1])
    out = {r["doc_id"]: r["n_removed"] for r in suffix_dedup.removal(docs).collect()}
    assert out == {i: len(near[i % 10]) for i in range(200)}
    rows = sent[0].select("anchor", "same").collect()
    assert rows and len(rows) < 1.2 * len(set(rows))
    # a passage in many different texts: parts of its contexts, not a row for each window
    words = [" ".join([*(word() for _ in range(70)), *base[:45], *(word() for _ in range(70))]) for _ in range(60)]
    docs = spark.createDataFrame([*enumerate(words)], "doc_id bigint, text string")
    cold = Counter(map(tuple, suffix_dedup.removal(docs, suffix_dedup.Spans(length=300)).collect()))
    assert sum(r[2] > 0 for r in cold) == 60
    assert Counter(map(tuple, suffix_dedup.removal(docs, suffix_dedup.Spans(length=300, hot=20)).collect())) == cold
    n = [r["c"] for r in sent[-1].groupBy("anchor", "same").agg(F.count("*").alias("c"), F.count("core").alias("k")).filter("k > 0").collect()]
    assert len(n) >= 60 and max(n) <= 20


def test_suffix_dedup_windows_that_repeat_within():
    r = random.Random(5)
    part = "".join(r.choices("ab", k=70))
    how = suffix_dedup.Spans(length=40, gram=8)
    for text in ("a" * 200, part, part + "c" + part, part[:50] + part + part[20:], "abc" * 50 + part + "abc" * 20):
        b = text.encode()
        want = [i for i in range(len(b) - 39) if sum(b[j : j + 40] == b[i : i + 40] for j in range(len(b) - 39)) > 1]
        assert suffix_dedup.contexts(np.frombuffer(b, dtype=np.uint8), how, inner=True).inner.tolist() == want


def test_induced_sorting():
    rng = random.Random(4)
    for _ in range(20):
        t = [rng.choice((1, 2, 3)) for _ in range(rng.randint(1, 200))] + [0]
        assert suffix_dedup.sorted_suffixes(np.array(t), 10**9, 1 << 9).tolist() == sorted(range(len(t)), key=lambda i: t[i:])


def test_license_scan(spark, empty):
    files = [("1", "a/LICENSE", "Released under the MIT License."), ("2", "a/b/x", "code"), ("3", "c/x", "x = 1\nLicensed under CC BY-NC 4.0.\n" + "y " * 99), ("4", "c/y", None), ("5", None, "")]
    out = {r["file"]: r for r in license_scan.scan(spark.createDataFrame(files, "file string, path string, text string")).collect()}
    assert [(out[f]["license"], out[f]["found"], out[f]["from_path"]) for f in "12345"] == [("MIT", "file", None), ("MIT", "inherited", "a"), ("CC-BY-NC-4.0", "header", None), (None, "none", None), (None, "none", None)]
    assert license_scan.scan(empty.selectExpr("key AS file", "source AS path", "text")).count() == 0


def test_fingerprints(docs, empty, rows):
    out = fingerprints.with_next(docs).collect()
    assert len(out) == len(rows)
    by_text = defaultdict(set)
    ordered = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    for r in out:
        if r["doc_id"] is not None:
            own = next(x for x in rows if x[0] == r["doc_id"])[1] or ""
            by_text[own].add(r["fingerprint"])
            assert r["n_chars"] == len(own) and 0 <= r["near_next"] <= 1
    assert all(len(x) == 1 for x in by_text.values())
    texts = [x[1] or "" for x in ordered]
    want = Counter(hashlib.sha256(fingerprints.edited(t, texts[(i + 1) % len(texts)]).encode()).hexdigest() for i, t in enumerate(texts))
    assert Counter(r["edited_sha256"] for r in out) == want
    assert fingerprints.with_next(empty).count() == 0


def test_fingerprint_is_homomorphic():
    f, a, b = fingerprints.Fingerprint, ["x.", "y.", "y."], ["z."]
    assert f(a + b).hex() == f(b).add(a[::-1]).hex() == f(a + b + ["q"]).remove(["q"]).hex()
    assert fingerprints.likeness(f(a), f(a[::-1])) == 1 and fingerprints.likeness(f(a), f(b)) < 0.5
    for text in (_text(random.Random(8), 200), "a. b.\n\nc", ""):
        new, changed = fingerprints._edit(f(fingerprints.paragraphs(text)), text, "Q. R\nS. T")
        assert changed.hex() == f(fingerprints.paragraphs(new)).hex()


def test_likeness_is_near_the_shared_share():
    rng = random.Random(4)
    errors = []
    for _ in range(40):
        a = [f"{rng.random()}." for _ in range(40)]
        shared = rng.randrange(41)
        b = a[:shared] + [f"{rng.random()}." for _ in range(40 - shared)]
        errors.append(fingerprints.likeness(fingerprints.Fingerprint(a), fingerprints.Fingerprint(b)) - shared / 40)
    assert np.sqrt(np.mean(np.square(errors))) < 0.05 and max(map(abs, errors)) < 0.2


def test_many_equal_paragraphs_dont_wrap():
    some, more = fingerprints.Fingerprint(["x."] * 65_535), fingerprints.Fingerprint(["x."] * 65_536)
    assert more.like.any() and fingerprints.likeness(some, more) > 0.99


def _classes(texts, k, percent):
    low = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = []
    for t in texts:
        w = words((t or "").translate(low))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    return sets, lambda a, b: bool(a and b) and 100 * len(a & b) >= percent * len(a | b)


def test_jaccard_join(docs, empty, rows):
    sets, linked = _classes([r[1] for r in rows], 4, 85)
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if linked(sets[i], sets[j]):
                root = [root[j] if x == root[i] else x for x in root]
    least = {c: min((rows[i][0] for i in range(len(rows)) if root[i] == c and rows[i][0] is not None), default=None) for c in set(root)}
    out = jaccard_join.class_ids(docs).collect()
    assert Counter(map(tuple, out)) == Counter((r[0], len(sets[i]), least[root[i]] if sets[i] else r[0]) for i, r in enumerate(rows))
    assert jaccard_join.class_ids(empty).count() == 0


def test_long_words_differ():
    """Two words of 1,024 letters, the Thue-Morse word and its complement, hash alike under any polynomial modulo 2**64 with an odd base."""
    word = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = word.translate(str.maketrans("ab", "ba"))
    a, b = (sets.word_hashes(x.encode())[0] for x in (word, other))
    assert a != b and a == sets.word_hashes(word.upper().encode())[0]


def test_one_document_of_each_class_stays(spark):
    rng = random.Random(11)
    base = _text(rng, 120)
    near = base.replace(".", " tail.", 1)
    rows = [(5, base, "a"), (5, near, "b"), (3, near, "x"), (3, near, "x"), (None, base, "c"), (7, None, "d"), (8, "", "e"), (8, "", "e"), (9, _text(rng, 90), "f")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, rowhash string")
    kept = sorted(map(tuple, jaccard_join.stage(spark, df, "").collect()), key=str)
    assert kept == sorted([rows[2], rows[5], rows[6], rows[7], rows[8]], key=str)


def test_line_dedup(docs, empty, rows):
    named = [r for r in rows if r[0] is not None]
    places = sorted({(r[0], i, x) for r in named for i, x in enumerate((r[1] or "").split("\n"))})
    sets, linked = _classes([p[2] for p in places], 5, 80)
    usable = [len(words(p[2])) >= 5 for p in places]
    gone = Counter(p[0] for i, p in enumerate(places) if usable[i] and any(usable[j] and linked(sets[i], sets[j]) for j in range(i)))
    out = line_dedup.dedup(docs.filter("doc_id is not null").select("doc_id", "text")).collect()
    assert {r["doc_id"]: r["n_removed"] for r in out} == {r[0]: gone[r[0]] for r in named}
    assert len(out) == len(named)
    assert line_dedup.dedup(empty.select("doc_id", "text")).count() == 0


def test_chat_format_folds_events(spark):
    log = [(1, 1, 1, "start", "user", None), (1, 2, 1, "delta", None, "Hel"), (1, 4, 1, "delta", None, "lo"), (1, 5, 2, "start", "assistant", None), (1, 6, 2, "delta", None, "bad"), (1, 7, 2, "regenerate", None, None), (1, 8, 2, "delta", None, "go"), (1, 9, 2, "delta", None, "od"), (1, 10, 1, "edit", None, "Hi"), (1, 11, 3, "start", "user", None), (1, 12, 3, "delete", None, None)]
    folded = chat_format.fold(spark.createDataFrame(log, chat_format._EVENT))
    assert sorted(map(tuple, folded.collect())) == [(1, 1, "user", "Hi"), (1, 2, "assistant", "good")]


def test_chat_format_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "<|end|>\n<|turn|>", "a\\b\\\\<s>", "", None, "ü\n日本"]
    rows = [(c, i, role, t) for c in (7, None) for i, t in enumerate(texts) for role in (["assistant", "user<|text|>"][i % 2],)] + [(9, 0, None, None), (9, 0, None, None)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    out = {r["conv_id"]: r for r in chat_format.read_back(chat_format.render(chat_format.fold(chat_format.log_of(df)))).collect()}
    assert [(t["role"], t["text"]) for t in out[7]["turns"]] == [(r[2], r[3] or "") for r in rows[: len(texts)]]
    assert out[7]["loss_texts"] == [t or "" for t in texts[::2]]
    assert len(out[9]["turns"]) == 2 and len(out) == 3
    assert chat_format.read_back(chat_format.render(chat_format.fold(chat_format.log_of(df.limit(0))))).count() == 0


def test_chat_logs_have_all_kinds_and_fold_back(spark):
    rng = random.Random(6)
    rows = [(c, t, ["user", "assistant"][t % 2], "".join(rng.choice("ab \n日") for _ in range(rng.choice([0, 3, 10, 11, 500])))) for c in range(8) for t in range(6)]
    log = chat_format.log_of(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"), delta=10, deltas=16)
    events = log.collect()
    assert {e["kind"] for e in events} == {"start", "delta", "edit", "regenerate", "delete"}
    assert len({(e["conv_id"], e["seq"]) for e in events}) == len(events)
    folded = sorted(chat_format.fold(log).collect(), key=lambda r: (r["conv_id"], r["message"]))
    assert [(r["conv_id"], r["role"], r["text"]) for r in folded] == [(r[0], r[2], r[3]) for r in rows]


def test_rarity_is_not_blurred_by_tokens_seen_once(spark):
    """Tokens seen once add nothing to a cell's count; what a task hands over follows its tokens, not the bitmaps' size."""
    rng = np.random.default_rng(3)
    top = lambda bit: np.uint64(int(bit) << (64 - sets.SEEN_BITS))
    cell = 8 * int(rng.integers(1 << 20))
    once, twice, often = [top(cell + i) for i in range(6)], top(cell + 6), top((1 << 24) + 1)
    parts = []
    for k in range(2):
        stats = sets.Stats()
        stats.add(np.sort(np.array([*once[3 * k : 3 * k + 3], twice], dtype=np.uint64)))
        for _ in range(200):
            stats.add(np.array([often], dtype=np.uint64))
        stats.add(np.sort(rng.integers(1 << 40, 1 << 63, 1000, dtype=np.uint64) | np.uint64(1 << 63)))
        parts += [tuple(r.values()) for r in stats.rows()]
        assert not [*stats.rows()]
    assert sum(len(a) + len(n) for _, a, n in parts) < 2 * 1000 * 30
    f = sets.Rarity(*sets.merged_stats(spark.createDataFrame(parts, sets.STATS_DDL))).frequency(np.array([*once, twice, often], dtype=np.uint64))
    assert f[:6].tolist() == [0.0] * 6
    assert f[6] == 2
    assert 360 <= f[7] <= 400
    a, n = rng.integers(1 << 27, size=900_000, dtype=np.uint64), sets.Stats()
    for x in np.array_split(a << np.uint64(37), 9):
        n.add(x)
    n._merge()
    at, counts = np.unique(a, return_counts=True)
    assert (n.at == at).all() and (n.counts == counts).all()
    assert sum(len(r["at"]) + len(r["counts"]) for r in n.rows()) < 2 * len(at)  # dense arrays: 7 bytes a token and more


def test_written_tables_pass_small_batches(spark):
    """A batch of whole texts stands in memory several times; the session's own limit comes back afterwards."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    sizes = lambda batches: (pa.RecordBatch.from_arrays([pa.array([len(b)])], ["n"]) for b in batches)
    got = [r["n"] for r in common.written(spark.range(0, 5000, 1, 1).mapInArrow(sizes, "n bigint")).collect()]
    assert sum(got) == 5000 and max(got) <= common.MOST_ROWS
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == before
    assert sets._powers(1 << 17)[0].base is sets._powers(1 << 16)[0].base  # one pair of tables for all sizes
