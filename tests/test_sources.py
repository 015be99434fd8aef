import hashlib
import json
import struct

import pyarrow as pa
import pytest

from parlance.plans import catalog
from parlance.sources import image_sources, readers, tokenizer_file
from parlance.streaming.custom_input import CustomInput


@pytest.mark.parametrize(("url", "want"), [("data:image/png;base64,QUJD", b"ABC"), ("DATA:image/JPG ;x=y;BASE64,QU JD", b"ABC"), ("data:image/gif,a%20b#c", b"a b"), ("data:image/webp;base64,QQ", b"A")])
def test_data_urls(url, want):
    assert image_sources.parse_data_url(url)[1] == want


@pytest.mark.parametrize(("url", "kind"), [("http://x", "invalid_data_url"), ("data:text/plain,x", "unsupported_media_type"), ("data:image/png;base64,Q", "invalid_base64"), ("data:image/png;base64,Q*==", "invalid_base64")])
def test_data_url_errors(url, kind):
    with pytest.raises(image_sources.ImageError) as e:
        image_sources.parse_data_url(url)
    assert e.value.kind == kind


def test_dimensions():
    assert image_sources.dimensions(b"\x89PNG\r\n\x1a\n" + b"\0" * 8 + struct.pack(">II", 3, 4)) == (3, 4)
    assert image_sources.dimensions(b"GIF89a" + struct.pack("<HH", 5, 6)) == (5, 6)
    assert image_sources.dimensions(b"\xff\xd8\xff\xe0\0\4ab\xff\xc0\0\x11\x08" + struct.pack(">HH", 7, 8) + b"\0") == (8, 7)
    assert image_sources.dimensions(b"junk") is None


def test_retries():
    slept, left = [], [image_sources.FetchError(), image_sources.FetchError(503)]

    def fetch(url):
        if left:
            raise left.pop()
        return b"x"

    assert image_sources.fetched("u", fetch, slept.append) == b"x" and slept == [0.3, 0.6]
    with pytest.raises(image_sources.FetchError):
        image_sources.fetched("u", lambda u: (_ for _ in ()).throw(image_sources.FetchError(404)), slept.append)
    assert slept == [0.3, 0.6]


def test_resolve(spark):
    rows = [(1, 0, "data_url", "data:image/png;base64,QUJD", None, None), (1, 1, "url", None, "http://x", None), (1, 2, "bytes", None, None, bytearray(b"GIF89a\5\0\6\0"))]
    df = spark.createDataFrame(rows, "request bigint, idx bigint, kind string, data_url string, url string, data binary")
    got = [(r["n_bytes"], r["width"], r["error"]) for r in image_sources.resolve(df).orderBy("idx").collect()]
    assert got == [(3, None, None), (None, None, "fetch_disabled"), (10, 5, None)]


@pytest.mark.parametrize(("whole", "want"), [('{"input":"a\\nb\\u00e9\\ud83d\\ude00\\"x"}', 'a\nbé😀"x'), ('{ "input" : "" }', ""), ("plain", "plain"), ('{"other":1}', '{"other":1}'), ('{"input":"cut \\u00', "cut \\u00")])
def test_custom_input(whole, want):
    for n in (1, 2, 5, 100):
        c = CustomInput()
        assert "".join(c.feed(whole[i : i + n]) for i in range(0, len(whole), n)) + c.finish() == want


def test_sse_and_mock(spark):
    from parlance.streaming import processing

    events = processing.to_events(readers.mock_backend(spark), "chat_completions")
    frames = [r["frame"] for r in readers.sse(events, True).orderBy("event_seq").collect()]
    assert frames[0].startswith('data: {"id":"1"') and frames[-1] == "data: [DONE]\n\n" and len(frames) == 5


def test_tokenizer_against_library(spark, tmp_path):
    tokenizers = pytest.importorskip("tokenizers")
    public = pytest.importorskip("public_tokenizers")
    path = public.path("byte_bpe_50k.json")
    ours, theirs = tokenizer_file.Tokenizer.load(path), tokenizers.Tokenizer.from_file(path)
    for piece in ("hello", " world", "日本", "ééé", "aaaaaaaaaaaa", "!?;"):
        assert ours.encode_piece(piece) == theirs.encode(piece, add_special_tokens=False).ids
    assert ours.decode([50256, 15496], True) == "Hello" and ours.vocab_size() == 50257
    texts = ["Hello 12345 it's  x don't", "日本語、テスト 1234\n\n  a", "<|endoftext|> é　b ", "", None]
    rows = [(2, texts[0]), (2, texts[1]), (None, texts[2]), (None, texts[3]), (5, texts[4])]
    got = tokenizer_file.encode(spark.createDataFrame(rows, "k bigint, t string"), "k", "t", ours).collect()
    want = [(k, theirs.encode(t or "", add_special_tokens=False).ids) for k, t in rows]
    assert sorted(((r["k"], r["ids"]) for r in got), key=str) == sorted(want, key=str)


def _spec(**more):
    splits = [{"type": "Split", "pattern": {"Regex": p}, "behavior": "Isolated", "invert": False} for p in tokenizer_file.PATTERNS]
    pre = {"type": "Sequence", "pretokenizers": [*splits, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
    vocab = {c: i for i, c in enumerate(tokenizer_file.LETTER.values())}
    merges = ["Ġ t", "h e", "Ġt he", "l l", "1 2"]
    vocab |= {m.replace(" ", ""): 256 + i for i, m in enumerate(merges)}
    model = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False, "vocab": vocab, "merges": merges}
    decoder = {"type": "ByteLevel", "add_prefix_space": True, "trim_offsets": True, "use_regex": True}
    return {"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": pre, "post_processor": None, "decoder": decoder, "model": model} | more


def _added(content, id_, **flags):
    return {"id": id_, "content": content, "single_word": False, "lstrip": False, "rstrip": False, "normalized": False, "special": False} | flags


def test_tokenizer_files_that_are_refused():
    spec = _spec()
    tokenizer_file.Tokenizer.of(spec)
    steps = spec["pre_tokenizer"]["pretokenizers"]
    sequence = lambda *s: {"pre_tokenizer": {"type": "Sequence", "pretokenizers": [*s]}}
    other = steps[0] | {"pattern": {"Regex": "zzz"}}
    for change in (
        {"pre_tokenizer": None}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": steps[3]}, {"pre_tokenizer": {"type": "ByteLevel", "add_prefix_space": True}}, sequence(*steps[1:]), sequence(other, *steps[1:]), sequence(steps[1], steps[0], *steps[2:]),
        sequence(steps[0] | {"invert": True}, *steps[1:]), sequence(steps[0] | {"behavior": "Removed"}, *steps[1:]), sequence(steps[0] | {"pattern": {"String": tokenizer_file.PATTERNS[0]}}, *steps[1:]), sequence(*steps[:3], steps[3] | {"use_regex": True}), sequence(*steps[:3], {"type": "Metaspace"}),
        {"normalizer": {"type": "NFC"}}, {"normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}]}}, {"post_processor": {"type": "TemplateProcessing"}}, {"decoder": {"type": "WordPiece"}},
        *({"model": spec["model"] | m} for m in ({"type": "Unigram"}, {"dropout": 0.1}, {"ignore_merges": True}, {"unk_token": "nowhere"}, {"merges": ["q q"]}, {"merges": [["zz", "a"]]})),
    ):
        with pytest.raises(ValueError, match="unsupported tokenizer"):
            tokenizer_file.Tokenizer.of(spec | change)
    tokenizer_file.Tokenizer.of(spec | {"normalizer": {"type": "Sequence", "normalizers": []}, "post_processor": {"type": "ByteLevel"}, "decoder": None, "model": spec["model"] | {"dropout": 0.0}})


TEXTS = ["the llama 1234 the", " the<a>the", "x <a>  <b> y", "<a><ab><abc>", "no nose no", "no.no _no no1", "\t<b>\n<b> ", "日本 the日本語テスト 12345", "it's (ok) !ab", "", "  ", "<ab", "a<s>b", "NO<a>no", None]


@pytest.mark.parametrize("change", [
    {}, {"added_tokens": [_added("<a>", 261), _added("<ab>", 262), _added("<abc>", 263), _added("<ab", 264)]}, {"added_tokens": [_added("<b>", 261, lstrip=True), _added("<a>", 262, rstrip=True), _added("no", 263, single_word=True)]},
    {"added_tokens": [_added("no", 261, normalized=True), _added("no nose", 262, normalized=True), _added("nose", 263), _added("<s>", 264, special=True), _added(" <a> ", 265, normalized=True, lstrip=True, rstrip=True)]},
    {"prefix_space": True}, {"model": {"unk_token": "<u>", "fuse_unk": True}, "drop": "the日"}, {"model": {"unk_token": "<u>"}, "drop": "aox"}, {"drop": "al"}, {"model": {"byte_fallback": True}, "drop": "ae", "bytes": True}, {"model": {"end_of_word_suffix": "</w>"}, "ends": True}, {"model": {"continuing_subword_prefix": "##"}, "inner": True},
])
def test_tokenizer_options_against_the_library(spark, tmp_path, change):
    """Files with three splits: added tokens with their flags, unknown letters, byte fallback, word ends, inner prefixes."""
    tokenizers = pytest.importorskip("tokenizers")
    spec = _spec(added_tokens=change.get("added_tokens", []))
    vocab = spec["model"]["vocab"]
    if change.get("prefix_space"):
        spec["pre_tokenizer"]["pretokenizers"][3]["add_prefix_space"] = True
    spec["model"] |= change.get("model", {})
    if "<u>" in (spec["model"]["unk_token"] or ""):
        vocab["<u>"] = 290
    if change.get("bytes"):
        vocab |= {f"<0x{b:02X}>": 400 + b for b in range(256)}
    if change.get("ends"):
        vocab |= {f"{c}</w>": 700 + i for i, c in enumerate(tokenizer_file.LETTER.values())}
        vocab["he</w>"], spec["model"]["merges"] = 999, [*spec["model"]["merges"], "h e</w>"]
    if change.get("inner"):
        vocab |= {f"##{c}": 700 + i for i, c in enumerate(tokenizer_file.LETTER.values())}
        vocab |= {"##he": 1000, "l##l": 1001}
        spec["model"]["merges"] = ["##h ##e", "l ##l"]
        vocab["ll"] = vocab.pop("ll", 259)
    for c in change.get("drop", "").encode():
        vocab.pop(tokenizer_file.LETTER[c], None)
    spec["model"]["merges"] = [m for m in spec["model"]["merges"] if all(x in vocab for x in m.split(" "))]
    path = tmp_path / "t.json"
    path.write_text(json.dumps(spec))
    ours, theirs = tokenizer_file.Tokenizer.load(str(path)), tokenizers.Tokenizer.from_file(str(path))
    got = tokenizer_file.encode(spark.createDataFrame(list(enumerate(TEXTS)), "k int, t string").repartition(2), "k", "t", ours).collect()
    assert {r["k"]: r["ids"] for r in got} == {k: theirs.encode(t or "", add_special_tokens=False).ids for k, t in enumerate(TEXTS)}
    for t in TEXTS:
        ids = theirs.encode(t or "", add_special_tokens=False).ids
        if not change.get("ends") and not change.get("inner") and not change.get("bytes"):
            assert ours.decode(ids) == theirs.decode(ids, skip_special_tokens=False)


def test_data_urls_are_read_as_urls():
    for url in (" DATA:image/png;base64,eHl6", "da\tta:image/png;base64,eHl6"):
        assert image_sources.parse_data_url(url)[0] == "image/png"


def test_prompts_are_encoded_as_the_library_does(spark):
    tokenizers, public = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    theirs = tokenizers.Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    d = "/root/testdata/sf0.001"
    prompts = {r["conv_id"]: r["prompt"] for r in catalog.QUERIES["render_prompt_v41"](spark, d).collect()}
    got = catalog.QUERIES["encode_prompt"](spark, d).collect()
    want = {c: theirs.encode(p, add_special_tokens=False).ids for c, p in prompts.items()}
    assert {r["conv_id"]: (r["n_tokens"], r["ids_sha256"]) for r in got} == {c: (len(i), hashlib.sha256(",".join(map(str, i)).encode()).hexdigest()) for c, i in want.items()}


def test_batches_in_runs_of_bounded_size():
    lists = [["x"] * n for n in (3, 0, 4, 20, 1, 1, 5, 0)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8)), pa.array(lists, pa.list_(pa.string()))], ["k", "pieces"])
    for b, want in ((batch, [[0, 1, 2], [3], [4, 5, 6, 7]]), (batch.slice(2), [[2], [3], [4, 5, 6, 7]]), (batch.slice(0, 0), [])):
        got = list(tokenizer_file._slices(b, 7))
        assert [x.column(0).to_pylist() for x in got] == want
        assert [y for x in got for y in x.column(1).to_pylist()] == b.column(1).to_pylist()


def test_encode_in_runs(spark, monkeypatch):
    """Runs of a few pieces, or one, give the ids of whole batches; nulls, empty texts and long pieces among them."""
    path = pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")
    t = tokenizer_file.Tokenizer.load(path)
    rows = [(i, x) for i, x in enumerate([None, "", "a b c", "z" * 500, "one <|endoftext|> two", "", "x " * 50] * 3)]
    df = spark.createDataFrame(rows, "k bigint, t string").coalesce(1)
    want = {r["k"]: r["ids"] for r in tokenizer_file.encode(df, "k", "t", t).collect()}
    monkeypatch.setattr(tokenizer_file, "AT_ONCE", 2)
    assert {r["k"]: r["ids"] for r in tokenizer_file.encode(df, "k", "t", t).collect()} == want
    assert {k: t.decode(v) for k, v in want.items()} == {k: x or "" for k, x in rows}
