"""Folds of events wherever a stream breaks off, over micro-batches, natively; token-id chunks; what a request hands to its stream."""

import json
import random

import pytest
from pyspark.sql import functions as F

from parlance.functions import tokens as T
from parlance.operators import accumulating, conversion
from parlance.streaming import folds, processing
from parlance.streaming.parser import Options

D = T.DSML
CALL = f'\n\n<{D}tool_calls>\n<{D}invoke name="NAME">\n<{D}parameter name="input" string="true">x"é\n</{D}parameter>\n</{D}invoke>\n</{D}tool_calls>'
OUTPUTS = ["hm\n</think>answer " * 3, "why</think>so" + CALL.replace("NAME", "note"), "</think>" + CALL.replace("NAME", "box::open"), "only thought", "t</think>plain"]
O = Options(parse_tools=True, reasoning="start", custom_tools=("note",))


def _chunks(spark, outputs=OUTPUTS, size=4):
    rows = [(i, -1, "ready", None, 7, "fp", None) for i in range(len(outputs))]
    rows += [(i, k // size, "text", o[k : k + size], None, None, None) for i, o in enumerate(outputs) for k in range(0, len(o), size)]
    rows += [(i, 1000, "finish", None, None, None, "stop") for i in range(len(outputs)) if i != 3]
    return spark.createDataFrame([(*r[:4], 1, r[4], 0, r[5], r[6]) for r in rows], processing.CHUNK)


@pytest.fixture(scope="module")
def events(spark):
    return {d: processing.to_events(_chunks(spark), d, O).cache() for d in folds.FOLDS}


def _responses(df):
    return {r["stream_id"]: json.loads(r["response"]) for r in df.collect()}


@pytest.mark.parametrize("dialect", list(folds.FOLDS))
def test_folds_of_whole_streams(spark, events, dialect):
    want = _responses(processing.to_responses(_chunks(spark), dialect, O))
    assert _responses(processing.accumulate(events[dialect], dialect)) == want
    again = events[dialect].unionByName(events[dialect])  # events that come twice
    assert _responses(processing.accumulate(again, dialect)) == want


def test_streams_that_break_off(spark, events):
    """After any number of events there is what they said; the native form says the same."""
    rng = random.Random(3)
    listed = {}
    for r in events["responses"].orderBy("event_seq").collect():
        listed.setdefault(r["stream_id"], []).append(r["data"])
    cut, want, n = [], {}, 0
    for stream in listed.values():
        for end in sorted({*range(1, 8), *rng.sample(range(1, len(stream) + 1), 6), len(stream)}):
            if end <= len(stream):
                cut += [(n, i, None, d) for i, d in enumerate(stream[:end])]
                want[n] = folds.collect("responses", [json.loads(d) for d in stream[:end]])
                n += 1
    df = spark.createDataFrame(cut, processing.EVENT).repartition(3)
    assert _responses(processing.accumulate(df, "responses")) == want
    said = lambda i: i.get("arguments", i.get("input", (i.get("content") or [{"text": ""}])[0]["text"]))
    items = {(s, k): (i["id"], i["type"], i["status"], i.get("call_id"), i.get("name"), i.get("namespace"), said(i), r["status"]) for s, r in want.items() for k, i in enumerate(r["output"])}
    got = accumulating.accumulated_items(df).collect()
    assert {(r["stream_id"], r["output_index"]): (r["item_id"], r["kind"], r["status"], r["call_id"], r["name"], r["namespace"], r["text"], r["stream_status"]) for r in got} == items
    assert any(v[2] == "in_progress" and v[6] for v in items.values())


def test_events_that_do_not_fit_are_passed_over(spark):
    item = {"id": "m", "type": "message", "status": "in_progress", "role": "assistant", "content": []}
    part = {"type": "output_text", "text": ""}
    e = lambda kind, **b: {"type": f"response.{kind}"} | b
    events = [
        e("output_item.added", output_index=1, item=item), e("output_item.added", output_index=0, item=item), e("content_part.added", output_index=0, item_id="x", content_index=0, part=part), e("content_part.added", output_index=0, item_id="m", content_index=1, part=part),
        e("content_part.added", output_index=0, item_id="m", content_index=0, part={"type": "reasoning_text", "text": ""}), e("content_part.added", output_index=0, item_id="m", content_index=0, part=part), e("output_text.delta", output_index=0, item_id="m", content_index=0, delta="a", logprobs=[1]),
        e("output_text.delta", output_index=0, item_id="x", content_index=0, delta="b"), e("output_text.delta", output_index=5, item_id="m", content_index=0, delta="c"), e("function_call_arguments.delta", output_index=0, item_id="m", delta="d"), e("output_item.done", output_index=0, item=item | {"id": "y"}),
        e("output_text.delta", output_index=0, item_id="m", content_index=0, delta="e"),
    ]
    got = folds.collect("responses", events)
    assert [(p["text"], p["logprobs"]) for p in got["output"][0]["content"]] == [("ae", [1])] and len(got["output"]) == 1
    df = spark.createDataFrame([(1, i, None, json.dumps(x)) for i, x in enumerate(events)], processing.EVENT)
    assert [(r["item_id"], r["text"]) for r in accumulating.accumulated_items(df).collect()] == [("m", "ae")]
    assert folds.collect("responses", [])["output"] == [] and folds.collect("messages", []) == {} and folds.collect("chat_completions", [])["usage"] is None
    block = [{"type": "message_start", "message": {"id": "i", "content": []}}, {"type": "content_block_start", "index": 0, "content_block": {"type": "tool_use", "input": {}}}, {"type": "content_block_delta", "index": 0, "delta": {"type": "input_json_delta", "partial_json": '{"a": '}}]
    assert folds.collect("messages", block)["content"] == [{"type": "tool_use", "input": {}}]
    assert folds.collect("messages", [*block, {"type": "content_block_stop", "index": 0}])["content"][0]["input"] == {}


@pytest.mark.parametrize("dialect", ["messages", "responses"])
def test_appending_over_micro_batches(spark, events, tmp_path, dialect):
    df = events[dialect].filter("stream_id <> 3")
    for i in range(5):  # a file a micro-batch; the third comes again
        part = df.filter((F.col("event_seq") % 5 == i) if dialect == "none" else (F.least(F.floor(F.col("event_seq") / 4), F.lit(4)) == i))
        part.coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        if i == 2:
            part.coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(processing.EVENT).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = processing.append_events(stream, dialect).writeStream.format("memory").queryName(f"appended_{dialect}").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert _responses(spark.table(f"appended_{dialect}")) == _responses(processing.accumulate(df, dialect))


class _Letters:
    """Ids are bytes, 256 is a special token, 257 is nothing's."""

    def token_bytes(self, i, skip_special=False):
        return bytes([i]) if i < 256 else b"<end>" if i == 256 else b""


def test_token_ids(spark, monkeypatch):
    monkeypatch.setattr(processing, "_tokenizer", lambda path: _Letters())
    text = "é日本😀 a�b"
    decoder = processing.TokenDecoder("x")
    got = [decoder.push(i) for i in text.encode()]
    assert "".join(g[0] for g in got if g) == text and [g[1] for g in got if g] == [2, 3, 3, 4, 1, 1, 4]  # U+FFFD itself waits for what follows
    assert decoder.push(256) == ("<end>", 1) and decoder.push(257) is None and decoder.push(65) == ("A", 2)
    assert [decoder.push(i) for i in (0xE6, 0x97)] == [None, None]  # never whole: dropped
    p = processing.Processor(1, "chat_completions", Options(), tokenizer="x")
    said = [e for i, t in enumerate("hé".encode()) for e in p.push({"seq": i, "kind": "token", "token_id": t, "content": None, "content_tokens": None})]
    assert [e["choices"][0]["delta"]["content"] for _, e in said] == ["", "h", "é"] and p.usage.completion == 3
    none = processing.Processor(1, "chat_completions", Options())
    error = none.push({"seq": 0, "kind": "token", "token_id": 1, "content": None, "content_tokens": None})
    assert error[0][0] == "error" and none.push({"seq": 1, "kind": "text", "content": "a", "content_tokens": 1}) == [] and none.end() == []


def test_requests_and_their_streams(spark):
    """Converted, parsed and generated: the same names in the same namespace; usage as asked."""
    tools = [{"type": "namespace", "name": "box", "tools": [{"type": "function", "name": "open", "parameters": {"type": "object"}}]}, {"type": "function", "name": "box::shut"}, {"type": "namespace", "name": "a", "tools": [{"type": "function", "name": "b"}]}]
    bodies = [("responses", {"model": "m", "input": "x", "tools": [tools[0], tools[2], {"type": "custom", "name": "apply_patch"}]}), ("responses", {"model": "m", "input": "x", "reasoning": {"effort": "none"}})]
    df = spark.createDataFrame([(i, p, json.dumps(b)) for i, (p, b) in enumerate(bodies)], "stream_id bigint, protocol string, body string")
    names = ["box::open", "apply_patch", "a::b"]
    outputs = ["why</think>" + f"\n\n<{D}tool_calls>\n" + "".join(f'<{D}invoke name="{n}">\n<{D}parameter name="input" string="true">p</{D}parameter>\n</{D}invoke>\n' for n in names) + f"</{D}tool_calls>", "\n\nwhy</think>so"]
    asked = processing.with_requests(_chunks(spark, outputs), conversion.convert(df, "stream_id", protocols=("responses",)))
    got = _responses(processing.to_responses(asked, "responses"))
    kinds = [(i["type"], i.get("namespace"), i.get("name")) for i in got[0]["output"]]
    assert kinds == [("reasoning", None, None), ("function_call", "box", "open"), ("custom_tool_call", None, "apply_patch"), ("function_call", "a", "b")] and got[0]["output"][2]["input"] == "p"
    assert [i["type"] for i in got[1]["output"]] == ["message"] and got[1]["output"][0]["content"][0]["text"] == "whyso"
    user = [{"role": "user", "content": "x"}]
    chat = [{"model": "m", "messages": user, "stream": True}, {"model": "m", "messages": user, "stream": True, "stream_options": {"include_usage": True}}]
    df = spark.createDataFrame([(i, "chat_completions", json.dumps(b)) for i, b in enumerate(chat)], "stream_id bigint, protocol string, body string")
    events = processing.to_events(processing.with_requests(_chunks(spark, ["a", "a"]), conversion.convert(df, "stream_id", protocols=("chat_completions",))), "chat_completions").collect()
    with_field = {s: [("usage" in json.loads(r["data"])) for r in sorted(events, key=lambda r: r["event_seq"]) if r["stream_id"] == s] for s in (0, 1)}
    assert with_field[0] == [False] * (len(with_field[0]) - 1) + [True] and all(with_field[1])


def test_streams_share_batches(spark):
    """Many short streams, cut and dealt anyhow: each as if alone, without a call of Python for each."""
    chunks = spark.range(3000).selectExpr("id as stream_id").selectExpr("stream_id", "explode(sequence(0L, stream_id % 7)) as seq")
    chunks = chunks.selectExpr("stream_id", "seq", "'text' as kind", "concat('w', seq, ' ') as content", "1L as content_tokens", *(f"cast(null as {k}) as {n}" for n, k in (x.split() for x in processing.CHUNK.split(", ")[5:])))
    r = processing.to_responses(chunks.orderBy(F.rand(3)), "chat_completions")
    got = {x["stream_id"]: json.loads(x["response"]) for x in r.collect()}
    assert {k: v["choices"][0]["message"]["content"] for k, v in got.items()} == {i: "".join(f"w{j} " for j in range(i % 7 + 1)) for i in range(3000)}
    assert {k: v["usage"]["completion_tokens"] for k, v in got.items()} == {i: i % 7 + 1 for i in range(3000)}
    e = processing.to_events(chunks, "chat_completions")
    assert {x["stream_id"]: x["n"] for x in e.groupBy("stream_id").agg(F.countDistinct("event_seq").alias("n")).collect()} == {i: i % 7 + 3 for i in range(3000)}
    assert _responses(processing.accumulate(e, "chat_completions")) == _responses(r)
    for f in (r, e, processing.accumulate(e, "chat_completions")):
        assert "FlatMapGroupsInPandas" not in f._jdf.queryExecution().executedPlan().toString()
    assert processing.to_responses(chunks.limit(0), "messages").collect() == []
