"""Rendering, JSON text, images, parsing: tables of inputs and expected outputs."""

import random

import pytest
from pyspark.sql import functions as F

from parlance.functions import images, jsontext, text
from parlance.functions import tokens as T
from parlance.operators import rendering, requests, tool_calls
from parlance.streaming import folds, generators, processing
from parlance.streaming.parser import Options, Parser

M = "conv_id bigint, idx bigint, role string, content string, reasoning_content string, call_ids array<string>, tool_call_id string"


def _prompt(spark, rows, version=T.V41, **how):
    df = spark.createDataFrame([(1, i, r[0], r[1], *([*r[2:], None, None, None][:3])) for i, r in enumerate(rows)], M)
    return rendering.render(df, version, **how).first()["prompt"]


def test_render_framing(spark):
    rows = [("system", "S"), ("user", "a"), ("assistant", "b", "why"), ("user", "c"), ("tool", "t"), ("user", "d")]
    tail = f"{T.USER}c\n\n<tool_result>t</tool_result>\n\nd{T.ASSISTANT}"
    assert _prompt(spark, rows) == f"{T.BOS}{T.SYSTEM}S{T.USER}a{T.ASSISTANT}</think>b{T.EOS}{tail}</think>"
    assert _prompt(spark, rows, T.V4, thinking=True, effort="low") == f"{T.BOS}S{T.USER}a{T.ASSISTANT}<think>why</think>b{T.EOS}{tail}<think>"
    assert _prompt(spark, rows[1:2], thinking=True) == f"{T.BOS}{T.SYSTEM}{T.EFFORT_SCORE.format(75)}{T.USER}a{T.ASSISTANT}<think>"


def test_late_systems(spark):
    rows = [("system", "A"), ("system", ""), ("user", "u"), ("system", "late"), ("system", "")]
    assert _prompt(spark, rows, T.V4) == f"{T.BOS}A{T.USER}u\n\nlate{T.ASSISTANT}</think>"
    assert _prompt(spark, rows) == f"{T.BOS}{T.SYSTEM}A{T.SYSTEM}{T.USER}u{T.SYSTEM}late{T.SYSTEM}{T.ASSISTANT}</think>"


def test_tool_results_in_call_order(spark):
    rows = [("assistant", "", None, ["x", "y", "z"]), ("tool", "3", None, None, "z"), ("user", "u"), ("tool", "1", None, None, "x"), ("tool", "2", None, None, "y")]
    df = rendering.messages(spark.createDataFrame([(1, i, *[*r, None, None, None, None][:5]) for i, r in enumerate(rows)], M))
    assert [r["content"] for r in rendering.order_tool_results(df).orderBy("idx").collect()] == ["", "1", "u", "2", "3"]


def test_tool_call_text():
    d = T.DSML
    assert tool_calls.call_text(T.V4, "f", '{"a": "x", "b": [1, 2.0]}') == f'<{d}invoke name="f">\n<{d}parameter name="a" string="true">x</{d}parameter>\n<{d}parameter name="b" string="false">[1, 2.0]</{d}parameter>\n</{d}invoke>'
    assert tool_calls.call_text(T.V41, "f", "{}") == f'<{d} invoke name="f">\n\n</{d} invoke>'
    assert 'name="arguments" string="true">nope<' in tool_calls.call_text(T.V4, "f", "nope")


@pytest.mark.parametrize(("x", "want"), [(1.0, "1.0"), (1e-5, "0.00001"), (1e15, "1000000000000000.0"), (1e16, "1e+16"), (1.5e300, "1.5e+300"), (1e-7, "1e-7"), (123.25, "123.25"), (-0.0, "-0.0"), (0.1, "0.1")])
def test_compact_numbers(x, want):
    assert jsontext.compact_number(x) == want and float(want) == x


def test_json_text():
    assert jsontext.python_style(jsontext.parse('{"b":1,"a":[1e-5,"é\\u2028"],"b":{"c":null}}')) == '{"b": {"c": null}, "a": [1e-05, "é\u2028"]}'
    assert jsontext.compact({"a": "\x1f\ud800"}) == '{"a":"\\u001f\ufffd"}'
    for bad in ("1e999", "NaN", "[1] 2", ""):
        with pytest.raises(ValueError):
            jsontext.parse(bad)


def test_image_sizes(spark):
    got = spark.createDataFrame([(1, 1), (16809, 11841)], "w bigint, h bigint").select(images.resized(F.col("w"), F.col("h"))["num_tokens"].alias("n")).collect()
    assert [r["n"] for r in got] == [184, 990]


def test_predicates(spark):
    df = spark.createDataFrame([("a-B_9",), ("a\n",), ("",), ("x" * 129,)], "s string")
    assert [r[0] for r in df.select(text.tool_name_ok(F.col("s"))).collect()] == [True, False, False, False]
    kinds = spark.createDataFrame([("HTTPS://x",), ("data:;base64,AA",), ("ftp://x",)], "s string").select(images.source_kind(F.col("s"))).collect()
    assert [r[0] for r in kinds] == ["url", "data_url", None]
    first = spark.range(1).select(requests.sampling_error(n=F.lit(2), temperature=F.lit(3.0)), requests.sampling_error(top_p=F.lit(float("nan"))), requests.sampling_error(temperature=F.lit(2.0))).first()
    assert first[0] == "n must be 1" and "top_p" in first[1] and first[2] is None


def test_pieces_put_together(spark):
    s = "Hello 12345 世界かな  x\n\n it's (ok)"
    got = spark.createDataFrame([(s,)], "s string").select(text.pieces(F.col("s"))).first()[0]
    assert "".join(got) == s and "123" in got and "45" in got and "世界かな" in got


def _fed(options, pieces):
    p = Parser(options)
    out = [x for piece in pieces for x in p.feed(piece)] + p.finish()
    joined = {}
    for kind, t in out:
        joined[kind] = joined.get(kind, "") + t
    return joined, p


D = T.DSML
CALLS = f'\n\n<{D}tool_calls>\n<{D}invoke name="f">\n<{D}parameter name="a" string="true">x"\n</{D}parameter>\n<{D}parameter name="b" string="false">[1]</{D}parameter>\n</{D}invoke>\n<{D}invoke name="g">\n</{D}invoke>\n</{D}tool_calls>after'


@pytest.mark.parametrize(("options", "whole", "want"), [
    (Options(reasoning="start"), "\n\nhm\n</think>\n\nyes</think>!", {"reasoning": "hm", "raw": "yes!"}),
    (Options(parse_tools=True), "text" + CALLS, {"raw": "text", "begin": "", "tool": "fg", "args": '{"a": "x\\"\\n", "b": [1]}{}'}),
    (Options(stops=("STOP",)), "a STO STOP b", {"raw": "a STO "}),
    (Options(parse_tools=True, reasoning="reasoning"), "think" + CALLS, {"reasoning": "think", "begin": "", "tool": "fg", "args": '{"a": "x\\"\\n", "b": [1]}{}'}),
    (Options(), "<｜DSM", {"raw": "<｜DSM"}),
])
def test_parser_whole_and_cut(options, whole, want):
    rng = random.Random(1)
    for _ in range(20):
        pieces, at = [], 0
        while at < len(whole):
            n = rng.choice((1, 2, 3, 8, 100))
            pieces.append(whole[at : at + n])
            at += n
        assert _fed(options, pieces)[0] == want
    assert _fed(options, [whole])[0] == want


def test_parser_json():
    for o in ('{"a": 1}', '```json\n{"a": 1}\n```'):
        assert _fed(Options(json_output=True), ["Sure: ", o])[0]["raw"].strip() == '{"a": 1}'


def test_finish_reasons():
    assert _fed(Options(parse_tools=True), [CALLS])[1].reason("stop") == "tool_calls"
    assert _fed(Options(stops=("x",)), ["ax"])[1].reason("length") == "stop_sequence"
    assert _fed(Options(), ["a"])[1].reason(None) == "end_of_stream"


CHUNKS = [(1, 0, "ready", None, None, 10, 4, "fp", None), (1, 1, "text", "why</think>he", 2, None, None, None, None), (1, 2, "text", "llo" + CALLS, 3, None, None, None, None), (1, 3, "finish", None, None, None, None, None, "stop")]


def test_complete_responses(spark):
    import json

    df = spark.createDataFrame(CHUNKS, processing.CHUNK)
    o = Options(parse_tools=True, reasoning="start")
    got = {d: json.loads(processing.to_responses(df, d, o).first()["response"]) for d in generators.DIALECTS}
    chat = got["chat_completions"]
    assert chat["choices"][0]["message"]["content"] == "hello" and chat["choices"][0]["message"]["reasoning_content"] == "why"
    assert [c["function"]["arguments"] for c in chat["choices"][0]["message"]["tool_calls"]] == ['{"a": "x\\"\\n", "b": [1]}', "{}"]
    assert chat["choices"][0]["finish_reason"] == "tool_calls" and chat["system_fingerprint"] == "fp"
    assert (chat["usage"]["prompt_tokens"], chat["usage"]["completion_tokens"], chat["usage"]["prompt_cache_miss_tokens"]) == (10, 5, 6)
    assert [b["type"] for b in got["messages"]["content"]] == ["thinking", "text", "tool_use", "tool_use"]
    assert got["messages"]["content"][2]["input"] == {"a": 'x"\n', "b": [1]} and got["messages"]["stop_reason"] == "tool_use"
    assert [i["type"] for i in got["responses"]["output"]] == ["reasoning", "message", "function_call", "function_call"] and got["responses"]["status"] == "completed"


def test_custom_tools_and_namespaces():
    options = Options(parse_tools=True, custom_tools=("note",))
    g = processing.Processor(7, "responses", options).generator
    events = [e for kind, text in (("raw", "so"), ("begin", ""), ("tool", "note"), ("args", '{"input": "a'), ("args", '\\n"}'), ("tool", "box::open"), ("args", "{}")) for e in g.piece(kind, text)]
    events += g.finish("tool_calls", None, generators.Usage())
    names = [n for n, _ in events]
    assert names.count("response.custom_tool_call_input.delta") == 2 and names.count("response.custom_tool_call_input.done") == 1
    assert [e["sequence_number"] for _, e in events] == list(range(len(events)))
    message, note, call = folds.collect("responses", [e for _, e in events])["output"]
    assert message["phase"] == "commentary"
    assert (note["type"], note["id"], note["call_id"], note["name"], note["input"], note["status"]) == ("custom_tool_call", "ctc_7_1", "call_7_0", "note", "a\n", "completed")
    assert (call["type"], call["namespace"], call["name"], call["arguments"]) == ("function_call", "box", "open", "{}")


def test_idle_streams_end(spark, tmp_path):
    import time

    df = spark.createDataFrame(CHUNKS, processing.CHUNK).filter("seq < 2")
    df.coalesce(1).write.json(str(tmp_path / "in"))
    o = Options(parse_tools=True, reasoning="start")
    stream = spark.readStream.schema(processing.CHUNK).json(str(tmp_path / "in"))
    q = processing.stream_events(stream, "messages", o, idle_ms=100).writeStream.format("memory").queryName("idle_out").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(processingTime="300 milliseconds").start()
    want = sorted(map(tuple, processing.to_events(df, "messages", o).collect()), key=lambda r: r[1])
    until = time.time() + 60
    while spark.table("idle_out").count() < len(want) and time.time() < until:
        time.sleep(0.5)
    q.stop()
    assert sorted(map(tuple, spark.table("idle_out").collect()), key=lambda r: r[1]) == want


def test_stateful_stream_equals_batch(spark, tmp_path):
    o = Options(parse_tools=True, reasoning="start")
    df = spark.createDataFrame(CHUNKS, processing.CHUNK)
    for i in range(4):  # one file a micro-batch
        df.filter(F.col("seq") == i).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(processing.CHUNK).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    q = processing.stream_events(stream, "messages", o).writeStream.format("memory").queryName("events_out").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = sorted(map(tuple, spark.table("events_out").collect()), key=lambda r: r[1])
    assert got == sorted(map(tuple, processing.to_events(df, "messages", o).collect()), key=lambda r: r[1])


def test_entry_registers_queries():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
