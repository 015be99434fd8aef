"""Requests and answers through format(...), in batches and streams."""

import json

import pytest

from parlance.operators import conversion
from parlance.sources import datasource
from parlance.streaming import processing


@pytest.fixture(scope="module")
def sources(spark):
    datasource.register(spark)
    return spark


def _put(folder, name, lines):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join(lines))


def _read(folder):
    return {str(p.relative_to(folder)): p.read_text() for p in sorted(folder.rglob("part-*"))}


USER = [{"role": "user", "content": "hé"}]


def test_requests_in_a_batch(sources, tmp_path):
    _put(tmp_path / "in/chat_completions", "a.jsonl", [json.dumps({"model": "m", "messages": USER}), "", "{broken"])
    _put(tmp_path / "in/responses", "b.jsonl", [json.dumps({"model": "m", "input": "x"})] * 5000)
    _put(tmp_path / "in/_staged", "c.jsonl", ["hidden"])
    df = sources.read.format("chat_requests").load(str(tmp_path / "in"))
    rows = df.collect()
    assert len(rows) == 5002 and {(r["protocol"], r["line"]) for r in rows if r["protocol"] != "responses"} == {("chat_completions", 0), ("chat_completions", 2)}
    got = conversion.convert(df.filter("protocol <> 'responses'"), "line", protocols=("chat_completions",)).collect()
    assert {r["line"]: r["ok"] for r in got} == {0: True, 2: False}
    assert sources.read.format("chat_requests").option("protocol", "messages").load(f"file://{tmp_path}/in/responses").first()["protocol"] == "messages"
    assert sources.read.format("chat_requests").load(str(tmp_path / "none")).collect() == []


def test_requests_in_a_stream(sources, tmp_path):
    def run():
        stream = sources.readStream.format("chat_requests").load(str(tmp_path / "in"))
        q = stream.writeStream.format("json").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
        q.awaitTermination(120)
        return sorted(r["body"] for r in sources.read.json(str(tmp_path / "out")).collect())

    _put(tmp_path / "in/messages", "a.jsonl", ["1", "2"])
    assert run() == ["1", "2"]
    _put(tmp_path / "in/messages", "b.jsonl", ["3"])
    assert run() == ["1", "2", "3"] and run() == ["1", "2", "3"]


EVENTS = [(1, 0, None, '{"choices":[{"finish_reason":null}]}'), (1, 1, None, '{"choices":[{"finish_reason":"stop"}]}')]


def test_answers_in_a_batch(sources, tmp_path):
    df = sources.createDataFrame(EVENTS, processing.EVENT).coalesce(1)
    df.write.format("chat_answers").option("done", "true").mode("append").save(str(tmp_path / "sse"))
    assert list(_read(tmp_path / "sse").values()) == ['data: {"choices":[{"finish_reason":null}]}\n\ndata: {"choices":[{"finish_reason":"stop"}]}\n\ndata: [DONE]\n\n']
    named = sources.createDataFrame([(1, 0, "ping", "{}")], processing.EVENT).coalesce(1)
    named.write.format("chat_answers").mode("append").save(str(tmp_path / "named"))
    assert list(_read(tmp_path / "named").values()) == ["event: ping\ndata: {}\n\n"]
    sources.createDataFrame([(1, '{"a":1}'), (2, "{}")], processing.RESPONSE).coalesce(1).write.format("chat_answers").mode("append").save(str(tmp_path / "json"))
    assert list(_read(tmp_path / "json").values()) == ['{"a":1}\n{}\n']
    assert not list((tmp_path / "sse/_staged").iterdir())


def test_answers_in_a_stream_and_again(sources, tmp_path):
    sources.createDataFrame(EVENTS, processing.EVENT).coalesce(1).write.json(str(tmp_path / "in"))
    stream = sources.readStream.schema(processing.EVENT).json(str(tmp_path / "in"))
    for checkpoint in ("one", "two"):  # the second run commits its batch 0 anew: it has been there
        q = stream.writeStream.format("chat_answers").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / checkpoint)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert list(_read(tmp_path / "out")) == ["batch=0/part-00000"] and not list((tmp_path / "out/_staged").iterdir())
