"""Chunks to events: one class for batch and Structured Streaming.

Chunks: stream_id, seq, kind (ready, text, token, finish), content, content_tokens, prompt_tokens, prompt_cache_hit_tokens,
system_fingerprint, finish_reason; with token chunks also token_id, and with requests also request (see with_requests).
Within a stream, order is seq; a seq that was seen is dropped."""

from __future__ import annotations

import functools
import json
import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import jsontext as J
from ..sources.tokenizer_file import Tokenizer
from .folds import FOLDS, Fold
from .generators import DIALECTS, Event, Usage
from .parser import Options, Parser

CHUNK = "stream_id bigint, seq bigint, kind string, content string, content_tokens bigint, prompt_tokens bigint, prompt_cache_hit_tokens bigint, system_fingerprint string, finish_reason string"
EVENT = "stream_id bigint, event_seq bigint, event_name string, data string"


@functools.lru_cache(maxsize=2)
def _tokenizer(path: str) -> Tokenizer:
    return Tokenizer.load(path)


class TokenDecoder:
    """Token ids to text as soon as it is whole: bytes of an unfinished code point wait for the next ids.

    Only the last bytes are looked at after each id, so a run that never gets whole stays linear; what is left at the end is dropped."""

    def __init__(self, path: str) -> None:
        self.path, self.waiting, self.ids = path, b"", 0

    def push(self, token_id: int) -> tuple[str, int] | None:
        """Text and the number of ids it took, or nothing yet."""
        self.waiting += _tokenizer(self.path).token_bytes(token_id)
        self.ids += 1
        if not self.waiting or self.waiting[-8:].decode("utf-8", "replace").endswith("\ufffd"):
            return None
        out = self.waiting.decode("utf-8", "replace"), self.ids
        self.waiting, self.ids = b"", 0
        return out


def _asked(request: str) -> Options:
    """The options in a chunk's request."""
    r = json.loads(request)
    spaces = tuple((flat, x["namespace"], x["name"]) for flat, x in (r.get("namespaces") or {}).items())
    return Options(bool(r.get("parse_tools")), bool(r.get("json_output")), bool(r.get("in_tools")), r.get("reasoning"), tuple(r.get("stops") or ()), tuple(r.get("custom_tools") or ()), spaces, bool(r.get("include_usage", True)))


class Processor:
    def __init__(self, stream_id: Any, dialect: str, options: Options, model: str = "model", tokenizer: str | None = None) -> None:
        self.id, self.dialect, self.model = str(stream_id), dialect, model
        self.decoder = TokenDecoder(tokenizer) if tokenizer else None
        self._set(options)
        self.usage, self.started, self.done, self.last_seq, self.n = Usage(), False, False, None, 0

    def _set(self, o: Options) -> None:
        self.parser = Parser(o)
        more = {"custom": frozenset(o.custom_tools), "namespaces": {flat: (space, name) for flat, space, name in o.namespaces}} if self.dialect == "responses" else {}
        more |= {"include_usage": o.include_usage} if self.dialect == "chat_completions" else {}
        self.generator = DIALECTS[self.dialect](self.id, self.model, (o.reasoning or "content") in ("start", "reasoning"), **more)

    def _begin(self, fingerprint: str | None = None) -> list[Event]:
        if self.started:
            return []
        self.started = True
        return self.generator.start(self.usage, fingerprint)

    def _pieces(self, pieces: list[tuple[str, str]]) -> list[Event]:
        return [e for kind, text in pieces for e in self.generator.piece(kind, text)]

    def push(self, chunk: dict) -> list[Event]:
        if self.done or (self.last_seq is not None and chunk["seq"] <= self.last_seq):
            return []
        self.last_seq = chunk["seq"]
        if not self.started and chunk.get("request"):
            self._set(_asked(chunk["request"]))
        if chunk["kind"] == "ready":
            if not self.started:
                self.usage.prompt, self.usage.hit = int(chunk["prompt_tokens"] or 0), int(chunk["prompt_cache_hit_tokens"] or 0)
            return self._begin(chunk["system_fingerprint"])
        if chunk["kind"] == "finish":
            return self.end(chunk["finish_reason"] or "stop")
        content, tokens = chunk["content"] or "", int(chunk["content_tokens"] or 0)
        if chunk["kind"] == "token":
            if self.decoder is None:
                self.done = True
                return [("error", {"error": {"message": "a token chunk needs a tokenizer", "type": "internal_error", "param": None, "code": None}})]
            whole = None if chunk["token_id"] is None else self.decoder.push(int(chunk["token_id"]))
            if whole is None:
                return []
            content, tokens = whole
        out = self._begin()
        self.usage.completion += tokens
        out += self._pieces(self.parser.feed(content))
        return out + (self.end() if self.parser.stop is not None else [])

    def end(self, backend: str | None = None) -> list[Event]:
        if self.done:
            return []
        self.done = True
        out = self._begin() + self._pieces(self.parser.finish())
        return out + self.generator.finish(self.parser.reason(backend), self.parser.stop, self.usage)

    def rows(self, stream_id: Any, events: list[Event]) -> list[tuple]:
        out = [(stream_id, self.n + i, name, J.compact(body)) for i, (name, body) in enumerate(events)]
        self.n += len(events)
        return out


def _chunks(pdf: pd.DataFrame) -> list[dict]:
    ordered = pdf.sort_values("seq", kind="stable")
    return ordered.astype(object).where(ordered.notna(), None).to_dict("records")


def with_requests(chunks: DataFrame, converted: DataFrame, key: str = "stream_id") -> DataFrame:
    """Chunks with what their requests ask for (rows of conversion.convert, by `key`) on each stream's ready chunk: how
    its output is parsed, and the names that its tools had in the request."""
    fields = {"parse_tools": "parse_tools", "json_output": "json_output", "in_tools": "tools_first", "stops": "stops", "custom_tools": "custom_tools", "namespaces": "namespaces", "include_usage": "include_usage"}
    asked = F.to_json(F.struct(*(F.col(c).alias(k) for k, c in fields.items()), F.when(F.col("reasoning_start"), "start").alias("reasoning")))
    requests = converted.filter("ok").select(F.col(key).alias("stream_id"), F.lit("ready").alias("kind"), asked.alias("request"))
    return chunks.drop("request").join(requests, ["stream_id", "kind"], "left")


_KINDS = {"bigint": pa.int64(), "string": pa.string()}


def _by_stream(rows: DataFrame, order: str, begin: Callable[[Any], tuple[Callable, Callable]], schema: str) -> DataFrame:
    """Streams one after the other, each in order: of each, `begin(id)` gives what takes its rows and what ends it, both
    returning output rows. A task holds one stream's state and a batch, whatever a stream's length; there is no call, frame or
    batch of its own for each stream."""
    names, fields = rows.columns, [x.split() for x in schema.split(", ")]
    at = names.index("stream_id")

    def made(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, _KINDS[k]) for c, (_, k) in zip(zip(*out, strict=True), fields, strict=True)], [n for n, _ in fields])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size, current, push, end = 0, None, None, None
        for batch in batches:
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if push is None or values[at] != current:
                    new = end() if end else []
                    current = values[at]
                    push, end = begin(current)
                    new += push(dict(zip(names, values, strict=True)))
                else:
                    new = push(dict(zip(names, values, strict=True)))
                if new:
                    out += new
                    size += sum(len(x[-1]) for x in new)
                    if len(out) >= 10_000 or size > 4 << 20:
                        yield made(out)
                        out, size = [], 0
        if end:
            out += end()
        if out:
            yield made(out)

    return rows.repartition("stream_id").sortWithinPartitions("stream_id", order).mapInArrow(walk, schema)


def to_events(chunks: DataFrame, dialect: str, options: Options = Options(), model: str = "model", tokenizer: str | None = None) -> DataFrame:
    """Batch: the events of all streams; a stream that has no finish chunk ends with its source."""

    def begin(stream_id: Any) -> tuple[Callable, Callable]:
        p = Processor(stream_id, dialect, options, model, tokenizer)
        return lambda c: p.rows(stream_id, p.push(c)), lambda: p.rows(stream_id, p.end())

    return _by_stream(chunks, "seq", begin, EVENT)


RESPONSE = "stream_id bigint, response string"


def to_responses(chunks: DataFrame, dialect: str, options: Options = Options(), model: str = "model", tokenizer: str | None = None) -> DataFrame:
    """Batch: (stream_id, response JSON); events are folded as they are made."""

    def begin(stream_id: Any) -> tuple[Callable, Callable]:
        p, fold = Processor(stream_id, dialect, options, model, tokenizer), FOLDS[dialect]()

        def push(chunk: dict) -> list[tuple]:
            for _, e in p.push(chunk):
                fold.append(e)
            return []

        def end() -> list[tuple]:
            for _, e in p.end():
                fold.append(e)
            return [(stream_id, J.compact(fold.response(fold.taken())))]

        return push, end

    return _by_stream(chunks, "seq", begin, RESPONSE)


def accumulate(events: DataFrame, dialect: str) -> DataFrame:
    """Batch: rows (stream_id, event_seq, event_name, data) to (stream_id, response JSON), wherever a stream breaks off."""

    def begin(stream_id: Any) -> tuple[Callable, Callable]:
        fold, seen = FOLDS[dialect](), [object()]

        def push(event: dict) -> list[tuple]:
            if event["event_seq"] != seen[0]:
                seen[0] = event["event_seq"]
                fold.append(json.loads(event["data"]))
            return []

        return push, lambda: [(stream_id, J.compact(fold.response(fold.taken())))]

    return _by_stream(events, "event_seq", begin, RESPONSE)


class _Appending(StatefulProcessor):
    """State: a fold's head with the last event's number, and a list of text pieces to which each micro-batch appends."""

    def __init__(self, dialect: str, idle_ms: int | None) -> None:
        self.dialect, self.idle_ms = dialect, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "head string, last bigint, timer bigint")
        self.pieces = handle.getListState("pieces", "place string, text string, anew boolean")
        self.ended = handle.getValueState("ended", "ended boolean", *([3 * self.idle_ms] if self.idle_ms else []))

    def _finished(self, key: Any, fold: Fold) -> pd.DataFrame:
        whole = fold.response([(p[0], p[1], p[2]) for p in self.pieces.get()])
        self.head.clear()
        self.pieces.clear()
        self.ended.update((True,))
        return pd.DataFrame([(key[0], J.compact(whole))], columns=["stream_id", "response"])

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        if self.ended.exists():
            return
        held, last, timer = self.head.get() if self.head.exists() else (None, -1, 0)
        fold, over = FOLDS[self.dialect](json.loads(held) if held else None), False
        pdf = pd.concat(list(rows)).sort_values("event_seq", kind="stable")
        for seq, data in zip(pdf["event_seq"], pdf["data"], strict=True):
            if seq > last and not over:
                event, last = json.loads(data), int(seq)
                fold.append(event)
                over = fold.over(event)
        if new := fold.taken():
            self.pieces.appendList(new)
        if timer:
            self.handle.deleteTimer(timer)
        if over:
            yield self._finished(key, fold)
            return
        if self.idle_ms:
            timer = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
            self.handle.registerTimer(timer)
        self.head.update((J.compact(fold.head), last, timer))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.head.exists():
            yield self._finished(key, FOLDS[self.dialect](json.loads(self.head.get()[0])))

    def close(self) -> None:
        pass


def append_events(events: DataFrame, dialect: str, idle_ms: int | None = None) -> DataFrame:
    """Structured Streaming: events folded over micro-batches into (stream_id, response), one row a stream when its last
    event has come (with `idle_ms`, also when none has come for so long). Events of a stream must arrive in order between
    micro-batches; one that was seen is dropped."""
    return events.groupBy("stream_id").transformWithStateInPandas(_Appending(dialect, idle_ms), RESPONSE, "Append", "ProcessingTime" if idle_ms else "None")


class _Stateful(StatefulProcessor):
    """State: the pickled parser and its timer; of an ended stream a mark that expires, so that late chunks are known as such."""

    def __init__(self, dialect: str, options: Options, model: str, idle_ms: int | None, tokenizer: str | None) -> None:
        self.how, self.idle_ms = (dialect, options, model, tokenizer), idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("parser", "state binary, timer bigint")
        self.ended = handle.getValueState("ended", "ended boolean", *([3 * self.idle_ms] if self.idle_ms else []))

    def _rows(self, key: Any, p: Processor, events: list[Event]) -> pd.DataFrame:
        return pd.DataFrame(p.rows(key[0], events), columns=["stream_id", "event_seq", "event_name", "data"])

    def _end(self) -> None:
        self.state.clear()
        self.ended.update((True,))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        if self.ended.exists():
            return
        held, timer = self.state.get() if self.state.exists() else (None, 0)
        p = pickle.loads(held) if held else Processor(key[0], *self.how)
        out = self._rows(key, p, [e for c in _chunks(pd.concat(list(rows))) for e in p.push(c)])
        if timer:
            self.handle.deleteTimer(timer)
        if p.done:
            self._end()
        else:
            if self.idle_ms:
                timer = timerValues.getCurrentProcessingTimeInMs() + self.idle_ms
                self.handle.registerTimer(timer)
            self.state.update((pickle.dumps(p), timer))
        yield out

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        if self.state.exists():
            p = pickle.loads(self.state.get()[0])
            yield self._rows(key, p, p.end())
            self._end()

    def close(self) -> None:
        pass


def stream_events(chunks: DataFrame, dialect: str, options: Options = Options(), model: str = "model", idle_ms: int | None = None, tokenizer: str | None = None) -> DataFrame:
    """Structured Streaming: the same parser as state of its stream (RocksDB state store).

    An ended stream's parser goes at once, and a mark stays by which later chunks are dropped. With `idle_ms`, a stream
    without chunks for so long ends there, as if its source had, and marks go after three times as long. That needs
    processing time, under which a query triggered by availableNow always has another batch to run: leave it out there."""
    return chunks.groupBy("stream_id").transformWithStateInPandas(_Stateful(dialect, options, model, idle_ms, tokenizer), EVENT, "Append", "ProcessingTime" if idle_ms else "None")


def decode_output(df: DataFrame, dialect: str, options: Options = Options()) -> DataFrame:
    """Whole outputs (stream_id, output) to responses: one chunk without token figures, cut at the end token."""
    from ..functions.tokens import ASSISTANT, EOS, THINK

    text = F.regexp_replace(F.substring_index("output", EOS, 1), rf"\A(?:\Q{ASSISTANT}\E)?(?:{THINK})?", "")
    none = F.lit(None)
    chunks = df.select("stream_id", F.lit(0).cast("bigint").alias("seq"), F.lit("text").alias("kind"), text.alias("content"), *(none.cast("bigint").alias(c) for c in ("content_tokens", "prompt_tokens", "prompt_cache_hit_tokens")), *(none.cast("string").alias(c) for c in ("system_fingerprint", "finish_reason")))
    return to_responses(chunks, dialect, options)
