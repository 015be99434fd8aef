"""Parsed pieces to protocol events for three dialects; folds.py puts events together again.

An event is (name or None, body as a dict in wire order). `created` is a parameter: it is the only thing in the
output that would differ between runs."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

from ..functions import jsontext as J
from ..operators.requests import FINISH
from .custom_input import CustomInput

Event = tuple[str | None, dict[str, Any]]


@dataclass
class Usage:
    prompt: int = 0
    hit: int = 0
    completion: int = 0


class Chat:
    """Chat-completion chunks: unnamed events."""

    def __init__(self, id: str, model: str, thinking: bool = False, include_usage: bool = True, created: int = 0) -> None:
        self.base = {"id": id, "object": "chat.completion.chunk", "created": created, "model": model}
        self.thinking, self.include_usage, self.calls, self.fingerprint = thinking, include_usage, 0, None

    def _chunk(self, delta: dict, reason: str | None = None, usage: dict | None = None) -> list[Event]:
        body = self.base | {"system_fingerprint": self.fingerprint, "choices": [{"index": 0, "delta": delta, "logprobs": None, "finish_reason": reason}]}
        return [(None, body | ({"usage": usage} if usage or self.include_usage else {}))]

    def _text(self, content: str | None, thought: str | None = None) -> dict:
        return {"content": content} | ({"reasoning_content": thought} if self.thinking or thought is not None else {})

    def start(self, usage: Usage, fingerprint: str | None) -> list[Event]:
        self.fingerprint = fingerprint
        return self._chunk({"role": "assistant"} | (self._text(None, "") if self.thinking else {"content": ""}))

    def piece(self, kind: str, text: str) -> list[Event]:
        if kind == "raw":
            return self._chunk(self._text(text))
        if kind == "reasoning":
            return self._chunk({"content": None, "reasoning_content": text})
        if kind == "tool":
            self.calls += 1
            n = self.calls - 1
            return self._chunk({"tool_calls": [{"index": n, "id": f"call_{self.base['id']}_{n}", "type": "function", "function": {"name": text, "arguments": ""}}]})
        return self._chunk({"tool_calls": [{"index": max(self.calls - 1, 0), "function": {"arguments": text}}]}) if kind == "args" else []

    def finish(self, reason: str, stop: str | None, u: Usage) -> list[Event]:
        usage = {"prompt_tokens": u.prompt, "completion_tokens": u.completion, "total_tokens": u.prompt + u.completion, "prompt_tokens_details": {"cached_tokens": u.hit}, "prompt_cache_hit_tokens": u.hit, "prompt_cache_miss_tokens": max(0, u.prompt - u.hit)}
        return self._chunk(self._text(""), FINISH["chat_completions"][reason], usage)


class Messages:
    """Content blocks that start, grow and stop."""

    def __init__(self, id: str, model: str, thinking: bool = False, signature: str = "", created: int = 0) -> None:
        self.id, self.model, self.thinking, self.signature = id, model, thinking, signature
        self.block: str | None = None
        self.index = self.calls = 0

    @staticmethod
    def _usage(u: Usage, completion: int) -> dict:
        return {"input_tokens": max(0, u.prompt - u.hit), "cache_creation_input_tokens": 0, "cache_read_input_tokens": u.hit, "output_tokens": completion}

    def _event(self, kind: str, **body: Any) -> Event:
        return kind, {"type": kind} | body

    def _close(self) -> list[Event]:
        if self.block is None:
            return []
        signed = [self._delta(type="signature_delta", signature=self.signature)] if self.block == "thinking" else []
        stop = self._event("content_block_stop", index=self.index)
        self.block, self.index = None, self.index + 1
        return [*signed, stop]

    def _open(self, kind: str, **block: Any) -> list[Event]:
        out = [*self._close(), self._event("content_block_start", index=self.index, content_block={"type": kind} | block)]
        self.block = kind
        return out + ([self._event("ping")] if self.index == 0 else [])

    def _delta(self, **delta: Any) -> Event:
        return self._event("content_block_delta", index=self.index, delta=delta)

    def start(self, usage: Usage, fingerprint: str | None) -> list[Event]:
        message = {"id": self.id, "type": "message", "role": "assistant", "content": [], "model": self.model, "stop_reason": None, "stop_sequence": None, "usage": self._usage(usage, 0)}
        return [self._event("message_start", message=message), *(self._open("thinking", thinking="", signature="") if self.thinking else [])]

    def piece(self, kind: str, text: str) -> list[Event]:
        if kind == "raw":
            return [*(self._open("text", text="") if self.block != "text" else []), self._delta(type="text_delta", text=text)]
        if kind == "reasoning":
            return [*(self._open("thinking", thinking="", signature="") if self.block != "thinking" else []), self._delta(type="thinking_delta", thinking=text)]
        if kind == "tool":
            self.calls += 1
            return self._open("tool_use", id=f"toolu_{self.id}_{self.calls - 1}", name=text, input={})
        return [self._delta(type="input_json_delta", partial_json=text)] if kind == "args" and self.block == "tool_use" else []

    def finish(self, reason: str, stop: str | None, u: Usage) -> list[Event]:
        return [*self._close(), self._event("message_delta", delta={"stop_reason": FINISH["messages"][reason], "stop_sequence": stop}, usage=self._usage(u, u.completion)), self._event("message_stop")]


class Responses:
    """Output items with parts; every event carries a sequence number."""

    def __init__(self, id: str, model: str, thinking: bool = False, created: int = 0, namespaces: dict[str, tuple[str, str]] | None = None, custom: frozenset[str] = frozenset()) -> None:
        self.id, self.model, self.created = id, model, created
        self.items: list[dict] = []
        self.kind: str | None = None
        self.text, self.n, self.calls = "", 0, 0
        self.namespaces, self.custom, self.input = namespaces or {}, custom, CustomInput()

    def _event(self, kind: str, **body: Any) -> Event:
        self.n += 1
        return f"response.{kind}", {"type": f"response.{kind}"} | body | {"sequence_number": self.n - 1}

    def _response(self, status: str, usage: dict | None = None, why: str | None = None) -> dict:
        return {"id": self.id, "object": "response", "created_at": self.created, "status": status, "incomplete_details": {"reason": why} if why else None, "model": self.model, "output": [dict(i) for i in self.items], "usage": usage}

    def _at(self) -> dict:
        return {"item_id": self.items[-1]["id"], "output_index": len(self.items) - 1}

    def start(self, usage: Usage, fingerprint: str | None) -> list[Event]:
        return [self._event("created", response=self._response("in_progress")), self._event("in_progress", response=self._response("in_progress"))]

    def _close(self, status: str = "completed") -> list[Event]:
        if self.kind is None:
            return []
        item, at, out = self.items[-1], self._at(), []
        if self.kind == "function_call":
            item["arguments"] = self.text
            out.append(self._event("function_call_arguments.done", arguments=self.text, **at))
        elif self.kind == "custom_tool_call":
            out += self._input(self.input.finish())
            item["input"] = self.text
            out.append(self._event("custom_tool_call_input.done", input=self.text, **at))
        else:
            name = "output_text" if self.kind == "message" else "reasoning_text"
            part = {"type": name, "text": self.text} | ({"annotations": [], "logprobs": []} if self.kind == "message" else {})
            item["content"] = [part]
            out.append(self._event(f"{name}.done", content_index=0, **at, **({"logprobs": []} if self.kind == "message" else {}), text=self.text))
            out.append(self._event("content_part.done", content_index=0, **at, part=part))
        item["status"] = status
        out.append(self._event("output_item.done", item=dict(item), output_index=at["output_index"]))
        self.kind, self.text = None, ""
        return out

    def _open(self, kind: str, prefix: str, **item: Any) -> list[Event]:
        out = self._close()
        self.items.append({"type": kind, "id": f"{prefix}_{self.id}_{len(self.items)}", "status": "in_progress"} | item)
        self.kind = kind
        out.append(self._event("output_item.added", item=dict(self.items[-1]), output_index=len(self.items) - 1))
        if kind not in ("function_call", "custom_tool_call"):
            name = "output_text" if kind == "message" else "reasoning_text"
            out.append(self._event("content_part.added", content_index=0, **self._at(), part={"type": name, "text": ""}))
        return out

    def _input(self, delta: str) -> list[Event]:
        self.text += delta
        return [self._event("custom_tool_call_input.delta", delta=delta, **self._at())] if delta else []

    def piece(self, kind: str, text: str) -> list[Event]:
        if kind == "begin":
            if self.kind == "message":
                self.items[-1]["phase"] = "commentary"  # an answer that goes on with a tool call
            return []
        if kind == "tool":
            self.calls += 1
            call = f"call_{self.id}_{self.calls - 1}"
            if text in self.custom:
                out = self._open("custom_tool_call", "ctc", call_id=call, name=text, input="")
                self.input = CustomInput()
                return out
            front, cut, back = text.partition("::")
            space, name = self.namespaces.get(text) or ((front, back) if cut else (None, text))
            return self._open("function_call", "fc", call_id=call, name=name, arguments="", **({"namespace": space} if space else {}))
        if kind == "args":
            if self.kind == "custom_tool_call":
                return self._input(self.input.feed(text))
            if self.kind != "function_call":
                return []
            self.text += text
            return [self._event("function_call_arguments.delta", delta=text, **self._at())]
        want, prefix, name = ("message", "msg", "output_text") if kind == "raw" else ("reasoning", "rs", "reasoning_text")
        out = self._open(want, prefix, **({"role": "assistant"} if want == "message" else {"summary": []}), content=[]) if self.kind != want else []
        self.text += text
        return [*out, self._event(f"{name}.delta", content_index=0, delta=text, **self._at(), **({"logprobs": []} if want == "message" else {}))]

    def finish(self, reason: str, stop: str | None, u: Usage) -> list[Event]:
        status = FINISH["responses"][reason]
        out = self._close(status)
        usage = {"input_tokens": u.prompt, "input_tokens_details": {"cached_tokens": u.hit}, "output_tokens": u.completion, "output_tokens_details": {"reasoning_tokens": 0}, "total_tokens": u.prompt + u.completion}
        why = {"length": "max_output_tokens", "content_filter": "content_filter"}.get(reason)
        return [*out, self._event(status, response=self._response(status, usage, why))]


DIALECTS = {"chat_completions": Chat, "messages": Messages, "responses": Responses}


def frames(dialect: str, events: list[Event]) -> str:
    """Events as server-sent events; chat completions end with a sentinel."""
    text = "".join((f"event: {n}\n" if n else "") + f"data: {J.compact(e)}\n\n" for n, e in events)
    return text + ("data: [DONE]\n\n" if dialect == "chat_completions" else "")
