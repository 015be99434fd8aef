"""Events to complete responses, one event at a time: what a stream's events have come to so far.

A fold keeps a head (ids, items, reasons, usage: as large as the number of items) and hands out text as pieces, each with
the place in the head where it belongs. So state that outlives a micro-batch grows by appending, and is never larger
than the answer. A stream may break off anywhere."""

from __future__ import annotations

import copy
from typing import Any

from ..functions import jsontext as J

#: A place in the head, slash-separated; text; whether it replaces what was there.
Piece = tuple[str, str, bool]


class Fold:
    def __init__(self, head: dict | None = None) -> None:
        self.head: dict[str, Any] = head or {}
        self.pieces: list[list] = []

    def _text(self, place: str, text: str, anew: bool = False) -> None:
        if self.pieces and self.pieces[-1][0] == place and not anew:
            self.pieces[-1][1].append(text)
        else:
            self.pieces.append([place, [text], anew])

    def taken(self) -> list[Piece]:
        """The pieces since the last call."""
        out = [(place, "".join(parts), anew) for place, parts, anew in self.pieces]
        self.pieces = []
        return out

    def append(self, event: dict) -> None:
        raise NotImplementedError

    def over(self, event: dict) -> bool:
        """Whether an event ends its stream."""
        raise NotImplementedError

    def response(self, pieces: list[Piece]) -> dict:
        """The response from the head and all pieces, in order."""
        joined: dict[str, list[str]] = {}
        for place, text, anew in pieces:
            if anew:
                joined[place] = [text]
            else:
                joined.setdefault(place, []).append(text)
        return self._filled(copy.deepcopy(self.head), {place: "".join(parts) for place, parts in joined.items()})

    def _filled(self, head: dict, texts: dict[str, str]) -> dict:
        raise NotImplementedError


class ChatFold(Fold):
    """Usage and reasons: the last; fingerprint: the first; texts and arguments by choice and call: joined. A call out of order is passed over."""

    def append(self, event: dict) -> None:
        h = self.head
        h.setdefault("first", {k: event[k] for k in ("id", "created", "model")})
        h["usage"] = event.get("usage") or h.get("usage")
        h["fingerprint"] = h["fingerprint"] if h.get("fingerprint") is not None else event.get("system_fingerprint")
        for c in event["choices"]:
            choice = h.setdefault("choices", {}).setdefault(str(c["index"]), {"calls": [], "reason": None})
            choice["reason"] = c["finish_reason"] or choice["reason"]
            for k in ("content", "reasoning_content"):
                if c["delta"].get(k) is not None:
                    self._text(f"{c['index']}/{k}", c["delta"][k])
            for call in c["delta"].get("tool_calls", ()):
                if "id" in call and call["index"] == len(choice["calls"]):
                    choice["calls"].append({"id": call["id"], "type": "function", "name": call["function"]["name"]})
                if call["index"] < len(choice["calls"]):
                    self._text(f"{c['index']}/call/{call['index']}", call["function"].get("arguments", ""))

    def over(self, event: dict) -> bool:
        return any(c["finish_reason"] for c in event["choices"])

    def _filled(self, head: dict, texts: dict[str, str]) -> dict:
        choices = []
        for index, c in head.get("choices", {"0": {"calls": [], "reason": None}}).items():
            calls = [{"id": x["id"], "type": "function", "function": {"name": x["name"], "arguments": texts.get(f"{index}/call/{i}", "")}} for i, x in enumerate(c["calls"])]
            thought = texts.get(f"{index}/reasoning_content")
            message = {"role": "assistant", "content": texts.get(f"{index}/content")} | ({"reasoning_content": thought} if thought else {}) | ({"tool_calls": calls} if calls else {})
            choices.append({"index": int(index), "message": message, "logprobs": None, "finish_reason": c["reason"]})
        first = head.get("first", {"id": None, "created": 0, "model": None})
        return {"id": first["id"], "object": "chat.completion", "created": first["created"], "model": first["model"], "system_fingerprint": head.get("fingerprint"), "choices": choices, "usage": head.get("usage")}


class MessagesFold(Fold):
    """Blocks start, grow and stop; a tool's input is parsed when its block stops, {} if it isn't JSON."""

    def append(self, event: dict) -> None:
        h, kind = self.head, event["type"]
        blocks = h.setdefault("blocks", [])
        if kind == "message_start":
            h["message"] = dict(event["message"])
        elif kind == "content_block_start" and event["index"] == len(blocks):
            blocks.append(dict(event["content_block"], stopped=False))
        elif kind == "content_block_delta" and event["index"] < len(blocks):
            d = event["delta"]
            field = {"input_json_delta": "partial_json"}.get(d["type"], d["type"].removesuffix("_delta"))
            self._text(f"{event['index']}/{field}", d[field])
        elif kind == "content_block_stop" and event["index"] < len(blocks):
            blocks[event["index"]]["stopped"] = True
        elif kind == "message_delta":
            h["end"] = event["delta"] | {"usage": event["usage"]}

    def over(self, event: dict) -> bool:
        return event["type"] == "message_stop"

    def _filled(self, head: dict, texts: dict[str, str]) -> dict:
        content = []
        for i, block in enumerate(head.get("blocks", ())):
            stopped = block.pop("stopped")
            for field in ("text", "thinking", "signature"):
                if field in block:
                    block[field] += texts.get(f"{i}/{field}", "")
            if stopped and f"{i}/partial_json" in texts:
                try:
                    block["input"] = J.parse(texts[f"{i}/partial_json"])
                except ValueError:
                    block["input"] = {}
            content.append(block)
        message = head.get("message", {})
        return {k: content if k == "content" else v for k, v in message.items()} | head.get("end", {}) if message else {}


_FIELD = {"function_call": "arguments", "custom_tool_call": "input"}
_PART = {"message": "output_text", "reasoning": "reasoning_text"}


class ResponsesFold(Fold):
    """A whole response replaces all; items are added in order, parts likewise; deltas append, what is done replaces.
    Events that don't fit the item at their index (id, kind, kind of part) are passed over."""

    def _stored(self, index: int, item: dict) -> dict:
        """An item without its texts, which become pieces."""
        item = copy.deepcopy(item)
        for j, part in enumerate(item.get("content") or ()):
            self._text(f"{index}/{j}", part.get("text", ""), True)
            part["text"] = ""
        if (field := _FIELD.get(item["type"])) in item:
            self._text(str(index), item[field], True)
            item[field] = ""
        return item

    def _valid(self, item: dict) -> bool:
        return item["type"] in _FIELD or item["type"] in _PART and all(p["type"] == _PART[item["type"]] for p in item.get("content") or ())

    def _at(self, event: dict) -> dict | None:
        output = self.head.get("output", [])
        index = event["output_index"]
        return output[index] if 0 <= index < len(output) and output[index]["id"] == event["item_id"] else None

    def append(self, event: dict) -> None:
        kind = event["type"].removeprefix("response.")
        if "response" in event:
            self.head = {k: v for k, v in event["response"].items() if k != "output"} | {"output": []}
            for i, item in enumerate(event["response"].get("output", ())):
                self.head["output"].append(self._stored(i, item))
            return
        output = self.head.setdefault("output", [])
        if kind == "output_item.added":
            if event["output_index"] == len(output) and self._valid(event["item"]):
                output.append(self._stored(len(output), event["item"]))
            return
        if kind == "output_item.done":
            i, item = event["output_index"], event["item"]
            if 0 <= i < len(output) and (output[i]["id"], output[i]["type"]) == (item["id"], item["type"]) and self._valid(item):
                output[i] = self._stored(i, item)
            return
        item = self._at(event)
        if item is None:
            return
        what, step = kind.rsplit(".", 1)
        place = str(event["output_index"])
        if what in ("function_call_arguments", "custom_tool_call_input"):
            field = "arguments" if what == "function_call_arguments" else "input"
            if _FIELD.get(item["type"]) == field:
                self._text(place, event["delta"] if step == "delta" else event[field], step == "done")
            return
        part_kind = event["part"]["type"] if what == "content_part" else what
        if _PART.get(item["type"]) != part_kind:
            return
        parts, j = item.setdefault("content", []), event["content_index"]
        place = f"{place}/{j}"
        if what == "content_part":
            if step == "added" and j == len(parts) or step == "done" and 0 <= j < len(parts):
                parts[j:] = [dict(event["part"], text=""), *parts[j + 1 :]]
                self._text(place, event["part"].get("text", ""), True)
        elif 0 <= j < len(parts):
            self._text(place, event["delta"] if step == "delta" else event["text"], step == "done")
            if event.get("logprobs"):
                parts[j]["logprobs"] = [*(parts[j].get("logprobs") or [] if step == "delta" else []), *event["logprobs"]]

    def over(self, event: dict) -> bool:
        return event["type"] in ("response.completed", "response.incomplete")

    def _filled(self, head: dict, texts: dict[str, str]) -> dict:
        for i, item in enumerate(head.get("output", ())):
            for j, part in enumerate(item.get("content") or ()):
                part["text"] = texts.get(f"{i}/{j}", "")
            if (field := _FIELD.get(item["type"])) in item:
                item[field] = texts.get(str(i), "")
        return head or {"object": "response", "status": "in_progress", "output": []}


FOLDS = {"chat_completions": ChatFold, "messages": MessagesFold, "responses": ResponsesFold}


def collect(dialect: str, events: list[dict]) -> dict:
    fold = FOLDS[dialect]()
    for e in events:
        fold.append(e)
    return fold.response(fold.taken())
