"""The incremental output parser: text in pieces to answer, reasoning and tool-call pieces.

A stage is a table of markers. Fed text is searched for the marker that ends first; what comes before it is
handled as the stage says, and text that may still turn into a marker is held back. So pieces joined don't depend
on how the text was cut, except for the single spaces that stand for text around a JSON answer."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..functions import jsontext as J
from ..functions import tokens as T

# Markers of model output.
FENCES = ("```json\n", "```\n")
FENCE_END = "\n```"
OPEN, CLOSE = f"<{T.DSML}", f"</{T.DSML}"
BLOCK_ENDS = (f"</{T.DSML}tool_calls>", f"</{T.DSML} calls>")


@dataclass(frozen=True)
class Options:
    parse_tools: bool = False
    json_output: bool = False
    in_tools: bool = False
    reasoning: str | None = None  # start, reasoning, content
    stops: tuple[str, ...] = ()
    custom_tools: tuple[str, ...] = ()  # tools whose input is free text; only the responses dialect tells them apart
    namespaces: tuple[tuple[str, str, str], ...] = ()  # flat name, namespace, name within it
    include_usage: bool = True  # chat completions: whether chunks before the last have a usage field


@dataclass(frozen=True)
class Rule:
    marker: str
    to: str
    emit: tuple[str, str] | None = None
    newlines: bool = False  # newlines right before the marker belong to it


@dataclass
class Stage:
    rules: list[Rule] = field(default_factory=list)
    rest: str = "skip"  # what becomes of other text: raw, reasoning, space, name, args, text, skip
    leading: bool = False  # newlines at the very start are dropped


def stages(o: Options) -> dict[str, Stage]:
    stops = [Rule(s, "done", ("stop", s)) for s in o.stops if s]
    tools = [Rule(OPEN, "calls", newlines=True)] if o.parse_tools else []
    stray = [Rule(T.END_THINK, "answer")]
    json_in = [Rule(f, "json") for f in FENCES] + [Rule(b, "json", ("raw", b)) for b in "{["]
    answer = (json_in if o.json_output else stops) + tools + stray
    rest = "space" if o.json_output else "raw"
    end_thought = [Rule(T.END_THINK, "fresh_answer", newlines=True)]

    def arguments(first: bool) -> Stage:
        return Stage([Rule("parameter name=", "param", ("args", "{" if first else ", ")), Rule(CLOSE, "calls", ("args", "{}" if first else "}"))])

    return {
        "answer": Stage(answer, rest),
        "fresh_answer": Stage(answer, rest, True),
        "json": Stage([*stops, Rule(FENCE_END, "after_json")], "raw"),
        "after_json": Stage(tools, "space"),
        "calls": Stage([Rule('invoke name="', "name", ("begin", "")), *(Rule(m, "done") for m in BLOCK_ENDS)]),
        "name": Stage([Rule('"', "first_args", ("tool", ""))], "name"),
        "first_args": arguments(True),
        "args": arguments(False),
        "param": Stage([Rule(" ", "type", ("args", ": "))], "args"),
        "type": Stage([Rule('true">', "string", ("args", '"')), Rule('false">', "value")]),
        "string": Stage([Rule(CLOSE, "args", ("args", '"'))], "text"),
        "value": Stage([Rule(CLOSE, "args")], "args"),
        "reasoning": Stage(tools + end_thought, "reasoning"),
        "fresh_reasoning": Stage(tools + end_thought, "reasoning", True),
        "done": Stage(),
    }


class Parser:
    """feed() and finish() return (kind, text): raw, reasoning, begin, tool (its name), args."""

    def __init__(self, options: Options) -> None:
        self.table = stages(options)
        begin = {"start": "fresh_reasoning", "reasoning": "reasoning", "content": "answer"}.get(options.reasoning or "", "fresh_answer")
        self.stage = "calls" if options.in_tools else begin
        self.held = self.name = ""
        self.at_start = True
        self.stop: str | None = None
        self.called = False

    def _rest(self, text: str, out: list[tuple[str, str]]) -> None:
        kind = self.table[self.stage].rest
        if not text or kind == "skip":
            return
        if kind == "name":
            self.name += text
        elif kind == "text":
            out.append(("args", J.escape_body(text)))
        elif kind == "space":
            out.append(("raw", " "))
        else:
            out.append((kind, text))

    def _next(self, at: int, seen: dict[str, int]) -> tuple[int, int, Rule] | None:
        """The marker that ends first in the held text from `at` on: start, end, rule; earlier rules win ties. `seen` keeps
        where each marker was found last, so that a feed looks through its text once a marker, not once a find."""
        best = None
        for rule in self.table[self.stage].rules:
            found = seen.get(rule.marker, 0)
            if 0 <= found and (found < at or rule.marker not in seen):
                found = seen[rule.marker] = self.held.find(rule.marker, at)
            if found >= 0 and (best is None or found + len(rule.marker) < best[1]):
                start = found
                while rule.newlines and start > at and self.held[start - 1] == "\n":
                    start -= 1
                best = start, found + len(rule.marker), rule
        return best

    def _maybe(self) -> int:
        """How much of the end of the held text may belong to a marker."""
        most, text = 0, self.held
        for rule in self.table[self.stage].rules:
            n = next((k for k in range(min(len(rule.marker) - 1, len(text)), 0, -1) if text.endswith(rule.marker[:k])), 0)
            if rule.newlines:
                body = text[: len(text) - n]
                n += len(body) - len(body.rstrip("\n"))
            most = max(most, n)
        return most

    def feed(self, text: str) -> list[tuple[str, str]]:
        out: list[tuple[str, str]] = []
        self.held += text
        at, seen = 0, {}
        while True:
            if self.table[self.stage].leading and self.at_start and at < len(self.held):
                while at < len(self.held) and self.held[at] == "\n":
                    at += 1
                self.at_start = at == len(self.held)
            found = self._next(at, seen)
            if found is None:
                break
            start, at_end, rule = found
            self._rest(self.held[at:start], out)
            at = at_end
            self._emit(rule, out)
            self.stage, self.at_start = rule.to, True
        self.held = self.held[at:]
        keep = self._maybe()
        self._rest(self.held[: len(self.held) - keep], out)
        self.held = self.held[len(self.held) - keep :]
        return out

    def _emit(self, rule: Rule, out: list[tuple[str, str]]) -> None:
        kind, text = rule.emit or ("", "")
        if kind == "stop":
            self.stop = text
        elif kind == "tool":
            out.append(("tool", self.name))
            self.name, self.called = "", True
        elif kind:
            out.append((kind, text))

    def finish(self) -> list[tuple[str, str]]:
        out: list[tuple[str, str]] = []
        self._rest(self.held, out)
        self.held = ""
        return out

    def reason(self, backend: str | None) -> str:
        if self.stop is not None:
            return "stop_sequence"
        return "end_of_stream" if backend is None else "tool_calls" if backend == "stop" and self.called else backend
