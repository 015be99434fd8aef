"""The input of a custom tool, unwrapped while it streams: {"input":"..."} to its text."""

from __future__ import annotations

import json
import re

_HEAD = re.compile(r'\s*\{\s*"input"\s*:\s*"')
_ESCAPE = re.compile(r'\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4})')


class CustomInput:
    """feed() returns the text that is sure so far; what isn't wrapped as expected passes as it is."""

    def __init__(self) -> None:
        self.held, self.mode = "", "head"

    def _may_start(self) -> bool:
        """Whether the held text may still become the wrapper."""
        return bool(re.fullmatch(r'\s*(?:\{\s*(?:"(?:i(?:n(?:p(?:u(?:t(?:"\s*(?::\s*)?)?)?)?)?)?)?)?)?', self.held))

    def feed(self, text: str) -> str:
        self.held += text
        if self.mode == "head":
            if m := _HEAD.match(self.held):
                self.held, self.mode = self.held[m.end() :], "text"
            elif self._may_start():
                return ""
            else:
                self.mode = "plain"
        if self.mode == "plain":
            out, self.held = self.held, ""
            return out
        return self._unescaped() if self.mode == "text" else ""

    def _unescaped(self) -> str:
        out, at = [], 0
        while at < len(self.held):
            c = self.held[at]
            if c == '"':
                self.mode = "done"
                at = len(self.held)
            elif c != "\\":
                out.append(c)
                at += 1
            elif m := _ESCAPE.match(self.held, at):
                first_half = m[0][1] == "u" and 0xD800 <= int(m[0][2:], 16) < 0xDC00
                pair = _ESCAPE.match(self.held, m.end()) if first_half else None
                if first_half and not pair and len(self.held) - m.end() < 6:
                    break  # the other half may follow
                unit = m[0] + (pair[0] if pair and pair[0][1] == "u" else "")
                out.append(json.loads(f'"{unit}"').encode("utf-8", "replace").decode())
                at = m.start() + len(unit)
            elif len(self.held) - at < 6:
                break  # an escape that isn't whole yet
            else:
                out.append(c)
                at += 1
        self.held = self.held[at:]
        return "".join(out)

    def finish(self) -> str:
        out, self.held = (self.held if self.mode in ("head", "text") else ""), ""
        return out
