"""Prompt tokens and template versions."""

from __future__ import annotations

from dataclasses import dataclass

# The prompt's tokens and texts.
BOS = "<｜begin▁of▁sentence｜>"
EOS = "<｜end▁of▁sentence｜>"
SYSTEM = "<｜System｜>"
USER = "<｜User｜>"
ASSISTANT = "<｜Assistant｜>"
LATEST_REMINDER = "<｜latest_reminder｜>"
IMAGE = "<｜image｜>"
THINK, END_THINK = "<think>", "</think>"
DSML = "｜DSML｜"
EFFORT_HIGH = "Reasoning Effort: Absolute maximum with no shortcuts permitted.\nYou MUST be very thorough in your thinking and comprehensively decompose the problem to resolve the root cause, rigorously stress-testing your logic against all potential paths, edge cases, and adversarial scenarios.\nExplicitly write out your entire deliberation process, documenting every intermediate step, considered alternative, and rejected hypothesis to ensure absolutely no assumption is left unchecked.\n\n"
EFFORT_MAX = "Reasoning Effort: Beyond maximum — exhaustive, relentless, and uncompromising.\nYou MUST reason with the utmost depth and rigor, leaving absolutely nothing to chance: exhaustively decompose the problem into its most fundamental components, trace every causal chain to its root, and resolve the underlying cause rather than any surface symptom.\nDo not stop reasoning until you have independently verified the solution from multiple angles and are certain that no assumption remains unchecked and no error remains undiscovered.\n\n"
EFFORT_SCORE = "Reasoning Effort: {} (range 1-100, the higher the value, the more thorough the reasoning)\n\n"
JSON_FORMAT = '\n\n## Response Format:\n\nYou MUST strictly adhere to the following schema to reply:\n{"type": "json_object"}'
TOOLS_HEAD = """## Tools

You have access to a set of tools to help answer the user's question. You can invoke tools by writing a "<{D}{b}>" block like the following:

<{D}{b}>
<{D}{i} name="$TOOL_NAME">
<{D}{p} name="$PARAMETER_NAME" string="true|false">$PARAMETER_VALUE</{D}{p}>
...
</{D}{i}>
<{D}{i} name="$TOOL_NAME2">
...
</{D}{i}>
</{D}{b}>

String parameters should be specified as is and set `string="true"`. For all other types (numbers, booleans, arrays, objects), pass the value in JSON format and set `string="false"`.

If thinking_mode is enabled (triggered by <think>), you MUST output your complete reasoning inside <think>...</think> BEFORE any tool calls or final response.

Otherwise, output directly after </think> with tool calls or final response.

### Available Tool Schemas

"""
TOOLS_TAIL = "\n\nYou MUST strictly follow the above defined tool name and parameter schemas to invoke tool calls.\n"


@dataclass(frozen=True)
class Version:
    """What differs between template versions."""

    name: str
    system: str
    late_system: bool
    block: str
    call: str
    parameter: str
    effort: dict[str, str]

    def effort_text(self, effort: str | None) -> str:
        return self.effort.get(effort or "", self.effort[""])

    def tool_prompt(self, schemas: str) -> str:
        return TOOLS_HEAD.format(D=DSML, b=self.block, i=self.call, p=self.parameter) + schemas + TOOLS_TAIL


V4 = Version("v4", "", False, "tool_calls", "invoke", "parameter", {"low": "", "max": EFFORT_MAX, "": EFFORT_HIGH})
V41 = Version("v41", SYSTEM, True, " calls", " invoke", " parameter", {"low": EFFORT_SCORE.format(50), "max": EFFORT_SCORE.format(100), "": EFFORT_SCORE.format(75)})
VERSIONS = {v.name: v for v in (V4, V41)}
