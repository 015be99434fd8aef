"""Requests of three dialects: what they become, every way in which they are refused, and bodies that hold anything at all."""

import json
import random

import pytest

from parlance.functions import patch_tool, schemas
from parlance.functions import tokens as T
from parlance.operators import conversion

A, B, C = "chat_completions", "messages", "responses"
USER = {"role": "user", "content": "a"}
OBJECT = {"type": "object"}
TOKEN = T.IMAGE


def _tool(name="f", **more):
    return {"type": "function", "function": {"name": name} | more}


def _call(id_="1", name="f", arguments="{}"):
    return {"id": id_, "function": {"name": name, "arguments": arguments}}


def _use(id_="x", **more):
    return {"type": "tool_use", "id": id_, "name": "f", "input": {}} | more


def _result(id_="x", **more):
    return {"type": "tool_result", "tool_use_id": id_, "content": "r"} | more


def _say(*blocks, role="user"):
    return {"role": role, "content": list(blocks)}


def _fc(id_="1", **more):
    return {"type": "function_call", "call_id": id_, "name": "f", "arguments": "{}"} | more


def _out(id_="1", output="r"):
    return {"type": "function_call_output", "call_id": id_, "output": output}


TEXT = {"type": "text", "text": "t"}
LONG = "http://" + "x" * 9000
FOLLOW = "An assistant message with 'tool_calls' must be followed by tool messages responding to each 'tool_call_id'."
NEXT = " Each `tool_use` block must have a corresponding `tool_result` block in the next message."
#: (dialect, fields besides the model, the error's text or its beginning if it ends in ...)
REFUSED = [
    # chat completions, in the order of the checks
    (A, {}, "missing field `messages`"), (A, {"messages": 5}, "invalid type: expected a list for `messages`"), (A, {"messages": [5]}, "invalid type: expected an object in `messages`"),
    (A, {"messages": [{"role": "banana", "content": "a"}]}, "unknown variant `banana`, expected one of `system`, `user`, `assistant`, `tool`, `latest_reminder`"), (A, {"messages": [{"role": "user"}]}, "missing field `content`"),
    (A, {"messages": [{"role": "tool", "content": "a"}]}, "missing field `tool_call_id`"), (A, {"messages": [{"role": "user", "content": 5}]}, "invalid content..."), (A, {"messages": [{"role": "latest_reminder", "content": []}]}, "invalid content: expected a string"),
    (A, {"messages": [_say({"type": "video"})]}, "invalid content: unknown variant `video`, expected one of `text`, `image_url`, `file`"), (A, {"messages": [_say({"type": "text"})]}, "invalid content: missing field `text`"),
    (A, {"messages": [_say({"type": "image_url"})]}, "invalid content: missing field `image_url`"), (A, {"messages": [_say({"type": "image_url", "image_url": {"url": "http://x", "detail": "huge"}})]}, "invalid content: unknown variant `huge`, expected one of `low`, `high`, `original`, `auto`"),
    (A, {"messages": [USER], "stop": [5]}, "invalid type: expected strings in `stop`"), (A, {"messages": [USER], "stop": 5}, "invalid type: expected a list for `stop`"), (A, {"messages": [USER], "reasoning_effort": "banana"}, "unknown variant `banana`, expected one of `none`..."),
    (A, {"messages": [USER], "thinking": {"type": "on"}}, "unknown variant `on`, expected `enabled` or `disabled`"), (A, {"messages": [USER], "thinking": {}}, "missing field `type`"), (A, {"messages": [USER], "max_tokens": 1.5}, "invalid value: expected `max_tokens`..."),
    (A, {"messages": [USER], "max_tokens": 2**64 - 1}, "invalid value: expected `max_tokens` to be a whole number in [0, 4294967295]"), (A, {"messages": [USER], "max_tokens": -1}, "invalid value: expected `max_tokens`..."), (A, {"messages": [USER], "temperature": "hot"}, "invalid type: expected a number for `temperature`"),
    (A, {"messages": [{"role": "assistant", "content": "a", "reasoning_content": 5}]}, "invalid type: expected a string for `reasoning_content`"), (A, {"messages": [USER], "tools": [_tool(description=5)]}, "invalid type: expected a string for `description`"),
    (A, {"messages": [USER], "tools": [_tool(strict="yes")]}, "invalid type: expected a boolean for `strict`"), (A, {"messages": [USER], "stream": 1}, "invalid type: expected a boolean for `stream`"), (A, {"messages": [USER], "tool_choice": "banana"}, "unknown variant `banana`, expected one of `none`, `auto`, `required`"),
    (A, {"messages": [USER], "response_format": {"type": "xml"}}, "unknown variant `xml`..."), (A, {"messages": [USER], "n": 2}, "Invalid n value (currently only n = 1 is supported)"), (A, {"messages": [USER], "frequency_penalty": 3}, "frequency_penalty must be in [-2, 2]"),
    (A, {"messages": [USER], "presence_penalty": -2.5}, "presence_penalty must be in [-2, 2]"), (A, {"messages": [USER], "max_tokens": 0}, "max_tokens must be greater than zero"), (A, {"messages": [USER], "temperature": 2.5}, "temperature must be in [0, 2]"),
    (A, {"messages": [USER], "top_p": 0}, "top_p must be in (0, 1]"), (A, {"messages": [USER], "seed": 2**63}, "seed must be in [0, 2^63)"), (A, {"messages": [USER], "stop": ["x"] * 17}, "ChatCompletionStopSequences string array too long: 17"),
    (A, {"messages": [USER], "stream_options": {}}, "stream_options should be set along with stream = true"), (A, {"messages": [USER], "tools": [_tool("a b")]}, "tools.0.function.name: expected 1-128 ASCII letters, digits, underscores or hyphens"),
    (A, {"messages": [USER], "tools": [_tool(), _tool("é")], "tool_choice": "none"}, "tools.1.function.name: expected..."), (A, {"messages": [USER], "tools": [_tool(), _tool()]}, "Tool names must be unique"),
    (A, {"messages": [USER], "tools": [_tool(parameters=None)]}, "tools.0.function.parameters must be a JSON Schema of type object"), (A, {"messages": [USER], "tools": [_tool(), _tool("g", parameters={"type": "array"})]}, "tools.1.function.parameters must be a JSON Schema of type object"),
    (A, {"messages": [USER], "tools": [_tool(parameters=OBJECT | {"properties": {"a": {"type": "text"}}})]}, "tools.0.function.parameters: /properties/a/type: expected one of..."), (A, {"messages": [USER], "tools": [_tool()], "tool_choice": {"type": "banana"}}, "tool_choice: no tool named '' was specified"),
    (A, {"messages": [USER], "tools": [_tool()], "tool_choice": {"type": "function", "function": {"name": "g"}}}, "tool_choice: no tool named 'g' was specified"), (A, {"messages": [USER], "tools": [_tool()], "tool_choice": "required"}, "Thinking mode does not support this tool_choice"),
    (A, {"messages": []}, "Empty input messages"), (A, {"messages": [{"role": "user", "content": f"a{TOKEN}"}]}, "The sub-string..."), (A, {"messages": [USER, {"role": "assistant", "content": "", "reasoning_content": TOKEN}]}, "The sub-string..."),
    (A, {"messages": [{"role": "system", "content": [{"type": "image_url", "image_url": {"url": "http://x"}}]}]}, "Image in system message is unsupported"), (A, {"messages": [{"role": "assistant", "content": [{"type": "file", "file_data": "x"}]}]}, "Image in assistant message is unsupported"),
    (A, {"messages": [_say({"type": "file", "file_id": "x"})]}, "messages[0].content[0]: file_id is not supported. Pass the image as a base64 data url instead."), (A, {"messages": [_say(TEXT, {"type": "file"})]}, "messages[0].content[1]: file must have file_data"),
    (A, {"messages": [_say({"type": "image_url", "image_url": {"url": "ftp://x"}})]}, "messages[0].content[0].image_url.url: Unsupported image_url format"), (A, {"messages": [_say({"type": "image_url", "image_url": {"url": LONG}})]}, "messages[0].content[0].image_url.url: external link length 9007 too long..."),
    (A, {"messages": [{"role": "assistant"}]}, "Invalid assistant message: content or tool_calls must be set"), (A, {"messages": [USER, {"role": "assistant", "tool_calls": []}]}, "Invalid 'messages[1].tool_calls': empty array. Expected..."),
    (A, {"messages": [{"role": "assistant", "tool_calls": [_call(), _call()]}]}, "Duplicate value for 'tool_call_id' of 1 in message[0]"), (A, {"messages": [{"role": "assistant", "tool_calls": [_call()]}, USER]}, f"{FOLLOW} (insufficient tool messages following tool_calls message)"),
    (A, {"messages": [{"role": "assistant", "tool_calls": [_call(), _call("2")]}, {"role": "tool", "tool_call_id": "1", "content": ""}]}, f"{FOLLOW} (insufficient tool messages following tool_calls message)"),
    (A, {"messages": [{"role": "assistant", "tool_calls": [_call()]}, {"role": "tool", "tool_call_id": "9", "content": ""}]}, f"{FOLLOW} Unexpected tool_call_id: 9"),
    (A, {"messages": [{"role": "assistant", "tool_calls": [_call(), _call("2")]}, *[{"role": "tool", "tool_call_id": "1", "content": ""}] * 2]}, "Duplicate value for 'tool_call_id' of 1 in message[2]"),
    (A, {"messages": [{"role": "assistant", "tool_calls": [_call()]}, {"role": "tool", "tool_call_id": "1", "content": [{"type": "file"}]}]}, "messages[1].content.content[0]: file must have file_data"),
    (A, {"messages": [{"role": "tool", "tool_call_id": "9", "content": ""}]}, "Messages with role 'tool' must be a response to a preceding message with 'tool_calls'"),
    (A, {"messages": [{"role": "assistant", "tool_calls": [_call(arguments=TOKEN)]}, {"role": "tool", "tool_call_id": "1", "content": ""}]}, "The sub-string..."), (A, {"messages": [USER], "tools": [_tool(description=TOKEN)]}, "The sub-string..."),
    (A, {"messages": [USER], "tools": [_tool(parameters=OBJECT | {"title": TOKEN})]}, "The sub-string..."), (A, {"messages": [USER], "response_format": {"type": "json_object"}}, "Prompt must contain the word 'json'..."),
    (A, {"messages": [USER], "response_format": {"type": "regex", "regex": "x"}}, "response_format: only text and json_object are supported"),
    # the first error wins, whatever stands behind it
    (A, {"messages": [{"role": "assistant"}], "n": 3, "max_tokens": 0, "tools": [_tool("a b")]}, "Invalid n value..."), (A, {"messages": [{"role": "assistant"}], "tools": [_tool("a b")]}, "tools.0.function.name..."),
    # content blocks
    (B, {"messages": None}, "invalid type: expected a sequence"), (B, {}, "missing field `messages`"), (B, {"messages": [{"content": "a"}]}, "missing field `role`"), (B, {"messages": [{"role": None, "content": "a"}]}, "invalid type: null, expected string or map"),
    (B, {"messages": [{"role": "banana", "content": "a"}]}, "unknown variant `banana`, expected one of `user`, `assistant`, `system`"), (B, {"messages": [{"role": "user"}]}, "missing field `content`"),
    *[(B, {"messages": [{"role": "user", "content": c}]}, "data did not match any variant of untagged enum MessagesContent") for c in (5, None, [5], [{}], [{"type": "text"}], [{"type": "tool_use", "id": "x", "name": "f"}], [{"type": "image"}], [{"type": "image", "source": {"type": "url"}}], [{"type": "image", "source": {"type": "ftp"}}], [_result(content=5)], [{"type": "thinking"}], [{"type": "web_search_tool_result", "tool_use_id": "x"}])],
    *[(B, {"messages": [{"role": "system", "content": c}]}, "data did not match any variant of untagged enum MessagesTextOrTextBlocks") for c in (5, None, [{"type": "tool_reference"}])], (B, {"messages": [USER], "system": 5}, "data did not match any variant of untagged enum MessagesTextOrTextBlocks"),
    (B, {"messages": [USER], "tools": [{"input_schema": OBJECT}]}, "missing field `name`"), (B, {"messages": [USER], "tool_choice": {"type": "some"}}, "unknown variant `some`, expected one of `auto`, `any`, `tool`, `none`"), (B, {"messages": [USER], "tool_choice": {"type": "tool"}}, "missing field `name`"),
    (B, {"messages": [USER], "output_config": {"effort": "none"}}, "unknown variant `none`, expected one of `low`..."), (B, {"messages": [USER], "thinking": {"type": "enabled", "budget_tokens": -1}}, "invalid value: expected `budget_tokens`..."),
    (B, {"messages": [USER], "max_tokens": 0}, "max_tokens must be greater than zero"), (B, {"messages": [USER], "top_p": 1.5}, "top_p must be in (0, 1]"), (B, {"messages": [USER], "stop_sequences": ["x"] * 17}, "stop_sequences must contain at most 16 non-empty strings"),
    (B, {"messages": [USER], "stop_sequences": [""]}, "stop_sequences must contain at most 16 non-empty strings"), (B, {"messages": [USER], "tools": [{"name": "f", "type": "web_search_20250305"}]}, "tools.0: server tools are not supported"), (B, {"messages": [USER], "tools": [{"name": "f", "type": "bash"}]}, "tools.0: server tools are not supported"),
    (B, {"messages": [USER], "tools": [{"name": "", "input_schema": OBJECT}]}, "tools.0.name: expected..."), (B, {"messages": [USER], "tools": [{"name": "f", "input_schema": OBJECT}] * 2}, "Tool names must be unique"), (B, {"messages": [USER], "tools": [{"name": "f"}]}, "tools.0: missing input_schema"),
    (B, {"messages": [USER], "tools": [{"name": "f", "input_schema": None}]}, "tools.0: missing input_schema"), (B, {"messages": [USER], "tools": [{"name": "f", "input_schema": {"type": "array"}}]}, "tools.0.input_schema must be a JSON Schema of type object"),
    (B, {"messages": [USER], "tools": [{"name": "f", "input_schema": OBJECT | {"required": "a"}}]}, "tools.0.input_schema: /required..."), (B, {"messages": [USER], "tool_choice": {"type": "tool", "name": "g"}}, "tool_choice: no tool named 'g' was specified"),
    (B, {"messages": [USER], "tools": [{"name": "f", "input_schema": OBJECT}], "tool_choice": {"type": "tool", "name": "f"}}, "Thinking mode does not support this tool_choice"), (B, {"messages": []}, "messages: at least one message is required"),
    (B, {"messages": [_say({"type": "thinking", "thinking": TOKEN}, role="assistant")]}, "The sub-string..."), (B, {"messages": [USER], "system": [{"type": "text", "text": TOKEN}]}, "The sub-string..."), (B, {"messages": [USER], "system": [{"type": "image", "source": {"type": "url", "url": "http://x"}}]}, "Image in system message is unsupported"),
    (B, {"messages": [USER], "system": [{"type": "thinking"}]}, "Unsupported content block"), (B, {"messages": [{"role": "user", "content": []}]}, "messages.0: all messages must have non-empty content"), (B, {"messages": [USER, {"role": "assistant", "content": []}]}, "messages.1: all messages must have non-empty content"),
    *[(B, {"messages": [_say(_use(), role="assistant"), m]}, "messages.1: `tool_use` ids were found without `tool_result` blocks immediately after: x." + NEXT) for m in (USER, _say(TEXT, _result()), _say({"type": "document"}), {"role": "assistant", "content": "a"}, {"role": "system", "content": "a"})],
    (B, {"messages": [_say(_use("z"), _use("y"), role="assistant"), _say(_result("z"))]}, "messages.0:`tool_use` ids were found without `tool_result` blocks immediately after: y." + NEXT), (B, {"messages": [_say(_use("z"), _use("y"), role="assistant")]}, "messages.0:`tool_use` ids were found without `tool_result` blocks immediately after: y, z." + NEXT),
    (B, {"messages": [_say({"type": "image", "source": {"type": "base64", "media_type": "text/plain", "data": "eHl6"}})]}, "messages.0.content[0]: You have uploaded an unsupported image..."), (B, {"messages": [_say({"type": "image", "source": {"type": "base64", "media_type": "image/png", "data": "!!!"}})]}, "messages.0.content[0]: base64 decode error"),
    (B, {"messages": [_say({"type": "image", "source": {"type": "url", "url": "ftp://x"}})]}, 'messages.0.content[0]: invalid url: "ftp://x"'), (B, {"messages": [_say(TEXT, {"type": "image", "source": {"type": "file", "file_id": "x"}})]}, "messages.0.content[1]: file_id is not supported..."),
    (B, {"messages": [_say(_use())]}, "messages.0: `tool_use` blocks can only be in `assistant` messages"), (B, {"messages": [_say(_result())]}, "unexpected `messages.0.content.0: tool_use_id` found in `tool_result` blocks: x. Each `tool_result` block must have a corresponding `tool_use` block in the previous message."),
    (B, {"messages": [_say(_use(), role="assistant"), _say(_result(), _result())]}, "messages.1.content.1: each tool_use must have a single result. Found multiple `tool_result` blocks with id: x"), (B, {"messages": [_say({"type": "thinking", "thinking": "t"})]}, "messages.0.content: thinking blocks may only be in `assistant` messages"),
    (B, {"messages": [_say({"type": "server_tool_use", "id": "x", "name": "f", "input": {}})]}, "messages.0: `server_tool_use` blocks can only be in `assistant` messages"), (B, {"messages": [_say({"type": "web_search_tool_result", "tool_use_id": "x", "content": []})]}, "messages.0: `web_search_tool_result` blocks can only..."),
    (B, {"messages": [_say({"type": "banana"})]}, "Unsupported content block"), (B, {"messages": [_say({"type": "banana"}, role="assistant")]}, "Unsupported content block"), (B, {"messages": [_say(_use(), TEXT, role="assistant")]}, "messages.0.1: `tool_use` ids were found without `tool_result` blocks immediately after: x." + NEXT),
    (B, {"messages": [_say({"type": "image", "source": {"type": "url", "url": "http://x"}}, role="assistant")]}, "Image in assistant message is unsupported"), (B, {"messages": [_say(_use(), _use(), role="assistant")]}, "messages.0.content.1: `tool_use` ids must be unique"), (B, {"messages": [_say(_result(), role="assistant")]}, "messages.0: `tool_result` blocks can only be in `user` messages"),
    (B, {"messages": [_say({"type": "server_tool_use", "id": "x", "name": "f", "input": {}}, role="assistant")]}, "Unsupported content block: server tools are not supported"), (B, {"messages": [_say(_use(input={"a": TOKEN}), role="assistant"), _say(_result())]}, "The sub-string..."),
    (B, {"messages": [_say(_use(), role="assistant"), _say(_result(content=[{"type": "image", "source": {"type": "file", "file_id": "x"}}]))]}, "messages.1.content[0][0]: file_id is not supported..."),
    # items
    (C, {"input": 5}, "data did not match any variant of untagged enum ResponsesInput"), *[(C, {"input": [x]}, "data did not match any variant of untagged enum ResponsesInput") for x in (5, {"type": 5}, {"content": "a"}, {"role": "banana", "content": "a"}, {"role": "user"}, {"role": "user", "content": [{"type": "input_text"}]}, _fc(call_id=5), _fc(arguments={}), {"type": "function_call_output", "call_id": "1"}, {"type": "reasoning", "content": [{}]}, {"type": "custom_tool_call", "call_id": "1", "name": "f"})],
    (C, {"input": "a", "reasoning": {"effort": "ultra"}}, "unknown variant `ultra`..."), (C, {"input": TOKEN}, "The sub-string..."), (C, {"instructions": TOKEN}, "The sub-string..."), (C, {"input": [{"type": "reasoning", "content": [{"text": TOKEN}]}]}, "The sub-string..."), (C, {"input": [_fc(), _out(output=TOKEN)], "max_output_tokens": 0}, "The sub-string..."),
    (C, {"input": "a", "max_output_tokens": 0}, "max_output_tokens must be greater than zero"), (C, {"input": "a", "tools": [{"type": "function"}]}, "missing field `name`"), (C, {"input": "a", "tools": [{"type": "function", "name": "a b"}]}, "tools[0].name: expected..."), (C, {"input": "a", "tools": [{"type": "namespace", "name": "", "tools": []}]}, "tools[0].name: expected..."),
    (C, {"input": "a", "tools": [{"type": "namespace", "name": "n", "tools": []}] * 2}, "tools[1]: duplicate namespace name 'n'"), (C, {"input": "a", "tools": [{"type": "namespace", "name": "n", "tools": [{"type": "custom", "name": "apply_patch"}]}]}, "tools[0].tools[0]: custom tools are not supported inside a namespace"),
    (C, {"input": "a", "tools": [{"type": "namespace", "name": "n", "tools": [{"type": "function", "name": "é"}]}]}, "tools[0].tools[0].name: expected..."), (C, {"input": "a", "tools": [{"type": "namespace", "name": "n", "tools": [{"type": "function", "name": "f"}] * 2}]}, "tools[0].tools[1]: tool names within a namespace must be unique"),
    (C, {"input": "a", "tools": [{"type": "custom", "name": "other"}]}, "Unsupported custom tool: 'other'. Only 'apply_patch' is supported"), (C, {}, "Either input or instructions must be provided"), (C, {"instructions": ""}, "Either input or instructions must be provided"), (C, {"input": []}, "Input items array must not be empty"),
    (C, {"input": [_fc()]}, "No tool output found for tool call 1."), (C, {"input": [_fc("2"), _fc("1"), USER]}, "No tool output found for tool call 2."), (C, {"input": [_fc(""), USER]}, "Invalid 'input[0].call_id': empty string. Expected..."), (C, {"input": [_fc(), _fc()]}, "Duplicate 'call_id': 1."), (C, {"input": [_fc(), _out(), _fc()]}, "Duplicate 'call_id': 1."),
    (C, {"input": [_out("")]}, "Invalid 'input[0].call_id': empty string..."), (C, {"input": [_fc(), _out(), _out()]}, "Duplicate tool output for call_id: 1."), (C, {"input": [_out()]}, "No tool call found for tool output with call_id 1."), (C, {"input": [_fc(), {"type": "reasoning"}]}, "No tool output found for tool call 1."),
    (C, {"input": [_fc(), _out(output=[{"type": "output_text", "text": "a"}])]}, "Unsupported content block"), (C, {"input": [_fc(), _out(output=[{"type": "input_image"}])]}, "input[1].output[0]: input_image must have image_url or file_id"), (C, {"input": [_say({"type": "refusal"})]}, "Unsupported content block"),
    (C, {"input": [_say({"type": "input_image", "image_url": "http://x", "file_id": "y"})]}, "input[0].content[0]: input_image cannot have both image_url and file_id"), (C, {"input": [_say({"type": "input_image", "image_url": "", "file_id": "y"})]}, "input[0].content[0]: file_id is not supported..."), (C, {"input": [_say({"type": "input_image", "image_url": "zzz"})]}, "input[0].content[0].image_url: Unsupported image_url format"),
    (C, {"input": [_say({"type": "input_image", "image_url": "http://x"}, role="system")]}, "Image in system message is unsupported"), (C, {"input": [_say({"type": "input_image", "image_url": "http://x"}, role="assistant")]}, "Image in assistant message is unsupported"),
    (C, {"input": "a", "tools": [{"type": "function", "name": "f"}] * 2}, "Tool names must be unique"), (C, {"input": "a", "tools": [{"type": "function", "name": "f", "parameters": None}]}, "Tool 'f' parameters must be a JSON Schema of type object"), (C, {"input": "a", "tools": [{"type": "function", "name": "f", "parameters": OBJECT | {"minLength": -1}}]}, "Tool 'f' parameters: /minLength..."),
    (C, {"input": "a", "tools": [{"type": "function", "name": "f"}], "tool_choice": {"type": "function", "name": "g"}}, "tool_choice: no tool named 'g' was specified"), (C, {"input": "a", "tools": [{"type": "function", "name": "f"}], "tool_choice": "required"}, "Thinking mode does not support this tool_choice"),
    (C, {"input": [_fc(arguments=TOKEN), _out()]}, "The sub-string..."), (C, {"input": "a", "text": {"format": {"type": "json_object"}}}, "Response input messages must contain the word 'json'..."),
]


def _convert(spark, rows, **how):
    df = spark.createDataFrame([(i, p, b if isinstance(b, str | None) else json.dumps({"model": "m"} | b if isinstance(b, dict) else b)) for i, (p, b) in enumerate(rows)], "i int, protocol string, body string").coalesce(2)
    return [r.asDict(True) for r in sorted(conversion.convert(df, "i", protocols=[p for p in (A, B, C) if any(p == x for x, _ in rows)], **how).collect(), key=lambda r: r["i"])]


def test_requests_that_are_refused(spark):
    got = _convert(spark, [(p, b) for p, b, _ in REFUSED])
    assert len(got) == len(REFUSED)
    wrong = [(p, b, want, r["error"]) for (p, b, want), r in zip(REFUSED, got, strict=True) if r["ok"] or not (r["error"].startswith(want[:-3]) if want.endswith("...") else r["error"] == want)]
    assert not wrong, wrong[:5]
    assert {r["error_kind"] for r in got} == {"bad_request"} and all(r["messages"] is None and r["stream"] is None for r in got)


def test_bodies_that_hold_anything(spark):
    """One row a request: broken JSON, two values, deep nesting, lone surrogates, repeated keys, fields of any type."""
    lone = '{"model":"m","messages":[{"role":"user","content":"a\\ud800b\\\\ud800 \\udc00 \\ud83d\\ude00"}]}'
    fixed = ["", None, "{", "[]", "5", '"x"', "null", '{"model":"m"} {"model":"m"}', '{"model":"m","messages":[]},{}', "[" * 5000, '{"a":NaN}', lone, '{"model":"a","model":"m","messages":[{"role":"user","content":"x","content":"y"}]}', '{"model":"m","messages":[{"role":"user","content":"a"}],"temperature":1e999}']
    rng = random.Random(8)
    odd = [None, 5, 2**64 - 1, -1, 1.5, "x", "", True, [], [None], [5], ["x"], {}, {"type": "text"}, {"type": 5}, [{"type": "text", "text": 5}], [[]], {"role": "user"}]

    def spoil(value):
        if rng.random() < 0.12:
            return rng.choice(odd)
        if isinstance(value, dict):
            return {k: spoil(v) for k, v in value.items() if rng.random() > 0.05}
        return [spoil(v) for v in value] if isinstance(value, list) else value

    whole = {
        A: {"messages": [USER, _say(TEXT, {"type": "image_url", "image_url": {"url": "http://x"}}), {"role": "assistant", "tool_calls": [_call()]}, {"role": "tool", "tool_call_id": "1", "content": "r"}], "tools": [_tool(parameters=OBJECT, strict=True)], "stop": ["a"], "thinking": {"type": "enabled"}, "tool_choice": {"type": "function", "function": {"name": "f"}}, "response_format": {"type": "text"}, "max_tokens": 5},
        B: {"messages": [USER, _say(TEXT, {"type": "image", "source": {"type": "base64", "media_type": "image/png", "data": "eHl6"}}), _say({"type": "thinking", "thinking": "t"}, _use(), role="assistant"), _say(_result(content=[TEXT]))], "system": [TEXT], "tools": [{"name": "f", "input_schema": OBJECT}], "tool_choice": {"type": "auto"}, "stop_sequences": ["a"], "output_config": {"effort": "low"}},
        C: {"input": [USER, {"type": "reasoning", "content": [{"text": "r"}]}, _fc(namespace="n"), _out(output=[{"type": "input_text", "text": "t"}]), {"type": "custom_tool_call", "call_id": "2", "name": "apply_patch", "input": "x"}, {"type": "custom_tool_call_output", "call_id": "2", "output": "y"}], "tools": [{"type": "namespace", "name": "n", "tools": [{"type": "function", "name": "f", "parameters": OBJECT}]}], "text": {"format": {"type": "text"}}, "reasoning": {"effort": "low"}},
    }
    rows = [(p, b) for p in (A, B, C, "other", None) for b in fixed] + [(p, spoil(whole[p])) for p in (A, B, C) for _ in range(150)]
    got = _convert(spark, rows)
    assert len(got) == len(rows) and all(r["ok"] == (r["error"] is None) and r["ok"] == (r["messages"] is not None) for r in got)
    by = {(p, b): r for (p, b), r in zip(rows[: 5 * len(fixed)], got, strict=False)}
    assert all(by[A, b]["error"] == "malformed request: expected one JSON object" for b in fixed[:11])
    assert by[A, lone]["messages"][0]["content"] == "a�b\\ud800 � 😀"
    assert by[A, fixed[-2]]["model"] == "m" and by[A, fixed[-2]]["messages"][0]["content"] == "y" and by[A, fixed[-1]]["error"] == "invalid type: expected a number for `temperature`"
    assert by[None, lone]["error"] == "unknown protocol: " and not by["other", lone]["ok"]
    assert all(r["ok"] for r in _convert(spark, list(whole.items())[1:]))


def test_chat_requests(spark):
    image = {"type": "image_url", "image_url": {"url": "HTTP://x", "detail": "low"}}
    data = "data:image/png;base64,eHl6"
    body = {
        "messages": [{"role": "system", "content": ""}, {"role": "system", "content": None}, _say({"type": "text", "text": "a"}, image, {"type": "file", "file_data": data}), {"role": "assistant", "content": None, "reasoning_content": "why", "tool_calls": [_call("2"), _call("1", "g", "x")]}, {"role": "tool", "tool_call_id": "1", "content": [image]}, {"role": "tool", "tool_call_id": "2", "content": "r"}, {"role": "latest_reminder", "content": "now in JSON"}],
        "tools": [_tool(description="d", strict=True, parameters={"type": "object", "b": 1e-5, "a": [1.0, 2**63]}), _tool("g")], "stop": "S", "stream": True, "stream_options": {"include_usage": True}, "max_tokens": 4294967295, "temperature": 2.00000001, "top_p": 1, "response_format": {"type": "json_object"}, "seed": 2**63 - 1,
    }
    off = body | {"thinking": {"type": "disabled"}, "tool_choice": {"type": "function", "function": {"name": "g"}}, "reasoning_effort": "max"}
    full, named, none = _convert(spark, [(A, body), (A, off), (A, body | {"tool_choice": "none", "reasoning_effort": "none", "stream": False, "stream_options": None, "tools": [_tool(), _tool(parameters=None)]})])
    assert [m["role"] for m in full["messages"]] == ["user", "assistant", "tool", "tool", "latest_reminder"]
    assert full["messages"][0]["content"] == f"a\n\n{TOKEN}\n\n{TOKEN}" and full["messages"][0]["images"] == [{"kind": "url", "url": "HTTP://x", "detail": "low"}, {"kind": "data_url", "url": data, "detail": "high"}]
    assert full["messages"][1] == {"role": "assistant", "content": "", "images": [], "reasoning_content": "why", "calls": [{"id": "2", "name": "f", "arguments": "{}"}, {"id": "1", "name": "g", "arguments": "x"}], "tool_call_id": None}
    assert full["tools"] == [{"name": "f", "description": "d", "parameters": '{"type": "object", "b": 1e-05, "a": [1.0, 9223372036854775808]}', "strict": True}, {"name": "g", "description": None, "parameters": "{}", "strict": None}]
    keys = ("thinking", "effort", "tool_choice", "stops", "stream", "include_usage", "max_tokens", "temperature", "top_p", "response_format", "json_output", "reasoning_start", "parse_tools", "tools_first")
    assert [full[k] for k in keys] == [True, "high", "auto", ["S"], True, True, 4294967295, 2.0, 1.0, "json_object", True, True, True, False]
    assert [named[k] for k in ("thinking", "effort", "tool_choice", "tools_first", "parse_tools")] == [False, None, "required", True, True] and [t["name"] for t in named["tools"]] == ["g"]
    assert [none[k] for k in ("thinking", "tool_choice", "tools", "parse_tools", "include_usage")] == [False, "none", [], False, True]
    asked = [r["include_usage"] for r in _convert(spark, [(A, {"messages": [USER]} | m) for m in ({}, {"stream": True}, {"stream": True, "stream_options": {"include_usage": True}})])]
    assert asked == [True, False, True]


def test_block_requests(spark):
    blocks = [USER, _say({"type": "thinking", "thinking": "t"}, {"type": "text", "text": "so"}, {"type": "thinking", "thinking": "u"}, {"type": "tool_reference", "tool_name": "ref"}, {"type": "document"}, _use(input={"b": 1.0, "a": 2, "é": "\u001f"}), _use("y", input=[1]), role="assistant"), _say(_result("y", content=None), _result(), TEXT, {"type": "image", "source": {"type": "base64", "media_type": "IMAGE/JPG; q=1", "data": "eHl6eQ="}}), {"role": "system", "content": "s"}]
    tools = [{"name": "f", "description": "d", "input_schema": {"type": "object"}}, {"name": "s", "type": "web_search_20250305"}]
    server = _say({"type": "server_tool_use", "id": "q", "name": "s", "input": {}}, {"type": "web_search_tool_result", "tool_use_id": "q", "content": []}, TEXT, role="assistant")
    (full,) = _convert(spark, [(B, {"messages": blocks, "system": [TEXT, {"type": "document"}], "tools": tools[:1], "thinking": {"type": "adaptive", "budget_tokens": 2**64 - 1}, "output_config": {"effort": "ultra"}, "tool_choice": {"type": "any", "disable_parallel_tool_use": True}, "stop_sequences": ["a"]})])
    assert [(m["role"], m["content"]) for m in full["messages"]] == [("system", "t\n\n[Unsupported Document]"), ("user", "a"), ("assistant", "so\n\nref\n\n[Unsupported Document]"), ("tool", ""), ("tool", "r"), ("user", "t"), ("user", TOKEN), ("user", "<system-reminder>\ns\n</system-reminder>")]
    assert full["messages"][2]["reasoning_content"] == "t\n\nu" and [c["arguments"] for c in full["messages"][2]["calls"]] == ['{"b": 1.0, "a": 2, "é": "\\u001f"}', "[1]"] and full["messages"][6]["images"][0]["url"] == "data:image/jpeg;base64,eHl6eQ=="
    assert [full[k] for k in ("thinking", "effort", "tool_choice", "disable_parallel_tool_use", "stops", "parse_tools")] == [True, "max", "auto", True, ["a"], True] and int(full["thinking_budget"]) == 2**64 - 1
    ignored, dropped = _convert(spark, [(B, {"messages": [server], "tools": tools, "tool_choice": {"type": "tool", "name": "s"}}), (B, {"messages": [USER], "tools": tools, "tool_choice": {"type": "none"}})], how=conversion.Conversion(messages_web_search="ignore"))
    assert ignored["ok"] and [t["name"] for t in ignored["tools"]] == ["f"] and ignored["tool_choice"] == "auto" and [(m["role"], m["content"]) for m in ignored["messages"]] == [("assistant", "t")]
    assert dropped["tools"] == [] and dropped["tool_choice"] == "none"
    first = _convert(spark, [(B, {"messages": [USER, {"role": "assistant", "content": [{"type": "text", "text": ""}, TEXT]}], "thinking": {"type": "disabled"}, "tools": tools[:1], "tool_choice": {"type": "tool", "name": "f"}}), (B, {"messages": [USER]})], how=conversion.Conversion(default_thinking=False))
    assert first[0]["messages"][1]["content"] == "t" and first[0]["tools_first"] and (first[1]["thinking"], first[1]["effort"]) == (False, None)


def test_item_requests(spark):
    items = [
        {"role": "developer", "content": "d"}, {"type": "reasoning", "content": [{"text": "r"}, {"text": "s"}]}, {"type": "reasoning", "content": [{"text": "q"}]}, {"type": "reasoning"}, _say({"type": "output_text", "text": "x"}, {"type": "input_file"}, role="assistant"), {"role": "assistant", "content": ""}, {"role": "assistant", "content": "y"},
        _fc("b", namespace="n"), _fc("a", namespace="gone"), {"type": "web_search_call"}, {"type": "custom_tool_call", "call_id": "c", "name": "apply_patch", "input": 'é"\\\n\u001f'}, _out("b", "B"), {"type": "custom_tool_call_output", "call_id": "c", "output": "C"}, _out("a", [{"type": "input_text", "text": "A"}, {"type": "input_image", "image_url": "http://x"}]),
        _fc("d", namespace="gone"), _out("d"), _fc("e", name="g"), _out("e"), {"type": "message", "role": "user", "content": "json"},
    ]
    tools = [{"type": "function", "name": "n::f"}, {"type": "web_search"}, {"type": "other"}, {"type": "namespace", "name": "n", "description": "D", "tools": [{"type": "function", "name": "f", "parameters": OBJECT}, {"type": "function", "name": "g", "description": "own"}]}, {"type": "custom", "name": "apply_patch", "description": "other"}]
    full, ok, text = _convert(spark, [(C, {"input": items, "tools": tools[1:], "instructions": "I", "text": {"format": {"type": "json_object"}}, "stream": True}), (C, {"input": "hi", "tools": tools[3:], "tool_choice": {"type": "function", "name": "n::g"}, "reasoning": {"effort": "none"}}), (C, {"instructions": "I", "tools": tools[1:2], "tool_choice": {"type": "web_search"}})])
    assert [m["role"] for m in full["messages"]] == ["system", "user", "assistant", "tool", "tool", "tool", "assistant", "tool", "assistant", "tool", "user"]
    first = full["messages"][2]
    assert first["reasoning_content"] == "r\ns\nq" and first["content"] == "x\n\n[Unsupported Document]\n\ny"
    assert [(c["id"], c["name"]) for c in first["calls"]] == [("a", "gone::f"), ("b", "n::f"), ("c", "apply_patch")] and json.loads(first["calls"][2]["arguments"]) == {"input": 'é"\\\n\u001f'} and first["calls"][2]["arguments"] == '{"input":"é\\"\\\\\\n\\u001f"}'
    assert [(m["tool_call_id"], m["content"]) for m in full["messages"][3:6]] == [("a", f"A\n\n{TOKEN}"), ("b", "B"), ("c", "C")] and full["messages"][6]["calls"][0]["name"] == "gone::f" and full["messages"][3]["images"][0]["detail"] == "high"
    assert [t["name"] for t in full["tools"]] == ["n::f", "n::g", "apply_patch"] and [t["description"] for t in full["tools"]] == ["D\n", "D\nown", patch_tool.DESCRIPTION] and '"additionalProperties": false' in full["tools"][2]["parameters"]
    assert full["namespaces"] == {"n::f": {"namespace": "n", "name": "f"}, "n::g": {"namespace": "n", "name": "g"}} and full["custom_tools"] == ["apply_patch"] and full["json_output"] and full["stream"]
    assert [t["name"] for t in ok["tools"]] == ["n::g"] and (ok["tool_choice"], ok["tools_first"], ok["thinking"], ok["effort"]) == ("required", True, False, None)
    assert text["ok"] and text["tool_choice"] == "auto" and [m["content"] for m in text["messages"]] == ["I"]
    refused, refused_too = _convert(spark, [(C, {"input": "a", "tools": tools[1:2]}), (C, {"input": "a", "tool_choice": {"type": "web_search_2025_08_26"}})], how=conversion.Conversion(responses_web_search="reject"))
    assert refused["error"] == refused_too["error"] == "Server tools are not supported"


@pytest.mark.parametrize(("schema", "fault"), [
    ({"type": "object", "properties": {"a": {"$ref": "#/$defs/x"}}, "$defs": {"x": {"type": ["string", "null"], "pattern": "^a+$"}}}, None),
    ({"$ref": "#", "type": "object", "properties": {"a": True}}, "/$ref: `#` leads back to itself"), ({"properties": {"next": {"$ref": "#"}}}, None), ({"$defs": {"a": {"$ref": "#/$defs/b"}, "b": {"$ref": "#/$defs/a"}}}, "leads back to itself"),
    ({"properties": {"a": {"$ref": "#/$defs/x"}}}, "cannot resolve"), ({"$ref": "http://x"}, "cannot resolve"), ({"properties": {"a": {"$ref": "#here"}, "b": {"$anchor": "here"}}}, None), ({"properties": {"a": 5}}, "/properties/a: expected an object or a boolean"), ({"properties": []}, "/properties"),
    ({"anyOf": []}, "/anyOf"), ({"items": [{"type": "text"}]}, "/items/0/type"), ({"type": ["string", "string"]}, "/type"), ({"enum": 1}, "/enum"), ({"required": ["a", "a"]}, "/required"), ({"minItems": 1.5}, "/minItems"), ({"minItems": 2.0, "maximum": 1.5}, None), ({"maximum": "1"}, "/maximum"), ({"multipleOf": 0}, "/multipleOf"),
    ({"pattern": "("}, "/pattern"), ({"patternProperties": {"(": {}}}, "/patternProperties"), ({"uniqueItems": "yes"}, "/uniqueItems"), ({"description": 5}, "/description"), ({"dependentRequired": {"a": "b"}}, "/dependentRequired"), ({"not": {"not": 5}}, "/not/not"), ({"default": 5, "examples": "x", "const": None}, None), ({"$defs": {"a/b": {"~": {}}}, "$ref": "#/$defs/a~1b/~0"}, None),
])
def test_schemas(schema, fault):
    got = schemas.fault(schema)
    assert got is None if fault is None else fault in got
