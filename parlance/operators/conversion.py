"""Requests of three dialects to one conversation, as native expressions over a VARIANT.

`convert` takes (protocol, body) rows and gives one row a request, whatever its body holds, without a shuffle: the
conversation, or the first error in each dialect's own order. Decoding checks every field that is read; what a
request may then not ask for is checked on the way. Histories of calls and results are folded with `aggregate`. Python
only writes tool schemas and inputs out in Python style and checks the schemas (functions/schemas.py), for requests that have any.

A body of more than 16 MiB fits no VARIANT and is refused as malformed. A request of unknown protocol is refused too."""

from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import dataclass
from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patch_tool, schemas
from ..functions import tokens as T
from . import wire as W
from .wire import child, fail, first, first_of, let, said

IMAGE = "struct<kind:string,url:string,detail:string>"
CALL = "struct<id:string,name:string,arguments:string>"
MESSAGE = f"struct<role:string,content:string,images:array<{IMAGE}>,reasoning_content:string,calls:array<{CALL}>,tool_call_id:string>"
TOOL = "struct<name:string,description:string,parameters:string,strict:boolean>"
CONVERTED = {
    "ok": "boolean", "error_kind": "string", "error": "string", "messages": f"array<{MESSAGE}>", "thinking": "boolean", "effort": "string", "tools": f"array<{TOOL}>", "tool_choice": "string", "response_format": "string",
    "max_tokens": "bigint", "temperature": "float", "top_p": "float", "thinking_budget": "decimal(20,0)", "disable_parallel_tool_use": "boolean", "stops": "array<string>", "model": "string", "stream": "boolean", "include_usage": "boolean",
    "reasoning_start": "boolean", "parse_tools": "boolean", "tools_first": "boolean", "json_output": "boolean", "custom_tools": "array<string>", "namespaces": "map<string,struct<namespace:string,name:string>>",
}
#: Limits, and what the protocols' errors and placeholders say.
MAX_STOPS, MAX_URL, U32, U64 = 16, 8192, 2**32 - 1, 2**64 - 1
DOCUMENT = "[Unsupported Document]"
TOKEN = f'The sub-string "{T.IMAGE}" in your input is not allowed for this API. Please remove "{T.IMAGE}" from your input and try again.'
NO_THINKING = "Thinking mode does not support this tool_choice"
UNIQUE = "Tool names must be unique"
NO_SERVER = "Server tools are not supported"
BAD_BLOCK = "Unsupported content block"
BAD_INPUT = "invalid tool input"
BAD_IMAGE = "You have uploaded an unsupported image. Please make sure your image is valid and has one of the following formats: webp, png, jpeg, and gif."
FOLLOW = "An assistant message with 'tool_calls' must be followed by tool messages responding to each 'tool_call_id'."
UNANSWERED = ". Each `tool_use` block must have a corresponding `tool_result` block in the next message."
DETAILS = ("low", "high", "original", "auto")
MEDIA = ("image/jpeg", "image/png", "image/gif", "image/webp")
LEVELS = {"minimal": "low", "low": "low", "medium": "high", "high": "high", "xhigh": "xhigh", "max": "max"}
EFFORTS = {"chat_completions": ("none", "minimal", "low", "medium", "high", "xhigh", "max"), "messages": ("low", "medium", "high", "xhigh", "ultra", "max")}
EFFORTS["responses"] = EFFORTS["chat_completions"]


@dataclass(frozen=True)
class Conversion:
    """What requests leave open; a web search tool is refused (`reject`) or left out (`ignore`)."""

    default_thinking: bool = True
    messages_web_search: str = "reject"
    responses_web_search: str = "ignore"


def _none(kind: str) -> Column:
    return F.lit(None).cast(kind)


def _empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _text_or(value: Column, other: str = "") -> Column:
    return F.coalesce(value, F.lit(other))


def _has_token(value: Column) -> Column:
    return F.coalesce(value.contains(T.IMAGE), F.lit(False))


def _message(role: Column | str, content: Column, images: Column | None = None, reasoning: Column | None = None, calls: Column | None = None, call_id: Column | None = None) -> Column:
    fields = {
        "role": F.lit(role) if isinstance(role, str) else role, "content": content, "images": _empty(IMAGE) if images is None else images, "reasoning_content": _none("string") if reasoning is None else reasoning,
        "calls": _empty(CALL) if calls is None else calls, "tool_call_id": _none("string") if call_id is None else call_id,
    }
    return F.struct(*(v.alias(k) for k, v in fields.items())).cast(MESSAGE)


# ---- images and contents


def _image(kind: str, url: Column, detail: Column | None = None) -> Column:
    return F.struct(F.lit(kind).alias("kind"), url.alias("url"), F.coalesce(detail if detail is not None else _none("string"), F.lit("high")).alias("detail")).cast(IMAGE)


def _is_http(url: Column) -> Column:
    return F.lower(F.left(url, F.lit(4))) == "http"


def _url_error(url: Column, path: Column, other: Column) -> Column:
    """`other`: what holds for a URL that isn't one of the web."""
    size = F.octet_length(url)
    long = said(path, ": external link length ", size, f" too long, max link length {MAX_URL}. Consider passing file data directly with base64 data url instead.")
    return F.when(_is_http(url), F.when(size > MAX_URL, long)).otherwise(other)


def _any_url_error(url: Column, path: Column) -> Column:
    return _url_error(url, path, fail(~url.contains("base64,"), path, ": Unsupported image_url format"))


def _any_image(url: Column, detail: Column) -> Column:
    return F.when(_is_http(url), _image("url", url, detail)).otherwise(_image("data_url", url, detail))


def _file_id_error(path: Column) -> Column:
    return said(path, ": file_id is not supported. Pass the image as a base64 data url instead.")


def _part(text: Column, image: Column | None = None, wrong: Column | None = None, bad: Column | None = None, spoken: Column | None = None) -> Column:
    """A content block: its text, its image, its decoding error, its conversion error, and the text in which an image token is looked for."""
    fields = {"text": text, "image": _none(IMAGE) if image is None else image, "wrong": _none("string") if wrong is None else wrong, "bad": _none("string") if bad is None else bad, "spoken": text if spoken is None else spoken}
    return F.struct(*(v.alias(k) for k, v in fields.items()))


def _content(v: Column, block, path: Column, generic: str | None = None) -> Column:  # noqa: ANN001
    """Text or blocks: text, images, wrong, bad, token (whether its texts hold an image token), plain (it is text). Null is no block."""

    def put(parts: Column) -> Column:
        wrong = first(fail(~W.absent(v) & W.text(v).isNull() & W.items(v).isNull(), generic or "invalid content: expected a string or a list"), fail(first_of(parts, lambda p: p["wrong"]).isNotNull(), generic) if generic else first_of(parts, lambda p: said("invalid content: ", p["wrong"])))
        return F.struct(
            F.coalesce(W.text(v), F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n")).alias("text"), F.filter(F.transform(parts, lambda p: p["image"]), lambda i: i.isNotNull()).alias("images"), wrong.alias("wrong"),
            first_of(parts, lambda p: p["bad"]).alias("bad"), (_has_token(W.text(v)) | F.exists(parts, lambda p: _has_token(p["spoken"]))).alias("token"), W.text(v).isNotNull().alias("plain"),
        )

    return let(F.transform(F.coalesce(W.items(v), F.array().cast("array<variant>")), lambda b, k: block(b, k, path)), put)


def _textual(content: Column, role: str) -> Column:
    """The error of a content that may hold no image."""
    return first(content["bad"], fail(F.size(content["images"]) > 0, f"Image in {role} message is unsupported"))


def _chat_block(b: Column, k: Column, path: Column) -> Column:
    kind, text, shown = W.text(child(b, "type")), W.text(child(b, "text")), child(b, "image_url")
    url, detail, data = _text_or(W.text(child(shown, "url"))), W.text(child(shown, "detail")), W.text(child(b, "file_data"))
    at = said(path, ".content[", k, "]")
    wrong = first(
        fail(~W.is_object(b), "expected an object"), W.need_text(child(b, "type"), "type"), W.need_text(child(b, "text"), "text"), W.need_object(shown, "image_url"), W.need_text(child(shown, "url"), "url"),
        W.need_text(child(shown, "detail"), "detail"), W.one_of(detail, DETAILS), W.need_text(child(b, "file_id"), "file_id"), W.need_text(child(b, "file_data"), "file_data"), W.need_text(child(b, "filename"), "filename"),
        W.one_of(_text_or(kind), ("text", "image_url", "file")), fail((kind == "text") & text.isNull(), "missing field `text`"), fail((kind == "image_url") & W.absent(shown), "missing field `image_url`"),
    )
    bad = F.when(kind == "image_url", _any_url_error(url, said(at, ".image_url.url"))).when(kind == "file", first(F.when(W.text(child(b, "file_id")).isNotNull(), _file_id_error(at)), fail(data.isNull(), at, ": file must have file_data")))
    image = F.when(kind == "image_url", _any_image(url, detail)).when(kind == "file", _image("data_url", data))
    return _part(F.when(kind == "text", text).otherwise(T.IMAGE), image, wrong, bad, F.when(kind == "text", text))


def _source(source: Column, path: Column) -> tuple[Column, Column, Column]:
    """A block's image source: its image, its decoding error, its conversion error."""
    kind, media, data, url = (W.text(child(source, name)) for name in ("type", "media_type", "data", "url"))
    wrong = first(
        fail(~W.is_object(source), "expected an object"), W.need_text(child(source, "type"), "type", True), *(W.need_text(child(source, name), name) for name in ("media_type", "data", "url", "file_id")),
        W.one_of(kind, ("base64", "url", "file")), fail((kind == "base64") & media.isNull(), "missing field `media_type`"), fail((kind == "base64") & data.isNull(), "missing field `data`"),
        fail((kind == "url") & url.isNull(), "missing field `url`"), fail((kind == "file") & W.absent(child(source, "file_id")), "missing field `file_id`"),
    )
    plain = F.lower(F.trim(F.substring_index(media, ";", 1)))
    plain = F.when(plain == "image/jpg", "image/jpeg").otherwise(plain)
    bare = F.rtrim(data, F.lit("="))
    short = F.length(bare) % 4
    padded = F.when(data.endswith("=") & (short != 1), F.concat(bare, F.when(short == 0, "").when(short == 2, "==").otherwise("="))).otherwise(data)
    packed = F.regexp_replace(padded, r"[\r\n]", "")
    decodes = packed.rlike(r"\A[A-Za-z0-9+/]*={0,2}\z") & (F.length(packed) % 4 == 0)
    bad = (
        F.when(kind == "base64", first(fail(~F.coalesce(plain.isin(*MEDIA), F.lit(False)), path, f": {BAD_IMAGE}"), fail(~decodes, path, ": base64 decode error")))
        .when(kind == "url", _url_error(url, path, said(path, ': invalid url: "', url, '"')))
        .when(kind == "file", _file_id_error(path))
    )
    image = F.when(kind == "base64", _image("data_url", said("data:", plain, ";base64,", padded))).when(kind == "url", _image("url", url))
    return image, wrong, bad


def _text_block(b: Column, k: Column, path: Column) -> Column:
    """Blocks of a system text or a tool's result."""
    kind, text, name = W.text(child(b, "type")), W.text(child(b, "text")), W.text(child(b, "tool_name"))
    at = said(path, "[", k, "]")
    image, source_wrong, source_bad = _source(child(b, "source"), at)
    known = ("text", "tool_reference", "image", "document")
    wrong = first(
        fail(~W.is_object(b), "expected an object"), W.need_text(child(b, "type"), "type", True),
        F.when(kind.isin(*known), first(W.need_text(child(b, "text"), "text"), W.need_text(child(b, "tool_name"), "tool_name"), fail((kind == "text") & text.isNull(), "missing field `text`"), fail((kind == "tool_reference") & name.isNull(), "missing field `tool_name`"), F.when(kind == "image", source_wrong))),
    )
    own = F.when(kind == "text", text).when(kind == "tool_reference", name)
    shown = F.when(kind == "image", T.IMAGE).when(kind == "document", DOCUMENT).otherwise(own)
    return _part(_text_or(shown), F.when(kind == "image", image), wrong, F.when(kind == "image", source_bad).when(~kind.isin(*known), BAD_BLOCK), own)


def _item_block(b: Column, k: Column, path: Column) -> Column:
    """Blocks of an item's content; `path` ends where the number goes."""
    kind, text = W.text(child(b, "type")), W.text(child(b, "text"))
    url, detail, file_id = (W.text(child(b, name)) for name in ("image_url", "detail", "file_id"))
    at, spoken = said(path, "[", k, "]"), kind.isin("input_text", "output_text")
    wrong = first(
        fail(~W.is_object(b), "expected an object"), W.need_text(child(b, "type"), "type", True), W.need_text(child(b, "text"), "text"), fail(spoken & text.isNull(), "missing field `text`"),
        F.when(kind == "input_image", first(W.need_text(child(b, "image_url"), "image_url"), W.need_text(child(b, "detail"), "detail"), W.one_of(detail, DETAILS), W.need_text(child(b, "file_id"), "file_id"))),
    )
    has_url = _text_or(url) != ""
    bad = F.when(kind == "input_image", first(
        fail(~has_url & file_id.isNull(), at, ": input_image must have image_url or file_id"), fail(has_url & file_id.isNotNull(), at, ": input_image cannot have both image_url and file_id"),
        F.when(~has_url, _file_id_error(at)), _any_url_error(url, said(at, ".image_url")),
    )).when(~spoken & (kind != "input_file"), BAD_BLOCK)
    shown = F.when(kind == "input_image", T.IMAGE).when(kind == "input_file", DOCUMENT).otherwise(text)
    return _part(_text_or(shown), F.when(kind == "input_image", _any_image(url, detail)), wrong, bad, F.when(spoken, text))


def _output_block(b: Column, k: Column, path: Column) -> Column:
    """Blocks of a call's output: as above, without output_text."""
    part = _item_block(b, k, path)
    return part.withField("bad", F.when(W.text(child(b, "type")) == "output_text", F.lit(BAD_BLOCK)).otherwise(part["bad"]))


# ---- options


def _sampling_wrong(v: Column, limit: str) -> Column:
    return first(W.need_whole(child(v, limit), limit, U32), W.need_real(child(v, "temperature"), "temperature"), W.need_real(child(v, "top_p"), "top_p"), W.need_flag(child(v, "stream"), "stream"), W.need_text(child(v, "model"), "model"))


def _sampling_bad(v: Column, limit: str) -> Column:
    temperature, top_p = (W.real(child(v, k)).cast("float") for k in ("temperature", "top_p"))
    return first(
        fail(W.whole(child(v, limit)) == 0, f"{limit} must be greater than zero"), fail((temperature < 0) | (temperature > 2), "temperature must be in [0, 2]"), fail(F.isnan(top_p) | (top_p <= 0) | (top_p > 1), "top_p must be in (0, 1]"),
    )


def _effort(protocol: str, value: Column) -> tuple[Column, Column]:
    """The level that an effort stands for, and its error."""
    asked = W.text(value)
    level = F.coalesce(*(F.when(asked == k, F.lit(LEVELS.get(k, "max"))) for k in EFFORTS[protocol] if k != "none"))
    return level, first(W.need_text(value, "effort"), W.one_of(asked, EFFORTS[protocol]))


def _thinking(v: Column) -> tuple[Column, Column]:
    """Whether a thinking control asks for thinking, null without one; its error."""
    control = child(v, "thinking")
    asked = W.text(child(control, "type"))
    wrong = F.when(~W.absent(control), first(W.need_object(control, "thinking"), W.need_text(child(control, "type"), "type", True), W.one_of(asked, ("enabled", "adaptive", "disabled"), "`enabled` or `disabled`"), W.need_whole(child(control, "budget_tokens"), "budget_tokens", U64)))
    return F.when(~W.absent(control), asked != "disabled"), wrong


def _strings(v: Column) -> Column:
    return F.transform(W.items(v), W.text)


def _strings_wrong(v: Column, name: str) -> Column:
    return first(W.need_items(v, name), fail(F.exists(W.items(v), lambda x: W.text(x).isNull()), f"invalid type: expected strings in `{name}`"))


def _name_error(name: Column, path: Column) -> Column:
    return fail(~F.coalesce(name.rlike(r"\A[A-Za-z0-9_-]{1,128}\z"), F.lit(False)), path, ": expected 1-128 ASCII letters, digits, underscores or hyphens")


def _schema_error(schema: Column, path: Column, absent_ok: bool = True) -> Column:
    """Of a row of functions.schemas: not an object schema, or at fault."""
    fault = schema["fault"]
    at_fault = fail(fault.isNotNull(), path, ": ", fault)
    typed = fail(fault.isin("null", "object"), path, " must be a JSON Schema of type object")
    return F.when(fault == "missing", _none("string")).otherwise(first(typed, at_fault)) if absent_ok else first(typed, at_fault)


def _parameters(schema: Column) -> Column:
    return F.coalesce(schema["text"], F.lit("{}"))


def _tool(name: Column, description: Column, parameters: Column, strict: Column | None = None) -> Column:
    return F.struct(name.alias("name"), description.alias("description"), parameters.alias("parameters"), (_none("boolean") if strict is None else strict).alias("strict")).cast(TOOL)


def _repeated(names: Column) -> Column:
    return F.size(F.array_distinct(names)) < F.size(names)


def _tool_token(tools: Column, messages: Column) -> Column:
    """Texts of tools and calls that hold an image token."""
    in_tool = F.exists(tools, lambda t: _has_token(t["name"]) | _has_token(t["description"]) | _has_token(t["parameters"]))
    in_call = F.exists(messages, lambda m: F.exists(m["calls"], lambda c: _has_token(c["name"]) | _has_token(c["arguments"])))
    return F.when(in_tool | in_call, TOKEN)


def _asks_json(messages: Column) -> Column:
    return F.exists(messages, lambda m: m["content"].rlike("(?i)json"))


def _row(error: Column, **made: Column) -> Column:
    """A row of CONVERTED: the fields made, or the error."""
    def put(r: Column) -> Column:
        e = r["error"]
        own = {"ok": e.isNull(), "error": e, "error_kind": F.when(e.isNotNull(), F.when(e == BAD_INPUT, "internal").otherwise("bad_request"))}
        return F.struct(*((own[k] if k in own else F.when(e.isNull(), made[k] if k in made else _none(kind))).cast(kind).alias(k) for k, kind in CONVERTED.items()))

    return let(F.struct(error.alias("error")), put)


def _common(v: Column, limit: str, on: Column, level: Column) -> dict[str, Column]:
    return {
        "thinking": on, "effort": F.when(on, F.coalesce(level, F.lit("high"))), "max_tokens": W.whole(child(v, limit)).cast("bigint"), "temperature": W.real(child(v, "temperature")), "top_p": W.real(child(v, "top_p")),
        "model": _text_or(W.text(child(v, "model"))), "stream": F.coalesce(W.flag(child(v, "stream")), F.lit(False)), "reasoning_start": on, "include_usage": F.lit(True),
    }


# ---- chat completions


def _chat_message(m: Column, i: Column) -> Column:
    role, content, calls = W.text(child(m, "role")), child(m, "content"), child(m, "tool_calls")
    path = F.when(role == "tool", said("messages[", i, "].content")).otherwise(said("messages[", i, "]"))
    function = lambda c: child(c, "function")
    call_wrong = lambda c: first(fail(~W.is_object(c), "expected an object in `tool_calls`"), W.need_text(child(c, "id"), "id"), W.need_object(function(c), "function"), W.need_text(child(function(c), "name"), "name"), W.need_text(child(function(c), "arguments"), "arguments"))
    call = lambda c: F.struct(_text_or(W.text(child(c, "id"))).alias("id"), _text_or(W.text(child(function(c), "name"))).alias("name"), _text_or(W.text(child(function(c), "arguments"))).alias("arguments")).cast(CALL)
    known = ("system", "user", "assistant", "tool", "latest_reminder")

    def put(c: Column) -> Column:
        wrong = first(
            fail(~W.is_object(m), "invalid type: expected an object in `messages`"), W.need_text(child(m, "role"), "role"), W.need_text(child(m, "reasoning_content"), "reasoning_content"), W.need_items(calls, "tool_calls"),
            first_of(W.items(calls), call_wrong), W.need_text(child(m, "tool_call_id"), "tool_call_id"), W.one_of(_text_or(role), known), fail((role != "assistant") & content.isNull(), "missing field `content`"),
            fail((role == "tool") & W.absent(child(m, "tool_call_id")), "missing field `tool_call_id`"), c["wrong"], fail((role == "latest_reminder") & ~c["plain"], "invalid content: expected a string"),
        )
        return F.struct(
            role.alias("role"), c.alias("content"), content.isNotNull().alias("spoke"), W.text(child(m, "reasoning_content")).alias("reasoning"), W.items(calls).isNotNull().alias("called"),
            F.coalesce(F.transform(W.items(calls), call), _empty(CALL)).alias("calls"), W.text(child(m, "tool_call_id")).alias("call_id"), wrong.alias("wrong"),
        )

    return let(_content(content, _chat_block, path), put)


def _chat_history(messages: Column) -> Column:
    """The first error of the messages' order: each assistant's calls are answered by as many results right behind it."""
    state = "struct<i:int,left:int,ids:array<string>,seen:array<string>,error:string>"
    start = F.struct(F.lit(0).alias("i"), F.lit(0).alias("left"), _empty("string").alias("ids"), _empty("string").alias("seen"), _none("string").alias("error")).cast(state)

    def step(s: Column, m: Column) -> Column:
        ids = F.transform(m["calls"], lambda c: c["id"])
        twice = F.get(F.filter(ids, lambda x, k: F.array_position(ids, x) <= k), F.lit(0))
        repeated = lambda x: said("Duplicate value for 'tool_call_id' of ", x, " in message[", s["i"], "]")
        answer = first(
            fail(m["role"] != "tool", f"{FOLLOW} (insufficient tool messages following tool_calls message)"), fail(~F.array_contains(s["ids"], m["call_id"]), f"{FOLLOW} Unexpected tool_call_id: ", m["call_id"]),
            F.when(F.array_contains(s["seen"], m["call_id"]), repeated(m["call_id"])), m["content"]["bad"],
        )
        own = (
            F.when(m["role"] == "system", _textual(m["content"], "system"))
            .when(m["role"] == "user", m["content"]["bad"])
            .when(m["role"] == "tool", F.lit("Messages with role 'tool' must be a response to a preceding message with 'tool_calls'"))
            .when(m["role"] == "assistant", first(
                fail(~m["spoke"] & ~m["called"], "Invalid assistant message: content or tool_calls must be set"), _textual(m["content"], "assistant"),
                fail(m["called"] & (F.size(ids) == 0), "Invalid 'messages[", s["i"], "].tool_calls': empty array. Expected an array with minimum length 1, but got an empty array instead."), F.when(twice.isNotNull(), repeated(twice)),
            ))
        )
        open_ = s["left"] > 0
        return F.struct(
            (s["i"] + 1).alias("i"), F.when(open_, s["left"] - 1).otherwise(F.size(ids)).alias("left"), F.when(open_, s["ids"]).otherwise(ids).alias("ids"),
            F.when(open_, F.array_append(s["seen"], m["call_id"])).otherwise(_empty("string")).alias("seen"), F.coalesce(s["error"], F.when(open_, answer).otherwise(own)).alias("error"),
        ).cast(state)

    return F.aggregate(messages, start, step, lambda s: first(s["error"], fail(s["left"] > 0, f"{FOLLOW} (insufficient tool messages following tool_calls message)")))


def _chat(v: Column, given: Column, how: Conversion) -> Column:
    protocol = "chat_completions"
    asked, thinking_wrong = _thinking(v)
    effort = W.text(child(v, "reasoning_effort"))
    level, effort_wrong = _effort(protocol, child(v, "reasoning_effort"))
    on = F.coalesce(asked, effort != "none", F.lit(how.default_thinking))
    stop, options, form, choice = (child(v, k) for k in ("stop", "stream_options", "response_format", "tool_choice"))
    mode, named, tools = W.text(choice), W.text(child(child(choice, "function"), "name")), F.coalesce(W.items(child(v, "tools")), F.array().cast("array<variant>"))
    function = lambda t: child(t, "function")
    tool_wrong = lambda t: first(fail(~W.is_object(t), "invalid type: expected an object in `tools`"), W.need_text(child(t, "type"), "type"), W.need_object(function(t), "function"), W.need_text(child(function(t), "name"), "name"), W.need_text(child(function(t), "description"), "description"), W.need_flag(child(function(t), "strict"), "strict"))
    name = lambda t: _text_or(W.text(child(function(t), "name")))
    penalty = lambda k: W.real(child(v, k)).cast("float")

    none, by_name = _text_or(mode) == "none", ~W.absent(choice) & mode.isNull()
    wanted = _text_or(named)
    schema = lambda k: F.get(F.get(given["schemas"], k), F.lit(0))
    one = lambda t, k: _tool(name(t), W.text(child(function(t), "description")), _parameters(schema(k)), W.flag(child(function(t), "strict")))

    def chosen(d: Column) -> Column:
        made = F.when(by_name, F.filter(d["tools"], lambda t: t["name"] == wanted)).otherwise(d["tools"])
        messages = F.filter(F.transform(d["messages"], lambda m: _message(m["role"], m["content"]["text"], m["content"]["images"], m["reasoning"], m["calls"], m["call_id"])), lambda m: (m["role"] != "system") | (m["content"] != ""))
        return F.struct(d["messages"].alias("messages"), made.alias("made"), messages.alias("out"), ((F.size(d["tools"]) > 0) & (by_name | (_text_or(mode) == "required"))).alias("required"))

    def put(d: Column) -> Column:
        made, messages, required = d["made"], d["out"], d["required"]
        wrong = first(
            fail(child(v, "messages").isNull(), "missing field `messages`"), fail(child(v, "model").isNull(), "missing field `model`"), W.need_items(child(v, "messages"), "messages"), _sampling_wrong(v, "max_tokens"),
            W.need_whole(child(v, "n"), "n", 255), W.need_real(child(v, "frequency_penalty"), "frequency_penalty"), W.need_real(child(v, "presence_penalty"), "presence_penalty"), W.need_whole(child(v, "seed"), "seed", U64),
            F.when(~W.absent(stop) & W.text(stop).isNull(), _strings_wrong(stop, "stop")), W.need_object(options, "stream_options"), W.need_flag(child(options, "include_usage"), "include_usage"), W.need_object(form, "response_format"),
            W.need_text(child(form, "type"), "type"), W.need_text(child(form, "regex"), "regex"), F.when(~W.absent(form), W.one_of(_text_or(W.text(child(form, "type"))), ("json_object", "json_schema", "regex", "text"))),
            W.need_items(child(v, "tools"), "tools"), first_of(tools, tool_wrong), W.one_of(mode, ("none", "auto", "required")),
            F.when(~W.absent(choice) & mode.isNull(), first(W.need_object(choice, "tool_choice"), W.need_text(child(choice, "type"), "type"), W.need_object(child(choice, "function"), "function"), W.need_text(child(child(choice, "function"), "name"), "name"))),
            effort_wrong, thinking_wrong, W.need_flag(child(v, "parallel_tool_calls"), "parallel_tool_calls"), first_of(d["messages"], lambda m: m["wrong"]),
        )
        tool_bad = first(
            first_of(F.transform(tools, lambda t, k: _name_error(name(t), said("tools.", k, ".function.name"))), lambda e: e),
            F.when(~none & (F.size(tools) > 0), first(
                _tools_in_order(F.transform(tools, lambda t, k: F.struct(name(t).alias("name"), _schema_error(schema(k), said("tools.", k, ".function.parameters")).alias("error")))),
                fail(by_name & (F.size(made) == 0), "tool_choice: no tool named '", wanted, "' was specified"), fail(required & on, NO_THINKING),
            )),
        )
        stops = F.when(W.text(stop).isNotNull(), F.array(W.text(stop))).otherwise(F.coalesce(_strings(stop), _empty("string")))
        json = W.text(child(form, "type")) == "json_object"
        speech = lambda m: (m["role"] != "latest_reminder") & m["content"]["token"] | (m["role"] == "latest_reminder") & m["content"]["token"] | (m["role"] == "assistant") & _has_token(m["reasoning"])
        bad = first(
            fail(W.whole(child(v, "n")) != 1, "Invalid n value (currently only n = 1 is supported)"), *(fail((penalty(k) < -2) | (penalty(k) > 2), f"{k} must be in [-2, 2]") for k in ("frequency_penalty", "presence_penalty")),
            _sampling_bad(v, "max_tokens"), fail(W.whole(child(v, "seed")) >= F.lit(Decimal(2**63)), "seed must be in [0, 2^63)"), fail(F.size(_strings(stop)) > MAX_STOPS, "ChatCompletionStopSequences string array too long: ", F.size(stops)),
            fail(~F.coalesce(W.flag(child(v, "stream")), F.lit(False)) & ~W.absent(options), "stream_options should be set along with stream = true"), tool_bad, fail(F.size(d["messages"]) == 0, "Empty input messages"),
            F.when(F.exists(d["messages"], speech), TOKEN), _chat_history(d["messages"]), _tool_token(made, messages),
            F.when(json & ~_asks_json(messages), "Prompt must contain the word 'json' in some form to use 'response_format' of type 'json_object'."), F.when(W.text(child(form, "type")) == "regex", "response_format: only text and json_object are supported"),
        )
        common = _common(v, "max_tokens", on, level)
        more = {"messages": messages, "tools": made, "tool_choice": F.when(none, "none").when(required, "required").otherwise("auto"), "stops": stops, "response_format": F.when(json, "json_object").otherwise("text"), "json_output": F.coalesce(json, F.lit(False)), "parse_tools": (F.size(made) > 0) & ~none, "tools_first": required}
        more["include_usage"] = ~common["stream"] | F.coalesce(W.flag(child(options, "include_usage")), F.lit(False))
        return _row(first(wrong, bad), **(common | more))

    decoded = F.transform(F.coalesce(W.items(child(v, "messages")), F.array().cast("array<variant>")), _chat_message)
    every = F.when(none, _empty(TOOL)).otherwise(F.transform(tools, one))
    return let(F.struct(decoded.alias("messages"), every.alias("tools")), lambda d: let(chosen(d), put))


def _tools_in_order(tools: Column) -> Column:
    """The first error of tools that are checked one by one: a name that came before, or the tool's own."""
    names = F.transform(tools, lambda t: t["name"])
    return first_of(F.transform(tools, lambda t, k: first(fail(F.array_position(names, t["name"]) <= k, UNIQUE), t["error"])), lambda e: e)


# ---- messages of content blocks

_BLOCKS = ("text", "tool_reference", "tool_use", "tool_result", "thinking", "image", "server_tool_use", "web_search_tool_result", "document")
_SPOKEN = ("text", "tool_reference", "image", "document")


def _block(b: Column, k: Column, i: Column, inputs: Column) -> Column:
    """A content block of a user or an assistant: kind, own text, image, id, arguments, result, errors."""
    kind = W.text(child(b, "type"))
    field = lambda name: W.text(child(b, name))
    at = said("messages.", i, ".content[", k, "]")
    image, source_wrong, source_bad = _source(child(b, "source"), at)
    result = child(b, "content")

    def put(c: Column) -> Column:
        missing = lambda kinds, name: fail(kind.isin(*kinds) & W.absent(child(b, name)), f"missing field `{name}`")
        wrong = first(
            fail(~W.is_object(b), "expected an object"), W.need_text(child(b, "type"), "type", True),
            F.when(kind.isin(*_BLOCKS), first(
                *(W.need_text(child(b, name), name) for name in ("text", "tool_name", "id", "name", "tool_use_id", "signature", "thinking")), W.need_flag(child(b, "is_error"), "is_error"), missing(["text"], "text"), missing(["tool_reference"], "tool_name"),
                missing(["tool_use", "server_tool_use"], "id"), missing(["tool_use", "server_tool_use"], "name"), fail(kind.isin("tool_use", "server_tool_use") & child(b, "input").isNull(), "missing field `input`"),
                missing(["tool_result", "web_search_tool_result"], "tool_use_id"), F.when(kind == "tool_result", c["wrong"]), missing(["thinking"], "thinking"), F.when(kind == "image", source_wrong),
                fail((kind == "web_search_tool_result") & result.isNull(), "missing field `content`"),
            )),
        )
        own = F.when(kind == "text", field("text")).when(kind == "tool_reference", field("tool_name"))
        shown = F.when(kind == "image", T.IMAGE).when(kind == "document", DOCUMENT).when(kind == "tool_result", c["text"]).otherwise(own)
        token = _has_token(F.when(kind == "thinking", field("thinking")).otherwise(own)) | ((kind == "tool_result") & c["token"])
        return F.struct(
            kind.alias("kind"), _text_or(shown).alias("text"), F.when(kind == "image", F.array(image)).when(kind == "tool_result", c["images"]).otherwise(_empty(IMAGE)).alias("images"),
            F.when(kind == "image", source_bad).when(kind == "tool_result", c["bad"]).alias("bad"), F.when(kind == "tool_result", field("tool_use_id")).otherwise(field("id")).alias("id"), field("name").alias("name"),
            F.get(F.get(inputs, i), k).alias("arguments"), field("thinking").alias("thinking"), wrong.alias("wrong"), token.alias("token"),
        )

    return let(_content(F.when(kind == "tool_result", result), _text_block, at), put)


def _blocks_message(m: Column, i: Column, inputs: Column) -> Column:
    role, content = W.text(child(m, "role")), child(m, "content")
    generic = "data did not match any variant of untagged enum MessagesContent"
    system = _content(F.when(role == "system", content), _text_block, said("messages.", i), "data did not match any variant of untagged enum MessagesTextOrTextBlocks")

    def put(s: Column) -> Column:
        c, blocks = s["system"], s["blocks"]
        wrong = first(
            fail(~W.is_object(m), "invalid type: expected an object in `messages`"), fail(child(m, "role").isNull(), "missing field `role`"), fail(F.is_variant_null(child(m, "role")), "invalid type: null, expected string or map"), W.need_text(child(m, "role"), "role"),
            fail(content.isNull(), "missing field `content`"), W.one_of(role, ("user", "assistant", "system")),
            F.when(role == "system", first(c["wrong"], fail(F.is_variant_null(content), "data did not match any variant of untagged enum MessagesTextOrTextBlocks"))).otherwise(fail(W.text(content).isNull() & W.items(content).isNull() | F.exists(blocks, lambda b: b["wrong"].isNotNull()), generic)),
        )
        return F.struct(role.alias("role"), c.alias("system"), W.text(content).alias("plain"), blocks.alias("blocks"), wrong.alias("wrong"), (c["token"] | _has_token(W.text(content)) | F.exists(blocks, lambda b: b["token"])).alias("token"))

    blocks = F.transform(F.coalesce(F.when(role != "system", W.items(content)), F.array().cast("array<variant>")), lambda b, k: _block(b, k, i, inputs))
    return let(F.struct(system.alias("system"), blocks.alias("blocks")), put)


def _blocks_history(messages: Column, how: Conversion) -> Column:
    """The first error of the messages' order: an assistant's uses are all answered in the next user message, each once."""
    state, inner = "struct<i:int,open:array<string>,error:string>", "struct<k:int,open:array<string>,done:array<string>,called:boolean,error:string>"
    listed = lambda ids: F.array_join(F.array_sort(ids), ", ")
    unanswered = lambda i, ids, between=" ": said("messages.", i, f":{between}`tool_use` ids were found without `tool_result` blocks immediately after: ", listed(ids), UNANSWERED)
    still_open = lambda i, ids: F.when(F.size(ids) > 0, unanswered(i, ids))
    only = lambda i, kind, role: said("messages.", i, f": `{kind}` blocks can only be in `{role}` messages")

    def user(s: Column, i: Column, b: Column) -> Column:
        result = b["kind"] == "tool_result"
        at = said("messages.", i, ".content.", s["k"])
        error = (
            F.when(b["kind"].isin(*_SPOKEN), first(still_open(i, s["open"]), b["bad"]))
            .when(result, first(
                fail(F.array_contains(s["done"], b["id"]), at, ": each tool_use must have a single result. Found multiple `tool_result` blocks with id: ", b["id"]),
                fail(~F.array_contains(s["open"], b["id"]), "unexpected `", at, ": tool_use_id` found in `tool_result` blocks: ", b["id"], ". Each `tool_result` block must have a corresponding `tool_use` block in the previous message."), b["bad"],
            ))
            .when(b["kind"] == "thinking", said("messages.", i, ".content: thinking blocks may only be in `assistant` messages"))
            .when(b["kind"] == "tool_use", only(i, "tool_use", "assistant")).when(b["kind"] == "server_tool_use", only(i, "server_tool_use", "assistant"))
            .when(b["kind"] == "web_search_tool_result", only(i, "web_search_tool_result", "assistant")).otherwise(BAD_BLOCK)
        )
        return F.struct((s["k"] + 1).alias("k"), F.when(result, F.array_remove(s["open"], b["id"])).otherwise(s["open"]).alias("open"), F.when(result, F.array_append(s["done"], b["id"])).otherwise(s["done"]).alias("done"), s["called"].alias("called"), F.coalesce(s["error"], error).alias("error")).cast(inner)

    def assistant(s: Column, i: Column, b: Column) -> Column:
        use = b["kind"] == "tool_use"
        error = (
            F.when(b["kind"].isin(*_SPOKEN), first(F.when(s["called"], said("messages.", i, ".", s["k"], ": `tool_use` ids were found without `tool_result` blocks immediately after: ", listed(s["open"]), UNANSWERED)), b["bad"], F.when(b["kind"] == "image", "Image in assistant message is unsupported")))
            .when(use, first(fail(b["arguments"].isNull(), BAD_INPUT), fail(F.array_contains(s["open"], b["id"]), "messages.", i, ".content.", s["k"], ": `tool_use` ids must be unique")))
            .when(b["kind"] == "tool_result", only(i, "tool_result", "user"))
            .when(b["kind"].isin("server_tool_use", "web_search_tool_result"), F.lit("Unsupported content block: server tools are not supported" if how.messages_web_search == "reject" else None).cast("string"))
            .when(b["kind"] != "thinking", BAD_BLOCK)
        )
        return F.struct((s["k"] + 1).alias("k"), F.when(use, F.array_append(s["open"], b["id"])).otherwise(s["open"]).alias("open"), s["done"].alias("done"), (s["called"] | use).alias("called"), F.coalesce(s["error"], error).alias("error")).cast(inner)

    def step(s: Column, m: Column) -> Column:
        i, text = s["i"], m["plain"].isNotNull()
        begin = F.struct(F.lit(0).alias("k"), s["open"].alias("open"), _empty("string").alias("done"), F.lit(False).alias("called"), _none("string").alias("error")).cast(inner)
        speaks = F.when(m["role"] == "user", F.aggregate(m["blocks"], begin, lambda a, b: user(a, i, b))).otherwise(F.aggregate(m["blocks"], begin, lambda a, b: assistant(a, i, b)))
        nothing = fail(~text & (F.size(m["blocks"]) == 0), "messages.", i, ": all messages must have non-empty content")

        def after(a: Column) -> Column:
            error = (
                F.when(m["role"] == "system", first(still_open(i, s["open"]), m["system"]["bad"]))
                .when(text, still_open(i, s["open"]))
                .when(m["role"] == "user", first(nothing, a["error"], F.when(F.size(a["open"]) > 0, unanswered(i - 1, a["open"], ""))))
                .otherwise(first(still_open(i, s["open"]), nothing, a["error"]))
            )
            return F.struct((i + 1).alias("i"), F.when(text | (m["role"] == "system"), s["open"]).otherwise(a["open"]).alias("open"), F.coalesce(s["error"], error).alias("error")).cast(state)

        return let(speaks, after)

    start = F.struct(F.lit(0).alias("i"), _empty("string").alias("open"), _none("string").alias("error")).cast(state)
    return F.aggregate(messages, start, step, lambda s: first(s["error"], F.when(F.size(s["open"]) > 0, unanswered(s["i"] - 1, s["open"], ""))))


def _blocks_messages(m: Column) -> Column:
    """The conversation's messages that one message stands for."""
    blocks = m["blocks"]
    texts = lambda kinds, name: F.transform(F.filter(blocks, lambda b: b["kind"].isin(*kinds)), lambda b: b[name])
    calls = F.transform(F.filter(blocks, lambda b: b["kind"] == "tool_use"), lambda b: F.struct(b["id"].alias("id"), b["name"].alias("name"), b["arguments"].alias("arguments")).cast(CALL))
    join = lambda parts: F.aggregate(parts, F.lit(""), lambda a, x: F.when(a == "", x).otherwise(F.concat(a, F.lit("\n\n"), x)))
    thoughts = texts(["thinking"], "thinking")
    thought = F.when(F.size(thoughts) > 0, F.array_join(thoughts, "\n\n"))
    apart = F.transform(blocks, lambda b: F.when(b["kind"] == "tool_result", _message("tool", b["text"], b["images"], call_id=b["id"])).otherwise(_message("user", b["text"], b["images"])))
    return (
        F.when(m["role"] == "system", F.array(_message("user", said("<system-reminder>\n", m["system"]["text"], "\n</system-reminder>"), m["system"]["images"])))
        .when(m["plain"].isNotNull(), F.array(_message(m["role"], m["plain"])))
        .when(m["role"] == "user", apart)
        .otherwise(F.array(_message("assistant", join(texts(_SPOKEN, "text")), None, thought, calls)))
    )


def _content_blocks(v: Column, given: Column, how: Conversion) -> Column:
    protocol = "messages"
    asked, thinking_wrong = _thinking(v)
    level, effort_wrong = _effort(protocol, child(child(v, "output_config"), "effort"))
    on = F.coalesce(asked, F.when(level.isNotNull(), True), F.lit(how.default_thinking))
    stops, choice, system, control = (child(v, k) for k in ("stop_sequences", "tool_choice", "system", "thinking"))
    tools = F.coalesce(W.items(child(v, "tools")), F.array().cast("array<variant>"))
    mode, wanted = W.text(child(choice, "type")), W.text(child(choice, "name"))
    name = lambda t: _text_or(W.text(child(t, "name")))
    server = lambda t: ~W.absent(child(t, "type"))
    dropped = lambda t: F.lit(how.messages_web_search == "ignore") & F.coalesce(W.text(child(t, "type")).startswith("web_search"), F.lit(False))
    tool_wrong = lambda t: first(fail(~W.is_object(t), "invalid type: expected an object in `tools`"), W.need_text(child(t, "name"), "name", True), W.need_text(child(t, "description"), "description"), W.need_text(child(t, "type"), "type"))
    text_generic = "data did not match any variant of untagged enum MessagesTextOrTextBlocks"
    schema = lambda k: F.get(F.get(given["schemas"], k), F.lit(0))
    kept = F.filter(F.transform(tools, lambda t, k: F.struct(_tool(name(t), W.text(child(t, "description")), _parameters(schema(k))).alias("tool"), dropped(t).alias("gone"))), lambda t: ~t["gone"])
    every = F.transform(kept, lambda t: t["tool"])
    names = F.transform(F.filter(tools, lambda t: ~dropped(t)), name)
    check = lambda t, k: F.when(~dropped(t), first(
        fail(server(t), "tools.", k, ": server tools are not supported"), _name_error(name(t), said("tools.", k, ".name")), fail(F.array_position(F.transform(F.filter(F.slice(tools, 1, F.greatest(k, F.lit(0))), lambda x: ~dropped(x)), name), name(t)) > 0, UNIQUE),
        fail(schema(k)["fault"].isin("missing", "null"), "tools.", k, ": missing input_schema"), _schema_error(schema(k), said("tools.", k, ".input_schema"), False),
    ))
    off, by_name = _text_or(mode) == "none", (_text_or(mode) == "tool") & ~F.coalesce(F.array_contains(F.transform(F.filter(tools, dropped), name), wanted), F.lit(False))

    def chosen(d: Column) -> Column:
        s = d["system"]
        made = F.when(off, _empty(TOOL)).when(by_name, F.filter(every, lambda t: t["name"] == wanted)).otherwise(every)
        head = F.when(~W.absent(system), F.array(_message("system", s["text"]))).otherwise(_empty(MESSAGE))
        messages = F.concat(head, F.flatten(F.transform(d["messages"], _blocks_messages)))
        return F.struct(d["messages"].alias("messages"), s.alias("system"), made.alias("made"), messages.alias("out"))

    def put(d: Column) -> Column:
        s = d["system"]
        wrong = first(
            W.need_text(child(v, "model"), "model", True), fail(child(v, "messages").isNull(), "missing field `messages`"), fail(W.items(child(v, "messages")).isNull(), "invalid type: expected a sequence"), _sampling_wrong(v, "max_tokens"),
            _strings_wrong(stops, "stop_sequences"), W.need_object(child(v, "output_config"), "output_config"), effort_wrong, thinking_wrong, W.need_items(child(v, "tools"), "tools"), first_of(tools, tool_wrong),
            F.when(~W.absent(choice), first(W.need_object(choice, "tool_choice"), W.need_text(child(choice, "type"), "type", True), W.one_of(mode, ("auto", "any", "tool", "none")), W.need_text(child(choice, "name"), "name"), W.need_flag(child(choice, "disable_parallel_tool_use"), "disable_parallel_tool_use"), fail((mode == "tool") & wanted.isNull(), "missing field `name`"))),
            F.when(~W.absent(system), s["wrong"]), first_of(d["messages"], lambda m: m["wrong"]),
        )
        made, messages = d["made"], d["out"]
        listed = F.coalesce(_strings(stops), _empty("string"))
        bad = first(
            _sampling_bad(v, "max_tokens"), fail((F.size(listed) > MAX_STOPS) | F.exists(listed, lambda x: x == ""), "stop_sequences must contain at most 16 non-empty strings"), first_of(F.transform(tools, check), lambda e: e),
            F.when(by_name, first(fail(~F.array_contains(names, wanted), "tool_choice: no tool named '", wanted, "' was specified"), fail(on, NO_THINKING))), fail(F.size(d["messages"]) == 0, "messages: at least one message is required"),
            F.when(F.exists(d["messages"], lambda m: m["token"]) | s["token"], TOKEN), F.when(~W.absent(system), _textual(s, "system")), _blocks_history(d["messages"], how), _tool_token(made, messages),
        )
        more = {
            "messages": messages, "tools": made, "tool_choice": F.when(off, "none").when(by_name, "required").otherwise("auto"), "stops": listed, "response_format": F.lit("text"), "json_output": F.lit(False), "parse_tools": F.size(made) > 0, "tools_first": by_name,
            "thinking_budget": W.whole(child(control, "budget_tokens")).cast("decimal(20,0)"), "disable_parallel_tool_use": F.when(mode.isin("auto", "any", "tool"), W.flag(child(choice, "disable_parallel_tool_use"))),
        }
        return _row(first(wrong, bad), **(_common(v, "max_tokens", on, level) | more))

    decoded = F.transform(F.coalesce(W.items(child(v, "messages")), F.array().cast("array<variant>")), lambda m, i: _blocks_message(m, i, given["inputs"]))
    return let(F.struct(decoded.alias("messages"), _content(system, _text_block, F.lit("system"), text_generic).alias("system")), lambda d: let(chosen(d), put))


# ---- responses

_SEARCH = ("web_search", "web_search_2025_08_26")


def _free_name(base: Column, taken: Column) -> Column:
    """The name itself, or with the first number that makes it differ from those taken."""
    tried = F.transform(F.sequence(F.lit(0), F.size(taken)), lambda k: F.when(k == 0, base).otherwise(said(base, "_", k)))
    return F.get(F.filter(tried, lambda x: ~F.array_contains(taken, x)), F.lit(0))


def _response_tools(tools: Column, schemas_: Column, how: Conversion) -> Column:
    """Tools in order, namespaces laid flat: defs (tool and its schema's error), names of top-level functions, the map from namespaced to flat names, the first error."""
    member = f"struct<tool:{TOOL},fault:string>"
    state = f"struct<i:int,defs:array<{member}>,top:array<string>,spaces:array<string>,flat:map<string,string>,error:string>"
    name = lambda t: W.text(child(t, "name"))
    kind = lambda t: W.text(child(t, "type"))
    top = F.transform(F.filter(tools, lambda t: kind(t) == "function"), lambda t: _text_or(name(t)))
    made = lambda t, title, description, schema: F.struct(_tool(title, description, _parameters(schema), W.flag(child(t, "strict"))).alias("tool"), schema["fault"].alias("fault")).cast(member)
    patch = F.struct(_tool(F.lit(patch_tool.NAME), F.lit(patch_tool.DESCRIPTION), F.lit(schemas.J.python_style(patch_tool.PARAMETERS))).alias("tool"), _none("string").alias("fault")).cast(member)

    def step(s: Column, t: Column) -> Column:
        path, members = said("tools[", s["i"], "]"), F.coalesce(W.items(child(t, "tools")), F.array().cast("array<variant>"))
        schema = lambda j: F.get(F.get(schemas_, s["i"]), j)
        inner_names = F.transform(members, lambda m: _text_or(name(m)))
        inner = first_of(F.transform(members, lambda m, j: first(
            fail(~F.coalesce(kind(m) == "function", F.lit(False)), path, ".tools[", j, "]: custom tools are not supported inside a namespace"), _name_error(_text_or(name(m)), said(path, ".tools[", j, "].name")),
            fail(F.array_position(inner_names, _text_or(name(m))) <= j, path, ".tools[", j, "]: tool names within a namespace must be unique"),
        )), lambda e: e)
        space = F.coalesce(kind(t) == "namespace", F.lit(False))
        prefix = _text_or(W.text(child(t, "description")))
        about = lambda m: F.when(prefix != "", F.concat(prefix, F.lit("\n"), _text_or(W.text(child(m, "description"))))).otherwise(W.text(child(m, "description")))
        flat_name = lambda m: said(_text_or(name(t)), "::", _text_or(name(m)))
        added = F.when(space, F.transform(members, lambda m, j: made(m, _free_name(flat_name(m), F.concat(s["top"], F.map_values(s["flat"]))), about(m), schema(j)))).when(kind(t) == "function", F.array(made(t, _text_or(name(t)), W.text(child(t, "description")), schema(F.lit(0))))).when(kind(t) == "custom", F.array(patch)).otherwise(_empty(member))
        error = (
            F.when(kind(t) == "function", _name_error(_text_or(name(t)), said(path, ".name")))
            .when(space, first(_name_error(_text_or(name(t)), said(path, ".name")), fail(F.array_contains(s["spaces"], _text_or(name(t))), path, ": duplicate namespace name '", name(t), "'"), inner))
            .when(kind(t) == "custom", fail(_text_or(name(t)) != patch_tool.NAME, "Unsupported custom tool: '", _text_or(name(t)), f"'. Only '{patch_tool.NAME}' is supported"))
            .when(kind(t).isin(*_SEARCH), F.lit(NO_SERVER if how.responses_web_search == "reject" else None).cast("string"))
        )

        def put(a: Column) -> Column:
            pairs = F.map_from_arrays(F.transform(members, flat_name), F.transform(a, lambda x: x["tool"]["name"]))
            fine = space & error.isNull() & s["error"].isNull()
            return F.struct(
                (s["i"] + 1).alias("i"), F.concat(s["defs"], a).alias("defs"), s["top"].alias("top"), F.when(space, F.array_append(s["spaces"], _text_or(name(t)))).otherwise(s["spaces"]).alias("spaces"),
                F.when(fine, F.map_concat(s["flat"], pairs)).otherwise(s["flat"]).alias("flat"), F.coalesce(s["error"], error).alias("error"),
            ).cast(state)

        return let(added, put)

    start = F.struct(F.lit(0).alias("i"), _empty(member).alias("defs"), top.alias("top"), _empty("string").alias("spaces"), F.create_map().cast("map<string,string>").alias("flat"), _none("string").alias("error")).cast(state)
    return F.aggregate(tools, start, step)


_KINDS = ("message", "function_call", "function_call_output", "reasoning", "custom_tool_call", "custom_tool_call_output")


def _item(x: Column, i: Column) -> Column:
    """An input item: kind (null for those that are passed over), role, content, thought, call, errors. An item without a type is a message."""
    typed = child(x, "type")
    kind = F.when(typed.isNull(), "message").otherwise(W.text(typed))
    message, output = kind == "message", kind.isin("function_call_output", "custom_tool_call_output")
    path = F.when(message, said("input[", i, "].content")).otherwise(said("input[", i, "].output"))
    said_ = _content(F.when(message, child(x, "content")), _item_block, path, "data did not match any variant of untagged enum ResponsesMessageContent")
    gave = _content(F.when(output, child(x, "output")), _output_block, path, "data did not match any variant of untagged enum ResponsesToolCallOutputContent")
    role, field = W.text(child(x, "role")), lambda name: W.text(child(x, name))
    thoughts = child(x, "content")
    need = lambda kinds, name: F.when(kind.isin(*kinds), W.need_text(child(x, name), name, True))

    def put(s: Column) -> Column:
        c = F.when(message, s["said"]).otherwise(s["gave"])
        wrong = first(
            fail(~W.is_object(x), "invalid type: expected a Responses input item object"), fail(typed.isNotNull() & W.text(typed).isNull(), "invalid type: expected a string for the type field"),
            F.when(message, first(W.need_text(child(x, "role"), "role", True), W.one_of(role, ("user", "assistant", "system", "developer")), fail(child(x, "content").isNull(), "missing field `content`"), c["wrong"])),
            need(["function_call"], "arguments"), need(["custom_tool_call"], "input"), need(["function_call", "function_call_output", "custom_tool_call", "custom_tool_call_output"], "call_id"), need(["function_call", "custom_tool_call"], "name"),
            F.when(kind == "function_call", W.need_text(child(x, "namespace"), "namespace")), fail((kind == "function_call_output") & W.absent(child(x, "output")), "missing field `output`"), F.when(output, c["wrong"]),
            F.when(kind == "reasoning", first(W.need_items(thoughts, "content"), first_of(W.items(thoughts), lambda b: first(fail(~W.is_object(b), "expected an object in `content`"), W.need_text(child(b, "text"), "text", True))))),
        )
        thought = F.when(kind == "reasoning", F.array_join(F.transform(W.items(thoughts), lambda b: W.text(child(b, "text"))), "\n"))
        arguments = F.when(kind == "function_call", field("arguments")).when(kind == "custom_tool_call", F.concat(F.lit('{"input":'), W.json_string(field("input")), F.lit("}")))
        return F.struct(
            F.when(kind.isin(*_KINDS), kind).alias("kind"), F.when(role == "developer", "user").otherwise(role).alias("role"), c.alias("content"), _text_or(thought).alias("thought"), F.when(kind.isin("function_call", "custom_tool_call"), field("name")).alias("name"),
            F.when(kind == "function_call", field("namespace")).alias("namespace"), field("call_id").alias("call_id"), arguments.alias("arguments"), wrong.alias("wrong"), (c["token"] | _has_token(thought)).alias("token"),
        )

    return let(F.struct(said_.alias("said"), gave.alias("gave")), put)


def _item_history(items: Column, head: Column, tools: Column) -> Column:
    """Items to messages. Calls gather until each has its output; then they join the assistant before them, by id. The
    state keeps the calls without an output in their order, the ids that have one, and names given to namespaces of the past."""
    state = f"struct<i:int,messages:array<{MESSAGE}>,pending:array<string>,resolved:array<string>,calls:array<{CALL}>,results:array<{MESSAGE}>,names:map<string,string>,error:string>"

    def flushed(messages: Column, calls: Column, results: Column) -> Column:
        by_id = F.array_sort(calls)
        last = F.get(messages, F.size(messages) - 1)
        joins = F.coalesce(last["role"] == "assistant", F.lit(False))
        with_calls = F.when(joins, last.withField("calls", F.concat(last["calls"], by_id))).otherwise(_message("assistant", F.lit(""), calls=by_id))
        before = F.when(joins, F.slice(messages, F.lit(1), F.size(messages) - 1)).otherwise(messages)
        answers = F.flatten(F.transform(by_id, lambda c: F.filter(results, lambda r: r["tool_call_id"] == c["id"])))
        return F.concat(before, F.array(with_calls.cast(MESSAGE)), answers)

    def step(s: Column, x: Column) -> Column:
        kind, c, ms = x["kind"], x["content"], s["messages"]
        last = F.get(ms, F.size(ms) - 1)
        ours = F.coalesce(last["role"] == "assistant", F.lit(False))
        rest = F.slice(ms, F.lit(1), F.greatest(F.size(ms) - 1, F.lit(0)))
        waiting = fail(F.size(s["pending"]) > 0, "No tool output found for tool call ", F.get(s["pending"], F.lit(0)), ".")
        no_id = fail(x["call_id"] == "", "Invalid 'input[", s["i"], "].call_id': empty string. Expected a string with minimum length 1, but got an empty string instead.")
        known, done = F.array_contains(s["pending"], x["call_id"]), F.array_contains(s["resolved"], x["call_id"])
        call, output = kind.isin("function_call", "custom_tool_call"), kind.isin("function_call_output", "custom_tool_call_output")
        error = (
            F.when(kind == "message", first(waiting, F.when(x["role"] == "user", c["bad"]).when(x["role"] == "system", _textual(c, "system")).otherwise(_textual(c, "assistant"))))
            .when(kind == "reasoning", waiting)
            .when(call, first(no_id, fail(known | done, "Duplicate 'call_id': ", x["call_id"], ".")))
            .when(output, first(no_id, fail(~known & done, "Duplicate tool output for call_id: ", x["call_id"], "."), fail(~known, "No tool call found for tool output with call_id ", x["call_id"], "."), c["bad"]))
        )
        key = said(_text_or(x["namespace"]), "::", _text_or(x["name"]))
        given = F.coalesce(tools["flat"][key], s["names"][key], _free_name(key, F.concat(tools["top"], F.map_values(tools["flat"]), F.map_values(s["names"]))))
        name = F.when(x["namespace"].isNull(), x["name"]).otherwise(given)
        called = F.when(call, F.array_append(s["calls"], F.struct(x["call_id"].alias("id"), name.alias("name"), x["arguments"].alias("arguments")).cast(CALL))).otherwise(s["calls"])
        results = F.when(output, F.array_append(s["results"], _message("tool", c["text"], c["images"], call_id=x["call_id"]))).otherwise(s["results"])
        merged = last.withField("content", F.when(c["text"] == "", last["content"]).when(last["content"] == "", c["text"]).otherwise(F.concat(last["content"], F.lit("\n\n"), c["text"])))
        thinking = last.withField("reasoning_content", F.when(_text_or(last["reasoning_content"]) == "", x["thought"]).otherwise(F.concat(last["reasoning_content"], F.lit("\n"), x["thought"])))
        complete = output & (F.size(results) >= F.size(called))
        messages = (
            F.when(kind == "message", F.when(ours & (x["role"] == "assistant") & (F.size(last["calls"]) == 0), F.array_append(rest, merged.cast(MESSAGE))).otherwise(F.array_append(ms, _message(x["role"], c["text"], c["images"]))))
            .when((kind == "reasoning") & (x["thought"] != ""), F.when(ours & (last["content"] == ""), F.array_append(rest, thinking.cast(MESSAGE))).otherwise(F.array_append(ms, _message("assistant", F.lit(""), None, x["thought"]))))
            .when(complete, flushed(ms, called, results))
            .otherwise(ms)
        )
        return F.struct(
            (s["i"] + 1).alias("i"), messages.alias("messages"), F.when(call, F.array_append(s["pending"], x["call_id"])).when(output, F.array_remove(s["pending"], x["call_id"])).otherwise(s["pending"]).alias("pending"),
            F.when(output, F.array_append(s["resolved"], x["call_id"])).otherwise(s["resolved"]).alias("resolved"), F.when(complete, _empty(CALL)).otherwise(called).alias("calls"), F.when(complete, _empty(MESSAGE)).otherwise(results).alias("results"),
            F.when(x["namespace"].isNotNull() & s["names"][key].isNull() & tools["flat"][key].isNull(), F.map_concat(s["names"], F.create_map(key, given))).otherwise(s["names"]).alias("names"), F.coalesce(s["error"], error).alias("error"),
        ).cast(state)

    def end(s: Column) -> Column:
        return F.struct(s["messages"].alias("messages"), first(s["error"], fail(F.size(s["pending"]) > 0, "No tool output found for tool call ", F.get(s["pending"], F.lit(0)), ".")).alias("error"))

    start = F.struct(
        F.lit(0).alias("i"), head.alias("messages"), _empty("string").alias("pending"), _empty("string").alias("resolved"), _empty(CALL).alias("calls"), _empty(MESSAGE).alias("results"), F.create_map().cast("map<string,string>").alias("names"), _none("string").alias("error"),
    ).cast(state)
    return F.aggregate(items, start, step, end)


def _responses(v: Column, given: Column, how: Conversion) -> Column:
    protocol = "responses"
    asked = child(child(v, "reasoning"), "effort")
    level, effort_wrong = _effort(protocol, asked)
    on = F.when(W.text(asked).isNotNull(), W.text(asked) != "none").otherwise(F.lit(how.default_thinking))
    source, instructions, choice, form = child(v, "input"), child(v, "instructions"), child(v, "tool_choice"), child(child(v, "text"), "format")
    spoken, order, mode = W.text(source), _text_or(W.text(instructions)), W.text(choice)
    tools = F.coalesce(W.items(child(v, "tools")), F.array().cast("array<variant>"))
    tool_wrong = lambda t: first(
        fail(~W.is_object(t), "invalid type: expected an object in `tools`"), W.need_text(child(t, "type"), "type", True),
        F.when(W.text(child(t, "type")).isin("function", "namespace", "custom"), first(W.need_text(child(t, "name"), "name", True), W.need_text(child(t, "description"), "description"), W.need_flag(child(t, "strict"), "strict"), F.when(W.text(child(t, "type")) == "namespace", first(
            fail(W.items(child(t, "tools")).isNull(), "missing field `tools`"), first_of(W.items(child(t, "tools")), lambda m: first(fail(~W.is_object(m), "expected an object in `tools`"), W.need_text(child(m, "type"), "type", True), W.need_text(child(m, "name"), "name"), W.need_text(child(m, "description"), "description"), W.need_flag(child(m, "strict"), "strict"))),
        )))),
    )
    generic = "data did not match any variant of untagged enum ResponsesInput"
    picked = F.when(mode.isNull(), W.text(child(choice, "type")))
    wanted = W.text(child(choice, "name"))
    refused = F.when(picked.isin(*_SEARCH), F.lit(NO_SERVER if how.responses_web_search == "reject" else None).cast("string"))
    none, by_name = _text_or(mode) == "none", F.coalesce(picked.isin("function", "custom"), F.lit(False))

    def chosen(d: Column) -> Column:
        converted, history = d["tools"], d["history"]
        defs = converted["defs"]
        every = F.when(none, _empty(TOOL)).otherwise(F.transform(defs, lambda t: t["tool"]))
        made = F.when(by_name, F.filter(every, lambda t: t["name"] == wanted)).otherwise(every)
        required = (F.size(every) > 0) & (by_name | (_text_or(mode) == "required"))
        messages = F.when(spoken.isNotNull(), F.array_append(d["head"], _message("user", spoken))).when(W.items(source).isNotNull(), history["messages"]).otherwise(d["head"])
        return F.struct(*(d[k].alias(k) for k in ("items", "tools", "head", "history")), made.alias("made"), messages.alias("out"), required.alias("required"))

    def put(d: Column) -> Column:
        converted, history = d["tools"], d["history"]
        wrong = first(
            fail(child(v, "model").isNull(), "missing field `model`"), _sampling_wrong(v, "max_output_tokens"), W.need_text(instructions, "instructions"), W.need_object(child(v, "reasoning"), "reasoning"), effort_wrong,
            fail(~W.absent(source) & spoken.isNull() & W.items(source).isNull(), generic), fail(F.exists(d["items"], lambda x: x["wrong"].isNotNull()), generic), W.need_items(child(v, "tools"), "tools"), first_of(tools, tool_wrong),
            F.when(mode.isNotNull(), W.one_of(mode, ("none", "auto", "required"))), F.when(~W.absent(choice) & mode.isNull(), first(W.need_object(choice, "tool_choice"), W.need_text(child(choice, "type"), "type", True), F.when(W.text(child(choice, "type")).isin("function", "custom"), W.need_text(child(choice, "name"), "name", True)))),
            W.need_object(child(v, "text"), "text"), W.need_object(form, "format"), W.need_text(child(form, "type"), "type"), W.one_of(W.text(child(form, "type")), ("text", "json_object", "json_schema", "")),
        )
        made, messages, required, defs = d["made"], d["out"], d["required"], converted["defs"]
        order_errors = _tools_in_order(F.transform(defs, lambda t: F.struct(t["tool"]["name"].alias("name"), _schema_error(F.struct(t["tool"]["parameters"].alias("text"), t["fault"].alias("fault")), said("Tool '", t["tool"]["name"], "' parameters")).alias("error"))))
        chosen_bad = first(refused, F.when(~none & (F.size(defs) > 0), first(order_errors, fail(by_name & (F.size(made) == 0), "tool_choice: no tool named '", wanted, "' was specified"), fail(required & on, NO_THINKING))))
        json = W.text(child(form, "type")) == "json_object"
        bad = first(
            F.when(_has_token(W.text(instructions)) | _has_token(spoken) | F.exists(d["items"], lambda x: x["token"]), TOKEN), _sampling_bad(v, "max_output_tokens"), converted["error"],
            fail(W.absent(source) & (order == ""), "Either input or instructions must be provided"), fail(F.size(W.items(source)) == 0, "Input items array must not be empty"), F.when(W.items(source).isNotNull(), history["error"]), chosen_bad, _tool_token(made, messages),
            F.when(json & ~_asks_json(messages), "Response input messages must contain the word 'json' to use text.format of type json_object"),
        )
        spaces = F.map_from_entries(F.transform(F.map_entries(converted["flat"]), lambda e: F.struct(e["value"].alias("key"), F.struct(F.substring_index(e["key"], "::", 1).alias("namespace"), F.substring_index(e["key"], "::", -1).alias("name")).alias("value"))))
        custom = F.array_distinct(F.transform(F.filter(tools, lambda t: W.text(child(t, "type")) == "custom"), lambda t: W.text(child(t, "name"))))
        more = {
            "messages": messages, "tools": made, "tool_choice": F.when(none, "none").when(required, "required").otherwise("auto"), "stops": _empty("string"), "response_format": F.when(json, "json_object").otherwise("text"), "json_output": F.coalesce(json, F.lit(False)),
            "parse_tools": F.size(made) > 0, "tools_first": required, "custom_tools": custom, "namespaces": spaces,
        }
        return _row(first(wrong, bad), **(_common(v, "max_output_tokens", on, level) | more))

    head = F.when(order != "", F.array(_message("system", order))).otherwise(_empty(MESSAGE))
    decoded = F.transform(F.coalesce(W.items(source), F.array().cast("array<variant>")), _item)
    listed = F.struct(decoded.alias("items"), _response_tools(tools, given["schemas"], how).alias("tools"), head.alias("head"))
    return let(listed, lambda d: let(F.struct(d["items"].alias("items"), d["tools"].alias("tools"), d["head"].alias("head"), _item_history(d["items"], d["head"], d["tools"]).alias("history")), lambda h: let(chosen(h), put)))


CONVERTERS = {"chat_completions": _chat, "messages": _content_blocks, "responses": _responses}


@functools.lru_cache(maxsize=16)
def _converted(protocol: str, how: Conversion, process: int) -> Column:  # noqa: ARG001
    """Over the columns _v and _given. Some thousand calls to the JVM make it, so it is made once a driver process."""
    return CONVERTERS[protocol](F.col("_v"), F.col("_given"), how)


def convert(requests: DataFrame, *keep: str, how: Conversion = Conversion(), protocols: Sequence[str] = tuple(CONVERTERS)) -> DataFrame:
    """A row for each request of (protocol, body); the columns named in `keep` come along. Naming the protocols that
    occur makes a smaller plan; others are refused as unknown."""
    spark = requests.sparkSession
    setting = "spark.sql.variant.allowDuplicateKeys"
    before = spark.conf.get(setting, "false")
    spark.conf.set(setting, "true")  # of repeated keys the last counts; read when the expression is made
    try:
        body = requests.select(*keep, "protocol", W.clean(F.coalesce("body", F.lit(""))).alias("_body")).withColumn("_v", W.parsed(F.col("_body")))
    finally:
        spark.conf.set(setting, before)
    has = lambda word: F.col("_v").isNotNull() & F.col("_body").contains(word)
    given = F.struct(schemas.tool_schemas(F.when(has('"tools"'), F.get_json_object("_body", "$.tools"))).alias("schemas"), schemas.tool_inputs(F.when(has('"tool_use"') & (F.col("protocol") == "messages"), F.get_json_object("_body", "$.messages"))).alias("inputs"))
    made = F.when(F.col("_v").isNull() | ~W.is_object(F.col("_v")), _row(F.lit("malformed request: expected one JSON object")))
    for protocol in protocols:
        made = made.when(F.col("protocol") == protocol, _converted(protocol, how, id(spark.sparkContext._jvm)))
    made = made.otherwise(_row(said("unknown protocol: ", _text_or(F.col("protocol")))))
    return body.withColumn("_given", given).select(*keep, "protocol", made.alias("_c")).select(*keep, "protocol", "_c.*")
