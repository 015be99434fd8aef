"""Tool parameters: JSON Schema checked by its structure, and written out in Python style with their key order."""

from __future__ import annotations

import re
from typing import Any

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as S

from . import jsontext as J

#: Fixed values of the schema language: what its keywords hold.
TYPES = ("array", "boolean", "integer", "null", "number", "object", "string")
ONE = ("additionalProperties", "contains", "contentSchema", "else", "if", "items", "not", "propertyNames", "then", "unevaluatedItems", "unevaluatedProperties")
MANY = ("allOf", "anyOf", "oneOf", "prefixItems")
NAMED = ("$defs", "definitions", "dependentSchemas", "patternProperties", "properties")
COUNTS = ("maxContains", "maxItems", "maxLength", "maxProperties", "minContains", "minItems", "minLength", "minProperties")
NUMBERS = ("exclusiveMaximum", "exclusiveMinimum", "maximum", "minimum")
TEXTS = ("$anchor", "$comment", "$dynamicAnchor", "$dynamicRef", "$id", "$ref", "$schema", "contentEncoding", "contentMediaType", "description", "format", "pattern", "title")
FLAGS = ("deprecated", "readOnly", "uniqueItems", "writeOnly")


def _number(v: Any) -> bool:
    return isinstance(v, (int, float)) and not isinstance(v, bool)


def _found(root: Any, ref: str) -> Any:
    """What a local reference points to; KeyError if there is nothing."""
    if ref == "#":
        return root
    if not ref.startswith("#/"):
        for node in _nodes(root):
            if isinstance(node, dict) and f"#{node.get('$anchor')}" == ref:
                return node
        raise KeyError(ref)
    at = root
    for part in ref[2:].split("/"):
        part = part.replace("~1", "/").replace("~0", "~")
        if isinstance(at, list) and part.isdigit() and int(part) < len(at):
            at = at[int(part)]
        elif isinstance(at, dict) and part in at:
            at = at[part]
        else:
            raise KeyError(ref)
    return at


def _nodes(value: Any):  # noqa: ANN202
    stack = [value]
    while stack:
        at = stack.pop()
        yield at
        stack.extend(at.values() if isinstance(at, dict) else at if isinstance(at, list) else ())


def fault(schema: Any) -> str | None:
    """What keeps a schema from being one; references go within it only, and never round without a step into an instance."""
    stack, seen = [(schema, "")], set()
    while stack:
        at, path = stack.pop()
        if isinstance(at, bool):
            continue
        if not isinstance(at, dict):
            return f"{path or '/'}: expected an object or a boolean"
        if id(at) in seen:
            continue
        seen.add(id(at))
        for key, v in at.items():
            here = f"{path}/{key}"
            if key in ONE and not (key == "items" and isinstance(v, list)):
                stack.append((v, here))
            elif key in MANY or key == "items":
                if not isinstance(v, list) or not v and key != "items":
                    return f"{here}: expected a list of schemas"
                stack.extend((x, f"{here}/{i}") for i, x in enumerate(v))
            elif key in NAMED:
                if not isinstance(v, dict):
                    return f"{here}: expected an object of schemas"
                stack.extend((x, f"{here}/{name}") for name, x in v.items())
                bad = [name for name in v if key == "patternProperties" and not _pattern(name)]
                if bad:
                    return f"{here}: invalid pattern `{bad[0]}`"
            elif key == "type":
                names = v if isinstance(v, list) else [v]
                if not names or any(not isinstance(x, str) or x not in TYPES for x in names) or len(set(names)) < len(names):
                    return f"{here}: expected one of {', '.join(TYPES)}, or a list of different ones"
            elif key == "enum" and not isinstance(v, list):
                return f"{here}: expected a list"
            elif key == "required" and (not isinstance(v, list) or any(not isinstance(x, str) for x in v) or len(set(v)) < len(v)):
                return f"{here}: expected a list of different strings"
            elif key == "dependentRequired" and (not isinstance(v, dict) or any(not isinstance(x, list) or any(not isinstance(y, str) for y in x) for x in v.values())):
                return f"{here}: expected an object of lists of strings"
            elif key in COUNTS and (not _number(v) or v < 0 or v != int(v)):
                return f"{here}: expected a whole number from 0 on"
            elif key in NUMBERS and not _number(v):
                return f"{here}: expected a number"
            elif key == "multipleOf" and (not _number(v) or v <= 0):
                return f"{here}: expected a number above 0"
            elif key in FLAGS and not isinstance(v, bool):
                return f"{here}: expected a boolean"
            elif key in TEXTS and not isinstance(v, str):
                return f"{here}: expected a string"
            elif key == "pattern" and not _pattern(v):
                return f"{here}: invalid pattern `{v}`"
            if key == "$ref":
                try:
                    stack.append((_found(schema, v), f"{here}({v})"))
                except KeyError:
                    return f"{here}: cannot resolve `{v}`"
    return _circle(schema)


def _pattern(p: str) -> bool:
    try:
        re.compile(p)
    except re.error:
        return False
    return True


def _circle(root: Any) -> str | None:
    """References that lead back to themselves through nothing but references would never end."""
    for node in _nodes(root):
        at, passed = node, []
        while isinstance(at, dict) and isinstance(at.get("$ref"), str):
            if any(at is x for x in passed):
                return f"/$ref: `{at['$ref']}` leads back to itself"
            passed.append(at)
            try:
                at = _found(root, at["$ref"])
            except KeyError:
                break
    return None


SCHEMA = S.StructType([S.StructField("text", S.StringType()), S.StructField("fault", S.StringType())])


def _schema(parameters: Any, given: bool) -> tuple[str | None, str | None]:
    """Python-style text, and what is wrong: `missing`, `null`, `object` or the fault."""
    if parameters is None:
        return None, "null" if given else "missing"
    text = J.python_style(parameters)
    if not isinstance(parameters, dict) or parameters.get("type") != "object":
        return text, "object"
    return text, fault(parameters)


def _of_tool(tool: Any) -> list[tuple[str | None, str | None]]:
    if not isinstance(tool, dict):
        return []
    if isinstance(tool.get("tools"), list):
        return [x for t in tool["tools"] for x in (_of_tool(t) or [(None, "missing")])]
    holder = tool["function"] if isinstance(tool.get("function"), dict) else tool
    key = "input_schema" if "input_schema" in holder else "parameters"
    return [_schema(holder.get(key), key in holder)]


@F.pandas_udf(S.ArrayType(S.ArrayType(SCHEMA)))
def tool_schemas(tools: pd.Series) -> pd.Series:
    """For each tool of a request's `tools` (JSON text): its parameters, or those of its members."""

    def of(text: str | None) -> list | None:
        if text is None:
            return None
        try:
            listed = J.parse(text)
        except (ValueError, RecursionError) as e:
            return [[(None, f"invalid JSON Schema: {e}")]]
        return [_of_tool(t) for t in listed] if isinstance(listed, list) else []

    return tools.map(of)


@F.pandas_udf(S.ArrayType(S.ArrayType(S.StringType())))
def tool_inputs(messages: pd.Series) -> pd.Series:
    """The inputs of `tool_use` blocks in Python style, by message and block of a request's `messages` (JSON text)."""

    def one(block: Any) -> str | None:
        return J.python_style(block["input"]) if isinstance(block, dict) and block.get("type") == "tool_use" and "input" in block else None

    def of(text: str | None) -> list | None:
        if text is None:
            return None
        try:
            listed = J.parse(text)
        except (ValueError, RecursionError):
            return None
        contents = [m.get("content") if isinstance(m, dict) else None for m in (listed if isinstance(listed, list) else [])]
        return [[one(b) for b in c] if isinstance(c, list) else [] for c in contents]

    return messages.map(of)
