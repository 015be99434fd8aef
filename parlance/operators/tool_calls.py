"""Tool definitions and calls as prompt text; calls and results matched."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import jsontext as J
from ..functions import tokens as T


def call_text(version: T.Version, name: str, arguments: str) -> str:
    """One call; arguments that aren't a JSON object become the one string parameter `arguments`."""
    try:
        value = J.parse(arguments)
    except (ValueError, RecursionError):
        value = None
    value = value if isinstance(value, dict) else {"arguments": arguments}
    tag = T.DSML + version.parameter
    body = "\n".join(f'<{tag} name="{k}" string="{str(isinstance(v, str)).lower()}">{v if isinstance(v, str) else J.python_style(v)}</{tag}>' for k, v in value.items())
    tag = T.DSML + version.call
    return f'<{tag} name="{name}">\n{body}\n</{tag}>'


def calls_text(version: T.Version, calls: list[tuple[str, str]]) -> str | None:
    if not calls:
        return None
    tag = T.DSML + version.block
    return f"<{tag}>\n" + "\n".join(call_text(version, n, a) for n, a in calls) + f"\n</{tag}>"


def render_calls(version: T.Version, calls: Column) -> Column:
    """array<struct<name, arguments>> to text, null if empty."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: None if x is None else calls_text(version, [(c["name"], c["arguments"]) for c in x]))

    return run(calls)


def tool_schema(name: str, description: str | None, parameters: str) -> str:
    return J.python_style({"name": name, "description": description or "", "parameters": J.parse(parameters)})


def render_schemas(tools: Column) -> Column:
    """array<struct<name, description, parameters>> to the newline-joined schemas of the tool prompt."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: "\n".join(tool_schema(t["name"], t["description"], t["parameters"]) for t in (x if x is not None else [])))

    return run(tools)


def unresolved(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Calls without a result, as (conv_id, ids): sorted, joined by commas."""
    left = calls.join(results.select("conv_id", "id").distinct(), ["conv_id", "id"], "left_anti")
    return left.groupBy("conv_id").agg(F.array_join(F.array_sort(F.collect_set("id")), ", ").alias("ids"))


def duplicates(calls: DataFrame) -> DataFrame:
    return calls.groupBy("conv_id", "id").agg(F.count("*").alias("n")).filter("n > 1")
