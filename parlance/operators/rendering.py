"""Prompt rendering: normalized messages to one prompt a conversation, native.

Messages: conv_id, idx, role (system, user, assistant, tool, latest_reminder), content, reasoning_content, tool_calls
(already rendered text, or null), call_ids (of an assistant), tool_call_id, images (sources in the order of their
placeholders). One exchange on conv_id serves all windows and aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import tokens as T

COLUMNS = {"reasoning_content": "string", "tool_calls": "string", "call_ids": "array<string>", "tool_call_id": "string", "images": "array<struct<kind:string,url:string,detail:string>>"}


def messages(df: DataFrame) -> DataFrame:
    """The columns a message has, missing ones as nulls."""
    extra = [F.lit(None).cast(t).alias(c) for c, t in COLUMNS.items() if c not in df.columns]
    return df.select("conv_id", "idx", "role", F.coalesce("content", F.lit("")).alias("content"), *(c for c in COLUMNS if c in df.columns), *extra)


def _by_conv(*, upto: bool = False) -> Window:
    w = Window.partitionBy("conv_id").orderBy("idx")
    return w.rowsBetween(Window.unboundedPreceding, -1) if upto else w


def merge_runs(df: DataFrame, role: str = "user", separator: str = "\n\n") -> DataFrame:
    """Runs of messages of a role become one, contents joined."""
    w = Window.partitionBy("conv_id").orderBy("idx")
    starts = (F.col("role") != role) | F.coalesce(F.lag("role").over(w) != role, F.lit(True))
    run = df.withColumn("_run", F.sum(starts.cast("int")).over(w))
    first = lambda c: F.min_by(c, "idx").alias(c)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "content"))), lambda x: x["content"]), separator)
    shown = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("idx", "images"))), lambda x: F.coalesce(x["images"], F.array().cast(COLUMNS["images"]))))
    return run.groupBy("conv_id", "_run").agg(F.min("idx").alias("idx"), first("role"), text.alias("content"), *(shown.alias(c) if c == "images" else first(c) for c in COLUMNS)).drop("_run")


def normalize_systems(df: DataFrame) -> DataFrame:
    """Without late system messages: leading ones become one (joined by a blank line where both have text), later ones user
    messages, empty later ones go."""
    leading = ~F.coalesce(F.max(F.col("role") != "system").over(_by_conv(upto=True)), F.lit(False)) & (F.col("role") == "system")
    df = df.withColumn("_lead", leading)
    late = (F.col("role") == "system") & ~F.col("_lead")
    df = df.withColumn("_late", late).filter(~F.col("_late") | (F.col("content") != ""))
    df = df.withColumn("role", F.when(F.col("_late"), "user").otherwise(F.col("role"))).drop("_late")
    lead = Window.partitionBy("conv_id", "_lead")
    parts = F.filter(F.transform(F.array_sort(F.collect_list(F.struct("idx", "content")).over(lead)), lambda x: x["content"]), lambda x: x != "")
    df = df.withColumn("content", F.when(F.col("_lead"), F.array_join(parts, "\n\n")).otherwise(F.col("content")))
    df = df.withColumn("_first", F.min("idx").over(lead))
    return df.filter(~F.col("_lead") | (F.col("idx") == F.col("_first"))).drop("_lead", "_first")


def order_tool_results(df: DataFrame) -> DataFrame:
    """In each run of user and tool messages, tool results stand in the order of the latest calls; unknown ids rank first,
    equal ranks keep their order, user messages keep their places."""
    w = Window.partitionBy("conv_id").orderBy("idx")
    df = df.withColumn("_calls", F.last(F.when(F.size("call_ids") > 0, F.col("call_ids")), ignorenulls=True).over(w))
    inside = F.col("role").isin("user", "tool")
    df = df.withColumn("_run", F.sum((~inside).cast("int")).over(w)).withColumn("_tool", F.col("role") == "tool")
    rank = F.greatest(F.coalesce(F.array_position("_calls", F.col("tool_call_id")), F.lit(0)) - 1, F.lit(0))
    df = df.withColumn("_rank", F.when(F.col("_tool"), rank))
    rest = [c for c in df.columns if c not in ("conv_id", "idx", "_run", "_tool", "_rank", "_calls")]
    ranked = F.array_sort(F.collect_list(F.struct(F.coalesce("_rank", F.lit(0)).alias("_rank"), "idx", F.struct(*rest).alias("m"))))
    runs = df.groupBy("conv_id", "_run", "_tool").agg(F.array_sort(F.collect_list("idx")).alias("slots"), ranked.alias("rows"))
    placed = F.transform("rows", lambda x, i: F.struct(F.get("slots", i).alias("idx"), x["m"].alias("m")))  # the k-th by rank takes the k-th place
    return runs.select("conv_id", F.explode(placed).alias("x")).select("conv_id", "x.idx", "x.m.*")


def with_head(df: DataFrame, version: T.Version, tool_schemas: Column | None = None, json_format: bool = False) -> DataFrame:
    """The first system message with tool prompt and JSON format behind it; an empty one is put first where there is none."""
    if tool_schemas is None and not json_format:
        return df
    first = F.col("idx") == F.min("idx").over(Window.partitionBy("conv_id"))
    more = F.concat(*([F.concat(F.lit("\n\n" + version.tool_prompt("\0").split("\0")[0]), tool_schemas, F.lit(T.TOOLS_TAIL))] if tool_schemas is not None else []), F.lit(T.JSON_FORMAT if json_format else ""))
    heads = df.groupBy("conv_id").agg(F.min("idx").alias("idx"), F.min_by("role", "idx").alias("_r")).filter("_r <> 'system'")
    made = heads.select("conv_id", (F.col("idx") - 1).alias("idx"), F.lit("system").alias("role"), F.lit("").alias("content"), *(F.lit(None).cast(t).alias(c) for c, t in COLUMNS.items()))
    both = df.unionByName(made)
    return both.withColumn("content", F.when(first, F.concat("content", more)).otherwise(F.col("content")))


def normalize(df: DataFrame, version: T.Version) -> DataFrame:
    df = df if version.late_system else normalize_systems(df)
    return order_tool_results(merge_runs(df))


def render(df: DataFrame, version: T.Version = T.V41, thinking: bool = False, effort: str | None = None, required: bool = False, tool_schemas: Column | None = None, json_format: bool = False) -> DataFrame:
    """(conv_id, prompt), and the images of user and tool messages in prompt order where `df` has images."""
    shown = "images" in df.columns
    df = with_head(normalize(messages(df), version), version, tool_schemas, json_format)
    w = Window.partitionBy("conv_id").orderBy("idx")
    df = df.withColumn("_i", F.row_number().over(w) - 1).withColumn("_before", F.lag("role").over(w))
    is_, head = lambda r: F.col("role") == r, F.col("_i") == 0
    prefix = version.effort_text(effort) if thinking else ""
    begin = F.when(head, F.when(is_("system") | F.lit(prefix != ""), version.system + prefix).otherwise(prefix)).otherwise("")
    turn = F.when(F.col("_before").isin("user", "tool"), "\n\n").otherwise(T.USER)
    thought = F.when(F.lit(thinking) & ~head, F.concat(F.lit(T.THINK), F.coalesce("reasoning_content", F.lit("")), F.lit(T.END_THINK))).otherwise(T.END_THINK)
    calls = F.coalesce(F.concat(F.lit("\n\n"), "tool_calls"), F.lit(""))
    body = (
        F.when(is_("system"), F.concat(F.when(~head & F.lit(version.late_system), version.system).otherwise(""), "content"))
        .when(is_("user"), F.concat(turn, "content"))
        .when(is_("latest_reminder"), F.concat(F.lit(T.LATEST_REMINDER), "content"))
        .when(is_("tool"), F.concat(turn, F.lit("<tool_result>"), "content", F.lit("</tool_result>")))
        .otherwise(F.concat(F.lit(T.ASSISTANT), thought, "content", calls, F.lit(T.EOS)))
    )
    tail = T.ASSISTANT + (T.THINK if thinking else T.END_THINK) + (f"\n\n<{T.DSML}{version.block}>\n" if required else "")
    own = F.when(F.col("role").isin("user", "tool"), F.col("images"))
    parts = F.array_sort(F.collect_list(F.struct("_i", F.concat(begin, body).alias("t"), *([own.alias("images")] if shown else []))))
    prompt = F.concat(F.lit(T.BOS), F.array_join(F.transform("parts", lambda x: x["t"]), ""), F.lit(tail)).alias("prompt")
    listed = F.flatten(F.transform(F.filter("parts", lambda x: x["images"].isNotNull()), lambda x: x["images"])).alias("images")
    return df.groupBy("conv_id").agg(parts.alias("parts")).select("conv_id", prompt, *([listed] if shown else []))


def segments(prompt: Column) -> Column:
    """A prompt as (marker or plain, text) in order."""
    marker = "|".join(rf"\Q{m}\E" for m in (T.BOS, T.EOS, T.SYSTEM, T.USER, T.ASSISTANT, T.LATEST_REMINDER, T.IMAGE, T.THINK, T.END_THINK)) + rf"|</?\Q{T.DSML}\E[^>]*>"
    found = F.regexp_extract_all(prompt, F.lit(rf"{marker}|(?:(?!{marker})[\s\S])+"), F.lit(0))
    return F.transform(found, lambda x: F.struct(F.rlike(x, F.lit(rf"\A(?:{marker})\z")).alias("marker"), x.alias("text")))
