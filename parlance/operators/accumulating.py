"""Events of the responses dialect to output items, natively: a fold by stream, then by item.

All windows and the last aggregate share one exchange by stream_id. Streams may break off anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_ITEM = "struct<id:string,type:string,status:string,call_id:string,name:string,namespace:string,arguments:string,input:string,content:array<struct<type:string,text:string>>>"
_EVENT = f"struct<type:string,output_index:bigint,item_id:string,content_index:bigint,delta:string,text:string,arguments:string,input:string,part:struct<type:string,text:string>,item:{_ITEM},response:struct<status:string,output:array<{_ITEM}>>>"
_OWN = {"message": "output_text", "reasoning": "reasoning_text", "function_call": "function_call_arguments", "custom_tool_call": "custom_tool_call_input"}


def _text_of(item: Column) -> Column:
    return F.coalesce(item["arguments"], item["input"], F.get(item["content"], F.lit(0))["text"], F.lit(""))


def accumulated_items(events: DataFrame) -> DataFrame:
    """Rows (stream_id, event_seq, data) to (stream_id, stream_status, output_index, item_id, kind, status, call_id, name, namespace, text).

    The last event with a whole response starts anew; behind it items are added in the order of their indices, texts grow by
    deltas, and what is done replaces. Events that don't fit the item at their index, by id or by kind, are passed over.
    `text` is an item's first part, its arguments or its input."""
    e = F.from_json("data", _EVENT)
    rows = events.select("stream_id", "event_seq", e.alias("e")).dropDuplicates(["stream_id", "event_seq"])
    stream = Window.partitionBy("stream_id")
    whole = F.col("e.response").isNotNull()
    rows = rows.withColumn("base", F.coalesce(F.max(F.when(whole, F.col("event_seq"))).over(stream), F.lit(-1))).filter("event_seq >= base")
    rows = rows.withColumn("given", F.coalesce(F.max(F.when(whole, F.size("e.response.output"))).over(stream), F.lit(0)))
    rows = rows.withColumn("stream_status", F.coalesce(F.max(F.when(whole, F.col("e.response.status"))).over(stream), F.lit("in_progress")))
    added = F.col("e.type") == "response.output_item.added"
    place = F.col("e.output_index")
    asked = F.array_sort(F.collect_list(F.when(added, F.struct("event_seq", place.alias("at")))).over(stream))
    start = F.struct(F.col("given").cast("bigint").alias("next"), F.array().cast("array<bigint>").alias("taken"))
    taken = F.aggregate("asked", start, lambda s, x: F.when(x["at"] == s["next"], F.struct((s["next"] + 1).alias("next"), F.array_append(s["taken"], x["event_seq"]).alias("taken"))).otherwise(s), lambda s: s["taken"])
    rows = rows.withColumn("asked", asked).withColumn("is_new", added & F.array_contains(taken, F.col("event_seq"))).drop("asked")
    # a row for each item of a whole response, and for each event about one item
    each = F.when(whole, F.transform("e.response.output", lambda x, i: F.struct(i.cast("bigint").alias("at"), x.alias("item"), F.lit(True).alias("is_new")))).otherwise(F.array(F.struct(place.alias("at"), F.col("e.item").alias("item"), "is_new")))
    listed = rows.select("stream_id", "event_seq", "stream_status", "e", F.explode(each).alias("x")).select("stream_id", "event_seq", "stream_status", "e", "x.*")
    item = Window.partitionBy("stream_id", "at")
    listed = listed.withColumn("first", F.min_by(F.when(F.col("is_new"), F.struct("event_seq", F.col("item.id").alias("id"), F.col("item.type").alias("kind"))), F.when(F.col("is_new"), F.col("event_seq"))).over(item))
    what = F.regexp_extract("e.type", r"\Aresponse\.(\w+)\.\w+\z", 1)
    kind = F.col("first.kind")
    own = F.coalesce(*(F.when(kind == k, F.lit(v)) for k, v in _OWN.items()))
    done_item = (F.col("e.type") == "response.output_item.done") & (F.col("item.id") == F.col("first.id")) & (F.col("item.type") == kind)
    part = (what == "content_part") & (F.col("e.part.type") == own)
    mine = (F.col("e.item_id") == F.col("first.id")) & (F.coalesce("e.content_index", F.lit(0)) == 0) & ((what == own) | part)
    fits = (F.col("is_new") & (F.col("event_seq") == F.col("first.event_seq"))) | ((F.col("event_seq") > F.col("first.event_seq")) & (done_item | mine))
    delta = F.col("e.type").endswith(".delta")
    set_to = F.when(F.col("item").isNotNull(), _text_of(F.col("item"))).otherwise(F.coalesce("e.part.text", "e.text", "e.arguments", "e.input", F.lit("")))
    kept = listed.filter(fits).withColumn("set_at", F.max(F.when(~delta, F.col("event_seq"))).over(item))
    grown = F.array_sort(F.collect_list(F.when(delta & (F.col("event_seq") > F.col("set_at")), F.struct("event_seq", "e.delta"))))
    last = lambda c: F.max_by(f"item.{c}", F.when(F.col("item").isNotNull(), F.col("event_seq")))
    return kept.groupBy("stream_id", "at").agg(
        F.first("stream_status").alias("stream_status"), F.first("first.id").alias("item_id"), F.first("first.kind").alias("kind"), *(last(c).alias(c) for c in ("status", "call_id", "name", "namespace")),
        F.concat(F.max_by(set_to, F.when(~delta, F.col("event_seq"))), F.array_join(F.transform(grown, lambda d: d["delta"]), "")).alias("text"),
    ).select("stream_id", "stream_status", F.col("at").alias("output_index"), "item_id", "kind", "status", "call_id", "name", "namespace", "text")
