r"""Operator 10, chat formatting: event-sourced reconstruction with DataFrame functions only.

A log of events is partitioned by conversation and sorted by sequence; streamed deltas, edits and
regenerations fold into final messages; these are rendered with a loss mask and can be read back.

Events: (conv_id, seq, message, kind, role, text). Kinds: `start` opens a message with its role, `delta`
appends text, `edit` replaces the text so far, `regenerate` drops the text so far (deltas follow), `delete`
removes the message. Message ids order the messages of a conversation.

Template: <s> then for each message <|turn|>role<|text|>text<|end|>\n, then </s>. A backslash goes inside every
control string and before every backslash of a role or text, so no text can forge a turn; dropping
it restores them exactly. The loss mask covers the escaped text of each assistant message.

Edge cases: null roles and texts are empty; rows that repeat are turns of their own; turns that tie are ordered
by role, then text (code points); null conv_id is a conversation of its own; an empty log gives an
empty result; other columns are ignored. A conversation is one output row, so the row must hold it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

TURN, TEXT, END, BOS, EOS = "<|turn|>", "<|text|>", "<|end|>", "<s>", "</s>"
_EVENT = "conv_id bigint, seq bigint, message bigint, kind string, role string, text string"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?=\\)|(?<=<)(?=\||/?s>)|(?<=\[)(?=/?INST\])", r"\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def fold(events: DataFrame) -> DataFrame:
    """Events to final messages (conv_id, message, role, text).

    A window finds each message's last event that starts its text anew; what came before is dropped before the
    one exchange's groups are built, so only final text is gathered."""
    w = Window.partitionBy("conv_id", "message")
    anew = F.col("kind").isin("start", "edit", "regenerate")
    live = (
        events.withColumn("_from", F.max(F.when(anew, F.col("seq"))).over(w))
        .withColumn("_gone", F.max((F.col("kind") == "delete").cast("int")).over(w))
        .filter((F.col("_gone") == 0) & ((F.col("kind") == "start") | (F.col("seq") >= F.coalesce(F.col("_from"), F.lit(-(2**62))))))
    )
    piece = F.struct("seq", F.when((F.col("kind") == "start") & (F.col("seq") < F.col("_from")), F.lit("")).otherwise(F.coalesce("text", F.lit(""))).alias("text"))
    return live.groupBy("conv_id", "message").agg(
        F.max(F.when(F.col("kind") == "start", F.coalesce("role", F.lit("")))).alias("role"),
        F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x: x["text"]), "").alias("text"),
    ).withColumn("role", F.coalesce("role", F.lit("")))


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Messages to one row per conversation: conv_id, formatted, loss_spans (start and length in code points)."""
    order = Window.partitionBy("conv_id").orderBy("message")
    er, et = escape(F.col("role")), escape(F.col("text"))
    m = messages.select("conv_id", "message", F.col("role") == loss_role, F.concat(F.lit(TURN), er, F.lit(TEXT)).alias("head"), et.alias("body")).toDF("conv_id", "message", "own", "head", "body")
    m = m.withColumn("n", F.length("head") + F.length("body") + len(END) + 1)
    m = m.withColumn("start", len(BOS) + F.sum("n").over(order) - F.col("n") + F.length("head"))
    parts = F.array_sort(F.collect_list(F.struct("message", "head", "body", "own", "start")))
    g = m.groupBy("conv_id").agg(parts.alias("p"))
    spans = F.transform(F.filter("p", lambda x: x["own"]), lambda x: F.struct(x["start"].alias("start"), F.length(x["body"]).cast("bigint").alias("length")))
    body = F.array_join(F.transform("p", lambda x: F.concat(x["head"], x["body"], F.lit(END + "\n"))), "")
    return g.select("conv_id", F.concat(F.lit(BOS), body, F.lit(EOS)).alias("formatted"), spans.alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Rendered rows to their turns and the text under the mask, from `formatted` and `loss_spans` alone."""
    inner = F.expr(f"substring(formatted, {len(BOS) + 1}, length(formatted) - {len(BOS) + len(EOS)})")
    rows = F.filter(F.split(inner, r"<\|end\|>\n"), lambda x: x != "")
    turn = lambda x: F.split(F.substr(x, F.lit(len(TURN) + 1)), r"<\|text\|>", 2)
    turns = F.transform(F.transform(rows, turn), lambda x: F.struct(unescape(x[0]).alias("role"), unescape(x[1]).alias("text")))
    under = F.transform("loss_spans", lambda x: unescape(F.substr(F.col("formatted"), (x["start"] + 1).cast("int"), x["length"].cast("int"))))
    return formatted.select("*", turns.alias("turns"), under.alias("loss_texts"))


def log_of(conversations: DataFrame, delta: int = 200, deltas: int = 64) -> DataFrame:
    """Rows (conv_id, turn, role, text) as a log that would have produced them.

    Texts come in deltas of `delta` code points, longer ones beyond `deltas` of them, so that cutting a very long text
    stays linear. By a hash of the row, a third of the messages are drafted first and regenerated, another third are
    drafted and then edited into their beginning; behind every fourth message stands one that is deleted again."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    m = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).withColumn("message", F.row_number().over(order).cast("bigint"))
    m = m.withColumn("way", F.pmod(F.xxhash64("conv_id", "message"), F.lit(12))).withColumn("size", F.greatest(F.lit(delta), F.ceil(F.length("text") / deltas).cast("int")))
    m = m.withColumn("count", F.greatest(F.lit(1), F.ceil(F.length("text") / F.col("size")).cast("int")))
    none, first = F.lit(None).cast("string"), F.col("message") * 2 * (deltas + 8)

    def event(k: Column | int, kind: str, text: Column, role: Column = none, of: int = 0) -> Column:
        k = k if isinstance(k, Column) else F.lit(k)
        return F.struct((first + k).cast("bigint").alias("seq"), (F.col("message") * 2 + of).alias("message"), F.lit(kind).alias("kind"), role.alias("role"), text.alias("text"))

    piece = lambda i: F.substr(F.col("text"), i * F.col("size") + 1, F.col("size"))
    pieces = lambda at: F.transform(F.sequence(F.lit(at), F.col("count") - 1), lambda i: event(i + 4, "delta", piece(i)))
    nothing = F.slice(pieces(0), 1, 0)
    draft = event(1, "delta", F.concat(F.lit("draft: "), F.left("text", F.lit(delta))))
    own = (
        F.when(F.col("way") % 3 == 1, F.concat(F.array(draft, event(2, "regenerate", none)), pieces(0)))
        .when(F.col("way") % 3 == 2, F.concat(F.array(draft, event(3, "edit", piece(F.lit(0)))), F.when(F.col("count") > 1, pieces(1)).otherwise(nothing)))
        .otherwise(pieces(0))
    )
    over = F.array(event(deltas + 5, "start", F.lit(""), F.col("role"), 1), event(deltas + 6, "delta", F.lit("sent by mistake"), none, 1), event(deltas + 7, "delete", none, none, 1))
    events = F.concat(F.array(event(0, "start", F.lit(""), F.col("role"))), own, F.when(F.col("way") % 4 == 0, over).otherwise(nothing))
    return m.select("conv_id", F.explode(events).alias("e")).select("conv_id", "e.seq", "e.message", "e.kind", "e.role", "e.text")


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    added = spark.createDataFrame([(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id bigint, turn bigint, role string, text string")
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").unionByName(added)
    back = read_back(render(fold(log_of(rows))))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return back.select(
        "conv_id", F.size("turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
