"""Records: request checks, usage, sequences, image figures over the relational tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import images
from ..operators import budgets, requests, streams
from .registry import collector, table

QUERIES, ORACLES, query = collector()
_KEYS = ("l_orderkey", "l_linenumber")
_OPTIONS = """(SELECT l_orderkey, l_linenumber, l_quantity::BIGINT - 3 AS max_tokens, l_discount * 30 AS temperature, l_tax * 20 - 0.2 AS top_p FROM lineitem)"""


def _options(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem", *_KEYS, "l_quantity", "l_discount", "l_tax")
    return li.select(*_KEYS, (F.col("l_quantity").cast("bigint") - 3).alias("max_tokens"), (F.col("l_discount") * 30).alias("temperature"), (F.col("l_tax") * 20 - F.lit(0.2)).alias("top_p"))


@query(f"SELECT l_orderkey, l_linenumber, NOT (max_tokens <= 0 OR temperature < 0 OR temperature > 2 OR top_p <= 0 OR top_p > 1) AS ok FROM {_OPTIONS}")
def validate_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = requests.sampling_error(max_tokens=F.col("max_tokens"), temperature=F.col("temperature"), top_p=F.col("top_p"))
    return _options(spark, sf_dir).select(*_KEYS, e.isNull().alias("ok"))


@query(f"""SELECT l_orderkey, l_linenumber, CASE WHEN max_tokens <= 0 THEN 'max_tokens must be greater than 0' WHEN temperature < 0 OR temperature > 2 THEN 'temperature must be between 0 and 2'
 WHEN top_p <= 0 OR top_p > 1 THEN 'top_p must be greater than 0 and at most 1' END AS error FROM {_OPTIONS}""")
def first_error_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = requests.sampling_error(max_tokens=F.col("max_tokens"), temperature=F.col("temperature"), top_p=F.col("top_p"))
    return _options(spark, sf_dir).select(*_KEYS, e.alias("error"))


_REASONS = ["stop", "length", "content_filter", "tool_calls", "stop_sequence"]


def _cases(dialect: str) -> str:
    return "CASE event_id % 5 " + " ".join(f"WHEN {i} THEN '{requests.FINISH[dialect][r]}'" for i, r in enumerate(_REASONS)) + " END"


@query("SELECT event_id, " + ", ".join(f"{_cases(d)} AS {d}" for d in requests.FINISH) + " FROM events")
def finish_reason_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = F.get(F.array(*map(F.lit, _REASONS)), (F.col("event_id") % 5).cast("int"))
    return table(spark, sf_dir, "events", "event_id").select("event_id", *(requests.finish_reason(d, reason).alias(d) for d in requests.FINISH))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 2 END::BIGINT AS n_kept, CASE WHEN event_id % 3 = 0 AND event_id % 2 = 0 THEN 'web search is not supported' END AS error FROM events")
def web_search_policy(spark: SparkSession, sf_dir: str) -> DataFrame:
    tools = F.array(F.lit("function"), F.when(F.col("event_id") % 3 == 0, "web_search").otherwise("custom"))
    kept, error = requests.web_search(tools, "reject")
    return table(spark, sf_dir, "events", "event_id").select("event_id", F.size(kept).cast("bigint").alias("n_kept"), F.when(F.col("event_id") % 2 == 0, error).alias("error"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN true WHEN event_id % 4 = 1 THEN false WHEN event_id % 4 = 2 THEN event_id % 8 <> 2 ELSE true END AS thinking FROM events""")
def resolve_thinking(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 4
    thinking = F.when(k == 0, "adaptive").when(k == 1, "disabled")
    effort = F.when(k == 2, F.when(F.col("event_id") % 8 == 2, "none").otherwise("low")).when(k == 1, "max")
    return table(spark, sf_dir, "events", "event_id").select("event_id", requests.thinking_chat(thinking, effort)["thinking"].alias("thinking"))


_STREAM = "(SELECT user_id, event_id % 900 AS prompt, event_id % 1000 AS hit, abs(value)::BIGINT AS tokens, event_id FROM (SELECT *, floor(abs(value)) AS v FROM events))"


def _usage(spark: SparkSession, d: str) -> DataFrame:
    """Each user's events as chunks of one stream: prompt figures of the last one, tokens summed."""
    ev = table(spark, d, "events", "event_id", "user_id")
    return ev.groupBy("user_id").agg(F.max_by(F.struct((F.col("event_id") % 900).alias("p"), (F.col("event_id") % 1000).alias("h")), "event_id").alias("last"), F.sum(F.col("event_id") % 50).alias("completion")).select("user_id", F.col("last.p").alias("prompt"), F.col("last.h").alias("hit"), "completion")


_USAGE = "(SELECT user_id, arg_max(event_id % 900, event_id) AS p, arg_max(event_id % 1000, event_id) AS h, sum(event_id % 50)::BIGINT AS c FROM events GROUP BY user_id)"


def _usage_query(name: str, dialect: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _usage(spark, sf_dir).select("user_id", requests.usage(dialect, F.col("prompt"), F.col("hit"), F.col("completion")).alias("u")).select("user_id", "u.*")

    query(f"SELECT user_id, {sql} FROM {_USAGE}", name)(run)


_usage_query("usage_chat", "chat_completions", "p AS prompt_tokens, c AS completion_tokens, p + c AS total_tokens, h AS prompt_cache_hit_tokens, greatest(0, p - h)::BIGINT AS prompt_cache_miss_tokens")
_usage_query("usage_messages", "messages", "greatest(0, p - h)::BIGINT AS input_tokens, c AS output_tokens, h AS cache_read_input_tokens, 0::BIGINT AS cache_creation_input_tokens")
_usage_query("usage_responses", "responses", "p AS input_tokens, h AS cached_tokens, c AS output_tokens, 0::BIGINT AS reasoning_tokens, p + c AS total_tokens")


@query("SELECT event_id, sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT - 1 AS call_index FROM events")
def tool_call_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events", "event_id", "user_id", "event_type").select("event_id", streams.call_index(F.col("event_type"), "user_id", "event_id", "click").alias("call_index"))


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS sequence_number FROM events")
def event_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events", "event_id", "user_id").select("event_id", streams.sequence_number("user_id", "event_id").alias("sequence_number"))


@query("SELECT event_id, sum(CASE WHEN p <> event_type THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id)::BIGINT AS block_index FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events)")
def content_block_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.block_index(table(spark, sf_dir, "events", "event_id", "user_id", "event_type"), "event_type", "user_id", "event_id").select("event_id", "block_index")


@query("SELECT user_id, arg_min(event_type, event_id) AS fingerprint, arg_max(value, event_id) AS last_usage FROM events GROUP BY user_id")
def fingerprint_first_usage_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events", "event_id", "user_id", "event_type", "value")
    return ev.groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("fingerprint"), F.max_by("value", "event_id").alias("last_usage"))


def _once(source: str) -> str:
    """One resize step in SQL, over a table (k, w, h)."""
    return f"""(SELECT k, CASE WHEN n <= 1024 THEN aw WHEN mw < 1 THEN 42 WHEN mh < 1 THEN 1021 * 42 ELSE trunc(w * beta / 14.0)::BIGINT * 14 END AS w, CASE WHEN n <= 1024 THEN ah WHEN mw < 1 THEN 511 * 42 WHEN mh < 1 THEN 42 ELSE trunc(h * beta / 14.0)::BIGINT * 14 END AS h
 FROM (SELECT *, least(trunc(mw)::BIGINT * 42 / w::DOUBLE, trunc(mh)::BIGINT * 42 / h::DOUBLE) AS beta FROM (SELECT *, ((ah // 14 + 2) // 3) * ((aw // 14 + 2) // 3 + 1) + 2 AS n, sqrt(1022.0::DOUBLE / (h::DOUBLE / w) + 0.25) - 0.5 AS mw, (sqrt(1022.0::DOUBLE / (h::DOUBLE / w) + 0.25) - 0.5) * (h::DOUBLE / w) AS mh
 FROM (SELECT k, w, h, (w + 13) // 14 * 14 AS aw, (h + 13) // 14 * 14 AS ah FROM (SELECT k, CASE WHEN w * h < 295936 THEN trunc(w * sqrt(295936.0::DOUBLE / (w * h)))::BIGINT ELSE w END AS w, CASE WHEN w * h < 295936 THEN trunc(h * sqrt(295936.0::DOUBLE / (w * h)))::BIGINT ELSE h END AS h FROM {source})))))"""


_SIZE_SQL = f"""WITH src AS (SELECT l_orderkey * 10 + l_linenumber AS k, (l_partkey * 37 % 6000 + 1)::BIGINT AS w, (l_suppkey * 91 % 5000 + 1)::BIGINT AS h FROM lineitem),
{", ".join(f"t{i} AS MATERIALIZED {_once(f't{i - 1}' if i else 'src')}" for i in range(10))},
s AS (SELECT k, w AS bw, h AS bh, (h // 14 + 2) // 3 AS gh, (w // 14 + 2) // 3 AS gw FROM t9)"""


def _sized(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    k = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    return li.select(k.alias("k"), "l_orderkey", images.resized(F.col("l_partkey") * 37 % 6000 + 1, F.col("l_suppkey") * 91 % 5000 + 1).alias("r"))


@query(_SIZE_SQL + " SELECT k, gh * (gw + 1) + 2 AS num_tokens, bw AS best_width, bh AS best_height, gh AS n_llm_h, gw AS n_llm_w FROM s")
def image_token_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sized(spark, sf_dir).select("k", "r.*")


@query(_SIZE_SQL + " SELECT k // 10 AS request, sum(gh * (gw + 1) + 1)::BIGINT AS more_tokens FROM s GROUP BY 1")
def image_token_adjustment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sized(spark, sf_dir).groupBy(F.col("l_orderkey").alias("request")).agg(F.sum(F.col("r.num_tokens") - 1).alias("more_tokens"))


@query(f"""WITH s AS (SELECT l_suppkey, l_orderkey * 10 + l_linenumber AS idx, l_quantity::BIGINT * 800000 AS bytes FROM lineitem),
r AS (SELECT *, row_number() OVER w AS n, sum(bytes) OVER w AS total FROM s WINDOW w AS (PARTITION BY l_suppkey ORDER BY idx))
SELECT l_suppkey, min(idx) AS first_refused, arg_min(CASE WHEN n > {images.MAX_IMAGES} THEN 'too_many' WHEN bytes > {images.MAX_BYTES} THEN 'too_large' ELSE 'total_too_large' END, idx) AS reason
FROM r WHERE n > {images.MAX_IMAGES} OR bytes > {images.MAX_BYTES} OR total > {images.MAX_TOTAL} GROUP BY 1""")
def image_quota_violation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as requests, lines as their images: the first that a quota refuses."""
    li = table(spark, sf_dir, "lineitem", "l_suppkey", "l_orderkey", "l_linenumber", "l_quantity")
    s = li.select("l_suppkey", (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("idx"), (F.col("l_quantity").cast("bigint") * 800000).alias("bytes"))
    w = Window.partitionBy("l_suppkey").orderBy("idx")
    s = s.withColumn("n", F.row_number().over(w)).withColumn("total", F.sum("bytes").over(w))
    reason = requests.first_error((F.col("n") > images.MAX_IMAGES, "too_many"), (F.col("bytes") > images.MAX_BYTES, "too_large"), (F.col("total") > images.MAX_TOTAL, "total_too_large"))
    return s.withColumn("reason", reason).filter("reason IS NOT NULL").groupBy("l_suppkey").agg(F.min("idx").alias("first_refused"), F.min_by("reason", "idx").alias("reason"))


@query(f"SELECT l_orderkey, l_linenumber, CASE WHEN count(*) OVER (PARTITION BY l_partkey) >= {images.MANY_IMAGES} THEN {images.SIDE_MANY} ELSE {images.SIDE_FEW} END AS max_side FROM lineitem")
def image_max_dimension(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem", *_KEYS, "l_partkey")
    return li.select(*_KEYS, images.max_side(F.count("*").over(Window.partitionBy("l_partkey"))).alias("max_side"))


@query(f"""WITH RECURSIVE s AS (SELECT l_suppkey AS request, l_orderkey // 512 AS call, l_orderkey * 10 + l_linenumber AS idx, l_quantity::BIGINT * 70000 * (1 + (l_orderkey % 97 = 0)::BIGINT * 9) AS n FROM lineitem),
r AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY request ORDER BY call, idx, n) AS k, count(*) OVER (PARTITION BY request, call) AS size, row_number() OVER (PARTITION BY request, call ORDER BY idx, n) AS i FROM s),
t AS (SELECT request, 0::BIGINT AS k, NULL::BIGINT AS call, 0::BIGINT AS images, 0::BIGINT AS bytes, 0::BIGINT AS run, NULL::VARCHAR AS kind, NULL::BIGINT AS failed_at, NULL::BIGINT AS figure, false AS ended FROM (SELECT DISTINCT request FROM s)
  UNION ALL
  SELECT request, k, call, CASE WHEN i = size AND kind IS NULL THEN images + size ELSE images END, CASE WHEN i = size AND kind IS NULL THEN run ELSE bytes END, run, kind, failed_at, figure, i = size FROM (
    SELECT request, k, call, images, bytes, i, size, run + n AS run, CASE WHEN kind IS NOT NULL THEN kind WHEN n > {images.MAX_BYTES} THEN 'image_too_large' WHEN run + n > {images.MAX_TOTAL} THEN 'total_size_too_large' END AS kind,
      CASE WHEN kind IS NULL AND (n > {images.MAX_BYTES} OR run + n > {images.MAX_TOTAL}) THEN idx ELSE failed_at END AS failed_at, CASE WHEN kind IS NULL AND n > {images.MAX_BYTES} THEN n WHEN kind IS NULL AND run + n > {images.MAX_TOTAL} THEN run + n ELSE figure END AS figure FROM (
      SELECT r.request, r.k, r.call, r.i, r.size, r.n, r.idx, t.images, t.bytes, CASE WHEN i = 1 THEN t.bytes ELSE t.run END AS run, CASE WHEN i > 1 THEN t.kind WHEN t.images + r.size > {images.MAX_IMAGES} THEN 'too_many_images' END AS kind,
        CASE WHEN i > 1 THEN t.failed_at END AS failed_at, CASE WHEN i > 1 THEN t.figure WHEN t.images + r.size > {images.MAX_IMAGES} THEN t.images + r.size END AS figure FROM t JOIN r ON r.request = t.request AND r.k = t.k + 1)))
SELECT request, call, kind, failed_at, CASE kind WHEN 'too_many_images' THEN 'too many images: max {images.MAX_IMAGES} images per request, got ' || figure WHEN 'image_too_large' THEN 'image size ' || figure || ' bytes exceeds the limit of {images.MAX_BYTES} bytes'
  WHEN 'total_size_too_large' THEN 'total image size ' || figure || ' bytes exceeds the limit of {images.MAX_TOTAL} bytes' END AS error, CASE WHEN kind IS NOT NULL THEN 400 END::INTEGER AS status, images, bytes FROM t WHERE ended""")
def image_call_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as requests, runs of orders as their calls, lines as images: what each call adds, or why it fails."""
    li = table(spark, sf_dir, "lineitem", "l_suppkey", "l_orderkey", "l_linenumber", "l_quantity")
    size = F.col("l_quantity").cast("bigint") * 70000 * (1 + (F.col("l_orderkey") % 97 == 0).cast("bigint") * 9)
    return budgets.resolve_calls(li.select(F.col("l_suppkey").alias("request"), F.expr("l_orderkey div 512").alias("call"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("idx"), size.alias("n_bytes")))
