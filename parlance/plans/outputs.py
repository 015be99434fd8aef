"""Model output: parsing, decoding, and streams against whole texts. Outputs are made from `conversations`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tokens as T
from ..operators import accumulating, streams
from ..sources import tokenizer_file
from ..streaming import processing
from ..streaming.parser import Options
from .registry import collector, table, tokenizer_path

QUERIES, ORACLES, query = collector()
_ID = "conv_id * 1000 + turn"
_TEXT = "ltrim(text, chr(10))"


def _outputs(spark: SparkSession, d: str, output: Column) -> DataFrame:
    df = table(spark, d, "conversations", "conv_id", "turn", "role", "text")
    return df.select((F.col("conv_id") * 1000 + F.col("turn")).alias("stream_id"), output.alias("output"))


def _chunks(df: DataFrame, size: int) -> DataFrame:
    c = streams.chunked(df, "stream_id", "output", size)
    none = {n: k for n, k in (x.split() for x in processing.CHUNK.split(", ")) if n not in ("stream_id", "seq", "kind", "content", "content_tokens")}
    return c.select("stream_id", "seq", F.lit("text").alias("kind"), "content", F.lit(1).cast("bigint").alias("content_tokens"), *(F.lit(None).cast(k).alias(n) for n, k in none.items()))


def _json(path: str) -> Column:
    return F.get_json_object("response", path)


@query(f"SELECT {_ID} AS stream_id, role AS reasoning, {_TEXT} AS answer FROM conversations")
def split_reasoning(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _outputs(spark, sf_dir, F.concat(F.lit("\n"), "role", F.lit("\n</think>\n"), "text"))
    r = processing.to_responses(_chunks(out, 11), "chat_completions", Options(reasoning="start"))
    return r.select("stream_id", _json("$.choices[0].message.reasoning_content").alias("reasoning"), _json("$.choices[0].message.content").alias("answer"))


_CALL = [f"\n\n<{T.DSML} calls>\n<{T.DSML} invoke name=\"look\">\n<{T.DSML} parameter name=\"turn\" string=\"false\">", f"</{T.DSML} parameter>\n<{T.DSML} parameter name=\"role\" string=\"true\">", f"</{T.DSML} parameter>\n</{T.DSML} invoke>\n</{T.DSML} calls>"]


@query(f"""SELECT {_ID} AS stream_id, {_TEXT} AS answer, 'look' AS name, '{{"turn": ' || turn || ', "role": "' || role || '"}}' AS arguments, 'tool_calls' AS reason FROM conversations""")
def parse_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _outputs(spark, sf_dir, F.concat("text", F.lit(_CALL[0]), F.col("turn").cast("string"), F.lit(_CALL[1]), "role", F.lit(_CALL[2])))
    text = _chunks(out, 13)
    last = text.groupBy("stream_id").agg(F.max("seq").alias("seq"))
    end = last.select("stream_id", (F.col("seq") + 1).alias("seq"), F.lit("finish").alias("kind"), F.lit("").alias("content"), F.lit(0).cast("bigint").alias("content_tokens"), *(F.lit(None).cast("bigint").alias(c) for c in ("prompt_tokens", "prompt_cache_hit_tokens")), F.lit(None).cast("string").alias("system_fingerprint"), F.lit("stop").alias("finish_reason"))
    r = processing.to_responses(text.unionByName(end), "chat_completions", Options(parse_tools=True))
    at = "$.choices[0].message.tool_calls[0].function"
    return r.select("stream_id", _json("$.choices[0].message.content").alias("answer"), _json(f"{at}.name").alias("name"), _json(f"{at}.arguments").alias("arguments"), _json("$.choices[0].finish_reason").alias("reason"))


@query(f"""SELECT {_ID} AS stream_id, '{{"turn": ' || turn || '}}' AS answer FROM conversations""")
def json_fence_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _outputs(spark, sf_dir, F.concat(F.lit('Here:\n```json\n{"turn": '), F.col("turn").cast("string"), F.lit("}\n```\nThat is it.")))
    r = processing.to_responses(_chunks(out, 5), "chat_completions", Options(json_output=True))
    return r.select("stream_id", F.trim(_json("$.choices[0].message.content")).alias("answer"))


@query(f"SELECT {_ID} AS stream_id, CASE WHEN contains({_TEXT}, ' the ') THEN split_part({_TEXT}, ' the ', 1) ELSE {_TEXT} END AS answer, CASE WHEN contains({_TEXT}, ' the ') THEN 'stop_sequence' ELSE 'end_turn' END AS reason FROM conversations")
def stop_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = processing.to_responses(_chunks(_outputs(spark, sf_dir, F.col("text")), 9), "messages", Options(stops=(" the ",)))
    return r.select("stream_id", F.coalesce(_json("$.content[0].text"), F.lit("")).alias("answer"), _json("$.stop_reason").alias("reason"))


_ANSWER = {"chat_completions": "$.choices[0].message.content", "messages": "$.content[0].text", "responses": "$.output[0].content[0].text"}


def _decode(name: str, dialect: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out = _outputs(spark, sf_dir, F.concat(F.lit(T.ASSISTANT), "text", F.lit(T.EOS + "more")))
        return processing.decode_output(out, dialect).select("stream_id", _json(_ANSWER[dialect]).alias("answer"))

    query(f"SELECT {_ID} AS stream_id, {_TEXT} AS answer FROM conversations", name)(run)


for _n, _d in (("chat", "chat_completions"), ("messages", "messages"), ("responses", "responses")):
    _decode(f"decode_output_{_n}", _d)


@query(f"SELECT {_ID} AS stream_id, true AS same FROM conversations")
def stream_parse_equals_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cut in small pieces or whole: the same complete responses."""
    out = _outputs(spark, sf_dir, F.concat(F.lit("why\n\n</think>\n"), "text", F.lit(_CALL[0] + "1" + _CALL[1]), "role", F.lit(_CALL[2])))
    o = Options(parse_tools=True, reasoning="start")
    pick = lambda r, n: r.select("stream_id", F.regexp_replace("response", r'"usage":\{.*\}\}', "").alias(n))
    small = pick(processing.to_responses(_chunks(out, 3), "responses", o), "a")
    whole = pick(processing.to_responses(_chunks(out, 1_000_000), "responses", o), "b")
    return small.join(whole, "stream_id").select("stream_id", (F.regexp_replace("a", r'"usage".*', "") == F.regexp_replace("b", r'"usage".*', "")).alias("same"))


@query(f"SELECT {_ID} AS stream_id, count(*)::BIGINT AS n_deltas FROM (SELECT conv_id, turn, unnest(range(0, greatest(1, (len(text) + 49) // 50))) FROM conversations) GROUP BY 1")
def chat_delta_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a plain answer: a start, a delta for each chunk, a finish."""
    e = processing.to_events(_chunks(_outputs(spark, sf_dir, F.col("text")), 50), "chat_completions")
    return e.groupBy("stream_id").agg((F.count("*") - 2).alias("n_deltas"))


@query(f"""WITH c AS (SELECT {_ID} AS stream_id, conv_id % 5 AS k, text, (len(text) + 49) // 50 AS n FROM conversations)
  SELECT stream_id, CASE WHEN 4 + k >= n + 8 THEN 'completed' ELSE 'in_progress' END AS stream_status, 0::BIGINT AS output_index, 'message' AS kind, CASE WHEN 4 + k >= n + 7 THEN 'completed' ELSE 'in_progress' END AS status, ltrim(left(text, 50 * k), chr(10)) AS answer FROM c""")
def accumulate_cut_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams that break off behind their first deltas: the items so far."""
    e = processing.to_events(_chunks(_outputs(spark, sf_dir, F.col("text")), 50), "responses").filter(F.expr("event_seq < 4 + (stream_id div 1000) % 5"))
    return accumulating.accumulated_items(e).select("stream_id", "stream_status", "output_index", "kind", "status", F.col("text").alias("answer"))


if tokenizer_path():

    @query(f"SELECT {_ID} AS stream_id, ltrim(text, chr(10)) || ' 世界x' || CASE WHEN conv_id % 3 = 0 THEN '' ELSE '😀' END AS answer FROM conversations")
    def token_stream_text(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Texts as token ids, one a chunk, and back through the stream; some lack the last id, so their last code point never gets whole."""
        out = _outputs(spark, sf_dir, F.concat("text", F.lit(" 世界x😀")))
        ids = tokenizer_file.encode(out, "stream_id", "output", tokenizer_file.Tokenizer.load(tokenizer_path()))
        cut = F.when(F.expr("(stream_id div 1000) % 3 = 0"), F.slice("ids", F.lit(1), F.size("ids") - 1)).otherwise(F.col("ids"))
        one = ids.select("stream_id", F.posexplode(cut).alias("seq", "token_id"))
        rest = {n: k for n, k in (x.split() for x in processing.CHUNK.split(", ")) if n not in ("stream_id", "seq", "kind")}
        chunks = one.select("stream_id", F.col("seq").cast("bigint").alias("seq"), F.lit("token").alias("kind"), *(F.lit(None).cast(k).alias(n) for n, k in rest.items()), F.col("token_id").cast("bigint").alias("token_id"))
        return processing.to_responses(chunks, "messages", tokenizer=tokenizer_path()).select("stream_id", _json("$.content[0].text").alias("answer"))
