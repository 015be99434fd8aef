"""Texts: predicates, pieces, JSON text, cuts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import images, jsontext, text
from ..functions import tokens as T
from ..operators import streams
from .registry import collector, table

QUERIES, ORACLES, query = collector()


@query("SELECT p_partkey AS k, p_brand AS name, regexp_full_match(p_brand, '[A-Za-z0-9_-]{1,128}') AS ok FROM part UNION ALL SELECT c_custkey, c_name || chr(10), regexp_full_match(c_name || chr(10), '[A-Za-z0-9_-]{1,128}') FROM customer")
def tool_name_valid(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part", "p_partkey", "p_brand").toDF("k", "name").unionByName(table(spark, sf_dir, "customer", "c_custkey", "c_name").select(F.col("c_custkey").alias("k"), F.concat("c_name", F.lit("\n")).alias("name")))
    return names.withColumn("ok", text.tool_name_ok(F.col("name")))


@query("SELECT conv_id, bool_or(contains(lower(text), 'json')) AS named FROM (SELECT conv_id, CASE WHEN conv_id % 2 = 0 THEN text || ' JsOn' ELSE text END AS text FROM conversations) GROUP BY conv_id")
def json_instruction(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "conversations", "conv_id", "text").withColumn("text", F.when(F.col("conv_id") % 2 == 0, F.concat("text", F.lit(" JsOn"))).otherwise(F.col("text")))
    return df.groupBy("conv_id").agg(F.bool_or(text.names_json(F.col("text"))).alias("named"))


@query(f"SELECT doc_id, contains(CASE WHEN doc_id % 7 = 0 THEN text || '{T.IMAGE}' ELSE text END, '{T.IMAGE}') AS refused FROM documents")
def image_token_reject(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit(T.IMAGE))).otherwise(F.col("text"))
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", text.has_image_token(t).alias("refused"))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '\p{N}{1,3}|\P{N}+'))::BIGINT AS n FROM documents")
def pretok_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.size(text.digit_pieces(F.col("text"))).cast("bigint").alias("n"))


@query(r"SELECT page_id, len(regexp_extract_all(html, '[\x{4e00}-\x{9fa5}\x{3040}-\x{309f}\x{30a0}-\x{30ff}]+|[^\x{4e00}-\x{9fa5}\x{3040}-\x{309f}\x{30a0}-\x{30ff}]+'))::BIGINT AS n FROM pages")
def pretok_cjk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages", "page_id", "html").select("page_id", F.size(text.cjk_pieces(F.col("html"))).cast("bigint").alias("n"))


@query("SELECT doc_id, text AS rejoined FROM documents")
def pretok_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of all three splits, put together again."""
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.array_join(text.pieces(F.col("text")), "").alias("rejoined"))


@query("SELECT doc_id, octet_length(encode(text))::BIGINT AS n_bytes FROM documents")
def byte_level_len(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.octet_length("text").cast("bigint").alias("n_bytes"))


@query("""SELECT event_id, regexp_replace(regexp_replace(props, ':\\s*', ': ', 'g'), ',\\s*', ', ', 'g') AS t FROM events""")
def stringify_python(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events", "event_id", "props").select("event_id", jsontext.to_python_style(F.col("props")).alias("t"))


@query("""SELECT event_id, regexp_replace(regexp_replace(props, ':\\s*', ':', 'g'), ',\\s*', ',', 'g') AS t FROM events""")
def stringify_compact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events", "event_id", "props").select("event_id", jsontext.to_compact(F.col("props")).alias("t"))


@query(f"SELECT doc_id, split_part(replace(text, '. ', '{T.EOS}'), '{T.EOS}', 1) AS t FROM documents")
def truncate_eos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with an end token for each sentence end but those at line ends, up to the first."""
    t = F.replace(F.col("text"), F.lit(". "), F.lit(T.EOS))
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", F.substring_index(t, T.EOS, 1).alias("t"))


@query("""SELECT doc_id, CASE WHEN p = 0 THEN text ELSE left(text, p - 1) END AS t FROM (SELECT doc_id, text,
 CASE WHEN strpos(text, 'the ') > 0 AND strpos(text, 'der ') > 0 THEN least(strpos(text, 'the '), strpos(text, 'der ')) ELSE greatest(strpos(text, 'the '), strpos(text, 'der ')) END AS p FROM documents)""")
def stop_sequence_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents", "doc_id", "text").select("doc_id", text.first_cut(F.col("text"), ["the ", "der ", ""]).alias("t"))


@query("SELECT doc_id, (unnest(range(0, greatest(1, (len(text) + 99) // 100))))::BIGINT AS seq FROM documents".replace("AS seq FROM documents", "AS seq, substring(text, (unnest(range(0, greatest(1, (len(text) + 99) // 100))) * 100 + 1)::BIGINT, 100) AS content FROM documents"))
def chunk_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.chunked(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text", 100)


@query("SELECT doc_id, text AS content FROM documents")
def accumulate_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = streams.chunked(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text", 1000)
    return chunks.groupBy("doc_id").agg(streams.concat_in_order("seq", "content").alias("content"))


@query("""SELECT page_id, CASE WHEN lower(left(u, 4)) = 'http' AND octet_length(encode(u)) <= 8192 THEN 'url' WHEN lower(left(u, 4)) <> 'http' AND contains(u, 'base64,') THEN 'data_url' END AS kind
 FROM (SELECT page_id, CASE page_id % 4 WHEN 0 THEN upper(url) WHEN 1 THEN 'data:image/png;base64,' || url WHEN 2 THEN 'ftp://' || url ELSE url END AS u FROM pages)""")
def image_url_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id") % 4
    u = F.when(k == 0, F.upper("url")).when(k == 1, F.concat(F.lit("data:image/png;base64,"), "url")).when(k == 2, F.concat(F.lit("ftp://"), "url")).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages", "page_id", "url").select("page_id", images.source_kind(u).alias("kind"))


@query("""SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/webp' WHEN 3 THEN NULL ELSE 'image/gif' END AS media_type FROM pages""")
def mime_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = F.array(*(F.lit(x) for x in (" IMAGE/JPG; q=1", "image/png", "Image/WebP ;x=y", "image/tiff", "image/gif;")))
    return table(spark, sf_dir, "pages", "page_id").select("page_id", images.media_type(F.get(names, (F.col("page_id") % 5).cast("int"))).alias("media_type"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/png' WHEN 2 THEN 'image/gif' WHEN 3 THEN 'image/webp' END AS media_type FROM part""")
def media_type_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = F.array(*(F.unhex(F.lit(x)) for x in ("FFD8FFE000104A46", "89504E470D0A1A0A00", "474946383961FF", "5249464600000000574542505650", "25504446")))
    return table(spark, sf_dir, "part", "p_partkey").select("p_partkey", images.sniff(F.get(heads, (F.col("p_partkey") % 5).cast("int"))).alias("media_type"))


@query("""SELECT conv_id, turn::BIGINT AS turn, 'event: ' || role || chr(10) || 'data: ' || text || chr(10) || chr(10) AS frame FROM conversations""")
def sse_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").select("conv_id", F.col("turn").cast("bigint").alias("turn"), streams.sse_frame(F.col("role"), F.col("text")).alias("frame"))


@query("""SELECT event_id, '{"error":{"message":"' || event_type || '","type":"bad_request","param":null,"code":null}}' AS body FROM events""")
def error_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events", "event_id", "event_type").select("event_id", streams.error_body(F.col("event_type"), F.lit("bad_request")).alias("body"))
