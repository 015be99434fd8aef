"""Prompt rendering over `conversations`, tool calls over `lineitem` and `orders`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import tokens as T
from ..operators import rendering, tool_calls
from .registry import collector, table

QUERIES, ORACLES, query = collector()


def _messages(spark: SparkSession, d: str, role: str = "role", keep: str = "true") -> DataFrame:
    df = table(spark, d, "conversations", "conv_id", "turn", "role", "text").filter(F.expr(keep))
    return df.select("conv_id", F.col("turn").cast("bigint").alias("idx"), F.expr(role).alias("role"), F.col("text").alias("content"))


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _sql(version: T.Version, thinking: bool = False, effort: str | None = None, role: str = "role", keep: str = "true", required: bool = False, head: str = "") -> str:
    """The same prompts in SQL, for conversations whose turns alternate but for leading system turns and user runs."""
    prefix = version.effort_text(effort) if thinking else ""
    late = "" if version.late_system else """
, lead AS (SELECT *, role = 'system' AND coalesce(bool_and(role = 'system') OVER (PARTITION BY conv_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS is_lead FROM m0)
, m1 AS (SELECT conv_id, min(idx) AS idx, 'system' AS role, coalesce(string_agg(nullif(content, ''), chr(10) || chr(10) ORDER BY idx), '') AS content FROM lead WHERE is_lead GROUP BY conv_id
  UNION ALL SELECT conv_id, idx, CASE WHEN role = 'system' THEN 'user' ELSE role END, content FROM lead WHERE NOT is_lead AND NOT (role = 'system' AND content = ''))"""
    source = "m0" if version.late_system else "m1"
    first = "FALSE" if not head else "i = 0"
    return f"""
WITH m0 AS (SELECT conv_id, turn AS idx, {role} AS role, coalesce(text, '') AS content FROM conversations WHERE {keep}){late}
, r AS (SELECT *, sum(CASE WHEN role <> 'user' OR coalesce(prev <> 'user', true) THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY idx) AS run FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY idx) AS prev FROM {source}))
, g0 AS (SELECT conv_id, run, min(idx) AS idx, arg_min(role, idx) AS role, string_agg(content, chr(10) || chr(10) ORDER BY idx) AS content FROM r GROUP BY conv_id, run)
, g AS (SELECT conv_id, idx, role, content FROM g0 {"UNION ALL SELECT conv_id, min(idx) - 1, 'system', '' FROM g0 GROUP BY conv_id HAVING arg_min(role, idx) <> 'system'" if head else ""})
, n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY idx) - 1 AS i, lag(role) OVER (PARTITION BY conv_id ORDER BY idx) AS prev FROM g)
, p AS (SELECT conv_id, i, CASE WHEN i = 0 THEN (CASE WHEN role = 'system' OR {_q(prefix)} <> '' THEN {_q(version.system)} ELSE '' END) || {_q(prefix)} ELSE '' END
  || CASE role WHEN 'system' THEN (CASE WHEN i > 0 THEN {_q(version.system if version.late_system else '')} ELSE '' END) || content || CASE WHEN {first} THEN {_q(head)} ELSE '' END
   WHEN 'user' THEN (CASE WHEN prev IN ('user', 'tool') THEN chr(10) || chr(10) ELSE {_q(T.USER)} END) || content
   ELSE {_q(T.ASSISTANT)} || (CASE WHEN {str(thinking).lower()} AND i > 0 THEN {_q(T.THINK + T.END_THINK)} ELSE {_q(T.END_THINK)} END) || content || {_q(T.EOS)} END AS t FROM n)
SELECT conv_id, {_q(T.BOS)} || string_agg(t, '' ORDER BY i) || {_q(T.ASSISTANT + (T.THINK if thinking else T.END_THINK) + (f"{chr(10)}{chr(10)}<{T.DSML}{version.block}>{chr(10)}" if required else ""))} AS prompt FROM p GROUP BY conv_id"""


_RUNS = dict(role="CASE WHEN turn % 4 = 1 THEN 'user' ELSE role END")
_MID = dict(role="CASE WHEN turn % 3 = 2 THEN 'system' ELSE role END")


def _register(name: str, version: T.Version, thinking: bool = False, effort: str | None = None, role: str = "role", keep: str = "true", required: bool = False, json_format: bool = False, tools: list[tuple[str, str, str]] | None = None) -> None:
    """tools: (name, description, parameters) of each."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        schemas = tools and tool_calls.render_schemas(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(d).alias("description"), F.lit(p).alias("parameters")) for n, d, p in tools)))
        return rendering.render(_messages(spark, sf_dir, role, keep), version, thinking, effort, required, schemas, json_format)

    listed = "\n".join(f'{{"name": "{n}", "description": "{d}", "parameters": {p}}}' for n, d, p in tools or ())
    prompt = "\n\n" + version.tool_prompt("\0").split("\0")[0] + listed + T.TOOLS_TAIL if tools else ""
    query(_sql(version, thinking, effort, role, keep, required, prompt + (T.JSON_FORMAT if json_format else "")), name)(run)


_TOOLS = [("find", "Finds things.", '{"type": "object", "properties": {"what": {"type": "string"}}, "required": ["what"]}'), ("now", "Tells the time.", '{"type": "object"}')]


for _v in (T.V4, T.V41):
    _register(f"render_prompt_{_v.name}", _v)
    _register(f"render_thinking_{_v.name}", _v, True)
    _register(f"render_effort_low_{_v.name}", _v, True, "low")
    _register(f"render_effort_max_{_v.name}", _v, True, "max")
    _register(f"render_user_runs_{_v.name}", _v, **_RUNS)
    _register(f"render_mid_system_{_v.name}", _v, True, **_MID)
    _register(f"render_required_{_v.name}", _v, required=True)
    _register(f"render_json_format_{_v.name}", _v, json_format=True)
    _register(f"render_tools_{_v.name}", _v, tools=_TOOLS)
    _register(f"render_tools_json_{_v.name}", _v, True, tools=_TOOLS, json_format=True)


@query(f"""
WITH m AS (SELECT conv_id, turn, text, {_RUNS["role"]} AS role FROM conversations),
r AS (SELECT *, sum(CASE WHEN role <> 'user' OR coalesce(before <> 'user', true) THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM (SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM m)),
u AS (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM r WHERE role = 'user')
SELECT conv_id, min(turn)::BIGINT AS first_turn, any_value(n)::BIGINT AS n_turns, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS content FROM u GROUP BY conv_id, run""")
def normalize_merge_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With some assistant turns taken for the user's, user turns come in runs of three."""
    df = rendering.messages(_messages(spark, sf_dir, **_RUNS))
    n = df.filter("role = 'user'").groupBy("conv_id").agg(F.count("*").alias("n_turns"))
    merged = rendering.merge_runs(df).filter("role = 'user'")
    return merged.join(n, "conv_id").select("conv_id", F.col("idx").alias("first_turn"), "n_turns", "content")


@query("""
WITH m AS (SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN 'system' ELSE role END AS role, text FROM conversations),
l AS (SELECT *, role = 'system' AND coalesce(bool_and(role = 'system') OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS lead FROM m)
SELECT conv_id, min(turn)::BIGINT AS idx, 'system' AS role, coalesce(string_agg(nullif(text, ''), chr(10) || chr(10) ORDER BY turn), '') AS content FROM l WHERE lead GROUP BY conv_id
UNION ALL SELECT conv_id, turn::BIGINT, CASE WHEN role = 'system' THEN 'user' ELSE role END, text FROM l WHERE NOT lead AND NOT (role = 'system' AND text = '')""")
def normalize_v4_mid_system(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendering.normalize_systems(rendering.messages(_messages(spark, sf_dir, **_MID))).select("conv_id", "idx", "role", "content")


@query("""
WITH c AS (SELECT l_orderkey AS conv_id, list(l_linenumber::VARCHAR ORDER BY l_linenumber) AS calls FROM lineitem GROUP BY 1),
t AS (SELECT l_orderkey AS conv_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey, l_suppkey) AS idx, CASE WHEN l_linenumber % 5 = 0 THEN 'none' ELSE l_linenumber::VARCHAR END AS id, l_partkey::VARCHAR AS l_comment FROM lineitem),
r AS (SELECT t.*, greatest(coalesce(list_position(calls, id), 0) - 1, 0) AS rank FROM t JOIN c USING (conv_id)),
a AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY rank, idx) AS at FROM r),
s AS (SELECT conv_id, idx, row_number() OVER (PARTITION BY conv_id ORDER BY idx) AS at FROM r)
SELECT a.conv_id, s.idx::BIGINT AS idx, a.id AS tool_call_id, a.l_comment AS content FROM a JOIN s ON a.conv_id = s.conv_id AND a.at = s.at""")
def tool_result_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as conversations: an assistant calls once a line, results come back in reverse, some with unknown ids."""
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    li = li.withColumn("idx", F.row_number().over(Window.partitionBy("l_orderkey").orderBy(F.desc("l_linenumber"), "l_partkey", "l_suppkey")).cast("bigint"))
    number = F.col("l_linenumber")
    calls = li.groupBy(F.col("l_orderkey").alias("conv_id")).agg(F.transform(F.array_sort(F.collect_list("l_linenumber")), lambda x: x.cast("string")).alias("call_ids"))
    calls = calls.select("conv_id", F.lit(0).cast("bigint").alias("idx"), F.lit("assistant").alias("role"), F.lit("").alias("content"), "call_ids", F.lit(None).cast("string").alias("tool_call_id"))
    results = li.select(F.col("l_orderkey").alias("conv_id"), "idx", F.lit("tool").alias("role"), F.col("l_partkey").cast("string").alias("content"), F.lit(None).cast("array<string>").alias("call_ids"), F.when(number % 5 == 0, "none").otherwise(number.cast("string")).alias("tool_call_id"))
    ordered = rendering.order_tool_results(rendering.messages(calls.unionByName(results)))
    return ordered.filter("role = 'tool'").select("conv_id", "idx", "tool_call_id", "content")


@query("""
SELECT o_orderkey AS conv_id, string_agg(id, ', ' ORDER BY id) AS ids FROM (
  SELECT o_orderkey, 'call_' || n AS id FROM orders, (SELECT unnest(range(1, 4)) AS n)
  EXCEPT SELECT l_orderkey, 'call_' || l_linenumber FROM lineitem) GROUP BY 1""")
def unresolved_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order makes three calls; its lines are the results."""
    calls = table(spark, sf_dir, "orders", "o_orderkey").select(F.col("o_orderkey").alias("conv_id"), F.explode(F.array(*(F.lit(f"call_{i}") for i in (1, 2, 3)))).alias("id"))
    results = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber").select(F.col("l_orderkey").alias("conv_id"), F.concat(F.lit("call_"), F.col("l_linenumber").cast("string")).alias("id"))
    return tool_calls.unresolved(calls, results)


@query("SELECT l_orderkey AS conv_id, l_suppkey::VARCHAR AS id, count(*)::BIGINT AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_call_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tool_calls.duplicates(table(spark, sf_dir, "lineitem", "l_orderkey", "l_suppkey").select(F.col("l_orderkey").alias("conv_id"), F.col("l_suppkey").cast("string").alias("id")))


_TAG = {k: T.DSML + getattr(T.V41, k) for k in ("block", "call", "parameter")}


@query(f"""
SELECT l_orderkey AS conv_id, l_linenumber AS n, '<{_TAG["block"]}>' || chr(10) || '<{_TAG["call"]} name="part">' || chr(10)
 || '<{_TAG["parameter"]} name="key" string="false">' || l_partkey || '</{_TAG["parameter"]}>' || chr(10) || '<{_TAG["parameter"]} name="flag" string="true">' || l_returnflag || '</{_TAG["parameter"]}>' || chr(10)
 || '</{_TAG["call"]}>' || chr(10) || '</{_TAG["block"]}>' AS rendered FROM lineitem""")
def render_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_returnflag")
    call = F.array(F.struct(F.lit("part").alias("name"), F.concat(F.lit('{"key": '), F.col("l_partkey").cast("string"), F.lit(', "flag":"'), F.col("l_returnflag"), F.lit('"}')).alias("arguments")))
    return li.select(F.col("l_orderkey").alias("conv_id"), F.col("l_linenumber").alias("n"), tool_calls.render_calls(T.V41, call).alias("rendered"))


@query(r"""SELECT p_partkey, '{"name": "' || p_name || '", "description": "' || p_brand || '", "parameters": {"type": "object", "properties": {"size": {"type": "integer"}}}}' AS schema_text FROM part""")
def render_tool_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    tool = F.array(F.struct(F.col("p_name").alias("name"), F.col("p_brand").alias("description"), F.lit('{"type":"object","properties":{"size":{"type":"integer"}}}').alias("parameters")))
    return table(spark, sf_dir, "part", "p_partkey", "p_name", "p_brand").select("p_partkey", tool_calls.render_schemas(tool).alias("schema_text"))


@query(f"""
WITH c AS (SELECT conv_id, unnest(regexp_extract_all({_q(T.BOS)} || text || {_q(T.EOS)}, '<[^>]*>|[^<]+')) AS s FROM conversations)
SELECT conv_id, count(*) FILTER (s LIKE '<%')::BIGINT AS n_markers, count(*) FILTER (s NOT LIKE '<%')::BIGINT AS n_plain, sum(len(s))::BIGINT AS n_chars FROM c GROUP BY conv_id""")
def segment_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "conversations", "conv_id", "text")
    s = df.select("conv_id", F.explode(rendering.segments(F.concat(F.lit(T.BOS), F.coalesce("text", F.lit("")), F.lit(T.EOS)))).alias("s"))
    return s.groupBy("conv_id").agg(F.count_if(F.col("s.marker")).alias("n_markers"), F.count_if(~F.col("s.marker")).alias("n_plain"), F.sum(F.length("s.text")).alias("n_chars"))


_SHOWN = "CASE WHEN (conv_id + turn) % 3 = 0 THEN {many} WHEN (conv_id + turn) % 3 = 1 THEN {one} ELSE {none} END"


@query(f"""WITH m AS (SELECT conv_id, turn, CASE WHEN turn % 4 = 2 THEN 'tool' ELSE role END AS role, {_SHOWN.format(many="['a' || turn, 'b' || turn]", one="['c' || turn]", none="[]::VARCHAR[]")} AS urls FROM conversations)
  SELECT conv_id, coalesce(string_agg(array_to_string(urls, ','), ',' ORDER BY turn) FILTER (role IN ('user', 'tool') AND len(urls) > 0), '') AS images FROM m GROUP BY conv_id""")
def render_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image sources in prompt order, beside the prompt: some turns as tool results, user turns in runs."""
    df = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    one = lambda letter: f"named_struct('kind', 'url', 'url', concat('{letter}', turn), 'detail', 'high')"
    shown = F.expr(_SHOWN.format(many=f"array({one('a')}, {one('b')})", one=f"array({one('c')})", none="array()"))
    turns = df.select("conv_id", F.col("turn").cast("bigint").alias("idx"), F.expr("CASE WHEN turn % 4 = 2 THEN 'tool' ELSE role END").alias("role"), F.col("text").alias("content"), shown.cast(rendering.COLUMNS["images"]).alias("images"))
    return rendering.render(turns).select("conv_id", F.array_join(F.transform("images", lambda i: i["url"]), ",").alias("images"))


def _with_results(version: T.Version) -> None:
    """Turns as user, assistant with two calls, their results the other way round, and a reminder, over and over."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = table(spark, sf_dir, "conversations", "conv_id", "turn", "text")
        k = F.col("turn") % 5
        role = F.element_at(F.array(*(F.lit(x) for x in ("user", "assistant", "tool", "tool", "latest_reminder"))), (k + 1).cast("int"))
        turns = df.select(
            "conv_id", F.col("turn").cast("bigint").alias("idx"), role.alias("role"), F.col("text").alias("content"), F.when(k == 1, F.concat(F.lit("calls of "), F.col("turn").cast("string"))).alias("tool_calls"),
            F.when(k == 1, F.array(F.lit("b"), F.lit("a"))).alias("call_ids"), F.when(k == 2, "a").when(k == 3, "b").alias("tool_call_id"),
        )
        return rendering.render(turns, version)

    result = "'<tool_result>' || {} || '</tool_result>'"
    sql = f"""WITH t AS (SELECT conv_id, turn, turn % 5 AS k, text, lag(text) OVER w AS before, lead(text) OVER w AS behind FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
      p AS (SELECT conv_id, turn, CASE k WHEN 0 THEN {_q(T.USER)} || text WHEN 1 THEN {_q(T.ASSISTANT + T.END_THINK)} || text || chr(10) || chr(10) || 'calls of ' || turn || {_q(T.EOS)} WHEN 2 THEN {_q(T.USER)} || {result.format("coalesce(behind, text)")}
        WHEN 3 THEN chr(10) || chr(10) || {result.format("before")} ELSE {_q(T.LATEST_REMINDER)} || text END AS s FROM t)
      SELECT conv_id, {_q(T.BOS)} || string_agg(s, '' ORDER BY turn) || {_q(T.ASSISTANT + T.END_THINK)} AS prompt FROM p GROUP BY conv_id"""
    query(sql, f"render_tool_results_{version.name}")(run)


for _v in (T.V4, T.V41):
    _with_results(_v)
