"""Whole requests made from `conversations`, and tokens of `documents`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import tokens as T
from ..operators import conversion, rendering
from ..sources import tokenizer_file
from .registry import collector, table, tokenizer_path

QUERIES, ORACLES, query = collector()


#: By conv_id modulo 7: the effort that each dialect's requests ask for, and the level it stands for (None: no thinking).
_EFFORTS = {
    "chat_completions": ([None, "banana", "minimal", "none", "medium", "max", "xhigh"], ["high", None, "low", None, "high", "max", "xhigh"]),
    "messages": ([None, "none", "low", "ultra", "medium", "max", "xhigh"], ["high", None, "low", "max", "high", "max", "xhigh"]),
    "responses": ([None, "ultra", "minimal", "none", "high", "max", "low"], ["high", None, "low", None, "high", "max", "low"]),
}
_ALLOWED = {p: ", ".join(f"`{x}`" for x in names) for p, names in conversion.EFFORTS.items()}
_CALL = {
    "chat_completions": '{{"role":"assistant","tool_calls":[{calls}]}}', "messages": '{{"role":"assistant","content":[{calls}]}}', "responses": "{calls}",
}
_ONE = {
    "chat_completions": '{{"id":"{i}","type":"function","function":{{"name":"f#","arguments":"{{\\"n\\": #}}"}}}}', "messages": '{{"type":"tool_use","id":"{i}","name":"f#","input":{{"n":#}}}}',
    "responses": '{{"type":"function_call","call_id":"{i}","name":"f#","arguments":"{{\\"n\\": #}}"}}',
}
_ANSWER = {
    "chat_completions": '{{"role":"tool","tool_call_id":"{i}","content":"r{i}"}}', "messages": '{{"type":"tool_result","tool_use_id":"{i}","content":[{{"type":"text","text":"r{i}"}}]}}', "responses": '{{"type":"function_call_output","call_id":"{i}","output":"r{i}"}}',
}
_SHOWN = {
    "chat_completions": '{"role":"user","content":[{"type":"text","text":"see"},{"type":"image_url","image_url":{"url":"http://x/#"}}]}', "messages": '{"role":"user","content":[{"type":"text","text":"see"},{"type":"image","source":{"type":"url","url":"http://x/#"}}]}',
    "responses": '{"role":"user","content":[{"type":"input_text","text":"see"},{"type":"input_image","image_url":"http://x/#"}]}',
}


def _more(p: str, calls: tuple[str, ...], answers: tuple[str, ...]) -> str:
    """Messages behind the turns: a user's, an assistant's calls, their results; # stands for the conv_id."""
    made = _CALL[p].format(calls=",".join(_ONE[p].format(i=i) for i in calls))
    given = ",".join(_ANSWER[p].format(i=i) for i in answers)
    return ",".join(x for x in ('{"role":"user","content":"go"}', made, f'{{"role":"user","content":[{given}]}}' if p == "messages" and given else given) if x)


def _bodies(spark: SparkSession, d: str, protocol: str) -> DataFrame:
    """A request a conversation: its turns, a tool, an effort, a seed; every fifth is too hot, every eleventh's seed too large.

    By conv_id modulo 6 there follow nothing, an image, a call and its result, a call without one, nothing but stops and a
    tool choice, or two calls whose results come the other way round."""
    g = table(spark, d, "conversations", "conv_id", "turn", "role", "text").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    turns = F.array_join(F.transform("m", lambda x: F.to_json(F.struct(x["role"].alias("role"), x["content"].alias("content")))), ",")
    k, number = F.pmod("conv_id", F.lit(6)), F.col("conv_id").cast("string")
    extra = F.when(k == 1, F.lit("," + _SHOWN[protocol]))
    for n, calls, answers in ((2, ("c#",), ("c#",)), (3, ("c#",), ()), (5, ("z", "y"), ("y", "z"))):
        extra = extra.when(k == n, F.lit("," + _more(protocol, calls, answers)))
    effort = F.element_at(F.array(*(F.lit(x).cast("string") for x in _EFFORTS[protocol][0])), (F.pmod("conv_id", F.lit(7)) + 1).cast("int"))
    at = {"chat_completions": '"reasoning_effort":{}', "messages": '"output_config":{{"effort":{}}}', "responses": '"reasoning":{{"effort":{}}}'}[protocol].split("{}")
    schema = '{"type":"object","title":"t#","b":1e-5,"a":[1.0,2]}'
    tool = {"chat_completions": f'{{"type":"function","function":{{"name":"f#","parameters":{schema}}}}}', "messages": f'{{"name":"f#","input_schema":{schema}}}', "responses": f'{{"type":"function","name":"f#","parameters":{schema}}}'}[protocol]
    choice = {
        "chat_completions": ',"stop":["a","b#"],"thinking":{"type":"disabled"},"tool_choice":{"type":"function","function":{"name":"f#"}}',
        "messages": ',"stop_sequences":["a","b#"],"thinking":{"type":"disabled"},"tool_choice":{"type":"tool","name":"f#"}', "responses": ',"tool_choice":"none"',
    }[protocol]
    seed = F.when(F.col("conv_id") % 11 == 0, "9223372036854775808").otherwise("7")
    heat = F.when(F.col("conv_id") % 5 == 0, "3.0").otherwise("0.5")
    quoted = F.coalesce(F.concat(F.lit('"'), effort, F.lit('"')), F.lit("null"))
    parts = ['{"model":"m#","' + ("input" if protocol == "responses" else "messages") + '":[', turns, F.coalesce(extra, F.lit("")), "],", at[0].replace("{{", "{"), quoted, at[1].replace("}}", "}") + ',"tools":[' + tool + '],"seed":', seed, ',"temperature":', heat, F.when(k == 4, choice).otherwise(""), "}"]
    filled = [x if isinstance(x, Column) and x is turns else F.replace(x if isinstance(x, Column) else F.lit(x), F.lit("#"), number) for x in parts]
    return g.select("conv_id", F.lit(protocol).alias("protocol"), F.concat(*filled).alias("body"))


def _convert(protocol: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = conversion.convert(_bodies(spark, sf_dir, protocol), "conv_id", protocols=(protocol,))
        said = F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "\n")
        images = F.array_join(F.flatten(F.transform("messages", lambda m: F.transform(m["images"], lambda i: F.concat_ws("|", i["kind"], i["url"], i["detail"])))), ",")
        calls = F.array_join(F.flatten(F.transform("messages", lambda m: F.transform(m["calls"], lambda x: F.concat_ws("|", x["id"], x["name"], x["arguments"])))), ",")
        answers = F.array_join(F.transform("messages", lambda m: m["tool_call_id"]), ",")
        return c.select(
            "conv_id", "ok", "error", "model", "thinking", "effort", F.get("tools", F.lit(0))["name"].alias("tool"), F.get("tools", F.lit(0))["parameters"].alias("parameters"), "tool_choice", F.array_join("stops", ",").alias("stops"),
            F.size("messages").cast("bigint").alias("n_messages"), F.sha2(said, 256).alias("said_sha256"), images.alias("images"), calls.alias("calls"), answers.alias("answers"),
        )

    blocks, items = protocol == "messages", protocol == "responses"
    asked, levels = _EFFORTS[protocol]
    level = "[" + ", ".join("NULL" if x is None else f"'{x}'" for x in levels) + "][conv_id % 7 + 1]"
    image = T.IMAGE
    turn = "CASE WHEN role = 'system' THEN 'user:<system-reminder>' || chr(10) || text || chr(10) || '</system-reminder>' ELSE role || ':' || text END" if blocks else "role || ':' || text"
    seen = f"chr(10) || 'user:see' || chr(10) || 'user:{image}'" if blocks else f"chr(10) || 'user:see' || chr(10) || chr(10) || '{image}'"
    unanswered = {
        "chat_completions": f"'{conversion.FOLLOW.replace(chr(39), chr(39) * 2)} (insufficient tool messages following tool_calls message)'",
        "messages": "'messages.' || (n + 1) || ':`tool_use` ids were found without `tool_result` blocks immediately after: c' || conv_id || '" + conversion.UNANSWERED + "'", "responses": "'No tool output found for tool call c' || conv_id || '.'",
    }[protocol]
    off = "k = 4" if not items else "false"
    thinks = f"NOT ({off}) AND {level} IS NOT NULL" if not blocks else f"NOT ({off})"
    seed = "" if blocks or items else "WHEN conv_id % 11 = 0 THEN 'seed must be in [0, 2^63)'"
    one = "{i} || '|f' || conv_id || '|{{\"n\": ' || conv_id || '}}'"
    two = [one.format(i="'z'"), one.format(i="'y'")]
    sql = f"""WITH g AS (SELECT conv_id, conv_id % 6 AS k, count(*)::BIGINT AS n, string_agg({turn}, chr(10) ORDER BY turn) AS s FROM conversations GROUP BY conv_id),
      e AS (SELECT *, CASE WHEN conv_id % 7 = 1 THEN 'unknown variant `{asked[1]}`, expected one of {_ALLOWED[protocol]}' WHEN conv_id % 5 = 0 THEN 'temperature must be in [0, 2]' {seed} WHEN k = 3 THEN {unanswered} END AS error,
        CASE k WHEN 1 THEN {seen} WHEN 2 THEN chr(10) || 'user:go' || chr(10) || 'assistant:' || chr(10) || 'tool:rc' || conv_id WHEN 5 THEN chr(10) || 'user:go' || chr(10) || 'assistant:' || chr(10) || 'tool:ry' || chr(10) || 'tool:rz' ELSE '' END AS more FROM g),
      f AS (SELECT *, {thinks} AS t FROM e)
      SELECT conv_id, error IS NULL AS ok, error, CASE WHEN error IS NULL THEN 'm' || conv_id END AS model, CASE WHEN error IS NULL THEN t END AS thinking, CASE WHEN error IS NULL AND t THEN {level} END AS effort,
      CASE WHEN error IS NULL {"AND k <> 4" if items else ""} THEN 'f' || conv_id END AS tool, CASE WHEN error IS NULL {"AND k <> 4" if items else ""} THEN '{{"type": "object", "title": "t' || conv_id || '", "b": 1e-05, "a": [1.0, 2]}}' END AS parameters,
      CASE WHEN error IS NULL THEN CASE WHEN k = 4 THEN '{"none" if items else "required"}' ELSE 'auto' END END AS tool_choice, CASE WHEN error IS NULL THEN {"''" if items else "CASE WHEN k = 4 THEN 'a,b' || conv_id ELSE '' END"} END AS stops,
      CASE WHEN error IS NULL THEN n + [0, {2 if blocks else 1}, 3, 0, 0, 4][k + 1] END AS n_messages, CASE WHEN error IS NULL THEN sha256(s || more) END AS said_sha256, CASE WHEN error IS NULL THEN CASE WHEN k = 1 THEN 'url|http://x/' || conv_id || '|high' ELSE '' END END AS images,
      CASE WHEN error IS NULL THEN CASE k WHEN 2 THEN 'c' || conv_id || '|f' || conv_id || '|{{"n": ' || conv_id || '}}' WHEN 5 THEN {" || ',' || ".join(sorted(two, reverse=not items))} ELSE '' END END AS calls,
      CASE WHEN error IS NULL THEN CASE k WHEN 2 THEN 'c' || conv_id WHEN 5 THEN 'y,z' ELSE '' END END AS answers FROM f"""
    query(sql, f"convert_{protocol}")(run)


for _p in conversion.CONVERTERS:
    _convert(_p)


_BROKEN = {  # by conv_id modulo 6: items behind the turns, and the error; @ stands for the number of the first of them
    1: ('{"type":"function_call","call_id":"","name":"f","arguments":"{}"}', "'Invalid ''input[' || n || '].call_id'': empty string. Expected a string with minimum length 1, but got an empty string instead.'"),
    2: ('{"type":"function_call","call_id":"a#","name":"f","arguments":"{}"},{"type":"function_call","call_id":"a#","name":"f","arguments":"{}"}', "'Duplicate ''call_id'': a' || conv_id || '.'"),
    3: ('{"type":"function_call","call_id":"a#","name":"f","arguments":"{}"},{"type":"function_call_output","call_id":"a#","output":"r"},{"type":"function_call_output","call_id":"a#","output":"r"}', "'Duplicate tool output for call_id: a' || conv_id || '.'"),
    4: ('{"type":"function_call","call_id":"a#","name":"f","arguments":"{}"},{"type":"function_call_output","call_id":"b#","output":"r"}', "'No tool call found for tool output with call_id b' || conv_id || '.'"),
    5: ('{"type":"function_call","call_id":"z#","name":"f","arguments":"{}"},{"type":"function_call","call_id":"b#","name":"f","arguments":"{}"},{"type":"function_call","call_id":"a#","name":"f","arguments":"{}"},{"type":"function_call_output","call_id":"z#","output":"r"},{"role":"user","content":"go"}', "'No tool output found for tool call b' || conv_id || '.'"),
}


@query("WITH g AS (SELECT conv_id, count(*) AS n FROM conversations GROUP BY conv_id) SELECT conv_id, CASE conv_id % 6 " + " ".join(f"WHEN {k} THEN {e}" for k, (_, e) in _BROKEN.items()) + " END AS error FROM g")
def call_output_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls and outputs that don't fit each other behind the turns of a conversation: the five ways, the first pending call named."""
    g = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content")))).alias("m"))
    turns = F.array_join(F.transform("m", lambda x: F.to_json(F.struct(x["role"].alias("role"), x["content"].alias("content")))), ",")
    extra = F.coalesce(*(F.when(F.pmod("conv_id", F.lit(6)) == k, F.replace(F.lit("," + items), F.lit("#"), F.col("conv_id").cast("string"))) for k, (items, _) in _BROKEN.items()), F.lit(""))
    bodies = g.select("conv_id", F.lit("responses").alias("protocol"), F.concat(F.lit('{"model":"m","input":['), turns, extra, F.lit("]}")).alias("body"))
    return conversion.convert(bodies, "conv_id", protocols=("responses",)).select("conv_id", "error")


if tokenizer_path():

    @query("SELECT doc_id, text AS back FROM documents")
    def tokenize_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Texts to ids and back."""
        t = tokenizer_file.Tokenizer.load(tokenizer_path())
        ids = tokenizer_file.encode(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text", t)
        return ids.select("doc_id", tokenizer_file.decode(ids, "ids", t).alias("back"))

    @query()
    def token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
        t = tokenizer_file.Tokenizer.load(tokenizer_path())
        return tokenizer_file.encode(table(spark, sf_dir, "documents", "doc_id", "text"), "doc_id", "text", t).select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"))

    @query()
    def encode_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Conversations rendered and encoded: (conv_id, n_tokens, ids_sha256)."""
        t = tokenizer_file.Tokenizer.load(tokenizer_path())
        df = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
        turns = df.select("conv_id", F.col("turn").cast("bigint").alias("idx"), "role", F.col("text").alias("content"))
        ids = tokenizer_file.encode(rendering.render(turns), "conv_id", "prompt", t)
        listed = F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")
        return ids.select("conv_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"))
