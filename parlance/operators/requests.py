"""Request checks: ordered validators (the first error wins), policies, enumerations, usage figures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Finish reasons of the three dialects.
FINISH = {
    "chat_completions": {"stop": "stop", "stop_sequence": "stop", "length": "length", "content_filter": "content_filter", "tool_calls": "tool_calls", "end_of_stream": "stop"},
    "messages": {"stop": "end_turn", "stop_sequence": "stop_sequence", "length": "max_tokens", "content_filter": "refusal", "tool_calls": "tool_use", "end_of_stream": "end_turn"},
    "responses": {"stop": "completed", "stop_sequence": "completed", "length": "incomplete", "content_filter": "incomplete", "tool_calls": "completed", "end_of_stream": "completed"},
}


def first_error(*checks: tuple[Column, str | Column]) -> Column:
    """The message of the first check that fails, or null."""
    return F.coalesce(*(F.when(bad, F.lit(m) if isinstance(m, str) else m) for bad, m in checks))


def sampling_error(n: Column | None = None, max_tokens: Column | None = None, temperature: Column | None = None, top_p: Column | None = None, frequency_penalty: Column | None = None, presence_penalty: Column | None = None, seed: Column | None = None) -> Column:
    """Limits of the sampling options; absent (null) ones pass."""
    outside = lambda c, low, high: F.isnan(c) | (c < low) | (c > high)
    checks = []
    if n is not None:
        checks.append((n != 1, "n must be 1"))
    for name, c in (("frequency_penalty", frequency_penalty), ("presence_penalty", presence_penalty)):
        if c is not None:
            checks.append((outside(c, -2, 2), f"{name} must be between -2 and 2"))
    if max_tokens is not None:
        checks.append((max_tokens <= 0, "max_tokens must be greater than 0"))
    if temperature is not None:
        checks.append((outside(temperature, 0, 2), "temperature must be between 0 and 2"))
    if top_p is not None:
        checks.append((F.isnan(top_p) | (top_p <= 0) | (top_p > 1), "top_p must be greater than 0 and at most 1"))
    if seed is not None:
        checks.append((seed >= F.lit(2**63 - 1).cast("decimal(20,0)") + 1, "seed is out of range"))
    return first_error(*checks)


def finish_reason(dialect: str, reason: Column) -> Column:
    return F.create_map(*(F.lit(x) for kv in FINISH[dialect].items() for x in kv))[reason]


def web_search(tools: Column, policy: str) -> tuple[Column, Column]:
    """The tools without web search and the error: `ignore` drops such tools, `reject` refuses them."""
    kept = F.filter(tools, lambda t: t != "web_search")
    return kept, F.when(F.lit(policy == "reject") & F.array_contains(tools, "web_search"), "web search is not supported")


def thinking_chat(thinking: Column, effort: Column, default: bool = True) -> Column:
    """thinking, then effort, then the default; effort `none` turns it off."""
    on = F.when(thinking.isNotNull(), thinking.isin("enabled", "adaptive")).when(effort.isNotNull(), effort != "none").otherwise(default)
    return F.struct(on.alias("thinking"), F.when(on, F.when(effort.isNull() | (effort == "none"), "high").otherwise(effort)).alias("effort"))


def usage(dialect: str, prompt: Column, hit: Column, completion: Column) -> Column:
    miss = F.greatest(F.lit(0), prompt - hit)
    if dialect == "chat_completions":
        return F.struct(prompt.alias("prompt_tokens"), completion.alias("completion_tokens"), (prompt + completion).alias("total_tokens"), hit.alias("prompt_cache_hit_tokens"), miss.alias("prompt_cache_miss_tokens"))
    if dialect == "messages":
        return F.struct(miss.alias("input_tokens"), completion.alias("output_tokens"), hit.alias("cache_read_input_tokens"), F.lit(0).cast("bigint").alias("cache_creation_input_tokens"))
    return F.struct(prompt.alias("input_tokens"), hit.alias("cached_tokens"), completion.alias("output_tokens"), F.lit(0).cast("bigint").alias("reasoning_tokens"), (prompt + completion).alias("total_tokens"))
