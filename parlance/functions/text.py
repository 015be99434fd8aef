"""Predicates and pre-tokenization of texts, all native."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tokens import IMAGE

# The word pattern and the CJK and kana ranges of the pre-tokenizer.
WORD = r"[!\"#$%&'()*+,\-./:;<=>?@\[\\\]^_`{|}~][A-Za-z]+|[^\r\n\p{L}\p{P}\p{S}]?[\p{L}\p{M}]+| ?[\p{P}\p{S}]+[\r\n]*|\s*[\r\n]+|\s+(?!\S)|\s+"
CJK = r"[一-龥぀-ゟ゠-ヿ]"


def tool_name_ok(name: Column) -> Column:
    return F.rlike(name, F.lit(r"\A[A-Za-z0-9_-]{1,128}\z"))


def names_json(text: Column) -> Column:
    return F.rlike(text, F.lit("(?i)json"))


def has_image_token(text: Column) -> Column:
    return F.contains(text, F.lit(IMAGE))


def digit_pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\p{N}{1,3}|\P{N}+"), F.lit(0))


def cjk_pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(f"{CJK}+|(?:(?!{CJK})[\\s\\S])+"), F.lit(0))


def word_pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(rf"(?U)(?:{WORD})|(?:(?!{WORD})[\s\S])+"), F.lit(0))


def pieces(text: Column) -> Column:
    """The three splits, each within the pieces of the one before."""
    cjk = F.flatten(F.transform(digit_pieces(text), cjk_pieces))
    return F.flatten(F.transform(cjk, word_pieces))


#: Fixed value: the pattern of the plain byte-level pre-tokenizer.
BYTE_LEVEL = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_level_pieces(text: Column) -> Column:
    """The one split of tokenizer files whose pre-tokenizer is byte-level with its own pattern."""
    return F.regexp_extract_all(text, F.lit(f"(?U){BYTE_LEVEL}"), F.lit(0))


def first_cut(text: Column, stops: list[str]) -> Column:
    """The text up to the first stop sequence; empty ones are ignored."""
    at = [F.when(F.locate(s, text) > 0, F.locate(s, text)) for s in stops if s]
    if not at:
        return text
    first = F.least(*at) if len(at) > 1 else at[0]
    return F.when(first.isNotNull(), F.substring(text, F.lit(1), first - 1)).otherwise(text)
