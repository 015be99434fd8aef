"""Operator 6, quality rules: line-first cleaning with DataFrame functions only.

Every line is judged by itself (punctuation, navigation, boilerplate); failing lines go; then a document
goes that fails the base rules or has lost too much of its text. One narrow pass, no shuffle: all of a
document's figures come from arrays built inside its row.

Edge cases: null and empty texts have no words, so they fail the base rules and their cleaned text is
empty; a null doc_id is kept as it is; repeated rows are judged row by row; an empty table gives an empty
one; `judge` hands on other columns, whatever their names, but one called as its own result (`name`), which
gives way to it. Scripts without marks at the end of sentences would fail the rule on long lines without one: `unended_words=None` turns it off.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, table, words


@dataclass(frozen=True)
class Rules:
    min_words: int = 50
    max_repeat_percent: int = 50
    #: Punctuation: a line fails with more than so many symbols, or runs of '!' and '?', for 100 words.
    max_symbol_percent: int = 30
    max_shout_percent: int = 30
    #: Punctuation: a line of so many words or more fails if no mark in it ends a sentence; None: never.
    unended_words: int | None = 20
    #: Navigation: a line fails with that many separators or more, for 100 words.
    max_separator_percent: int = 30
    #: Boilerplate: phrases of site furniture, looked for in lines of at most so many words.
    boilerplate: tuple[str, ...] = ("cookie policy", "privacy policy", "terms of use", "terms of service", "all rights reserved", "enable javascript", "lorem ipsum", "click here to", "skip to content", "subscribe to our newsletter")
    #: The same in other languages of the table.
    boilerplate_elsewhere: tuple[str, ...] = ("alle rechte vorbehalten", "datenschutzerklärung", "nutzungsbedingungen", "zum inhalt springen", "newsletter abonnieren", "tous droits réservés", "politique de confidentialité", "conditions d'utilisation", "mentions légales", "aller au contenu", "todos los derechos reservados", "política de privacidad", "condiciones de uso", "aviso legal", "saltar al contenido")
    boilerplate_words: int = 30
    #: A document goes when failing lines held more than this share of its word characters.
    max_lost_percent: int = 50

    @property
    def phrases(self) -> str:
        """The boilerplate as one pattern for (?i:): by first letters, and other than ASCII letters in both cases."""
        by: dict[str, list[str]] = {}
        for p in (*self.boilerplate, *self.boilerplate_elsewhere):
            spelled = "".join(c if c.isascii() and c.isalnum() or c in " '" else f"[{c.lower()}{c.upper()}]" if c.isalpha() else re.escape(c) for c in p)
            by.setdefault(p[0], []).append(spelled.removeprefix(p[0]))
        return "|".join(f"{first}(?:{'|'.join(rest)})" if first.isascii() and (first.isalnum() or first in " '") else "|".join(rest) for first, rest in sorted(by.items()))


#: Marks that end a sentence.
MARKS = "[.!?…。！？｡؟।]"


def _count(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(F.translate(text, characters, ""))


def _same(a: Column, b: Column, w: Column) -> Column:
    x, y = a["i"], b["i"]
    return F.coalesce((a["h"] == b["h"]) & (F.get(w, x) == F.get(w, y)) & (F.get(w, x + 1) == F.get(w, y + 1)) & (F.get(w, x + 2) == F.get(w, y + 2)), F.lit(False))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """The input's columns with `_n_words` and so on behind them; `judge` turns them into verdicts.

    n_repeat_words counts the word positions under 3-word windows that occur twice or more. Windows get a 64-bit
    hash; where all hashes of a row differ, nothing repeats. Else they are sorted inside the row, and neighbours
    of equal hash count if their words agree too."""
    df = docs.withColumn("_t", F.coalesce(F.col(text), F.lit(""))).withColumn("_w", words(F.col("_t")))
    w, h = F.col("_w"), F.col("_h")
    df = df.withColumn("_v", F.transform(w, lambda x: F.xxhash64(x)))
    df = df.withColumn("_h", F.slice(F.transform(F.col("_v"), lambda x, i: F.xxhash64(x, F.get(F.col("_v"), i + 1), F.get(F.col("_v"), i + 2))), F.lit(1), F.greatest(F.size(w) - 2, F.lit(0))))
    df = df.withColumn("_repeats", F.size(h) > F.size(F.array_distinct(h)))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    df = df.withColumn("_k", F.when(F.col("_repeats"), F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))).otherwise(none))
    k = F.col("_k")
    found = F.filter(k, lambda x, j: _same(x, F.get(k, j - 1), w) | _same(x, F.get(k, j + 1), w))
    df = df.withColumn("_p", F.sort_array(F.transform(found, lambda x: x["i"])))
    covered = F.aggregate(F.col("_p"), F.struct(F.lit(-3).alias("last"), F.lit(0).cast("bigint").alias("n")), lambda a, x: F.struct(x.alias("last"), (a["n"] + F.least(F.lit(3), x - a["last"])).alias("n")), lambda a: a["n"])
    return df.withColumns({
        "_n_words": F.size("_w").cast("bigint"),
        "_word_chars": F.length(F.translate(F.col("_t"), SPACES, "")).cast("bigint"),
        "_n_symbols": F.regexp_count(F.col("_t"), F.lit("[#*$%&|<>]")).cast("bigint"),
        "_n_repeat_words": covered,
        "_lines": F.split(F.col("_t"), "\n"),
    }).drop("_k", "_p", "_w", "_v", "_h", "_repeats")


def _suspect(text: Column, rules: Rules) -> Column:
    """False if no line of the text can fail but for its end: the other rules need one of these characters or phrases."""
    return F.rlike(text, F.lit(r"[#*$%&<>!?|»›•·]" + (f"|(?i:{rules.phrases})" if rules.phrases else "")))


def _ended(line: Column, rules: Rules) -> Column:
    """False for a long line without an end of a sentence."""
    return F.lit(True) if rules.unended_words is None else F.rlike(line, F.lit(MARKS)) | (_count(line, SPACES) + 1 < rules.unended_words)


def _keeps(line: Column, rules: Rules) -> Column:
    """Whether a line passes the line rules; a blank line does."""
    n_words = _count(line, SPACES) + 1  # runs of spaces only make the rules milder
    symbols, shouts, separators = _count(line, "#*$%&<>"), _count(line, "!?"), _count(line, "|»›•·")
    few = n_words <= rules.boilerplate_words
    phrases = F.rlike(line, F.lit(f"(?i:{rules.phrases})")) if rules.phrases else F.lit(False)
    too_many = lambda n, percent, least: (n >= least) & (100 * n > percent * n_words)
    return _ended(line, rules) & ~(too_many(symbols, rules.max_symbol_percent, 3) | too_many(shouts, rules.max_shout_percent, 6) | too_many(separators, rules.max_separator_percent, 3) | (few & phrases))


def judge(docs: DataFrame, rules: Rules = Rules(), text: str = "text", name: str = "verdict") -> DataFrame:
    """The input's columns with the struct `name` behind them: figures, base_failed, kept and the cleaned text."""
    columns, docs = docs.columns, docs.select(F.struct("*").alias("_doc"), F.col(text).alias("text"))
    spaced = F.transform(F.col("_lines"), lambda x: F.struct(x.alias("line"), F.length(F.translate(x, SPACES, "")).cast("bigint").alias("c")))
    df = measure(docs).withColumn("_lines", spaced)
    df = df.withColumn("_good", F.when(_suspect(F.col("_t"), rules), F.filter(F.col("_lines"), lambda x: _keeps(x["line"], rules))).otherwise(F.filter(F.col("_lines"), lambda x: _ended(x["line"], rules))))
    with_word = F.transform(F.filter(F.col("_lines"), lambda x: x["c"] > 0), lambda x: x["line"])
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + x["c"])
    df = df.withColumns({
        "_with_word": with_word,
        "_kept_chars": total(F.col("_good")),
        "_base": (F.col("_n_words") < rules.min_words) | (100 * F.col("_n_repeat_words") > rules.max_repeat_percent * F.col("_n_words")),
    })
    lost = F.col("_word_chars") - F.col("_kept_chars")
    verdict = F.struct(
        F.col("_n_words").alias("n_words"), F.col("_word_chars").alias("word_chars"), F.col("_n_symbols").alias("n_symbols"),
        (F.size("_with_word") - F.size(F.array_distinct("_with_word"))).cast("bigint").alias("n_dup_lines"),
        F.col("_n_repeat_words").alias("n_repeat_words"), F.col("_base").alias("base_failed"),
        (~F.col("_base") & (100 * lost <= rules.max_lost_percent * F.col("_word_chars"))).alias("kept"),
        lost.alias("lost_chars"), (F.size("_lines") - F.size("_good")).cast("bigint").alias("n_lines_removed"),
        F.array_join(F.transform(F.col("_good"), lambda x: x["line"]), "\n").alias("cleaned_text"),
    )
    return df.select(*(F.col("_doc")[c].alias(c) for c in columns if c.lower() != name.lower()), verdict.alias(name))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines_removed")
    return judge(table(spark, sf_dir, "documents", "doc_id", "text")).select("doc_id", *(F.col("verdict")[f].alias(f) for f in fields))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline: rejected documents go, the others keep their cleaned text."""
    named = docs.select(F.struct(*docs.columns).alias("_doc"), F.col("text").alias("text"))
    # a filter on the verdict would be pushed down and spell all of its expressions out again and again
    judged = judge(named).withColumn("_v", F.col("verdict"))
    kept = judged.select("_doc", F.explode_outer(F.when(F.col("_v")["kept"], F.array(F.col("_v")["cleaned_text"]))).alias("_clean")).filter(F.col("_clean").isNotNull())
    of = {"text": F.col("_clean"), "n_chars": F.length("_clean").cast("bigint")}
    return kept.select(*(of.get(c, F.col("_doc")[c]).alias(c) for c in docs.columns))
