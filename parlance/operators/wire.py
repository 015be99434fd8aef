"""Reading request fields out of a VARIANT: typed access, and an error text where a field doesn't hold what it should.

All functions take and give columns. An error column is null where nothing is wrong; `first` picks the one that wins."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

C = Column
#: A body longer than a VARIANT holds, or one that isn't JSON, has none.
_LONE = r"(?i)(?<!\\)((?:\\\\)*)(?:\\u(d[89ab][0-9a-f]{2})(?!\\ud[c-f][0-9a-f]{2})|(?<!\\ud[89ab][0-9a-f]{2})\\u(d[c-f][0-9a-f]{2}))"


def clean(body: C) -> C:
    """JSON text with escapes of lone surrogates replaced by U+FFFD."""
    return F.when(body.rlike(r"(?i)\\ud[89a-f]"), F.regexp_replace(body, _LONE, r"$1\\ufffd")).otherwise(body)


def parsed(body: C) -> C:
    """The object that a body holds, as a VARIANT; null if it is anything else, or more than one value."""
    listed = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), body, F.lit("]"))), "$", "array<variant>")
    return F.when(F.size(listed) == 1, F.get(listed, F.lit(0)))


def let(value: C, then: Callable[[C], C]) -> C:
    """A value that is used several times, worked out once."""
    return F.transform(F.array(value), then)[0]


def first(*errors: C) -> C:
    return F.coalesce(*errors, F.lit(None).cast("string"))


def first_of(rows: C, error: Callable[[C], C]) -> C:
    """The first error of an array's rows."""
    return F.get(F.filter(F.transform(rows, error), lambda e: e.isNotNull()), F.lit(0))


def said(*parts: C | str) -> C:
    return F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))


def fail(when: C, *parts: C | str) -> C:
    return F.when(when, said(*parts))


def child(v: C, name: str) -> C:
    return F.variant_get(v, f"$.{name}", "variant")


def absent(v: C) -> C:
    """Missing or null."""
    return v.isNull() | F.is_variant_null(v)


def kind(v: C) -> C:
    return F.schema_of_variant(v)


def items(v: C) -> C:
    return F.try_variant_get(v, "$", "array<variant>")


def is_object(v: C) -> C:
    return F.try_variant_get(v, "$", "map<string,variant>").isNotNull()


def text(v: C) -> C:
    return F.when(kind(v) == "STRING", F.variant_get(v, "$", "string"))


def flag(v: C) -> C:
    return F.when(kind(v) == "BOOLEAN", F.variant_get(v, "$", "boolean"))


def whole(v: C) -> C:
    """A whole number without fraction or exponent, of up to 38 digits."""
    return F.when(kind(v).rlike(r"\A(BIGINT|DECIMAL\((19|2\d|3\d),0\))\z"), F.try_variant_get(v, "$", "decimal(38,0)"))


def real(v: C) -> C:
    return F.when(kind(v).rlike(r"\A(BIGINT|DOUBLE|DECIMAL.*)\z"), F.variant_get(v, "$", "double"))


def need_text(v: C, name: str, needed: bool = False) -> C:
    wrong = fail(~absent(v) & text(v).isNull(), f"invalid type: expected a string for `{name}`")
    return first(fail(absent(v), f"missing field `{name}`"), wrong) if needed else wrong


def need_flag(v: C, name: str) -> C:
    return fail(~absent(v) & flag(v).isNull(), f"invalid type: expected a boolean for `{name}`")


def need_whole(v: C, name: str, most: int) -> C:
    n = whole(v)
    return fail(~absent(v) & ~F.coalesce((n >= 0) & (n <= F.lit(Decimal(most))), F.lit(False)), f"invalid value: expected `{name}` to be a whole number in [0, {most}]")


def need_real(v: C, name: str) -> C:
    return fail(~absent(v) & ~F.coalesce(F.abs(real(v)) <= 3.4028235677973366e38, F.lit(False)), f"invalid type: expected a number for `{name}`")


def need_object(v: C, name: str) -> C:
    return fail(~absent(v) & ~is_object(v), f"invalid type: expected an object for `{name}`")


def need_items(v: C, name: str) -> C:
    return fail(~absent(v) & items(v).isNull(), f"invalid type: expected a list for `{name}`")


def one_of(value: C, allowed: Sequence[str], listed: str | None = None) -> C:
    """Errors of a value that is there but not among those allowed."""
    expected = listed or "one of " + ", ".join(f"`{x}`" for x in allowed)
    return fail(value.isNotNull() & ~value.isin(*allowed), "unknown variant `", value, f"`, expected {expected}")


def json_string(value: C) -> C:
    """Compact JSON of a string: lower-case escapes, nothing but control characters, quotes and backslashes escaped."""
    plain = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    short = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r"}
    bare = plain
    for code in range(32):
        bare = F.replace(bare, F.lit(chr(code)), F.lit(short.get(code, f"\\u{code:04x}")))
    return F.concat(F.lit('"'), F.when(value.rlike(r"[\x00-\x1f]"), bare).otherwise(plain), F.lit('"'))
