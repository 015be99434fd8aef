"""JSON text: strict parsing with key order kept, Python-style and compact output."""

from __future__ import annotations

import json
import math
import re
from typing import Any

import pandas as pd
from pyspark.sql import functions as F

_LONE = re.compile("[\ud800-\udfff]")


def _integer(lexeme: str) -> int | float:
    n = int(lexeme)
    return n if -(2**63) <= n < 2**64 and lexeme != "-0" else _real(lexeme)


def _real(lexeme: str) -> float:
    x = float(lexeme)
    if math.isinf(x):
        raise ValueError(f"number out of range: {lexeme}")
    return x


def _never(lexeme: str) -> None:
    raise ValueError(f"not JSON: {lexeme}")


def parse(text: str) -> Any:
    """Strict JSON; objects keep first positions and last values; 64-bit integers stay exact, out-of-range reals are errors."""
    return json.loads(text, parse_int=_integer, parse_float=_real, parse_constant=_never)


def _clean(value: Any) -> Any:
    if isinstance(value, str):
        return _LONE.sub("�", value)
    if isinstance(value, float) and not math.isfinite(value):
        return None
    if isinstance(value, dict):
        return {_clean(k): _clean(v) for k, v in value.items()}
    return [_clean(v) for v in value] if isinstance(value, list) else value


def python_style(value: Any) -> str:
    return json.dumps(_clean(value), ensure_ascii=False)


def compact_number(x: float) -> str:
    """Fixed notation for decimal exponents from -5 to 15, else d.ddde+N."""
    if not math.isfinite(x):
        return "null"
    sign, digits = ("-" if math.copysign(1, x) < 0 else ""), repr(abs(x))
    mantissa, _, exp = digits.partition("e")
    whole, _, frac = mantissa.partition(".")
    number = (whole + frac).lstrip("0")
    if not number.strip("0"):
        return sign + "0.0"
    lead = len(whole + frac) - len(number)
    e = int(exp or 0) + len(whole) - 1 - lead
    number = number.rstrip("0")
    if -5 <= e <= 15:
        if e < 0:
            return f"{sign}0.{'0' * (-e - 1)}{number}"
        number = number.ljust(e + 1, "0")
        return f"{sign}{number[: e + 1]}.{number[e + 1 :] or '0'}"
    return f"{sign}{number[0]}{'.' + number[1:] if len(number) > 1 else ''}e{'+' if e > 0 else ''}{e}"


def compact(value: Any) -> str:
    if isinstance(value, dict):
        return "{" + ",".join(f"{compact(k)}:{compact(v)}" for k, v in value.items()) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(compact, value)) + "]"
    return compact_number(value) if isinstance(value, float) else json.dumps(_clean(value), ensure_ascii=False)


def escape_body(text: str) -> str:
    return python_style(text)[1:-1]


def _over(make):  # noqa: ANN001, ANN202
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        def one(x: str | None) -> str | None:
            try:
                return None if x is None else make(parse(x))
            except (ValueError, RecursionError):
                return None

        return s.map(one, na_action=None)

    return run


def to_python_style(column):  # noqa: ANN001, ANN201
    """JSON text to Python-style JSON text; null where it isn't JSON."""
    return _over(python_style)(column)


def to_compact(column):  # noqa: ANN001, ANN201
    return _over(compact)(column)
