"""Money: exact decimals, normalised to million units with half-up rounding to one place."""

from __future__ import annotations

import re
from decimal import ROUND_HALF_UP, Decimal, InvalidOperation

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewell.functions import patterns as P
from tracewell.functions.text import strip


def parse_money(c: Column) -> Column:
    """``(1,234.5)`` is negative; anything that is not a number becomes NULL."""
    raw = strip(c)
    negative = raw.rlike(r"^\(.*\)$")
    bare = F.regexp_replace(F.when(negative, strip(F.substring(raw, F.lit(2), F.length(raw) - 2))).otherwise(raw), ",", "")
    value = bare.try_cast("decimal(38,6)")
    return F.when(negative, -value).otherwise(value)


def million_value(value: Column, unit: Column) -> Column:
    """Value in million units as decimal(38,1); NULL for an unknown unit or value."""
    factor = None
    for name, ratio in P.MONEY_FACTORS.items():
        test = strip(unit) == name
        number = F.lit(Decimal(ratio)).cast("decimal(18,6)")
        factor = F.when(test, number) if factor is None else factor.when(test, number)
    return F.round(parse_money(value).cast("decimal(25,6)") * factor, 1).cast("decimal(38,1)")


def format_million(value: Column) -> Column:
    """Thousands separators; one decimal place unless the value is whole."""
    whole = value == F.floor(value)
    grouped = F.regexp_replace(F.abs(value).cast("decimal(38,1)").cast("string"), r"(?<=\d)(?=(?:\d{3})+\.)", ",")
    short = F.when(whole, F.regexp_replace(grouped, r"\.0$", "")).otherwise(grouped)
    return F.when(value < 0, F.concat(F.lit("-"), short)).otherwise(short)


def normalize_money(value: Column, unit: Column) -> Column:
    """Struct (text, unit, normalized); unknown input passes through unchanged."""
    million = million_value(value, unit)
    known = million.isNotNull()
    return F.struct(
        F.when(known, format_million(million)).otherwise(value.cast("string")).alias("text"),
        F.when(known, P.MILLION_UNIT).otherwise(unit).alias("unit"),
        (known & (strip(unit) != P.MILLION_UNIT)).alias("normalized"),
    )


# Fixed value: an amount with its unit in running text.
_AMOUNT = re.compile(r"(\(?[+-]?\d[\d,]*(?:\.\d+)?\)?)\s*(백만원|억원|만원|천원|원)(?![가-힣])")


def _amount_in_million(hit: re.Match[str]) -> str:
    written, unit = hit.groups()
    sign = -1 if written[0] == "(" and written[-1] == ")" else 1
    try:
        number = sign * Decimal((written[1:-1] if sign < 0 else written).replace(",", ""))
    except InvalidOperation:
        return written + unit
    tenths = (number * Decimal(P.MONEY_FACTORS[unit])).quantize(Decimal("0.1"), ROUND_HALF_UP)
    shown = f"{tenths:,.1f}".removesuffix(".0")
    return ("0" if shown == "-0" else shown) + P.MILLION_UNIT


@F.pandas_udf(T.StringType())
def rewrite_amounts(texts: pd.Series) -> pd.Series:
    """Amounts inside running text; a replacement computed per match has no SQL form."""
    return texts.map(lambda t: _AMOUNT.sub(_amount_in_million, t), na_action="ignore")
