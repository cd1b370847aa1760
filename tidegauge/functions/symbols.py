"""Canonical six-digit symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def zero_filled(text: Column, width: int = 6) -> Column:
    """Zeros in front, after a sign; longer texts stay whole (lpad alone would cut them)."""
    sign = F.regexp_extract(text, "^[+-]", 0)
    rest = F.regexp_replace(text, "^[+-]", "")
    missing = F.greatest(F.lit(0), F.lit(width) - F.length(text))
    return F.concat(sign, F.repeat(F.lit("0"), missing), rest)


def normalize_symbol(df: DataFrame, column: str) -> Column:
    """The symbol of a column of any simple type; '' where there is none."""
    kind, c = df.schema[column].dataType, F.col(f"`{column}`")
    if isinstance(kind, T.BooleanType):
        out = F.lit("")
    elif isinstance(kind, T.IntegralType):
        out = zero_filled(c.cast("string"))
    elif isinstance(kind, T.FractionalType):
        x = c.cast("double")
        whole = F.rint(x)
        near = F.abs(x - whole) < 1e-9
        out = F.when(F.isnan(x) | (F.abs(x) == float("inf")), "").when(near, zero_filled(whole.cast("decimal(38,0)").cast("string"))).otherwise(_from_text(c.cast("string")))
    else:
        out = _from_text(c.cast("string"))
    return F.coalesce(out, F.lit(""))


def _from_text(raw: Column) -> Column:
    s = F.regexp_replace(raw, r"^\s+|\s+$", "")
    digits = F.regexp_replace(s, "[^0-9]", "")
    number = F.regexp_replace(F.regexp_replace(s, r"\.0$", ""), r"^\+", "")
    stripped = F.regexp_replace(number, r"^(-?)0+(?=[0-9])", "$1")
    integer = zero_filled(F.when(stripped == "-0", "0").otherwise(stripped))
    return (
        F.when((s == "") | F.lower(s).isin("nan", "none", "null"), "")
        .when(s.rlike("^[0-9]+$"), zero_filled(F.right(s, F.lit(6))))
        .when(s.rlike(r"^[+-][0-9]+(\.0)?$") | s.rlike(r"^[0-9]+\.0$"), integer)
        .when(s.rlike(r"^[+-]{2,}[0-9]+(\.0)?$") | (digits == ""), "")
        .otherwise(zero_filled(F.right(digits, F.lit(6))))
    )


def is_symbol6(symbol: Column | str) -> Column:
    c = F.col(symbol) if isinstance(symbol, str) else symbol
    return F.coalesce(F.trim(c).rlike("^[0-9]{6}$"), F.lit(False))


def assert_symbol6(df: DataFrame, column: str, context: str = "symbols") -> DataFrame:
    bad = [r[0] for r in df.where(~is_symbol6(column)).select(column).limit(10).collect()]
    if bad:
        raise ValueError(f"{context}: not six digits: {bad}")
    return df
