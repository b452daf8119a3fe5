"""Column functions where the dialect means something else than Spark: all exact, all in the JVM."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F


def trunc_decimal(c: Column, scale: int) -> Column:
    """Digits beyond ``scale`` are cut, not rounded."""
    return F.when(c >= 0, F.floor(c, F.lit(scale))).otherwise(F.ceil(c, F.lit(scale))).cast(f"decimal(38,{scale})")


def trunc_bigint(c: Column) -> Column:
    """The integer part."""
    return c.cast("bigint")


def int_div(a: Column, b: Column) -> Column:
    """Integer division, truncating toward zero."""
    return F.call_function("div", a.cast("bigint"), b.cast("bigint"))


def avg_trunc(total: Column, count: Column, scale: int) -> Column:
    """total / count, cut at ``scale`` + 2 digits, where ``scale`` is that of the summed values."""
    digits = scale + 2
    shifted = (total.cast("decimal(38,%d)" % scale) * F.lit(Decimal(10) ** digits)).cast("decimal(38,0)")
    whole = F.call_function("div", shifted, count.cast("decimal(20,0)"))
    return (whole.cast("decimal(19,0)") * F.lit(Decimal(1).scaleb(-digits))).cast(f"decimal(38,{digits})")


def char_eq(a: Column, b: Column) -> Column:
    """Equality of fixed-length strings: trailing blanks don't count."""
    return F.rtrim(a) == F.rtrim(b)


def char_eq_constant(c: Column, text: str) -> Column:
    """char_eq() with a constant. The prefix is implied; scans can skip by it, which they can't by a trimmed column."""
    text = text.rstrip(" ")
    return c.startswith(F.lit(text)) & (F.rtrim(c) == F.lit(text)) if text else F.rtrim(c) == F.lit(text)


def like(c: Column, pattern: str) -> Column:
    """% and _ match as usual; a backslash is an ordinary character."""
    return c.like(pattern.replace("\\", "\\\\"))
