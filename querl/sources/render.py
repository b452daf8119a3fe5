"""How results are written: every value as text, rows with bars, a console table, a file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from querl.functions import types as ty

CONSOLE_ROWS = 18
CONSOLE_WIDTH = 25


def text_of(c: Column, t: ty.Type) -> Column:
    """A value in the dialect's text form: fixed strings padded, dates with slashes, decimals at full scale."""
    if t.tag == "char":
        return F.rpad(c, t.length, " ")
    if t.tag == "date":
        return F.date_format(c, "yyyy/MM/dd")
    if t.tag == "decimal":
        return c.cast(f"decimal(38,{t.scale})").cast("string")
    return c.cast("string")


def rows_as_text(df: DataFrame, columns: dict[str, ty.Type]) -> DataFrame:
    """(value): every value followed by a bar."""
    parts = [x for n, t in columns.items() for x in (F.coalesce(text_of(F.col(f"`{n}`"), t), F.lit("")), F.lit("|"))]
    return df.select(F.concat(*parts).alias("value"))


def write_file(df: DataFrame, columns: dict[str, ty.Type], path: str) -> None:
    """Text files below ``path``; one file when the result is ordered and small enough for one task is the caller's choice."""
    rows_as_text(df, columns).write.mode("overwrite").text(path)


def console(df: DataFrame, columns: dict[str, ty.Type]) -> str:
    """A table of the first rows with names and types above, and the number of rows below."""
    names = list(columns)
    shown = df.select(*[text_of(F.col(f"`{n}`"), t).alias(n) for n, t in columns.items()]).limit(CONSOLE_ROWS).collect()
    cells = [names, [str(columns[n]) for n in names], *[[str(v if v is not None else "")[:CONSOLE_WIDTH] for v in r] for r in shown]]
    widths = [max(len(r[i]) for r in cells) for i in range(len(names))]
    line = "+".join("-" * (w + 2) for w in widths)
    body = [" | ".join(v.ljust(w) for v, w in zip(r, widths, strict=True)) for r in cells]
    return "\n".join([*body[:2], line, *body[2:], line, f"{df.count()} tuples"])
