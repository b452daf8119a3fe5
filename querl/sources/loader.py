"""Bulk insert: delimited text into typed rows, read and checked by Spark in parallel.

A line holds one row; a terminator after the last field is allowed. Strings longer than declared are
cut. Dates are yyyy-mm-dd, yyyy/mm/dd or mm/dd/yyyy and must exist. Decimals have the declared scale;
further digits are cut. A line with too many or too few fields, or a field that is not of its type, is
an error that names the line's content. load() reads a file once, when it is asked to, and stores the
rows as Parquet, so its errors appear there and later statements read columns with statistics.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querl.errors import EngineError
from querl.functions import types as ty
from querl.functions.semantics import trunc_decimal


def _field(token: Column, t: ty.Type) -> Column:
    """The typed value of a field; null where it is malformed."""
    text = F.trim(token)
    if t.tag in ty.STRINGS:
        return F.substring(token, 1, t.length)
    if t.tag in ("int", "bigint"):
        return F.when(text.rlike(r"^-?[0-9]+$"), text.try_cast(t.spark))
    if t.tag == "decimal":
        number = F.when(text.rlike(r"^-?([0-9]+\.?[0-9]*|\.[0-9]+)$"), text.try_cast(f"decimal(38,{min(18, t.scale + 9)})"))
        return trunc_decimal(number, t.scale).try_cast(t.spark)
    if t.tag == "date":
        iso = F.regexp_replace(text, "/", "-")
        american = F.regexp_replace(text, r"^([0-9]{1,2})/([0-9]{1,2})/([0-9]{4})$", "$3-$1-$2")
        return F.when(text.rlike(r"^[0-9]{4}[-/][0-9]{1,2}[-/][0-9]{1,2}$"), iso.try_cast("date")).when(text.rlike(r"^[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}$"), american.try_cast("date"))
    if t.tag == "bool":
        return F.when(F.lower(text).isin("true", "1"), F.lit(True)).when(F.lower(text).isin("false", "0"), F.lit(False))
    return text.try_cast(t.spark)


def parse_lines(lines: DataFrame, columns: dict[str, ty.Type], terminator: str) -> DataFrame:
    """Typed rows of ``lines`` (value string); bad lines raise when they are read."""
    if len(terminator) != 1:
        raise EngineError("a field terminator is one character")
    quoted = "\\Q" + terminator + "\\E"
    n = len(columns)
    parts = F.split(F.col("value"), quoted, -1)
    # a terminator at the end of the line ends the last field; it doesn't begin another
    tokens = F.when((F.size(parts) == n + 1) & (F.element_at(parts, -1) == ""), F.slice(parts, 1, n)).otherwise(parts)
    split = lines.select("value", tokens.alias("tokens"))
    complaint = F.concat(F.lit(f"a line has not {n} fields: "), F.col("value"))
    fields = []
    for i, (name, t) in enumerate(columns.items()):
        value = _field(F.col("tokens")[i], t)
        wrong = F.concat(F.lit(f"not a value of {name} {t}: "), F.col("tokens")[i])
        fields.append(F.when(F.size("tokens") != n, F.raise_error(complaint)).otherwise(F.coalesce(value, F.raise_error(wrong))).cast(t.spark).alias(name))
    return split.select(*fields)


def read_delimited(spark: SparkSession, path: str, columns: dict[str, ty.Type], terminator: str = ",", first_row: int = 1) -> DataFrame:
    """The rows of a delimited file, from line ``first_row`` of it on (1: all)."""
    try:
        lines = spark.read.text(path)
    except Exception as e:
        raise EngineError(f"can't read {path}: {e}") from e
    if first_row > 1:  # numbers ascend within a block of the file, and the first block begins at 0
        numbered = lines.select("value", F.monotonically_increasing_id().alias("__n"), F.col("_metadata.file_block_start").alias("__at"))
        skipped = numbered.where("__at = 0").orderBy("__n").limit(first_row - 1).select("__n").collect()
        lines = numbered.where(~F.col("__n").isin([r["__n"] for r in skipped])).select("value")
    return parse_lines(lines.where(F.length("value") > 0), columns, terminator)


def stored_root(spark: SparkSession) -> str:
    """Where loaded tables are stored: a folder that driver and executors share."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return (named or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def load(spark: SparkSession, path: str, columns: dict[str, ty.Type], terminator: str = ",", first_row: int = 1) -> str:
    """Stores the rows of a delimited file as Parquet and gives the folder; a bad line stores nothing that is used."""
    rows = read_delimited(spark, path, columns, terminator, first_row)
    folder = f"{stored_root(spark)}/querl-tables/{uuid.uuid4().hex}"
    rows.write.parquet(folder)
    return folder
