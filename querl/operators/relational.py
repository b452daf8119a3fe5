"""The operators of a plan as functions from DataFrame to DataFrame.

Each is declarative: Catalyst prunes columns, pushes predicates into scans and picks the physical
join. No operator broadcasts by hint; Spark broadcasts what it has measured to be small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querl.errors import EngineError


def scan(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A Parquet table, or the named columns of it."""
    df = spark.read.parquet(path)
    return df.select(*columns) if columns else df


def one_row(spark: SparkSession) -> DataFrame:
    """The leaf of a select without tables."""
    return spark.range(1).select()


def select(df: DataFrame, condition: Column | str) -> DataFrame:
    return df.where(condition)


def project(df: DataFrame, *columns: Column | str) -> DataFrame:
    """Any scalar expressions; repeated rows stay."""
    return df.select(*columns)


def hash_join(left: DataFrame, right: DataFrame, equalities: Sequence[tuple[Column | str, Column | str]]) -> DataFrame:
    """Inner equi-join on one or more pairs of expressions, each over one side."""
    if not equalities:
        raise EngineError("a hash join needs an equality")
    # each side's expressions become columns of their own first, so that names on both sides can't clash
    a, b = left, right
    condition = None
    for i, (x, y) in enumerate(equalities):
        a = a.withColumn(f"__l{i}", F.expr(x) if isinstance(x, str) else x)
        b = b.withColumn(f"__r{i}", F.expr(y) if isinstance(y, str) else y)
        one = F.col(f"__l{i}") == F.col(f"__r{i}")
        condition = one if condition is None else condition & one
    return a.join(b, condition, "inner").drop(*[f"__{s}{i}" for s in "lr" for i in range(len(equalities))])


def theta_join(left: DataFrame, right: DataFrame, condition: Column) -> DataFrame:
    """Inner join on any condition."""
    return left.join(right, condition, "inner")


def cross_product(left: DataFrame, right: DataFrame) -> DataFrame:
    """Every pair of rows; its size is the product of both, so only statements that ask for it use it."""
    return left.crossJoin(right)


def aggregate(df: DataFrame, groups: Sequence[Column | str], aggregates: Sequence[Column]) -> DataFrame:
    """Groups with aggregates; no groups: one row; no aggregates: the distinct groups."""
    keys = [F.expr(g) if isinstance(g, str) else g for g in groups]
    if not aggregates:
        return df.select(*keys).distinct()
    return df.groupBy(*keys).agg(*aggregates) if keys else df.agg(*aggregates)


def order_by(df: DataFrame, keys: Sequence[tuple[str, bool]]) -> DataFrame:
    """By output columns, each ascending or not."""
    return df.orderBy(*[F.col(name).asc() if ascending else F.col(name).desc() for name, ascending in keys])


def limit(df: DataFrame, n: int) -> DataFrame:
    return df.limit(n)
