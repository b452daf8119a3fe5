"""A select as one DataFrame: joins, filter, groups, projection, order and limit, left to Catalyst."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querl.errors import EngineError
from querl.functions import semantics as sem
from querl.functions import types as ty
from querl.operators import relational as ops
from querl.plans.expressions import Typed, compile
from querl.plans.syntax import Node, Select
from querl.sources.catalog import Catalog

ONE_TASK_BYTES = 128 << 20
"""A table of fewer bytes may be a single row group, which one task reads."""


@dataclass
class Planned:
    """A result: its rows and the declared types of its columns."""

    rows: DataFrame
    columns: dict[str, ty.Type]


def _bytes(rows: DataFrame) -> int:
    """Spark's estimate of a table's size."""
    return int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def _dealt(tables: list[DataFrame]) -> list[DataFrame]:
    """Tables to be joined, the largest dealt over all cores if one task may read it all.

    Joins run in the tasks that read the largest table while the others are broadcast, and an equality of columns that
    aren't unique makes many rows of each: a few MB read by one task would leave all of those to it. Streams stay as they are.
    """
    if len(tables) < 2 or any(t.isStreaming for t in tables):
        return tables
    sizes = [_bytes(t) for t in tables]
    largest = sizes.index(max(sizes))
    if sizes[largest] >= ONE_TASK_BYTES:
        return tables
    cores = tables[0].sparkSession.sparkContext.defaultParallelism
    return [t.repartition(cores) if i == largest else t for i, t in enumerate(tables)]


class Scope:
    """The columns of the tables of a select; names in more than one table can't be used."""

    def __init__(self, catalog: Catalog, tables: list[str]) -> None:
        self.columns: dict[str, list[Typed]] = {}
        self.order: list[tuple[str, str, ty.Type]] = []
        self.rows: DataFrame | None = None
        if len(set(tables)) < len(tables):
            raise EngineError("a table appears twice; tables have no aliases")
        dealt = _dealt([catalog.get(name).rows for name in tables])
        for i, (name, rows) in enumerate(zip(tables, dealt, strict=True)):
            table = catalog.get(name)
            own = rows.select(*[F.col(f"`{c}`").alias(f"{c}@{i}") for c in table.columns])
            self.rows = own if self.rows is None else ops.cross_product(self.rows, own)  # the filter makes joins of it
            for c, t in table.columns.items():
                self.columns.setdefault(c, []).append((F.col(f"`{c}@{i}`"), t))
                self.order.append((c, f"{c}@{i}", t))

    def resolve(self, node: Node) -> Typed | None:
        if node.kind != "name":
            return None
        found = self.columns.get(node.value, [])
        if len(found) > 1:
            raise EngineError(f"column {node.value} is in more than one table")
        return found[0] if found else None


def _output_names(columns: list[tuple[Node, str | None]]) -> list[str]:
    names = [alias or (e.value if e.kind == "name" else f"expr{i}") for i, (e, alias) in enumerate(columns)]
    if len(set(names)) < len(names):
        raise EngineError("two columns of the result have one name")
    return names


def _grouped(q: Select, rows: DataFrame, scope: Scope) -> tuple[DataFrame, dict[Node, Typed]]:
    """Rows by group, and what the group expressions and aggregates have become."""
    known: dict[Node, Typed] = {}
    keys, values = [], []
    for i, g in enumerate(q.groups):
        c, t = compile(g, scope.resolve)
        keys.append((F.rtrim(c) if t.tag == "char" else c).alias(f"g{i}"))  # trailing blanks tell no groups of fixed-length strings apart
        known[g] = F.col(f"g{i}"), t
    wanted = dict.fromkeys(n for e, _ in q.columns for n in e.walk() if n.kind == "aggregate")
    for i, a in enumerate(wanted):
        value, t = compile(a.parts[0], scope.resolve) if a.parts else (F.lit(1), None)
        kind = ty.aggregate(a.value, t)
        if t is not None and t.tag == "int" and a.value in ("sum", "avg"):
            value = value.cast("bigint")
        if a.value == "count":
            values.append((F.count("*") if t is None else F.count(value)).alias(f"a{i}"))
        elif a.value == "avg" and kind.tag == "decimal":
            values += [F.sum(value).alias(f"a{i}"), F.count(value).alias(f"n{i}")]
            known[a] = sem.avg_trunc(F.col(f"a{i}"), F.col(f"n{i}"), kind.scale - 2), kind
            continue
        else:
            values.append({"sum": F.sum, "avg": F.avg, "min": F.min, "max": F.max}[a.value](value).alias(f"a{i}"))
        known[a] = F.col(f"a{i}"), kind
    return ops.aggregate(rows, keys, values), known


def plan(q: Select, catalog: Catalog) -> Planned:
    """The rows a select asks for."""
    scope = Scope(catalog, q.tables)
    rows = scope.rows if scope.rows is not None else ops.one_row(catalog.spark)
    if q.where is not None:
        condition, t = compile(q.where, scope.resolve)
        if t.tag != "bool":
            raise EngineError(f"where needs a condition, not {t}")
        rows = ops.select(rows, condition)
    if not q.columns:
        if q.groups:
            raise EngineError("select * can't be grouped")
        names = [c for c, _, _ in scope.order]
        if len(set(names)) < len(names):
            raise EngineError("select * over tables that share a column name")
        out = ops.project(rows, *[F.col(f"`{inner}`").alias(c) for c, inner, _ in scope.order])
        columns = {c: t for c, _, t in scope.order}
    else:
        names = _output_names(q.columns)
        if q.groups or any(n.kind == "aggregate" for e, _ in q.columns for n in e.walk()):
            rows, known = _grouped(q, rows, scope)
            resolve = known.get
        else:
            resolve = scope.resolve
        typed = [compile(e, resolve) for e, _ in q.columns]
        out = ops.project(rows, *[c.alias(n) for (c, _), n in zip(typed, names, strict=True)])
        columns = {n: t for (_, t), n in zip(typed, names, strict=True)}
    for name, _ in q.order:
        if name not in columns:
            raise EngineError(f"order by needs a column of the result, not {name}")
    if q.order:
        out = ops.order_by(out, q.order)
    if q.limit is not None:
        out = ops.limit(out, q.limit)
    return Planned(out, columns)
