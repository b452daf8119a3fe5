"""Declared tables: names, columns with their types, and the DataFrame that holds the rows."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from querl.errors import EngineError
from querl.functions import types as ty


@dataclass
class Table:
    """A table's columns, in order, and its rows: those of DataFrames given to it and of folders that loads have stored."""

    name: str
    columns: dict[str, ty.Type]
    rows: DataFrame | None = None
    given: list[DataFrame] = field(default_factory=list)
    folders: list[str] = field(default_factory=list)


class Catalog:
    """One flat namespace of tables, as long as the session."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.tables: dict[str, Table] = {}

    def create(self, name: str, columns: dict[str, ty.Type]) -> Table:
        """A new, empty table."""
        if name in self.tables:
            raise EngineError(f"table {name} exists")
        if not columns:
            raise EngineError(f"table {name} has no columns")
        return self._keep(Table(name, dict(columns)))

    def register(self, name: str, rows: DataFrame, declared: dict[str, ty.Type] | None = None) -> Table:
        """A table over a DataFrame; ``declared`` gives types Spark doesn't have (char, varchar)."""
        columns = {f.name: (declared or {}).get(f.name) or ty.of_spark(f.dataType) for f in rows.schema}
        return self._keep(Table(name, columns, given=[rows]))

    def append(self, name: str, rows: DataFrame) -> None:
        table = self.get(name)
        table.given.append(rows)
        self._keep(table)

    def add_folder(self, name: str, folder: str) -> None:
        """Rows stored as Parquet join the table; all its folders are one scan."""
        table = self.get(name)
        table.folders.append(folder)
        self._keep(table)

    def get(self, name: str) -> Table:
        if name not in self.tables:
            raise EngineError(f"no table {name}")
        return self.tables[name]

    def _keep(self, table: Table) -> Table:
        schema = T.StructType([T.StructField(c, t.spark) for c, t in table.columns.items()])
        stored = [self.spark.read.schema(schema).parquet(*table.folders)] if table.folders else []
        table.rows = reduce(DataFrame.unionByName, [*table.given, *stored]) if table.given or stored else self.spark.createDataFrame([], schema)
        self.tables[table.name] = table
        table.rows.createOrReplaceTempView(table.name)
        return table

    def listing(self) -> list[tuple[str, int, int]]:
        """Name, number of columns and of rows of every table."""
        return [(n, len(t.columns), t.rows.count()) for n, t in sorted(self.tables.items())]
