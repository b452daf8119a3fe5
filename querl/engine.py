"""The session's surface: statements, scripts and control commands."""

from __future__ import annotations

import re
import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import SparkSession

from querl.errors import EngineError
from querl.plans import planner, syntax
from querl.sources import loader, render
from querl.sources.catalog import Catalog

FLAGS = ("showplan", "tofile", "showperf", "showasm", "showfln", "optimize", "emitmc")
"""On or off. optimize and emitmc are accepted and shown; Catalyst and the JVM do what they stood for."""
COMMAND = re.compile(r"\s*(\w+)\s*(?:=\s*(\w+)\s*)?;?\s*$")
RESULT_FILE = "qres.tbl"


@contextmanager
def spark_errors() -> Iterator[None]:
    """Spark's errors, in planning or while rows are computed, as EngineError."""
    try:
        yield
    except (PySparkException, Py4JJavaError) as e:
        raise EngineError(str(e)) from e


@dataclass
class Result:
    """What a statement gave: rows with declared types, or a message; seconds to plan it and, with showperf, to run it."""

    message: str = ""
    planned: planner.Planned | None = None
    seconds: float = 0.0
    run_seconds: float = 0.0

    @property
    def rows(self):
        return self.planned.rows if self.planned else None

    def fetch(self) -> list[tuple]:
        """All rows, on the driver; what goes wrong while they are computed is an EngineError."""
        with spark_errors():
            return [tuple(r) for r in self.planned.rows.collect()] if self.planned else []

    def text(self) -> str:
        with spark_errors():
            return render.console(self.planned.rows, self.planned.columns) if self.planned else self.message


class Engine:
    """One flat catalog and the settings of its control commands."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark
        self.catalog = Catalog(spark)
        self.flags = dict.fromkeys(FLAGS, False)
        self.threads = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.result_path = RESULT_FILE

    def execute(self, statement: str) -> Result:
        """Carries out one statement or control command."""
        control = self._control(statement)
        if control is not None:
            return control
        began = time.perf_counter()
        with spark_errors():
            tree = syntax.parse(statement)
            if isinstance(tree, syntax.CreateTable):
                self.catalog.create(tree.name, tree.columns)
                out = Result(f"created table {tree.name}")
            elif isinstance(tree, syntax.BulkInsert):
                columns = self.catalog.get(tree.table).columns
                self.catalog.add_folder(tree.table, loader.load(self.spark, tree.path, columns, tree.terminator, tree.first_row))
                out = Result(f"loaded {tree.path} into {tree.table}")
            else:
                out = Result(planned=planner.plan(tree, self.catalog))
            out.seconds = time.perf_counter() - began
            if out.planned:
                self._show(out)
        return out

    def _show(self, out: Result) -> None:
        planned = out.planned
        if self.flags["showplan"]:
            planned.rows.explain("formatted")
        if self.flags["showasm"] or self.flags["showfln"]:
            planned.rows.explain("codegen")
        if self.flags["tofile"]:
            render.write_file(planned.rows, planned.columns, self.result_path)
        if self.flags["showperf"]:
            began = time.perf_counter()
            planned.rows.write.format("noop").mode("overwrite").save()
            out.run_seconds = time.perf_counter() - began
            print(f"planned in {out.seconds * 1000:.1f} ms, run in {out.run_seconds * 1000:.1f} ms")

    def _control(self, statement: str) -> Result | None:
        m = COMMAND.match(statement)
        if not m:
            files = re.match(r"\s*exec\s+(\S+?)\s*;?\s*$", statement)
            return self.run_file(files[1]) if files else None
        name, value = m.groups()
        if name in FLAGS:
            if value is not None:
                if value not in ("true", "false"):
                    raise EngineError(f"{name} is true or false")
                self.flags[name] = value == "true"
            return Result(f"{name}={str(self.flags[name]).lower()}")
        if name == "threads":
            if value is not None:
                if not value.isdigit() or not int(value):
                    raise EngineError("threads is a positive number")
                self.threads = int(value)
                self.spark.conf.set("spark.sql.shuffle.partitions", value)
            return Result(f"threads={self.threads}")
        if name == "tables" and value is None:
            return Result("\n".join(f"{n}: {k} attributes, {rows} tuples" for n, k, rows in self.catalog.listing()))
        return None

    def run_script(self, text: str) -> list[Result]:
        """Every statement of a script, in order."""
        return [self.execute(s) for s in syntax.split_statements(text)]

    def run_file(self, path: str) -> Result:
        """A script file's statements; the result is the last one's."""
        try:
            with open(path, encoding="utf-8") as f:
                text = f.read()
        except OSError as e:
            raise EngineError(f"can't read {path}: {e}") from e
        results = self.run_script(text)
        return results[-1] if results else Result()
