"""A folder of delimited files as a table that grows: the loader's rules, read as a stream.

A select over it is planned like any other; filters and projections stream in append mode, groups in
complete or update mode.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from querl.functions import types as ty
from querl.sources.catalog import Catalog, Table
from querl.sources.loader import parse_lines


def stream_table(catalog: Catalog, name: str, folder: str, columns: dict[str, ty.Type], terminator: str = ",") -> Table:
    """Registers the files that are and will be in ``folder`` as table ``name``."""
    lines = catalog.spark.readStream.text(folder).where(F.length("value") > 0)
    return catalog.register(name, parse_lines(lines, columns, terminator), columns)
