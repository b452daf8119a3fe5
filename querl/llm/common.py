"""What the operators of this subpackage share: input, shared storage, code shipping, Arrow text access.

Intermediate tables go to the folder the cluster names in ``spark.checkpoint.dir``; a private folder
is used only where that setting is absent and everything runs on one machine (tests). Results read
these tables when they are computed; clear() deletes them once they are no longer needed.
"""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SLICE_BYTES = 4 << 20
"""Texts are handled in slices of about this many bytes (a longer document is a slice of its own)."""

BATCH_ROWS, MOST_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
"""Rows hold whole texts, so batches of Spark's usual 10,000 rows would take much memory."""

TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
"""While it is true, an execution's shuffle files are deleted when it ends."""

_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)

_own_root: dict[str, str] = {}
_shipped: set[str] = set()
_written: dict[str, list[str]] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ``documents`` table of ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder for intermediate tables that driver and executors share."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _own_root:
        _own_root[app] = "file://" + tempfile.mkdtemp(prefix="querl-shared-")
    return _own_root[app]


def cut(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back: lineage ends there.

    The table stands in for the shuffles that made it, so their files go once it is written.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(TIDY, "false")
    spark.conf.set(TIDY, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(TIDY, before)
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> int:
    """Deletes the tables that cut() has written for this application, once no result that reads them is needed; how many."""
    paths = _written.pop(spark.sparkContext.applicationId, [])
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
    return len(paths)


def cut_measured(df: DataFrame, label: str, **measures) -> tuple[DataFrame, dict]:
    """cut() with aggregates of the rows taken while they are written."""
    seen = Observation()
    return cut(df.observe(seen, *[c.alias(n) for n, c in measures.items()]), label), seen.get


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors' Python workers, once per application, and keeps Arrow batches small."""
    sc = spark.sparkContext
    if int(spark.conf.get(BATCH_ROWS)) > MOST_ROWS:
        spark.conf.set(BATCH_ROWS, MOST_ROWS)
    if sc.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    out = os.path.join(tempfile.mkdtemp(prefix="querl-code-"), "querl_code.zip")
    with zipfile.ZipFile(out, "w") as z:
        for folder, _, names in os.walk(top):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(top)))
    sc.addPyFile(out)
    _shipped.add(sc.applicationId)


def release() -> None:
    """Gives the memory that is free in this worker back to the machine; called between groups of work."""
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def narrow(docs: DataFrame, *more: str) -> DataFrame:
    """``doc_id`` and ``text`` (null text: empty) and ``more``; other columns can't clash after this."""
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        *[F.col(c) for c in more],
    )


def flat(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string or binary column back to back, and the len+1 offsets."""
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays([c.cast(pa.large_binary()) for c in col.chunks]) if col.num_chunks else pa.array([], pa.large_binary())
    col = pc.fill_null(col.cast(pa.large_binary()), b"")
    if not len(col):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offs, data = col.buffers()
    offsets = np.frombuffer(offs, np.int64)[col.offset : col.offset + len(col) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of rows of at most ``limit`` bytes, or of one row."""
    n, at = len(offsets) - 1, 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1
        to = min(n, max(at + 1, to))
        yield at, to
        at = to


def blocks_of(docs: DataFrame, target_bytes: int) -> int:
    """How many blocks of about ``target_bytes`` hold all texts: one pass that reads lengths only."""
    total = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    return max(1, -(-int(total) // target_bytes))
