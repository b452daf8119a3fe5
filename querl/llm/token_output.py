"""Token-id output: frequency-ranked ids in byte-aligned variable-length coding, controls kept apart.

File format. A corpus is a table ``shards`` and a table ``ranks``. Ids are numbered by falling
frequency (ties: smaller id first); a rank takes 1 to 4 little-endian bytes. A shard row holds the
documents of a stretch of the doc_id order: their ids and token counts, the control bytes (four
2-bit lengths each, first token in the low bits) and the data bytes back to back. Shards are
numbered by (part, seq), and doc_id ascends over them. Decoding takes the lengths of four tokens
from a 256-entry table and everything else by numpy indexing.

Defined results: a null text is empty and yields its end id alone; null doc_ids come first; repeated
doc_ids are written one after the other, ordered by their ids; an empty table gives an empty corpus;
an end id beyond 32 bits is an error. Long texts are encoded whole; other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querl.llm.common import cut, flat, narrow, release, ship, slices
from querl.llm.tokens import library_encoder

SHARD_TOKENS = 1 << 20
PART_TOKENS = 4 << 20
MOST_PARTS = 4096
"""Parts are sorted as streams, so a part may hold any number of tokens."""

LENGTHS = np.array([[(c >> (2 * k) & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)
MASKS = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """Control bytes and data bytes of unsigned 32-bit ranks."""
    r = np.ascontiguousarray(ranks, "<u4")
    extra = (r > 0xFF).astype(np.uint8) + (r > 0xFFFF) + (r > 0xFFFFFF)
    codes = np.zeros(-(-len(r) // 4) * 4, np.uint8)
    codes[: len(r)] = extra
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    data = r.view(np.uint8).reshape(-1, 4)[np.arange(4, dtype=np.uint8) <= extra[:, None]]
    return control.tobytes(), data.tobytes()


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The ``n`` ranks of encode_ranks()."""
    lengths = LENGTHS[np.frombuffer(control, np.uint8)].ravel()[:n]
    at = np.cumsum(lengths, dtype=np.int64) - lengths
    d = np.frombuffer(data + b"\0\0\0", np.uint8).astype(np.uint32)
    out = d[at]
    for k in (1, 2, 3):
        out |= d[at + k] << np.uint32(8 * k)
    return out & MASKS[lengths]


def id_type(path: str, end_id: int) -> str:
    """The integers that hold every id of a tokenizers file and the end id."""
    from tokenizers import Tokenizer

    largest = max(end_id, *Tokenizer.from_file(path).get_vocab(with_added_tokens=True).values())
    if not 0 <= end_id <= largest < 1 << 32:
        raise ValueError(f"ids up to {largest} and the end id {end_id} don't fit 32 bits")
    return "<u2" if largest < 1 << 16 else "<u4"


def _tokenize(batches: Iterator[pa.RecordBatch], path: str, end_id: int, dtype: str) -> Iterator[pa.RecordBatch]:
    encoder = library_encoder(path, spaced=True)
    for batch in batches:
        data, offsets = flat(batch.column("text"))
        for a, b in slices(offsets):
            ids, counts = encoder.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            full = np.full(len(ids) + len(counts), end_id, dtype)
            ends = np.cumsum(counts + 1)
            body = np.ones(len(full), bool)
            body[ends - 1] = False
            full[body] = ids
            width = full.itemsize
            bounds = np.concatenate([[0], ends]) * width
            blob = full.tobytes()
            rows = [blob[x:y] for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(a, b - a), pa.array(counts + 1, pa.int64()), pa.array(rows, pa.binary())],
                ["doc_id", "n_tokens", "ids"],
            )
        release()


def tokenize(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """(doc_id, n_tokens, ids): ids and the end id as the integers of id_type(), little-endian."""
    ship(docs.sparkSession)
    dtype = id_type(path, end_id)
    return narrow(docs).mapInArrow(partial(_tokenize, path=path, end_id=end_id, dtype=dtype), "doc_id long, n_tokens long, ids binary")


def _count(batches: Iterator[pa.RecordBatch], dtype: str) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(1, np.int64)
    for batch in batches:
        ids = flat(batch.column("ids"))[0].view(dtype)
        own = np.bincount(ids, minlength=len(seen))
        own[: len(seen)] += seen
        seen = own
    some = np.flatnonzero(seen)
    yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(seen[some], pa.int64())], ["id", "n"])


def rank_ids(tokens: DataFrame, dtype: str = "<u2") -> np.ndarray:
    """Ids by falling frequency. At most one entry for each id of the vocabulary comes to the driver."""
    counts = tokens.select("ids").mapInArrow(partial(_count, dtype=dtype), "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    rows = counts.toPandas()
    order = np.lexsort((rows["id"].to_numpy(), -rows["n"].to_numpy())) if len(rows) else []
    return rows["id"].to_numpy(np.int64)[order]


SHARD_SCHEMA = "part int, seq int, part_start long, n_tokens long, doc_ids array<long>, counts array<long>, control binary, data binary"


def _write_shards(batches: Iterator[pa.RecordBatch], by_rank: np.ndarray, dtype: str) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    rank_of = np.zeros(int(by_rank.max()) + 1 if len(by_rank) else 1, np.uint32)
    rank_of[by_rank] = np.arange(len(by_rank), dtype=np.uint32)
    seq = start = held = 0
    docs: list = []
    counts: list[int] = []
    ids: list[np.ndarray] = []

    def shard() -> pa.RecordBatch:
        control, data = encode_ranks(rank_of[np.concatenate(ids)])
        values = [[part], [seq], [start], [held], [docs], [counts], [control], [data]]
        kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        names = [x.split()[0] for x in SHARD_SCHEMA.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names)

    for batch in batches:
        data, offsets = flat(batch.column("ids"))
        ns = batch.column("n_tokens").to_pylist()
        for i, doc in enumerate(batch.column("doc_id").to_pylist()):
            docs.append(doc)
            counts.append(ns[i])
            ids.append(data[offsets[i] : offsets[i + 1]].view(dtype))
            held += ns[i]
            if held >= SHARD_TOKENS:
                yield shard()
                release()
                seq, start, held, docs, counts, ids = seq + 1, start + held, 0, [], [], []
    if docs:
        yield shard()


def write_corpus(docs: DataFrame, path: str, end_id: int) -> tuple[DataFrame, DataFrame]:
    """Tokenizes ``docs`` and writes the corpus to the shared folder; the tables ``shards`` and ``ranks`` (rank, id)."""
    dtype = id_type(path, end_id)
    tokens = cut(tokenize(docs, path, end_id), "tokens")
    by_rank = rank_ids(tokens, dtype)
    total = tokens.agg(F.sum("n_tokens").alias("n")).first()["n"] or 0
    parts = max(1, min(MOST_PARTS, -(-total // PART_TOKENS)))
    ordered = tokens.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "n_tokens", "ids")
    shards = cut(ordered.mapInArrow(partial(_write_shards, by_rank=by_rank, dtype=dtype), SHARD_SCHEMA), "shards")
    ranks = docs.sparkSession.createDataFrame(pd.DataFrame({"rank": np.arange(len(by_rank)), "id": by_rank}), "rank long, id long")
    return shards, cut(ranks, "ranks")


def _read_shards(batches: Iterator[pa.RecordBatch], by_rank: np.ndarray, base: dict[int, int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            ids = by_rank[decode_ranks(row["control"], row["data"], row["n_tokens"])].astype("<u4")
            counts = np.array(row["counts"], np.int64)
            ends = np.cumsum(counts)
            raw = memoryview(ids.tobytes())
            crcs = [zlib.crc32(raw[4 * (e - c) : 4 * e]) for e, c in zip(ends.tolist(), counts.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(row["doc_ids"], pa.int64()),
                    pa.array(base[row["part"]] + row["part_start"] + ends - counts, pa.int64()),
                    pa.array(counts, pa.int64()),
                    pa.array(crcs, pa.int64()),
                ],
                ["doc_id", "start", "n_tokens", "ids_crc32"],
            )
            release()


def read_corpus(shards: DataFrame, ranks: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) from the files. The ranks and one total for each part come to the driver."""
    by_rank = ranks.orderBy("rank").toPandas()["id"].to_numpy(np.int64)
    totals = shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).orderBy("part").collect()
    base, at = {}, 0
    for r in totals:
        base[r["part"]] = at
        at += r["n"]
    return shards.mapInArrow(partial(_read_shards, by_rank=by_rank, base=base), "doc_id long, start long, n_tokens long, ids_crc32 long")
