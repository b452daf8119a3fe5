"""Byte-level BPE encoding and decoding with a two-tier lookup.

Tier one: a minimal perfect hash over the vocabulary resolves a whole pre-token that is itself a
token. Tier two: other pre-tokens are merged by a heap of adjacent pairs over linked bytes, lowest
rank first and leftmost among equals. Pre-tokens are those of the vocabulary's pattern; texts are
handled by their distinct chunks (see tokens.py), which gives the ids of the whole text.

Defined results: a null text is empty; an empty text has no ids; special tokens are ordinary text; texts of
any length are coded whole; of pairs with one rank the leftmost merges; every row gives a row, repeated
or with a null doc_id or not; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame

from querl.llm.common import flat, narrow, release, ship, slices
from querl.llm.tokens import ChunkEncoder

KEYS_PER_BUCKET = 4


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a tiktoken file in the order of their ranks, which must be 0, 1, 2, ..."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    tokens = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class PerfectHash:
    """A minimal perfect hash by hash-and-displace: key -> slot, each slot one key.

    A key's bucket names a seed under which all keys of the bucket fall into free slots; buckets
    are placed largest first, and a bucket of one key names its slot (as -1 - slot).
    """

    def __init__(self, seeds: np.ndarray, values: np.ndarray) -> None:
        self.seeds, self.values = seeds.tolist(), values.tolist()
        self.n_buckets, self.n = len(self.seeds), len(self.values)

    @staticmethod
    def _slots(h: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
        x = h[None, :] ^ (seeds[:, None] * np.uint64(0x9E3779B97F4A7C15))
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        return x % np.uint64(n)

    @classmethod
    def build(cls, keys: list[bytes]) -> PerfectHash:
        n = len(keys)
        h = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)
        n_buckets = max(1, n // KEYS_PER_BUCKET)
        bucket = (h % np.uint64(n_buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        sizes = np.bincount(bucket, minlength=n_buckets)
        firsts = np.cumsum(sizes) - sizes
        seeds, values, free = np.zeros(n_buckets, np.int64), np.zeros(n, np.int64), np.ones(n, bool)
        for b in np.argsort(-sizes, kind="stable").tolist():
            own = order[firsts[b] : firsts[b] + sizes[b]]
            if len(own) < 2:
                break
            at = 0
            while True:
                tried = cls._slots(h[own], np.arange(at, at + 64, dtype=np.uint64), n).astype(np.int64)
                good = free[tried].all(axis=1)
                for i in np.flatnonzero(good).tolist():
                    if len(set(tried[i].tolist())) == len(own):
                        break
                else:
                    at += 64
                    continue
                break
            seeds[b] = at + i
            free[tried[i]] = False
            values[tried[i]] = own
        left = np.flatnonzero(free)
        for slot, b in zip(left.tolist(), np.flatnonzero(sizes == 1).tolist(), strict=True):
            seeds[b] = -1 - slot
            values[slot] = order[firsts[b]]
        return cls(seeds, values)

    def find(self, key: bytes) -> int:
        """The number of the one key that ``key`` can be; the caller compares them."""
        h = xxhash.xxh3_64_intdigest(key)
        seed = self.seeds[h % self.n_buckets]
        if seed < 0:
            return self.values[-1 - seed]
        x = h ^ (seed * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
        x ^= x >> 32
        x = x * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF
        x ^= x >> 32
        return self.values[x % self.n]


class Bpe:
    """Encodes pre-tokens by ``tokens`` (in rank order) and decodes ids."""

    def __init__(self, tokens: list[bytes], pattern: str, table: PerfectHash | None = None) -> None:
        self.tokens = tokens
        self.pattern = regex.compile(pattern)
        self.table = table or PerfectHash.build(tokens)
        self.rank = {t: i for i, t in enumerate(tokens)}
        self.decimal = [b"%d" % i for i in range(len(tokens))]

    def word(self, word: bytes) -> list[int]:
        """The ids of one pre-token."""
        at = self.table.find(word)
        if self.tokens[at] == word:
            return [at]
        return self._merge(word)

    def _merge(self, word: bytes) -> list[int]:
        n, rank = len(word), self.rank
        ends = list(range(1, n + 1))  # where the part that begins here ends; 0: merged into an earlier part
        before = list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            r = rank.get(word[i : i + 2])
            if r is not None:
                heap.append((r, i, i + 2))
        heapq.heapify(heap)
        while heap:
            _, i, end = heapq.heappop(heap)
            middle = ends[i]
            if not middle or middle >= n or ends[middle] != end:
                continue  # one of the two parts has changed since
            ends[i], ends[middle] = end, 0
            if end < n:
                before[end] = i
                r = rank.get(word[i : ends[end]])
                if r is not None:
                    heapq.heappush(heap, (r, i, ends[end]))
            if i:
                p = before[i]
                r = rank.get(word[p:end])
                if r is not None:
                    heapq.heappush(heap, (r, p, end))
        out, i = [], 0
        while i < n:
            out.append(rank[word[i : ends[i]]])
            i = ends[i]
        return out

    def encode_many(self, chunks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the chunks back to back, and each chunk's number of ids."""
        ids: list[int] = []
        lengths = np.zeros(len(chunks), np.int64)
        for k, chunk in enumerate(chunks):
            had = len(ids)
            for w in self.pattern.findall(chunk.decode()):
                ids += self.word(w.encode())
            lengths[k] = len(ids) - had
        return np.array(ids, np.uint32), lengths

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


_made: dict[tuple[str, str], tuple[Bpe, ChunkEncoder]] = {}


def bpe_of(path: str, pattern: str, table: PerfectHash | None = None) -> tuple[Bpe, ChunkEncoder]:
    """The coder of a tiktoken file; one for each worker process."""
    if (path, pattern) not in _made:
        bpe = Bpe(read_ranks(path), pattern, table)
        _made[path, pattern] = bpe, ChunkEncoder(bpe.encode_many, spaced=True)
    return _made[path, pattern]


def _round_trip(batches: Iterator[pa.RecordBatch], path: str, pattern: str, table: PerfectHash) -> Iterator[pa.RecordBatch]:
    bpe, encoder = bpe_of(path, pattern, table)
    for batch in batches:
        data, offsets = flat(batch.column("text"))
        for a, b in slices(offsets):
            ids, counts = encoder.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            ends = np.cumsum(counts)
            hashes, decoded = [], []
            for e, c in zip(ends.tolist(), counts.tolist(), strict=True):
                own = ids[e - c : e].tolist()
                hashes.append(hashlib.sha256(b" ".join(map(bpe.decimal.__getitem__, own))).hexdigest())
                decoded.append(hashlib.sha256(bpe.decode(own)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").slice(a, b - a), pa.array(counts, pa.int64()), pa.array(hashes), pa.array(decoded)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )
        release()


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text."""
    ship(docs.sparkSession)
    table = PerfectHash.build(read_ranks(path))
    return narrow(docs).mapInArrow(
        partial(_round_trip, path=path, pattern=pattern, table=table),
        "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string",
    )


def _ids(batches: Iterator[pa.RecordBatch], path: str, pattern: str, table: PerfectHash) -> Iterator[pa.RecordBatch]:
    _, encoder = bpe_of(path, pattern, table)
    for batch in batches:
        data, offsets = flat(batch.column("text"))
        for a, b in slices(offsets):
            ids, counts = encoder.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            starts = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(starts), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(a, b - a), lists], ["doc_id", "ids"])


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, ids): the ids themselves."""
    ship(docs.sparkSession)
    table = PerfectHash.build(read_ranks(path))
    return narrow(docs).mapInArrow(partial(_ids, path=path, pattern=pattern, table=table), "doc_id long, ids array<int>")
