"""Best-fit packing of tokenized documents into sequences by a grouping genetic algorithm.

A document longer than a sequence is cut into full pieces and a rest; full pieces are sequences of
their own. All other pieces are spread over districts of bounded size. In each district a few
islands evolve packings: an individual is a set of bins; crossover injects whole well-filled bins of
one parent into the other, removes the bins that hold duplicates, and puts the displaced pieces back
by best fit; mutation empties the worst-filled bins and refits their pieces. Fitness is the number
of bins, then the mean of squared fills (the Falkenauer cost). After each epoch an island's elite moves to the next
island of the ring. An island starts from best fit over falling lengths and stops where its packing meets
the lower bound, as nothing can better it; where many short pieces fill every gap, as in prose, that is
often at once. A district's best packing keeps its well-filled bins; the pieces of the others
go to the next level, where districts are fewer, until one district is left or nothing changes.

Individuals use multisets of lengths: pieces of one length are interchangeable, so a bin is a tuple
of lengths, and the pieces take their places at the end, in the order of (doc_id, piece, digest).

Defined results: a null text is empty and packs as its end id alone; repeated and null doc_ids are documents
of their own; a text of any length is tokenized whole and cut into pieces; pieces of one length are ties,
which any order packs alike; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import random
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from functools import partial
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from querl.llm.common import cut, flat, narrow, release, ship, slices
from querl.llm.tokens import library_encoder

CAPACITY = 2048
DISTRICT = 6000
"""Pieces in a district, about."""
ISLANDS = 2
EPOCHS = 3
GENERATIONS = 30
POPULATION = 8
MOST_TASKS = 2048
KEEP_FILL = 0.995
"""Bins filled at least so far are final at their level."""
LEVELS = 4
END_ID = 0

Bin = tuple[int, ...]


# Pieces ----------------------------------------------------------------------------------------

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int) -> Iterator[pa.RecordBatch]:
    encoder = library_encoder(path, spaced=False)
    names = [x.split()[0] for x in PIECES.split(", ")]
    for batch in batches:
        data, offsets = flat(batch.column("text"))
        for a, b in slices(offsets):
            ids, counts = encoder.encode(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            ids = ids.astype("<u4")
            ends = np.cumsum(counts)
            rows = []
            for doc, end, n in zip(batch.column("doc_id").slice(a, b - a).to_pylist(), ends.tolist(), counts.tolist(), strict=True):
                raw = ids[end - n : end].tobytes() + END_ID.to_bytes(4, "little")
                for piece, at in enumerate(range(0, n + 1, capacity)):
                    own = raw[4 * at : 4 * (at + capacity)]
                    rows.append((doc, piece, at, len(own) // 4, zlib.crc32(own)))
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
        release()


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every document, its end id included."""
    ship(docs.sparkSession)
    return narrow(docs).mapInArrow(partial(_pieces, path=path, capacity=capacity), PIECES)


# The genetic algorithm on lengths ----------------------------------------------------------------


class Open:
    """Bins under construction: best fit finds the fullest one that still has room."""

    def __init__(self, capacity: int, bins: list[Bin] = ()) -> None:
        self.capacity = capacity
        self.bins = [list(b) for b in bins]
        self.rooms: list[tuple[int, int]] = sorted((capacity - sum(b), i) for i, b in enumerate(self.bins))

    def put(self, length: int) -> None:
        at = bisect_left(self.rooms, (length, -1))
        if at < len(self.rooms):
            room, i = self.rooms.pop(at)
        else:
            room, i = self.capacity, len(self.bins)
            self.bins.append([])
        self.bins[i].append(length)
        if room > length:
            insort(self.rooms, (room - length, i))

    def done(self) -> list[Bin]:
        return [tuple(sorted(b, reverse=True)) for b in self.bins if b]


def best_fit(lengths: list[int], capacity: int, bins: list[Bin] = ()) -> list[Bin]:
    """``bins`` with ``lengths`` put in, in their order, by best fit."""
    out = Open(capacity, bins)
    for n in lengths:
        out.put(n)
    return out.done()


def fitness(bins: list[Bin], capacity: int) -> tuple[int, float]:
    """Fewer bins are better, then more uneven fills: larger is better."""
    return -len(bins), sum((sum(b) / capacity) ** 2 for b in bins) / max(len(bins), 1)


def lower_bound(lengths: list[int], capacity: int) -> int:
    """No packing has fewer bins: total size, and pieces over half plus what can't join them."""
    total = -(-sum(lengths) // capacity)
    large = [n for n in lengths if 2 * n > capacity]
    best = max(total, len(large))
    for k in sorted({n for n in lengths if 2 * n <= capacity})[:: max(1, capacity // 64)]:
        alone = sum(n > capacity - k for n in lengths)
        mid = [n for n in large if n <= capacity - k]
        small = sum(n for n in lengths if k <= n and 2 * n <= capacity)
        best = max(best, alone + len(mid) + max(0, -(-(small - (len(mid) * capacity - sum(mid))) // capacity)))
    return best


def crossover(a: list[Bin], b: list[Bin], capacity: int, rng: random.Random) -> list[Bin]:
    """``a`` with well-filled bins of ``b`` injected."""
    ranked = sorted(b, key=sum, reverse=True)
    top = ranked[: max(1, len(ranked) // 2)]
    injected = rng.sample(top, max(1, len(top) // rng.randint(2, 6)))
    taken = Counter(n for x in injected for n in x)
    kept, displaced = [], []
    for x in rng.sample(a, len(a)):
        own = Counter(x)
        if all(taken[n] == 0 for n in own):
            kept.append(x)
            continue
        for n in x:  # the bin held a duplicate and goes; its other pieces are displaced
            if taken[n]:
                taken[n] -= 1
            else:
                displaced.append(n)
    return best_fit(sorted(displaced, reverse=True), capacity, kept + injected)


def mutate(bins: list[Bin], capacity: int, rng: random.Random) -> list[Bin]:
    """Empties the worst-filled bins and a few others and refits their pieces."""
    ranked = sorted(bins, key=sum)
    n = max(2, len(ranked) // 20)
    gone = set(range(n)) | set(rng.sample(range(len(ranked)), min(n, len(ranked))))
    loose = [x for i in gone for x in ranked[i]]
    if rng.random() < 0.5:
        loose.sort(reverse=True)
    else:
        rng.shuffle(loose)
    return best_fit(loose, capacity, [x for i, x in enumerate(ranked) if i not in gone])


def evolve(lengths: list[int], elite: list[list[Bin]], capacity: int, seed: int, generations: int = GENERATIONS, population: int = POPULATION) -> list[Bin]:
    """The best individual of an island that starts from ``elite``."""
    rng = random.Random(seed)
    falling = sorted(lengths, reverse=True)
    least = lower_bound(lengths, capacity)

    def scored(bins: list[Bin]) -> tuple[tuple[int, float], list[Bin]]:
        return fitness(bins, capacity), bins  # computed once for each individual

    score = itemgetter(0)
    people = [scored(x) for x in elite] or [scored(best_fit(falling, capacity))]
    best = max(people, key=score)
    if -best[0][0] <= least:
        return best[1]  # it can't be bettered
    while len(people) < population:
        noisy = sorted(falling, key=lambda n: n * rng.uniform(0.85, 1), reverse=True)
        people.append(scored(best_fit(noisy, capacity)))
    for _ in range(generations):
        a, b = rng.sample(people, 2)
        children = [crossover(a[1], b[1], capacity, rng), mutate(max(people, key=score)[1], capacity, rng)]
        people = sorted(people + [scored(x) for x in children], key=score, reverse=True)[:population]
        if -people[0][0][0] <= least:
            break
    return people[0][1]


def _pack_bins(bins: list[Bin]) -> tuple[bytes, bytes]:
    return np.array([len(b) for b in bins], "<u4").tobytes(), np.array([n for b in bins for n in b], "<u4").tobytes()


def _unpack_bins(sizes: bytes, lengths: bytes) -> list[Bin]:
    flat_lengths, out, at = np.frombuffer(lengths, "<u4").tolist(), [], 0
    for k in np.frombuffer(sizes, "<u4").tolist():
        out.append(tuple(flat_lengths[at : at + k]))
        at += k
    return out


ISLAND = "district long, island int, bins int, fill double, sizes binary, lengths binary"


def _island(key, table: pa.Table, capacity: int, epoch: int, islands: int) -> pa.Table:
    """One island's epoch: its rows are its elite and the one that came, or, before the first, the pieces as one bin."""
    district, island = key[0].as_py(), key[1].as_py()
    elite = [_unpack_bins(r["sizes"], r["lengths"]) for r in table.select(["sizes", "lengths"]).to_pylist()]
    lengths = [n for b in elite[0] for n in b]
    people = [] if epoch == 0 else elite
    best = evolve(lengths, people, capacity, seed=(district * islands + island) * 1009 + epoch)
    score = fitness(best, capacity)
    row = (district, island, -score[0], score[1], *_pack_bins(best))
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.binary(), pa.binary())
    return pa.Table.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], [x.split()[0] for x in ISLAND.split(", ")])


def _epoch(capacity: int, epoch: int, islands: int):
    return lambda key, t: _island(key, t, capacity, epoch, islands)


def _start(key, table: pa.Table) -> pa.Table:
    """A district's pieces as one bin of all lengths, for each island to start from."""
    n = table.column("length").to_pylist()
    sizes, lengths = _pack_bins([tuple(n)])
    return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int64()), pa.array([sizes], pa.binary()), pa.array([lengths], pa.binary())], ["district", "sizes", "lengths"])


def best_packings(items: DataFrame, districts: int, capacity: int, islands: int, epochs: int) -> DataFrame:
    """(district, sizes, lengths): the best packing of each of the ``districts`` of ``items`` (district, length)."""
    tasks = min(MOST_TASKS, districts * islands)  # the rows are few and small, the work on each is not
    started = items.groupBy("district").applyInArrow(lambda key, t: _start(key, t), "district long, sizes binary, lengths binary")
    held = started.withColumn("island", F.explode(F.array(*[F.lit(i) for i in range(islands)])))
    for epoch in range(epochs):
        if epoch:  # the elite moves along the ring, and stays too
            moved = held.withColumn("island", F.pmod(F.col("island") + 1, F.lit(islands)))
            held = held.union(moved)
        held = held.repartition(tasks, "district", "island").groupBy("district", "island").applyInArrow(_epoch(capacity, epoch, islands), ISLAND)
        held = cut(held, f"islands-{epoch}")  # read twice: as what stays and as what moves
    best = held.groupBy("district").agg(F.max(F.struct(-F.col("bins"), "fill", -F.col("island"), "sizes", "lengths")).alias("m"))
    return best.select("district", "m.sizes", "m.lengths")


PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, district long, bin int, offset long, full boolean"


def _place(key, items: pa.Table, best: pa.Table, capacity: int, keep: float) -> pa.Table:
    """Pieces of a district in the bins of its packing."""
    bins = _unpack_bins(best.column("sizes")[0].as_py(), best.column("lengths")[0].as_py())
    rows = sorted(items.to_pylist(), key=lambda r: (r["length"], r["doc_id"] is not None, r["doc_id"] or 0, r["piece"], r["ids_crc32"]))
    of: dict[int, list] = {}
    for r in reversed(rows):
        of.setdefault(r["length"], []).append(r)
    out = []
    for i, b in enumerate(bins):
        at, full = 0, sum(b) >= keep * capacity
        for n in b:
            r = of[n].pop()
            out.append((r["doc_id"], r["piece"], r["start"], n, r["ids_crc32"], key[0].as_py(), i, at, full))
            at += n
    fields = [x.split() for x in PLACED.split(", ")]
    kinds = {"long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_()}
    columns = list(zip(*out, strict=True))
    return pa.Table.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [f for f, _ in fields])


def _placer(capacity: int, keep: float):
    return lambda key, items, best: _place(key, items, best, capacity, keep)


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, district: int = DISTRICT, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every piece and its place."""
    cut_up = cut(pieces(docs, path, capacity), "pieces")
    rest = cut_up.where(F.col("length") < capacity)
    n = rest.count()
    done, level = [], 0
    while n:
        count = max(1, -(-n // district))
        last = level == LEVELS - 1 or count == 1
        spread = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.lit(level)), F.lit(count)).cast("long")
        items = rest.select(spread.alias("district"), "doc_id", "piece", "start", "length", "ids_crc32")
        best = best_packings(items, count, capacity, islands, epochs)
        keep = 0.0 if last else KEEP_FILL
        placed = items.groupBy("district").cogroup(best.groupBy("district")).applyInArrow(_placer(capacity, keep), PLACED)
        placed = cut(placed, f"placed-{level}")
        done.append(placed.where("full").withColumn("level", F.lit(level)))
        if last:
            break
        rest = placed.where("not full").select("doc_id", "piece", "start", "length", "ids_crc32")
        n, level = rest.count(), level + 1
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    # numbers: level and district and bin share one 63-bit number; whole pieces follow by a number of their own
    out = cut_up.where(F.col("length") == capacity).select(*columns, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    for placed in done:
        number = (F.col("level").cast("long") * F.lit(1 << 58)) + F.col("district") * F.lit(1 << 16) + F.col("bin")
        out = out.union(placed.select(*columns, number.alias("sequence_id"), "offset"))
    return out
