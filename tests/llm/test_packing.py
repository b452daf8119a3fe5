import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from querl.llm import packing as pk
from querl.llm.common import documents

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, got, capacity):
    tokenizer = Tokenizer.from_file(PATH)
    want = []
    for d, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), capacity)):
            own = ids[at : at + capacity]
            want.append((d, k, at, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
    assert Counter(want) == Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got)
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), -(-sum(w[3] for w in want) // capacity)


def test_sample_table(spark):
    docs = documents(spark, "/root/testdata/sf0.001")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = pk.pack(docs.withColumn("district", F.lit("x")), PATH, district=60).collect()
    n, least = check(rows, got, pk.CAPACITY)
    assert n <= least + 2


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "word " * 5000), (4, "x"), (4, "x"), (5, "y " * 2047), (6, "a <|endoftext|>b<|startoftext|> c")]
    got = pk.pack(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()
    check(rows, got, pk.CAPACITY)


def test_empty_table(spark):
    assert pk.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_operators_keep_all_pieces():
    rng = random.Random(4)
    lengths = [rng.randint(1, 1500) for _ in range(400)]
    a = pk.best_fit(lengths, 2048)
    b = pk.best_fit(sorted(lengths, reverse=True), 2048)
    for _ in range(20):
        child = pk.mutate(pk.crossover(a, b, 2048, rng), 2048, rng)
        assert Counter(n for x in child for n in x) == Counter(lengths)
        assert all(sum(x) <= 2048 for x in child)


def test_evolution_beats_best_fit():
    rng = random.Random(6)
    bins = []
    for _ in range(60):  # a hidden perfect packing of three pieces a bin
        x = rng.randint(550, 800)
        y = rng.randint(500, 700)
        bins += [x, y, 2048 - x - y]
    start = pk.best_fit(sorted(bins, reverse=True), 2048)
    best = pk.evolve(bins, [], 2048, seed=1, generations=200, population=8)
    assert pk.lower_bound(bins, 2048) <= len(best) <= len(start)
    assert pk.fitness(best, 2048) > pk.fitness(start, 2048)


def hidden_perfect_packings(rng, districts, bins):
    """Pieces that fill ``bins`` bins a district to the brim, three or four a bin; best fit over falling lengths needs more."""
    rows = []
    for d in range(districts):
        own = []
        for _ in range(bins):
            x, y = rng.randint(550, 800), rng.randint(500, 700)
            own += [x, y, 2048 - x - y]
        rows += [(d, n) for n in own]
    return rows


def test_islands_better_best_fit_in_every_district(spark):
    rng = random.Random(8)
    rows = hidden_perfect_packings(rng, 4, 25)
    items = spark.createDataFrame(rows, "district long, length long")
    of = defaultdict(list)
    for d, n in rows:
        of[d].append(n)
    plain = {d: pk.best_fit(sorted(x, reverse=True), 2048) for d, x in of.items()}
    assert all(len(x) > pk.lower_bound(of[d], 2048) for d, x in plain.items())  # best fit misses the bound

    def evolved(islands, epochs):
        got = {r["district"]: pk._unpack_bins(r["sizes"], r["lengths"]) for r in pk.best_packings(items, 4, 2048, islands, epochs).collect()}
        assert all(Counter(n for b in x for n in b) == Counter(of[d]) and max(map(sum, x)) <= 2048 for d, x in got.items())
        return {d: pk.fitness(x, 2048) for d, x in got.items()}

    alone, moved = evolved(1, 1), evolved(pk.ISLANDS, pk.EPOCHS)
    start = {d: pk.fitness(x, 2048) for d, x in plain.items()}
    assert all(moved[d] > start[d] for d in start)
    assert sum(-x[0] for x in moved.values()) < sum(-x[0] for x in start.values())  # fewer bins
    assert all(moved[d] >= alone[d] for d in alone) and any(moved[d] > alone[d] for d in alone)  # more islands and migration help


def test_three_islands_keep_all_pieces(spark):
    items = spark.createDataFrame([(0, n) for n in (900, 800, 700, 600, 500, 500)], "district long, length long")
    seen = pk.best_packings(items, 1, 2048, 3, 2).collect()
    assert len(seen) == 1 and sorted(n for b in pk._unpack_bins(seen[0]["sizes"], seen[0]["lengths"]) for n in b) == [500, 500, 600, 700, 800, 900]
