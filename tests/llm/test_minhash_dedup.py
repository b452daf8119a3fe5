import os
import random

from pyspark.sql import functions as F

from querl.llm import minhash_dedup as md
from querl.llm.common import documents
from querl.llm.components import components
from tests.llm.test_tokens import thue_morse


def shingle_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows, percent=85):
    sets = {d: shingle_set(t) for d, t in rows if d is not None}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    return sorted([(d, len(shingle_set(t)), d if d is None else root(d), d is None or root(d) == d) for d, t in rows], key=str)


def rows_of(df):
    return sorted(map(tuple, df.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 99), (100, 98), (7, 7), (50, 51), (50, 51)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "u long, v long")).collect()))
    assert got == {i: 0 for i in range(41)} | {98: 98, 99: 98, 100: 98, 50: 50, 51: 50}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_against_brute_force(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(300)]
    rows = [(0, None), (1, ""), (2, " \n"), (3, "one two three"), (4, "One\ttwo THREE"), (5, "one two"), (None, "one two"), (6, "É a b c d e"), (7, "é a b c d e"), (8, "w1"), (8, "w1")]
    base = [rng.choice(words) for _ in range(120)]
    for i in range(10, 60):  # a chain of drifting copies: neighbours similar, ends not
        base = list(base)
        base[rng.randrange(len(base))] = rng.choice(words)
        rows.append((i, " ".join(base)))
    stem = [rng.choice(words) for _ in range(200)]
    for i in range(60, 110):  # copies around the threshold
        own = list(stem)
        for _ in range(rng.randint(0, 4)):
            own[rng.randrange(len(own))] = rng.choice(words)
        rows.append((i, "  ".join(own).upper()))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("u", F.lit(1)).withColumn("bucket", F.lit("x"))
    assert rows_of(md.dedup(df)) == brute(rows)


def test_split_joins_are_joins(spark, monkeypatch):
    rng = random.Random(1)
    rows = spark.createDataFrame([(rng.choice([1, 1, 1, 1, rng.randint(2, 40)]), i) for i in range(2000)], "bucket long, id long")
    few = spark.createDataFrame([(b, k) for b in range(45) for k in range(b % 3)], "bucket long, k long")
    counts = rows.groupBy("bucket").agg(F.count("*").alias("c"))
    want = sorted(map(tuple, rows.join(few, "bucket").select("bucket", "id", "k").collect()))
    for share in (1, 7, 1000):
        monkeypatch.setattr(md, "SHARE", share)
        assert sorted(map(tuple, md.split_join(rows, few, counts, 2000, 2).select("bucket", "id", "k").collect())) == want


def test_written_tables_are_deleted(spark):
    from querl.llm import common

    df = common.cut(spark.range(3), "x")
    path = df.inputFiles()[0].removeprefix("file://").removeprefix("file:").rsplit("/", 1)[0]
    assert os.path.exists(path) and common.clear(spark) >= 1 and not os.path.exists(path) and common.clear(spark) == 0


def test_words_of_equal_polynomials(spark):
    rows = list(enumerate(t for n in (1024, 65536) for t in thue_morse(n)))
    assert rows_of(md.dedup(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))) == brute(rows)


def test_empty_table(spark):
    assert md.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sample_table(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert rows_of(md.dedup(docs)) == brute(rows)


def test_tables_follow_the_threshold(spark):
    for side, percent in ((12, 85), (16, 80)):
        assert md.side_of(percent, 100) == side
        assert 1 - (1 - (1 - (percent / 100) ** md.ROWS) ** side) ** 2 <= md.MISS
    docs = documents(spark, "/root/testdata/sf0.001")
    assert {len(r["keys"]) for r in md.sketches(docs, 16).select("keys").collect()} == {32}
