import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from querl.llm import suffix_dedup as sd
from querl.llm.common import documents


def brute(rows, match=50):
    least = {}
    low = lambda d: -(1 << 63) if d is None else d
    texts = [(low(d), (t or "").encode()) for d, t in rows]
    for d, b in texts:
        for i in range(len(b) - match + 1):
            k = b[i : i + match]
            if least.get(k, d) >= d:
                least[k] = d
    out = []
    for (d, b), (doc, _) in zip(texts, rows, strict=True):
        gone = bytearray(len(b))
        for i in range(len(b) - match + 1):
            if least[b[i : i + match]] < d:
                gone[i : i + match] = b"\1" * match
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and (not i or not gone[i - 1]))
        out.append((doc, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(map(tuple, df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)


def test_sort_suffixes_is_the_sorted_order():
    rng = random.Random(5)
    words = [bytes(rng.choices(b"ab", k=rng.randint(1, 9))) for _ in range(5)]
    text = b"".join(rng.choice(words) for _ in range(2000))
    buffer = np.frombuffer(text, np.uint8)
    starts = np.arange(len(text) - 49)
    order, cls = sd.sort_suffixes(buffer, starts)
    keys = [text[s : s + 50] for s in starts[order]]
    assert keys == sorted(keys) and sorted(order.tolist()) == list(range(len(starts)))
    assert [a == b for a, b in zip(keys, keys[1:])] == [a == b for a, b in zip(cls.tolist(), cls.tolist()[1:])]


@pytest.mark.parametrize("hot", [0, 16])
def test_against_brute_force(spark, hot):
    rng = random.Random(7)
    words = ["the", "of", "über", "a", "passage", "sæt", "\n", "zz"]
    passages = [" ".join(rng.choice(words) for _ in range(rng.randint(8, 60))) for _ in range(6)]
    rows = [(None, passages[0]), (0, None), (1, ""), (2, "x" * 200), (3, "x" * 130), (4, "short"), (5, passages[0]), (5, passages[0])]
    for i in range(6, 80):
        parts = [rng.choice(passages) if rng.random() < 0.5 else " ".join(rng.choice(words) + str(rng.randint(0, 99)) for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 4))]
        rows.append((rng.randint(6, 70), " ".join(parts)))
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("block", F.lit("clash"))
    assert rows_of(sd.dedup(df, block_bytes=4000, hot_runs=hot)) == brute(rows)


@pytest.mark.parametrize(("blocks", "hot"), [(2470, 0), (4097, 1)])
def test_anchors_of_many_blocks(blocks, hot):
    rows = [(0, b, np.array([7], "<u4").tobytes(), np.packbits([0]).tobytes(), np.packbits([0]).tobytes()) for b in range(blocks)]
    answers = sd._answer((pa.scalar(0),), sd._table(rows, sd.REPORT), 16)
    assert answers.num_rows == blocks and {np.unpackbits(np.frombuffer(x, np.uint8))[0] for x in answers.column("hot").to_pylist()} == {hot}


def test_carried_columns_and_texts(spark):
    long = "a passage of more than fifty bytes, with ä and ö in it, repeated"
    df = spark.createDataFrame([(1, long, "n", 3), (2, "ä" + long[1:] + "!", None, 4)], "doc_id long, text string, lang string, n_bytes long").drop("n_bytes")
    got = {r["doc_id"]: r for r in sd.dedup(df, with_text=True, carry=("lang",)).collect()}
    assert got[1]["kept_text"] == long and got[1]["lang"] == "n"
    assert got[2]["kept_text"] == "ä!" and got[2]["lang"] is None


def test_empty_table(spark):
    assert sd.dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_sample_table(spark):
    docs = documents(spark, "/root/testdata/sf0.001")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert rows_of(sd.dedup(docs)) == brute(rows)
