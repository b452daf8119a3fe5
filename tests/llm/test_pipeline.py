from pyspark.sql import functions as F

import corpus_pipeline as cp
from querl.llm import pii
from querl.llm.common import documents
from tests.llm.test_minhash_dedup import brute as brute_groups
from tests.llm.test_minhash_dedup import shingle_set
from tests.llm.test_packing import check as check_packing
from tests.llm.test_pii import plain_spans

SF = "/root/testdata/sf0.001"


def brute_passages(rows, match=50):
    """Characters stay when none of their bytes is covered by a string an earlier document has."""
    least, out = {}, {}
    for d, t in rows:
        b = t.encode()
        for i in range(len(b) - match + 1):
            least[b[i : i + match]] = min(d, least.get(b[i : i + match], d))
    for d, t in rows:
        b = t.encode()
        gone = bytearray(len(b))
        for i in range(len(b) - match + 1):
            if least[b[i : i + match]] < d:
                gone[i : i + match] = b"\1" * match
        kept, at = [], 0
        for ch in t:
            n = len(ch.encode())
            if not any(gone[at : at + n]):
                kept.append(ch)
            at += n
        out[d] = "".join(kept)
    return out


def test_stages(spark):
    docs = documents(spark, SF)
    extra = spark.createDataFrame([(9001, None, None, "s", 0), (9002, "12 34", "en", "s", 5)], docs.schema)
    now = docs.union(extra)
    rows = {r["doc_id"]: r["text"] for r in now.collect()}
    stages = dict(cp.STAGES)
    assert list(stages) == ["language_id", "minhash_dedup", "suffix_dedup", "pii", "packing"]

    now = stages["language_id"](spark, now, SF)
    assert now.columns == list(cp.COLUMNS)
    got = {r["doc_id"]: r["text"] for r in now.collect()}
    assert got == {d: t for d, t in rows.items() if t and any(c.isalpha() for c in t)}

    want = {d for d, _, _, kept in brute_groups(list(got.items()), 80) if kept}
    now = cp.cut(stages["minhash_dedup"](spark, cp.cut(now, "test"), SF), "test")
    got = {r["doc_id"]: r["text"] for r in now.collect()}
    assert now.columns == list(cp.COLUMNS) and set(got) == want

    want = brute_passages(list(got.items()))
    now = cp.cut(stages["suffix_dedup"](spark, now, SF), "test")
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in now.collect()}
    assert now.columns == list(cp.COLUMNS) and got == {d: (t, len(t)) for d, t in want.items()}

    now = cp.cut(stages["pii"](spark, now, SF), "test")
    clean = {r["doc_id"]: r["text"] for r in now.collect()}
    assert now.columns == list(cp.COLUMNS) and set(clean) == set(got)
    for d, (t, _) in got.items():
        assert not plain_spans(clean[d]) or not plain_spans(t)
        if not plain_spans(t) and "<SECRET>" not in clean[d] and not any(f"<{k.upper()}>" in clean[d] for k in pii.KINDS):
            assert clean[d] == t

    packed = stages["packing"](spark, now, SF).collect()
    check_packing(list(clean.items()), packed, 2048)


def test_run(spark):
    got = cp.run(spark, SF)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(got.columns) and got.count() > 100
    assert got.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 2048").count() == 0


def test_near_duplicates_at_80_percent(spark):
    docs = documents(spark, "/root/testdata/sf0.01").select(*cp.COLUMNS)
    sets = {r["doc_id"]: shingle_set(r["text"]) for r in docs.collect()}
    ids = sorted(d for d in sets if sets[d])
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[:i]:
            x, y = sets[a], sets[b]
            if 100 * min(len(x), len(y)) >= 80 * max(len(x), len(y)) and 100 * len(x & y) >= 80 * len(x | y):
                ra, rb = root(a), root(b)
                parent[max(ra, rb)] = min(ra, rb)
    got = {r["doc_id"] for r in dict(cp.STAGES)["minhash_dedup"](spark, docs, SF).collect()}
    assert got == {d for d in sets if root(d) == d}


def test_empty_and_unlabelled_tables(spark):
    schema = documents(spark, SF).schema
    empty = spark.createDataFrame([], schema)
    for _, stage in cp.STAGES:
        assert stage(spark, empty, SF).count() == 0
    rows = [(1, "some words here", None, None, 15), (2, "12 34", None, "s", 5), (3, None, None, "s", 0), (4, "été", None, "s", 3)]
    kept = dict(cp.STAGES)["language_id"](spark, spark.createDataFrame(rows, schema), SF)
    assert kept.columns == list(cp.COLUMNS) and {r["doc_id"] for r in kept.collect()} == {1, 4}


def test_repeated_rows_become_one(spark):
    schema = documents(spark, SF).schema
    text = "one two three four five six seven"
    rows = [(5, text, "en", "s", 1), (5, text, "en", "s", 1), (6, text, "en", "s", 1), (7, "other words", "en", "s", 1), (None, text, "en", "s", 1), (None, text, "en", "s", 1)]
    got = dict(cp.STAGES)["minhash_dedup"](spark, spark.createDataFrame(rows, schema), SF)
    assert sorted((r["doc_id"] for r in got.collect()), key=str) == [5, 7, None, None]
