import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from querl.llm import pitman_yor as py
from querl.llm.common import documents
from tests.llm.test_tokens import thue_morse


def tokens_of(text):
    return [*(text or "").encode().lower().split(), None]


def brute(rows):
    train = Counter(t for d, x in rows if not py.held_out(d) for t in tokens_of(x))
    n, v = sum(train.values()), len(train)
    out = []
    for d, x in rows:
        own = tokens_of(x)
        out.append((d, py.held_out(d), len(own), sum(train[t] > 0 for t in own), n, sum(math.log10((train[t] + 1) / (n + v + 1)) for t in own)))
    return out


def check(rows, got):
    a = sorted(brute(rows), key=str)
    b = sorted([tuple(r[c] for c in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score")) for r in got], key=str)
    assert [x[:5] for x in a] == [x[:5] for x in b]
    assert all(math.isclose(x[5], y[5], rel_tol=1e-9) for x, y in zip(a, b, strict=True))


def test_held_out_is_crc32_mod_7():
    assert [d for d in range(40) if py.held_out(d)] == [d for d in range(40) if zlib.crc32(str(d).encode()) % 7 == 2]
    assert not py.held_out(None)


def test_sample_table(spark):
    docs = documents(spark, "/root/testdata/sf0.001")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = py.score(docs.withColumn("part", F.lit("x")), block_bytes=60_000, part_bytes=60_000).collect()
    check(rows, got)
    out = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in out) > sum(r["base_score"] for r in out)  # better on texts it hasn't seen


def test_probabilities_sum_to_one(spark):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(12)]
    rows = [(i, " ".join(rng.choices(words, weights=range(1, 13), k=rng.randint(1, 30)))) for i in range(60)]
    rows = [r for r in rows if not py.held_out(r[0])]
    out = [d for d in range(1000, 9000) if py.held_out(d)]
    seen = sorted({w for _, x in rows for w in x.split()})
    # all one-word texts, each possible next word after the first context: P(w|end) P(end|w); two words more give P(w|w11)
    asked = [f"w11 {w} w3" for w in [*seen, "unknown"]] + ["w11", *(f"{w} w3" for w in [*seen, "unknown"])]
    got = {r["doc_id"]: r["score"] for r in py.score(spark.createDataFrame(rows + list(zip(out, asked)), "doc_id long, text string"), block_bytes=300, part_bytes=300).collect()}
    score = {x: got[d] for d, x in zip(out, asked)}
    # P(w11|end) sum of P(w|w11) over all words and the end is P(w11|end); P(w3|w) P(end|w3) cancel by P(w|end)
    assert all(math.isfinite(x) and x < 0 for x in score.values())
    first = {w: score[f"{w} w3"] for w in [*seen, "unknown"]}
    assert max(first.values()) < 0 and len(set(first.values())) > 5


def test_parent_and_children_are_distributions():
    # one part holds everything: sums over the vocabulary and the unknown word are exactly one
    rng = np.random.default_rng(1)
    c = rng.integers(1, 90, 40)
    t = py.seat(c, np.full(40, 60.0), np.full(40, 0.02), py.D2, py.T2, py.log_stirling(py.D2), rng)
    assert ((t >= 1) & (t <= c)).all()
    base = rng.dirichlet(np.ones(41))
    own = (c - py.D2 * t) / (py.T2 + c.sum())
    parent = (py.T2 + py.D2 * t.sum()) / (py.T2 + c.sum())
    assert math.isclose(own.sum() + parent * base.sum(), 1, rel_tol=1e-12)


def test_seating_matches_the_chinese_restaurant():
    # with one dish of base probability 1, tables follow the plain process
    rng = np.random.default_rng(4)
    n, d, s = 20, 0.5, 1.0
    want = []
    for _ in range(4000):
        sizes = []
        for k in range(n):
            if rng.random() < (s + d * len(sizes)) / (k + s):
                sizes.append(1)
            else:
                p = np.array(sizes) - d
                sizes[rng.choice(len(sizes), p=p / p.sum())] += 1
        want.append(len(sizes))
    got = py.seat(np.full(20_000, n), np.zeros(20_000), np.ones(20_000), d, s, py.log_stirling(d), rng)
    assert abs(np.mean(want) - got.mean()) < 0.15


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "a b"), (3, "word " * 3000), (4, "x A"), (4, "x a"), (5, "É é\x0by")]
    check(rows, py.score(spark.createDataFrame(rows, "doc_id long, text string"), block_bytes=100, part_bytes=100).collect())


def test_empty_table(spark):
    assert py.score(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_scores_depend_on_the_table_alone(spark):
    docs = documents(spark, "/root/testdata/sf0.001").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    results = []
    for partitions, block_bytes in ((3, 60_000), (5, 60_000), (2, 15_000), (4, 1 << 22)):
        random.Random(partitions).shuffle(rows)
        df = spark.createDataFrame(spark.sparkContext.parallelize(rows, partitions), "doc_id long, text string")
        got = sorted(map(tuple, py.score(df, block_bytes=block_bytes, part_bytes=80_000).collect()))
        results.append([(r[0], r[2], round(r[6], 6)) for r in got])
    assert results[0] == results[1] == results[2] == results[3]
    assert len(results[0]) == len(rows)


def sampled_scores(train, asked, sweeps=150, burn=30):
    """Mean predictive log10 probabilities by seating customers one at a time, tables and all, in both levels."""
    rng = random.Random(1)
    pairs = [(u, w) for t in train for u, w in zip([None, *tokens_of(t)[:-1]], tokens_of(t))]
    v = len({w for _, w in pairs})
    children, parent = {}, {}  # dish -> sizes of its tables

    def p_parent(w):
        k, n = sum(map(len, parent.values())), sum(map(sum, parent.values()))
        own = parent.get(w, [])
        return (sum(own) - py.D1 * len(own) + (py.T1 + py.D1 * k) / (v + 1)) / (py.T1 + n)

    def p_child(u, w):
        r = children.get(u, {})
        n, t, own = sum(map(sum, r.values())), sum(map(len, r.values())), r.get(w, [])
        return (sum(own) - py.D2 * len(own) + (py.T2 + py.D2 * t) * p_parent(w)) / (py.T2 + n)

    def sit(restaurant, w, discount, new_weight):
        own = restaurant.setdefault(w, [])
        i = rng.choices(range(len(own) + 1), [x - discount for x in own] + [new_weight])[0]
        if i == len(own):
            own.append(1)
            return True
        own[i] += 1
        return False

    def leave(restaurant, w):
        own = restaurant[w]
        i = rng.choices(range(len(own)), own)[0]
        own[i] -= 1
        if own[i]:
            return False
        own.pop(i)
        return True

    def add(u, w):
        r = children.setdefault(u, {})
        t = sum(map(len, r.values()))
        if sit(r, w, py.D2, (py.T2 + py.D2 * t) * p_parent(w)):
            sit(parent, w, py.D1, (py.T1 + py.D1 * sum(map(len, parent.values()))) / (v + 1))

    for u, w in pairs:
        add(u, w)
    total = {x: Counter() for x in asked}
    for sweep in range(sweeps):
        for u, w in pairs:
            if leave(children[u], w):
                leave(parent, w)
            add(u, w)
        if sweep >= burn:
            for x in asked:
                own = tokens_of(x)
                for i, (u, w) in enumerate(zip([None, *own[:-1]], own)):
                    total[x][i] += p_child(u, w) / (sweeps - burn)
    return {x: sum(math.log10(p) for p in total[x].values()) for x in asked}


def test_scores_are_those_of_a_plain_sampler(spark):
    rng = random.Random(3)
    follow = {w: rng.choices(range(9), k=3) for w in range(9)}
    rows, w = [], 0
    for d in range(60):
        own = []
        for _ in range(rng.randint(1, 12)):
            w = rng.choice(follow[w])
            own.append(f"w{w}")
        rows.append((d, " ".join(own)))
    rows = [r for r in rows if not py.held_out(r[0])]
    asked = ["w1 w2 w3", "w4", "unknown w1", "w5 w5 w5 w5", "w0 w7 w8 unknown", ""]
    out = [d for d in range(1000, 9000) if py.held_out(d)]
    got = {r["doc_id"]: r for r in py.score(spark.createDataFrame(rows + list(zip(out, asked)), "doc_id long, text string")).collect()}
    want = sampled_scores([t for _, t in rows], asked)
    for d, x in zip(out, asked):  # the mean of three samples, so with some noise
        n = len(tokens_of(x))
        assert abs(got[d]["score"] - want[x]) < 0.1 + 0.08 * n, (x, got[d]["score"], want[x])
        assert math.isclose(got[d]["perplexity"], 10 ** (-got[d]["score"] / n))


def test_words_of_equal_polynomials_are_two_words(spark):
    rows = [(d, t) for d, t in enumerate(thue_morse(1024)) if not py.held_out(d)]
    got = py.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check(rows, got)


def test_distinct_is_unique():
    rng = np.random.default_rng(8)
    hashes = rng.integers(0, 1 << 64, 300, dtype=np.uint64)
    near = (np.uint64(0xABC) << np.uint64(52)) + rng.integers(0, 40, 500, dtype=np.uint64)  # these differ in the bits that hold places alone
    for values in (rng.choice(hashes, 2000), near, rng.integers(0, 50, 999), np.array([(1 << 63) - 1, 0, (1 << 63) - 1]), np.array([7], np.uint64), np.zeros(0, np.int64)):
        for a, b in zip(py.distinct(values), np.unique(values, return_inverse=True), strict=True):
            assert (a == b).all() and a.dtype == b.dtype


def test_distinct_pairs_of_any_width():
    rng = np.random.default_rng(9)
    for most in (30, 1 << 40, (1 << 62) - 1):
        a, b = (rng.choice(rng.integers(0, most, 20), 3000) for _ in range(2))
        x, y, which = py.distinct_pairs(a, b)
        assert list(zip(x.tolist(), y.tolist())) == sorted(set(zip(a.tolist(), b.tolist())))
        assert (x[which] == a).all() and (y[which] == b).all()


def test_pairs_cost_less_than_one_sort_by_two_keys():
    rng = np.random.default_rng(10)
    contexts = [np.sort(rng.choice(1 << 20, 2000, replace=False)) for _ in range(10)]
    followers, ones = py.pack(np.full(2000, 50)), py.pack(np.ones(100_000, np.int64))
    rows = [{"part": 0, "block": i, "contexts": py.pack(c), "followers": followers, "words": py.pack(rng.integers(0, 1 << 20, 100_000)), "counts": ones} for i, c in enumerate(contexts)]
    table = pa.Table.from_pylist(rows)
    keys = np.concatenate([py.unpack(r["words"]) for r in rows]), np.concatenate([np.repeat(c, 50) for c in contexts])

    def least(f):
        took = []
        for _ in range(3):
            began = time.process_time()
            f()
            took.append(time.process_time() - began)
        return min(took)

    assert least(lambda: py.Pairs(table)) < 0.7 * least(lambda: np.lexsort(keys))
