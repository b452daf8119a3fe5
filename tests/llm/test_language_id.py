import zlib

import numpy as np
from pyspark.sql import functions as F

from querl.llm import crf
from querl.llm import language_id as li
from querl.llm.common import documents


def test_held_out_accuracy(spark):
    docs = documents(spark, "/root/testdata/sf0.01")
    got = {r["doc_id"]: r for r in li.identify(docs.withColumn("lang_pred", F.lit("x"))).collect()}
    want = {r["doc_id"]: r["lang"] for r in docs.select("doc_id", "lang").collect()}
    assert set(got) == set(want)
    out = [d for d in got if zlib.crc32(str(d).encode()) % 4 == 2]
    assert all(got[d]["held_out"] == (zlib.crc32(str(d).encode()) % 4 == 2) for d in got)
    assert np.mean([got[d]["lang_pred"] == want[d] for d in out]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_words_of_mixed_texts():
    english = "the house and the garden with their old trees " * 6
    german = "und der Garten mit einer schönen Wiese ist nicht groß " * 6
    model = li.fit_texts([english, german], ["en", "de"])
    text = (english[:92] + german[:106]).encode()
    data = np.frombuffer(text, np.uint8)
    starts, ends, first = li.word_bounds(data, np.array([0, len(data)]))
    p = model.word_posteriors(data, starts, ends, first[:-1])
    assert model.names == ["de", "en"]
    labels = p.argmax(axis=1)
    assert labels[:14].mean() > 0.9 and labels[-14:].mean() < 0.1


def test_forward_backward_and_viterbi_against_all_paths():
    rng = np.random.default_rng(2)
    scores, moves = rng.normal(size=(7, 3)), rng.normal(size=(3, 3))
    starts, lengths = np.array([0, 4]), np.array([4, 3])
    p, best = crf.posteriors(scores, moves, starts, lengths), crf.viterbi(scores, moves, starts, lengths)
    for s, n in ((0, 4), (4, 3)):
        paths = [tuple((i // 3**k) % 3 for k in range(n)) for i in range(3**n)]
        value = np.array([sum(scores[s + t, y] for t, y in enumerate(q)) + sum(moves[a, b] for a, b in zip(q, q[1:])) for q in paths])
        weight = np.exp(value - value.max())
        for t in range(n):
            for k in range(3):
                assert abs(p[s + t, k] - sum(w for w, q in zip(weight, paths) if q[t] == k) / weight.sum()) < 1e-9
        assert tuple(best[s : s + n]) == paths[int(value.argmax())]


def test_long_chains_are_walked_whole(monkeypatch):
    rng = np.random.default_rng(5)
    lengths = np.array([1, 7, 40, 13, 300, 41, 3, 97])
    starts = np.cumsum(lengths) - lengths
    scores, moves = rng.normal(size=(int(lengths.sum()), 4)) * 2, rng.normal(size=(4, 4)) * 3
    monkeypatch.setattr(crf, "BLOCK", 1000)
    p, best = crf.posteriors(scores, moves, starts, lengths), crf.viterbi(scores, moves, starts, lengths)
    for block, state in ((2, 1 << 22), (7, 2000), (10, 1 << 22)):
        monkeypatch.setattr(crf, "BLOCK", block)
        monkeypatch.setattr(crf, "STATE", state)
        assert np.allclose(crf.posteriors(scores, moves, starts, lengths), p, atol=1e-9)
        assert (crf.viterbi(scores, moves, starts, lengths) == best).all()


def test_every_language_and_whole_texts_are_learned(spark):
    rows = [(i, f"aa{i % 12}x bb{i % 12}y " * 4, f"l{i % 12:03}") for i in range(0, 240)]
    rows += [(5000 + i, "12 " * 3000 + "zug zog zig", "late") for i in range(40)]  # letters only far into the text
    got = li.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()
    want = {d: x for d, _, x in rows}
    assert len({r["lang_pred"] for r in got}) == 13 and np.mean([r["lang_pred"] == want[r["doc_id"]] for r in got]) > 0.9
    assert all(r["lang_pred"] == "late" for r in got if r["doc_id"] >= 5000)


def test_sample_is_bounded(spark, monkeypatch):
    monkeypatch.setattr(li, "SAMPLE_DOCS", 50)
    drawn = li.sample(spark.createDataFrame([(i, f"text {i}", "en" if i % 5 else "de") for i in range(5000)] + [(9000 + i, "x", "fr") for i in range(9)], "doc_id long, text string, lang string"))
    labels = [r["lang"] for r in drawn.collect()]
    n = {x: labels.count(x) for x in ("en", "de", "fr")}
    assert 25 < n["en"] < 80 and 25 < n["de"] < 80 and 3 < n["fr"] <= 9


def test_odd_rows(spark):
    rows = [(1, "the cat and the dog", "en"), (2, None, "en"), (3, "", None), (4, "12 34 !?", "en"), (None, "le chat et la maison", "fr"), (5, "le chat et le chien", "fr"), (5, "le chat et le chien", "fr"), (6, "x" * 100_000, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = sorted(map(tuple, li.identify(df).collect()), key=str)
    assert len(got) == len(rows)
    und = {r[0] for r in got if r[2] == "und"}
    assert und == {2, 3, 4}


def test_nothing_to_learn(spark):
    assert li.identify(spark.createDataFrame([], "doc_id long, text string, lang string")).count() == 0
    got = li.identify(spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")).first()
    assert (got["lang_pred"], got["score"]) == ("und", 0.0)
