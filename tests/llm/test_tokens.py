import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from querl.llm import byte_bpe as bb
from querl.llm import token_output as to
from querl.llm.common import documents
from querl.llm.tokens import ChunkEncoder, HashTable, library_encoder
from querl.llm.vec import hash_runs

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SF = "/root/testdata/sf0.001"


def joined(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.append(0, np.cumsum([len(x) for x in raw])).astype(np.int64)


def odd_texts(n, extra=""):
    rng = random.Random(3)
    letters = " \n\t  　\u0085é'a's's1ñ中🙂.,\x1ćΑΣσßİ<|endoftext|>" + extra
    return ["".join(rng.choice(letters) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def thue_morse(n):
    """Two strings of ``n`` letters whose polynomial hashes modulo 2**64 are equal, whatever the base."""
    bits = [bin(i).count("1") % 2 for i in range(n)]
    return "".join("ab"[x] for x in bits), "".join("ba"[x] for x in bits)


@pytest.fixture(scope="module")
def library():
    tokens = bb.read_ranks(RANKS)
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})


def test_perfect_hash_is_minimal_and_perfect():
    tokens = bb.read_ranks(RANKS)
    table = bb.PerfectHash.build(tokens)
    assert sorted(table.values) == list(range(len(tokens)))
    assert all(table.find(t) == i for i, t in enumerate(tokens))
    for n in (1, 2, 7):
        small = bb.PerfectHash.build(tokens[:n])
        assert [small.find(t) for t in tokens[:n]] == list(range(n))


def test_bpe_is_the_library_s(library):
    bpe, encoder = bb.bpe_of(RANKS, public_tokenizers.PATTERN)
    texts = [*odd_texts(4000), "a" * 5000, "", " ", "  x", "   x"]
    ids, counts = encoder.encode(*joined(texts))
    at = 0
    for t, n in zip(texts, counts.tolist()):
        own = ids[at : at + n].tolist()
        assert own == library.encode_ordinary(t), t
        assert bpe.decode(own) == t.encode()
        at += n


@pytest.mark.parametrize("name, spaced", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_library_encoder_gives_ids_of_whole_texts(name, spaced):
    path = public_tokenizers.path(name)
    tokenizer = Tokenizer.from_file(path)
    rng = random.Random(5)
    specials = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext|"]
    texts = [*odd_texts(4000), *specials, *("".join(rng.choice([*specials, " ", "a b", "é", "\n", "x's"]) for _ in range(rng.randint(0, 6))) for _ in range(2000))]
    ids, counts = library_encoder(path, spaced).encode(*joined(texts))
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == list(map(len, want)) and ids.tolist() == [x for w in want for x in w]


@pytest.mark.parametrize("n", [1024, 4096, 65536])
@pytest.mark.parametrize("spaced", [False, True])
def test_polynomial_collisions_are_told_apart(n, spaced):
    a, b = thue_morse(n)
    encoder = ChunkEncoder(lambda chunks: (np.array([len(c) + (c == a.encode()) for c in chunks], np.uint32), np.ones(len(chunks), np.int64)), spaced=spaced)
    data, offsets = joined([a, b, a, b])
    h = hash_runs(data, offsets[:-1], offsets[1:])
    assert h[0] == h[2] and h[1] == h[3] and h[0] != h[1]
    ids, _ = encoder.encode(data, offsets)
    assert ids.tolist() == [n + 1, n, n + 1, n]


def test_equal_hashes_are_no_equal_chunks(monkeypatch):
    monkeypatch.setattr("querl.llm.tokens.hash_words", lambda words, place, first, lengths: np.full(len(first), 7, np.uint64))
    encoder = ChunkEncoder(lambda chunks: (np.array([int(c) for c in chunks], np.uint32), np.ones(len(chunks), np.int64)), spaced=False)
    rng = random.Random(2)
    for _ in range(3):
        numbers = [rng.choice([1, 12, 123456789, 123456788, 4294967295]) for _ in range(50)]
        assert encoder.encode(*joined([" ".join(map(str, numbers))]))[0].tolist() == numbers


def test_round_trip_of_colliding_texts(spark, library):
    import hashlib

    rows = list(enumerate(t for n in (1024, 2048, 65536) for t in thue_morse(n)))
    got = {r["doc_id"]: r for r in bb.encode_documents(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), RANKS, public_tokenizers.PATTERN).collect()}
    for d, t in rows:
        assert got[d]["decoded_sha256"] == hashlib.sha256(t.encode()).hexdigest() and got[d]["n_tokens"] == len(library.encode_ordinary(t))


def test_table_restarts_without_changing_ids():
    seen = []
    encoder = ChunkEncoder(lambda chunks: (seen.append(len(chunks)), (np.array([len(c) for c in chunks], np.uint32), np.ones(len(chunks), np.int64)))[1], spaced=False, limit=40)
    for k in range(30):
        words = [f"{'x' * (i % 7)}{k * 13 + i}" for i in range(25)]
        ids, counts = encoder.encode(*joined([" ".join(words)]))
        assert ids.tolist() == [len(w) for w in words] and counts.tolist() == [25]


def test_hash_table():
    rng = np.random.default_rng(1)
    h = np.unique(rng.integers(1, 1 << 63, 5000).astype(np.uint64))
    table = HashTable(6000)
    table.add(h[::2])
    table.add(h[1::2])
    assert (table.find(h[::2]) == np.arange(len(h[::2]))).all() and (table.find(h[1::2]) == len(h[::2]) + np.arange(len(h[1::2]))).all()
    assert (table.find(h + np.uint64(1 << 63)) == -1).all()


def test_encode_documents(spark, library):
    import hashlib

    rows = [(1, None), (2, ""), (None, "x y"), (3, "long " * 20_000), (4, "é"), (4, "é")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_tokens", F.lit(-1))
    got = sorted(map(tuple, bb.encode_documents(docs, RANKS, public_tokenizers.PATTERN).collect()), key=str)
    want = []
    for d, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((d, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert got == sorted(want, key=str)
    lists = {r["doc_id"]: r["ids"] for r in bb.encode(docs, RANKS, public_tokenizers.PATTERN).collect()}
    assert lists[3] == library.encode_ordinary(rows[3][1]) and lists[2] == []


@pytest.mark.parametrize("n", [0, 1, 2, 3, 4, 5, 1000])
def test_variable_length_coding_round_trip(n):
    rng = np.random.default_rng(n)
    ranks = (rng.integers(0, 1 << 32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
    control, data = to.encode_ranks(ranks)
    assert len(control) == -(-n // 4)
    assert (to.decode_ranks(control, data, n) == ranks).all()


def brute_output(rows, end=2, kind="<u2"):
    import zlib

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    encoded = [(d, tokenizer.encode(t or "", add_special_tokens=False).ids + [end]) for d, t in rows]
    width = lambda ids: np.array(ids, kind).tobytes()
    encoded.sort(key=lambda x: (x[0] is not None, x[0] or 0, len(x[1]), width(x[1])))
    out, at = [], 0
    for d, ids in encoded:
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return sorted(out, key=str)


def test_token_output(spark):
    docs = documents(spark, SF)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    shards, ranks = to.write_corpus(docs.withColumn("ids", F.lit("clash")), public_tokenizers.path("byte_bpe_50k.json"), 2)
    assert sorted(map(tuple, to.read_corpus(shards, ranks).collect()), key=str) == brute_output(rows)


def test_token_output_of_odd_rows(spark):
    rows = [(5, None), (3, ""), (None, "x y"), (4, "long " * 3000), (4, "é"), (4, "é"), (-7, "b")]
    shards, ranks = to.write_corpus(spark.createDataFrame(rows, "doc_id long, text string"), public_tokenizers.path("byte_bpe_50k.json"), 2)
    assert sorted(map(tuple, to.read_corpus(shards, ranks).collect()), key=str) == brute_output(rows)
    shards, ranks = to.write_corpus(spark.createDataFrame([], "doc_id long, text string"), public_tokenizers.path("byte_bpe_50k.json"), 2)
    assert to.read_corpus(shards, ranks).count() == 0


def test_ids_beyond_16_bits(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    assert (to.id_type(path, 2), to.id_type(path, 65_536)) == ("<u2", "<u4")
    with pytest.raises(ValueError):
        to.id_type(path, 1 << 32)
    rows = [(1, "one <|endoftext|> two"), (2, None), (3, "é" * 300)]
    shards, ranks = to.write_corpus(spark.createDataFrame(rows, "doc_id long, text string"), path, 70_000)
    assert sorted(map(tuple, to.read_corpus(shards, ranks).collect()), key=str) == brute_output(rows, 70_000, "<u4")
