import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from querl.llm import transport_stream as ts


def test_round_trip_of_many_sizes():
    rng = random.Random(1)
    sizes = [*range(1, 800, 7), 16_320, 16_384, 16_385, 16_384 * 3 + 64, 16_384 * 9 + 128]
    for n in sizes:
        payload = rng.randbytes(n)
        media = ts.write_stream(payload)
        assert len(media) % ts.PACKET == 0
        s = ts.read_stream(media)
        assert s.payload == payload and s.counter_errors == 0 and s.program == ts.PROGRAM and s.pid == ts.STREAM_PID
        assert s.timestamps == [k * ts.UNIT_TICKS for k in range(-(-n // ts.UNIT_BYTES))]
        assert s.access_points == list(range(0, -(-n // ts.UNIT_BYTES), ts.UNITS_PER_ACCESS_POINT))


def test_damage_is_noticed():
    media = ts.write_stream(b"x" * 5000)
    lost = media[: 5 * 188] + media[6 * 188 :]
    with pytest.raises(ts.StreamError, match="continuity"):
        ts.read_stream(lost)
    bad_table = bytearray(media)
    bad_table[20 - 7] ^= 1
    with pytest.raises(ts.StreamError, match="CRC"):
        ts.read_stream(bytes(bad_table))
    for broken in (b"", media[1:], b"\0" + media[1:]):
        with pytest.raises(ts.StreamError):
            ts.read_stream(broken)


def test_known_values_of_the_format():
    assert ts.section_crc(b"123456789") == 0x0376E6E7
    assert ts.PAT_PACKET[:5].tobytes() == b"\x47\x40\x00\x10\x00"


def test_store(spark):
    rows = [(1, None), (2, ""), (None, "é"), (3, "y" * 200_000), (4, "z" * 64), (4, "z" * 64)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("media", F.lit(1))
    got = ts.store(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert any(
            d == r["doc_id"] and r["n_bytes"] == len((t or "").encode()) and r["payload_sha256"] == hashlib.sha256(p := ts.padded((t or "").encode())).hexdigest()
            and r["payload_bytes"] == len(p) and r["tail_crc32"] == zlib.crc32(p[-64:]) for d, t in rows
        )
        assert r["media_bytes"] == len(r["media"]) and r["media_sha256"] == hashlib.sha256(r["media"]).hexdigest()
        assert ts.read_stream(bytes(r["media"])).timestamps == r["pts"]
    assert len({(r["media_sha256"], r["feature"]) for r in got if r["doc_id"] == 4}) == 1
    assert ts.store(spark.createDataFrame([], "doc_id long, text string"), media=False).count() == 0
