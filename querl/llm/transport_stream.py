"""Media columns: bytes stored in, and read back from, MPEG transport streams.

Writing: one program with one private-data stream. The payload is cut into access units, each one
packetized elementary stream (PES) packet with a presentation timestamp; every few units a random
access point begins, preceded by the program tables and carrying a clock reference. Reading follows
the tables (PAT -> PMT -> stream), checks their CRC and every continuity counter, reassembles PES
packets, and gives timestamps with the random-access points. Fixed values are those of ISO/IEC
13818-1.

Defined results: a null text is empty; a payload is never empty (64 zero bytes at least); equal
payloads give equal streams.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from querl.llm.common import flat, narrow, ship

# Fixed values of the format.
PACKET = 188
SYNC = 0x47
PAT_PID = 0x0000
PMT_TABLE = 0x02
PAT_TABLE = 0x00
NULL_PID = 0x1FFF
PRIVATE_STREAM_1 = 0xBD
PRIVATE_DATA_TYPE = 0x06
CLOCK = 90_000

# Choices of the writer.
PROGRAM = 1
PMT_PID = 0x1000
STREAM_PID = 0x0100
UNIT_BYTES = 16_384
UNIT_TICKS = CLOCK // 25
UNITS_PER_ACCESS_POINT = 8
PAD_TO = 64

_CRC_TABLE = []
for _i in range(256):
    _c = _i << 24
    for _ in range(8):
        _c = (_c << 1 ^ (0x04C11DB7 if _c & 0x80000000 else 0)) & 0xFFFFFFFF
    _CRC_TABLE.append(_c)


class StreamError(ValueError):
    """The bytes are not a transport stream this reader can follow."""


def section_crc(section: bytes) -> int:
    """The CRC-32 of program tables (most significant bit first, no final inversion)."""
    c = 0xFFFFFFFF
    for b in section:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC_TABLE[c >> 24 ^ b]
    return c


def _table(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + section_crc(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> np.ndarray:
    head = bytes([SYNC, 0x40 | pid >> 8, pid & 0xFF, 0x10, 0])
    return np.frombuffer((head + section).ljust(PACKET, b"\xff"), np.uint8)


PAT_PACKET = _table_packet(PAT_PID, _table(PAT_TABLE, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big")))
PMT_PACKET = _table_packet(
    PMT_PID,
    _table(PMT_TABLE, PROGRAM, (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([PRIVATE_DATA_TYPE]) + (0xE000 | STREAM_PID).to_bytes(2, "big") + b"\xf0\x00"),
)


def _stamp(pts: int) -> bytes:
    """A 33-bit presentation timestamp in its five bytes with marker bits."""
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, 0x01 | pts >> 14 & 0xFE, pts >> 7 & 0xFF, 0x01 | pts << 1 & 0xFE])


def _unit_packets(data: np.ndarray, pts: int, access_point: bool, counter: int) -> np.ndarray:
    """The transport packets of one access unit; ``counter`` is its first continuity counter."""
    pes = np.empty(14 + len(data), np.uint8)
    pes[:14] = np.frombuffer(b"\x00\x00\x01" + bytes([PRIVATE_STREAM_1]) + (8 + len(data)).to_bytes(2, "big") + b"\x80\x80\x05" + _stamp(pts), np.uint8)
    pes[14:] = data
    lead = 8 if access_point else 0  # bytes of the first packet's adaptation field
    room = PACKET - 4
    n = -(-(len(pes) + lead) // room)
    spare = n * room - len(pes) - lead  # stuffing in the last packet
    out = np.full((n, PACKET), 0xFF, np.uint8)
    out[:, 0] = SYNC
    out[:, 1] = STREAM_PID >> 8
    out[:, 2] = STREAM_PID & 0xFF
    out[:, 3] = 0x10 | (np.arange(counter, counter + n) & 15)
    out[0, 1] |= 0x40
    if access_point:
        clock = (pts << 15 | 0x7E00).to_bytes(6, "big")
        out[0, 3] |= 0x20
        out[0, 4:12] = np.frombuffer(b"\x07\x50" + clock, np.uint8)
    skip = np.zeros(n, np.int64)
    skip[0] = lead
    if spare:
        last = n - 1
        out[last, 3] |= 0x20
        if skip[last]:
            out[last, 4] += spare  # the field there grows
        else:
            out[last, 4] = spare - 1
            if spare > 1:
                out[last, 5] = 0
        skip[last] += spare
    body = out[:, 4:]
    if n > 2:
        body[1:-1] = pes[room - lead : room - lead + (n - 2) * room].reshape(n - 2, room)
    body[0, skip[0] :] = pes[: room - skip[0]]
    if n > 1:
        body[-1, skip[-1] :] = pes[len(pes) - (room - skip[-1]) :]
    return out


def write_stream(payload: bytes) -> bytes:
    """A transport stream that holds ``payload`` (not empty)."""
    data = np.frombuffer(payload, np.uint8)
    parts, counter, tables = [], 0, 0
    for k, at in enumerate(range(0, len(data), UNIT_BYTES)):
        point = k % UNITS_PER_ACCESS_POINT == 0
        if point:
            for packet in (PAT_PACKET, PMT_PACKET):
                own = packet.copy()
                own[3] |= tables & 15
                parts.append(own[None, :])
            tables += 1
        unit = _unit_packets(data[at : at + UNIT_BYTES], k * UNIT_TICKS & (1 << 33) - 1, point, counter)
        counter += len(unit)
        parts.append(unit)
    return np.concatenate(parts).tobytes()


@dataclass
class Stream:
    """What read_stream() found: the payload, a timestamp for each unit, which units are random-access points."""

    payload: bytes = b""
    program: int = 0
    pid: int = 0
    kind: int = 0
    packets: int = 0
    timestamps: list[int] = field(default_factory=list)
    access_points: list[int] = field(default_factory=list)
    counter_errors: int = 0


def _sections(rows: np.ndarray, starts: np.ndarray) -> list[bytes]:
    """The distinct program-table sections in the packets of one PID (each within one packet)."""
    out = []
    for raw in dict.fromkeys(row[s:].tobytes() for row, s in zip(rows, starts.tolist(), strict=True) if row[1] & 0x40):
        at = 1 + raw[0]
        length = 3 + (int.from_bytes(raw[at + 1 : at + 3], "big") & 0xFFF)
        section = raw[at : at + length]
        if section_crc(section):
            raise StreamError("a program table has a wrong CRC")
        out.append(section)
    return out


def read_stream(media: bytes) -> Stream:
    """Reads the first elementary stream of the first program."""
    if not media or len(media) % PACKET:
        raise StreamError("not a whole number of packets")
    p = np.frombuffer(media, np.uint8).reshape(-1, PACKET)
    if (p[:, 0] != SYNC).any():
        raise StreamError("a packet lacks its sync byte")
    pid = (p[:, 1].astype(np.int64) & 0x1F) << 8 | p[:, 2]
    control = p[:, 3] >> 4 & 3
    starts = np.where(control & 2, 5 + p[:, 4].astype(np.int64), 4)
    has_payload = (control & 1).astype(bool)
    out = Stream(packets=len(p))

    def of(number: int) -> np.ndarray:
        rows = np.flatnonzero((pid == number) & has_payload)
        counters = p[rows, 3] & 15
        out.counter_errors += int(((counters[1:] - counters[:-1] & 15) != 1).sum())
        return rows

    rows = of(PAT_PID)
    tables = _sections(p[rows], starts[rows])
    if not tables:
        raise StreamError("no program association table")
    out.program = int.from_bytes(tables[0][8:10], "big")
    rows = of(int.from_bytes(tables[0][10:12], "big") & 0x1FFF)
    tables = _sections(p[rows], starts[rows])
    if not tables:
        raise StreamError("no program map table")
    at = 12 + (int.from_bytes(tables[0][10:12], "big") & 0xFFF)
    out.kind, out.pid = tables[0][at], int.from_bytes(tables[0][at + 1 : at + 3], "big") & 0x1FFF

    rows = of(out.pid)
    if out.counter_errors:
        raise StreamError(f"{out.counter_errors} continuity errors")
    own, begin = p[rows], starts[rows]
    data = own[np.arange(PACKET) >= begin[:, None]]
    ends = np.cumsum(PACKET - begin)
    first = np.flatnonzero(own[:, 1] & 0x40)
    at = (ends - (PACKET - begin))[first]
    points = ((own[first, 3] & 0x20) > 0) & (own[first, 4] > 0) & ((own[first, 5] & 0x40) > 0)
    parts = []
    for k, (a, b) in enumerate(zip(at.tolist(), [*at[1:].tolist(), len(data)], strict=True)):
        head = data[a : a + 14].tobytes()
        length = int.from_bytes(head[4:6], "big")
        if head[:3] != b"\x00\x00\x01" or length and b - a != 6 + length:
            raise StreamError("a PES packet is broken")
        s = head[9:14]
        out.timestamps.append((s[0] >> 1 & 7) << 30 | s[1] << 22 | s[2] >> 1 << 15 | s[3] << 7 | s[4] >> 1)
        parts.append(data[a + 9 + head[8] : b])
        if points[k]:
            out.access_points.append(k)
    out.payload = np.concatenate(parts).tobytes() if parts else b""
    return out


def describe(s: Stream) -> str:
    """The stream's features as one string."""
    return (
        f"program={s.program};pid={s.pid:#06x};type={s.kind:#04x};packets={s.packets};units={len(s.timestamps)};"
        f"pts={s.timestamps[0]}-{s.timestamps[-1]};access={','.join(f'{k}@{s.timestamps[k]}' for k in s.access_points)};errors={s.counter_errors}"
    )


def padded(text: bytes, to: int = PAD_TO) -> bytes:
    """``text`` with zero bytes up to a positive multiple of ``to``."""
    return text + b"\0" * (max(to, -(-len(text) // to) * to) - len(text))


def _store(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = flat(batch.column("text"))
        bounds, ids = offsets.tolist(), batch.column("doc_id").to_pylist()
        for at in range(0, len(ids), 256):
            rows = []
            for i in range(at, min(at + 256, len(ids))):
                raw = data[bounds[i] : bounds[i + 1]].tobytes()
                media = write_stream(padded(raw))
                back = read_stream(media)
                row = (
                    ids[i], len(raw), len(back.payload), hashlib.sha256(back.payload).hexdigest(), zlib.crc32(back.payload[-PAD_TO:]),
                    len(media), hashlib.sha256(media).hexdigest(), describe(back),
                )
                rows.append((*row, media, back.timestamps, [back.timestamps[k] for k in back.access_points]) if whole else row)
            columns = list(zip(*rows, strict=True))
            kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())] * whole
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in (SCHEMA + MEDIA * whole).split(", ")])


SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
MEDIA = ", media binary, pts array<long>, access_pts array<long>"


def store(docs: DataFrame, media: bool = True) -> DataFrame:
    """Each text as a transport stream, read back: digests and features, with ``media`` also the stream and its timestamps."""
    ship(docs.sparkSession)
    return narrow(docs).mapInArrow(partial(_store, whole=media), SCHEMA + MEDIA * media)
