"""Operator 6, media columns as MPEG transport streams.

``mux`` stores a payload in a transport stream: program association and program map tables, then one
packetised elementary packet for each access unit of 576 bytes, with a presentation time stamp, a clock
reference, and a random-access mark on every 12th unit. ``demux`` reads a stream of 188-byte packets: it
parses both tables, which may take several packets (and checks their CRC), checks the continuity counters of the first
elementary stream of the first program (a packet sent twice counts once, and a marked discontinuity is no error), reassembles its
elementary packets, and lists time stamps and random-access points. Other programs and streams are passed over.

Edge cases: a null text counts as empty, so its payload is 576 bytes of 255. Repeated rows and equal texts
give equal values. An empty table gives no rows. Extra columns are ignored. A stream that is broken (sync
byte, CRC, counters, lengths) is reported in ``errors``, not raised.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import portions

#: Fixed values of the format: packet length, sync byte; PIDs, stream type and id of private data.
PACKET, SYNC = 188, 0x47
PAT_PID, PMT_PID, DATA_PID, STREAM_TYPE, STREAM_ID = 0x0000, 0x1000, 0x0100, 0x06, 0xBD
#: Bytes of an access unit, ticks of 90 kHz between units (25 a second), units between random-access points.
UNIT, TICKS, GROUP = 576, 3600, 12


def _crc_table() -> np.ndarray:
    out = np.zeros(256, np.uint32)
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = ((c << 1) ^ (0x04C11DB7 if c & 0x80000000 else 0)) & 0xFFFFFFFF
        out[i] = c
    return out


_CRC = _crc_table()


def crc32_mpeg(data: bytes) -> int:
    c = 0xFFFFFFFF
    for b in data:
        c = ((c << 8) & 0xFFFFFFFF) ^ int(_CRC[(c >> 24) ^ b])
    return c


def _section(table: int, number: int, body: bytes) -> bytes:
    head = bytes([table]) + (0xB000 | (5 + len(body) + 4)).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + crc32_mpeg(head + body).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    head = bytes([SYNC, 0x40 | pid >> 8, pid & 255, 0x10, 0])
    return (head + section).ljust(PACKET, b"\xff")


TABLES = _table_packet(PAT_PID, _section(0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))) + _table_packet(
    PMT_PID, _section(2, 1, (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | DATA_PID).to_bytes(2, "big") + b"\xf0\x00"))


def payload_of(text: bytes) -> bytes:
    """text with bytes 255 up to a positive multiple of a unit."""
    return text.ljust(max(1, -(-len(text) // UNIT)) * UNIT, b"\xff")


def mux_bytes(payload: bytes) -> bytes:
    """The stream of a payload of whole units. Four packets a unit: 176 + 184 + 184 + 46 bytes of its 590."""
    n = len(payload) // UNIT
    i = np.arange(n, dtype=np.int64)
    pts = (TICKS * i) & (2**33 - 1)
    p = np.full((n, 4, PACKET), 255, np.uint8)
    p[:, :, 0] = SYNC
    p[:, :, 1] = DATA_PID >> 8
    p[:, 0, 1] |= 0x40
    p[:, :, 2] = DATA_PID & 255
    p[:, :, 3] = 0x10 | (np.arange(4 * n).reshape(n, 4) & 15)
    p[:, [0, 3], 3] |= 0x20
    p[:, 0, 4], p[:, 0, 5] = 7, np.where(i % GROUP == 0, 0x50, 0x10)  # clock reference; random access
    for k, v in enumerate((pts >> 25, pts >> 17, pts >> 9, pts >> 1, (pts & 1) << 7 | 0x7E, 0 * pts)):
        p[:, 0, 6 + k] = v & 255
    p[:, 3, 4], p[:, 3, 5] = 137, 0  # stuffing
    e = np.empty((n, 590), np.uint8)
    e[:, :9] = np.frombuffer(b"\x00\x00\x01" + bytes([STREAM_ID]) + (UNIT + 8).to_bytes(2, "big") + b"\x80\x80\x05", np.uint8)
    for k, v in enumerate((0x21 | (pts >> 30 & 7) << 1, pts >> 22, pts >> 14 | 1, pts >> 7, pts << 1 | 1)):
        e[:, 9 + k] = v & 255
    e[:, 14:] = np.frombuffer(payload, np.uint8).reshape(n, UNIT)
    p[:, 0, 12:] = e[:, :176]
    p[:, 1, 4:], p[:, 2, 4:], p[:, 3, 142:] = e[:, 176:360], e[:, 360:544], e[:, 544:]
    return TABLES + p.tobytes()


def _starts(p: np.ndarray) -> np.ndarray:
    """Where the payload of each packet begins."""
    control = p[:, 3] >> 4 & 3
    return np.where(control == 1, 4, np.where(control == 3, np.minimum(5 + p[:, 4].astype(np.int64), PACKET), PACKET))


def _read_section(p: np.ndarray, pid: np.ndarray, want: int, table: int) -> bytes | None:
    """The body of the first whole section of ``table`` on PID ``want``; None if there is none or its CRC is wrong."""
    rows = np.flatnonzero(pid == want)
    begins = p[rows, 1] & 0x40 > 0
    for k in np.flatnonzero(begins):
        s = b""
        for i, r in enumerate(rows[k:]):
            data = p[r, _starts(p[r : r + 1])[0] :].tobytes()
            if i == 0:
                data = data[1 + data[0] :] if data else b""
            elif begins[k + i]:  # the rest of this section is before the pointer
                data = data[1 : 1 + data[0]] if data else b""
            s += data
            length = int.from_bytes(s[1:3], "big") & 0xFFF
            if len(s) >= 3 and len(s) >= 3 + length or i and begins[k + i]:
                break
        if len(s) >= 3 + length and length >= 9 and s[0] == table and crc32_mpeg(s[: 3 + length]) == 0:
            return s[8 : 3 + length - 4]
    return None


def demux_bytes(media: bytes) -> dict:
    """payload, pts (of each unit), access (numbers of the units that are random-access points), packets, errors."""
    p = np.frombuffer(media, np.uint8)
    p = p[: len(p) // PACKET * PACKET].reshape(-1, PACKET)
    out = {"payload": b"", "pts": np.zeros(0, np.int64), "access": np.zeros(0, np.int64), "packets": len(p), "errors": int((p[:, 0] != SYNC).sum()) + (len(media) % PACKET > 0)}
    pid = (p[:, 1].astype(np.int64) & 31) << 8 | p[:, 2]
    pat = _read_section(p, pid, PAT_PID, 0)
    pmt = _read_section(p, pid, int.from_bytes(pat[2:4], "big") & 0x1FFF, 2) if pat else None
    if not pmt:
        return out | {"errors": out["errors"] + 1}
    at = 4 + (int.from_bytes(pmt[2:4], "big") & 0xFFF)
    data_pid = int.from_bytes(pmt[at + 1 : at + 3], "big") & 0x1FFF
    p = p[pid == data_pid]
    again = np.zeros(len(p), bool)
    again[1:] = (p[1:] == p[:-1]).all(1)
    p = p[~again]
    starts = _starts(p)
    has = starts < PACKET
    marked = (p[:, 3] & 0x20 > 0) & (p[:, 4] > 0) & (p[:, 5] & 0x80 > 0)
    counter = (p[:, 3] & 15).astype(np.int64)[has]
    out["errors"] += int((((np.diff(counter) - 1) % 16 != 0) & ~marked[has][1:]).sum())
    begins = (p[:, 1] & 0x40 > 0) & has
    if not begins.any():
        return out | {"errors": out["errors"] + 1}
    first, s = p[begins], starts[begins]
    rows = np.arange(len(first))
    head = first[rows[:, None], np.minimum(s[:, None] + np.arange(14), PACKET - 1)].astype(np.int64)
    out["errors"] += int(((head[:, 0] != 0) | (head[:, 1] != 0) | (head[:, 2] != 1)).sum())
    stamped = head[:, 7] & 0x80 > 0
    pts = (head[:, 9] >> 1 & 7) << 30 | head[:, 10] << 22 | head[:, 11] >> 1 << 15 | head[:, 12] << 7 | head[:, 13] >> 1
    out["pts"] = np.where(stamped, pts, -1)
    adapted = (first[:, 3] & 0x20 > 0) & (first[:, 4] > 0)
    out["access"] = np.flatnonzero(adapted & (first[:, 5] & 0x40 > 0))
    skip = starts.copy()
    skip[begins] = s + 9 + head[:, 8]
    unit = np.cumsum(begins) - 1
    keep = (np.arange(PACKET) >= skip[:, None]) & (has & (unit >= 0))[:, None]
    sizes = np.bincount(unit[unit >= 0], keep.sum(1)[unit >= 0], len(first)).astype(np.int64)
    stated = (head[:, 4] << 8 | head[:, 5]) - 3 - head[:, 8]
    out["errors"] += int((sizes != stated).sum())
    return out | {"payload": p[keep].tobytes()}


def feature(d: dict) -> str:
    """What is stored of the stream besides the payload, and the mean, spread and distinct values of its bytes."""
    x = np.frombuffer(d["payload"], np.uint8)
    c = np.bincount(x, minlength=256).astype(np.int64)
    n, s, q = int(c.sum()), int((c * np.arange(256)).sum()), int((c * np.arange(256) ** 2).sum())
    mean = s / n if n else 0.0
    pts, access = d["pts"], d["access"]
    times = pts[access]
    return f"packets={d['packets']};units={len(pts)};access={len(access)};first={times[0] if len(times) else -1};last={times[-1] if len(times) else -1};end={pts[-1] if len(pts) else -1};errors={d['errors']};mean={mean:.3f};std={max(0.0, q / n - mean * mean) ** 0.5 if n else 0.0:.3f};values={int((c > 0).sum())}"


def mux(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (the stream) of each row of docs (doc_id, text)."""
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in portions(b, 1):
                texts = [t.encode() for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, texts), pa.int64()), pa.array([mux_bytes(payload_of(t)) for t in texts], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit(""))).mapInArrow(run, f"doc_id {id_type}, n_bytes long, media binary")


def access_points(media: DataFrame) -> DataFrame:
    """doc_id, pts (array, all units), access_units and access_pts (arrays) of each stream."""
    id_type = media.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in portions(b, 1):
                found = [demux_bytes(m or b"") for m in part.column(1).to_pylist()]
                lists = [pa.array(x, pa.list_(pa.int64())) for x in ([d["pts"] for d in found], [d["access"] for d in found], [d["pts"][d["access"]] for d in found])]
                yield pa.RecordBatch.from_arrays([part.column(0), *lists], ["doc_id", "pts", "access_units", "access_pts"])

    return media.select("doc_id", "media").mapInArrow(run, f"doc_id {id_type}, pts array<long>, access_units array<long>, access_pts array<long>")


def demux(media: DataFrame) -> DataFrame:
    """What ``mux`` stored, read back: the contract's columns, and access: unit:time stamp of the random-access points, comma-joined."""
    id_type = media.schema["doc_id"].dataType.simpleString()
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "access"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in portions(b, 2):
                rows = []
                for m in part.column(2).to_pylist():
                    d = demux_bytes(m)
                    x = d["payload"]
                    points = ",".join(f"{u}:{t}" for u, t in zip(d["access"].tolist(), d["pts"][d["access"]].tolist(), strict=True))
                    rows.append((len(x), hashlib.sha256(x).hexdigest(), zlib.crc32(x[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature(d), points))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(v, t) for v, t in zip(zip(*rows, strict=True), types, strict=True))], ["doc_id", "n_bytes", *names])

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, f"doc_id {id_type}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, access string")
