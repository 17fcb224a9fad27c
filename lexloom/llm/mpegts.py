"""MPEG transport streams in media columns: write, parse, check and read back.

A stream is a row of 188-byte packets: a program association table, a program map table, then the payload in elementary (PES)
packets of up to `PES_BYTES` bytes, each opened by a packet with the unit-start flag, a time stamp, a clock reference and, every `RAP_EVERY`
units, a random-access flag. `demux` checks the continuity counter of every packet identifier (packets without payload don't count, one repeat of
a packet is dropped, the discontinuity flag is heeded), reassembles table sections over their packets and checks their CRCs, follows the
tables from program 0's pointer to the first elementary stream, strips adaptation fields wherever they are, reassembles the elementary packets
and lists their time stamps, clock references and random-access points. A broken stream raises ValueError with the packet's number.

`store` and `read` are the DataFrame forms. A null text is an empty one, whose payload is 64 zero bytes; equal texts give equal rows;
a null media value gives nulls; an empty table gives no rows; other columns of the input pass through `read` and are not read by `store`.
"""

from __future__ import annotations

import hashlib
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks

#: Fixed values of the format (ISO/IEC 13818-1): packet and payload bytes, sync byte, clock rate, CRC polynomial, stream type and id of private data.
PACKET, BODY, SYNC, CLOCK, POLYNOMIAL, STREAM_TYPE, STREAM_ID = 188, 184, 0x47, 90_000, 0x04C11DB7, 0x06, 0xBD
PMT_PID, ES_PID, NULL_PID = 0x100, 0x101, 0x1FFF
PES_BYTES, RAP_EVERY, FRAMES_PER_SECOND = 16_384, 4, 25
UNIT = 64


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint64) << np.uint64(24)
    for _ in range(8):
        table = np.where(table & np.uint64(0x80000000), (table << np.uint64(1)) ^ np.uint64(POLYNOMIAL), table << np.uint64(1)) & np.uint64(0xFFFFFFFF)
    return table


_CRC = [int(x) for x in _crc_table()]


def section_crc(data: bytes) -> int:
    crc = 0xFFFFFFFF
    for b in data:
        crc = (crc << 8 & 0xFFFFFFFF) ^ _CRC[crc >> 24 ^ b]
    return crc


def _section(table_id: int, key: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + key.to_bytes(2, "big") + b"\xc1\x00\x00" + body
    return head + section_crc(head).to_bytes(4, "big")


def _table_packet(pid: int, section: bytes) -> bytes:
    head = bytes([SYNC]) + (0x4000 | pid).to_bytes(2, "big") + b"\x10\x00"
    return (head + section).ljust(PACKET, b"\xff")


TABLES = _table_packet(0, _section(0, 1, (1).to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))) + _table_packet(
    PMT_PID, _section(2, 1, (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00" + bytes([STREAM_TYPE]) + (0xE000 | ES_PID).to_bytes(2, "big") + b"\xf0\x00")
)


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | (pts >> 29 & 0x0E)]) + ((pts >> 14 & 0xFFFE) | 1).to_bytes(2, "big") + ((pts << 1 & 0xFFFE) | 1).to_bytes(2, "big")


def mux(payload: bytes) -> bytes:
    """The payload as a transport stream."""
    parts, counter = [TABLES], 0
    for unit, at in enumerate(range(0, len(payload), PES_BYTES)):
        data = payload[at : at + PES_BYTES]
        pes = b"\x00\x00\x01" + bytes([STREAM_ID]) + (len(data) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(unit * CLOCK // FRAMES_PER_SECOND % 2**33) + data
        clock = unit * CLOCK // FRAMES_PER_SECOND
        # the first packet's adaptation field: length, flags, clock reference
        flags = bytes([7, 0x10 | (0x40 if unit % RAP_EVERY == 0 else 0)]) + ((clock % 2**33 << 15) | 0x7E00).to_bytes(6, "big")
        room = BODY - len(flags)
        first, rest = pes[:room], pes[room:]
        if len(first) < room:
            pad = room - len(first)
            flags = bytes([7 + pad]) + flags[1:] + b"\xff" * pad
        whole, tail = divmod(len(rest), BODY)
        n = 1 + whole + (tail > 0)
        out = np.full((n, PACKET), 0xFF, dtype=np.uint8)
        out[:, 0], out[:, 1], out[:, 2] = SYNC, ES_PID >> 8, ES_PID & 0xFF
        out[:, 3] = 0x10 | ((counter + np.arange(n)) & 15)
        out[0, 1] |= 0x40
        out[0, 3] |= 0x20
        out[0, 4:] = np.frombuffer(flags + first, dtype=np.uint8)
        body = np.frombuffer(rest, dtype=np.uint8)
        out[1 : 1 + whole, 4:] = body[: whole * BODY].reshape(whole, BODY)
        if tail:
            stuffing = BODY - tail - 1
            out[-1, 3] |= 0x20
            out[-1, 4] = stuffing
            if stuffing:
                out[-1, 5] = 0
            out[-1, PACKET - tail :] = body[whole * BODY :]
        counter = (counter + n) & 15
        parts.append(out.tobytes())
    return b"".join(parts)


def _kept(packets: np.ndarray, pids: np.ndarray, skip: np.ndarray) -> np.ndarray:
    """Which packets carry payload and repeat no other; the counters of every identifier but the null packets' are checked on the way."""
    carries, counters = (packets[:, 3] & 0x10) > 0, packets[:, 3].astype(np.int64) & 15
    keep = carries & (pids != NULL_PID)
    breaks = (skip > 1) & ((packets[:, 5] & 0x80) > 0)
    for pid in np.unique(pids[pids != NULL_PID]).tolist():
        own = np.flatnonzero(pids == pid)
        c, has = counters[own], carries[own]
        ok = ((c[1:] - c[:-1]) % 16 == has[1:]) | breaks[own[1:]]
        if ok.all():
            continue
        last = 0  # the packet before, and whether it was a repeat already
        repeated = False
        for k in range(1, len(own)):
            if ok[k - 1]:
                last, repeated = k, False
            elif has[k] and has[last] and c[k] == c[last] and not repeated and _same(packets[own[k]], packets[own[last]]):
                keep[own[k]], repeated = False, True
            else:
                raise ValueError(f"continuity is lost before packet {own[k]} of identifier {pid}")
    return keep


def _same(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether one packet repeats the other; its clock reference may differ."""
    unlike = a != b
    if a[3] & 0x20 and a[4] and a[5] & 0x10:
        unlike[6:12] = False
    return not unlike.any()


def _section_of(packets: np.ndarray, own: np.ndarray, skip: np.ndarray, table_id: int, pid: int) -> bytes:
    """The body of the identifier's first section with this table id; a section may go on over several packets."""
    held, broken = None, None
    for k in own.tolist():
        raw = packets[k, 4 + skip[k] :].tobytes()
        if packets[k, 1] & 0x40:
            # the pointer tells where the first new section starts; what is before ends the old one
            held, rest = (b"" if held is None else held + raw[1 : 1 + raw[0]]), raw[1 + raw[0] :]
            parts = [held, rest] if held else [rest]
        else:
            parts = [held + raw] if held is not None else []
        held = None
        for part in parts:
            while len(part) >= 3 and part[0] != 0xFF:
                length = 3 + (int.from_bytes(part[1:3], "big") & 0xFFF)
                if len(part) < length:
                    break
                if section_crc(part[:length]):
                    broken = k
                elif part[0] == table_id:
                    return part[8 : length - 4]
                part = part[length:]
            held = part if part and part[0] != 0xFF else None
    raise ValueError(f"no packet of table {pid}" if broken is None else f"table {pid} is broken in packet {broken}")


def demux(stream: bytes) -> tuple[bytes, dict]:
    """The payload, and what the stream shows: packets, units, time stamps, clock references and random-access points."""
    if len(stream) % PACKET:
        raise ValueError("not whole packets")
    packets = np.frombuffer(stream, dtype=np.uint8).reshape(-1, PACKET)
    if not (packets[:, 0] == SYNC).all():
        raise ValueError(f"no sync byte in packet {int(np.argmax(packets[:, 0] != SYNC))}")
    pids = (packets[:, 1].astype(np.int32) & 0x1F) << 8 | packets[:, 2]
    adapted = (packets[:, 3] & 0x20) > 0
    skip = np.where(adapted, packets[:, 4].astype(np.int64) + 1, 0)
    if (skip > BODY).any():
        raise ValueError(f"the adaptation field is too long in packet {int(np.argmax(skip > BODY))}")
    keep = _kept(packets, pids, skip)
    table = lambda pid, table_id: _section_of(packets, np.flatnonzero(keep & (pids == pid)), skip, table_id, pid)
    programs = table(0, 0)
    pmt = next(int.from_bytes(programs[i + 2 : i + 4], "big") & 0x1FFF for i in range(0, len(programs), 4) if programs[i : i + 2] != b"\0\0")
    streams = table(pmt, 2)
    clock_pid = int.from_bytes(streams[0:2], "big") & 0x1FFF
    at = 4 + (int.from_bytes(streams[2:4], "big") & 0xFFF)
    es = int.from_bytes(streams[at + 1 : at + 3], "big") & 0x1FFF
    flagged = np.where(skip > 1, packets[:, 5], 0)
    clocks = []
    for k in np.flatnonzero((pids == clock_pid) & ((flagged & 0x10) > 0)).tolist():
        value = int.from_bytes(packets[k, 6:12].tobytes(), "big")
        clocks.append((value >> 15) * 300 + (value & 0x1FF))
    own = np.flatnonzero(keep & (pids == es))
    mine, skipped = packets[own], skip[own]
    starts = np.flatnonzero(mine[:, 1] & 0x40)
    if len(own) and (not len(starts) or starts[0]):
        raise ValueError(f"the elementary stream does not begin with a unit in packet {own[0]}")
    body = mine[:, 4:][np.arange(BODY) >= skipped[:, None]].tobytes() if skipped.any() else mine[:, 4:].tobytes()
    ends = np.concatenate([[0], np.cumsum(BODY - skipped)])
    payload, stamps, points = [], [], []
    for k, a in enumerate(starts.tolist()):
        b = int(starts[k + 1]) if k + 1 < len(starts) else len(mine)
        pes = body[ends[a] : ends[b]]
        size = int.from_bytes(pes[4:6], "big")
        if pes[:3] != b"\0\0\1" or len(pes) != size + 6:
            raise ValueError(f"an elementary packet is broken in packet {own[a]}")
        pts = None
        if pes[7] & 0x80:
            s = pes[9:14]
            pts = (s[0] >> 1 & 7) << 30 | s[1] << 22 | (s[2] >> 1) << 15 | s[3] << 7 | s[4] >> 1
        stamps.append(pts)
        if flagged[own[a]] & 0x40:
            points.append((int(own[a]), pts))
        payload.append(pes[9 + pes[8] :])
    return b"".join(payload), {"packets": len(packets), "units": len(starts), "stuffing": int(skipped.sum()), "stamps": stamps, "clocks": clocks, "random_access": points}


def padded(text: str) -> tuple[bytes, int]:
    raw = text.encode()
    return raw + b"\0" * (max(UNIT, -(-len(raw) // UNIT) * UNIT) - len(raw)), len(raw)


def feature(found: dict) -> str:
    return json.dumps({"packets": found["packets"], "units": found["units"], "stuffing": found["stuffing"], "last_pts": found["stamps"][-1], "random_access": [p for p, _ in found["random_access"]][:1] + [len(found["random_access"])]}, separators=(",", ":"))


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each text as a stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            made = [padded(x) for x in part["text"]]
            yield pa.RecordBatch.from_arrays([pa.array(part["doc_id"], pa.int64()), pa.array([n for _, n in made], pa.int64()), pa.array([mux(p) for p, _ in made], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def read(media: DataFrame, media_col: str = "media") -> DataFrame:
    """Adds payload, units, stamps and random-access points read back from the stored bytes."""

    @F.pandas_udf("payload binary, packets long, units long, stamps array<long>, random_access array<struct<packet: long, pts: long>>, feature string")
    def parse(column: pd.Series) -> pd.DataFrame:
        rows = []
        for x in column:
            if x is None:
                rows.append((None,) * 6)
                continue
            payload, found = demux(bytes(x))
            rows.append((payload, found["packets"], found["units"], found["stamps"], [{"packet": p, "pts": t} for p, t in found["random_access"]], feature(found)))
        return pd.DataFrame(rows, columns=["payload", "packets", "units", "stamps", "random_access", "feature"])

    return media.withColumn("read_back", parse(F.col(media_col)))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores each text, reads the stored bytes back, and returns digests of both forms; one pass, a slice of texts in memory at a time."""
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, units long, random_access_points long"
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            rows = []
            for doc_id, text in zip(part["doc_id"], part["text"], strict=True):
                payload, n = padded(text)
                media = mux(payload)
                back, found = demux(media)
                rows.append((doc_id, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(media), hashlib.sha256(media).hexdigest(), feature(found), found["units"], len(found["random_access"])))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[x.split()[0] for x in schema.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)
