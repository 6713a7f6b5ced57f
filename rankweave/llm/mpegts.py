"""Media columns as MPEG transport streams.

``mux`` stores bytes losslessly as access units in PES packets of one program: a program association
table, a program map table, then for every unit TS packets of 188 bytes with continuity counters,
a clock reference, a timestamp, and the random-access flag on every ``RANDOM_ACCESS``-th unit.
``demux`` parses the tables with their checksums, checks the counters, drops repeated packets,
reassembles the packets of each elementary stream and gives back the units with their timestamps.

The stream carries its payload's bytes as they are, so any bytes survive the round trip; a lost or
reordered packet shows as a continuity error, a damaged table as a ``ValueError``.

Defined results: null content counts as empty; an empty payload has the two tables and no unit.
Equal contents give equal streams.  Contents are stored whole, whatever their length.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankweave.llm.textbatch import column, slices

PACKET = 188
MAP_PID, DATA_PID, STREAM_TYPE = 0x1000, 0x0100, 0x06  #: private data in PES packets
PES_HEAD, FIRST_ROOM, ROOM = 14, 176, 184
UNIT = FIRST_ROOM - PES_HEAD + 44 * ROOM  #: a full unit fills its packets to the last byte
TICKS, RANDOM_ACCESS = 3003, 8
BATCH_BYTES = 8_000_000


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 24
        for _ in range(8):
            c = (c << 1 ^ 0x04C11DB7 if c & 0x80000000 else c << 1) & 0xFFFFFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def section_crc(data: bytes) -> int:
    """The checksum of program tables: 0 over a section that ends with its own."""
    c = 0xFFFFFFFF
    for b in data:
        c = (c << 8 & 0xFFFFFFFF) ^ _CRC[c >> 24 ^ b]
    return c


def _table_packet(pid: int, table_id: int, number: int, body: bytes) -> bytes:
    section = struct.pack(">BHHBBB", table_id, 0xB000 | (len(body) + 9), number, 0xC1, 0, 0) + body
    section += struct.pack(">I", section_crc(section))
    head = struct.pack(">BHB", 0x47, 0x4000 | pid, 0x10) + b"\0"
    return (head + section).ljust(PACKET, b"\xff")


_TABLES = _table_packet(0, 0, 1, struct.pack(">HH", 1, 0xE000 | MAP_PID)) + _table_packet(MAP_PID, 2, 1, struct.pack(">HHBHH", 0xE000 | DATA_PID, 0xF000, STREAM_TYPE, 0xE000 | DATA_PID, 0xF000))


def _stamp(pts: int) -> bytes:
    return bytes([0x21 | pts >> 29 & 0x0E, pts >> 22 & 0xFF, pts >> 14 & 0xFE | 1, pts >> 7 & 0xFF, pts << 1 & 0xFE | 1])


def mux(payload: bytes, unit: int = UNIT) -> bytes:
    """The transport stream of the payload, cut into units of ``unit`` bytes."""
    parts = [_TABLES]
    counter = 0
    for k, lo in enumerate(range(0, len(payload), unit)):
        data = payload[lo : lo + unit]
        pts = k * TICKS & 0x1FFFFFFFF
        pes = b"\0\0\1\xbd" + struct.pack(">H", len(data) + 8 if len(data) + 8 < 65536 else 0) + b"\x80\x80\x05" + _stamp(pts) + data
        clock = struct.pack(">IH", pts >> 1, (pts & 1) << 15 | 0x7E00)
        flags = 0x10 | (0x40 if k % RANDOM_ACCESS == 0 else 0)
        stuffing = max(0, FIRST_ROOM - len(pes))
        head = struct.pack(">BHB", 0x47, 0x4000 | DATA_PID, 0x30 | counter) + bytes([7 + stuffing, flags]) + clock + b"\xff" * stuffing
        parts.append(head + pes[:FIRST_ROOM])
        rest = len(pes) - FIRST_ROOM
        n = rest // ROOM
        if n > 0:
            block = np.empty((n, PACKET), np.uint8)
            block[:, 0] = 0x47
            block[:, 1] = DATA_PID >> 8
            block[:, 2] = DATA_PID & 0xFF
            block[:, 3] = 0x10 | (counter + 1 + np.arange(n)) % 16
            block[:, 4:] = np.frombuffer(pes, np.uint8, n * ROOM, FIRST_ROOM).reshape(n, ROOM)
            parts.append(block.tobytes())
            counter += n
        left = rest - max(n, 0) * ROOM
        if left > 0:
            gap = ROOM - left
            counter += 1
            field_ = bytes([gap - 1]) + (b"\0" + b"\xff" * (gap - 2) if gap > 1 else b"")
            parts.append(struct.pack(">BHB", 0x47, DATA_PID, 0x30 | counter % 16) + field_ + pes[len(pes) - left :])
        counter = (counter + 1) % 16
    return b"".join(parts)


@dataclass
class Unit:
    pid: int
    pts: int | None
    random_access: bool
    data: bytes


@dataclass
class Stream:
    programs: dict[int, int] = field(default_factory=dict)  #: program number to its map's PID
    types: dict[int, int] = field(default_factory=dict)  #: elementary PID to stream type
    packets: int = 0
    continuity_errors: int = 0
    repeated: int = 0
    units: list[Unit] = field(default_factory=list)


def _section(packet: np.ndarray, offset: int) -> bytes:
    raw = packet[offset:].tobytes()
    raw = raw[1 + raw[0] :]
    size = 3 + (struct.unpack(">H", raw[1:3])[0] & 0x0FFF)
    if size > len(raw) or section_crc(raw[:size]):
        raise ValueError("damaged program table")
    return raw[:size]


def demux(stream: bytes) -> Stream:
    """Programs, stream types, counters' errors and all access units, in the order of their first packets."""
    if len(stream) % PACKET:
        raise ValueError("not a whole number of packets")
    out = Stream(packets=len(stream) // PACKET)
    if not stream:
        return out
    p = np.frombuffer(stream, np.uint8).reshape(-1, PACKET)
    if (p[:, 0] != 0x47).any():
        raise ValueError("lost synchronisation")
    pid = (p[:, 1].astype(np.int32) & 0x1F) << 8 | p[:, 2]
    starts = (p[:, 1] & 0x40) != 0
    control = p[:, 3] >> 4 & 3
    counter = (p[:, 3] & 15).astype(np.int32)
    offset = np.where(control & 2, 5 + p[:, 4].astype(np.int32), 4)
    carries = (control & 1) != 0
    for i in np.flatnonzero((pid == 0) & starts & carries):
        body = _section(p[i], offset[i])[8:-4]
        out.programs.update({n: m & 0x1FFF for n, m in struct.iter_unpack(">HH", body) if n})
    for i in np.flatnonzero(np.isin(pid, list(out.programs.values())) & starts & carries):
        body = _section(p[i], offset[i])[8:-4]
        at = 4 + (struct.unpack(">H", body[2:4])[0] & 0x0FFF)
        while at + 5 <= len(body):
            kind, es, size = struct.unpack(">BHH", body[at : at + 5])
            out.types[es & 0x1FFF] = kind
            at += 5 + (size & 0x0FFF)
    order: list[tuple[int, Unit]] = []
    for es in sorted(out.types):
        at = np.flatnonzero((pid == es) & carries)
        if not len(at):
            continue
        step = np.diff(counter[at]) % 16
        again = np.zeros(len(at), bool)
        if (step == 0).any():
            again[1:] = (step == 0) & (p[at[1:], 4:] == p[at[:-1], 4:]).all(1)
        out.repeated += int(again.sum())
        at = at[~again]
        out.continuity_errors += int((np.diff(counter[at]) % 16 != 1).sum())
        rows = p[at]
        from_ = offset[at]
        if (from_ == 4).all():
            data = rows[:, 4:].tobytes()
        else:
            data = rows[np.arange(PACKET) >= from_[:, None]].tobytes()
        ends = np.cumsum(PACKET - from_)
        first = np.flatnonzero(starts[at])
        begin = (ends - (PACKET - from_))[first]
        for j, lo in enumerate(begin):
            pes = data[lo : begin[j + 1] if j + 1 < len(begin) else ends[-1]]
            if pes[:3] != b"\0\0\1" or len(pes) < 9:
                raise ValueError("damaged elementary packet")
            size = struct.unpack(">H", pes[4:6])[0]
            head = 9 + pes[8]
            pts = None
            if pes[7] & 0x80:
                b = pes[9:14]
                pts = (b[0] >> 1 & 7) << 30 | b[1] << 22 | b[2] >> 1 << 15 | b[3] << 7 | b[4] >> 1
            i = at[first[j]]
            entry = bool(control[i] & 2 and p[i, 4] and p[i, 5] & 0x40)
            order.append((int(i), Unit(es, pts, entry, pes[head : 6 + size if size else len(pes)])))
    out.units = [u for _, u in sorted(order, key=lambda x: x[0])]
    return out


def padded(content: bytes, to: int = 64) -> bytes:
    """Bytes 0 appended up to a positive multiple of ``to``."""
    return content.ljust(max(1, -(-len(content) // to)) * to, b"\0")


def store(df: DataFrame, content: str, media: str = "media") -> DataFrame:
    """``df`` with a binary column that holds the stream of each row's content."""
    return _mapped(df.drop(media), content, [(media, "binary", pa.binary())], lambda b: [mux(b)])


def read(df: DataFrame, media: str = "media") -> DataFrame:
    """``df`` with the stream's payload and its units: pid, timestamp, random access, offset, length."""

    def parse(b: bytes) -> list:
        found = demux(b)
        units, at = [], 0
        for u in found.units:
            units.append({"pid": u.pid, "pts": u.pts, "random_access": u.random_access, "offset": at, "length": len(u.data)})
            at += len(u.data)
        return [b"".join(u.data for u in found.units), units, found.continuity_errors]

    kind = pa.list_(pa.struct([("pid", pa.int32()), ("pts", pa.int64()), ("random_access", pa.bool_()), ("offset", pa.int64()), ("length", pa.int64())]))
    spark_kind = "array<struct<pid: int, pts: bigint, random_access: boolean, offset: bigint, length: bigint>>"
    return _mapped(df.drop("payload", "units", "continuity_errors"), media, [("payload", "binary", pa.binary()), ("units", spark_kind, kind), ("continuity_errors", "bigint", pa.int64())], parse)


def digests(df: DataFrame, text: str = "text") -> DataFrame:
    """Each text's bytes stored and read back within one task: sizes, digests and the stream's features."""

    def trip(content: bytes) -> list:
        media = mux(padded(content))
        found = demux(media)
        back = b"".join(u.data for u in found.units)
        entries = [u.pts for u in found.units if u.random_access]
        feature = (
            f"program={','.join(map(str, found.programs))};streams={','.join(f'{k}:{v}' for k, v in found.types.items())};packets={found.packets};units={len(found.units)}"
            f";pts={found.units[0].pts}-{found.units[-1].pts};random_access={len(entries)}:{entries[-1]};continuity_errors={found.continuity_errors}"
        )
        return [len(content), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature]

    added = [("n_bytes", "bigint", pa.int64()), ("payload_bytes", "bigint", pa.int64()), ("payload_sha256", "string", pa.string()), ("tail_crc32", "bigint", pa.int64()), ("media_bytes", "bigint", pa.int64()), ("media_sha256", "string", pa.string()), ("feature", "string", pa.string())]
    base = df.withColumn(text, F.col(text).cast("binary")).drop(*(a[0] for a in added if a[0] != text))
    return _mapped(base, text, added, trip, drop=text)


def _mapped(df: DataFrame, source: str, added: list[tuple], function, drop: str | None = None) -> DataFrame:
    kept = [f for f in df.schema.fields if f.name != drop]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            contents = column(whole, source)
            others = [whole.column(i) for i, n in enumerate(whole.schema.names) if n != drop]
            for lo, hi in slices([len(c or b"") for c in contents], BATCH_BYTES):
                rows = [function(c or b"") for c in contents[lo:hi]]
                new = [pa.array([r[i] for r in rows], a[2]) for i, a in enumerate(added)]
                yield pa.RecordBatch.from_arrays([*(o.slice(lo, hi - lo) for o in others), *new], names=[*(f.name for f in kept), *(a[0] for a in added)])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), *(f"`{a[0]}` {a[1]}" for a in added)])
    return df.mapInArrow(run, schema)
