"""Media columns as MPEG transport streams (operator 9).

``mux`` stores bytes as elementary packets in a 188-byte-packet transport
stream with one program; ``demux`` reads any such stream: it follows the
program association and map tables, checks section checksums and continuity
counters, reassembles elementary packets and notes their time stamps and
random-access points.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import DataFrame

from .common import annotate

# Fixed values of the format (ISO/IEC 13818-1).
PACKET = 188
SYNC = 0x47
PAT_PID = 0x0000
NULL_PID = 0x1FFF
PRIVATE_STREAM_1 = 0xBD
PRIVATE_DATA_TYPE = 0x06
CLOCK_WRAP = 1 << 33

# Choices of this writer.
PMT_PID = 0x1000
MEDIA_PID = 0x0100
PROGRAM = 1
#: Payload bytes in one elementary packet.
UNIT_BYTES = 3072
#: Every so many units the tables and a clock reference are repeated and the unit is a random-access point.
RANDOM_ACCESS_EVERY = 8
#: Ticks of the 90 kHz clock from one unit to the next.
UNIT_TICKS = 3600
#: Payloads are padded with spaces to a positive multiple of this.
PAD_TO = 192


@lru_cache(maxsize=1)
def _crc_table() -> tuple[int, ...]:
    def entry(c: int) -> int:
        for _ in range(8):
            c = (c << 1) ^ 0x04C11DB7 if c & 0x80000000 else c << 1
        return c & 0xFFFFFFFF

    return tuple(entry(i << 24) for i in range(256))


@lru_cache(maxsize=256)
def section_crc(data: bytes) -> int:
    """CRC-32 of table sections; 0 over a section with its checksum."""
    table, crc = _crc_table(), 0xFFFFFFFF
    for b in data:
        crc = ((crc << 8) & 0xFFFFFFFF) ^ table[(crc >> 24) ^ b]
    return crc


def _section(table_id: int, number: int, body: bytes) -> bytes:
    head = bytes([table_id]) + (0xB000 | len(body) + 9).to_bytes(2, "big") + number.to_bytes(2, "big") + b"\xc1\x00\x00"
    return head + body + section_crc(head + body).to_bytes(4, "big")


def _packet_head(pid: int, first: bool, counter: int, adaptation: bool) -> bytes:
    return bytes([SYNC, (0x40 if first else 0) | pid >> 8, pid & 0xFF, (0x30 if adaptation else 0x10) | counter])


@lru_cache(maxsize=64)
def _table_packet(pid: int, counter: int) -> bytes:
    if pid == PAT_PID:
        section = _section(0x00, 1, PROGRAM.to_bytes(2, "big") + (0xE000 | PMT_PID).to_bytes(2, "big"))
    else:
        stream = bytes([PRIVATE_DATA_TYPE]) + (0xE000 | MEDIA_PID).to_bytes(2, "big") + b"\xf0\x00"
        section = _section(0x02, PROGRAM, (0xE000 | MEDIA_PID).to_bytes(2, "big") + b"\xf0\x00" + stream)
    return (_packet_head(pid, True, counter, False) + b"\x00" + section).ljust(PACKET, b"\xff")


def _stamp(mark: int, ticks: int) -> bytes:
    return bytes([mark << 4 | (ticks >> 30 & 7) << 1 | 1]) + ((ticks >> 15 & 0x7FFF) << 1 | 1).to_bytes(2, "big") + ((ticks & 0x7FFF) << 1 | 1).to_bytes(2, "big")


def _ticks(b: bytes) -> int:
    return (b[0] >> 1 & 7) << 30 | int.from_bytes(b[1:3], "big") >> 1 << 15 | int.from_bytes(b[3:5], "big") >> 1


def mux(payload: bytes, unit_bytes: int = UNIT_BYTES) -> bytes:
    """A transport stream that carries ``payload`` in elementary packets of ``unit_bytes``."""
    out, counter = [], 0
    for k in range(-(-len(payload) // unit_bytes)):
        ticks = k * UNIT_TICKS % CLOCK_WRAP
        body = payload[k * unit_bytes : (k + 1) * unit_bytes]
        unit = b"\x00\x00\x01" + bytes([PRIVATE_STREAM_1]) + (len(body) + 8).to_bytes(2, "big") + b"\x84\x80\x05" + _stamp(2, ticks) + body
        extra = b""
        if k % RANDOM_ACCESS_EVERY == 0:
            tables = k // RANDOM_ACCESS_EVERY & 15
            out += [_table_packet(PAT_PID, tables), _table_packet(PMT_PID, tables)]
            extra = b"\x50" + (ticks << 15 | 0x3F << 9).to_bytes(6, "big")
        at, first = 0, True
        while at < len(unit):
            room = PACKET - 4 - (1 + len(extra) if extra else 0)
            left = len(unit) - at
            if left < room and not extra:
                stuffing = room - left - 1
                adaptation = b"" if stuffing < 0 else bytes([stuffing]) + (b"\x00" + b"\xff" * (stuffing - 1) if stuffing else b"")
            elif extra:
                adaptation = bytes([len(extra) + max(0, room - left)]) + extra + b"\xff" * max(0, room - left)
            else:
                adaptation = b""
            take = PACKET - 4 - len(adaptation)
            out.append(_packet_head(MEDIA_PID, first, counter, bool(adaptation)) + adaptation + unit[at : at + take])
            at, counter, first, extra = at + take, counter + 1 & 15, False, b""
    return b"".join(out)


@dataclass
class Unit:
    """One elementary packet."""

    pid: int
    stream_id: int
    pts: int | None
    dts: int | None
    random_access: bool
    data: bytes


@dataclass
class Stream:
    """What a transport stream holds."""

    programs: dict[int, int] = field(default_factory=dict)  # program number to the PID of its map
    streams: dict[int, int] = field(default_factory=dict)  # PID to stream type
    carried: dict[int, list[int]] = field(default_factory=dict)  # program number to its streams' PIDs, as its map lists them
    units: list[Unit] = field(default_factory=list)  # in order of their first packet
    packets: int = 0
    continuity_errors: int = 0
    bad_sections: int = 0
    damaged: int = 0  # packets without the sync byte, flagged as errors, or cut short; elementary packets cut short

    def payload(self, pid: int) -> bytes:
        return b"".join(u.data for u in self.units if u.pid == pid)

    def first_program(self) -> bytes:
        """The units of the first program's streams, in order of their first packets."""
        first = next((n for n in self.programs if n in self.carried), None)
        pids = set(self.carried.get(first, ()))
        return b"".join(u.data for u in self.units if u.pid in pids)


def _table(s: Stream, pid: int, data: bytes) -> None:
    section = data[1 + data[0] :] if data else b""
    length = 3 + (int.from_bytes(section[1:3], "big") & 0xFFF) if len(section) >= 3 else 0
    section = section[:length]
    if length < 12 or len(section) < length or section_crc(bytes(section)):
        s.bad_sections += 1
    elif pid == PAT_PID and section[0] == 0x00:
        for at in range(8, length - 4, 4):
            number, where = int.from_bytes(section[at : at + 2], "big"), int.from_bytes(section[at + 2 : at + 4], "big") & 0x1FFF
            if number:
                s.programs[number] = where
    elif section[0] == 0x02:
        at = 12 + (int.from_bytes(section[10:12], "big") & 0xFFF)
        own = s.carried[int.from_bytes(section[3:5], "big")] = []
        while at + 5 <= length - 4:
            carried = int.from_bytes(section[at + 1 : at + 3], "big") & 0x1FFF
            s.streams[carried] = section[at]
            own.append(carried)
            at += 5 + (int.from_bytes(section[at + 3 : at + 5], "big") & 0xFFF)


def _unit(s: Stream, pid: int, random_access: bool, parts: list[bytes]) -> Unit | None:
    data = b"".join(parts)
    if len(data) < 9 or data[:3] != b"\x00\x00\x01":
        s.damaged += 1
        return None
    length, flags, start = int.from_bytes(data[4:6], "big"), data[7] >> 6, 9 + data[8]
    end = 6 + length if length else len(data)
    if end > len(data) or start > end:
        s.damaged += 1
    pts = _ticks(data[9:14]) if flags & 2 else None
    dts = _ticks(data[14:19]) if flags == 3 else pts
    return Unit(pid, data[3], pts, dts, random_access, data[start:end])


def demux(data: bytes) -> Stream:
    """Read a transport stream; damage is counted, not raised."""
    s = Stream()
    last: dict[int, tuple[int, bytes]] = {}
    # per PID: slot in order of first packets, random access, pieces
    building: dict[int, tuple[int, bool, list[bytes]]] = {}
    slots: list[Unit | None] = []
    maps: set[int] = set()

    def close(pid: int) -> None:
        if got := building.pop(pid, None):
            slots[got[0]] = _unit(s, pid, got[1], got[2])

    for at in range(0, len(data), PACKET):
        p = data[at : at + PACKET]
        s.packets += 1
        if len(p) < PACKET or p[0] != SYNC or p[1] & 0x80:
            s.damaged += 1
            continue
        pid, first, control, counter = (p[1] & 0x1F) << 8 | p[2], bool(p[1] & 0x40), p[3] >> 4 & 3, p[3] & 15
        if pid == NULL_PID:
            continue
        start, flags = 4, 0
        if control & 2:
            start, flags = 5 + p[4], p[5] if p[4] else 0
        if not control & 1 or start >= PACKET:
            continue
        before = last.get(pid)
        if before and not flags & 0x80:
            if counter == before[0] and p == before[1]:
                continue  # a packet may be sent twice
            if counter != before[0] + 1 & 15:
                s.continuity_errors += 1
        last[pid] = (counter, p)
        if pid == PAT_PID or pid in maps:
            if first:
                _table(s, pid, p[start:])
                maps = set(s.programs.values())
        elif pid in s.streams:
            if first:
                close(pid)
                building[pid] = (len(slots), bool(flags & 0x40), [])
                slots.append(None)
            if pid in building:
                building[pid][2].append(p[start:])
    for pid in list(building):
        close(pid)
    s.units = [u for u in slots if u is not None]
    return s


def padded(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text in UTF-8, and those padded with spaces to a positive multiple of ``PAD_TO``."""
    raw = (text or "").encode()
    return len(raw), raw.ljust(max(1, -(-len(raw) // PAD_TO)) * PAD_TO, b" ")


def feature(s: Stream) -> str:
    """Packets, units, random-access points and their time stamps, and what was wrong."""
    points = [u.pts for u in s.units if u.random_access]
    stamps = [u.pts for u in s.units if u.pts is not None]
    return (
        f"packets={s.packets} programs={len(s.programs)} types={','.join(str(t) for _, t in sorted(s.streams.items()))} "
        f"units={len(s.units)} first_pts={stamps[0] if stamps else '-'} last_pts={stamps[-1] if stamps else '-'} "
        f"random_access={','.join(map(str, points))} continuity_errors={s.continuity_errors} "
        f"bad_sections={s.bad_sections} damaged={s.damaged}"
    )


def store_media(df: DataFrame, text: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` plus ``n_bytes`` and ``media``: every whole text as a transport stream.

    A null text is stored as an empty one (192 spaces), a very long one whole.
    Repeated rows give repeated streams; an empty table gives an empty one;
    other columns are ignored.
    """

    def run(texts):
        got = [padded(t) for t in texts]
        return [n for n, _ in got], [mux(p) for _, p in got]

    return annotate(df, [text], "n_bytes bigint, media binary", lambda: run, keep)


def read_media(df: DataFrame, media: str = "media", keep: Sequence[str] = ("doc_id", "n_bytes")) -> DataFrame:
    """``keep`` plus digests, ``feature`` and the payload's checksums, read from stored streams.

    The payload is the units of the first program's streams in order. A null
    stream is read as one without packets, with an empty payload.
    """

    def run(streams):
        rows = []
        for m in streams:
            m = m or b""
            s = demux(m)
            back = s.first_program()
            rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature(s)))
        return list(zip(*rows, strict=True))

    fields = "payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string"
    return annotate(df, [media], fields, lambda: run, keep)


def media_units(df: DataFrame, media: str = "media", key: str = "doc_id") -> DataFrame:
    """One row for each elementary packet: key, pid, unit number, time stamps, random access, data size."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = []
            for k, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                rows += [(k, u.pid, i, u.pts, u.dts, u.random_access, len(u.data)) for i, u in enumerate(demux(m or b"").units)]
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = [b.schema.field(0).type, pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, t in zip(columns, kinds, strict=True)], names=names)

    names = [key, "pid", "unit", "pts", "dts", "random_access", "n_bytes"]
    kind = df.schema[key].dataType.simpleString()
    fields = f"`{key}` {kind}, pid bigint, unit bigint, pts bigint, dts bigint, random_access boolean, n_bytes bigint"
    return df.select(key, media).mapInArrow(run, fields)
