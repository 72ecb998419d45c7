"""Read names by tokens: each one is coded against the one before it, token by token."""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field

from . import adaptive, nx16
from .codecs import CodecError
from .packing import ORDER, PACKED, RUNS, Source, uint7

# Token types.
TYPE, STRING, CHAR, DIGITS0, WIDTH, DUPLICATE, DIFFERENT, DIGITS, DELTA, DELTA0, MATCH, NOTHING, END = range(13)
NEW_POSITION, COPIED = 0x80, 0x40
_TOKEN = re.compile(rb"([1-9][0-9]{0,8}|0(?![0-9]))|(0[0-9]{1,8})|([^0-9\0]{2,})|([^\0])")


def tokens(name: bytes) -> list[tuple[int, object]]:
    """(type, value): numbers, padded ones as (number, width), strings, single characters."""
    out: list[tuple[int, object]] = []
    for m in _TOKEN.finditer(name):
        if m[1]:
            out.append((DIGITS, int(m[1])))
        elif m[2]:
            out.append((DIGITS0, (int(m[2]), len(m[2]))))
        elif m[3]:
            out.append((STRING, m[3]))
        else:
            out.append((CHAR, m[4][0]))
    return out


def text(found: list[tuple[int, object]]) -> bytes:
    parts = []
    for kind, v in found:
        if kind == DIGITS:
            parts.append(b"%d" % v)
        elif kind == DIGITS0:
            parts.append(b"%0*d" % (v[1], v[0]))
        elif kind == STRING:
            parts.append(v)
        elif kind == CHAR:
            parts.append(bytes([v]))
    return b"".join(parts)


@dataclass
class _Streams:
    """Bytes by token position and type."""

    held: list[dict[int, bytearray]] = field(default_factory=list)

    def put(self, position: int, kind: int, data: bytes) -> None:
        while len(self.held) <= position:
            self.held.append({})
        self.held[position].setdefault(kind, bytearray()).extend(data)


def encode(data: bytes, adaptively: bool = False) -> bytes:
    """Names that each end in a zero byte."""
    if data and not data.endswith(b"\0"):
        raise CodecError("a name without an end")
    names, streams = data.split(b"\0")[:-1], _Streams()
    before: list[tuple[int, object]] = []
    for n, name in enumerate(names):
        if n and name == names[n - 1]:
            streams.put(0, TYPE, bytes([DUPLICATE]))
            streams.put(0, DUPLICATE, struct.pack("<I", 1))
            continue
        streams.put(0, TYPE, bytes([DIFFERENT]))
        streams.put(0, DIFFERENT, struct.pack("<I", 1 if n else 0))
        found = tokens(name)
        for t, (kind, v) in enumerate(found, 1):
            last_kind, last = before[t - 1] if t <= len(before) else (None, None)
            if (kind, v) == (last_kind, last):
                streams.put(t, TYPE, bytes([MATCH]))
            elif kind == last_kind == DIGITS and 0 < v - last < 256:
                streams.put(t, TYPE, bytes([DELTA]))
                streams.put(t, DELTA, bytes([v - last]))
            elif kind == last_kind == DIGITS0 and v[1] == last[1] and 0 < v[0] - last[0] < 256:
                streams.put(t, TYPE, bytes([DELTA0]))
                streams.put(t, DELTA0, bytes([v[0] - last[0]]))
            else:
                streams.put(t, TYPE, bytes([kind]))
                if kind == DIGITS:
                    streams.put(t, DIGITS, struct.pack("<I", v))
                elif kind == DIGITS0:
                    streams.put(t, DIGITS0, struct.pack("<I", v[0]))
                    streams.put(t, WIDTH, bytes([v[1]]))
                else:
                    streams.put(t, kind, v + b"\0" if kind == STRING else bytes([v]))
        streams.put(len(found) + 1, TYPE, bytes([END]))
        before = found
    out = bytearray(struct.pack("<IIB", len(data), len(names), adaptively))
    known: dict[bytes, tuple[int, int]] = {}
    for position, kinds in enumerate(streams.held):
        for kind, stream in sorted(kinds.items()):
            head, body = kind | (NEW_POSITION if kind == TYPE else 0), bytes(stream)
            if body in known:
                out += bytes([head | COPIED, *known[body]])
                continue
            if position < 256:
                known[body] = position, kind
            coder = adaptive.encode if adaptively else nx16.encode
            packed = min((coder(body, flags) for flags in (0, ORDER, RUNS, PACKED)), key=len)
            out += bytes([head]) + uint7(len(packed)) + packed
    return bytes(out)


def decode(data: bytes, size: int | None = None) -> bytes:
    s = Source(data)
    _, count, adaptively = struct.unpack("<IIB", s.take(9))
    coder = adaptive.decode if adaptively else nx16.decode
    streams: list[dict[int, Source]] = []
    while s.at < len(data):
        head = s.byte()
        kind = head & 0x3F
        if head & NEW_POSITION:
            streams.append({})
            if kind != TYPE:
                # all names but the first match the one before here
                streams[-1][TYPE] = Source(bytes([kind]) + bytes([MATCH]) * (count - 1))
        if not streams:
            raise CodecError("a stream without position")
        if head & COPIED:
            position, of = s.byte(), s.byte()
            if position >= len(streams) or of not in streams[position]:
                raise CodecError("a copy of no stream")
            streams[-1][kind] = Source(streams[position][of].data)
        else:
            streams[-1][kind] = Source(coder(s.take(s.uint7())))
    every: list[list[tuple[int, object]]] = []
    for n in range(count):
        kind = _take(streams, 0, TYPE, 1)[0]
        if kind not in (DUPLICATE, DIFFERENT):
            raise CodecError("a name that is neither a copy nor another one")
        distance = struct.unpack("<I", _take(streams, 0, kind, 4))[0]
        if distance > n:
            raise CodecError("a name before the first")
        before = every[n - distance] if distance else []
        if kind == DUPLICATE:
            every.append(before)
            continue
        found: list[tuple[int, object]] = []
        t = 0
        while True:
            t += 1
            kind = _take(streams, t, TYPE, 1)[0]
            if kind == END:
                break
            found.append(_token(streams, t, kind, before[t - 1] if t <= len(before) else None))
        every.append(found)
    return b"".join(text(x) + b"\0" for x in every)


def _take(streams: list[dict[int, Source]], position: int, kind: int, n: int) -> bytes:
    if position >= len(streams) or kind not in streams[position]:
        raise CodecError("no stream for a token")
    return streams[position][kind].take(n)


def _token(streams, t: int, kind: int, before) -> tuple[int, object]:
    if kind == CHAR:
        return CHAR, _take(streams, t, CHAR, 1)[0]
    if kind == STRING:
        s = streams[t][STRING]
        end = s.data.find(b"\0", s.at)
        if end < 0:
            raise CodecError("a string without an end")
        return STRING, s.take(end + 1 - s.at)[:-1]
    if kind == DIGITS:
        return DIGITS, struct.unpack("<I", _take(streams, t, DIGITS, 4))[0]
    if kind == DIGITS0:
        return DIGITS0, (struct.unpack("<I", _take(streams, t, DIGITS0, 4))[0], _take(streams, t, WIDTH, 1)[0])
    if kind == MATCH and before is not None:
        return before
    if kind == DELTA and before is not None and before[0] == DIGITS:
        return DIGITS, before[1] + _take(streams, t, DELTA, 1)[0]
    if kind == DELTA0 and before is not None and before[0] == DIGITS0:
        return DIGITS0, (before[1][0] + _take(streams, t, DELTA0, 1)[0], before[1][1])
    if kind == NOTHING:
        return NOTHING, None
    raise CodecError("a token that goes back to none")
