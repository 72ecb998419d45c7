"""Transforms that the entropy codecs share: 7-bit integers, bit packing, run lengths, stripes."""

from __future__ import annotations

from collections.abc import Callable

from .codecs import CodecError

# The bits of a stream's first byte. EXTRA is 32 lanes for rANS and a general compressor for the arithmetic coder.
ORDER, EXTRA, STRIPE, NO_SIZE, STORED, RUNS, PACKED = 1, 4, 8, 16, 32, 64, 128


class Source:
    """Bytes read from the front."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def byte(self) -> int:
        if self.at >= len(self.data):
            raise CodecError("block ends early")
        self.at += 1
        return self.data[self.at - 1]

    def take(self, n: int) -> bytes:
        if self.at + n > len(self.data):
            raise CodecError("block ends early")
        self.at += n
        return self.data[self.at - n : self.at]

    def rest(self) -> bytes:
        return self.take(len(self.data) - self.at)

    def uint7(self) -> int:
        v = 0
        while True:
            b = self.byte()
            v = v << 7 | b & 0x7F
            if b < 0x80:
                return v

    def alphabet(self) -> list[int]:
        """Symbols in order; of successive ones the first two are written and how many more follow. 0 ends."""
        found, s = [], self.byte()
        run = 0
        while True:
            found.append(s)
            if run:
                run -= 1
                s += 1
                continue
            s = self.byte()
            if s == 0:
                return found
            if s == found[-1] + 1:
                run = self.byte()


def uint7(v: int) -> bytes:
    out = [v & 0x7F]
    while v := v >> 7:
        out.append(0x80 | v & 0x7F)
    return bytes(reversed(out))


def alphabet(symbols: list[int]) -> bytes:
    out, i = bytearray(), 0
    while i < len(symbols):
        out.append(symbols[i])
        if i and symbols[i] == symbols[i - 1] + 1:
            more = 0
            while i + 1 < len(symbols) and symbols[i + 1] == symbols[i] + 1:
                more, i = more + 1, i + 1
            out.append(more)
        i += 1
    return bytes(out) + b"\0"


def pack(data: bytes) -> tuple[bytes, bytes] | None:
    """(what unpacking needs, packed bytes) of data with at most 16 symbols."""
    symbols = sorted(set(data))
    if not 0 < len(symbols) <= 16:
        return None
    width = 0 if len(symbols) == 1 else 1 if len(symbols) == 2 else 2 if len(symbols) <= 4 else 4
    code, out = {s: i for i, s in enumerate(symbols)}, bytearray()
    per = 8 // width if width else 0
    for k in range(0, len(data) if width else 0, per or 1):
        out.append(sum(code[s] << width * i for i, s in enumerate(data[k : k + per])))
    return bytes([len(symbols), *symbols]) + uint7(len(out)), bytes(out)


def read_packing(s: Source) -> tuple[bytes, int]:
    """(symbols, size of the packed data)."""
    return s.take(s.byte()), s.uint7()


def unpack(data: bytes, symbols: bytes, size: int) -> bytes:
    if len(symbols) <= 1:
        return symbols * size
    width = 1 if len(symbols) == 2 else 2 if len(symbols) <= 4 else 4
    if len(symbols) > 16:
        raise CodecError("too many symbols to be packed")
    out, mask = bytearray(), (1 << width) - 1
    for b in data:
        for i in range(8 // width):
            k = b >> width * i & mask
            out.append(symbols[k] if k < len(symbols) else symbols[0])
    if len(out) < size:
        raise CodecError("block ends early")
    return bytes(out[:size])


def striped(data: bytes, streams: int, encode: Callable[[bytes], bytes]) -> bytes:
    parts = [encode(data[j::streams]) for j in range(streams)]
    return bytes([streams]) + b"".join(uint7(len(p)) for p in parts) + b"".join(parts)


def unstriped(s: Source, size: int, decode: Callable[[bytes, int], bytes]) -> bytes:
    n = s.byte()
    sizes = [s.uint7() for _ in range(n)]
    out = bytearray(size)
    for j, k in enumerate(sizes):
        out[j::n] = decode(s.take(k), size // n + (size % n > j))
    return bytes(out)
