"""Block codecs of reference-compressed containers: general compressors and rANS 4x8 (order 0 and 1)."""

from __future__ import annotations

import bz2
import gzip
import lzma
import struct
from collections import Counter

LOW = 1 << 23
BITS = 12
TOTAL = 1 << BITS

#: Level of gzip blocks, that of blocked gzip: higher ones take many times as long for a few hundredths of the size.
LEVEL = 6
GENERAL = {"gzip": (lambda data: gzip.compress(data, LEVEL, mtime=0), gzip.decompress), "bzip2": (bz2.compress, bz2.decompress), "lzma": (lzma.compress, lzma.decompress)}


class CodecError(ValueError):
    """A block that can't be decoded."""


def compress(method: str, data: bytes) -> bytes:
    """A block by ``rans0``, ``rans1``, a general compressor, or ``nx16``, ``arith``, ``names``, ``fqzcomp`` (with + and flags after the first two)."""
    if method in ("rans0", "rans1"):
        return rans_encode(data, int(method[-1]))
    if method in GENERAL:
        return GENERAL[method][0](data)
    name, _, flags = method.partition("+")
    if name in ("names", "fqzcomp"):
        from . import adaptive, names

        return names.encode(data) if name == "names" else adaptive.encode_qualities(data)
    return _later(name).encode(data, int(flags or 0))


def decompress(method: str, data: bytes, size: int | None = None) -> bytes:
    """What a block holds; some methods must be told its size."""
    if method.startswith("rans"):
        return rans_decode(data)
    if method in GENERAL:
        return GENERAL[method][1](data)
    name = method.partition("+")[0]
    if name == "fqzcomp":
        return _later("arith").decode_qualities(data, size)
    return _later(name).decode(data, size)


def _later(name: str):
    from . import adaptive, names, nx16

    found = {"nx16": nx16, "arith": adaptive, "names": names}
    if name not in found:
        raise CodecError(f"unknown method {name}")
    return found[name]


def normalised(counts: Counter[int]) -> dict[int, int]:
    """Frequencies that sum to ``TOTAL``, none of them 0, in order of symbols."""
    n = sum(counts.values())
    out = {s: max(1, c * TOTAL // n) for s, c in sorted(counts.items())}
    while (rest := TOTAL - sum(out.values())) != 0:
        # what is left over, or taken too much, goes to the most frequent, that loses least by it
        top = max(out, key=lambda s: out[s])
        out[top] += rest if out[top] + rest > 0 else 1 - out[top]
    return out


def _starts(freq: dict[int, int]) -> dict[int, int]:
    at, out = 0, {}
    for s, f in freq.items():
        out[s] = at
        at += f
    return out


def _write_symbols(symbols: list[int], body) -> bytes:
    """Symbols in order with ``body(symbol)`` after each; runs of successive ones are counted; 0 ends."""
    out, run = bytearray(), 0
    for i, s in enumerate(symbols):
        if run:
            run -= 1
        else:
            out.append(s)
            if i and symbols[i - 1] == s - 1:
                run = 0
                while i + run + 1 < len(symbols) and symbols[i + run + 1] == s + run + 1:
                    run += 1
                out.append(run)
        out += body(s)
    return bytes(out) + b"\0"


class _Reader:
    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, at

    def byte(self) -> int:
        if self.at >= len(self.data):
            raise CodecError("block ends early")
        self.at += 1
        return self.data[self.at - 1]

    def symbols(self):
        """The symbols that :func:`_write_symbols` wrote; the caller reads each one's body in between."""
        s, run = self.byte(), 0
        while True:
            yield s
            if run:
                run -= 1
                s += 1
            else:
                last, s = s, self.byte()
                if s == 0:
                    return
                if s == last + 1:
                    run = self.byte()

    def frequency(self) -> int:
        b = self.byte()
        return b if b < 0x80 else (b & 0x3F) << 8 | self.byte()


def _frequency(f: int) -> bytes:
    return bytes([f]) if f < 0x80 else bytes([0x80 | f >> 8, f & 0xFF])


def _table(freq: dict[int, int]) -> bytes:
    return _write_symbols(list(freq), lambda s: _frequency(freq[s]))


def _read_table(r: _Reader) -> tuple[dict[int, int], dict[int, int], bytes]:
    freq = {}
    for s in r.symbols():
        freq[s] = r.frequency()
    lookup = b"".join(bytes([s]) * f for s, f in sorted(freq.items()))
    if len(lookup) > TOTAL:
        raise CodecError("frequencies exceed their total")
    freq = dict(sorted(freq.items()))
    return freq, _starts(freq), lookup.ljust(TOTAL, lookup[-1:])


def _lanes(n: int) -> list[range]:
    """The four stretches that order 1 codes abreast; the last one takes the rest."""
    q = n // 4
    return [range(0, q), range(q, 2 * q), range(2 * q, 3 * q), range(3 * q, n)]


def rans_encode(data: bytes, order: int = 0) -> bytes:
    if not data:
        return struct.pack("<BII", order, 0, 0)
    if order and len(data) < 4:
        order = 0
    states, out = [LOW] * 4, bytearray()
    if order == 0:
        freq = normalised(Counter(data))
        start = _starts(freq)
        told = {s: (f, (LOW >> BITS << 8) * f, start[s]) for s, f in freq.items()}
        steps = zip([0, 1, 2, 3] * (len(data) // 4 + 1), map(told.__getitem__, data))
        table = _table(freq)
    else:
        lanes = _lanes(len(data))
        contexts = bytearray(b"\0" + data[:-1])
        for lane in lanes:
            contexts[lane.start] = 0
        pairs: dict[int, Counter[int]] = {}
        for (c, x), n in Counter(zip(contexts, data)).items():
            pairs.setdefault(c, Counter())[x] = n
        tables = {c: normalised(n) for c, n in sorted(pairs.items())}
        starts = {c: _starts(t) for c, t in tables.items()}
        told = {(c, s): (f, (LOW >> BITS << 8) * f, starts[c][s]) for c, t in tables.items() for s, f in t.items()}
        each = list(map(told.__getitem__, zip(contexts, data)))
        abreast = zip(*(each[lane.start : lane.start + len(lanes[0])] for lane in lanes))
        steps = [(j, x) for four in abreast for j, x in enumerate(four)] + [(3, x) for x in each[lanes[3].start + len(lanes[0]) :]]
        table = _write_symbols(list(tables), lambda c: _table(tables[c]))
    for lane, (f, most, begin) in reversed(list(steps)):
        x = states[lane]
        while x >= most:
            out.append(x & 0xFF)
            x >>= 8
        states[lane] = (x // f << BITS) + x % f + begin
    body = table + struct.pack("<4I", *states) + bytes(reversed(out))
    return struct.pack("<BII", order, len(body), len(data)) + body


def rans_decode(block: bytes) -> bytes:
    order, size, n = struct.unpack_from("<BII", block)
    if not n:
        return b""
    if len(block) < 9 + size or order > 1:
        raise CodecError("block ends early or is of unknown order")
    r = _Reader(block, 9)
    tables = {}
    if order:
        for c in r.symbols():
            tables[c] = _read_table(r)
    else:
        tables[0] = _read_table(r)
    states = list(struct.unpack_from("<4I", block, r.at))
    r.at += 16
    out = bytearray(n)

    # zeros behind the block: that they were read is seen after each symbol
    data, at, mask = block + bytes(8), r.at, TOTAL - 1
    if order == 0:
        freq, start, lookup = tables[0]
        for i in range(n):
            x = states[i & 3]
            low = x & mask
            out[i] = s = lookup[low]
            x = freq[s] * (x >> BITS) + low - start[s]
            while x < LOW:
                x = x << 8 | data[at]
                at += 1
            states[i & 3] = x
            if at > len(block):
                raise CodecError("block ends early")
        return bytes(out)
    lanes, context = _lanes(n), [0] * 4
    places = [(j, lanes[j].start + k) for k in range(len(lanes[0])) for j in range(4)] + [(3, i) for i in lanes[3][len(lanes[0]) :]]
    for j, i in places:
        freq, start, lookup = tables[context[j]]
        x = states[j]
        low = x & mask
        context[j] = out[i] = s = lookup[low]
        x = freq[s] * (x >> BITS) + low - start[s]
        while x < LOW:
            x = x << 8 | data[at]
            at += 1
        states[j] = x
        if at > len(block):
            raise CodecError("block ends early")
    return bytes(out)


def itf8(value: int) -> bytes:
    """A 32-bit integer in one to five bytes: leading ones tell how many follow."""
    v = value & 0xFFFFFFFF
    if v < 1 << 7:
        return bytes([v])
    if v < 1 << 14:
        return struct.pack(">H", 0x8000 | v)
    if v < 1 << 21:
        return struct.pack(">I", 0xC00000 | v)[1:]
    if v < 1 << 28:
        return struct.pack(">I", 0xE0000000 | v)
    return bytes([0xF0 | v >> 28, v >> 20 & 0xFF, v >> 12 & 0xFF, v >> 4 & 0xFF, v & 0x0F])


def read_itf8(data: bytes, at: int) -> tuple[int, int]:
    """(signed value, next place)."""
    b = data[at]
    if b < 0x80:
        v, n = b, 1
    elif b < 0xC0:
        v, n = (b & 0x3F) << 8 | data[at + 1], 2
    elif b < 0xE0:
        v, n = (b & 0x1F) << 16 | int.from_bytes(data[at + 1 : at + 3], "big"), 3
    elif b < 0xF0:
        v, n = (b & 0x0F) << 24 | int.from_bytes(data[at + 1 : at + 4], "big"), 4
    else:
        v, n = (b & 0x0F) << 28 | int.from_bytes(data[at + 1 : at + 4], "big") << 4 | data[at + 4] & 0x0F, 5
    return (v - (1 << 32) if v >= 1 << 31 else v), at + n
