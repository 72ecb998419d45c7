"""rANS with 4 or 32 lanes and 16-bit renormalisation, order 0 and 1, with packing, run lengths and stripes."""

from __future__ import annotations

import struct
from collections import Counter

from .codecs import CodecError, normalised
from .packing import EXTRA, NO_SIZE, ORDER, PACKED, RUNS, STORED, STRIPE, Source, alphabet, pack, read_packing, striped, uint7, unpack, unstriped

LOW = 1 << 15
BITS = 12


def _starts(freq: dict[int, int]) -> dict[int, int]:
    out, at = {}, 0
    for s, f in freq.items():
        out[s], at = at, at + f
    return out


class _Table:
    """Frequencies of one context, raised to a sum of 2^bits."""

    def __init__(self, freq: dict[int, int], bits: int):
        total, shift = sum(freq.values()), 0
        while 0 < total << shift < 1 << bits:
            shift += 1
        self.freq = {s: f << shift for s, f in freq.items() if f}
        self.start = _starts(self.freq)
        self.lookup = b"".join(bytes([s]) * f for s, f in self.freq.items())
        if len(self.lookup) > 1 << bits:
            raise CodecError("frequencies exceed their total")


class _Lanes:
    def __init__(self, s: Source, lanes: int, bits: int):
        self.s, self.bits, self.states = s, bits, [struct.unpack("<I", s.take(4))[0] for _ in range(lanes)]

    def symbols(self, out: bytearray, places, tables: dict[int, _Table] | None, table: _Table | None = None) -> bytes:
        """Fill ``out`` at (lane, place) pairs, each symbol by its lane's last one's table, or all by one."""
        s, states, bits = self.s, self.states, self.bits
        mask, data, at, context = (1 << bits) - 1, s.data, s.at, [0] * len(states)
        for lane, i in places:
            if tables is not None:
                table = tables.get(context[lane])
                if table is None:
                    raise CodecError("no such context")
            x = states[lane]
            low = x & mask
            lookup = table.lookup
            if low >= len(lookup):
                raise CodecError("no symbol for a state")
            context[lane] = out[i] = symbol = lookup[low]
            x = table.freq[symbol] * (x >> bits) + low - table.start[symbol]
            if x < LOW:
                if at + 2 > len(data):
                    raise CodecError("data end early")
                x = x << 16 | data[at] | data[at + 1] << 8
                at += 2
            states[lane] = x
        s.at = at
        return bytes(out)


def _decode0(s: Source, size: int, lanes: int) -> bytes:
    if not size:
        return b""
    table = _Table({x: s.uint7() for x in s.alphabet()}, BITS)
    return _Lanes(s, lanes, BITS).symbols(bytearray(size), ((i % lanes, i) for i in range(size)), None, table)


def _decode1(s: Source, size: int, lanes: int) -> bytes:
    first = s.byte()
    bits = first >> 4
    if first & 1:
        raw, packed = s.uint7(), s.uint7()
        tables = _read_tables(Source(_decode0(Source(s.take(packed)), raw, 4)), bits)
    else:
        tables = _read_tables(s, bits)
    states, part = _Lanes(s, lanes, bits), size // lanes
    places = [(j, i + j * part) for i in range(part) for j in range(lanes)] + [(lanes - 1, i) for i in range(part * lanes, size)]
    return states.symbols(bytearray(size), places, tables)


def _read_tables(s: Source, bits: int) -> dict[int, _Table]:
    symbols, out = s.alphabet(), {}
    for context in symbols:
        freq, zeros = {}, 0
        for x in symbols:
            if zeros:
                zeros -= 1
                continue
            f = s.uint7()
            if f:
                freq[x] = f
            else:
                zeros = s.byte()
        out[context] = _Table(freq, bits)
    return out


def decode(data: bytes, size: int | None = None) -> bytes:
    """What a stream holds; its size is told where the stream doesn't say it."""
    s = Source(data)
    flags = s.byte()
    if not flags & NO_SIZE:
        size = s.uint7()
    if size is None:
        raise CodecError("a stream of unknown size")
    lanes = 32 if flags & EXTRA else 4
    if flags & STRIPE:
        return unstriped(s, size, decode)
    whole, symbols, runs = size, b"", None
    if flags & PACKED:
        symbols, size = read_packing(s)
    unpacked = size
    if flags & RUNS:
        meta, size = s.uint7(), s.uint7()
        body = Source(s.take(meta >> 1) if meta & 1 else _decode0(Source(s.take(s.uint7())), meta >> 1, lanes))
        repeated = {body.byte() for _ in range(body.byte() or 256)}
        runs = repeated, body
    out = s.take(size) if flags & STORED else _decode1(s, size, lanes) if flags & ORDER else _decode0(s, size, lanes)
    if runs:
        long = bytearray()
        for x in out:
            long += bytes([x]) * (1 + (runs[1].uint7() if x in runs[0] else 0))
        out = bytes(long)
        if len(out) != unpacked:
            raise CodecError("runs of another size")
    return unpack(out, symbols, whole) if flags & PACKED else out


class _Writer:
    def __init__(self, lanes: int, bits: int):
        self.states, self.bits, self.words = [LOW] * lanes, bits, []

    def puts(self, steps: list[tuple[int, tuple[int, int]]]) -> None:
        """(lane, (frequency, start)) of symbols, from the last one to be decoded on."""
        states, bits, words = self.states, self.bits, self.words
        full = LOW >> bits << 16
        for lane, (f, start) in steps:
            x = states[lane]
            while x >= full * f:
                words.append(x & 0xFFFF)
                x >>= 16
            states[lane] = (x // f << bits) + x % f + start

    def data(self) -> bytes:
        return struct.pack(f"<{len(self.states)}I", *self.states) + struct.pack(f"<{len(self.words)}H", *reversed(self.words))


def _encode0(data: bytes, lanes: int) -> bytes:
    if not data:
        return b""
    freq = normalised(Counter(data))
    start, w = _starts(freq), _Writer(lanes, BITS)
    told = {x: (f, start[x]) for x, f in freq.items()}
    w.puts([(i % lanes, told[data[i]]) for i in range(len(data) - 1, -1, -1)])
    return alphabet(list(freq)) + b"".join(uint7(f) for f in freq.values()) + w.data()


def _encode1(data: bytes, lanes: int) -> bytes:
    part = len(data) // lanes
    contexts = bytearray(b"\0" + data[:-1])
    for j in range(lanes):
        contexts[j * part] = 0
    pairs: dict[int, Counter] = {}
    for (c, x), n in Counter(zip(contexts, data, strict=True)).items():
        pairs.setdefault(c, Counter())[x] = n
    tables = {c: normalised(n) for c, n in pairs.items()}
    starts = {c: _starts(t) for c, t in tables.items()}
    told = {(c, x): (f, starts[c][x]) for c, t in tables.items() for x, f in t.items()}
    each = list(map(told.__getitem__, zip(contexts, data, strict=True)))
    w = _Writer(lanes, BITS)
    w.puts([(lanes - 1, each[i]) for i in range(len(data) - 1, part * lanes - 1, -1)] + [(j, each[j * part + k]) for k in range(part - 1, -1, -1) for j in range(lanes - 1, -1, -1)])
    symbols = sorted({0, *data})
    body = bytearray(alphabet(symbols))
    for c in symbols:
        k = 0
        while k < len(symbols):
            f = tables.get(c, {}).get(symbols[k], 0)
            body += uint7(f)
            if not f:
                more = 0
                while k + 1 < len(symbols) and more < 255 and not tables.get(c, {}).get(symbols[k + 1], 0):
                    more, k = more + 1, k + 1
                body.append(more)
            k += 1
    packed = _encode0(bytes(body), 4)
    table = bytes([BITS << 4 | 1]) + uint7(len(body)) + uint7(len(packed)) + packed if len(packed) < len(body) else bytes([BITS << 4]) + bytes(body)
    return table + w.data()


def _runs(data: bytes) -> tuple[bytes, bytes]:
    """(run lengths with the symbols that have some, symbols with runs taken out)."""
    gain: Counter = Counter()
    for a, b in zip(data, data[1:], strict=False):
        gain[b] += 1 if a == b else -1
    repeated = {s for s, n in gain.items() if n > 0}
    lengths, out, i = bytearray(), bytearray(), 0
    while i < len(data):
        j = i + 1
        while data[i] in repeated and j < len(data) and data[j] == data[i]:
            j += 1
        out.append(data[i])
        if data[i] in repeated:
            lengths += uint7(j - i - 1)
        i = j
    return bytes([len(repeated) & 0xFF, *sorted(repeated)]) + bytes(lengths), bytes(out)


def encode(data: bytes, flags: int = 0) -> bytes:
    """A stream with the wanted flags, as far as the data allow them."""
    lanes = 32 if flags & EXTRA else 4
    head = b"" if flags & NO_SIZE else uint7(len(data))
    if flags & STRIPE:
        rest = flags & ~(STRIPE | NO_SIZE)
        return bytes([flags & (STRIPE | NO_SIZE | EXTRA)]) + head + striped(data, 4, lambda x: encode(x, rest | NO_SIZE))
    if flags & PACKED:
        packed = pack(data)
        if packed is None:
            flags &= ~PACKED
        else:
            head, data = head + packed[0], packed[1]
    if flags & RUNS:
        meta, literal = _runs(data)
        if meta[0] == 0:  # nothing is repeated
            flags &= ~RUNS
        else:
            squeezed = _encode0(meta, lanes)
            head += uint7(len(meta) << 1) + uint7(len(literal)) + uint7(len(squeezed)) + squeezed if len(squeezed) < len(meta) else uint7(len(meta) << 1 | 1) + uint7(len(literal)) + meta
            data = literal
    if len(data) < lanes:
        flags &= ~ORDER
    if not data:
        flags |= STORED
    body = data if flags & STORED else _encode1(data, lanes) if flags & ORDER else _encode0(data, lanes)
    return bytes([flags]) + head + body
