"""Adaptive arithmetic coding: a range coder with frequency models, order 0 and 1, runs; and quality scores by it."""

from __future__ import annotations

import bz2
import struct
from collections.abc import Sequence
from dataclasses import dataclass, field

from .codecs import CodecError
from .packing import EXTRA, NO_SIZE, ORDER, PACKED, RUNS, STORED, STRIPE, Source, pack, read_packing, striped, uint7, unpack, unstriped

# Fixed values of the coder.
STEP = 16
MOST = (1 << 16) - 17
_MASK = 0xFFFFFFFF


class Decoder:
    def __init__(self, s: Source):
        self.s, self.range, self.code = s, _MASK, 0
        for _ in range(5):
            self.code = (self.code << 8 | s.byte()) & _MASK

    def frequency(self, total: int) -> int:
        self.range //= total
        return self.code // self.range

    def step(self, low: int, size: int) -> None:
        self.code -= low * self.range
        self.range *= size
        while self.range < 1 << 24:
            self.range = self.range << 8 & _MASK
            self.code = (self.code << 8 | (self.s.byte() if self.s.at < len(self.s.data) else 0)) & _MASK


class Encoder:
    def __init__(self):
        self.low, self.range, self.cache, self.pending, self.out = 0, _MASK, 0, 0, bytearray()

    def step(self, low: int, size: int, total: int) -> None:
        self.range //= total
        self.low += low * self.range
        self.range *= size
        while self.range < 1 << 24:
            self.range = self.range << 8 & _MASK
            self._shift()

    def _shift(self) -> None:
        # a byte is held back until no carry can reach it
        low = self.low
        if low < 0xFF000000 or low > _MASK:
            carry = low >> 32
            self.out.append(self.cache + carry & 0xFF)
            if self.pending:
                self.out += bytes([0xFF + carry & 0xFF]) * self.pending
                self.pending = 0
            self.cache = low >> 24 & 0xFF
        else:
            self.pending += 1
        self.low = low << 8 & _MASK

    def data(self) -> bytes:
        for _ in range(5):
            self._shift()
        return bytes(self.out)


class Model:
    """Frequencies of symbols, which move forward as they grow."""

    __slots__ = ("freq", "symbols", "total")

    def __init__(self, n: int):
        self.freq, self.symbols, self.total = [1] * n, list(range(n)), n

    def _seen(self, i: int) -> None:
        freq = self.freq
        freq[i] += STEP
        self.total += STEP
        if self.total > MOST:
            self.freq = freq = [f - (f >> 1) for f in freq]
            self.total = sum(freq)
        if i and freq[i] > freq[i - 1]:
            freq[i], freq[i - 1] = freq[i - 1], freq[i]
            symbols = self.symbols
            symbols[i], symbols[i - 1] = symbols[i - 1], symbols[i]

    # the coder's steps are written out in these two: they run for every symbol

    def take(self, d: Decoder) -> int:
        part = d.range // self.total
        wanted, after, i, freq = d.code // part, 0, 0, self.freq
        if wanted >= self.total:
            raise CodecError("no symbol for a code")
        if len(freq) > 32:
            while after + (some := sum(freq[i : i + 16])) <= wanted:
                after += some
                i += 16
        for f in freq[i:] if i else freq:
            after += f
            if after > wanted:
                break
            i += 1
        d.code -= (after - f) * part
        d.range = part = part * f
        if part < 1 << 24:
            s = d.s
            data, at, code = s.data, s.at, d.code
            while part < 1 << 24:
                part = part << 8 & _MASK
                if at < len(data):
                    code = (code << 8 | data[at]) & _MASK
                    at += 1
                else:
                    code = code << 8 & _MASK
            s.at, d.code, d.range = at, code, part
        found = self.symbols[i]
        self._seen(i)
        return found

    def put(self, e: Encoder, symbol: int) -> None:
        i, freq = self.symbols.index(symbol), self.freq
        part = e.range // self.total
        if i:
            e.low += (freq[0] if i == 1 else sum(freq[:i])) * part
        part *= freq[i]
        while part < 1 << 24:
            part = part << 8 & _MASK
            e._shift()
        e.range = part
        self._seen(i)


class _Models(dict):
    def __init__(self, n: int):
        super().__init__()
        self.n = n

    def __missing__(self, key):
        self[key] = m = Model(self.n)
        return m


def _plain(coder, n: int, order: int, size: int, data: bytes | None) -> bytes:
    """Decode ``size`` symbols, or encode ``data``; each in the context of the last one, or of none."""
    models, out, last = _Models(n), bytearray(), 0
    for i in range(size):
        m = models[last if order else 0]
        if data is None:
            out.append(m.take(coder))
            last = out[-1]
        else:
            last = data[i]
            m.put(coder, last)
    return bytes(out)


def _with_runs(coder, n: int, order: int, size: int, data: bytes | None) -> bytes:
    """Symbols with how often each is repeated, in parts of up to 3."""
    literal, runs, out, last, i = _Models(n), _Models(4), bytearray(), 0, 0
    while i < size:
        m = literal[last if order else 0]
        if data is None:
            last = m.take(coder)
            run = part = runs[last].take(coder)
            context = 256
            while part == 3:
                part = runs[context].take(coder)
                run, context = run + part, 257
            out += bytes([last]) * (run + 1)
        else:
            last, run = data[i], 0
            m.put(coder, last)
            while i + run + 1 < size and data[i + run + 1] == last:
                run += 1
            left, context = run, last
            while True:
                part = min(3, left)
                runs[context].put(coder, part)
                left -= part
                context = 256 if context < 256 else 257
                if part < 3:
                    break
        i += run + 1
    if data is None and len(out) != size:
        raise CodecError("runs of another size")
    return bytes(out)


def decode(data: bytes, size: int | None = None) -> bytes:
    s = Source(data)
    flags = s.byte()
    if not flags & NO_SIZE:
        size = s.uint7()
    if size is None:
        raise CodecError("a stream of unknown size")
    if flags & STRIPE:
        return unstriped(s, size, decode)
    whole, symbols = size, b""
    if flags & PACKED:
        symbols, size = read_packing(s)
    if flags & STORED:
        out = s.take(size)
    elif not size:
        out = b""
    elif flags & EXTRA:
        out = bz2.decompress(s.rest())
    else:
        n = s.byte() or 256
        out = (_with_runs if flags & RUNS else _plain)(Decoder(s), n, flags & ORDER, size, None)
    return unpack(out, symbols, whole) if flags & PACKED else out


def encode(data: bytes, flags: int = 0) -> bytes:
    head = b"" if flags & NO_SIZE else uint7(len(data))
    if flags & STRIPE:
        rest = flags & ~(STRIPE | NO_SIZE)
        return bytes([flags & (STRIPE | NO_SIZE)]) + head + striped(data, 4, lambda x: encode(x, rest | NO_SIZE))
    if flags & PACKED:
        packed = pack(data)
        if packed is None:
            flags &= ~PACKED
        else:
            head, data = head + packed[0], packed[1]
    if flags & STORED or not data:
        return bytes([flags | STORED]) + head + data
    if flags & EXTRA:
        return bytes([flags]) + head + bz2.compress(data)
    n = max(data) + 1
    e = Encoder()
    (_with_runs if flags & RUNS else _plain)(e, n, flags & ORDER, len(data), data)
    return bytes([flags]) + head + bytes([n & 0xFF]) + e.data()


# Quality scores

# Global flags, then flags of a parameter set.
VERSION = 5
MANY_SETS, SELECTORS, REVERSED = 1, 2, 4
DUPLICATES, SAME_LENGTH, SELECTED, MAPPED, BY_PLACE, BY_CHANGES, BY_TABLE = 2, 4, 8, 16, 32, 64, 128


def read_steps(s: Source, n: int) -> list[int]:
    """A rising table: how often each value stands in it, with repeated counts counted."""
    runs, held, last = [], 0, -1
    while held < n:
        run = s.byte()
        runs.append(run)
        held += run
        if run == last:
            more = s.byte()
            runs += [run] * more
            held += run * more
        last = run
    out, value, at = [], 0, 0
    while len(out) < n:
        length = 0
        while True:
            if at >= len(runs):
                raise CodecError("a table that ends early")
            part = runs[at]
            at += 1
            length += part
            if part != 255:
                break
        out += [value] * length
        value += 1
    return out[:n]


def write_steps(table: Sequence[int]) -> bytes:
    runs = []
    for value in range(max(table) + 1):
        n = sum(x == value for x in table)
        while n >= 255:
            runs.append(255)
            n -= 255
        runs.append(n)
    out, i = bytearray(), 0
    while i < len(runs):
        out.append(runs[i])
        if i and runs[i] == runs[i - 1]:
            more = 0
            while i + 1 < len(runs) and runs[i + 1] == runs[i] and more < 255:
                more, i = more + 1, i + 1
            out.append(more)
        i += 1
    return bytes(out)


@dataclass
class Parameters:
    """How a quality's context is put together from the ones before it, its place, and how often they changed."""

    context: int = 0
    flags: int = 0
    most: int = 93
    table_bits: int = 9
    table_shift: int = 5
    table_at: int = 7
    selector_at: int = 15
    place_at: int = 0
    changes_at: int = 14
    mapped: list[int] = field(default_factory=list)
    table: list[int] = field(default_factory=lambda: list(range(256)))
    places: list[int] = field(default_factory=lambda: [0] * 1024)
    changes: list[int] = field(default_factory=lambda: [0] * 256)

    @classmethod
    def read(cls, s: Source) -> Parameters:
        p = cls(struct.unpack("<H", s.take(2))[0], s.byte(), s.byte())
        for pair in (("table_bits", "table_shift"), ("table_at", "selector_at"), ("place_at", "changes_at")):
            b = s.byte()
            setattr(p, pair[0], b >> 4)
            setattr(p, pair[1], b & 15)
        p.mapped = list(s.take(p.most)) if p.flags & MAPPED else list(range(256))
        if p.flags & BY_TABLE:
            p.table = read_steps(s, 256)
        if p.flags & BY_PLACE:
            p.places = read_steps(s, 1024)
        if p.flags & BY_CHANGES:
            p.changes = read_steps(s, 256)
        return p

    def write(self) -> bytes:
        out = struct.pack("<HBB", self.context, self.flags, self.most)
        out += bytes([self.table_bits << 4 | self.table_shift, self.table_at << 4 | self.selector_at, self.place_at << 4 | self.changes_at])
        if self.flags & MAPPED:
            out += bytes(self.mapped)
        for flag, table in ((BY_TABLE, self.table), (BY_PLACE, self.places), (BY_CHANGES, self.changes)):
            out += write_steps(table) if self.flags & flag else b""
        return out

    def of(self, before: int, left: int, changes: int, selector: int) -> int:
        at = self.context + ((before & (1 << self.table_bits) - 1) << self.table_at)
        if self.flags & BY_PLACE:
            at += self.places[min(left, 1023)] << self.place_at
        if self.flags & BY_CHANGES:
            at += self.changes[min(changes, 255)] << self.changes_at
        if self.flags & SELECTED:
            at += selector << self.selector_at
        return at & 0xFFFF


def _scores(coder, p: Parameters, models: _Models, length: int, selector: int, codes: Sequence[int] | None) -> list[int]:
    """A record's scores, decoded or (``codes``) encoded."""
    out, before, changes, last, at = [], 0, 0, 0, p.context
    mask, shift, to, table, start = (1 << p.table_bits) - 1, p.table_shift, p.table_at, p.table, p.context + (selector << p.selector_at if p.flags & SELECTED else 0)
    by_place = [x << p.place_at for x in p.places[: min(length, 1023) + 1]] if p.flags & BY_PLACE else None
    by_changes = [x << p.changes_at for x in p.changes] if p.flags & BY_CHANGES else None
    for i in range(length):
        m = models[at]
        if codes is None:
            q = m.take(coder)
        else:
            q = codes[i]
            m.put(coder, q)
        out.append(q)
        before = (before << shift) + table[q] & 0xFFFFFFFF
        # as Parameters.of has it; scores that are left, this one included
        at = start + ((before & mask) << to)
        if by_place:
            at += by_place[min(length - i, 1023)]
        if by_changes:
            at += by_changes[min(changes, 255)]
        at &= 0xFFFF
        if q != last:
            changes += 1
            last = q
    return out


def decode_qualities(data: bytes, size: int | None = None) -> bytes:
    s = Source(data)
    size = s.uint7()
    if s.byte() != VERSION:
        raise CodecError("another version of the quality codec")
    flags = s.byte()
    n = s.byte() if flags & MANY_SETS else 1
    most = n - 1 if n > 1 else 0
    select = list(range(n))
    if flags & SELECTORS:
        most = s.byte()
        select = read_steps(s, 256)
    sets = [Parameters.read(s) for _ in range(n)]
    d = Decoder(s)
    quality, lengths = _Models(max(p.most for p in sets) + 1), [Model(256) for _ in range(4)]
    turn, duplicate, chosen = Model(2), Model(2), Model(most + 1)
    out, turned, length, first = bytearray(), [], 0, True
    while len(out) < size:
        x = chosen.take(d) if most else 0
        p = sets[select[x]]
        if first or not p.flags & SAME_LENGTH:
            length = sum(m.take(d) << 8 * k for k, m in enumerate(lengths))
        first = False
        if flags & REVERSED:
            turned.append((len(out), length, turn.take(d)))
        if p.flags & DUPLICATES and duplicate.take(d):
            out += out[-length:]
            continue
        out += bytes(p.mapped[q] for q in _scores(d, p, quality, length, x, None))
    for at, k, back in turned:
        if back:
            out[at : at + k] = out[at : at + k][::-1]
    if len(out) != size:
        raise CodecError("qualities of another size")
    return bytes(out)


def encode_qualities(data: bytes, lengths: Sequence[int] | None = None) -> bytes:
    """Scores of records of the given lengths (one record, without), with one set of parameters."""
    lengths = [n for n in (lengths if lengths is not None else [len(data)]) if n]
    if sum(lengths) != len(data):
        raise CodecError("lengths that don't make up the scores")
    symbols = sorted(set(data)) or [0]
    same, records, at = len(set(lengths)) <= 1, [], 0
    for n in lengths:
        records.append(data[at : at + n])
        at += n
    repeats = sum(a == b for a, b in zip(records, records[1:], strict=False))
    mapped = len(symbols) < 256  # a map can't hold every byte
    symbols = symbols if mapped else list(range(256))
    flags = (MAPPED if mapped else 0) | BY_PLACE | BY_CHANGES | (SAME_LENGTH if same else 0) | (DUPLICATES if repeats else 0)
    p = Parameters(
        flags=flags, most=min(255, len(symbols)), table_bits=9 if len(symbols) > 8 else 6, table_shift=5 if len(symbols) > 8 else 3, table_at=0, place_at=9, changes_at=12,
        mapped=symbols, places=[min(7, i >> 4) for i in range(1024)], changes=[min(7, i >> 2) for i in range(256)],
    )
    e, quality, sizes, duplicate = Encoder(), _Models(p.most + 1), [Model(256) for _ in range(4)], Model(2)
    code = {s: i for i, s in enumerate(symbols)}
    for i, r in enumerate(records):
        if i == 0 or not same:
            for k, m in enumerate(sizes):
                m.put(e, len(r) >> 8 * k & 0xFF)
        if repeats:
            again = bool(i) and r == records[i - 1]
            duplicate.put(e, int(again))
            if again:
                continue
        _scores(e, p, quality, len(r), 0, [code[x] for x in r])
    return uint7(len(data)) + bytes([VERSION, 0]) + p.write() + e.data()
