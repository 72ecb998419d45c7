"""Value encodings of reference-compressed containers: bit codes, external streams, byte arrays."""

from __future__ import annotations

from collections.abc import Sequence

from .codecs import CodecError, itf8, read_itf8

# Encoding ids.
NULL, EXTERNAL, GOLOMB, HUFFMAN, ARRAY_LEN, ARRAY_STOP, BETA, SUBEXP, GOLOMB_RICE, GAMMA = range(10)


class Cursor:
    """Bytes that are read from the front."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, n: int) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise CodecError("data end early")
        self.at += n
        return self.data[self.at - n : self.at]

    def byte(self) -> int:
        return self.take(1)[0]

    def itf8(self) -> int:
        try:
            v, self.at = read_itf8(self.data, self.at)
        except IndexError as e:
            raise CodecError("data end early") from e
        return v

    def ltf8(self) -> int:
        first = self.byte()
        more = 8 - (~first & 0xFF).bit_length() if first != 0xFF else 8
        v = first & (0xFF >> (more + 1)) if more < 8 else 0
        for b in self.take(more):
            v = v << 8 | b
        return v - (1 << 64) if v >= 1 << 63 else v

    def ints(self) -> list[int]:
        return [self.itf8() for _ in range(self.itf8())]

    def until(self, stop: int) -> bytes:
        end = self.data.find(bytes([stop]), self.at)
        if end < 0:
            raise CodecError("data end early")
        found, self.at = self.data[self.at : end], end + 1
        return found


def ltf8(value: int) -> bytes:
    """A 64-bit integer in one to nine bytes: leading ones tell how many follow."""
    v = value & 0xFFFFFFFFFFFFFFFF
    for more in range(8):
        if v < 1 << 7 * (more + 1):
            first = (0xFF00 >> more) & 0xFF
            return ((first << 8 * more) | v).to_bytes(more + 1, "big")
    return b"\xff" + v.to_bytes(8, "big")


def int_array(values: Sequence[int]) -> bytes:
    return itf8(len(values)) + b"".join(map(itf8, values))


class BitReader:
    """Bits from the most significant one on, as a text of zeros and ones: runs are found and numbers read without a step for each bit."""

    def __init__(self, data: bytes):
        self.data, self.at = data, 0
        self.text = bin(int.from_bytes(b"\x01" + data, "big"))[3:] if data else ""

    def bit(self) -> int:
        if self.at >= len(self.text):
            raise CodecError("bits end early")
        self.at += 1
        return self.text[self.at - 1] == "1"

    def bits(self, n: int) -> int:
        end = self.at + n
        if end > len(self.text):
            raise CodecError("bits end early")
        v = int(self.text[self.at : end], 2) if n else 0
        self.at = end
        return v

    def _run(self, end: str) -> int:
        found = self.text.find(end, self.at)
        if found < 0:
            raise CodecError("bits end early")
        n, self.at = found - self.at, found + 1
        return n

    def ones(self) -> int:
        return self._run("0")

    def zeros(self) -> int:
        return self._run("1")


class BitWriter:
    def __init__(self):
        self.out: list[str] = []

    def bits(self, v: int, n: int) -> None:
        if n:
            self.out.append(f"{v & (1 << n) - 1:0{n}b}")

    def ones(self, n: int) -> None:
        self.out.append("1" * n + "0")

    def data(self) -> bytes:
        text = "".join(self.out)
        size = -(-len(text) // 8)
        return int(text.ljust(8 * size, "0"), 2).to_bytes(size, "big") if text else b""


class Streams:
    """What a slice's values are read from: the core bits and the external blocks, which are unpacked when first asked for."""

    def __init__(self, core: bytes, blocks: dict):
        self.core, self._blocks, self._open = BitReader(core), blocks, {}

    def external(self, number: int) -> Cursor:
        if number not in self._open:
            if number not in self._blocks:
                raise CodecError(f"no external block {number}")
            self._open[number] = Cursor(self._blocks[number]())
        return self._open[number]


class External:
    def __init__(self, number: int):
        self.number = number

    def int(self, s: Streams) -> int:
        return s.external(self.number).itf8()

    def byte(self, s: Streams) -> int:
        return s.external(self.number).byte()

    def many(self, s: Streams, n: int) -> bytes:
        return s.external(self.number).take(n)

    def write(self) -> bytes:
        return _written(EXTERNAL, itf8(self.number))


class _Coded:
    """An encoding in the core bits."""

    def byte(self, s: Streams) -> int:
        return self.int(s)

    def many(self, s: Streams, n: int) -> bytes:
        return bytes(self.int(s) for _ in range(n))


class Huffman(_Coded):
    """Canonical codes: by length, then by symbol."""

    def __init__(self, symbols: Sequence[int], lengths: Sequence[int]):
        self.symbols, self.lengths, self.codes = list(symbols), list(lengths), {}
        code = before = 0
        for n, s in sorted(zip(lengths, symbols, strict=True)):
            code <<= n - before
            self.codes[n, code] = s
            code, before = code + 1, n
        self.of = {s: key for key, s in reversed(self.codes.items())}
        self.texts = {f"{code:0{n}b}": s for (n, code), s in self.codes.items() if n}
        self.sizes = sorted({n for n, _ in self.codes if 0 < n < 32})

    def int(self, s: Streams) -> int:
        if (0, 0) in self.codes:
            return self.codes[0, 0]
        core = s.core
        for n in self.sizes:
            found = self.texts.get(core.text[core.at : core.at + n])
            if found is not None and core.at + n <= len(core.text):
                core.at += n
                return found
        raise CodecError("no such code" if core.at < len(core.text) else "bits end early")

    def put(self, w: BitWriter, v: int) -> None:
        n, code = self.of[v]
        w.bits(code, n)

    def write(self) -> bytes:
        return _written(HUFFMAN, int_array(self.symbols) + int_array(self.lengths))


class Beta(_Coded):
    def __init__(self, offset: int, n: int):
        self.offset, self.n = offset, n

    def int(self, s: Streams) -> int:
        return s.core.bits(self.n) - self.offset

    def put(self, w: BitWriter, v: int) -> None:
        w.bits(v + self.offset, self.n)

    def write(self) -> bytes:
        return _written(BETA, itf8(self.offset) + itf8(self.n))


class Gamma(_Coded):
    def __init__(self, offset: int):
        self.offset = offset

    def int(self, s: Streams) -> int:
        n = s.core.zeros()
        return (1 << n | s.core.bits(n)) - self.offset

    def put(self, w: BitWriter, v: int) -> None:
        x = v + self.offset
        w.bits(x, 2 * x.bit_length() - 1)

    def write(self) -> bytes:
        return _written(GAMMA, itf8(self.offset))


class Subexponential(_Coded):
    def __init__(self, offset: int, k: int):
        self.offset, self.k = offset, k

    def int(self, s: Streams) -> int:
        u = s.core.ones()
        n = self.k if u == 0 else u + self.k - 1
        return s.core.bits(n) + (1 << n if u else 0) - self.offset

    def put(self, w: BitWriter, v: int) -> None:
        x = v + self.offset
        if x < 1 << self.k:
            w.ones(0)
            w.bits(x, self.k)
        else:
            n = x.bit_length() - 1
            w.ones(n - self.k + 1)
            w.bits(x, n)

    def write(self) -> bytes:
        return _written(SUBEXP, itf8(self.offset) + itf8(self.k))


class Golomb(_Coded):
    """Quotient in ones, remainder in truncated binary."""

    def __init__(self, offset: int, m: int):
        self.offset, self.m = offset, m
        self.width = (m - 1).bit_length()
        self.short = (1 << self.width) - m

    def int(self, s: Streams) -> int:
        q = s.core.ones()
        r = s.core.bits(self.width - 1) if self.width else 0
        if self.width and r >= self.short:
            r = (r << 1 | s.core.bit()) - self.short
        return q * self.m + r - self.offset

    def put(self, w: BitWriter, v: int) -> None:
        q, r = divmod(v + self.offset, self.m)
        w.ones(q)
        if not self.width:
            return
        if r < self.short:
            w.bits(r, self.width - 1)
        else:
            w.bits(r + self.short, self.width)

    def write(self) -> bytes:
        return _written(GOLOMB, itf8(self.offset) + itf8(self.m))


class GolombRice(_Coded):
    def __init__(self, offset: int, n: int):
        self.offset, self.n = offset, n

    def int(self, s: Streams) -> int:
        return (s.core.ones() << self.n | s.core.bits(self.n)) - self.offset

    def put(self, w: BitWriter, v: int) -> None:
        x = v + self.offset
        w.ones(x >> self.n)
        w.bits(x, self.n)

    def write(self) -> bytes:
        return _written(GOLOMB_RICE, itf8(self.offset) + itf8(self.n))


class ArrayLen:
    """Byte arrays as a length and so many bytes."""

    def __init__(self, length, values):
        self.length, self.values = length, values

    def bytes(self, s: Streams) -> bytes:
        return self.values.many(s, self.length.int(s))

    def write(self) -> bytes:
        return _written(ARRAY_LEN, self.length.write() + self.values.write())


class ArrayStop:
    """Byte arrays up to a stop byte."""

    def __init__(self, stop: int, number: int):
        self.stop, self.number = stop, number

    def bytes(self, s: Streams) -> bytes:
        return s.external(self.number).until(self.stop)

    def write(self) -> bytes:
        return _written(ARRAY_STOP, bytes([self.stop]) + itf8(self.number))


def _written(kind: int, parameters: bytes) -> bytes:
    return itf8(kind) + itf8(len(parameters)) + parameters


def read_encoding(c: Cursor):
    """The encoding that stands next; None for the null encoding."""
    kind = c.itf8()
    p = Cursor(c.take(c.itf8()))
    if kind == NULL:
        return None
    if kind == EXTERNAL:
        return External(p.itf8())
    if kind == HUFFMAN:
        return Huffman(p.ints(), p.ints())
    if kind == ARRAY_LEN:
        return ArrayLen(read_encoding(p), read_encoding(p))
    if kind == ARRAY_STOP:
        return ArrayStop(p.byte(), p.itf8())
    if kind == GAMMA:
        return Gamma(p.itf8())
    two = {GOLOMB: Golomb, BETA: Beta, SUBEXP: Subexponential, GOLOMB_RICE: GolombRice}
    if kind not in two:
        raise CodecError(f"unknown encoding {kind}")
    return two[kind](p.itf8(), p.itf8())


def coded(encoding, values: Sequence[int]) -> bytes:
    """Values in an encoding's bits."""
    w = BitWriter()
    for v in values:
        encoding.put(w, v)
    return w.data()


def decoded(encoding, data: bytes, n: int) -> list[int]:
    s = Streams(data, {})
    return [encoding.int(s) for _ in range(n)]
