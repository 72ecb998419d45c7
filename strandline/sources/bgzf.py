"""Blocked gzip: block discovery, checked inflation, framing, and a splittable source of text lines."""

from __future__ import annotations

import json
import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.coords import Region, parse_region
from .files import list_files, open_file

# Fixed values of the format.
MAGIC = b"\x1f\x8b\x08\x04"
HEADER = 18
TRAILER = 8
PAYLOAD = 65280
END_BLOCK = bytes.fromhex("1f8b08040000000000ff0600424302001b0003000000000000000000")
LEVEL = 6


class BgzfError(ValueError):
    """A damaged or cut block."""


@dataclass(frozen=True)
class Span:
    """One block: its place and size in the file, the deflated bytes in it, and what they inflate to."""

    offset: int
    size: int
    start: int
    length: int
    inflated: int
    crc: int


def block_size(data: bytes, at: int) -> int | None:
    """Size of the block at ``at``; None if its header is cut short; an error if it is no block."""
    head = data[at : at + 12]
    if head[:4] != MAGIC[: len(head)]:
        raise BgzfError(f"no block at {at}")
    if len(head) < 12:
        return None
    extra = struct.unpack_from("<H", head, 10)[0]
    fields = data[at + 12 : at + 12 + extra]
    if len(fields) < extra:
        return None
    k = 0
    while k + 4 <= extra:
        tag, n = fields[k : k + 2], struct.unpack_from("<H", fields, k + 2)[0]
        if tag == b"BC" and n == 2:
            size = struct.unpack_from("<H", fields, k + 4)[0] + 1
            if size < 12 + extra + TRAILER:
                raise BgzfError(f"block size too small at {at}")
            return size
        k += 4 + n
    raise BgzfError(f"no block size at {at}")


def discover(data: bytes, base: int = 0) -> tuple[list[Span], int]:
    """(whole blocks in ``data``, bytes that they take). A block cut by the end is where to go on."""
    spans, at = [], 0
    while at < len(data):
        size = block_size(data, at)
        if size is None or at + size > len(data):
            break
        start = 12 + struct.unpack_from("<H", data, at + 10)[0]
        crc, inflated = struct.unpack_from("<II", data, at + size - TRAILER)
        spans.append(Span(base + at, size, start, size - start - TRAILER, inflated, crc))
        at += size
    return spans, at


def inflate(block: bytes, span: Span) -> bytes:
    """A block's contents; its length and checksum must agree."""
    try:
        out = zlib.decompress(block[span.start : span.start + span.length], -15)
    except zlib.error as e:
        raise BgzfError(f"block at {span.offset}: {e}") from e
    if len(out) != span.inflated:
        raise BgzfError(f"block at {span.offset}: {len(out)} bytes, not {span.inflated}")
    if zlib.crc32(out) != span.crc:
        raise BgzfError(f"block at {span.offset}: checksum")
    return out


def framing(payload: int, deflated: int) -> str:
    """How a block is framed: 'empty', 'deflated', or 'stored' where deflating doesn't pay."""
    if not payload:
        return "empty"
    return "deflated" if deflated < payload + 5 else "stored"


def framed_size(length: int) -> int:
    return HEADER + length + TRAILER


def frame(payload: bytes, level: int = LEVEL) -> bytes:
    """One block of at most ``PAYLOAD`` bytes."""
    if len(payload) > PAYLOAD:
        raise BgzfError("payload too large for a block")
    packer = zlib.compressobj(level, zlib.DEFLATED, -15)
    body = packer.compress(payload) + packer.flush()
    if framing(len(payload), len(body)) == "stored":
        body = b"\x01" + struct.pack("<HH", len(payload), len(payload) ^ 0xFFFF) + payload
    head = MAGIC + struct.pack("<IBBHBBHH", 0, 0, 0xFF, 6, 66, 67, 2, framed_size(len(body)) - 1)
    return head + body + struct.pack("<II", zlib.crc32(payload), len(payload))


def compress(data: bytes, level: int = LEVEL, end: bool = True) -> bytes:
    out = [frame(data[k : k + PAYLOAD], level) for k in range(0, len(data), PAYLOAD)]
    return b"".join(out) + (END_BLOCK if end else b"")


def has_end(data: bytes) -> bool:
    return data.endswith(END_BLOCK)


#: Bytes of a file that isn't blocked that stand for a block.
RAW_BLOCK = 1 << 15


def is_raw(file) -> bool:
    """Whether a file holds its contents as they are, not in blocks."""
    return file.size() > 0 and file.read_at(min(2, file.size()), 0) != MAGIC[:2]


class BlockReader:
    """Blocks of a file from an offset on, read in pieces; a file that isn't blocked is read as if it were, block by block of ``RAW_BLOCK`` bytes."""

    PIECE = 1 << 20

    def __init__(self, file, offset: int = 0):
        self.file, self.offset = file, offset
        self.size = file.size()

    def __iter__(self) -> Iterator[tuple[int, int, bytes]]:
        """(offset of the block, offset of the next one, contents); an error if the file ends within a block."""
        if is_raw(self.file):
            for at in range(self.offset, self.size, RAW_BLOCK):
                data = self.file.read_at(min(RAW_BLOCK, self.size - at), at)
                yield at, at + len(data), data
            return
        base, held = self.offset, b""
        while True:
            piece = self.file.read_at(min(self.PIECE, self.size - base - len(held)), base + len(held)) if base + len(held) < self.size else b""
            held += piece
            spans, used = discover(held, base)
            for s in spans:
                at = s.offset - base
                yield s.offset, s.offset + s.size, inflate(held[at : at + s.size], s)
            if not piece:
                if used < len(held):
                    raise BgzfError(f"file ends within the block at {base + used}")
                return
            base, held = base + used, held[used:]


class Contents:
    """What blocks hold from an offset on, as far as it was asked for, with the virtual offset of every place."""

    def __init__(self, file, offset: int = 0):
        self.blocks, self.data, self.after = iter(BlockReader(file, offset)), bytearray(), offset
        self._places, self._offsets = [], []  # where in ``data`` each block begins, and its offset

    def more(self) -> bool:
        """Append a block; false at the file's end."""
        block = next(self.blocks, None)
        if block is None:
            return False
        offset, self.after, data = block
        if self._places and self._places[-1] == len(self.data):  # an empty block before it holds no place
            self._offsets[-1] = offset
        else:
            self._places.append(len(self.data))
            self._offsets.append(offset)
        self.data += data
        return True

    def drop(self, n: int) -> None:
        """Forget the first ``n`` bytes."""
        keep = max(0, bisect_right(self._places, n) - 1)
        self._places = [p - n for p in self._places[keep:]]
        self._offsets = self._offsets[keep:]
        del self.data[:n]

    def virtual(self, at: int) -> int:
        """The virtual offset of a place; of the end of what is held: the next block's."""
        if at >= len(self.data):
            return self.after << 16
        k = bisect_right(self._places, at) - 1
        return self._offsets[k] << 16 | at - self._places[k]

    def virtuals(self, at: np.ndarray) -> np.ndarray:
        """:meth:`virtual` of many places."""
        if not self._places:
            return np.full(len(at), self.after << 16)
        places, starts = np.array(self._places), np.array(self._offsets)
        k = np.searchsorted(places, at, "right") - 1
        return np.where(at >= len(self.data), self.after << 16, starts[k] << 16 | at - places[k])

    def held_before(self, offset: int) -> int:
        """How much of what is held lies in blocks that begin before a file offset."""
        k = bisect_left(self._offsets, offset)
        return self._places[k] if k < len(self._places) else len(self.data)


def find_block(file, offset: int) -> int | None:
    """The first block at or after ``offset``: one whose successor is a block too, or the end."""
    size = file.size()
    if is_raw(file):
        at = -(-offset // RAW_BLOCK) * RAW_BLOCK
        return at if at < size else None
    data = file.read_at(min(size - offset, 4 << 16), offset)
    at = data.find(MAGIC)
    while at >= 0:
        try:
            n = block_size(data, at)
            after = None if n is None else offset + at + n
            if after == size or (after is not None and after < size and file.read_at(4, after) == MAGIC):
                return offset + at
        except BgzfError:
            pass
        at = data.find(MAGIC, at + 1)
    return None


def read_from(file, offset: int, n: int, index: Sequence[tuple[int, int]] = ((0, 0),)) -> bytes:
    """``n`` bytes of the contents from an uncompressed offset on, less at the end.

    ``index`` has (compressed, uncompressed) offsets of blocks in order; what
    lies before the last one that isn't beyond the offset isn't read.
    """
    k = bisect_right([u for _, u in index], offset) - 1
    start, base = index[k]
    out = bytearray()
    for _, _, data in BlockReader(file, start):
        if len(out) >= n:
            break
        out += data[max(0, offset - base) :][: n - len(out)]
        base += len(data)
    return bytes(out)


class Reads:
    """Many reads of a file's contents by the index of all its blocks; the block that was read last is kept inflated."""

    def __init__(self, file, index: Sequence[tuple[int, int]]):
        self.file, self.starts, self.places = file, [c for c, _ in index], [u for _, u in index]
        self.held, self.data = -1, b""

    def _block(self, k: int) -> bytes:
        if k != self.held:
            end = self.starts[k + 1] if k + 1 < len(self.starts) else self.file.size()
            raw = self.file.read_at(end - self.starts[k], self.starts[k])
            spans, used = discover(raw)
            if used != len(raw):
                raise BgzfError(f"file ends within the block at {self.starts[k] + used}")
            self.held, self.data = k, b"".join(inflate(raw[s.offset : s.offset + s.size], s) for s in spans)
        return self.data

    def read(self, offset: int, n: int) -> bytes:
        """``n`` bytes from an uncompressed offset on, less at the end."""
        k, out = bisect_right(self.places, offset) - 1, b""
        while len(out) < n and k < len(self.starts):
            at = offset + len(out) - self.places[k]
            out += self._block(k)[at : at + n - len(out)]
            k += 1
        return out


def read_last(file, n: int, index: Sequence[tuple[int, int]]) -> bytes:
    """The last ``n`` bytes of the contents, by the blocks' offsets."""
    start, size = index[-1]
    size += sum(len(data) for _, _, data in BlockReader(file, start))
    return read_from(file, max(0, size - n), n, index)


def with_head(file, head: bytes, begin: int, within: int) -> Iterator[bytes]:
    """A file's blocks with other contents before a place (a block's offset and a place in it); blocks behind it are copied as they are."""
    after, rest = begin, b""
    for _, after, data in BlockReader(file, begin):
        rest = data[within:]
        break
    for k in range(0, len(head), PAYLOAD):
        yield frame(head[k : k + PAYLOAD])
    for k in range(0, len(rest), PAYLOAD):
        yield frame(rest[k : k + PAYLOAD])
    for at in range(after, file.size(), 1 << 20):
        yield file.read_at(min(1 << 20, file.size() - at), at)


@dataclass
class FileRange(InputPartition):
    """Blocks that begin in a range of a file; with ``chunks``, ranges of virtual offsets instead."""

    path: str
    begin: int
    end: int
    chunks: list[tuple[int, int]] | None = None


#: Splits that small ``split_bytes`` make at most, about, and the size up to which they are enlarged for that.
SPLITS, ENLARGED_BYTES = 1000, 64 << 20


def split_size(wanted: int, total: int) -> int:
    """Compressed bytes of a split: as wanted, but larger where files are so large that tasks would be too many to start."""
    return max(wanted, min(-(-total // SPLITS), ENLARGED_BYTES))


def by_size(chunks: list[tuple[int, int]], size: int) -> list[list[tuple[int, int]]]:
    """Chunks in groups of some ``size`` compressed bytes."""
    out: list[list[tuple[int, int]]] = []
    held = size
    for begin, end in chunks:
        if held >= size:
            out.append([])
            held = 0
        out[-1].append((begin, end))
        held += (end >> 16) - (begin >> 16) + 1
    return out


def regions_of(options) -> list[Region]:
    """The option ``regions``: a JSON list of region texts, or one region."""
    given = options.get("regions")
    if not given:
        return []
    return [parse_region(r) for r in (json.loads(given) if given.startswith("[") else [given])]


class BgzfLines(DataSource):
    """``format("bgzf_lines")``: (path, value) lines of blocked-gzip files, split at blocks.

    A task owns the lines that begin after a line break in its blocks (the
    first task the first line too) and reads on to finish its last one.
    Options: ``split_bytes`` (default 16 MiB of compressed bytes; enlarged where
    that would make more than some thousand tasks); ``offsets``
    (true: also ``voffset`` and ``vend``, the virtual offsets where a line
    begins and where the next one does); ``regions``, for files with a tabix or
    CSI index beside them, whose blocks alone are read. Lines that share a
    block or a bin with a region come too; a filter decides.
    """

    @classmethod
    def name(cls) -> str:
        return "bgzf_lines"

    def schema(self) -> str:
        return "path string, value string" + (", voffset bigint, vend bigint" if self.options.get("offsets") == "true" else "")

    def reader(self, schema):
        return _LineReader(self.options["path"], int(self.options.get("split_bytes", 16 << 20)), self.options.get("offsets") == "true", regions_of(self.options))


class _LineReader(DataSourceReader):
    def __init__(self, path: str, split: int, offsets: bool = False, regions: list[Region] | None = None):
        self.path, self.split, self.offsets, self.regions = path, split, offsets, regions or []

    def partitions(self):
        from . import indexes

        listed = [(p, n) for p, n in list_files(self.path) if not p.endswith(indexes.SUFFIXES)]
        if not self.regions:
            split = split_size(self.split, sum(n for _, n in listed))
            return [FileRange(p, at, min(at + split, n)) for p, n in listed for at in range(0, max(n, 1), split)]
        out = []
        for p, n in listed:
            index = indexes.beside(p)
            out += [FileRange(p, 0, n, c) for c in by_size(index.chunks_of(self.regions, index.names), self.split)]
        return out or [FileRange(self.path, 0, 0, [])]

    def read(self, part: FileRange):
        import pyarrow as pa

        rows = self._chunks(part) if part.chunks is not None else self._lines(part)
        held: list[tuple[bytes, int, int]] = []
        for row in rows:
            held.append(row)
            if len(held) == 8192:
                yield self._batch(pa, part.path, held)
                held = []
        if held:
            yield self._batch(pa, part.path, held)

    def _batch(self, pa, path: str, rows: list[tuple[bytes, int, int]]):
        columns = [pa.array([path] * len(rows)), pa.array([v.removesuffix(b"\r").decode() for v, _, _ in rows])]
        names = ["path", "value"]
        if self.offsets:
            columns += [pa.array([b for _, b, _ in rows], pa.int64()), pa.array([e for _, _, e in rows], pa.int64())]
            names += ["voffset", "vend"]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def _walk(self, c: Contents, at: int, broke: int, ends) -> Iterator[tuple[bytes, int, int]]:
        """Lines from a place on, until ``ends`` of a line's virtual offset and of the block with the line break before it."""
        scan = at
        while True:
            cut = c.data.find(b"\n", scan)
            if cut < 0:
                if ends(c.virtual(at), broke):
                    return
                c.drop(at)
                at, scan = 0, len(c.data)
                if c.more():
                    continue
                if c.data:
                    yield bytes(c.data), c.virtual(0), c.after << 16
                return
            begin = c.virtual(at)
            if ends(begin, broke):
                return
            broke = c.virtual(cut) >> 16
            yield bytes(c.data[at:cut]), begin, c.virtual(cut + 1)
            at = scan = cut + 1

    def _lines(self, part: FileRange) -> Iterator[tuple[bytes, int, int]]:
        file = open_file(part.path)
        if not file.size():
            return
        first = 0 if part.begin == 0 else find_block(file, part.begin)
        if first is None or first >= part.end:
            return
        c, at = Contents(file, first), 0
        while part.begin:
            # the line that is open here is an earlier task's
            if not c.more():
                return
            at = c.data.find(b"\n") + 1
            if at:
                break
            if c.after >= part.end:
                return
            c.drop(len(c.data))
        yield from self._walk(c, at, c.virtual(at - 1) >> 16 if at else 0, lambda _, broke: broke >= part.end)

    def _chunks(self, part: FileRange) -> Iterator[tuple[bytes, int, int]]:
        file = open_file(part.path)
        for begin, end in part.chunks or []:
            c = Contents(file, begin >> 16)
            if c.more():
                yield from self._walk(c, begin & 0xFFFF, 0, lambda v, _, end=end: v >= end)
