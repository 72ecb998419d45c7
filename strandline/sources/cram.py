"""Reference-compressed alignment files: containers, slices, records, and a data source.

A slice keeps each data series of its records in a stream of its own. Streams
that no wanted column needs aren't unpacked. Bases are kept as differences from
a reference, which comes from the file itself or from FASTA files.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import coords
from ..functions.coords import Region
from . import bam, bgzf, bits, codecs, files, sinks
from .bits import Cursor
from .columns import binaries, cigar_ops, flat, gathered, itf8_bytes, itf8s, mapped, offsets, read_itf8s, side_by_side, strings, summed

MAGIC = b"CRAM"
# Block methods and contents.
METHODS = {0: "raw", 1: "gzip", 2: "bzip2", 3: "lzma", 4: "rans0", 5: "nx16", 6: "arith", 7: "fqzcomp", 8: "names"}
FILE_HEADER, COMPRESSION_HEADER, SLICE_HEADER, _, EXTERNAL, CORE = range(6)
#: The 28 data series.
SERIES = "BF CF RI RL AP RG RN MF NS NP TS NF TL FN FC FP DL BB QQ BS IN RS PD HC SC MQ BA QS".split()
_ARRAYS = {"RN", "BB", "QQ", "IN", "SC"}
_BYTES = {"FC", "BA", "QS", "BS"}
_MULTIPLE, _UNPLACED = -2, -1
# Bits of a record's own flags.
HAS_QUALITIES, DETACHED, MATE_DOWNSTREAM, NO_BASES = 1, 2, 4, 8
_BASES = "ACGTN"
#: What a substitution's code stands for when no counts decide: the other bases in order.
PLAIN_SUBSTITUTIONS = bytes([0b00011011] * 5)
RECORDS = 10_000
_SECONDARY, _PAIRED, _UNMAPPED, _MATE_UNMAPPED, _REVERSE, _MATE_REVERSE = 0x900, 0x1, 0x4, 0x8, 0x10, 0x20


class CramError(ValueError):
    """A container that doesn't hold together."""


# Blocks and containers


@dataclass
class Block:
    method: int
    kind: int
    number: int
    raw_size: int
    body: bytes

    def data(self) -> bytes:
        method = METHODS.get(self.method)
        if method == "raw":
            out = self.body
        elif method is None:
            raise CramError(f"unknown block method {self.method}")
        else:
            out = codecs.decompress(method, self.body, self.raw_size)
        if len(out) != self.raw_size:
            raise CramError("a block of another size than it says")
        return out


def read_block(c: Cursor) -> Block:
    start = c.at
    method, kind, number = c.byte(), c.byte(), c.itf8()
    size, raw = c.itf8(), c.itf8()
    body = c.take(size)
    crc = zlib.crc32(c.data[start : c.at])
    if struct.unpack("<I", c.take(4))[0] != crc:
        raise CramError("block checksum")
    return Block(method, kind, number, raw, body)


def block_bytes(kind: int, number: int, data: bytes, method: str = "gzip") -> bytes:
    """A block; stored as it is where its method doesn't make it smaller."""
    code, body = 0, data
    if data and method != "raw" and kind not in (CORE, SLICE_HEADER, COMPRESSION_HEADER):
        packed = codecs.compress(method, data)
        if len(packed) < len(data):
            code, body = next(k for k, v in METHODS.items() if v == {"rans1": "rans0"}.get(method, method.partition("+")[0])), packed
    out = bytes([code, kind]) + codecs.itf8(number) + codecs.itf8(len(body)) + codecs.itf8(len(data)) + body
    return out + struct.pack("<I", zlib.crc32(out))


@dataclass
class ContainerHeader:
    size: int
    ref_id: int
    start: int
    span: int
    records: int
    counter: int
    bases: int
    blocks: int
    landmarks: list[int]


def read_container_header(data: bytes) -> tuple[ContainerHeader, int]:
    """(header, its size)."""
    c = Cursor(data, 4)
    header = ContainerHeader(struct.unpack_from("<i", data)[0], c.itf8(), c.itf8(), c.itf8(), c.itf8(), c.ltf8(), c.ltf8(), c.itf8(), c.ints())
    crc = zlib.crc32(data[: c.at])
    if struct.unpack("<I", c.take(4))[0] != crc:
        raise CramError("container checksum")
    return header, c.at


def container_bytes(h: ContainerHeader, blocks: bytes) -> bytes:
    out = struct.pack("<i", len(blocks)) + codecs.itf8(h.ref_id) + codecs.itf8(h.start) + codecs.itf8(h.span) + codecs.itf8(h.records)
    out += bits.ltf8(h.counter) + bits.ltf8(h.bases) + codecs.itf8(h.blocks) + bits.int_array(h.landmarks)
    return out + struct.pack("<I", zlib.crc32(out)) + blocks


def end_container() -> bytes:
    """The empty container that files end with: its start spells EOF."""
    block = bytes([0, COMPRESSION_HEADER, 0, 6, 6, 1, 0, 1, 0, 1, 0])
    return container_bytes(ContainerHeader(0, _UNPLACED, 0x454F46, 0, 0, 0, 0, 1, []), block + struct.pack("<I", zlib.crc32(block)))


class Containers:
    """The containers of a file, read one header after another."""

    def __init__(self, file):
        self.file, self.size = file, file.size()
        head = file.read_at(min(26, self.size), 0)
        if head[:4] != MAGIC or len(head) < 26:
            raise CramError("no CRAM file")
        self.version = head[4], head[5]
        if self.version[0] != 3:
            raise CramError(f"CRAM {head[4]}.{head[5]} isn't read")

    def header_at(self, offset: int) -> tuple[ContainerHeader, int]:
        """(header, where its blocks begin)."""
        n = 1 << 12
        while True:
            data = self.file.read_at(min(n, self.size - offset), offset)
            try:
                header, size = read_container_header(data)
                return header, offset + size
            except codecs.CodecError:
                if n > self.size - offset:
                    raise CramError("file ends within a container") from None
                n *= 16

    def blocks(self, header: ContainerHeader, at: int) -> bytes:
        data = self.file.read_at(header.size, at)
        if len(data) < header.size:
            raise CramError("file ends within a container")
        return data

    def __iter__(self) -> Iterator[tuple[int, ContainerHeader, int]]:
        """(offset, header, where its blocks begin) of every container with records."""
        offset, first = 26, True
        while offset < self.size:
            header, at = self.header_at(offset)
            if not first and header.records:
                yield offset, header, at
            offset, first = at + header.size, False

    def sam_header(self) -> bam.Header:
        header, at = self.header_at(26)
        data = read_block(Cursor(self.blocks(header, at))).data()
        n = struct.unpack_from("<i", data)[0]
        return parse_sam_header(data[4 : 4 + n].decode())


def parse_sam_header(text: str) -> bam.Header:
    refs = []
    for line in text.splitlines():
        if line.startswith("@SQ\t"):
            tags = dict(x.split(":", 1) for x in line.split("\t")[1:])
            refs.append((tags["SN"], int(tags["LN"])))
    return bam.Header(text, refs)


def read_groups(header: bam.Header) -> list[str]:
    return [m[1] for m in re.finditer(r"^@RG\t(?:.*\t)?ID:([^\t\n]+)", header.text, re.M)]


# References


class References:
    """Bases by name, from FASTA files or given; a file is read by its index where one stands beside it, once a name."""

    def __init__(self, paths: Sequence[str] = (), given: dict[str, str] | None = None):
        self.paths, self.known = list(paths), dict(given or {})

    def bases(self, name: str) -> str | None:
        if name not in self.known:
            self.known[name] = next((s for s in (self._from(p, name) for p in self.paths) if s is not None), None)
        return self.known[name]

    def _from(self, path: str, name: str) -> str | None:
        file = files.open_file(path)
        try:
            index = files.open_file(f"{path}.fai")
            rows = [x.split("\t") for x in index.read_at(index.size(), 0).decode().splitlines()]
        except FileNotFoundError:
            text = file.read_at(file.size(), 0).decode()
            for part in re.split(r"(?:^|\n)>", text)[1:]:
                definition, _, body = part.partition("\n")
                if definition.split()[:1] == [name]:
                    return re.sub(r"\s", "", body)
            return None
        for row in rows:
            if row[0] == name:
                length, offset, line, width = map(int, row[1:5])
                end = offset + length // line * width + length % line
                return re.sub(r"\s", "", file.read_at(end - offset, offset).decode())
        return None


def digest(bases: str) -> bytes:
    return hashlib.md5(bases.upper().encode()).digest()


# Reading


@dataclass
class CompressionHeader:
    names: bool = True
    deltas: bool = True
    needs_reference: bool = True
    substitutions: bytes = PLAIN_SUBSTITUTIONS
    tag_lists: list[list[bytes]] = field(default_factory=list)
    series: dict = field(default_factory=dict)
    tags: dict = field(default_factory=dict)


def read_compression_header(data: bytes) -> CompressionHeader:
    c, out = Cursor(data), CompressionHeader()
    m = Cursor(c.take(c.itf8()))
    for _ in range(m.itf8()):
        key = m.take(2)
        if key == b"SM":
            out.substitutions = m.take(5)
        elif key == b"TD":
            lists = m.take(m.itf8()).split(b"\0")[:-1]
            out.tag_lists = [[x[i : i + 3] for i in range(0, len(x), 3)] for x in lists]
        elif key in (b"RN", b"AP", b"RR"):
            setattr(out, {b"RN": "names", b"AP": "deltas", b"RR": "needs_reference"}[key], bool(m.byte()))
        else:
            raise CramError(f"unknown preservation key {key!r}")
    m = Cursor(c.take(c.itf8()))
    for _ in range(m.itf8()):
        name = m.take(2).decode()
        out.series[name] = bits.read_encoding(m)
    m = Cursor(c.take(c.itf8()))
    for _ in range(m.itf8()):
        key = m.itf8()
        out.tags[bytes([key >> 16 & 0xFF, key >> 8 & 0xFF, key & 0xFF])] = bits.read_encoding(m)
    return out


def substitution_table(codes: bytes) -> dict[tuple[str, int], str]:
    """(reference base, code): base read."""
    out = {}
    for base, byte in zip(_BASES, codes, strict=True):
        for k, other in enumerate(b for b in _BASES if b != base):
            out[base, byte >> (6 - 2 * k) & 3] = other
    return out


@dataclass
class SliceHeader:
    ref_id: int
    start: int
    span: int
    records: int
    counter: int
    blocks: int
    contents: list[int]
    embedded: int
    md5: bytes


def read_slice_header(data: bytes) -> SliceHeader:
    c = Cursor(data)
    return SliceHeader(c.itf8(), c.itf8(), c.itf8(), c.itf8(), c.ltf8(), c.itf8(), c.ints(), c.itf8(), c.take(16))


def slices_of(blocks: bytes) -> Iterator[tuple[CompressionHeader, SliceHeader, list[Block], int, int]]:
    """(compression header, slice header, blocks, place, size) of each slice in a container's blocks."""
    c = Cursor(blocks)
    compression = read_compression_header(read_block(c).data())
    while c.at < len(blocks):
        at = c.at
        head = read_slice_header(read_block(c).data())
        inner = [read_block(c) for _ in range(head.blocks)]
        yield compression, head, inner, at, c.at - at


class _Record:
    __slots__ = ("flags", "own", "ref", "length", "pos", "group", "name", "mate_ref", "mate_pos", "tlen", "distance", "tags", "features", "mapq", "bases", "qualities", "cigar", "end")


def read_slice(compression: CompressionHeader, head: SliceHeader, blocks: list[Block], header: bam.Header, references: References, wanted: set[str]) -> list[_Record]:
    """A slice's records, as far as the wanted columns need them."""
    core = next((b.data() for b in blocks if b.kind == CORE), b"")
    s = bits.Streams(core, {b.number: b.data for b in blocks if b.kind == EXTERNAL})
    e = compression.series
    embedded = next((b.data().decode() for b in blocks if b.kind == EXTERNAL and b.number == head.embedded), None) if head.embedded >= 0 else None
    out, last = [], head.start
    skip_names = "name" not in wanted and isinstance(e.get("RN"), (bits.ArrayStop, bits.ArrayLen)) and _apart(e, "RN") and not any(c in wanted for c in ("mate_ref_id", "mate_pos", "tlen", "flags"))
    skip_qualities = "quality" not in wanted and isinstance(e.get("QS"), bits.External) and _apart(e, "QS")
    skip_tags = "tags" not in wanted and all(isinstance(x, bits.ArrayLen) and isinstance(x.length, bits.External) for x in compression.tags.values())

    def integer(name: str) -> int:
        return e[name].int(s)

    for _ in range(head.records):
        r = _Record()
        r.flags, r.own = integer("BF"), integer("CF")
        r.ref = head.ref_id if head.ref_id != _MULTIPLE else integer("RI")
        r.length = integer("RL")
        r.pos = integer("AP")
        if compression.deltas:
            r.pos = last = last + r.pos
        r.group = integer("RG")
        r.name = None
        if compression.names and not skip_names:
            r.name = e["RN"].bytes(s).decode()
        r.mate_ref, r.mate_pos, r.tlen, r.distance = _UNPLACED, 0, 0, None
        if r.own & DETACHED:
            mate = integer("MF")
            r.flags |= (_MATE_REVERSE if mate & 1 else 0) | (_MATE_UNMAPPED if mate & 2 else 0)
            if not compression.names:
                r.name = e["RN"].bytes(s).decode()
            r.mate_ref, r.mate_pos, r.tlen = integer("NS"), integer("NP"), integer("TS")
        elif r.own & MATE_DOWNSTREAM:
            r.distance = integer("NF")
        keys = compression.tag_lists[integer("TL")]
        r.tags = [] if skip_tags else [(k, compression.tags[k].bytes(s)) for k in keys]
        r.features, r.mapq, r.bases, r.qualities = [], 255, None, None
        if not r.flags & _UNMAPPED:
            at = 0
            for _ in range(integer("FN")):
                code = chr(e["FC"].byte(s))
                at += integer("FP")
                r.features.append((at, code, _feature(code, e, s, skip_qualities)))
            r.mapq = integer("MQ")
        elif not r.own & NO_BASES:
            r.bases = e["BA"].many(s, r.length).decode()
        if r.own & HAS_QUALITIES and not skip_qualities:
            r.qualities = bytearray(e["QS"].many(s, r.length))
        out.append(r)
    needs = bool(wanted & {"sequence"}) and compression.needs_reference
    table = substitution_table(compression.substitutions)
    if needs and embedded is None and head.ref_id >= 0 and any(head.md5):
        bases = references.bases(header.references[head.ref_id][0])
        if bases is None:
            raise CramError(f"no reference for {header.references[head.ref_id][0]}")
        if digest(bases[head.start - 1 : head.start - 1 + head.span]) != head.md5:
            raise CramError(f"the reference's digest isn't the slice's: {header.references[head.ref_id][0]}")
    for r in out:
        if r.flags & _UNMAPPED:
            r.cigar, r.end = None, r.pos
            continue
        reference, first = None, 1
        if needs and not r.own & NO_BASES:
            if embedded is not None:
                reference, first = embedded, head.start
            elif r.ref >= 0:
                reference = references.bases(header.references[r.ref][0])
                if reference is None:
                    raise CramError(f"no reference for {header.references[r.ref][0]}")
        _rebuild(r, reference, first, table)
    _resolve_mates(out)
    return out


def _own_streams(compression: CompressionHeader) -> bool:
    """Whether every series and tag has external streams of its own, as this writer's have, so that a stream can be read alone."""
    e, seen = compression.series, []
    for x in [*e.values(), *compression.tags.values()]:
        parts = [x.length, x.values] if isinstance(x, bits.ArrayLen) else [x]
        if not all(isinstance(p, (bits.External, bits.ArrayStop)) for p in parts):
            return False
        seen += {p.number for p in parts}
    return len(seen) == len(set(seen)) and compression.names and isinstance(e.get("RN"), bits.ArrayStop) and not any(len({k[:2] for k in x}) < len(x) for x in compression.tag_lists)


def slice_columns(compression: CompressionHeader, head: SliceHeader, blocks: list[Block], header: bam.Header, references: References, groups: Sequence[str], wanted: set[str], reach: bool = False) -> dict | None:
    """The wanted columns of a slice as :func:`read_slice` and :func:`row` have them, without a step for each record; None of a slice that they must read.

    With ``reach`` also ``_ref``, ``_pos`` and ``_end``, where records lie.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    if not _own_streams(compression):
        return None
    e, held, n = compression.series, {b.number: b for b in blocks if b.kind == EXTERNAL}, head.records
    # streams of which this reader's columns need a part: what is left of the others isn't looked at
    stream = lambda number: np.frombuffer(held[number].data(), np.uint8) if number in held else np.zeros(0, np.uint8)

    def ints(name: str, count: int) -> np.ndarray:
        if not count:
            return np.zeros(0, np.int64)
        if name not in e or not isinstance(e[name], bits.External):
            raise CramError(f"no series {name}")
        return read_itf8s(stream(e[name].number), count)[0]

    def raw(name: str) -> np.ndarray:
        return stream(e[name].number) if name in e else np.zeros(0, np.uint8)

    flags, own = ints("BF", n), ints("CF", n)
    ref = ints("RI", n) if head.ref_id == _MULTIPLE else np.full(n, head.ref_id)
    length, pos = ints("RL", n), ints("AP", n)
    if compression.deltas:
        pos = head.start + np.cumsum(pos)
    alone = own & DETACHED != 0
    first = np.flatnonzero(~alone & (own & MATE_DOWNSTREAM != 0))
    mate = ints("MF", int(alone.sum()))
    flags[alone] |= np.where(mate & 1, _MATE_REVERSE, 0) | np.where(mate & 2, _MATE_UNMAPPED, 0)
    mate_ref, mate_pos, tlen = np.full(n, _UNPLACED), np.zeros(n, np.int64), np.zeros(n, np.int64)
    if wanted & {"mate_ref_id", "mate_pos", "tlen"}:
        for name, to in (("NS", mate_ref), ("NP", mate_pos), ("TS", tlen)):
            to[alone] = ints(name, int(alone.sum()))
    second = first + ints("NF", len(first)) + 1
    if (second >= n).any() or len(np.unique(np.concatenate((first, second)))) < 2 * len(first):
        return None  # chains of more than two, or ones that can't be
    mapped = flags & _UNMAPPED == 0
    end, out = pos.copy(), {}
    if reach or wanted & {"cigar", "sequence", "quality"} or (len(first) and "tlen" in wanted):
        told = _told_features(compression, head, held, header, references, wanted, ints, raw, flags, own, ref, pos, length, mapped)
        if told is None:
            return None
        end, out = told
    for a, b in ((first, second), (second, first)):
        mate_ref[a], mate_pos[a] = ref[b], pos[b]
        tlen[a] = np.where(mapped[a] & mapped[b] & (ref[a] == ref[b]), (np.maximum(end[a], end[b]) - np.minimum(pos[a], pos[b]) + 1) * np.where((pos[a] < pos[b]) | ((pos[a] == pos[b]) & (a < b)), 1, -1), 0)
    turned = flags.copy()
    for a, b in ((first, second), (second, first)):
        flags[a] |= np.where(turned[b] & _REVERSE, _MATE_REVERSE, 0) | np.where(turned[b] & _UNMAPPED, _MATE_UNMAPPED, 0)
    null = lambda values, where, kind: pa.array(values, kind, mask=where)
    mapq = np.full(n, 255)
    if "mapq" in wanted:
        mapq[mapped] = ints("MQ", int(mapped.sum()))
    if "name" in wanted:
        names = [x.decode() for x in held[e["RN"].number].data().split(bytes([e["RN"].stop]))[:n]] if n else []
        if len(names) < n:
            raise CramError("names end early")
        out["name"] = pa.array([None if x in ("", "*") else x for x in names], pa.string())
    if "tags" in wanted:
        out["tags"] = _tag_column(compression, stream, ints("TL", n), ints("RG", n), groups)
    out |= {
        "flags": pa.array(flags, pa.int32()), "ref_id": null(ref, ref < 0, pa.int32()), "pos": null(pos, pos <= 0, pa.int64()), "mapq": null(mapq, mapq == 255, pa.int32()),
        "mate_ref_id": null(mate_ref, mate_ref < 0, pa.int32()), "mate_pos": null(mate_pos, mate_pos <= 0, pa.int64()), "tlen": pa.array(tlen, pa.int32()),
    }
    if "ref_name" in wanted:
        out["ref_name"] = pa.array([x for x, _ in header.references], pa.string()).take(out["ref_id"])
    return {k: v for k, v in out.items() if k in wanted} | ({"_ref": ref, "_pos": pos, "_end": end} if reach else {})


def _arrays(data: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """(where each begins, its length) of byte arrays that stand behind their lengths."""
    c, starts, sizes = Cursor(data.tobytes()), [], []
    for _ in range(count):
        size = c.itf8()
        starts.append(c.at)
        sizes.append(size)
        c.at += size
    if c.at > len(data):
        raise codecs.CodecError("data end early")
    return np.array(starts, np.int64), np.array(sizes, np.int64)


def _told_features(compression, head, held, header, references, wanted, ints, raw, flags, own, ref, pos, length, mapped):
    """(last positions, columns) that come of features: CIGARs, bases and qualities. None where a feature is of a kind that isn't met here."""
    import pyarrow as pa
    import pyarrow.compute as pc

    n, e = len(pos), compression.series
    rows = np.flatnonzero(mapped)
    counts = np.zeros(n, np.int64)
    counts[rows] = ints("FN", len(rows))
    total = int(counts.sum())
    codes, steps = raw("FC")[:total].copy(), ints("FP", total)
    if len(codes) < total or not np.isin(codes, np.frombuffer(b"XBbISDNPH", np.uint8)).all():
        return None
    owner, begin = np.repeat(np.arange(n), counts), offsets(counts)
    run = np.cumsum(steps)
    at = run - np.concatenate(([0], run))[begin[owner]] if total else run  # read places from 1
    sizes, starts, bytes_of = np.ones(total, np.int64), np.zeros(total, np.int64), {}
    for code, series in (("D", "DL"), ("N", "RS"), ("P", "PD"), ("H", "HC")):
        some = codes == ord(code)
        sizes[some] = ints(series, int(some.sum()))
    for code, series in (("I", "IN"), ("S", "SC"), ("b", "BB")):
        some = codes == ord(code)
        if some.any():
            x = e[series]
            if not isinstance(x, bits.ArrayLen) or x.length.number != x.values.number:
                return None
            bytes_of[code] = np.frombuffer(held[x.length.number].data(), np.uint8)
            starts[some], sizes[some] = _arrays(bytes_of[code], int(some.sum()))
    reads = np.where(np.isin(codes, np.frombuffer(b"XBbIS", np.uint8)), sizes, 0)
    covers = np.where(np.isin(codes, np.frombuffer(b"XBbDN", np.uint8)), sizes, 0)
    new = np.zeros(total, bool)
    new[begin[:-1][counts > 0]] = True
    before = np.where(new, 1, np.concatenate(([0], (at + reads)[:-1])))
    gap = at - before
    last = np.ones(n, np.int64)
    last[counts > 0] = (at + reads)[begin[1:][counts > 0] - 1] if total else 1
    rest = np.where(mapped, np.maximum(length - last + 1, 0), 0)
    if (gap < 0).any() or (np.where(mapped, length - last + 1, 0) < 0).any():
        return None
    # the first reference place of each feature's gap
    moved = np.cumsum(gap + covers)
    ref_at = pos[owner] + np.concatenate(([0], moved))[:-1] - np.concatenate(([0], moved))[begin[owner]] if total else moved
    spans = summed(gap + covers, counts)
    end = np.where(mapped, pos + spans + rest - 1, pos)
    out = {}
    if "cigar" in wanted:
        rank, back = np.cumsum(mapped) - 1, np.arange(total)
        kinds, many, row = (np.zeros(2 * total + len(rows), np.int64) for _ in range(3))
        letter = np.zeros(256, np.int64)
        for c in "XBb":
            letter[ord(c)] = bam.CIGAR_CODES.index("M")
        for c in "ISDNPH":
            letter[ord(c)] = bam.CIGAR_CODES.index(c)
        g = 2 * back + rank[owner]
        many[g], row[g] = gap, owner
        many[g + 1], row[g + 1], kinds[g + 1] = sizes, owner, letter[codes]
        f = 2 * begin[1:][rows] + np.arange(len(rows))
        many[f], row[f] = rest[rows], rows
        keep = many > 0
        kinds, many, row = kinds[keep], many[keep], row[keep]
        edge = np.concatenate(([True], (row[1:] != row[:-1]) | (kinds[1:] != kinds[:-1]))) if len(row) else np.zeros(0, bool)
        where = np.flatnonzero(edge)
        many = np.add.reduceat(many, where) if len(where) else many
        kinds, row = kinds[where], row[where]
        which, back = np.unique(many << 4 | kinds, return_inverse=True)
        texts = pa.array([f"{x >> 4}{bam.CIGAR_CODES[x & 15]}" for x in which.tolist()], pa.string()).take(pa.array(back))
        per = np.bincount(row, minlength=n)
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets(per), pa.int32()), texts), "")
        out["cigar"] = pc.if_else(pa.array(per > 0), joined, pa.scalar(None, pa.string()))
    lone = np.flatnonzero(codes == ord("B"))
    lones = np.bincount(owner[lone], minlength=n)
    rank_of = np.arange(len(lone)) - offsets(lones)[owner[lone]]
    if "sequence" in wanted:
        has = own & NO_BASES == 0
        size = np.where(has, length, 0)
        place, bases = offsets(size), np.full(int(size.sum()), ord("N"), np.uint8)
        given = raw("BA")
        in_ba = np.where(mapped, lones, size)
        ba = offsets(in_ba)
        plain = np.flatnonzero(~mapped & has)
        at_out = lambda r, k, m: np.repeat(place[r] + k - offsets(m)[:-1], m) + np.arange(int(m.sum()))
        if ba[-1] > len(given):
            raise codecs.CodecError("data end early")
        bases[at_out(plain, 0, size[plain])] = gathered(given, ba[plain], size[plain])
        shown = has[owner]
        for code in "ISb":
            some = np.flatnonzero((codes == ord(code)) & shown)
            if len(some):
                bases[at_out(owner[some], at[some] - 1, sizes[some])] = gathered(bytes_of[code], starts[some], sizes[some])
        here = shown[lone]
        bases[place[owner[lone]][here] + at[lone][here] - 1] = given[ba[owner[lone]] + rank_of][here]
        embedded = np.frombuffer(held[head.embedded].data(), np.uint8) if head.embedded >= 0 else None
        substituted = np.flatnonzero(codes == ord("X"))
        values = raw("BS")[: len(substituted)][shown[substituted]]
        changed = substituted[shown[substituted]]
        table = np.zeros((256, 4), np.uint8)
        for (a, v), b in substitution_table(compression.substitutions).items():
            table[ord(a), v] = ord(b)
        known = np.isin(np.arange(256), np.frombuffer(_BASES.encode(), np.uint8))
        under = np.full(len(changed), ord("N"), np.uint8)
        # matches: before features, and behind the last one
        r = np.concatenate((owner, rows))
        m = np.concatenate((gap, rest[rows]))
        to = np.concatenate((before - 1, last[rows] - 1))
        of = np.concatenate((ref_at, pos[rows] + spans[rows]))
        if compression.needs_reference:
            for k in np.unique(ref[rows[has[rows]]]).tolist():
                if embedded is not None:
                    body, low = embedded, head.start
                elif k >= 0:
                    found = references.bases(header.references[k][0])
                    if found is None:
                        raise CramError(f"no reference for {header.references[k][0]}")
                    if k == head.ref_id and any(head.md5) and digest(found[head.start - 1 : head.start - 1 + head.span]) != head.md5:
                        raise CramError(f"the reference's digest isn't the slice's: {header.references[k][0]}")
                    body, low = np.frombuffer(found.encode(), np.uint8), 1
                else:
                    continue
                body = np.where((body >= 97) & (body <= 122), body - 32, body).astype(np.uint8)
                mine = np.flatnonzero((ref[r] == k) & has[r] & (m > 0))
                if (of[mine] < low).any():
                    return None
                source = np.repeat(of[mine] - low - offsets(m[mine])[:-1], m[mine]) + np.arange(int(m[mine].sum()))
                padded = np.concatenate((body, [ord("N")])).astype(np.uint8)
                bases[at_out(r[mine], to[mine], m[mine])] = padded[np.minimum(source, len(body))]
                x = np.flatnonzero(ref[owner[changed]] == k)
                spot = ref_at[changed[x]] + gap[changed[x]] - low
                if (spot < 0).any():
                    return None
                under[x] = padded[np.minimum(spot, len(body))]
        bases[place[owner[changed]] + at[changed] - 1] = table[np.where(known[under], under, ord("N")), values]
        out["sequence"] = strings(bases, size, size == 0)
    if "quality" in wanted:
        has = own & HAS_QUALITIES != 0
        given = raw("QS")
        sizes_q = np.where(has, length, 0)
        qs = offsets(lones + sizes_q)
        if qs[-1] > len(given):
            raise codecs.CodecError("data end early")
        odd = given[qs[owner[lone]] + rank_of] != 255
        if (odd & ~has[owner[lone]]).any():
            return None
        scores = gathered(given, qs[:-1] + lones, sizes_q)
        none = (sizes_q == 0) | (summed(scores == 255, sizes_q) == sizes_q)
        scores = np.minimum(scores[~np.repeat(none, sizes_q)], 93) + 33
        out["quality"] = strings(scores.astype(np.uint8), np.where(none, 0, sizes_q), none)
    return end, out


def _tag_column(compression: CompressionHeader, stream, lists: np.ndarray, group: np.ndarray, groups: Sequence[str]):
    import pyarrow as pa

    n, values = len(lists), {}
    holds = {k: np.array([k in x for x in compression.tag_lists], bool)[lists] for k in compression.tags}
    for k, x in compression.tags.items():
        count = int(holds[k].sum())
        if count:
            sizes = read_itf8s(stream(x.length.number), count)[0] if x.length.number != x.values.number else None
            data = stream(x.values.number)
            starts, sizes = (offsets(sizes)[:-1], sizes) if sizes is not None else _arrays(data, count)
            if starts[-1] + sizes[-1] > len(data):
                raise codecs.CodecError("data end early")
            values[k] = data, starts, sizes, np.cumsum(holds[k]) - 1
    parts, where = [], []
    for i, keys in enumerate(compression.tag_lists):
        rows = np.flatnonzero(lists == i)
        if len(rows):
            pieces = []
            for k in keys:
                data, starts, sizes, rank = values[k]
                pieces += [k, binaries(gathered(data, starts[rank[rows]], sizes[rank[rows]]), sizes[rank[rows]])]
            told = binaries(group[rows].astype("<i4").view(np.uint8), np.full(len(rows), 4))
            parts.append(side_by_side(told, *pieces))
            where.append(rows)
    kind = pa.map_(pa.string(), pa.string())
    if not n:
        return pa.array([], kind)
    back = np.empty(n, np.int64)
    back[np.concatenate(where)] = np.arange(n)
    coded = pa.concat_arrays(parts).dictionary_encode()

    def tags(x: bytes) -> list[tuple[str, str]]:
        (g,) = struct.unpack_from("<i", x)
        return [(k, bam.tag_text(*v)) for k, v in bam.parse_tags(x[4:]).items()] + ([("RG", f"Z:{groups[g]}")] if g >= 0 else [])

    return pa.array([tags(x) for x in coded.dictionary.to_pylist()], kind).take(coded.indices.take(pa.array(back)))


def _apart(e: dict, name: str) -> bool:
    """Whether a series has external streams of its own, so that it can be passed over."""

    def numbers(x) -> set[int]:
        if isinstance(x, bits.ArrayLen):
            return numbers(x.length) | numbers(x.values)
        return {x.number} if isinstance(x, (bits.External, bits.ArrayStop)) else {-1}

    mine = numbers(e[name])
    return -1 not in mine and not any(mine & numbers(x) for k, x in e.items() if k != name and x is not None)


def _feature(code: str, e: dict, s: bits.Streams, skip_qualities: bool):
    if code in ("D", "N", "P", "H"):
        return e[{"D": "DL", "N": "RS", "P": "PD", "H": "HC"}[code]].int(s)
    if code == "X":
        return e["BS"].byte(s)
    if code in ("I", "S", "b", "q"):
        return e[{"I": "IN", "S": "SC", "b": "BB", "q": "QQ"}[code]].bytes(s)
    if code == "i":
        return bytes([e["BA"].byte(s)])
    if code == "B":
        base = e["BA"].byte(s)
        return base, 255 if skip_qualities else e["QS"].byte(s)
    if code == "Q":
        return 255 if skip_qualities else e["QS"].byte(s)
    raise CramError(f"unknown feature {code!r}")


def _rebuild(r: _Record, reference: str | None, first: int, table: dict) -> None:
    """CIGAR, last position and bases of a mapped record from its features; matches come from the reference."""
    ops: list[list] = []
    out, read, ref = [], 1, r.pos
    extra: dict[int, int] = {}

    def op(kind: str, n: int) -> None:
        if n:
            if ops and ops[-1][1] == kind:
                ops[-1][0] += n
            else:
                ops.append([n, kind])

    def match(n: int) -> None:
        nonlocal read, ref
        if n > 0:
            op("M", n)
            if reference is not None:
                piece = reference[ref - first : ref - first + n].upper()
                out.append(piece + "N" * (n - len(piece)))
            else:
                out.append("N" * n)
            read, ref = read + n, ref + n

    for at, code, value in r.features:
        match(at - read)
        if code == "X":
            base = reference[ref - first].upper() if reference is not None and ref - first < len(reference) else "N"
            out.append(table[base if base in _BASES else "N", value])
            op("M", 1)
            read, ref = read + 1, ref + 1
        elif code == "B":
            out.append(chr(value[0]))
            extra[read] = value[1]
            op("M", 1)
            read, ref = read + 1, ref + 1
        elif code == "b":
            out.append(value.decode())
            op("M", len(value))
            read, ref = read + len(value), ref + len(value)
        elif code in ("I", "i", "S"):
            out.append(value.decode())
            op("S" if code == "S" else "I", len(value))
            read += len(value)
        elif code in ("D", "N"):
            op(code, value)
            ref += value
        elif code in ("P", "H"):
            op(code, value)
        elif code == "Q":
            extra[at] = value
        elif code == "q":
            extra |= {at + k: q for k, q in enumerate(value)}
    match(r.length - read + 1)
    r.cigar = "".join(f"{n}{k}" for n, k in ops) or None
    r.end = ref - 1
    r.bases = None if r.own & NO_BASES else "".join(out)
    if r.qualities is None and extra:
        r.qualities = bytearray(extra.get(k, 255) for k in range(1, r.length + 1))


def _resolve_mates(records: list[_Record]) -> None:
    """Mates that a record names by its distance in the slice get each other's place, flags and the template's length."""
    done = [False] * len(records)
    for i, r in enumerate(records):
        if done[i] or r.distance is None:
            continue
        chain = [i]
        while records[chain[-1]].distance is not None:
            j = chain[-1] + records[chain[-1]].distance + 1
            if j >= len(records):
                raise CramError("a mate beyond its slice")
            chain.append(j)
        for j in chain:
            done[j] = True
        name = r.name
        for j, k in zip(chain, chain[1:] + chain[:1], strict=True):
            a, b = records[j], records[k]
            a.name = a.name if a.name is not None else name
            a.mate_ref, a.mate_pos = b.ref, b.pos
            a.flags |= (_MATE_REVERSE if b.flags & _REVERSE else 0) | (_MATE_UNMAPPED if b.flags & _UNMAPPED else 0)
        for j, n in zip(chain, template_lengths([records[j] for j in chain]), strict=True):
            records[j].tlen = n


def template_lengths(chain: Sequence) -> list[int]:
    """Signed length of the template that a chain of segments covers: positive for the leftmost, the first of several."""
    if any(r.flags & _UNMAPPED for r in chain) or len({r.ref for r in chain}) > 1:
        return [0] * len(chain)
    low, high = min(r.pos for r in chain), max(r.end for r in chain)
    first = min(range(len(chain)), key=lambda i: (chain[i].pos, i))
    return [(high - low + 1) * (1 if i == first else -1) for i in range(len(chain))]


def row(r: _Record, header: bam.Header, groups: Sequence[str], columns: Sequence[str]) -> tuple:
    out = []
    for c in columns:
        if c == "name":
            out.append(r.name if r.name and r.name != "*" else None)
        elif c == "flags":
            out.append(r.flags)
        elif c == "ref_id":
            out.append(r.ref if r.ref >= 0 else None)
        elif c == "ref_name":
            out.append(header.references[r.ref][0] if r.ref >= 0 else None)
        elif c == "pos":
            out.append(r.pos if r.pos > 0 else None)
        elif c == "mapq":
            out.append(None if r.mapq == 255 else r.mapq)
        elif c == "cigar":
            out.append(r.cigar)
        elif c == "mate_ref_id":
            out.append(r.mate_ref if r.mate_ref >= 0 else None)
        elif c == "mate_pos":
            out.append(r.mate_pos if r.mate_pos > 0 else None)
        elif c == "tlen":
            out.append(r.tlen)
        elif c == "sequence":
            out.append(r.bases or None)
        elif c == "quality":
            q = r.qualities
            out.append(None if not q or all(x == 255 for x in q) else bytes(min(x, 93) + 33 for x in q).decode())
        elif c == "tags":
            tags = [(k, bam.tag_text(*v)) for key, raw in r.tags for k, v in bam.parse_tags(key + raw).items()]
            out.append(tags + ([("RG", f"Z:{groups[r.group]}")] if r.group >= 0 else []))
        else:
            raise CramError(f"no such column: {c}")
    return tuple(out)


# Writing


class _Writer:
    """Containers of one slice each, from rows in the order they come."""

    def __init__(self, header: bam.Header, references: References | None, embed: bool, method: str):
        self.header, self.references, self.embed, self.method = header, references, embed, method
        self.groups = {g: i for i, g in enumerate(read_groups(header))}
        self.counter = 0

    def start(self) -> bytes:
        text = self.header.text.encode()
        block = block_bytes(FILE_HEADER, 0, struct.pack("<i", len(text)) + text, "gzip")
        return MAGIC + b"\x03\x00" + b"\0" * 20 + container_bytes(ContainerHeader(0, 0, 0, 0, 0, 0, 0, 1, [0]), block)

    def batch(self, rows) -> bytes:
        """A container of an Arrow batch, as :meth:`container` makes it, without a step for each record; odd ones are left to it."""
        quick = self._columns(rows)
        if quick is not None:
            return quick
        listed = rows.to_pylist()
        for r in listed:
            if isinstance(r.get("tags"), list):
                r["tags"] = dict(r["tags"])
        return self.container(listed)

    def _columns(self, rows) -> bytes | None:
        import pyarrow as pa
        import pyarrow.compute as pc

        n = rows.num_rows
        given = dict(zip(rows.schema.names, rows.columns, strict=True))
        texts = lambda c: given[c] if c in given else pa.nulls(n, pa.string())
        numbers = lambda c, missing: pc.fill_null(given[c].cast(pa.int64()), missing).to_numpy(zero_copy_only=False) if c in given else np.full(n, missing)
        ops = cigar_ops(pc.replace_with_mask(texts("cigar"), pc.fill_null(pc.equal(texts("cigar"), "*"), False), pa.scalar("", pa.string())))
        seq, seq_at = flat(texts("sequence"))
        qual, qual_at = flat(texts("quality"))
        if ops is None or (seq > 127).any() or (qual > 127).any() or (qual < 33).any() or given["flags"].null_count:
            return None
        n_ops, sizes, kinds = ops
        of = lambda letters: np.isin(kinds, [bam.CIGAR_CODES.index(k) for k in letters])
        bases, scored, flags = np.diff(seq_at), np.diff(qual_at), numbers("flags", 0)
        used, covered = summed(sizes * of("MIS=X"), n_ops), summed(sizes * of("MDN=X"), n_ops)
        length = np.where(bases > 0, bases, used)
        if ((bases > 0) & (n_ops > 0) & (used != bases)).any() or ((scored > 0) & (scored != length)).any():
            return None
        refs, pos, mates = numbers("ref_id", _UNPLACED), numbers("pos", 0), numbers("mate_ref_id", _UNPLACED)
        unmapped = flags & _UNMAPPED != 0
        ends = pos + np.maximum(1, np.where(unmapped, 0, covered)) - 1
        ref_id = int(refs[0]) if (refs == refs[0]).all() else _MULTIPLE
        start = int(min(pos[pos != 0], default=0)) if ref_id >= 0 else 0
        span = int(max(ends, default=0)) - start + 1 if ref_id >= 0 and start else 0
        # mates: rows whose name two segments have
        names, distance, linked = texts("name"), np.zeros(n, np.int64), np.zeros(n, bool)
        paired = (flags & _PAIRED != 0) & (flags & _SECONDARY == 0)
        coded = pc.if_else(pa.array(paired), names, pa.scalar(None, pa.string())).dictionary_encode()
        which = pc.fill_null(coded.indices.cast(pa.int64()), -1).to_numpy(zero_copy_only=False)
        two = np.flatnonzero((which >= 0) & (np.bincount(which[which >= 0], minlength=len(coded.dictionary) + 1)[which] == 2))
        if len(two):
            some = rows.select(["name", "flags", *(c for c in ("ref_id", "pos", "mate_ref_id", "mate_pos", "tlen") if c in given)]).take(pa.array(two)).to_pylist()
            for i, j in _links(some, ends[two].tolist()).items():
                linked[two[i]] = True
                distance[two[i]] = 0 if j is None else two[j] - two[i]
        own = np.where(scored > 0, HAS_QUALITIES, 0) | np.where(bases > 0, 0, NO_BASES) | np.where(distance > 0, MATE_DOWNSTREAM, np.where(linked, 0, DETACHED))
        # tags: the group of a read is a number, others go by their keys
        group = np.full(n, -1)
        keys = pa.array([b""] * n, pa.large_binary())
        tag_streams: dict[bytes, tuple[bytes, bytes]] = {}
        tags = given.get("tags")
        if tags is not None and tags.null_count != n:
            at = np.asarray(tags.offsets)
            if tags.null_count or len(at) != n + 1:
                return None
            items = slice(int(at[0]), int(at[-1]))
            at = at - at[0]
            key, item = tags.keys.slice(items.start, items.stop - items.start), tags.items.slice(items.start, items.stop - items.start)
            if item.null_count:
                return None
            owner, is_group = np.repeat(np.arange(n), np.diff(at)), np.asarray(pc.equal(key, "RG"))
            if np.bincount(owner[is_group], minlength=n).max(initial=0) > 1:
                return None
            both = item.dictionary_encode()
            number = np.array([self.groups.get(x[2:], -1) for x in both.dictionary.to_pylist()], np.int64)[np.asarray(both.indices)]
            group[owner[is_group]] = number[is_group]
            kept = ~(is_group & (number >= 0))
            raw = mapped(side_by_side(key, b"=", item).filter(pa.array(kept)), lambda x: bam.encode_tag(*x.decode().split("=", 1)))
            data, raw_at = flat(raw)
            three = gathered(data, raw_at[:-1], np.full(len(raw), 3))
            held = np.bincount(owner[kept], minlength=n)
            keys = binaries(three, 3 * held)
            kind = binaries(three, np.full(len(raw), 3)).dictionary_encode()
            for k, name in enumerate(kind.dictionary.to_pylist()):
                one = np.flatnonzero(np.asarray(kind.indices) == k)
                rest = (raw_at[1:] - raw_at[:-1])[one] - 3
                tag_streams[name] = itf8_bytes(rest), gathered(data, raw_at[one] + 3, rest).tobytes()
        lists = keys.dictionary_encode()
        put = itf8_bytes
        alone, first = own & DETACHED != 0, distance > 0
        streams: dict[str, bytes] = {k: b"" for k in SERIES} | {
            "BF": put(np.where(linked, flags & ~(_MATE_REVERSE | _MATE_UNMAPPED), flags)), "CF": put(own), "RI": put(refs) if ref_id == _MULTIPLE else b"", "RL": put(length), "AP": put(pos), "RG": put(group),
            "RN": flat(side_by_side(pc.if_else(pc.equal(pc.fill_null(names, ""), ""), "*", names), b"\0"))[0].tobytes(), "TL": put(np.asarray(lists.indices)), "NF": put(distance[first] - 1),
            "MF": put(((flags & _MATE_REVERSE != 0) * 1 + (flags & _MATE_UNMAPPED != 0) * 2)[alone]), "NS": put(mates[alone]), "NP": put(numbers("mate_pos", 0)[alone]), "TS": put(numbers("tlen", 0)[alone]),
            "MQ": put(numbers("mapq", 255)[~unmapped]),
        }
        found = self._feature_columns(unmapped, pos, refs, seq, seq_at, qual, qual_at, n_ops, sizes, kinds)
        streams |= found
        told = {tuple(x[i : i + 3] for i in range(0, len(x), 3)): k for k, x in enumerate(lists.dictionary.to_pylist())}
        return self._assembled(range(n), ref_id, start, span, int(length.sum()), streams, tag_streams, told)

    def _feature_columns(self, unmapped, pos, refs, seq, seq_at, qual, qual_at, n_ops, sizes, kinds) -> dict[str, bytes]:
        """The streams of what tells mapped reads from the reference, and of bases and qualities."""
        n, bases, scored = len(pos), np.diff(seq_at), np.diff(qual_at)
        code = lambda letters: [bam.CIGAR_CODES.index(k) for k in letters]
        owner = np.repeat(np.arange(n), n_ops)
        reads, covers = sizes * np.isin(kinds, code("MIS=X")), sizes * np.isin(kinds, code("MDN=X"))
        before = lambda values: (offsets(values)[:-1] - offsets(values)[offsets(n_ops)[:-1]][owner]) if len(owner) else values
        read, ref = before(reads), before(covers) + np.where(pos == 0, 1, pos)[owner] - 1  # places from 0 on
        here, has = ~unmapped[owner], bases[owner] > 0
        match = np.isin(kinds, code("M=X")) & here & has
        known = np.zeros(n, bool)
        if self.references:
            known = np.isin(refs, [r for r in np.unique(refs).tolist() if r >= 0 and self.references.bases(self.header.references[r][0])])
        whole, single = match & ~known[owner], here & ~np.isin(kinds, code("M=X"))
        # stretches of bases where no reference is known; operations other than matches
        parts = [(np.flatnonzero(whole), read[whole], np.full(whole.sum(), ord("b")), sizes[whole])]
        letter = np.frombuffer(bam.CIGAR_CODES.encode(), np.uint8)
        parts.append((np.flatnonzero(single), read[single], letter[kinds[single]].astype(np.int64), sizes[single]))
        compared = np.flatnonzero(match & known[owner])
        if len(compared):
            many = sizes[compared]
            step = np.arange(int(many.sum())) - np.repeat(offsets(many)[:-1], many)
            of = np.repeat(compared, many)
            base, there, given = seq[seq_at[owner[of]] + read[of] + step], np.full(len(of), ord("N"), np.uint8), np.zeros(len(of), bool)
            for r in np.unique(refs[owner[compared]]).tolist():
                other = np.frombuffer(self.references.bases(self.header.references[r][0]).upper().encode(), np.uint8)
                mine = np.flatnonzero(refs[owner[of]] == r)
                place = ref[of[mine]] + step[mine]
                inside = (place >= 0) & (place < len(other))
                there[mine[inside]] = other[place[inside]]
            given = np.isin(there, np.frombuffer(_BASES.encode(), np.uint8))
            outside = np.full(len(of), False)
            for r in np.unique(refs[owner[compared]]).tolist():
                mine = np.flatnonzero(refs[owner[of]] == r)
                outside[mine] = ref[of[mine]] + step[mine] >= len(self.references.bases(self.header.references[r][0]))
            there[~given] = ord("N")
            table = np.full((256, 256), 255, np.uint8)
            for (a, v), b in substitution_table(PLAIN_SUBSTITUTIONS).items():
                table[ord(a), ord(b)] = v
            differs = np.flatnonzero((base != there) | outside | ~given)
            value = table[there[differs], base[differs]]
            kind = np.where(value == 255, ord("B"), ord("X"))
            parts.append((of[differs], read[of[differs]] + step[differs], kind, np.where(value == 255, base[differs], value)))
        op, at, letters, values = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(op, kind="stable")
        op, at, letters, values = op[order], at[order] + 1, letters[order], values[order]
        row = owner[op]
        counts = np.bincount(row, minlength=n)
        new = np.concatenate(([True], row[1:] != row[:-1])) if len(row) else np.zeros(0, bool)
        steps = np.where(new, at, at - np.concatenate(([0], at[:-1])))
        put = itf8_bytes
        out = {"FN": put(counts[~unmapped]), "FC": letters.astype(np.uint8).tobytes(), "FP": put(steps)}
        for k, series in (("D", "DL"), ("N", "RS"), ("P", "PD"), ("H", "HC")):
            out[series] = put(values[letters == ord(k)])
        out["BS"] = values[letters == ord("X")].astype(np.uint8).tobytes()
        padded = np.concatenate((seq, [ord("N")])).astype(np.uint8)
        for k, series in (("I", "IN"), ("S", "SC"), ("b", "BB")):
            some = np.flatnonzero(letters == ord(k))
            size, starts = values[some], seq_at[row[some]] + at[some] - 1
            if (bases[row[some]] > 0).all():
                pieces = gathered(padded, starts, size)
            else:  # inserted bases of a read without any
                inner = np.repeat(starts - offsets(size)[:-1], size) + np.arange(int(size.sum()))
                pieces = padded[np.where(np.repeat(bases[row[some]] > 0, size), inner, len(seq))]
            out[series] = flat(side_by_side(itf8s(size), binaries(pieces, size)))[0].tobytes()
        # single bases, and their qualities, stand where their reads do
        lone = np.flatnonzero(letters == ord("B"))
        lone_counts = np.bincount(row[lone], minlength=n)
        plain = np.where(unmapped, bases, 0)
        out["BA"] = flat(side_by_side(binaries(values[lone].astype(np.uint8), lone_counts), binaries(gathered(seq, seq_at[:-1], plain), plain)))[0].tobytes()
        scores = (qual - 33).astype(np.uint8)
        padded = np.concatenate((scores, [255])).astype(np.uint8)
        of_lone = padded[np.where(scored[row[lone]] > 0, qual_at[row[lone]] + at[lone] - 1, len(scores))]
        out["QS"] = flat(side_by_side(binaries(of_lone, lone_counts), binaries(scores, scored)))[0].tobytes()
        return out

    def container(self, rows: Sequence[dict]) -> bytes:
        refs = {r.get("ref_id") if r.get("ref_id") is not None else _UNPLACED for r in rows}
        ref_id = refs.pop() if len(refs) == 1 else _MULTIPLE
        ends = [_last(r) for r in rows]
        start = min((r["pos"] for r in rows if r.get("pos")), default=0) if ref_id >= 0 else 0
        span = max(ends, default=0) - start + 1 if ref_id >= 0 and start else 0
        streams: dict[str, bytearray] = {k: bytearray() for k in SERIES}
        tag_streams: dict[bytes, tuple[bytearray, bytearray]] = {}
        lists: dict[tuple[bytes, ...], int] = {}
        linked = _links(rows, ends)
        put = lambda k, v: streams[k].extend(codecs.itf8(v))
        bases = 0
        for i, r in enumerate(rows):
            seq, qual, flags = r.get("sequence"), r.get("quality"), r["flags"]
            ops = [(int(n), k) for n, k in re.findall(r"(\d+)([MIDNSHP=X])", r.get("cigar") or "")]
            length = len(seq) if seq else sum(n for n, k in ops if k in "MIS=X")
            if seq and ops and sum(n for n, k in ops if k in "MIS=X") != len(seq):
                raise CramError("sequence and CIGAR differ in length")
            bases += length
            own = (HAS_QUALITIES if qual else 0) | (0 if seq else NO_BASES)
            downstream = linked.get(i)
            own |= MATE_DOWNSTREAM if downstream else 0 if i in linked else DETACHED
            put("BF", flags & ~(_MATE_REVERSE | _MATE_UNMAPPED) if i in linked else flags)
            put("CF", own)
            if ref_id == _MULTIPLE:
                put("RI", _UNPLACED if r.get("ref_id") is None else r["ref_id"])
            put("RL", length)
            put("AP", r.get("pos") or 0)
            tags = dict(r["tags"] or {}) if r.get("tags") is not None else {}
            group = tags.get("RG", "")[2:]
            put("RG", self.groups.get(group, -1))
            if group in self.groups:
                del tags["RG"]
            streams["RN"] += (r.get("name") or "*").encode() + b"\0"
            if own & DETACHED:
                put("MF", (1 if flags & _MATE_REVERSE else 0) | (2 if flags & _MATE_UNMAPPED else 0))
                put("NS", _UNPLACED if r.get("mate_ref_id") is None else r["mate_ref_id"])
                put("NP", r.get("mate_pos") or 0)
                put("TS", r.get("tlen") or 0)
            elif downstream:
                put("NF", downstream - i - 1)
            raw = [bam.encode_tag(k, v) for k, v in tags.items()]
            put("TL", lists.setdefault(tuple(x[:3] for x in raw), len(lists)))
            for x in raw:
                sizes, values = tag_streams.setdefault(x[:3], (bytearray(), bytearray()))
                sizes += codecs.itf8(len(x) - 3)
                values += x[3:]
            if not flags & _UNMAPPED:
                self._features(r, ops, seq, streams, put)
                put("MQ", 255 if r.get("mapq") is None else r["mapq"])
            elif seq:
                streams["BA"] += seq.encode()
            if qual:
                if len(qual) != length:
                    raise CramError("sequence and qualities differ in length")
                streams["QS"] += bytes(ord(c) - 33 for c in qual)
        return self._assembled(rows, ref_id, start, span, bases, streams, tag_streams, lists)

    def _features(self, r: dict, ops, seq: str | None, streams, put) -> None:
        name = self.header.references[r["ref_id"]][0] if r.get("ref_id") is not None else None
        reference = self.references.bases(name) if self.references and name else None
        found, read, ref = [], 1, r.get("pos") or 1
        for n, k in ops:
            if k in "M=X":
                if seq:
                    found += self._bases(seq[read - 1 : read - 1 + n], read, ref, reference)
                read, ref = read + n, ref + n
            elif k in "IS":
                found.append((read, k, (seq[read - 1 : read - 1 + n] if seq else "N" * n).encode()))
                read += n
            else:
                found.append((read, k, n))
                ref += n if k in "DN" else 0
        put("FN", len(found))
        last = 0
        for at, code, value in found:
            streams["FC"] += code.encode()
            put("FP", at - last)
            last = at
            if code in "DNPH":
                put({"D": "DL", "N": "RS", "P": "PD", "H": "HC"}[code], value)
            elif code == "X":
                streams["BS"].append(value)
            elif code == "B":
                streams["BA"] += value
                quality = r.get("quality")
                streams["QS"].append(ord(quality[at - 1]) - 33 if quality else 255)
            else:
                series = {"I": "IN", "S": "SC", "b": "BB"}[code]
                streams[series] += codecs.itf8(len(value)) + value

    def _bases(self, piece: str, read: int, ref: int, reference: str | None) -> list:
        """Differences of a stretch of aligned bases from the reference; the bases themselves where there is none."""
        if reference is None or not self.references:
            return [(read, "b", piece.encode())]
        out = []
        other = reference[ref - 1 : ref - 1 + len(piece)].upper()
        codes = {(base, v): code for (base, code), v in substitution_table(PLAIN_SUBSTITUTIONS).items()}
        for k, base in enumerate(piece):
            there = other[k] if k < len(other) else "N"
            there = there if there in _BASES else "N"
            if base != there or k >= len(other) or other[k] not in _BASES:
                out.append((read + k, "X", codes[there, base]) if (there, base) in codes else (read + k, "B", base.encode()))
        return out

    def _assembled(self, rows, ref_id, start, span, bases, streams, tag_streams, lists) -> bytes:
        series = {k: (bits.ArrayStop(0, i + 1) if k == "RN" else bits.ArrayLen(bits.External(i + 1), bits.External(i + 1)) if k in _ARRAYS else bits.External(i + 1)) for i, k in enumerate(SERIES)}
        td = b"".join(b"".join(keys) + b"\0" for keys in lists)
        preserved = b"RN\x01AP\x00RR" + bytes([1 if self.references else 0]) + b"SM" + PLAIN_SUBSTITUTIONS + b"TD" + codecs.itf8(len(td)) + td
        used = [k for k in SERIES if k not in ("RI",) or ref_id == _MULTIPLE]
        coded = b"".join(k.encode() + series[k].write() for k in used)
        number = lambda key: key[0] << 16 | key[1] << 8 | key[2]
        tagged = b"".join(codecs.itf8(number(k)) + bits.ArrayLen(bits.External(number(k)), bits.External(number(k) | 1 << 24)).write() for k in tag_streams)
        maps = [codecs.itf8(5) + preserved, codecs.itf8(len(used)) + coded, codecs.itf8(len(tag_streams)) + tagged]
        compression = block_bytes(COMPRESSION_HEADER, 0, b"".join(codecs.itf8(len(m)) + m for m in maps))
        external = [(i + 1, bytes(streams[k])) for i, k in enumerate(SERIES) if streams[k]]
        external += [x for k, (sizes, values) in tag_streams.items() for x in ((number(k), bytes(sizes)), (number(k) | 1 << 24, bytes(values)))]
        embedded, md5 = -1, b"\0" * 16
        if self.references and ref_id >= 0 and span:
            own = (self.references.bases(self.header.references[ref_id][0]) or "")[start - 1 : start - 1 + span].upper()
            md5 = digest(own)
            if self.embed:
                embedded = len(SERIES) + 1
                external.append((embedded, own.encode()))
        blocks = [block_bytes(CORE, 0, b"")] + [block_bytes(EXTERNAL, k, v, self.method) for k, v in external]
        head = codecs.itf8(ref_id) + codecs.itf8(start) + codecs.itf8(span) + codecs.itf8(len(rows)) + bits.ltf8(self.counter)
        head += codecs.itf8(len(blocks)) + bits.int_array([k for k, _ in external]) + codecs.itf8(embedded) + md5
        body = compression + block_bytes(SLICE_HEADER, 0, head) + b"".join(blocks)
        out = container_bytes(ContainerHeader(0, ref_id, start, span, len(rows), self.counter, bases, len(blocks) + 2, [len(compression)]), body)
        self.counter += len(rows)
        return out


def _last(r: dict) -> int:
    """Last position; an unmapped read has its place only, as its operations aren't kept."""
    covered = 0 if r["flags"] & _UNMAPPED else sum(int(n) for n, _ in re.findall(r"(\d+)([MDN=X])", r.get("cigar") or ""))
    return (r.get("pos") or 0) + max(1, covered) - 1


def _links(rows: Sequence[dict], ends: Sequence[int]) -> dict[int, int | None]:
    """For two segments of a name whose mate fields say what can be computed from each other: the first's mate; None for the second."""

    @dataclass
    class Segment:
        flags: int
        ref: int | None
        pos: int
        end: int

    by_name: dict[str, list[int]] = {}
    for i, r in enumerate(rows):
        if r.get("name") and r["flags"] & _PAIRED and not r["flags"] & _SECONDARY:
            by_name.setdefault(r["name"], []).append(i)
    out: dict[int, int | None] = {}
    for found in by_name.values():
        if len(found) != 2:
            continue
        pair = [Segment(rows[i]["flags"], rows[i].get("ref_id"), rows[i].get("pos") or 0, ends[i]) for i in found]
        lengths = template_lengths(pair)

        def told(i: int, j: int, n: int) -> bool:
            r, m = rows[i], rows[j]
            flags = (_MATE_REVERSE if m["flags"] & _REVERSE else 0) | (_MATE_UNMAPPED if m["flags"] & _UNMAPPED else 0)
            same = (r.get("mate_ref_id"), r.get("mate_pos"), r.get("tlen") or 0) == (m.get("ref_id"), m.get("pos"), n)
            return same and r["flags"] & (_MATE_REVERSE | _MATE_UNMAPPED) == flags

        if told(*found, lengths[0]) and told(*found[::-1], lengths[1]):
            out[found[0]], out[found[1]] = found[1], None
    return out


def _cuts(rows, records: int) -> list[int]:
    """Where containers end in rows: after so many, or after a tenth where the reference changes, so that slices of one need none for each record."""
    import pyarrow as pa
    import pyarrow.compute as pc

    refs = pc.fill_null(rows.column("ref_id").cast(pa.int64()), _UNPLACED).to_numpy(zero_copy_only=False) if "ref_id" in rows.schema.names else np.full(rows.num_rows, _UNPLACED)
    changes, out, at = np.flatnonzero(refs[1:] != refs[:-1]) + 1, [], 0
    while True:
        k = int(np.searchsorted(changes, at + max(1, records // 10)))
        cut = min(at + records, int(changes[k]) if k < len(changes) else at + records)
        if cut >= rows.num_rows:
            return out
        out.append(cut)
        at = cut


def write_cram(
    df: DataFrame, folder: str, header: bam.Header, reference: Sequence[str] = (), embed: bool = False, method: str = "gzip", records: int = RECORDS
) -> list[str]:
    """One whole CRAM 3.0 file a partition, in the rows' order; tags are map<tag, TYPE:VALUE>. Returns the paths.

    With ``reference``, FASTA files, bases are kept as differences from it, and
    ``embed`` puts what slices of one reference cover into them. Without, bases
    are kept as they are and the files can be read by themselves. Operations =
    and X become M, as the format doesn't tell them apart.
    """

    def body(batches) -> Iterable[bytes]:
        import pyarrow as pa

        writer = _Writer(header, References(reference) if reference else None, embed, method)
        yield writer.start()
        held = None
        for b in batches:
            held = b if held is None else pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0] if b.num_rows else held
            at, cuts = 0, _cuts(held, records)
            for cut in cuts:
                yield writer.batch(held.slice(at, cut - at))
                at = cut
            held = held.slice(at)
        if held is not None and held.num_rows:
            yield writer.batch(held)
        yield end_container()

    return sinks.write_parts(df, folder, "cram", body)


# The source


@dataclass
class Part(InputPartition):
    path: str
    containers: list[int] | None = None  # offsets; None: all


class CramSource(DataSource):
    """``format("cram")``: alignment records of CRAM 3 files.

    Options: ``columns`` (comma list, as for BAM), ``reference`` (a FASTA path
    or a JSON list of them), ``regions`` (a region or a JSON list of them; with
    an index beside a file only the containers that may hold their records are
    read, each once however many of its slices match). A task takes a file;
    with an index beside it some ``split_bytes`` of containers.
    """

    @classmethod
    def name(cls) -> str:
        return "cram"

    def _wanted(self) -> list[str]:
        if "columns" not in self.options:
            return [c for c in bam.SCHEMA if c not in (*bam.PLACES, "bin")]
        wanted = [c.strip() for c in self.options["columns"].split(",")]
        if unknown := set(wanted) - set(bam.SCHEMA) | set(wanted) & {*bam.PLACES, "bin"}:
            raise ValueError(f"unknown columns: {sorted(unknown)}")
        return wanted

    def schema(self) -> str:
        return ", ".join(f"{k} {bam.SCHEMA[k]}" for k in self._wanted())

    def reader(self, schema):
        import json

        given = self.options.get("reference", "")
        paths = json.loads(given) if given.startswith("[") else [given] if given else []
        return _CramReader(self.options["path"], self._wanted(), paths, bgzf.regions_of(self.options), schema, int(self.options.get("split_bytes", 64 << 20)))


class _CramReader(DataSourceReader):
    def __init__(self, path: str, wanted: Sequence[str], reference: Sequence[str], regions: Sequence[Region], schema, split: int = 64 << 20):
        self.path, self.wanted, self.reference, self.regions, self.fields, self.split = path, list(wanted), list(reference), list(regions), schema, split

    def partitions(self):
        out = []
        for path, _ in files.list_files(self.path):
            if not path.endswith(".cram"):
                continue
            rows = read_index_rows(path)
            if rows is None:
                out.append(Part(path))
                continue
            names = [n for n, _ in Containers(files.open_file(path)).sam_header().references]
            wanted = sorted({r[3] for r in rows if not self.regions or any(row_meets(r, g, names) for g in self.regions)})
            group: list[int] = []
            for offset in wanted:
                if group and offset - group[0] >= self.split:
                    out.append(Part(path, group))
                    group = []
                group.append(offset)
            if group:
                out.append(Part(path, group))
        return out or [Part("", [])]

    def read(self, part: Part) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.fields)
        for got in self._slices(part):
            if isinstance(got, dict):
                yield pa.RecordBatch.from_arrays([got[f.name].cast(f.type) for f in schema], schema=schema)
            elif got:
                yield self._batch(pa, schema, got)

    def _batch(self, pa, schema, rows):
        got = dict(zip(self.wanted, zip(*rows, strict=True), strict=True))
        return pa.RecordBatch.from_arrays([pa.array(got[f.name], type=f.type) for f in schema], schema=schema)

    def _records(self, part: Part) -> Iterator[tuple]:
        for got in self._slices(part):
            yield from zip(*(got[c].to_pylist() for c in self.wanted), strict=True) if isinstance(got, dict) else got

    def _slices(self, part: Part) -> Iterator[dict | list[tuple]]:
        """A slice's wanted records as Arrow columns, or as rows where it takes a step for each."""
        import pyarrow as pa

        if not part.path:
            return
        containers = Containers(files.open_file(part.path))
        header, references = containers.sam_header(), References(self.reference)
        groups, ids = read_groups(header), {n: i for i, (n, _) in enumerate(header.references)}
        regions = [(ids[g.name], g.start or 1, g.end or 1 << 62) for g in self.regions if g.name in ids]
        every = containers if part.containers is None else ((o, *containers.header_at(o)) for o in part.containers)
        for _, head, at in every:
            if self.regions and head.ref_id not in (_MULTIPLE, *(i for i, _, _ in regions)):
                continue
            for compression, slice_, blocks, _, _ in slices_of(containers.blocks(head, at)):
                got = slice_columns(compression, slice_, blocks, header, references, groups, set(self.wanted), bool(self.regions))
                if got is not None:
                    if self.regions:
                        ref, pos, end = got.pop("_ref"), got.pop("_pos"), got.pop("_end")
                        met = np.zeros(len(ref), bool)
                        for i, s, e in regions:
                            met |= (ref == i) & (pos > 0) & (pos <= e) & (np.maximum(end, pos) >= s)
                        got = {k: v.filter(pa.array(met)) for k, v in got.items()}
                    yield got
                    continue
                records = read_slice(compression, slice_, blocks, header, references, set(self.wanted))
                yield [row(r, header, groups, self.wanted) for r in records if not self.regions or any(r.ref == i and 0 < r.pos <= e and max(r.end, r.pos) >= s for i, s, e in regions)]


# Index


def index_rows(path: str) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(reference, start, span, container's offset, slice's place in it, slice's size): a row a slice, or for each reference of one with several."""
    containers = Containers(files.open_file(path))
    header = containers.sam_header()
    for offset, head, at in containers:
        for compression, s, blocks, place, size in slices_of(containers.blocks(head, at)):
            if s.ref_id != _MULTIPLE:
                yield s.ref_id, s.start, s.span, offset, place, size
                continue
            reach: dict[int, tuple[int, int]] = {}
            got = slice_columns(compression, s, blocks, header, References(), [], set(), True)
            if got is None:
                records = read_slice(compression, s, blocks, header, References(), {"pos", "cigar"})
                got = {"_ref": np.array([r.ref for r in records]), "_pos": np.array([r.pos for r in records]), "_end": np.array([r.end for r in records])}
            for r in np.unique(got["_ref"]).tolist():
                here = got["_ref"] == r
                reach[r] = int(got["_pos"][here].min()), int(got["_end"][here].max())
            for ref, (low, high) in sorted(reach.items(), key=lambda x: (x[0] < 0, x[0])):
                yield (ref, low, high - low + 1, offset, place, size) if ref >= 0 else (ref, 0, 0, offset, place, size)


def write_indexes(spark: SparkSession, path: str) -> DataFrame:
    """Write an index beside each CRAM file, a task a file; (path, ref_id, start, span, offset, landmark, slice_length) of all rows."""
    listed = [(p,) for p, _ in files.list_files(path) if p.endswith(".cram")]

    def run(batches):
        import gzip
        import uuid

        import pyarrow as pa

        for b in batches:
            for p in b.column(0).to_pylist():
                rows = list(index_rows(p))
                system, inner = files.filesystem(p)
                hidden = f"{inner.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}"
                with system.open_output_stream(hidden, compression=None) as out:
                    out.write(gzip.compress("".join("\t".join(map(str, r)) + "\n" for r in rows).encode(), mtime=0))
                system.move(hidden, f"{inner}.crai")
                columns = list(zip(*rows, strict=True)) or [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array([p] * len(rows), pa.string()), *[pa.array(c, pa.int64()) for c in columns]], names=_INDEX_COLUMNS)

    fields_ = ", ".join(f"{c} {'string' if c == 'path' else 'bigint'}" for c in _INDEX_COLUMNS)
    return files.staged(spark.createDataFrame(listed, "path string").repartition(max(1, len(listed))).mapInArrow(run, fields_))


_INDEX_COLUMNS = ["path", "ref_id", "start", "span", "offset", "landmark", "slice_length"]


def read_index_rows(path: str) -> list[tuple[int, ...]] | None:
    import gzip

    try:
        file = files.open_file(f"{path}.crai")
    except FileNotFoundError:
        return None
    return [tuple(map(int, x.split("\t"))) for x in gzip.decompress(file.read_at(file.size(), 0)).decode().splitlines()]


def row_meets(r: Sequence[int], region: Region, names: Sequence[str]) -> bool:
    """Whether an index row's slice may hold records of a region; without a start or a span only if the region has no bounds."""
    if region.name not in names or r[0] != names.index(region.name):
        return False
    if region.start is None and region.end is None:
        return True
    return r[1] > 0 and r[2] > 0 and r[1] <= (region.end or coords.MAX_POSITION) and r[1] + r[2] - 1 >= (region.start or 1)

