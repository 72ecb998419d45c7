"""Binary variant files: typed values, dictionaries, decoding, encoding, and a data source."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader

from . import bgzf, files, indexes, sinks

MAGIC = b"BCF\x02"
SCHEMA = {
    "chrom": "string", "pos": "bigint", "ids": "array<string>", "ref": "string", "alts": "array<string>", "qual": "float", "filters": "array<string>",
    "info": "map<string,string>", "samples": "array<map<string,string>>",
}
# Widths and sentinels by type code.
WIDTHS = {1: ("b", 1), 2: ("h", 2), 3: ("i", 4), 5: ("f", 4), 7: ("c", 1)}
MISSING_FLOAT = 0x7F800001
END_FLOAT = 0x7F800002
RESERVED = 8


class BcfError(ValueError):
    """A record that doesn't hold together."""


def string_map(header_lines: Sequence[str]) -> dict[str, int]:
    """Names of filters and INFO and FORMAT fields to ids: PASS is 0, IDX= decides, gaps stay gaps."""
    out, following = {"PASS": 0}, 1
    for line in header_lines:
        m = re.match(r"##(FILTER|INFO|FORMAT)=<ID=([^,>]+)", line)
        if m and m[2] not in out:
            idx = re.search(r",IDX=(\d+)", line)
            out[m[2]] = int(idx[1]) if idx else following
            following = max(following, out[m[2]] + 1)
    return out


def contig_map(header_lines: Sequence[str]) -> dict[str, int]:
    out, following = {}, 0
    for line in header_lines:
        m = re.match(r"##contig=<ID=([^,>]+)", line)
        if m and m[1] not in out:
            idx = re.search(r",IDX=(\d+)", line)
            out[m[1]] = int(idx[1]) if idx else following
            following = max(following, out[m[1]] + 1)
    return out


@dataclass
class Header:
    lines: list[str]

    def __post_init__(self):
        self.strings = {i: n for n, i in string_map(self.lines).items()}
        self.contigs = {i: n for n, i in contig_map(self.lines).items()}
        last = next((x for x in self.lines if x.startswith("#CHROM")), "")
        self.samples = last.split("\t")[9:]


def read_typed(data: bytes, at: int):
    """(type code, values as stored, next place). Values keep sentinels; strings are bytes."""
    kind, n = data[at] & 15, data[at] >> 4
    at += 1
    if n == 15:
        _, (n,), at = read_typed(data, at)
    if kind == 0:
        return 0, (), at
    if kind == 7:
        return 7, data[at : at + n], at + n
    if kind not in WIDTHS:
        raise BcfError(f"unknown value type {kind}")
    code, width = WIDTHS[kind]
    if kind == 5:
        code = "I"  # bits, as sentinels are told by them
    return kind, struct.unpack_from(f"<{n}{code}", data, at), at + n * width


def meaning(kind: int, raw: int):
    """(state, value) of a stored number: 'value', 'missing', 'end' or 'reserved', by the width it is stored in."""
    if kind == 5:
        if raw == MISSING_FLOAT:
            return "missing", None
        if raw == END_FLOAT:
            return "end", None
        if MISSING_FLOAT < raw <= MISSING_FLOAT + RESERVED:
            return "reserved", None
        return "value", struct.unpack("<f", struct.pack("<I", raw))[0]
    low = -(1 << (8 * WIDTHS[kind][1] - 1))
    if raw == low:
        return "missing", None
    if raw == low + 1:
        return "end", None
    if raw < low + RESERVED:
        return "reserved", None
    return "value", raw


def values(kind: int, raw) -> list:
    """Numbers up to the end marker, None for missing; a reserved one is an error."""
    out = []
    for x in raw:
        state, v = meaning(kind, x)
        if state == "end":
            break
        if state == "reserved":
            raise BcfError("reserved value")
        out.append(v)
    return out


def _text(kind: int, raw) -> str | None:
    if kind == 0:
        return None
    if kind == 7:
        s = bytes(raw).split(b"\0")[0].decode()
        return s if s and s != "." else None
    got = values(kind, raw)
    if not got or (len(got) == 1 and got[0] is None):
        return None
    return ",".join("." if v is None else f"{v:g}" if kind == 5 else str(v) for v in got)


def genotype(raw: Sequence[int], kind: int = 1) -> str:
    """Genotype text of (allele + 1) << 1 | phased numbers up to the end marker."""
    out = ""
    for i, x in enumerate(raw):
        if meaning(kind, x)[0] == "end":
            break
        allele = (x >> 1) - 1
        out += ("" if i == 0 else "|" if x & 1 else "/") + ("." if x >> 1 == 0 else str(allele))
    return out


def decode(data: bytes, at: int, header: Header) -> tuple[tuple, int]:
    """(one record's columns, its size); its parts must fill its two sections."""
    shared, indiv = struct.unpack_from("<II", data, at)
    chrom, pos, _, qual_bits, n_info_allele, n_fmt_sample = struct.unpack_from("<iiiIII", data, at + 8)
    p, middle, end = at + 32, at + 8 + shared, at + 8 + shared + indiv
    _, raw, p = read_typed(data, p)
    ids = bytes(raw).rstrip(b"\0").decode() if raw else ""
    alleles = []
    for _ in range(n_info_allele >> 16):
        _, raw, p = read_typed(data, p)
        alleles.append(bytes(raw).decode())
    kind, raw, p = read_typed(data, p)
    filters = [header.strings[v] for v in values(kind, raw)] if kind else []
    info = []
    for _ in range(n_info_allele & 0xFFFF):
        k, (key,), p = read_typed(data, p)
        kind, raw, p = read_typed(data, p)
        info.append((header.strings[key], _text(kind, raw)))
    if p != middle:
        raise BcfError("a record's shared fields don't fill their section")
    n_samples = n_fmt_sample & 0xFFFFFF
    samples: list[list[tuple[str, str | None]]] = [[] for _ in range(n_samples)]
    for _ in range(n_fmt_sample >> 24):
        k, (key,), p = read_typed(data, p)
        name = header.strings[key]
        kind, n = data[p] & 15, data[p] >> 4
        p += 1
        if n == 15:
            _, (n,), p = read_typed(data, p)
        code, width = WIDTHS.get(kind, ("c", 1))
        for s in range(n_samples):
            piece = data[p : p + n * width]
            raw = piece if kind == 7 else struct.unpack(f"<{n}{'I' if kind == 5 else code}", piece)
            samples[s].append((name, genotype(raw, kind) if name == "GT" and kind in (1, 2, 3) else _text(kind, raw)))
            p += n * width
    if p != end:
        raise BcfError("a record's sample fields don't fill their section")
    state, qual = meaning(5, qual_bits)
    row = (
        header.contigs[chrom], pos + 1 if pos >= 0 else None, [x for x in ids.split(";") if x and x != "."], alleles[0] if alleles else None, alleles[1:],
        qual if state == "value" else None, filters, info, samples,
    )
    return row, 8 + shared + indiv


def plausible(data: bytes, at: int, samples: int, contigs: int) -> bool:
    """Whether a record may begin at ``at``: its number of samples, contig and sizes agree."""
    if at + 32 > len(data):
        return False
    shared, indiv, chrom, pos, rlen, _, n_info_allele, n_fmt_sample = struct.unpack_from("<IIiiiIII", data, at)
    if shared < 24 or not 0 <= chrom < contigs or pos < -1 or rlen < 0 or n_fmt_sample & 0xFFFFFF != samples:
        return False
    return n_info_allele >> 16 > 0 and (indiv > 0) == (n_fmt_sample >> 24 > 0)


def record_starts(data: bytes, samples: int, header: Header) -> tuple[list[int], int]:
    """(places where records begin, places that the sieve let through): a candidate counts if it decodes whole and
    the next record, or the end, follows it."""
    passed = [at for at in range(max(0, len(data) - 31)) if plausible(data, at, samples, len(header.contigs))]
    ends: dict[int, int] = {}
    for at in passed:
        try:
            _, size = decode(data, at, header)
        except (BcfError, KeyError, IndexError, struct.error, UnicodeDecodeError, ValueError):
            continue
        ends[at] = at + size
    # tiles from the end: a chain of records must run through to it
    good = {len(data)}
    for at in sorted(ends, reverse=True):
        if ends[at] in good:
            good.add(at)
    return sorted(good - {len(data)}), len(passed)


def write_typed(kind: int, body: bytes, n: int) -> bytes:
    if n < 15:
        return bytes([n << 4 | kind]) + body
    size = 1 if n < 128 else 2 if n < 32768 else 3
    return bytes([15 << 4 | kind, 1 << 4 | size]) + struct.pack("<" + WIDTHS[size][0], n) + body


def write_string(s: str) -> bytes:
    return write_typed(7, s.encode(), len(s.encode()))


def _width(numbers: Sequence[int | None]) -> int:
    known = [x for x in numbers if x is not None] or [0]
    return next(k for k in (1, 2, 3) if all(-(1 << (8 * WIDTHS[k][1] - 1)) + RESERVED <= x < 1 << (8 * WIDTHS[k][1] - 1) for x in known))


def write_ints(numbers: Sequence[int | None], pad: int | None = None) -> bytes:
    kind = _width(numbers)
    low = -(1 << (8 * WIDTHS[kind][1] - 1))
    stored = [low if x is None else x for x in numbers] + [low + 1] * max(0, (pad or 0) - len(numbers))
    return write_typed(kind, struct.pack(f"<{len(stored)}{WIDTHS[kind][0]}", *stored), len(stored))


def encode(row: dict, strings: dict[str, int], contigs: dict[str, int], kinds: dict[str, str]) -> bytes:
    """One record; ``kinds`` gives INFO and FORMAT fields' types (Integer, Float, String, Flag; GT is told by its name)."""

    def info_value(name: str, text: str | None) -> bytes:
        if kinds.get(name) == "Flag" or text is None:
            return b"\0"
        if kinds.get(name) == "Integer":
            return write_ints([None if x == "." else int(x) for x in text.split(",")])
        if kinds.get(name) == "Float":
            items = text.split(",")
            return write_typed(5, b"".join(struct.pack("<I", MISSING_FLOAT) if x == "." else struct.pack("<f", float(x)) for x in items), len(items))
        return write_string(text)

    info = list((dict(row.get("info") or {})).items())
    alleles = [row["ref"], *(row.get("alts") or [])]
    shared = struct.pack(
        "<iiiIII", contigs[row["chrom"]], (row.get("pos") or 0) - 1, len(row["ref"]),
        MISSING_FLOAT if row.get("qual") is None else struct.unpack("<I", struct.pack("<f", row["qual"]))[0],
        len(alleles) << 16 | len(info), (1 << 24 | len(row["gts"])) if row.get("gts") else 0,
    )
    shared += write_string(";".join(row.get("ids") or []) or ".") + b"".join(map(write_string, alleles))
    shared += write_ints([strings[f] for f in row["filters"]]) if row.get("filters") else b"\0"
    for name, text in info:
        shared += write_ints([strings[name]]) + info_value(name, text)
    indiv = b""
    if row.get("gts"):
        packed = [[(0 if a == "." else int(a) + 1) << 1 | (sep == "|") for sep, a in re.findall(r"([|/]?)(\d+|\.)", gt)] for gt in row["gts"]]
        n = max(map(len, packed))
        body = b"".join(struct.pack(f"<{n}b", *(g + [-127] * (n - len(g)))) for g in packed)
        indiv = write_ints([strings["GT"]]) + bytes([n << 4 | 1]) + body
    return struct.pack("<II", len(shared), len(indiv)) + shared + indiv


def header_bytes(lines: Sequence[str]) -> bytes:
    text = ("\n".join(lines) + "\n").encode() + b"\0"
    return MAGIC + b"\x02" + struct.pack("<I", len(text)) + text


def write_bcf(df: DataFrame, folder: str, lines: Sequence[str]) -> list[str]:
    """One whole BCF file a partition; returns the paths."""
    strings, contigs = string_map(lines), contig_map(lines)
    kinds = {m[1]: m[2] for x in lines if (m := re.match(r"##(?:INFO|FORMAT)=<ID=([^,]+),.*Type=(\w+)", x))}

    def records_of(batch):
        return (encode(row, strings, contigs, kinds) for row in batch.to_pylist())

    return sinks.write_blocks(df, folder, "bcf", header_bytes(lines), records_of)


#: Where a record stands: its file, its virtual offset and the next one's, its contig's number.
PLACES = {"path": "string", "voffset": "bigint", "vend": "bigint", "ref_id": "int"}


class BcfSource(DataSource):
    """``format("bcf")``: variant records of binary files.

    A file is split at blocks, some ``split_bytes`` a task (64 MiB). A task
    finds the first record in its blocks as the first place from which a chain
    of plausible records runs through ``PROOF`` bytes, reading on as long as
    none is found, and takes the records that begin in its blocks. Options: ``places`` (true: also ``path``, ``voffset``, ``vend`` and
    ``ref_id``), ``regions`` (a region or a JSON list of them, for files with
    an index beside them: only the blocks that may hold their records are
    read; records that share a block or bin with a region come too).
    """

    @classmethod
    def name(cls) -> str:
        return "bcf"

    def schema(self) -> str:
        fields = SCHEMA | (PLACES if self.options.get("places") == "true" else {})
        return ", ".join(f"{k} {v}" for k, v in fields.items())

    def reader(self, schema):
        return _BcfReader(self.options["path"], schema, bgzf.regions_of(self.options), int(self.options.get("split_bytes", 64 << 20)))


class _BcfReader(DataSourceReader):
    #: Compressed bytes of an index's chunks that one task reads, about.
    CHUNK_BYTES = 16 << 20

    def __init__(self, path: str, schema, regions=(), split: int = 64 << 20):
        self.path, self.fields, self.regions, self.split = path, schema, list(regions), split

    def partitions(self):
        listed = [(p, n) for p, n in files.list_files(self.path) if not p.endswith(indexes.SUFFIXES)]
        if not self.regions:
            return [bgzf.FileRange(p, at, min(at + self.split, n)) for p, n in listed for at in range(0, max(n, 1), self.split)]
        out = []
        for p, n in listed:
            header, _ = read_header(files.open_file(p))
            contigs = [header.contigs.get(i, "") for i in range(max(header.contigs, default=-1) + 1)]
            out += [bgzf.FileRange(p, 0, n, c) for c in bgzf.by_size(indexes.beside(p).chunks_of(self.regions, contigs), self.CHUNK_BYTES)]
        return out or [bgzf.FileRange(self.path, 0, 0, [])]

    def read(self, part: bgzf.FileRange) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, rows = to_arrow_schema(self.fields), []
        places = "voffset" in schema.names
        for row, place in records(part.path, part.chunks, part.begin, part.end):
            rows.append(row + place if places else row)
            if len(rows) == 4096:
                yield _batch(pa, schema, rows)
                rows = []
        if rows:
            yield _batch(pa, schema, rows)


def _batch(pa, schema, rows):
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def read_header(file) -> tuple[Header, bgzf.Contents]:
    """(header, contents from the first record on)."""
    c = bgzf.Contents(file)
    while c.more():
        if c.data[: len(MAGIC)] != MAGIC[: len(c.data)]:
            raise BcfError("no BCF header")
        if len(c.data) >= 9 and len(c.data) >= 9 + (size := struct.unpack_from("<I", c.data, 5)[0]):
            header = Header(bytes(c.data[9 : 9 + size]).rstrip(b"\0").decode().splitlines())
            c.drop(9 + size)
            return header, c
    raise BcfError("no BCF header")


#: Bytes that a chain of records must run through where a task begins within a file.
PROOF = 1 << 17


def records(path: str, chunks: Sequence[tuple[int, int]] | None = None, begin: int = 0, end: int | None = None) -> Iterator[tuple[tuple, tuple]]:
    """(a record's columns, its places): of ranges of virtual offsets, or of the blocks that begin in a range of the file."""
    if chunks is not None and not chunks:
        return
    file = files.open_file(path)
    header, contents = read_header(file)
    if chunks is not None:
        for low, high in chunks:
            c = bgzf.Contents(file, low >> 16)
            if c.more():
                yield from _walk(path, header, c, low & 0xFFFF, high)
        return
    last = None if end is None or end >= file.size() else end << 16
    if not begin:
        yield from _walk(path, header, contents, 0, last)
        return
    first = bgzf.find_block(file, begin)
    if first is None or first >= end:
        return
    if first << 16 <= contents.virtual(0):
        # the header ends behind where this task's blocks begin
        if contents.virtual(0) >> 16 < end:
            yield from _walk(path, header, contents, 0, last)
        return
    c, at, need, done = bgzf.Contents(file, first), None, PROOF, False
    while at is None:
        done = done or not c.more()
        if not done and len(c.data) < need:
            continue
        ends = c.held_before(end)
        at, settled = _first_record(bytes(c.data), ends, header, done)
        if at is None:
            c.drop(settled)
            if done or c.held_before(end) <= 0:
                return
            need = len(c.data) + PROOF
    yield from _walk(path, header, c, at, last)


def _first_record(data: bytes, ends: int, header: Header, done: bool) -> tuple[int | None, int]:
    """(first place before ``ends`` where a record begins, or None; up to where places are settled)."""
    contigs, samples = max(header.contigs, default=-1) + 1, len(header.samples)
    for start in range(ends):
        if not done and len(data) - start < PROOF:
            return None, start
        at, n = start, 0
        while at + 32 <= len(data) and plausible(data, at, samples, contigs):
            shared, indiv = struct.unpack_from("<II", data, at)
            at, n = at + 8 + shared + indiv, n + 1
        if done:
            if n and at == len(data):
                return start, start
        elif at + 32 > len(data):  # what is left is too short to tell
            return (start if n > 1 else None), start
    return None, ends


def _walk(path: str, header: Header, c: bgzf.Contents, at: int, end: int | None) -> Iterator[tuple[tuple, tuple]]:
    """Records from a place on that begin before a virtual offset."""
    while True:
        over = False
        while at + 8 <= len(c.data) and not over:
            shared, indiv = struct.unpack_from("<II", c.data, at)
            size = 8 + shared + indiv
            begin = c.virtual(at)
            over = end is not None and begin >= end
            if over or at + size > len(c.data):
                break
            data = bytes(c.data[at : at + size])
            row, _ = decode(data, 0, header)
            yield row, (path, begin, c.virtual(at + size), struct.unpack_from("<i", data, 8)[0])
            at += size
        if over:
            return
        c.drop(at)
        at = 0
        if not c.data and end is not None and c.after << 16 >= end:
            return
        if not c.more():
            if c.data:
                raise BcfError("file ends within a record")
            return


def indexable(spark: SparkSession, path: str) -> DataFrame:
    """What :func:`indexes.build` takes, of BCF files."""
    from pyspark.sql import functions as F

    listed = [p for p, _ in files.list_files(path) if not p.endswith(indexes.SUFFIXES)]
    n_refs = max((max(read_header(files.open_file(p))[0].contigs, default=-1) + 1 for p in listed), default=0)
    rows = spark.read.format("bcf").option("places", "true").load(path)
    return rows.select("path", "ref_id", "pos", last_position().alias("aend"), F.lit(False).alias("unmapped"), "voffset", "vend", F.lit(n_refs).alias("n_refs"))


def last_position():
    """Last position of a record of the source, by INFO/END if it has one."""
    from pyspark.sql import functions as F

    end = F.try_element_at("info", F.lit("END")).cast("bigint")
    return F.coalesce(end, F.coalesce("pos", F.lit(1).cast("bigint")) + F.length("ref") - 1)
