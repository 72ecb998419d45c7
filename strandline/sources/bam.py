"""Binary alignment files: decoding, encoding, and a data source that reads them as DataFrames."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.coords import Region
from ..functions.records import BASE_CODES, CIGAR_CODES
from . import bgzf, files, indexes, sinks
from .columns import binaries, cigar_ops, flat, gathered, mapped, offsets, side_by_side, strings, summed

MAGIC = b"BAM\x01"
CORE = struct.Struct("<iiBBHHHiiii")
#: Column order; ``columns`` of the source picks from it.
SCHEMA = {
    "name": "string", "flags": "int", "ref_id": "int", "ref_name": "string", "pos": "bigint", "mapq": "int", "cigar": "string", "mate_ref_id": "int",
    "mate_pos": "bigint", "tlen": "int", "sequence": "string", "quality": "string", "tags": "map<string,string>", "bin": "int",
    "voffset": "bigint", "vend": "bigint", "path": "string",
}
#: Compressed bytes of a file that a task takes.
SPLIT_BYTES = 64 << 20
#: Inflated bytes of records that are decoded at once, about.
RUN_BYTES = 1 << 20
#: Where a record stands in its file, and where its file is: only if asked for.
PLACES = ("voffset", "vend", "path")
#: Columns that stand at fixed places of a record.
FIXED = ("flags", "ref_id", "ref_name", "pos", "mapq", "mate_ref_id", "mate_pos", "tlen", "bin")
_CORE_TYPE = np.dtype(
    [("size", "<i4"), ("ref", "<i4"), ("pos", "<i4"), ("l_name", "u1"), ("mapq", "u1"), ("bin", "<u2"), ("n_ops", "<u2"), ("flags", "<u2"), ("bases", "<i4"), ("mate", "<i4"), ("mate_pos", "<i4"), ("tlen", "<i4")]
)
_PAIRS = np.array([a + b for a in BASE_CODES for b in BASE_CODES])
_PHRED = bytes(min(q + 33, 255) for q in range(256))
_INTEGERS = {"c": "b", "C": "B", "s": "h", "S": "H", "i": "i", "I": "I"}


class BamError(ValueError):
    """A record that doesn't hold together."""


@dataclass
class Header:
    text: str
    references: list[tuple[str, int]]


def parse_header(data: bytes) -> tuple[Header, int] | None:
    """(header, its size); None if ``data`` ends before it does."""
    if len(data) >= 4 and data[:4] != MAGIC:
        raise BamError("no BAM header")
    try:
        n = struct.unpack_from("<i", data, 4)[0]
        text = data[8 : 8 + n]
        count = struct.unpack_from("<i", data, 8 + n)[0]
        at, refs = 12 + n, []
        for _ in range(count):
            k = struct.unpack_from("<i", data, at)[0]
            name = data[at + 4 : at + 3 + k].decode()
            refs.append((name, struct.unpack_from("<i", data, at + 4 + k)[0]))
            at += 8 + k
    except struct.error:
        return None
    return (Header(text.rstrip(b"\0").decode(), refs), at) if at <= len(data) else None


def header_bytes(header: Header) -> bytes:
    text = header.text.encode()
    refs = b"".join(struct.pack("<i", len(n) + 1) + n.encode() + b"\0" + struct.pack("<i", size) for n, size in header.references)
    return MAGIC + struct.pack("<i", len(text)) + text + struct.pack("<i", len(header.references)) + refs


def parse_tags(data: bytes) -> dict[str, tuple[str, object]]:
    """tag: (type, value); the first of a repeated tag."""
    out: dict[str, tuple[str, object]] = {}
    at = 0
    while at < len(data):
        tag, kind = data[at : at + 2].decode(), chr(data[at + 2])
        at += 3
        if kind == "A":
            value, at = chr(data[at]), at + 1
        elif kind in _INTEGERS:
            value = struct.unpack_from("<" + _INTEGERS[kind], data, at)[0]
            at += struct.calcsize(_INTEGERS[kind])
        elif kind == "f":
            value, at = struct.unpack_from("<f", data, at)[0], at + 4
        elif kind in "ZH":
            end = data.index(b"\0", at)
            value, at = data[at:end].decode(), end + 1
        elif kind == "B":
            sub, n = chr(data[at]), struct.unpack_from("<i", data, at + 1)[0]
            code = "f" if sub == "f" else _INTEGERS[sub]
            value = (sub, list(struct.unpack_from(f"<{n}{code}", data, at + 5)))
            at += 5 + n * struct.calcsize(code)
        else:
            raise BamError(f"unknown tag type {kind!r}")
        out.setdefault(tag, (kind, value))
    return out


def tag_text(kind: str, value) -> str:
    """TYPE:VALUE as in the text format: every integer is an i."""
    if kind == "B":
        sub, numbers = value
        return f"B:{sub}," + ",".join(f"{x:g}" if sub == "f" else str(x) for x in numbers)
    if kind == "f":
        return f"f:{value:g}"
    return f"{'i' if kind in _INTEGERS else kind}:{value}"


def encode_tag(tag: str, text: str) -> bytes:
    kind, _, value = text.partition(":")
    head = tag.encode()
    if kind == "A":
        return head + b"A" + value.encode()
    if kind == "i":
        n = int(value)
        code = next(c for c, (lo, hi) in (("c", (-128, 127)), ("C", (0, 255)), ("s", (-(1 << 15), (1 << 15) - 1)), ("S", (0, 65535)), ("i", (-(1 << 31), (1 << 31) - 1)), ("I", (0, (1 << 32) - 1))) if lo <= n <= hi)
        return head + code.encode() + struct.pack("<" + _INTEGERS[code], n)
    if kind == "f":
        return head + b"f" + struct.pack("<f", float(value))
    if kind in ("Z", "H"):
        return head + kind.encode() + value.encode() + b"\0"
    if kind == "B":
        sub, *numbers = value.split(",")
        code = "f" if sub == "f" else _INTEGERS[sub]
        return head + b"B" + sub.encode() + struct.pack(f"<i{len(numbers)}{code}", len(numbers), *(float(x) if sub == "f" else int(x) for x in numbers))
    raise BamError(f"unknown tag type {kind!r}")


def record_size(data, at: int) -> int | None:
    """Size of the record at ``at`` with its length field, if its fixed part is there and its parts fit; else an error."""
    if at + 4 > len(data):
        return None
    n = struct.unpack_from("<i", data, at)[0]
    if n < 32:
        raise BamError(f"record of {n} bytes")
    return n + 4


def plausible(data: bytes, at: int, references: int) -> int | None:
    """Size of what may be a record at ``at``; None if it can't be one or too little of it is there to tell."""
    if at + 36 > len(data):
        return None
    n, ref, pos, name, _, _, ops, _, bases, mate, mate_pos, _ = struct.unpack_from("<iiiBBHHHiiii", data, at)
    fits = 32 + name + 4 * ops + (bases + 1) // 2 + bases if bases >= 0 else -1
    if n < 32 or name < 1 or bases < 0 or fits > n or not -1 <= ref < references or not -1 <= mate < references or pos < -1 or mate_pos < -1:
        return None
    end = at + 36 + name
    if end <= len(data) and (data[end - 1] != 0 or any(b < 33 or b > 126 for b in data[at + 36 : end - 1])):
        return None
    return n + 4


def _cigar(raw: tuple[int, ...]) -> str:
    return "".join(f"{x >> 4}{CIGAR_CODES[x & 15]}" for x in raw)


def decode(data: bytes, at: int, end: int, header: Header, columns: Sequence[str]) -> tuple:
    """One record's wanted columns."""
    ref, pos, l_name, mapq, bin_, n_ops, flags, bases, mate, mate_pos, tlen = CORE.unpack_from(data, at + 4)
    a = at + 36
    b = a + l_name
    c = b + 4 * n_ops
    d = c + (bases + 1) // 2
    e = d + bases
    if e > end:
        raise BamError("a record's parts exceed it")
    tags = cigar = None
    want = set(columns)
    if "cigar" in want or "tags" in want:
        ops = struct.unpack_from(f"<{n_ops}I", data, b)
        placeholder = n_ops == 2 and ops[0] == (bases << 4 | 4) and ops[1] & 15 == 3
        if "tags" in want or placeholder:
            tags = parse_tags(data[e:end])
        if placeholder:
            kind, value = tags.pop("CG", (None, None))
            if kind != "B" or value[0] != "I":
                raise BamError("long CIGAR without tag CG")
            ops = tuple(value[1])
        cigar = _cigar(ops) or None
    row = []
    for col in columns:
        if col == "name":
            name = data[a : b - 1].decode()
            row.append(None if name == "*" else name)
        elif col == "flags":
            row.append(flags)
        elif col == "ref_id":
            row.append(ref if ref >= 0 else None)
        elif col == "ref_name":
            row.append(header.references[ref][0] if ref >= 0 else None)
        elif col == "pos":
            row.append(pos + 1 if pos >= 0 else None)
        elif col == "mapq":
            row.append(mapq if mapq != 255 else None)
        elif col == "cigar":
            row.append(cigar)
        elif col == "mate_ref_id":
            row.append(mate if mate >= 0 else None)
        elif col == "mate_pos":
            row.append(mate_pos + 1 if mate_pos >= 0 else None)
        elif col == "tlen":
            row.append(tlen)
        elif col == "sequence":
            row.append("".join(_PAIRS[np.frombuffer(data, np.uint8, d - c, c)])[:bases] if bases else None)
        elif col == "quality":
            q = data[d:e]
            row.append(None if not bases or q == b"\xff" * bases else q.translate(_PHRED).decode("latin-1"))
        elif col == "tags":
            row.append([(k, tag_text(*v)) for k, v in tags.items()])
        else:
            row.append(bin_)
    return tuple(row)


def _bin(begin: int, end: int) -> int:
    for level in range(5, 0, -1):
        shift = 14 + 3 * (5 - level)
        if begin >> shift == end - 1 >> shift:
            return ((1 << 3 * level) - 1) // 7 + (begin >> shift)
    return 0


def encode(row: dict) -> bytes:
    """One record; a CIGAR of more than 65535 operations goes to tag CG."""
    ops = [int(n) << 4 | CIGAR_CODES.index(k) for n, k in re.findall(r"(\d+)([MIDNSHP=X])", row.get("cigar") or "")]
    span = sum(x >> 4 for x in ops if CIGAR_CODES[x & 15] in "MDN=X")
    seq, qual = row.get("sequence") or "", row.get("quality")
    used = sum(x >> 4 for x in ops if CIGAR_CODES[x & 15] in "MIS=X")
    if ops and seq and used != len(seq):
        raise BamError("sequence and CIGAR differ in length")
    if qual is not None and len(qual) != len(seq):
        raise BamError("sequence and qualities differ in length")
    tags = b"".join(encode_tag(k, v) for k, v in (row.get("tags") or {}).items())
    if len(ops) > 65535:
        tags += b"CGBI" + struct.pack(f"<i{len(ops)}I", len(ops), *ops)
        ops = [len(seq) << 4 | 4, span << 4 | 3]
    codes = [BASE_CODES.find(c) if c in BASE_CODES else 15 for c in seq.upper()] + [0] * (len(seq) % 2)
    packed = bytes(x << 4 | y for x, y in zip(codes[::2], codes[1::2], strict=True))
    scores = bytes(ord(c) - 33 for c in qual) if qual is not None else b"\xff" * len(seq)
    name = (row.get("name") or "*").encode() + b"\0"
    none = lambda k: -1 if row.get(k) is None else row[k]
    pos = (row.get("pos") or 0) - 1
    core = CORE.pack(
        none("ref_id"), pos, len(name), 255 if row.get("mapq") is None else row["mapq"], _bin(max(pos, 0), max(pos, 0) + max(span, 1)) if pos >= 0 else 4680,
        len(ops), row["flags"], len(seq), none("mate_ref_id"), (row.get("mate_pos") or 0) - 1, row.get("tlen") or 0,
    )
    body = core + name + struct.pack(f"<{len(ops)}I", *ops) + packed + scores + tags
    return struct.pack("<i", len(body)) + body


_BASE_CODE = np.full(256, 15, np.uint8)
for _i, _c in enumerate(BASE_CODES):
    _BASE_CODE[ord(_c)] = _BASE_CODE[ord(_c.lower())] = _i
_SPANS, _USES = (np.isin(np.arange(16), [CIGAR_CODES.index(k) for k in kinds]) for kinds in ("MDN=X", "MIS=X"))


def encode_batch(batch) -> bytes:
    """The records of an Arrow batch one after another, as :func:`encode` makes them, without a step for each; odd ones are left to it."""
    quick = _encoded(batch)
    if quick is not None:
        return quick
    out = []
    for row in batch.to_pylist():
        if isinstance(row.get("tags"), list):
            row["tags"] = dict(row["tags"])
        out.append(encode(row))
    return b"".join(out)


def _encoded(batch) -> bytes | None:
    import pyarrow as pa
    import pyarrow.compute as pc

    n = batch.num_rows
    given = dict(zip(batch.schema.names, batch.columns, strict=True))
    texts = lambda c: given[c] if c in given else pa.nulls(n, pa.string())
    numbers = lambda c, missing: pc.fill_null(given[c].cast(pa.int64()), missing).to_numpy(zero_copy_only=False) if c in given else np.full(n, missing)
    ops = cigar_ops(pc.replace_with_mask(texts("cigar"), pc.fill_null(pc.equal(texts("cigar"), "*"), False), pa.scalar("", pa.string())))
    seq, seq_at = flat(texts("sequence"))
    qual, qual_at = flat(texts("quality"))
    if ops is None or (seq > 127).any() or (qual > 127).any() or (qual < 33).any() or given["flags"].null_count:
        return None
    n_ops, op_sizes, op_codes = ops
    length, scored = np.diff(seq_at), np.diff(qual_at)
    known = np.asarray(texts("quality").is_valid())
    span, used = (summed(op_sizes * of[op_codes], n_ops) for of in (_SPANS, _USES))
    if (n_ops > 65535).any() or (op_sizes >> 28).any() or ((n_ops > 0) & (length > 0) & (used != length)).any() or (known & (scored != length)).any():
        return None
    # bases in pairs, a last one alone with nothing
    pairs = (length + 1) // 2
    codes = np.zeros(2 * int(pairs.sum()), np.uint8)
    codes[np.repeat(2 * offsets(pairs)[:-1] - seq_at[:-1], length) + np.arange(len(seq))] = _BASE_CODE[seq]
    scores = np.full(int(length.sum()), 255, np.uint8)
    scores[np.repeat(known, length)] = qual - 33
    tags = given.get("tags")
    if tags is None or tags.null_count == n:
        tagged, tag_sizes = b"", np.zeros(n, np.int64)
    elif tags.items.null_count or tags.keys.null_count:
        return None
    else:
        at = np.asarray(tags.offsets)
        items = slice(int(at[0]), int(at[-1]))
        values = mapped(side_by_side(tags.keys.slice(items.start, items.stop - items.start), b"=", tags.items.slice(items.start, items.stop - items.start)), lambda x: encode_tag(*x.decode().split("=", 1)))
        if len(at) != n + 1 or tags.null_count:
            return None
        every, item_at = flat(values)
        tag_sizes = np.diff(item_at[at - at[0]])
        tagged = binaries(every, tag_sizes)
    name = side_by_side(pc.fill_null(pc.replace_with_mask(texts("name").cast(pa.string()), pc.fill_null(pc.equal(texts("name"), ""), False), pa.scalar("*")), "*"), b"\0")
    name_sizes = np.diff(flat(name)[1])
    begin = numbers("pos", 0) - 1
    first = np.maximum(begin, 0)
    last, number = first + np.maximum(span, 1) - 1, np.zeros(n, np.int64)
    for level in range(1, 6):
        shift = 14 + 3 * (5 - level)
        number = np.where(first >> shift == last >> shift, ((1 << 3 * level) - 1) // 7 + (first >> shift), number)
    core = np.zeros(n, _CORE_TYPE)
    values = {
        "size": 32 + name_sizes + 4 * n_ops + pairs + length + tag_sizes, "ref": numbers("ref_id", -1), "pos": begin, "l_name": name_sizes, "mapq": numbers("mapq", 255), "bin": np.where(begin >= 0, number, 4680),
        "n_ops": n_ops, "flags": numbers("flags", 0), "bases": length, "mate": numbers("mate_ref_id", -1), "mate_pos": numbers("mate_pos", 0) - 1, "tlen": numbers("tlen", 0),
    }
    for field, v in values.items():
        kind = np.iinfo(_CORE_TYPE[field])
        if (v < kind.min).any() or (v > kind.max).any():
            return None
        core[field] = v
    fixed = binaries(core.view(np.uint8), np.full(n, _CORE_TYPE.itemsize))
    cigars = binaries((op_sizes << 4 | op_codes).astype("<u4").view(np.uint8), 4 * n_ops)
    packed = binaries(codes[::2] << 4 | codes[1::2], pairs)
    return flat(side_by_side(fixed, name, cigars, packed, binaries(scores, length), tagged))[0].tobytes()


def fixed_columns(data: bytes, starts: np.ndarray, header: Header, columns: Sequence[str]) -> dict:
    """Arrow arrays of the wanted fixed columns of the records that start at given places, without a step for each record."""
    import pyarrow as pa

    core = np.frombuffer(data, np.uint8)[starts[:, None] + np.arange(_CORE_TYPE.itemsize)].reshape(-1).view(_CORE_TYPE)

    def known(values, missing):
        return pa.array(values, mask=missing)

    out = {}
    for c in columns:
        if c == "flags":
            out[c] = pa.array(core["flags"].astype(np.int32))
        elif c == "bin":
            out[c] = pa.array(core["bin"].astype(np.int32))
        elif c == "tlen":
            out[c] = pa.array(core["tlen"].astype(np.int32))
        elif c == "mapq":
            out[c] = known(core["mapq"].astype(np.int32), core["mapq"] == 255)
        elif c in ("ref_id", "mate_ref_id"):
            v = core["ref" if c == "ref_id" else "mate"]
            out[c] = known(v.astype(np.int32), v < 0)
        elif c in ("pos", "mate_pos"):
            v = core[c].astype(np.int64)
            out[c] = known(v + 1, v < 0)
        elif c == "ref_name":
            v = core["ref"]
            names = pa.array([n for n, _ in header.references], pa.string())
            out[c] = names.take(known(v.astype(np.int32), v < 0))
    return out


_PAIR_BYTES = np.array([list((a + b).encode()) for a in BASE_CODES for b in BASE_CODES], np.uint8)


def other_columns(data: bytes, starts: np.ndarray, ends: np.ndarray, header: Header, columns: Sequence[str]) -> dict:
    """Arrow arrays or lists of columns that have no fixed place, as :func:`decode` has them, without a step for each record; odd records are left to it."""
    quick = _decoded(data, starts, ends, columns) if columns else {}
    if quick is not None:
        return quick
    rows = [decode(data, a, b, header, columns) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    return dict(zip(columns, zip(*rows, strict=True), strict=True))


def _decoded(data: bytes, starts: np.ndarray, ends: np.ndarray, columns: Sequence[str]) -> dict | None:
    import pyarrow as pa
    import pyarrow.compute as pc

    flat_bytes = np.frombuffer(data, np.uint8)
    core = flat_bytes[starts[:, None] + np.arange(_CORE_TYPE.itemsize)].reshape(-1).view(_CORE_TYPE)
    bases, n_ops, name = (core[k].astype(np.int64) for k in ("bases", "n_ops", "l_name"))
    a = starts + 36
    b = a + name
    c = b + 4 * n_ops
    d = c + (bases + 1) // 2
    e = d + bases
    if (e > ends).any() or (bases < 0).any() or (name < 1).any():
        return None
    out = {}
    if "name" in columns:
        out["name"] = strings(gathered(flat_bytes, a, name - 1), name - 1, (name == 2) & (flat_bytes[a] == ord("*")))
    if "cigar" in columns or "tags" in columns:
        ops = gathered(flat_bytes, b, 4 * n_ops).view("<u4")
        first = offsets(n_ops)[:-1]
        two = np.flatnonzero(n_ops == 2)
        if ((ops[first[two]] == bases[two] << 4 | 4) & (ops[first[two] + 1] & 15 == 3)).any():
            return None  # what stands for a long CIGAR
    if "cigar" in columns:
        kinds, which = np.unique(ops, return_inverse=True)
        if (kinds & 15 >= len(CIGAR_CODES)).any():
            return None
        texts = pa.array([f"{x >> 4}{CIGAR_CODES[x & 15]}" for x in kinds.tolist()], pa.string()).take(pa.array(which))
        told = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets(n_ops), pa.int32()), texts), "")
        out["cigar"] = pc.if_else(pa.array(n_ops > 0), told, pa.scalar(None, pa.string()))
    if "sequence" in columns:
        pairs = (bases + 1) // 2
        letters = _PAIR_BYTES[gathered(flat_bytes, c, pairs)].reshape(-1)
        whole = np.ones(len(letters), bool)
        whole[(2 * offsets(pairs)[1:] - 1)[bases % 2 == 1]] = False
        out["sequence"] = strings(letters[whole], bases, bases == 0)
    if "quality" in columns:
        scores, none = gathered(flat_bytes, d, bases), bases == 0
        none = none | (summed(scores == 255, bases) == bases)
        scores = scores[~np.repeat(none, bases)]
        if (scores > 94).any():
            return None
        out["quality"] = strings(scores + 33, np.where(none, 0, bases), none)
    if "tags" in columns:
        coded = binaries(gathered(flat_bytes, e, ends - e), ends - e).dictionary_encode()
        told = [[(k, tag_text(*v)) for k, v in parse_tags(x).items()] for x in coded.dictionary.to_pylist()]
        out["tags"] = pa.array(told, pa.map_(pa.string(), pa.string())).take(coded.indices)
    return {k: out[k] for k in columns}


@dataclass
class Split(InputPartition):
    path: str
    begin: int  # compressed offset from which on records are this task's
    end: int
    chunks: list[tuple[int, int]] | None = None  # ranges of virtual offsets, instead


class BamSource(DataSource):
    """``format("bam")``: alignment records of binary files.

    Options: ``columns`` (comma list of what is decoded; the default is all but
    ``voffset``, ``vend`` and ``path``, where a record begins and ends and in
    which file), ``split_bytes`` (64 MiB; smaller ones are enlarged where
    they would make more than some thousand tasks; 0: a task a file), ``regions``
    (a region or a JSON list of them, for files with an index beside them: only
    the blocks that may hold their records are read, and only records that meet
    one come). With splits a task finds the first record in its blocks as the
    first place from which a chain of two plausible records or more runs
    through ``PROOF`` bytes, reading on as long as none is found, and takes the
    records that begin in its blocks. Where Spark pushes filters to Python
    sources, ones on ``ref_name`` and ``pos`` choose blocks by the index too.
    """

    @classmethod
    def name(cls) -> str:
        return "bam"

    def _wanted(self) -> list[str]:
        if "columns" in self.options:
            wanted = [c.strip() for c in self.options["columns"].split(",")]
            if unknown := set(wanted) - set(SCHEMA):
                raise ValueError(f"unknown columns: {sorted(unknown)}")
            return wanted
        return [c for c in SCHEMA if c not in PLACES]

    def schema(self) -> str:
        return ", ".join(f"{k} {SCHEMA[k]}" for k in self._wanted())

    def reader(self, schema):
        return _BamReader(self.options["path"], self._wanted(), int(self.options.get("split_bytes", SPLIT_BYTES)), schema, bgzf.regions_of(self.options))


class _BamReader(DataSourceReader):
    #: Bytes that a chain of records must run through.
    PROOF = 1 << 18
    #: Compressed bytes of an index's chunks that one task reads, about.
    CHUNK_BYTES = 16 << 20

    def __init__(self, path: str, wanted: Sequence[str], split: int, schema, regions: Sequence[Region] = ()):
        self.path, self.wanted, self.split, self.fields, self.regions = path, list(wanted), split, schema, list(regions)
        self.pushed: Region | None = None

    def pushFilters(self, filters):  # noqa: N802
        """Remember what filters on ``ref_name`` and ``pos`` say of a region; all of them are left to Spark as well."""
        name = low = high = None
        for f in filters:
            column, value = getattr(f, "attribute", None), getattr(f, "value", None)
            kind = type(f).__name__
            if column == ("ref_name",) and kind == "EqualTo":
                name = value
            elif column == ("pos",) and kind in ("EqualTo", "GreaterThan", "GreaterThanOrEqual"):
                low = max(low or 1, value)
            if column == ("pos",) and kind in ("EqualTo", "LessThan", "LessThanOrEqual"):
                high = min(high or value, value)
        if name is not None:
            self.pushed = Region(name, max(low, 1) if low else None, max(high, 1) if high is not None else None)
        return filters

    def partitions(self):
        out, listed = [], [(p, n) for p, n in files.list_files(self.path) if not p.endswith(indexes.SUFFIXES)]
        split = self.split and bgzf.split_size(self.split, sum(n for _, n in listed))
        for path, size in listed:
            chunks = self._chunks_of(path)
            if chunks is not None:
                out += [Split(path, 0, size, c) for c in bgzf.by_size(chunks, self.split or self.CHUNK_BYTES)]
                continue
            step = split or max(size, 1)
            out += [Split(path, at, min(at + step, size)) for at in range(0, max(size, 1), step)]
        return out or [Split(self.path, 0, 0, [])]

    def _chunks_of(self, path: str) -> list[tuple[int, int]] | None:
        """What the index beside a file says of the regions; None where the whole file is to be read."""
        regions = self.regions or ([self.pushed] if self.pushed else [])
        if not regions:
            return None
        try:
            index = indexes.beside(path)
        except FileNotFoundError:
            if self.regions:
                raise
            return None
        header, _, _ = read_header(files.open_file(path))
        return index.chunks_of(regions, [n for n, _ in header.references])

    def read(self, part: Split) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        schema = to_arrow_schema(self.fields)
        fixed = [c for c in self.wanted if c in FIXED]
        others = [c for c in self.wanted if c not in FIXED and c not in PLACES]
        file = files.open_file(part.path) if part.end else None
        header = read_header(file) if file else None
        for data, starts, ends, begins, afters in self._runs(part, file, header):
            for at in range(0, len(starts), 4096):
                s, e = starts[at : at + 4096], ends[at : at + 4096]
                got = fixed_columns(data, s, header[0], fixed) | other_columns(data, s, e, header[0], others)
                got |= {"voffset": begins[at : at + 4096], "vend": afters[at : at + 4096]}
                if "path" in self.wanted:
                    got["path"] = pa.repeat(part.path, len(s))
                yield pa.RecordBatch.from_arrays([got[f.name].cast(f.type) if isinstance(got[f.name], pa.Array) else pa.array(got[f.name], type=f.type) for f in schema], schema=schema)

    def _records(self, part: Split) -> Iterator[tuple]:
        """A task's records, one after another."""
        file = files.open_file(part.path)
        header = read_header(file)
        for data, starts, ends, *_ in self._runs(part, file, header):
            for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
                yield decode(data, a, b, header[0], self.wanted)

    def _runs(self, part: Split, file, read) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(bytes, where records start and end in them, their virtual offsets and those after them), a run some blocks."""
        if part.chunks is not None:
            for begin, end in part.chunks:
                c = bgzf.Contents(file, begin >> 16)
                if c.more():
                    for run in self._walk(c, begin & 0xFFFF, end):
                        if self.regions:
                            run = self._meeting(run, read[0])
                        if len(run[1]):
                            yield run
            return
        header, begin, within = read
        if part.begin == 0:
            c, at = bgzf.Contents(file, begin), within
        else:
            first = bgzf.find_block(file, part.begin)
            if first is None or first >= part.end:
                return
            c, at = bgzf.Contents(file, max(first, begin)), None
            if first <= begin:
                at = within
        need, done = self.PROOF, False
        while at is None:
            done = done or not c.more()
            if not done and len(c.data) < need:
                continue
            ends = c.held_before(part.end)
            at, settled = _first_record(bytes(c.data), ends, len(header.references), done, self.PROOF)
            if at is None:
                # all that is held may lie within one long record
                c.drop(settled)
                if done or c.held_before(part.end) <= 0:
                    return
                need = len(c.data) + self.PROOF
        while len(c.data) <= at and c.more():
            pass
        yield from self._walk(c, min(at, len(c.data)), part.end << 16)

    def _walk(self, c: bgzf.Contents, at: int, stop: int) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Runs of whole records from a place on, of those that begin before a virtual offset."""
        while True:
            while len(c.data) - at < RUN_BYTES and c.after << 16 < stop and c.more():
                pass
            data = bytes(c.data)
            starts, at = _chain(data, at)
            starts = np.array([*starts, at])
            places = c.virtuals(starts)
            # a record belongs to the task if it begins before the offset; so do all before it
            n = min(len(starts) - 1, int(np.searchsorted(places, stop)))
            if n:
                yield data, starts[:n], starts[1 : n + 1], places[:n], places[1 : n + 1]
            if n < len(starts) - 1 or (at < len(data) and places[-1] >= stop):
                return
            # a place past what is held: the block that is read next decides
            c.drop(at)
            at = 0
            if not c.data and c.after << 16 >= stop:
                return
            if not c.more():
                if c.data:
                    raise BamError("file ends within a record")
                return

    def _meeting(self, run, header: Header):
        """The records of a run that meet one of the regions."""
        data, starts, ends, begins, afters = run
        ids = {n: i for i, (n, _) in enumerate(header.references)}
        wanted = [(ids[r.name], r.start or 1, r.end or 1 << 62) for r in self.regions if r.name in ids]
        keep = []
        for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
            ref, pos = struct.unpack_from("<ii", data, a + 4)
            near = [(s, e) for r, s, e in wanted if r == ref and pos >= 0 and pos + 1 <= e]
            if near:
                last = pos + max(1, _span(data, a, b))
                if any(last >= s for s, _ in near):
                    keep.append(i)
        return data, *(x[keep] if keep else x[:0] for x in (starts, ends, begins, afters))


def _chain(data: bytes, at: int) -> tuple[list[int], int]:
    """(where the whole records from a place on start, where the last one ends)."""
    starts, size_at, held = [], struct.Struct("<i").unpack_from, len(data)
    while at + 4 <= held:
        n = size_at(data, at)[0] + 4
        if n < 36:
            raise BamError(f"record of {n - 4} bytes")
        if at + n > held:
            break
        starts.append(at)
        at += n
    return starts, at


def _span(data: bytes, at: int, end: int) -> int:
    """Reference bases that a record covers."""
    (cigar,) = decode(data, at, end, Header("", []), ["cigar"])
    return sum(int(n) for n, k in re.findall(r"(\d+)([MDN=X])", cigar or ""))


def _first_record(data: bytes, ends: int, references: int, done: bool, proof: int) -> tuple[int | None, int]:
    """(first place before ``ends`` where a record begins, or None; up to where places are settled)."""
    for start in range(ends):
        if not done and len(data) - start < proof:
            return None, start
        at, n = start, 0
        while at < len(data):
            size = plausible(data, at, references)
            if size is None:
                break
            at, n = at + size, n + 1
        if done:
            if n and at == len(data):
                return start, start
        elif at + 36 > len(data):  # what is left is too short to tell
            if n > 1:
                return start, start
            return None, start  # one record alone is no chain
    return None, ends


def read_header(file) -> tuple[Header, int, int]:
    """(header, offset of the block with the first record, place in it)."""
    data, starts = b"", []
    for begin, after, block in bgzf.BlockReader(file, 0):
        starts.append((len(data), begin, after))
        data += block
        found = parse_header(data)
        if found:
            header, size = found
            for at, b, nxt in reversed(starts):
                if at <= size:
                    return (header, b, size - at) if size < len(data) else (header, nxt, 0)
    raise BamError("no BAM header")


def write_bam(df: DataFrame, folder: str, header: Header, into: int | None = None) -> list[str]:
    """One whole BAM file a partition, or ``into`` files, in the rows' order; tags are map<tag, TYPE:VALUE>. Returns the paths."""

    return sinks.write_blocks(df, folder, "bam", header_bytes(header), lambda batch: [encode_batch(batch)], into)


def quickcheck(spark: SparkSession, path: str) -> DataFrame:
    """Per file whether it is block-compressed, has a header with a reference at least, and ends with the end block.

    Of every file its header and its last bytes are read, whatever its size.
    """

    def run(batches):
        import pyarrow as pa

        for b in batches:
            ok = []
            for p in b.column(0).to_pylist():
                file = files.open_file(p)
                n = len(bgzf.END_BLOCK)
                try:
                    whole = file.size() >= n and file.read_at(n, file.size() - n) == bgzf.END_BLOCK
                    ok.append(whole and bool(read_header(file)[0].references))
                except ValueError:
                    ok.append(False)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ok, pa.bool_())], names=["path", "ok"])

    listed = spark.createDataFrame([(p,) for p, _ in files.list_files(path) if not p.endswith(indexes.SUFFIXES)], "path string")
    return listed.mapInArrow(run, "path string, ok boolean")


def indexable(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """What :func:`indexes.build` takes, of BAM files whose headers say that they are in coordinate order; others raise."""
    headers = [read_header(files.open_file(p))[0] for p, _ in files.list_files(path) if not p.endswith(indexes.SUFFIXES)]
    if not all(coordinate_sorted(h.text) for h in headers):
        raise BamError("the header doesn't say that records are in coordinate order")
    n_refs = len(headers[0].references) if headers else 0
    from pyspark.sql import functions as F

    from ..functions import records

    rows = spark.read.format("bam").option("columns", "path,ref_id,pos,cigar,flags,voffset,vend").option("split_bytes", split_bytes).load(path)
    return rows.select(
        "path", "ref_id", "pos", records.alignment_end(F.col("pos"), F.col("cigar")).alias("aend"), records.has(F.col("flags"), "unmapped").alias("unmapped"), "voffset", "vend", F.lit(n_refs).alias("n_refs")
    )


def coordinate_sorted(text: str) -> bool:
    """Whether a header's @HD line says SO:coordinate."""
    first = text.split("\n", 1)[0].split("\t")
    return first[0] == "@HD" and "SO:coordinate" in first[1:]
