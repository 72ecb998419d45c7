"""Index files: BAI, CSI, tabix and GZI; their rows, what a region needs of a file, and building them from records."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import coords
from ..functions.coords import Region
from ..operators import indexing
from . import bgzf, files

#: Endings of index files, which stand beside the files that they index.
SUFFIXES = (".bai", ".csi", ".tbi", ".gzi", ".crai", ".fai")
BINS_SCHEMA = "path string, ref_id int, ref_name string, bin int, loffset bigint, chunk_begin bigint, chunk_end bigint"


def metadata_bin(depth: int = 5) -> int:
    """The bin number under which counts are kept."""
    return ((1 << 3 * (depth + 1)) - 1) // 7 + 1


@dataclass
class Index:
    """Chunks per reference and bin, and what goes with them."""

    bins: list[tuple[int, int, int, int, int]] = field(default_factory=list)  # reference, bin, smallest offset, begin, end
    counts: dict[int, tuple[int, int]] = field(default_factory=dict)  # reference: mapped, unmapped
    linear: dict[int, list[int]] = field(default_factory=dict)
    names: list[str] = field(default_factory=list)
    columns: dict[str, int] = field(default_factory=dict)
    unplaced: int | None = None
    min_shift: int = 14
    depth: int = 5

    def chunks_of(self, regions: Sequence[Region], names: Sequence[str]) -> list[tuple[int, int]]:
        """Merged ranges of virtual offsets that may hold records of any of the regions; ``names`` are the references in order."""
        found = []
        for region in regions:
            if region.name in names:
                ref = names.index(region.name)
                found += query_chunks(self, ref, coords.region_bins(region, self.min_shift, self.depth), least=least_offset(self, ref, (region.start or 1) - 1))
        return merged(found)


class _Bytes:
    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, layout: str):
        got = struct.unpack_from("<" + layout, self.data, self.at)
        self.at += struct.calcsize("<" + layout)
        return got if len(got) > 1 else got[0]

    def left(self) -> int:
        return len(self.data) - self.at


def _references(r: _Bytes, index: Index, csi: bool) -> None:
    n_refs = r.take("i")
    special = metadata_bin(index.depth)
    for ref in range(n_refs):
        for _ in range(r.take("i")):
            number = r.take("I")
            loffset = r.take("Q") if csi else 0
            chunks = [r.take("QQ") for _ in range(r.take("i"))]
            if number == special and len(chunks) == 2:
                index.counts[ref] = chunks[1]
            else:
                index.bins += [(ref, number, loffset, b, e) for b, e in chunks]
        if not csi:
            index.linear[ref] = [r.take("Q") for _ in range(r.take("i"))]
    if r.left() >= 8:
        index.unplaced = r.take("Q")


def _tabix_header(r: _Bytes, index: Index) -> None:
    kind, name, start, end, meta, skip, size = r.take("iiiiiii")
    index.columns = {"format": kind & 0xFFFF, "zero_based": kind >> 16 & 1, "name": name, "start": start, "end": end, "comment": meta, "skip": skip}
    index.names = [n.decode() for n in r.data[r.at : r.at + size].split(b"\0")[:-1]]
    r.at += size


def parse_index(data: bytes) -> Index:
    """BAI, CSI or tabix, told by the magic number; the latter two may be block-compressed."""
    if data[:2] == b"\x1f\x8b":
        spans, used = bgzf.discover(data)
        if used != len(data):
            raise bgzf.BgzfError("file ends within a block")
        data = b"".join(bgzf.inflate(data[s.offset : s.offset + s.size], s) for s in spans)
    index, r = Index(), _Bytes(data, 4)
    if data[:4] == b"BAI\x01":
        _references(r, index, False)
    elif data[:4] == b"TBI\x01":
        n = struct.unpack_from("<i", data, 4)[0]
        r.at = 8
        _tabix_header(r, index)
        # the number of references stands before the header here
        body = _Bytes(struct.pack("<i", n) + data[r.at :])
        _references(body, index, False)
    elif data[:4] == b"CSI\x01":
        index.min_shift, index.depth, aux = r.take("iii")
        if aux:
            head = _Bytes(data, r.at)
            if aux >= 28:
                _tabix_header(head, index)
            r.at += aux
        _references(r, index, True)
    else:
        raise ValueError("no index")
    return index


def _bins_bytes(index: Index, references: int, csi: bool) -> bytes:
    per: dict[int, dict[int, list[tuple[int, int]]]] = {}
    least: dict[tuple[int, int], int] = {}
    for r, number, loffset, b, e in index.bins:
        per.setdefault(r, {}).setdefault(number, []).append((b, e))
        least[r, number] = loffset
    out = [struct.pack("<i", references)]
    for ref in range(references):
        chunks = per.get(ref, {})
        counted = ref in index.counts
        out.append(struct.pack("<i", len(chunks) + counted))
        for number, found in sorted(chunks.items()):
            out.append(struct.pack("<I", number) + (struct.pack("<Q", least[ref, number]) if csi else b""))
            out.append(struct.pack("<i", len(found)) + b"".join(struct.pack("<QQ", *c) for c in sorted(found)))
        if counted:
            begin = min((b for f in chunks.values() for b, _ in f), default=0)
            end = max((e for f in chunks.values() for _, e in f), default=0)
            out.append(struct.pack("<I", metadata_bin(index.depth)) + (struct.pack("<Q", 0) if csi else b"") + struct.pack("<iQQQQ", 2, begin, end, *index.counts[ref]))
        if not csi:
            linear = index.linear.get(ref, [])
            out.append(struct.pack(f"<i{len(linear)}Q", len(linear), *linear))
    if index.unplaced is not None:
        out.append(struct.pack("<Q", index.unplaced))
    return b"".join(out)


def _roles_bytes(index: Index) -> bytes:
    c = index.columns
    names = b"".join(n.encode() + b"\0" for n in index.names)
    return struct.pack("<iiiiiii", c["format"] | c["zero_based"] << 16, c["name"], c["start"], c["end"], c["comment"], c["skip"], len(names)) + names


def write_bai(index: Index, references: int) -> bytes:
    """BAI of bins and linear offsets."""
    return b"BAI\x01" + _bins_bytes(index, references, False)


def write_csi(index: Index, references: int) -> bytes:
    """CSI, block-compressed; with column roles where the index has them."""
    aux = _roles_bytes(index) if index.columns else b""
    return bgzf.compress(b"CSI\x01" + struct.pack("<iii", index.min_shift, index.depth, len(aux)) + aux + _bins_bytes(index, references, True))


def write_tabix(index: Index) -> bytes:
    """Tabix, block-compressed; references are the index's names."""
    body = _bins_bytes(index, len(index.names), False)
    return bgzf.compress(b"TBI\x01" + body[:4] + _roles_bytes(index) + body[4:])


def merged(chunks: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Ranges in order, those that overlap or touch as one."""
    out: list[tuple[int, int]] = []
    for b, e in sorted(chunks):
        if out and b <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((b, e))
    return out


def least_offset(index: Index, ref: int, start0: int) -> int:
    """The smallest offset at which a record that reaches a 0-based position or lies beyond it can begin."""
    linear = index.linear.get(ref)
    if linear:
        return linear[min(start0 >> 14, len(linear) - 1)]
    least = {n: lo for r, n, lo, _, _ in index.bins if r == ref}
    for level in range(index.depth, -1, -1):
        # CSI keeps a smallest offset for each bin: the one around the position, or one that holds it
        number = coords.level_offset(level) + (start0 >> index.min_shift + 3 * (index.depth - level))
        if number in least:
            return least[number]
    return 0


def query_chunks(index: Index, ref: int, bins: Sequence[int], first_window: int | None = None, least: int = 0) -> list[tuple[int, int]]:
    """Merged chunks that may hold a region's records: those of its bins that end after ``least`` and after the linear index's offset of its first window."""
    if first_window is not None and index.linear.get(ref):
        linear = index.linear[ref]
        least = max(least, linear[min(first_window, len(linear) - 1)])
    wanted = set(bins)
    return merged((max(b, least), e) for r, n, _, b, e in index.bins if r == ref and n in wanted and e > least)


def read_index(path: str) -> Index:
    file = files.open_file(path)
    return parse_index(file.read_at(file.size(), 0))


def beside(path: str) -> Index:
    """The index that stands beside a file."""
    for suffix in (".bai", ".csi", ".tbi"):
        try:
            return read_index(path + suffix)
        except FileNotFoundError:
            continue
    raise FileNotFoundError(f"no index beside {path}")


def parse_gzi(data: bytes) -> list[tuple[int, int]]:
    """(compressed, uncompressed) offsets of blocks, the first one's zeros included."""
    n = struct.unpack_from("<Q", data)[0]
    if len(data) != 8 + 16 * n:
        raise ValueError("GZI of another size than it says")
    flat = struct.unpack_from(f"<{2 * n}Q", data, 8)
    return [(0, 0), *zip(flat[::2], flat[1::2], strict=True)]


def write_gzi(offsets: Sequence[tuple[int, int]]) -> bytes:
    body = [x for x in offsets if x != (0, 0)]
    return struct.pack("<Q", len(body)) + b"".join(struct.pack("<QQ", *x) for x in body)


def gzi_of(data: bytes) -> list[tuple[int, int]]:
    spans, _ = bgzf.discover(data)
    out, at = [], 0
    for s in spans:
        if s.inflated:
            out.append((s.offset, at))
        at += s.inflated
    return out


def offsets_of(file) -> list[tuple[int, int]]:
    """(compressed, uncompressed) offsets of a file's blocks that hold something, by their headers and trailers alone."""
    out, at, start, piece = [], 0, 0, 1 << 22
    while at < file.size():
        data = file.read_at(min(piece, file.size() - at), at)
        spans, used = bgzf.discover(data, at)
        if not used:
            raise bgzf.BgzfError("file ends within a block")
        for s in spans:
            if s.inflated:
                out.append((s.offset, start))
            start += s.inflated
        at += used
    return out or [(0, 0)]


def read_bins(spark: SparkSession, path: str) -> DataFrame:
    """One row for each chunk of index files; an index is parsed by one task, as index files are small."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = []
            for p, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                index = parse_index(data)
                rows += [(p, r, index.names[r] if r < len(index.names) else None, n, lo, begin, end) for r, n, lo, begin, end in index.bins]
            columns = list(zip(*rows, strict=True)) or [[]] * 7
            kinds = (pa.string(), pa.int32(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ["path", "ref_id", "ref_name", "bin", "loffset", "chunk_begin", "chunk_end"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, BINS_SCHEMA)


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    """(path, ref_id, mapped, unmapped) of index files, from what they say of each reference; the null reference counts the unplaced."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            rows = []
            for p, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
                index = parse_index(data)
                rows += [(p, ref, mapped, unmapped) for ref, (mapped, unmapped) in sorted(index.counts.items())]
                rows.append((p, None, 0, index.unplaced or 0))
            kinds = (pa.string(), pa.int32(), pa.int64(), pa.int64())
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["path", "ref_id", "mapped", "unmapped"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "path string, ref_id int, mapped bigint, unmapped bigint")


#: Column roles: kind of file, where names and positions stand, and what a line that is no record begins with.
ROLES = {
    "bed": {"format": 0, "zero_based": 1, "name": 1, "start": 2, "end": 3, "comment": ord("#"), "skip": 0},
    "gff": {"format": 0, "zero_based": 0, "name": 1, "start": 4, "end": 5, "comment": ord("#"), "skip": 0},
    "sam": {"format": 1, "zero_based": 0, "name": 3, "start": 4, "end": 0, "comment": ord("@"), "skip": 0},
    "vcf": {"format": 2, "zero_based": 0, "name": 1, "start": 2, "end": 0, "comment": ord("#"), "skip": 0},
}
#: Tiles of virtual offsets: 64 MiB of compressed bytes.
_TILE = 1 << 42


def build(records: DataFrame, kind: str, roles: dict[str, int] | None = None, min_shift: int = coords.MIN_SHIFT, depth: int = coords.DEPTH, compact: bool = True) -> list[str]:
    """Write an index beside each file of ``records``; returns the indexes' paths.

    ``records`` has ``path``, ``ref_id``, ``n_refs`` or ``ref_name``, ``pos``,
    ``aend``, ``unmapped`` and ``voffset``, ``vend``, the virtual offsets of a
    record. They must be in order: a file whose records go back raises. Bins,
    chunks, offsets and counts are aggregated by Spark; one task a file puts
    its index together, which is small beside the file. ``kind`` is bai, csi
    or tbi.
    """
    named = "ref_name" in records.columns
    # a few numbers a record, read several times
    records = files.staged(records)
    if named:
        # references are numbered in the order in which a file has them first
        first = records.where("ref_name is not null").groupBy("path", "ref_name").agg(F.min("voffset").alias("at"))
        refs = first.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("at", "ref_name"))).alias("r"))
        refs = refs.select("path", F.transform("r", lambda x: x["ref_name"]).alias("names"))
        numbers = refs.select("path", F.posexplode("names").alias("ref_id", "ref_name"))
        records = records.join(numbers, ["path", "ref_name"], "left")
    else:
        refs = records.groupBy("path").agg(F.max("n_refs").alias("n_refs"))
    rows = records.select("path", "ref_id", "pos", "aend", "unmapped", F.col("voffset").alias("begin"), F.col("vend").alias("end"))
    keys = ("path", "ref_id")
    chunks = files.staged(indexing.bin_chunks(rows, keys, min_shift, depth, _TILE).select(*keys, "bin", "begin", "end"))
    if compact:
        chunks = indexing.folded_bins(chunks, keys, depth, tile=_TILE).select(*keys, "bin", "begin", "end")
    linear = indexing.linear_index(rows, keys)
    stats = indexing.reference_stats(rows, keys)
    order = indexing.sorted_by_file(rows, "path", "begin", "ref_id", "pos", _TILE)
    # one row a piece of the index; what it is stands in ``part``
    none = lambda t: F.lit(None).cast(t)
    pieces = chunks.select("path", F.lit("bin").alias("part"), "ref_id", F.col("bin").cast("bigint").alias("a"), F.col("begin").alias("b"), F.col("end").alias("c"), none("array<string>").alias("names"))
    pieces = pieces.unionByName(linear.select("path", F.lit("linear").alias("part"), "ref_id", F.col("window").cast("bigint").alias("a"), F.col("offset").alias("b"), none("bigint").alias("c"), none("array<string>").alias("names")))
    pieces = pieces.unionByName(stats.select("path", F.lit("count").alias("part"), "ref_id", F.col("mapped").alias("a"), F.col("unmapped").alias("b"), none("bigint").alias("c"), none("array<string>").alias("names")))
    pieces = pieces.unionByName(order.select("path", F.lit("order").alias("part"), none("int").alias("ref_id"), F.col("sorted").cast("bigint").alias("a"), none("bigint").alias("b"), none("bigint").alias("c"), none("array<string>").alias("names")))
    pieces = pieces.unionByName(refs.select("path", F.lit("refs").alias("part"), none("int").alias("ref_id"), (none("bigint") if named else F.col("n_refs").cast("bigint")).alias("a"), none("bigint").alias("b"), none("bigint").alias("c"), (F.col("names") if named else none("array<string>")).alias("names")))

    def run(t):
        import uuid

        import pyarrow as pa

        path = t.column("path")[0].as_py()
        index, windows, references = Index(min_shift=min_shift, depth=depth, columns=dict(roles or {})), {}, 0
        unplaced = 0
        for r in t.to_pylist():
            if r["part"] == "bin":
                index.bins.append((r["ref_id"], r["a"], 0, r["b"], r["c"]))
            elif r["part"] == "linear":
                windows.setdefault(r["ref_id"], {})[r["a"]] = r["b"]
            elif r["part"] == "count" and r["ref_id"] is not None:
                index.counts[r["ref_id"]] = (r["a"], r["b"])
            elif r["part"] == "count":
                unplaced = r["a"] + r["b"]
            elif r["part"] == "order" and not r["a"]:
                raise ValueError(f"records aren't in coordinate order: {path}")
            elif r["part"] == "refs":
                index.names, references = r["names"] or [], r["a"] or len(r["names"] or [])
        index.unplaced = unplaced
        for ref, found in windows.items():
            # a window that nothing reaches takes the next one's offset
            offsets, following = [0] * (max(found) + 1), 0
            for w in range(max(found), -1, -1):
                offsets[w] = following = found.get(w, following)
            index.linear[ref] = offsets
        if kind == "csi":
            index.bins = [(r, n, _bin_least(index, r, n), b, e) for r, n, _, b, e in index.bins]
        data = write_bai(index, references) if kind == "bai" else write_csi(index, references) if kind == "csi" else write_tabix(index)
        system, inner = files.filesystem(path)
        hidden = f"{inner.rsplit('/', 1)[0]}/.{uuid.uuid4().hex}"
        with system.open_output_stream(hidden, compression=None) as out:
            out.write(data)
        system.move(hidden, f"{inner}.{kind}")
        return pa.table({"path": pa.array([f"{path}.{kind}"])})

    return sorted(r["path"] for r in pieces.groupBy("path").applyInArrow(run, "path string").collect())


def _bin_least(index: Index, ref: int, number: int) -> int:
    """A bin's smallest offset: of the records that reach into its first window or lie after."""
    linear, level = index.linear.get(ref) or [0], 0
    while coords.level_offset(level + 1) <= number:
        level += 1
    start0 = number - coords.level_offset(level) << index.min_shift + 3 * (index.depth - level)
    return linear[min(start0 >> 14, len(linear) - 1)]
