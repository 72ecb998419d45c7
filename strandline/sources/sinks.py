"""Text records and files: FASTA, FASTQ, line formats and blocked gzip."""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.records import wrap
from . import bgzf, columns
from .files import filesystem


def _definition(mark: str) -> Column:
    return F.concat(F.lit(mark), F.concat_ws(" ", "name", F.nullif(F.col("description"), F.lit(""))))


def fasta_record(width: int = 80) -> Column:
    return F.concat(_definition(">"), F.lit("\n"), wrap(F.col("sequence"), width))


def fastq_record() -> Column:
    return F.concat(_definition("@"), F.lit("\n"), F.col("sequence"), F.lit("\n+\n"), F.col("quality"))


def write_lines(records: DataFrame, folder: str, header: list[str] = ()) -> None:
    """A folder of text files of the one column's records, each file with the header."""
    records = records.toDF("value")
    if not header:
        records.write.text(folder)
        return
    # the header opens every file, so that each can be read by itself
    first = "\n".join(header)

    def run(batches):
        import pyarrow as pa

        yield pa.RecordBatch.from_arrays([pa.array([first])], names=["value"])
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string())], names=["value"])

    records.mapInArrow(run, "value string").write.text(folder)


def write_parts(df: DataFrame, folder: str, suffix: str, body: Callable[[Iterable], Iterable[bytes]]) -> list[str]:
    """A file for each partition, of the bytes that ``body`` makes of its Arrow batches. Returns the paths, by partition.

    A task writes under a name of its own in a hidden folder. Its name counts
    only if Spark takes the task's result, which happens once a partition
    however often a task runs; the driver then gives the file its name and
    removes what other attempts left.
    """
    import uuid

    job = uuid.uuid4().hex
    hidden = f"{folder.rstrip('/')}/_attempts-{job}"

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        system, inner = filesystem(hidden)
        system.create_dir(inner, recursive=True)
        name = f"{part}-{uuid.uuid4().hex}"
        with system.open_output_stream(f"{inner}/{name}", compression=None) as out:
            for piece in body(batches):
                out.write(piece)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name])], names=["part", "name"])

    system, inner = filesystem(folder.rstrip("/"))
    system.create_dir(inner, recursive=True)
    paths = []
    for row in sorted(df.mapInArrow(run, "part int, name string").collect()):
        final = f"part-{row['part']:05d}-{job}.{suffix}"
        system.move(f"{inner}/_attempts-{job}/{row['name']}", f"{inner}/{final}")
        paths.append(f"{folder.rstrip('/')}/{final}")
    with contextlib.suppress(FileNotFoundError):
        system.delete_dir(f"{inner}/_attempts-{job}")
    return paths


def write_blocks(df: DataFrame, folder: str, suffix: str, head: bytes, encode: Callable[[object], Iterable[bytes]], into: int | None = None) -> list[str]:
    """Blocked-gzip files by :func:`write_parts`: ``head``, then what ``encode`` makes of each Arrow batch, then the end block.

    ``into`` makes so many files, whatever the number of partitions: each
    partition's blocks are written by a task of its own, then joined by copying
    bytes, the partitions in their order.
    """

    def blocks(batches, held: bytearray) -> Iterable[bytes]:
        for b in batches:
            for piece in encode(b):
                held += piece
                while len(held) >= bgzf.PAYLOAD:
                    yield bgzf.frame(bytes(held[: bgzf.PAYLOAD]))
                    del held[: bgzf.PAYLOAD]
        if held:
            yield bgzf.frame(bytes(held))

    def whole(batches) -> Iterable[bytes]:
        yield from blocks(batches, bytearray(head))
        yield bgzf.END_BLOCK

    if into is None:
        return write_parts(df, folder, suffix, whole)
    import uuid

    pieces = f"{folder.rstrip('/')}/_pieces-{uuid.uuid4().hex}"
    parts = write_parts(df, pieces, "part", lambda batches: blocks(batches, bytearray()))

    def joined(batches) -> Iterable[bytes]:
        for k in (k for b in batches for k in b.column(0).to_pylist()):
            yield from blocks([], bytearray(head))
            for part in parts[len(parts) * k // into : len(parts) * (k + 1) // into]:
                system, inner = filesystem(part)
                with system.open_input_stream(inner, compression=None) as given:
                    while piece := given.read(1 << 22):
                        yield piece
            yield bgzf.END_BLOCK

    paths = write_parts(df.sparkSession.range(0, into, 1, into), folder, suffix, joined)
    system, inner = filesystem(pieces)
    system.delete_dir(inner)
    return paths


def write_bgzf(records: DataFrame, folder: str, header: list[str] = (), suffix: str = "gz", into: int | None = None) -> list[str]:
    """Blocked-gzip files of the one column's records, a file a partition or ``into`` files, each with header and end block; their paths."""

    def encode(batch):
        if batch.column(0).null_count:
            raise ValueError("a line is null")
        yield columns.flat(columns.side_by_side(batch.column(0), b"\n"))[0].tobytes()

    return write_blocks(records, folder, suffix, "".join(f"{x}\n" for x in header).encode(), encode, into)


def reheader(spark: SparkSession, path: str, folder: str, header: bytes, suffix: str) -> list[str]:
    """Blocked files with another header, their records as they were: blocks without a header are copied byte by byte.

    ``header`` is a BAM header, or lines for text that begin with its comment
    mark. A task takes a file.
    """
    from . import bam, files
    from .indexes import SUFFIXES

    listed = [(p,) for p, _ in files.list_files(path) if not p.endswith(SUFFIXES)]

    def body(batches):
        for b in batches:
            for p in b.column(0).to_pylist():
                file = files.open_file(p)
                if header[:4] == bam.MAGIC:
                    _, begin, within = bam.read_header(file)
                else:
                    begin, within = _after_header(file, header[:1])
                yield from bgzf.with_head(file, header, begin, within)

    given = spark.createDataFrame(listed, "path string").repartitionByRange(max(1, len(listed)), "path")
    return write_parts(given, folder, suffix, body)


def _after_header(file, mark: bytes) -> tuple[int, int]:
    """(block, place in it) where the first line without a mark begins."""
    c, at = bgzf.Contents(file), 0
    while c.more():
        while (cut := c.data.find(b"\n", at)) >= 0 or at < len(c.data):
            if c.data[at : at + 1] != mark:
                v = c.virtual(at)
                return v >> 16, v & 0xFFFF
            if cut < 0:
                break
            at = cut + 1
    return c.after, 0
