"""Files of any store that pyarrow knows, and the folder that a cluster shares."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def filesystem(path: str):
    """(file system, path in it) of a path or URI; Hadoop's names of one store are known too."""
    from pyarrow import fs

    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:") and not path.startswith("file://"):
        path = "file://" + path.removeprefix("file:")
    for alias in ("s3a://", "s3n://"):
        path = "s3://" + path.removeprefix(alias) if path.startswith(alias) else path
    return fs.FileSystem.from_uri(path)


def open_file(path: str):
    """A random-access file."""
    system, inner = filesystem(path)
    return system.open_input_file(inner)


def list_files(path: str) -> list[tuple[str, int]]:
    """(path, size) of a file, or of a folder's files in order; hidden ones left out."""
    from pyarrow import fs

    system, inner = filesystem(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = system.get_file_info(fs.FileSelector(inner, recursive=False))
    folder = path.rstrip("/")
    return sorted((f"{folder}/{f.base_name}", f.size) for f in found if f.type == fs.FileType.File and not f.base_name.startswith((".", "_")))


def qualified(spark: SparkSession, path: str) -> str:
    """A path with the scheme that the cluster reads it by: the default file system's, where it names none."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    full = p.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(p).toUri().toString()
    return "file://" + full.removeprefix("file:") if full.startswith("file:/") and not full.startswith("file://") else full


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Only a local session may do without; it gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        set_before = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = set_before.get() if set_before.isDefined() else None
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='strandline-')}"
        spark.sparkContext.setCheckpointDir(found)
    return qualified(spark, found).rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    with contextlib.suppress(Exception):  # the session may be gone
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def staged(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again, until the program ends: its lineage is cut, a lost executor costs its tasks only."""
    path = f"{shared_folder(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    atexit.register(remove, df.sparkSession, path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
