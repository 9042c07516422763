"""Paths that all executors share, and files moved by Hadoop's file systems."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share.

    It is the session's spark.checkpoint.dir. Where that is unset a local master gets a temporary
    folder, set for the rest of the session; a cluster gets an error, as its machines share none.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="millrace-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """df, written once to the shared folder and read from there."""
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hadoop(spark: SparkSession, path: str):
    """(Path, FileSystem) of a path."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = hadoop(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    p, fs = hadoop(spark, path)
    fs.delete(p, True)


def replace_file(spark: SparkSession, source: str, target: str) -> None:
    """Moves source to target, whose folder is made and which is replaced if it exists."""
    a, fs = hadoop(spark, source)
    b, other = hadoop(spark, target)
    if b.getParent() is not None:
        other.mkdirs(b.getParent())
    if other.exists(b):
        other.delete(b, True)
    moved = fs.getUri().equals(other.getUri()) and fs.rename(a, b)
    if not moved and not spark._jvm.org.apache.hadoop.fs.FileUtil.copy(fs, a, other, b, True, True, spark._jsc.hadoopConfiguration()):
        raise OSError(f"{source} cannot be moved to {target}")
    check = spark._jvm.org.apache.hadoop.fs.Path(b.getParent(), f".{b.getName()}.crc")
    local = spark._jvm.java.io.File(check.toUri().getPath())
    if not other.getUri().getScheme() or other.getUri().getScheme() == "file":  # else the file could not be edited
        local.delete()


def joined(spark: SparkSession, parts: list[str], target: str, head: str = "", end: str = "", without: int = 0) -> None:
    """One file of several, copied by Hadoop's streams, between two texts; the last bytes, as many as
    `without`, of what the files hold are left out."""
    p, fs = hadoop(spark, target)
    sizes = [other.getFileStatus(q).getLen() for q, other in (hadoop(spark, x) for x in parts)]
    last = max((i for i, n in enumerate(sizes) if n), default=-1)
    out = fs.create(p)
    try:
        out.write(head.encode())
        for i, (part, size) in enumerate(zip(parts, sizes, strict=True)):
            q, other = hadoop(spark, part)
            source = other.open(q)
            if i == last and without:
                source = spark._jvm.org.apache.commons.io.input.BoundedInputStream(source, size - without)
            try:
                spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(source, out, 1 << 16, False)
            finally:
                source.close()
        out.write(end.encode())
    finally:
        out.close()


def joined_parquet(spark: SparkSession, parts: list[str], target: str) -> None:
    """One Parquet file with the row groups of several of the same columns, copied as they are."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    hadoop_, util = jvm.org.apache.parquet.hadoop, jvm.org.apache.parquet.hadoop.util
    files = [util.HadoopInputFile.fromPath(hadoop(spark, x)[0], conf) for x in parts]
    reader = hadoop_.ParquetFileReader.open(files[0])
    try:
        meta = reader.getFileMetaData()
    finally:
        reader.close()
    out = util.HadoopOutputFile.fromPath(hadoop(spark, target)[0], conf)
    writer = hadoop_.ParquetFileWriter(out, meta.getSchema(), getattr(hadoop_, "ParquetFileWriter$Mode").CREATE, 128 << 20, 8 << 20)
    writer.start()
    for file in files:
        writer.appendFile(file)
    writer.end(meta.getKeyValueMetaData())


def list_files(spark: SparkSession, pattern: str) -> list[str]:
    """The files that a path or glob pattern names."""
    p, fs = hadoop(spark, pattern)
    return sorted(str(x.getPath().toString()) for x in fs.globStatus(p) or () if x.isFile())


def read_text(spark: SparkSession, path: str, size: int = 65536) -> str:
    """The first bytes of a file as text."""
    p, fs = hadoop(spark, path)
    stream = fs.open(p)
    try:
        n = min(size, fs.getFileStatus(p).getLen())
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, n) if n else b"").decode("utf-8", "replace")
    finally:
        stream.close()


class Counted:
    """An iterator that knows how many items it has given."""

    def __init__(self, items):
        self.items, self.n = iter(items), 0

    def __iter__(self):
        return self

    def __next__(self):
        out = next(self.items)
        self.n += 1
        return out
