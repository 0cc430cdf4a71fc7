"""Small files on whatever file system a path names, through Hadoop's."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _at(spark, path)
    return fs.exists(at)


def files_below(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(path, size, time of change) of all files below a path, or of the file it is, sorted."""
    at, fs = _at(spark, path)
    if not fs.exists(at):
        return []
    out, found = [], fs.listFiles(at, True)
    while found.hasNext():
        one = found.next()
        out.append((one.getPath().toString(), one.getLen(), one.getModificationTime()))
    return sorted(out)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    at, fs = _at(spark, path)
    out = fs.create(at, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, path: str) -> str:
    at, fs = _at(spark, path)
    stream = fs.open(at)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def md5(spark: SparkSession, path: str) -> tuple[str, int]:
    """md5 and size of a file, read as a stream."""
    at, fs = _at(spark, path)
    stream = fs.open(at)
    try:
        return spark._jvm.org.apache.commons.codec.digest.DigestUtils.md5Hex(stream), fs.getFileStatus(at).getLen()
    finally:
        stream.close()
