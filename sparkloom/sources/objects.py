"""Single objects through Hadoop's file systems, for small side data."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Objects above this size belong into a DataFrame, not into the driver.
LIMIT = 64 << 20


def _at(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def object_name(key: str, *suffixes: object, delimiter: str = "_") -> str:
    """``key`` and its suffixes joined."""
    return delimiter.join([key, *map(str, suffixes)])


def object_size(spark: SparkSession, path: str) -> int:
    """Bytes of a file, or of all files below a folder."""
    fs, where = _at(spark, path)
    return fs.getContentSummary(where).getLength()


def write_object(spark: SparkSession, path: str, data: bytes) -> None:
    if len(data) > LIMIT:
        raise ValueError(f"{len(data)} bytes are too many for one object")
    fs, where = _at(spark, path)
    out = fs.create(where, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def read_object(spark: SparkSession, path: str) -> bytes:
    if (n := object_size(spark, path)) > LIMIT:
        raise ValueError(f"{n} bytes are too many for one object")
    rows = spark.read.format("binaryFile").load(path).select("content").collect()
    if len(rows) != 1:
        raise ValueError(f"{path} isn't one file")
    return bytes(rows[0].content)
