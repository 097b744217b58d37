"""Small helpers shared by the file sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p))


def empty(spark: SparkSession, schema: str) -> DataFrame:
    return spark.createDataFrame([], schema)


def join_files(spark: SparkSession, folder: str, path: str, head: str, tail: str) -> None:
    """One file of ``head``, the bytes of the folder's files in order of their names, and ``tail``.

    Streams through the file system in small buffers, under a hidden name; the file appears
    under its own name when it is whole."""
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    target = hadoop.fs.Path(path)
    fs, source = target.getFileSystem(conf), hadoop.fs.Path(folder).getFileSystem(conf)
    hidden = hadoop.fs.Path(target.getParent(), f"_{target.getName()}.tmp")
    parts = [s.getPath() for s in source.listStatus(hadoop.fs.Path(folder))] if path_exists(spark, folder) else []
    out = fs.create(hidden, True)
    try:
        out.write(bytearray(head.encode("utf-8")))
        for part in sorted((p for p in parts if not p.getName().startswith(("_", "."))), key=lambda p: p.getName()):
            read = source.open(part)
            hadoop.io.IOUtils.copyBytes(read, out, 1 << 16, False)
            read.close()
        out.write(bytearray(tail.encode("utf-8")))
    finally:
        out.close()
    fs.delete(target, False)
    fs.rename(hidden, target)
