"""Single files on any storage that Spark's Hadoop client reaches, and folders written part by part.

A format that must be one file is written as ordered text parts by the
executors and joined as byte streams, so rows never pass through the driver's Python.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own in the shared checkpoint folder; it comes into being when something is written there."""
    from timberline.operators.graph import ensure_checkpoint_dir

    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file: a header, a configuration, a drawing."""
    _, fs, where = _hadoop(spark, path)
    out = fs.create(where, True)
    try:
        out.write(data)
    finally:
        out.close()


def read_bytes(spark: SparkSession, path: str) -> bytes:
    """A small file."""
    return bytes(spark.read.format("binaryFile").load(path).select("content").first()[0])


def write_text_file(bodies: list[DataFrame], path: str, header: str = "") -> None:
    """``header`` and then the lines (column ``value``) of each frame, in the frame's order, as one file."""
    spark = bodies[0].sparkSession
    jvm, fs, where = _hadoop(spark, path)
    out = fs.create(where, True)
    try:
        out.write(header.encode())
        for k, body in enumerate(bodies):
            folder = f"{path}.parts{k}"
            body.select(F.col("value").cast("string")).write.mode("overwrite").text(folder)
            parts = sorted(str(s.getPath()) for s in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{folder}/part-*")))
            for part in parts:
                read = fs.open(jvm.org.apache.hadoop.fs.Path(part))
                try:
                    jvm.org.apache.hadoop.io.IOUtils.copyBytes(read, out, 1 << 16, False)
                finally:
                    read.close()
            fs.delete(jvm.org.apache.hadoop.fs.Path(folder), True)
    finally:
        out.close()


def write_blobs(blobs: DataFrame, path: str, header: bytes = b"") -> None:
    """``header`` and then the byte strings (column ``value``, not null) in the frame's order, as one file.

    The executors write each byte string as a file of its own (text, whose last byte is
    the line's end), and the driver's Hadoop client joins these as streams; no bytes pass
    through Python. Byte strings should be of some megabytes.
    """
    spark = blobs.sparkSession
    jvm, fs, where = _hadoop(spark, path)
    folder = f"{path}.parts"
    # the cast takes the bytes as they are
    blobs.select(F.col("value").cast("string").alias("value")).write.mode("overwrite").option("maxRecordsPerFile", 1).option("compression", "none").option("lineSep", "\n").text(folder)
    parts = [s for s in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{folder}/part-*")) if s.getLen()]
    out = fs.create(where, True)
    try:
        out.write(header)
        for part in sorted(parts, key=lambda s: _turn(s.getPath().getName())):
            read = fs.open(part.getPath())
            try:
                jvm.org.apache.commons.io.IOUtils.copyLarge(read, out, 0, part.getLen() - 1)
            finally:
                read.close()
    finally:
        out.close()
    fs.delete(jvm.org.apache.hadoop.fs.Path(folder), True)


def _turn(name: str) -> tuple[int, int]:
    """(task, file of the task) of a part's name."""
    task, file = re.fullmatch(r"part-(\d+)-.*-c(\d+)\.txt", name).groups()
    return int(task), int(file)


def write_named(files: DataFrame, folder: str) -> None:
    """One text file for each ``name``, holding its values (column ``value``) in order of ``at``; all in one folder."""
    spark = files.sparkSession
    jvm, fs, where = _hadoop(spark, folder)
    staged = f"{folder}.parts"
    # a file is one task's, as files are
    files.select("name", "at", F.col("value").cast("string").alias("value")).repartition("name").sortWithinPartitions("name", "at").drop("at").write.mode("overwrite").partitionBy("name").text(staged)
    fs.mkdirs(where)
    for found in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{staged}/name=*")):
        name = found.getPath().getName().removeprefix("name=")
        (part,) = fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{found.getPath()}/part-*"))
        fs.rename(part.getPath(), jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}"))
    fs.delete(jvm.org.apache.hadoop.fs.Path(staged), True)
