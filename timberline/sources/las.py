"""LAS point clouds (SRC6, SRC7, SNK5): a Spark data source split by record ranges, and a writer."""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from timberline.sources.files import write_blobs

RECORDS = 500_000
#: Bytes of one part of a file that is written.
PART_BYTES = 1 << 24
_CORE = [("X", "<i4"), ("Y", "<i4"), ("Z", "<i4"), ("intensity", "<u2")]
_OLD = [*_CORE, ("flags", "u1"), ("classification", "u1"), ("scan_angle", "i1"), ("user_data", "u1"), ("pt_src_id", "<u2")]
_NEW = [*_CORE, ("returns", "u1"), ("flags", "u1"), ("classification", "u1"), ("user_data", "u1"), ("scan_angle", "<i2"), ("pt_src_id", "<u2"), ("gps_time", "<f8")]
_TIME, _RGB = [("gps_time", "<f8")], [("red", "<u2"), ("green", "<u2"), ("blue", "<u2")]
#: Fields of the point formats, in file order.
FORMATS = {0: _OLD, 1: _OLD + _TIME, 2: _OLD + _RGB, 3: _OLD + _TIME + _RGB, 6: _NEW, 7: _NEW + _RGB, 8: [*_NEW, *_RGB, ("nir", "<u2")]}
SCHEMA = "cloud_id string, pid long, x double, y double, z double, intensity double, red double, green double, blue double, classification int, pt_src_id int"


def header(data: bytes) -> dict:
    """Offsets, format, count, scale and offset of a LAS file's first 375 bytes."""
    if data[:4] != b"LASF":
        raise ValueError("not a LAS file")
    major, minor = data[24], data[25]
    start = struct.unpack_from("<I", data, 96)[0]
    kind, size, count = struct.unpack_from("<BHI", data, 104)
    if (major, minor) >= (1, 4) and not count:
        count = struct.unpack_from("<Q", data, 247)[0]
    if kind & 0x3F not in FORMATS or kind & 0x80:
        raise ValueError(f"point format {kind} is not supported")
    numbers = struct.unpack_from("<6d", data, 131)
    return {"start": start, "format": kind & 0x3F, "size": size, "count": count, "scale": numbers[:3], "offset": numbers[3:]}


def record_type(h: dict) -> np.dtype:
    fields = FORMATS[h["format"]]
    known = np.dtype(fields).itemsize
    if h["size"] < known:
        raise ValueError("records are shorter than their format")
    return np.dtype([*fields, ("extra", f"V{h['size'] - known}")]) if h["size"] > known else np.dtype(fields)


def _batch(raw: np.ndarray, h: dict, cloud: str, first: int, schema: pa.Schema) -> pa.RecordBatch:
    n = len(raw)
    columns: dict[str, pa.Array] = {"cloud_id": pa.array([cloud] * n), "pid": pa.array(np.arange(first, first + n))}
    for c, s, o in zip("xyz", h["scale"], h["offset"], strict=True):
        columns[c] = pa.array(raw[c.upper()] * s + o)
    for c in ("intensity", "red", "green", "blue"):
        columns[c] = pa.array(raw[c].astype(float)) if c in raw.dtype.names else pa.nulls(n, pa.float64())
    for c in ("classification", "pt_src_id"):
        columns[c] = pa.array(raw[c].astype(np.int32))
    return pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in schema], schema=schema)


class _Range(InputPartition):
    def __init__(self, path: str, first: int, count: int, base: int):
        self.path, self.first, self.count, self.base = path, first, count, base


class _LasReader(DataSourceReader):
    def __init__(self, schema: StructType, options: dict):
        from pyspark.sql.pandas.types import to_arrow_schema

        self.schema, self.options = to_arrow_schema(schema), options

    def partitions(self) -> list[_Range]:
        path, out, base = self.options["path"].removeprefix("file:"), [], 0
        paths = sorted(os.path.join(path, f) for f in os.listdir(path) if f.lower().endswith(".las")) if os.path.isdir(path) else [path]
        each = int(self.options.get("records", RECORDS))
        for p in paths:
            with open(p, "rb") as f:
                n = header(f.read(375))["count"]
            out += [_Range(p, k, min(each, n - k), base + k) for k in range(0, n, each)]
            base += n
        return out or [_Range(paths[0], 0, 0, 0)] if paths else []

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        with open(part.path, "rb") as f:
            h = header(f.read(375))
            f.seek(h["start"] + part.first * h["size"])
            raw = np.frombuffer(f.read(part.count * h["size"]), record_type(h))
        yield _batch(raw, h, os.path.basename(part.path), part.base, self.schema)


class LasSource(DataSource):
    """``spark.read.format("las").load(path)``: a file or a folder of files on storage that all executors mount.

    ``pid`` counts records through the files in order of their names; tasks
    read ranges of ``records`` records; only asked-for columns are built.
    """

    @classmethod
    def name(cls) -> str:
        return "las"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> _LasReader:
        return _LasReader(schema, self.options)


def read_las(spark: SparkSession, path: str, records: int = RECORDS) -> DataFrame:
    """SRC6, SRC7: points of a LAS file or folder; coordinates are integers times scale plus offset."""
    spark.dataSource.register(LasSource)
    return spark.read.format("las").option("records", records).load(path)


def read_las_store(spark: SparkSession, path: str) -> DataFrame:
    """SRC6 from storage that only Spark reads: each file (2 GB at most) is one row of ``binaryFile``; pid counts within a file."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(spark.createDataFrame([], SCHEMA).schema)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                h = header(data[:375])
                raw = np.frombuffer(data, record_type(h), h["count"], h["start"])
                for k in range(0, len(raw), 100_000):
                    yield _batch(raw[k : k + 100_000], h, os.path.basename(name), k, schema)

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.las").load(path).select("path", "content").mapInArrow(parse, SCHEMA)


def write_las(points: DataFrame, path: str, label: str | None = None, offset: tuple[float, float, float] = (0.0, 0.0, 0.0), scale: float = 0.001) -> None:
    """SNK5: one LAS 1.2 file (point format 2) in order of pid; records are made by the executors as parts of ``PART_BYTES`` and joined as streams.

    ``label`` goes to ``pt_src_id``; ``offset`` is added to the coordinates of
    the file, not to the frame; the header's offset is the floor of the least
    coordinates. Points with a null coordinate have no place in a file and are left out.
    """
    points = points.where(F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull())
    b = points.agg(F.count("*").alias("n"), *[f(c) for c in "xyz" for f in (F.min, F.max)]).first()
    n, lo, hi = b[0], [(b[k] or 0.0) + o for k, o in zip((1, 3, 5), offset, strict=True)], [(b[k] or 0.0) + o for k, o in zip((2, 4, 6), offset, strict=True)]
    base = [float(np.floor(v)) for v in lo]
    head = bytearray(227)
    struct.pack_into("<4s", head, 0, b"LASF")
    head[24:26] = bytes((1, 2))
    struct.pack_into("<HII", head, 94, 227, 227, 0)
    struct.pack_into("<BHI", head, 104, 2, 26, n)
    struct.pack_into("<I", head, 111, n)
    struct.pack_into("<6d", head, 131, scale, scale, scale, *base)
    struct.pack_into("<6d", head, 179, *[v for pair in zip(hi, lo, strict=True) for v in pair])
    kind = np.dtype(FORMATS[2])
    pick = lambda c: F.coalesce(F.col(c), F.lit(0)) if c in points.columns else F.lit(0)
    colours = ("intensity", "red", "green", "blue")
    wanted = points.select("pid", "x", "y", "z", *[pick(c).cast("double").alias(c) for c in colours], F.coalesce(F.col(label) if label else F.lit(0), F.lit(0)).cast("int").alias("pt_src_id")).orderBy("pid")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = lambda held: pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["value"])
        held: list[bytes] = []
        for batch in batches:
            raw = np.zeros(batch.num_rows, kind)
            for k, c in enumerate("xyz"):
                raw[c.upper()] = np.rint((batch.column(c).to_numpy() + offset[k] - base[k]) / scale)
            for c in (*colours, "pt_src_id"):
                raw[c] = np.clip(batch.column(c).to_numpy(), 0, 65535)
            held.append(raw.tobytes())
            if sum(map(len, held)) >= PART_BYTES:
                yield part(held)
                held = []
        if held:
            yield part(held)

    write_blobs(wanted.mapInArrow(records, "value binary"), path, bytes(head))
