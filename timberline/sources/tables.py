"""Text, binary and annotation formats (SRC1-3, SRC5, SRC8, SRC10-14, SNK1, SNK2, SNK6-8, SNK10-14, SNK16-22)."""

from __future__ import annotations

import json
import os
from collections.abc import Iterator
from dataclasses import asdict
from xml.sax.saxutils import escape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from timberline.model import RasterConfig
from timberline.operators.detect import image_of
from timberline.operators.graph import checkpointed
from timberline.operators.projections import voc_to_yolo
from timberline.sources.files import write_bytes, write_named


#: Blocks of files up to which their first numbers are broadcast.
BROADCAST_BLOCKS = 1 << 16


def _numbered(spark: SparkSession, path: str, delimiter: str, glob: str | None = None) -> DataFrame:
    """Lines of text files as (cloud_id, pid, f array<string>); pid counts a file's lines from 0, blank ones left out.

    Files are split and read by blocks. A line's number is its place in its block and the
    lines of the file's blocks before it, which are counted by a first pass over the files.
    """
    reader = spark.read.option("pathGlobFilter", glob) if glob else spark.read
    file, block = F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block")
    name = F.url_decode(F.regexp_replace(F.col("_metadata.file_name"), r"\+", "%2B"))  # names come as parts of URIs
    lines = reader.text(path).select("value", file, block, name.alias("cloud_id")).where(F.col("value").rlike(r"\S"))
    lines = lines.withColumn("_place", F.monotonically_increasing_id())  # goes up by one inside a block
    blocks = lines.groupBy("_file", "_block").agg(F.min("_place").alias("_start"), F.count("*").alias("_lines"))
    before = F.sum("_lines").over(Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = checkpointed(blocks.select(F.col("_file").alias("_f"), F.col("_block").alias("_b"), (F.coalesce(before, F.lit(0)) - F.col("_start")).alias("_shift")))
    few = blocks.limit(BROADCAST_BLOCKS + 1).count() <= BROADCAST_BLOCKS
    out = lines.join(F.broadcast(blocks) if few else blocks, (F.col("_file") == F.col("_f")) & (F.col("_block") == F.col("_b")))
    pattern = r"\s+" if delimiter == " " else "\\Q" + delimiter + "\\E"
    fields = F.transform(F.split(F.regexp_replace("value", r"^\s+|\s+$", ""), pattern), lambda v: F.trim(F.regexp_replace(v, r"^\||\|$", "")))
    return out.select("cloud_id", (F.col("_place") + F.col("_shift")).alias("pid"), fields.alias("f"))


def read_xyz(spark: SparkSession, path: str, delimiter: str = " ", x: int = 0, y: int = 1, z: int = 2, label: int | None = None, returns: int | None = None, other: tuple[int, ...] = (), glob: str | None = None) -> DataFrame:
    """SRC1, SRC2, SRC8: points from columns by position; no header. Others come as c<number>.

    A folder gives one frame with the file's name as cloud_id.
    """
    pick = lambda k: F.get(F.col("f"), F.lit(k)).cast("double")
    columns = [pick(x).alias("x"), pick(y).alias("y"), pick(z).alias("z")]
    columns += [pick(returns).alias("ret")] if returns is not None else []
    columns += [pick(label).alias("label")] if label is not None else []
    return _numbered(spark, path, delimiter, glob).select("cloud_id", "pid", *columns, *[pick(k).alias(f"c{k}") for k in other])


def read_large_xyz(spark: SparkSession, path: str, names: list[str], delimiter: str = " ") -> DataFrame:
    """SRC1 for files too large for one task: split by Spark's CSV reader; pid is (block, place in block) as one number and so unique, not contiguous."""
    schema = T.StructType([T.StructField(n, T.DoubleType()) for n in names])
    return spark.read.csv(path, sep=delimiter, quote="|", schema=schema).withColumn("pid", F.monotonically_increasing_id())


def read_off(spark: SparkSession, path: str, delimiter: str = " ") -> DataFrame:
    """SRC5: the first line is a count, then as many rows of x, y, z."""
    rows = _numbered(spark, path, delimiter).where(F.col("pid") > 0)
    return rows.select("cloud_id", (F.col("pid") - 1).alias("pid"), *[F.get("f", F.lit(k)).cast("double").alias(c) for k, c in enumerate("xyz")])


def read_bin(spark: SparkSession, path: str, names: list[str], formats: list[str], wanted: list[str] | None = None) -> DataFrame:
    """SRC3: fixed records of numpy ``formats``; only ``wanted`` fields are kept. A file is read by one task."""
    kind = np.dtype({"names": names, "formats": formats})
    kept = wanted or names
    schema = ", ".join(f"{n} double" for n in kept)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for data in pdf["content"]:
                raw = np.frombuffer(bytes(data), kind)
                yield pd.DataFrame({"pid": np.arange(len(raw)), **{n: raw[n].astype(float) for n in kept}})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, f"pid long, {schema}")


def read_numeric(spark: SparkSession, path: str, header_rows: tuple[int, ...] = (), delimiter: str = ",") -> tuple[DataFrame, DataFrame]:
    """SRC10: (header rows as text, data rows as numbers), both (pid, f)."""
    rows = _numbered(spark, path, delimiter).select("pid", "f")
    head = rows.where(F.col("pid").isin(*header_rows)) if header_rows else rows.where(F.lit(False))
    data = rows.where(~F.col("pid").isin(*header_rows)) if header_rows else rows
    return head, data.select("pid", F.transform("f", lambda v: v.cast("double")).alias("f"))


def read_config(spark: SparkSession, path: str) -> DataFrame:
    """SRC11: a JSON configuration as a row."""
    return spark.read.json(path, multiLine=True)


VOC = T.StructType(
    [
        T.StructField("size", T.StructType([T.StructField("width", T.DoubleType()), T.StructField("height", T.DoubleType())])),
        T.StructField("object", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("difficult", T.IntegerType()), T.StructField("bndbox", T.StructType([T.StructField(c, T.DoubleType()) for c in ("xmin", "ymin", "xmax", "ymax")]))]))),
    ]
)


def read_voc(spark: SparkSession, path: str, classes: list[str]) -> DataFrame:
    """SRC12: (file, class_id, cx, cy, w, h) of annotated objects; unknown classes and difficult ones are left out."""
    rows = spark.read.format("xml").option("rowTag", "annotation").schema(VOC).load(path)
    objects = rows.select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file"), "size.width", "size.height", F.explode("object").alias("o"))
    known = objects.where(F.col("o.name").isin(classes) & (F.coalesce("o.difficult", F.lit(0)) != 1))
    number = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("o.name")) - 1
    return voc_to_yolo(known.select("file", "width", "height", number.cast("int").alias("class_id"), "o.bndbox.*")).select("file", "class_id", "cx", "cy", "w", "h")


def write_yolo(labels: DataFrame, folder: str) -> None:
    """UDF15: one text file a ``file`` (its ending replaced by .txt) with a line "class cx cy w h" an object."""
    line = F.concat_ws(" ", *[F.col(c).cast("string") for c in ("class_id", "cx", "cy", "w", "h")])
    write_named(labels.select(F.concat(F.regexp_replace("file", r"\.[^.]*$", ""), F.lit(".txt")).alias("name"), line.alias("at"), line.alias("value")), folder)


def read_ppm(spark: SparkSession, path: str) -> DataFrame:
    """SRC13: pixels (file, row, col, red, green, blue) of binary PPM images."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                head = bytes(data).split(maxsplit=4)
                if head[0] != b"P6":
                    raise ValueError(f"{name} is not a binary PPM")
                w, h = int(head[1]), int(head[2])
                v = np.frombuffer(bytes(data)[-w * h * 3 :], np.uint8).reshape(h * w, 3)
                yield pd.DataFrame({"file": os.path.basename(name), "row": np.repeat(np.arange(h), w), "col": np.tile(np.arange(w), h), "red": v[:, 0], "green": v[:, 1], "blue": v[:, 2]})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, row int, col int, red int, green int, blue int")


def ppm_bytes(image: np.ndarray) -> bytes:
    """One uint8 image (rows, columns, 3) as a binary PPM."""
    return f"P6 {image.shape[1]} {image.shape[0]} 255\n".encode() + np.ascontiguousarray(image, np.uint8).tobytes()


def write_ppm(image: np.ndarray, path: str) -> None:
    """SNK19 on this machine: one image."""
    with open(path, "wb") as f:
        f.write(ppm_bytes(image))


def write_raster(layers: DataFrame, config: RasterConfig, folder: str) -> None:
    """SNK19: ``raster.ppm`` of one window's or cloud's layers (layer, row, col, v) and ``raster_config.json`` beside it; the grid bounds the image."""
    spark = layers.sparkSession
    image = image_of(layers.select("layer", "row", "col", "v").toPandas(), config)
    write_bytes(spark, f"{folder}/raster.ppm", ppm_bytes(image))
    write_bytes(spark, f"{folder}/raster_config.json", json.dumps(asdict(config)).encode())


def plot_metrics(metrics: DataFrame, path: str, width: int = 640, height: int = 400) -> None:
    """SNK22: the metrics table (epoch, name, value) drawn as one line a name into an SVG file; a row an epoch and name, so it is small."""
    rows = metrics.where(F.col("value").isNotNull()).groupBy("name", "epoch").agg(F.avg("value").alias("value")).orderBy("name", "epoch").collect()
    lo, hi = (min((r["value"] for r in rows), default=0.0), max((r["value"] for r in rows), default=1.0))
    first, last = (min((r["epoch"] for r in rows), default=0), max((r["epoch"] for r in rows), default=1))
    lines = []
    for k, name in enumerate(sorted({r["name"] for r in rows})):
        at = [(40 + (r["epoch"] - first) / max(1, last - first) * (width - 60), height - 30 - (r["value"] - lo) / ((hi - lo) or 1.0) * (height - 60)) for r in rows if r["name"] == name]
        colour = f"hsl({k * 137 % 360},70%,40%)"
        lines.append(f'<polyline fill="none" stroke="{colour}" points="{" ".join(f"{x:.1f},{y:.1f}" for x, y in at)}"/><text x="50" y="{20 + 16 * k}" fill="{colour}">{escape(name)}</text>')
    text = f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}">{"".join(lines)}<text x="5" y="30">{hi:.4g}</text><text x="5" y="{height - 30}">{lo:.4g}</text></svg>'
    write_bytes(metrics.sparkSession, path, text.encode())


def write_lists(split: DataFrame, folder: str, pattern: str = "{}.txt") -> None:
    """UDF15: ``train.txt`` and ``test.txt`` (a file a ``part``) with one item's file name a line, in order of cloud_id."""
    before, after = pattern.split("{}")
    rows = split.select(F.concat("part", F.lit(".txt")).alias("name"), F.col("cloud_id").alias("at"), F.concat(F.lit(before), F.col("cloud_id").cast("string"), F.lit(after)).alias("value"))
    write_named(rows, folder)


def write_xyz(points: DataFrame, folder: str, delimiter: str = " ", label: str | None = None, ret: str | None = None) -> None:
    """SNK1, SNK2: x, y, z[, return][, label] without a header."""
    points.select("x", "y", "z", *([ret] if ret else []), *([label] if label else [])).write.mode("overwrite").csv(folder, sep=delimiter, header=False)


def write_table(rows: DataFrame, folder: str, header: bool = True) -> None:
    """SNK10-12: a CSV with one header field a column (Q15)."""
    rows.write.mode("overwrite").csv(folder, header=header)


def swapped_stem_points(points: DataFrame, parity: bool = False) -> DataFrame:
    """SNK16: X, Y, Z of stem points; ``parity`` puts z under Y and y under Z (Q21)."""
    y, z = ("z", "y") if parity else ("y", "z")
    return points.select(F.col("x").alias("X"), F.col(y).alias("Y"), F.col(z).alias("Z"))


def voxel_indices(voxels: DataFrame) -> DataFrame:
    """SNK18: ix, iy, iz, 1 for every point."""
    return voxels.select("ix", "iy", "iz", F.lit(1).alias("one"))


def save_boxes(boxes: DataFrame, path: str) -> None:
    """SNK20."""
    boxes.write.mode("overwrite").parquet(path)


def load_boxes(spark: SparkSession, path: str) -> DataFrame:
    """SRC14."""
    return spark.read.parquet(path)


def stage(df: DataFrame, path: str) -> DataFrame:
    """SNK21: a stage's rows, written and read again."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def append_metrics(spark: SparkSession, path: str, epoch: int, values: dict[str, float]) -> DataFrame:
    """SNK22: (epoch, name, value) rows added to a metrics table, which is returned."""
    spark.createDataFrame([(epoch, k, float(v)) for k, v in values.items()], "epoch int, name string, value double").write.mode("append").parquet(path)
    return spark.read.parquet(path)


def save_config(config: dict, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        json.dump(config, f)
