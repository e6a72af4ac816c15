"""Spatial joins as grid-keyed equi-joins (JN2, JN3, WIN1-4, SRT3).

A theta join on coordinates would be planned as a nested loop. Here both sides
get integer cells, the join is an equi-join on them, and the exact predicate is
applied again, so plans shuffle, spill and split skew like any other join.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from timberline.operators.graph import checkpointed, numbered


def _all(tests) -> Column:
    return reduce(lambda a, b: a & b, tests)


def bounds(points: DataFrame, columns: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """AGG1: one row with x0, x1, y0, y1 ... of the named columns."""
    return points.agg(*[f(c).alias(f"{c}{k}") for c in columns for k, f in enumerate((F.min, F.max))])


def with_bounds(points: DataFrame, columns: tuple[str, ...] = ("x", "y")) -> DataFrame:
    """Every row with the bounds of the whole frame (one broadcast row)."""
    return points.join(F.broadcast(bounds(points, columns)), F.lit(True))


def points_in_boxes(points: DataFrame, boxes: DataFrame, size: float = 5.0) -> DataFrame:
    """Range join: a row for each point strictly inside each box (columns of both); boxes are spread over their cells."""
    low = lambda c: F.floor(F.col(c) / size).cast("int")
    spread = boxes.withColumn("_cx", F.explode(F.sequence(low("xmin"), low("xmax")))).withColumn("_cy", F.explode(F.sequence(low("ymin"), low("ymax"))))
    if spread.isEmpty():
        return points.join(boxes, F.lit(False))
    keyed = points.withColumns({"_cx": low("x"), "_cy": low("y")})
    inside = (F.col("x") > F.col("xmin")) & (F.col("x") < F.col("xmax")) & (F.col("y") > F.col("ymin")) & (F.col("y") < F.col("ymax"))
    return keyed.join(spread, ["_cx", "_cy"]).where(inside).drop("_cx", "_cy")


def label_points(points: DataFrame, boxes: DataFrame, size: float = 5.0, classes: str | None = None, seed: int | None = None) -> DataFrame:
    """JN2: (pid, label): 1 + the largest bid among the boxes around the point, 0 without one.

    With ``classes`` the label is that column of the last box. Ids are those of
    the boxes (Q8); ``seed`` permutes them, 0 staying 0. No boxes label all 0 (Q19).
    """
    own = F.max_by(F.col(classes) if classes else F.col("bid") + 1, "bid").alias("_own")
    tops = boxes.groupBy("ymin", "xmin", "ymax", "xmax").agg(own, F.max("bid").alias("bid"))  # of copies the last decides
    hits = points_in_boxes(points.select("pid", "x", "y"), tops, size)
    last = hits.groupBy("pid").agg(F.max_by("_own", "bid").alias("label"))
    if seed is not None and not classes:
        order = numbered(boxes.select("bid"), F.xxhash64(F.lit(seed), "bid"), "bid", name="other")
        last = last.join(order.select((F.col("bid") + 1).alias("label"), "other"), "label").select("pid", (F.col("other") + 1).alias("label"))
    return points.select("pid").join(last, "pid", "left").select("pid", F.coalesce(F.col("label"), F.lit(0)).cast("long").alias("label"))


def _progression(first: Column, step: int):
    return lambda k: first + k * step  # a lambda with a second parameter would get the index


def sliding_windows(points: DataFrame, step: int, window: float, cover_all: bool = False) -> DataFrame:
    """JN3, WIN2: (wx, wy, point) of every window a point is strictly inside of.

    Origins start at the bounds truncated towards zero and exclude the truncated
    maximum (Q6); ``cover_all`` starts at the floor and includes the maximum.
    """
    whole = F.floor if cover_all else (lambda c: F.when(c < 0, F.ceil(c)).otherwise(F.floor(c)))
    tests, out = [], with_bounds(points)
    for c in "xy":
        first, stop = whole(F.col(f"{c}0")), (F.floor(F.col(f"{c}1")) + 1 if cover_all else whole(F.col(f"{c}1")))
        low = F.greatest(F.floor((F.col(c) - window - first) / step), F.lit(0))
        high = F.least(F.ceil((F.col(c) - first) / step), F.ceil((stop - first) / step) - 1)
        origins = F.when(low <= high, F.transform(F.sequence(low, F.greatest(low, high)), _progression(first, step))).otherwise(F.array().cast("array<bigint>"))
        out = out.withColumn(f"w{c}", F.explode(origins)).withColumn(f"w{c}", F.col(f"w{c}").cast("long"))
        tests.append((F.col(c) > F.col(f"w{c}")) & (F.col(c) < F.col(f"w{c}") + window))
    return out.where(_all(tests)).drop("x0", "x1", "y0", "y1")


def image_windows(pixels: DataFrame, rows: int, cols: int, step: int, window: tuple[int, int]) -> DataFrame:
    """WIN1: (wrow, wcol, pixel) of every window that lies wholly in the image."""
    out = pixels
    for name, n, w in (("row", rows, window[0]), ("col", cols, window[1])):
        low = F.greatest(F.ceil((F.col(name) - w + 1) / step), F.lit(0))
        high = F.least(F.floor(F.col(name) / step), F.lit((n - w) // step if n >= w else -1))
        out = out.withColumn(f"w{name}", F.explode(F.when(low <= high, F.sequence(low, F.greatest(low, high))).otherwise(F.array().cast("array<bigint>")))).withColumn(f"w{name}", (F.col(f"w{name}") * step).cast("int"))
    return out


def half_overlapping_tiles(points: DataFrame, size: float, keys: list[str] | None = None) -> DataFrame:
    """WIN4: (tx, ty, point) for tiles of ``size`` every half ``size``, half-open, ``ceil(range / hop) - 1`` a side, per key."""
    hop, keys = size / 2.0, keys or []
    edges = points.groupBy(*keys).agg(*[f(c).alias(f"_{c}{k}") for c in "xy" for k, f in enumerate((F.min, F.max))])
    out = points.join(edges, keys) if keys else points.join(F.broadcast(edges), F.lit(True))
    for c in "xy":
        count = F.ceil((F.col(f"_{c}1") - F.col(f"_{c}0")) / hop) - 1
        at = F.floor((F.col(c) - F.col(f"_{c}0")) / hop)
        low, high = F.greatest(at - 2, F.lit(0)), F.least(at + 1, count - 1)
        out = out.withColumn(f"t{c}", F.explode(F.when(low <= high, F.sequence(low, F.greatest(low, high))).otherwise(F.array().cast("array<bigint>"))))
    inside = [(F.col(c) >= F.col(f"_{c}0") + F.col(f"t{c}") * hop) & (F.col(c) < F.col(f"_{c}0") + F.col(f"t{c}") * hop + size) for c in "xy"]
    return out.where(_all(inside)).withColumns({"tx": F.col("tx").cast("int"), "ty": F.col("ty").cast("int")}).drop("_x0", "_x1", "_y0", "_y1")


def tile_spans(points: DataFrame, size: float, key: str) -> DataFrame:
    """(key, tx0, tx1, ty0, ty1, pid, x, y) of the points (key, an int, pid, x, y): the first and last of the :func:`half_overlapping_tiles` that a point lies in, unless in none.

    A row a point, where tiles have up to four. ``key`` has few values, whose bounds are broadcast.
    """
    hop = size / 2.0
    points = points.select(key, "pid", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    edges = points.groupBy(key).agg(*[f(c).alias(f"_{c}{k}") for c in "xy" for k, f in enumerate((F.min, F.max))])
    names = [key, "tx0", "tx1", "ty0", "ty1", "pid", "x", "y"]

    def span(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept, ends = np.ones(batch.num_rows, bool), []
            for c in "xy":
                at, low, high = (batch.column(n).to_numpy(zero_copy_only=False).astype(float) for n in (c, f"_{c}0", f"_{c}1"))
                with np.errstate(invalid="ignore", over="ignore"):
                    cell = np.floor((at - low) / hop)
                    starts = [low + (cell + k) * hop for k in (-2, -1, 0, 1)]
                    first = np.maximum(cell - 2 + sum(at >= s + size for s in starts), 0)
                    last = np.minimum(cell - 3 + sum(at >= s for s in starts), np.ceil((high - low) / hop) - 2)
                    kept &= np.isfinite(cell) & (first <= last)
                ends += [first, last]
            rows = batch.filter(pa.array(kept))
            yield pa.RecordBatch.from_arrays([rows.column(key), *[pa.array(e[kept].astype(np.int32)) for e in ends], *[rows.column(n) for n in names[5:]]], names=names)

    # in numpy: with the view below, Spark's generated method is too long for the JVM to compile
    joined = points.join(F.broadcast(checkpointed(edges)), key)
    return joined.mapInArrow(span, f"{key} int, tx0 int, tx1 int, ty0 int, ty1 int, pid {points.schema['pid'].dataType.simpleString()}, x double, y double")


def closest_pixels(pixels: DataFrame, target: tuple[float, ...], channels: tuple[str, ...]) -> DataFrame:
    """SRT3: all pixels with their squared colour distance, in order of it (then row, column)."""
    d = reduce(lambda a, b: a + b, ((F.col(c) - v) * (F.col(c) - v) for c, v in zip(channels, target, strict=True)))
    return pixels.withColumn("dist", d).orderBy("dist", "row", "col")
