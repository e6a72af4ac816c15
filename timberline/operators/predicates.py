"""Filters (FLT1-12): crops, masks and thresholds. All inequalities are strict, as in the crops they replace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_rectangle(xmin: float, xmax: float, ymin: float, ymax: float) -> Column:
    """FLT2: whether a point lies strictly inside the rectangle."""
    return (F.col("x") > xmin) & (F.col("x") < xmax) & (F.col("y") > ymin) & (F.col("y") < ymax)


def crop_rectangle(points: DataFrame, xmin: float, xmax: float, ymin: float, ymax: float) -> DataFrame:
    """FLT1: points strictly inside the rectangle; none give an empty frame."""
    return points.where(in_rectangle(xmin, xmax, ymin, ymax))


def crop_annulus(points: DataFrame, x: float, y: float, outer: float, inner: float = 0.0) -> DataFrame:
    """FLT3: points strictly between two radii; the centre itself is outside even if ``inner`` is 0."""
    d2 = (F.col("x") - x) * (F.col("x") - x) + (F.col("y") - y) * (F.col("y") - y)
    return points.where((d2 < outer * outer) & (d2 > inner * inner))


def square_boxes(boxes: DataFrame, thresh: float) -> DataFrame:
    """FLT5: boxes whose height and width differ by less than ``thresh`` of the width; degenerate ones go."""
    return boxes.where(F.abs(1 - (F.col("ymax") - F.col("ymin")) / (F.col("xmax") - F.col("xmin"))) < thresh)


def boxes_overlap(a: str, b: str) -> Column:
    """FLT6: closed overlap of the boxes under two aliases."""
    return (F.col(f"{a}.ymin") <= F.col(f"{b}.ymax")) & (F.col(f"{b}.ymin") <= F.col(f"{a}.ymax")) & (F.col(f"{a}.xmin") <= F.col(f"{b}.xmax")) & (F.col(f"{b}.xmin") <= F.col(f"{a}.xmax"))


def confident(boxes: DataFrame, least: float) -> DataFrame:
    """FLT7: boxes whose class score is over ``least``."""
    return boxes.where(F.col("score") > least)


def of_class(boxes: DataFrame, class_id: int) -> DataFrame:
    """FLT8: boxes of one class."""
    return boxes.where(F.col("class_id") == class_id)


def slices(points: DataFrame, low: float, high: float, step: float) -> DataFrame:
    """FLT9 and WIN3: (slice, points) of the ``int((high - low) / step)`` slices; points on a slice's edge are in none."""
    count = int((high - low) / step)
    s = F.floor((F.col("z") - low) / step).cast("int")
    return points.withColumn("slice", s).where((F.col("slice") >= 0) & (F.col("slice") < count) & (F.col("z") > low + F.col("slice") * step) & (F.col("z") < low + (F.col("slice") + 1) * step))


def nearer_than(points: DataFrame, limit: float, distance: str = "dist") -> DataFrame:
    """FLT11: rows with a distance strictly under ``limit``; infinity keeps all that have one."""
    return points.where(F.col(distance) < F.lit(float(limit))) if limit != float("inf") else points.where(F.col(distance).isNotNull())


def labelled(points: DataFrame, label: str = "tree_id") -> DataFrame:
    """FLT12: points of some tree, still one frame keyed by the label."""
    return points.where(F.col(label) > 0)
