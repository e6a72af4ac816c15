"""Tree inventory (AGG16-19)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.operators.ground import height_above_ground
from timberline.operators.selection import at_rank, with_group


def tree_tops(points: DataFrame, percentile: float = 99.9, key: str = "tree_id") -> DataFrame:
    """AGG16: (key, pid, x, y, z) the point nearest to each tree's height percentile (nearest rank, half to even).

    Background (0) is no tree; every other label has a row (Q10). Equal
    distances go to the least pid. A tree of any size is counted and searched by partial
    sums and minima; it is never sorted in one place.
    """
    trees = points.where(F.col(key) > 0)
    at = at_rank(trees, key, "z", lambda n: F.rint(F.lit(percentile / 100.0) * (n - 1)))
    near = with_group(trees.select(key, "pid", "x", "y", "z"), at.select(F.col(key).alias("_key"), F.col("z").alias("_pz")), key)
    top = F.min(F.struct(F.abs(F.col("z") - F.col("_pz")).alias("_far"), "pid", "x", "y", "z")).alias("top")
    return near.groupBy(key).agg(top).select(key, "top.pid", "top.x", "top.y", "top.z")


def single_tree_top(points: DataFrame, percentile: float = 99.9) -> DataFrame:
    """AGG17: the top of a cloud that is one tree."""
    return tree_tops(points.withColumn("tree_id", F.lit(1)), percentile).drop("tree_id")


def tree_heights(tops: DataFrame, ground: DataFrame, crop: bool = False) -> DataFrame:
    """AGG18: tops with ``height`` above the nearest ground point; ``crop`` as in Q11."""
    heights = height_above_ground(tops, ground, crop=crop).select("tree_id", F.col("z").alias("height"))
    return tops.join(heights, "tree_id", "left")


def class_probability(points: DataFrame, keys: list[str], target: int | None = None) -> DataFrame:
    """AGG19: mean ``certainty`` of each key, of one class if told."""
    rows = points if target is None else points.where(F.col("class_id") == target)
    return rows.groupBy(*keys).agg(F.avg("certainty").alias("prob"))


def summary(inventory: DataFrame, column: str = "height") -> DataFrame:
    """Count, mean, sample and population deviation and range of one column."""
    return inventory.agg(F.count(column).alias("n"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"), F.stddev_pop(column).alias("std_pop"), F.min(column).alias("least"), F.max(column).alias("most"))
