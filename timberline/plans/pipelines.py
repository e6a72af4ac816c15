"""End-to-end plans: detection with inventory, segmentation, and stem extraction without learning."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.model import RasterConfig
from timberline.operators import inventory, stems
from timberline.operators.detect import Detector, detect_trees
from timberline.operators.graph import checkpointed
from timberline.operators.ground import above_ground, ground_grid, ground_points, remove_ground
from timberline.operators.projections import colour_components, onto_components
from timberline.operators.segment import Scorer, segment
from timberline.operators.spatial import label_points
from timberline.operators.voxels import downsampled


@dataclass(frozen=True)
class Preset:
    """Settings of one sensor."""

    thresh: float
    window: float
    step: int
    overlap: float


#: Fixed values, presets by density of the sensor: high- and low-density airborne, under canopy, photogrammetry of seedlings.
PRESETS = {"airborne_high": Preset(2.0, 100, 80, 5), "airborne_low": Preset(2.0, 50, 40, 5), "under_canopy": Preset(2.0, 22, 15, 3), "seedlings": Preset(0.5, 25, 23, 1)}


def tree_inventory(labelled: DataFrame, ground: DataFrame | None = None, percentile: float = 99.9, crop: bool = False) -> DataFrame:
    """(tree_id, x, y, z[, height]) of every labelled tree."""
    tops = inventory.tree_tops(labelled, percentile).drop("pid")
    if ground is None:
        return tops
    keyed = tops.withColumn("pid", F.col("tree_id").cast("long"))
    return inventory.tree_heights(keyed, ground, crop).drop("pid")


def detect_and_report(points: DataFrame, config: RasterConfig, preset: Preset, detector: Detector | None = None, heights: bool = True, confidence: float = 0.5, colours: tuple[str, ...] = ("intensity",)) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(labelled points, boxes, inventory): ground removal, windows, detection, labels, tops and heights; ``colours`` are the columns of the colour layers."""
    kept, ground = remove_ground(points, preset.thresh)
    kept = checkpointed(kept)
    labels, boxes = detect_trees(kept, config, preset.window, preset.step, preset.overlap, ground=ground, detector=detector, confidence=confidence, colours=colours)
    labelled = kept.join(labels.withColumnRenamed("label", "tree_id"), "pid")
    return labelled, boxes, tree_inventory(labelled, ground if heights else None)


def detect_and_segment(points: DataFrame, config: RasterConfig, preset: Preset, scorer: Scorer, grid: tuple[int, int, int] = (150, 150, 100), res: float = 0.1, label_thresh: float = 1.0, detector: Detector | None = None, passes: int = 1, confidence: float = 0.5, colours: tuple[str, ...] = ("intensity",)) -> tuple[DataFrame, DataFrame]:
    """(segmented points, inventory): detection on the cloud above ``preset.thresh``, labels and segmentation above ``label_thresh``; one ground model serves both."""
    ground = checkpointed(ground_points(points))
    surface = checkpointed(ground_grid(points, ground))
    high, low = (checkpointed(above_ground(points, surface, t)) for t in (preset.thresh, label_thresh))
    _, boxes = detect_trees(high, config, preset.window, preset.step, preset.overlap, ground=ground, detector=detector, confidence=confidence, colours=colours)
    labelled = low.join(label_points(low, boxes).withColumnRenamed("label", "tree_id"), "pid").where(F.col("tree_id") > 0)
    return segment(labelled, grid, res, scorer, passes), tree_inventory(labelled, ground)


def detect_seedlings(points: DataFrame, config: RasterConfig, preset: Preset = PRESETS["seedlings"], detector: Detector | None = None, channels: tuple[str, ...] = ("red", "green", "blue"), confidence: float = 0.5) -> tuple[DataFrame, DataFrame, DataFrame]:
    """As :func:`detect_and_report`, with the colour layers 1 and 2 taken from the two main colour components of the cloud (PRJ19), for plants that differ from the ground by colour more than by height.

    Points without a colour count as of mean colour.
    """
    mean, axes = colour_components(points, channels)
    held = points.withColumns({c: F.coalesce(F.col(c), F.lit(m)) for c, m in zip(channels, mean, strict=True)})
    return detect_and_report(onto_components(held, mean, axes, channels), config, preset, detector, confidence=confidence, colours=("pc1", "pc2"))


def tree_certainty(labelled: DataFrame, grid: tuple[int, int, int], res: float, scorer: Scorer, target: int, ground: DataFrame | None = None, passes: int = 20) -> DataFrame:
    """(tree_id, x, y, z[, height], prob, n): the inventory of trees with the mean certainty of their points of class ``target`` over ``passes`` scorings (AGG19 after UDF7).

    Trees without such a point have a null ``prob`` and n = 0; points of tree 0 or of none belong to no tree.
    """
    trees = labelled.where(F.col("tree_id") > 0)
    hit = checkpointed(segment(trees, grid, res, scorer, passes).where(F.col("class_id") == target))
    prob = inventory.class_probability(hit, ["tree_id"]).join(hit.groupBy("tree_id").agg(F.count("*").alias("n")), "tree_id")
    return tree_inventory(trees, ground).join(prob, "tree_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def extract_stems(points: DataFrame, low: float = 0.0, high: float = 10.0, dh: float = 0.2, voxel: float = 0.05) -> tuple[DataFrame, DataFrame]:
    """(rings, stem points): downsampling, circles by slice, suppression, climbing, merging, and the points in the rings' shells."""
    thinned = checkpointed(downsampled(points, voxel))
    circles = checkpointed(stems.suppressed(checkpointed(stems.circle_stacks(thinned, dh, low, high))))
    trees = checkpointed(stems.merge_stems(checkpointed(stems.climb(circles))))
    return trees, stems.stem_points(thinned, trees)
