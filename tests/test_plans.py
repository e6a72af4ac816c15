"""Whole plans: colour layers from components, certainty by tree."""

import numpy as np
import pytest

from timberline.model import RasterConfig
from timberline.operators import detect, segment
from timberline.plans import pipelines


def test_seedlings_are_found_by_colour_alone(spark):
    """All plants have one height; the redder patch is the only box, and a point without colour is no error."""
    rows, pid = [], 0
    for x in np.arange(0.1, 24, 0.4):
        for y in np.arange(0.1, 24, 0.4):
            red = 0.9 if abs(x - 12) < 1 and abs(y - 8) < 1 else 0.2
            for z in (0.0, 1.0):
                rows.append((pid, float(x), float(y), z, 0.5, None if pid == 7 else red, 0.3, 0.3))
                pid += 1
    cloud = spark.createDataFrame(rows, "pid long, x double, y double, z double, intensity double, red double, green double, blue double")
    config = RasterConfig(["max_colour1"], [1], "rescale", res=0.5, gridSize=(48, 48, 20))
    preset = pipelines.Preset(0.5, 24, 24, 3.0)
    labelled, boxes, report = pipelines.detect_seedlings(cloud, config, preset, detect.peak_detector(3, 250), confidence=0.1)
    boxes = boxes.collect()
    assert boxes and all(abs((b.ymin + b.ymax) / 2 - 8) < 2.5 and abs((b.xmin + b.xmax) / 2 - 12) < 2.5 for b in boxes)
    assert {r.tree_id for r in report.collect()} <= {r.tree_id for r in labelled.collect()}


def test_certainty_by_tree(spark):
    """The mean of the points of one class; trees without any keep their row."""
    rng = np.random.default_rng(2)
    rows = [(i, *map(float, rng.uniform(0, (2, 2, 8))), i % 3) for i in range(900)] + [(900, 50.0, 50.0, 1.0, 4), (901, 0.0, 0.0, 0.0, None)]
    trees = spark.createDataFrame(rows, "pid long, x double, y double, z double, tree_id int")
    got = {r.tree_id: r for r in pipelines.tree_certainty(trees, (10, 10, 10), 1.0, segment.HeightRule(), 2, passes=3).collect()}
    points = segment.segment(trees.where("tree_id > 0"), (10, 10, 10), 1.0, segment.HeightRule(), 3).toPandas()
    want = points[points["class_id"] == 2].groupby("tree_id")["certainty"].agg(["mean", "size"])
    assert sorted(got) == [1, 2, 4] and {1, 2} <= set(want.index)
    for tree, r in got.items():
        if tree in want.index:
            assert r.prob == pytest.approx(want.loc[tree, "mean"]) and r.n == want.loc[tree, "size"]
        else:
            assert r.prob is None and r.n == 0


def test_heights_are_found_only_for_a_layer_of_them(spark, monkeypatch):
    from timberline.model import RasterConfig
    from timberline.operators import detect

    asked, whole = [], detect.height_above_ground
    monkeypatch.setattr(detect, "height_above_ground", lambda *a, **k: asked.append(1) or whole(*a, **k))
    points = spark.range(20).selectExpr("id AS pid", "id * 0.4D AS x", "id * 0.3D AS y", "id * 0.1D AS z", "1 AS tree_id")
    ground = spark.sql("SELECT 0 AS ix, 0 AS iy, 1.0D AS gx, 1.0D AS gy, 0.0D AS gz")
    layers = lambda *names: {tuple(r) for r in detect.rasters(points, RasterConfig(list(names), [1] * len(names), "rescale", res=0.5, gridSize=(20, 20, 20)), ["tree_id"], ground).collect()}
    assert layers("vertical_density", "max_height") and not asked
    assert layers("canopy_height") and asked
