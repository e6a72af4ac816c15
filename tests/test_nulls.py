"""Null coordinates, empty frames and repeated points: each operator's defined result."""

import pytest
from pyspark.sql import functions as F

from timberline.operators import active, boxes, ground, inventory, neighbours, predicates, projections, spatial, stems, voxels
from timberline.plans import pipelines

ROWS = [(k, k % 9 * 1.0, k // 9 * 1.0, k % 4 * 0.5) for k in range(81)] + [(80, 8.0, 8.0, 0.0)]
NULLS = [(100, None, 1.0, 1.0), (101, 1.0, None, 1.0), (102, 1.0, 1.0, None), (103, None, None, None)]
GRID = (10, 10, 10)


def frame(spark, rows):
    return spark.createDataFrame(rows, "pid long, x double, y double, z double").withColumns({"tree_id": F.lit(1), "class_id": F.lit(1), "intensity": F.lit(0.5)})


CLOUD = {
    "grid_minimum": lambda c: ground.grid_minimum(c),
    "grid_lowest_point": lambda c: ground.grid_lowest_point(c),
    "ground_points": lambda c: ground.ground_points(c),
    "remove_ground": lambda c: ground.remove_ground(c, 0.4)[0].select("pid"),
    "flat_minimum": lambda c: ground.flat_minimum(c),
    "export_points": lambda c: ground.export_points(c),
    "running_minimum": lambda c: ground.running_minimum(c),
    "windows": lambda c: spatial.sliding_windows(c, 3, 4).select("pid", "wx", "wy"),
    "tiles": lambda c: spatial.half_overlapping_tiles(c, 4.0).select("pid", "tx", "ty"),
    "crop": lambda c: predicates.crop_rectangle(c, 0, 5, 0, 5).select("pid"),
    "slices": lambda c: predicates.slices(c, 0.0, 2.0, 0.5).select("pid", "slice"),
    "occupancy": lambda c: voxels.occupancy(voxels.voxelised(c, [], GRID, 1.0)),
    "density": lambda c: voxels.vertical_density(voxels.voxelised(c, [], GRID, 1.0, (4.0, 4.0, 1.0)), [], GRID, 3).withColumn("v", F.round("v", 9)),
    "height": lambda c: voxels.max_height(voxels.voxelised(c, [], GRID, 1.0, (4.0, 4.0, 1.0)), [], GRID),
    "downsampled": lambda c: voxels.downsampled(c, 2.0),
    "stacks": lambda c: stems.circle_stacks(c),
    "nearest": lambda c: neighbours.nearest(c, c.where("pid < 9").withColumnRenamed("pid", "gid"), 1).select("pid", "gid"),
}


@pytest.mark.parametrize("name", CLOUD)
def test_points_with_a_null_coordinate_change_nothing(spark, name):
    plain, mixed = (sorted(map(repr, CLOUD[name](frame(spark, rows)).collect())) for rows in (ROWS, ROWS + NULLS))
    if name == "crop":
        mixed = [r for r in mixed if "pid=102" not in r]  # a null height does not take a point out of a plan
    if name == "nearest":
        mixed = [r for r in mixed if "pid=102" not in r]
    if name in ("windows", "tiles"):
        mixed = [r for r in mixed if "pid=102" not in r]
    if name == "slices":
        mixed = [r for r in mixed if "pid=100" not in r and "pid=101" not in r]
    assert mixed == plain
    assert CLOUD[name](frame(spark, [])).isEmpty()


def test_labels_of_points_without_a_place(spark):
    b = spark.createDataFrame([(0, 0.0, 0.0, 9.0, 9.0), (1, None, 0.0, 9.0, 9.0)], "bid long, ymin double, xmin double, ymax double, xmax double")
    got = {r.pid: r.label for r in spatial.label_points(frame(spark, ROWS[:20] + NULLS), b).collect()}
    assert got[100] == got[101] == got[103] == 0 and got[102] == 1 and got[10] == 1


def test_boxes_with_a_null_side(spark):
    b = spark.createDataFrame([(0, 0.0, 0.0, 2.0, 2.0), (1, 1.0, 1.0, 3.0, 3.0), (2, None, 0.0, 2.0, 2.0)], "bid long, ymin double, xmin double, ymax double, xmax double")
    assert [tuple(r) for r in boxes.overlap_pairs(b).collect()] == [(1, 0)]
    assert {tuple(r) for r in boxes.merged_boxes(b).collect()} == {(0.0, 0.0, 3.0, 3.0), (None, 0.0, 2.0, 2.0)}
    assert {r.keep for r in boxes.unique_boxes(b, 5.0).collect()} <= {0, 1}
    for f in (boxes.merged_boxes, lambda x: boxes.merged_boxes(x, parity=True), lambda x: boxes.unique_boxes(x, 1.0), boxes.overlap_pairs):
        assert f(b.limit(0)).count() == 0


def test_circles_with_a_null(spark):
    c = spark.createDataFrame([(0, 0.0, 0.0, 0.2, 1.0, 60), (1, 0.1, 0.0, 0.2, 1.0, 90), (2, None, 0.0, 0.2, 1.0, 50), (3, 0.0, 0.0, None, 1.0, 70)], "cid long, x double, y double, r double, z double, n long")
    assert {r.cid for r in stems.suppressed(c).collect()} == {1, 2, 3}
    assert {tuple(r) for r in stems.overlapping_at_height(c).collect()} == {(0, 0), (1, 1), (0, 1)}
    none = c.limit(0)
    assert stems.suppressed(none).count() == stems.next_up(none).count() == stems.climb(none).count() == 0
    assert stems.merge_stems(stems.climb(none)).count() == 0


def test_empty_pools(spark):
    pool = spark.createDataFrame([], "id long, code array<double>, prob double, label int")
    for got in (active.medoid_ids(pool, 3), active.medoid_ids_restarted(pool, 3, repeats=2), active.cluster_exemplars(pool, 3), active.select_batch(pool, 3), active.mean_distances(pool.select("id", "code")), active.nearest_codes(pool, pool)):
        assert got.count() == 0
    some = spark.createDataFrame([(1, [0.0, 1.0], 0.5, 0), (2, None, 0.5, 0), (3, [0.0, 3.0], 0.1, 1)], "id long, code array<double>, prob double, label int")
    assert {(r.id, r.spread) for r in active.mean_distances(some.select("id", "code")).collect()} == {(1, 1.0), (3, 1.0)}
    assert {(r.id, r.lid) for r in active.nearest_codes(some, some, 1).collect()} == {(1, 1), (3, 3)}


def test_inventory_of_nothing(spark):
    none = frame(spark, [])
    assert pipelines.tree_inventory(none).count() == 0 and inventory.tree_tops(none).count() == 0
    assert projections.unit_sphere(none, ["tree_id"]).count() == 0
