from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from timberline.functions.scalar import conv_output_shape, kernel_table, learning_rate
from timberline.model import RasterConfig
from timberline.operators import active, detect, projections, segment, training, voxels
from timberline.operators.inventory import summary, tree_tops
from timberline.plans.pipelines import PRESETS, detect_and_report, detect_and_segment


def cloud(spark, xyz, key=1):
    return spark.createDataFrame([(i, *map(float, p), key, i % 4) for i, p in enumerate(xyz)], "pid long, x double, y double, z double, tree_id int, class_id int")


def crowns(seed=0, shift=0.0):
    """Nine cones of 8 m on a slope, with their tops."""
    r = np.random.default_rng(seed)
    g = r.uniform(0, 60, (9000, 2))
    rows, tops = [np.column_stack([g + shift, 0.1 * g[:, 0] + r.uniform(0, 0.05, 9000)])], []
    for k in range(9):
        x, y = 10 + k % 3 * 20, 10 + k // 3 * 20
        d, a = 3 * np.sqrt(r.uniform(0, 1, 900)), r.uniform(0, 2 * np.pi, 900)
        rows.append(np.column_stack([x + d * np.cos(a) + shift, y + d * np.sin(a) + shift, 0.1 * x + 8 - 1.5 * d]))
        rows.append([[x + shift, y + shift, 0.1 * x + 8]])
        tops.append((x + shift, y + shift))
    return np.vstack(rows), tops


@pytest.mark.parametrize("shift", [0.0, -130.0])
def test_planted_crowns_are_reported(spark, shift):
    xyz, tops = crowns(shift=shift)
    config = RasterConfig(["canopy_height"], [1], "rescale", res=0.5, gridSize=(140, 140, 60))
    preset = PRESETS["airborne_low"].__class__(2.0, 70, 70, 5)
    labelled, boxes, report = detect_and_report(cloud(spark, xyz).drop("tree_id"), config, preset, detect.peak_detector(7, 60), confidence=0.2)
    found = report.collect()
    assert boxes.count() == 9 and len(found) == 9
    for x, y in tops:
        near = min(found, key=lambda r: np.hypot(r.x - x, r.y - y))
        assert np.hypot(near.x - x, near.y - y) < 1.5 and 6.5 < near.height < 8.8
    assert labelled.where("tree_id > 0").count() > 4000
    points, _ = detect_and_segment(cloud(spark, xyz).drop("tree_id"), config, preset, segment.HeightRule(), (40, 40, 40), 0.4, detector=detect.peak_detector(7, 60), confidence=0.2)
    assert {r.class_id for r in points.select("class_id").distinct().collect()} <= {1, 2} and points.count() > 4000


def test_no_detections_label_all_zero(spark):
    xyz, _ = crowns()
    config = RasterConfig(["vertical_density"], res=2.0, gridSize=(35, 35, 20))
    labels, boxes = detect.detect_trees(cloud(spark, xyz[:500]), config, 80, 80, detector=lambda image: [])
    assert boxes.count() == 0 and {r.label for r in labels.collect()} == {0}


def test_convolution_equals_numpy(spark):
    r = np.random.default_rng(1)
    dense = np.zeros((15, 12))
    at = r.integers(0, [15, 12], (40, 2))
    dense[tuple(at.T)] = r.uniform(0, 5, 40)
    cells = spark.createDataFrame([(int(i), int(j), float(dense[i, j])) for i, j in np.argwhere(dense > 0)], "ix int, iy int, v double")
    for size, weighted in ((3, True), (5, False), (7, True)):
        kernel = np.zeros((size, size))
        for i, j, w in kernel_table(size, weighted):
            kernel[i + size // 2, j + size // 2] = w
        half = size // 2
        wide = np.pad(dense, half)
        windows = np.lib.stride_tricks.sliding_window_view(wide, (size, size))
        want = np.einsum("xyij,ij->xy", windows, kernel[::-1, ::-1])
        got = np.zeros(dense.shape)
        for c in voxels.convolved(cells, dense.shape, size, [], weighted).collect():
            got[c.ix, c.iy] = c.v
        assert np.allclose(got, want)
        top = np.where(kernel > 0.6, windows, -1).max((2, 3))
        got = np.zeros(dense.shape)
        for c in voxels.neighbourhood_max(cells, dense.shape, size, [], weighted).collect():
            got[c.ix, c.iy] = c.v
        assert np.allclose(got, np.maximum(top, 0))
    assert [sum(w > 0.6 for *_, w in kernel_table(n)) for n in (3, 5, 7, 11)] == [5, 13, 29, 81]


def test_equalised_equals_numpy(spark):
    r = np.random.default_rng(2)
    dense = np.zeros((20, 20))
    dense[r.integers(0, 20, 150), r.integers(0, 20, 150)] = r.uniform(0.5, 4, 150)
    cells = spark.createDataFrame([(int(i), int(j), float(dense[i, j])) for i, j in np.argwhere(dense > 0)], "ix int, iy int, v double")
    count, edges = np.histogram(dense, 256)
    want = np.interp(dense, (edges[:-1] + edges[1:]) / 2, np.cumsum(count) / dense.size)
    for c in voxels.equalised(cells, [], (20, 20)).collect():
        assert c.v == pytest.approx(want[c.ix, c.iy], abs=1e-6)


def test_transposed_convolution_is_the_adjoint():
    r = np.random.default_rng(0)
    for stride, k in ((1, 3), (2, 5)):
        x, w = r.normal(size=(2, 7, 6, 5)), r.normal(size=(3, 2, k, k, k))
        y = segment.conv3d(x, w, stride)
        z = r.normal(size=y.shape)
        back = segment.deconv3d(z, w, x.shape[1:], stride)
        assert np.isclose((y * z).sum(), (x * back).sum())
    p = segment.VoxelNet.random(channels=3)(np.ones((8, 6, 7)))
    assert p.shape == (3, 8, 6, 7) and np.allclose(p.sum(0), 1)


def test_augmentation_keeps_norms_and_copy_zero(spark):
    c = cloud(spark, np.random.default_rng(1).normal(size=(50, 3)))
    fan = training.augmented(c, 2, "tree_id").join(c.select("pid", F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("z").alias("z0")), "pid").collect()
    assert len(fan) == 150
    for r in fan:
        assert r.x**2 + r.y**2 + r.z**2 == pytest.approx(r.x0**2 + r.y0**2 + r.z0**2)
        assert r.copy or (r.x, r.y, r.z) == (r.x0, r.y0, r.z0)
    for parity in (False, True):
        m = projections.rotation(10, 20, 30, parity)
        assert np.allclose(m @ m.T, np.eye(3))
    again = training.augmented(c.repartition(5), 2, "tree_id").orderBy("copy", "pid").collect()
    assert [tuple(r) for r in again] == [tuple(r) for r in training.augmented(c, 2, "tree_id").orderBy("copy", "pid").collect()]


def test_batches_wrap_around(spark):
    items = spark.createDataFrame([(f"c{k}",) for k in range(10)], "cloud_id string")
    rows = training.batch_numbers(items, 4).collect()
    assert sorted((r.batch, r.slot) for r in rows) == [(b, s) for b in range(3) for s in range(4)]
    assert {r.cloud_id for r in rows if r.batch == 2} == {"c8", "c9", "c0", "c1"}


def pool(spark, n=60, d=5, seed=0):
    r = np.random.default_rng(seed)
    codes, probs = r.normal(size=(n, d)), r.uniform(size=n)
    return spark.createDataFrame([(i, codes[i].tolist(), float(probs[i]), i % 3) for i in range(n)], "id long, code array<double>, prob double, label int"), codes, probs


def test_selection(spark, monkeypatch):
    p, codes, probs = pool(spark)
    dist = np.sqrt(((codes[:, None] - codes[None]) ** 2).sum(2))
    monkeypatch.setattr(active, "BLOCK", 16)
    spread = {r.id: r.spread for r in active.mean_distances(p.select("id", "code")).collect()}
    assert all(spread[i] == pytest.approx(dist[i].mean()) for i in range(60))
    want = np.argsort(dist.mean(0) * 0.1 + probs)[:7]
    assert {r.id for r in active.density_weighted(p, 7).collect()} == set(want.tolist())
    ids = {r.id for r in active.medoid_ids_restarted(p, 5, 10, 4).select("id").collect()}
    assert len(ids) == 5 and len({r.id for r in active.cluster_exemplars(p, 6).collect()}) == 6
    medoids, assign, _ = active.k_medoids(codes, probs, 5, 10)
    assert (dist[medoids].argmin(0) == assign).mean() > 0.9


def test_batch_selection_is_exact_when_small(spark):
    p, codes, probs = pool(spark, 12)
    dist = np.sqrt(((codes[:, None] - codes[None]) ** 2).sum(2))
    cost = probs + 0.1 * dist.mean(0)
    best = max(active.batch_value(dist, cost, c, 0.03) for c in combinations(range(12), 3))
    rows = active.select_batch(p, 3).collect()
    assert rows[0].objective == pytest.approx(best) and len(rows) == 3
    greedy = active.select_batch(p, 3, exact_limit=0).collect()
    assert greedy[0].objective == pytest.approx(best, abs=0.02)


def test_batch_selection_is_proven_by_bounds(spark, monkeypatch):
    """Branch and bound finds what trying all choices finds, and bounds what it did not look at."""
    p, codes, probs = pool(spark, 26)
    dist = np.sqrt(((codes[:, None] - codes[None]) ** 2).sum(2))
    for alpha in (0.03, 0.5, 2.0):
        cost = probs + 0.1 * dist.mean(0)
        best = max(active.batch_value(dist, cost, c, alpha) for c in combinations(range(26), 4))
        rows = active.select_batch(p, 4, alpha=alpha, exact_limit=1, gap=True).collect()
        assert len(rows) == 4 and rows[0].exact and rows[0].objective == pytest.approx(best) and rows[0].gap == pytest.approx(0, abs=1e-12)
    monkeypatch.setattr(active, "LOOKED_AT", 1)
    cut = active.select_batch(p, 4, alpha=2.0, exact_limit=1, gap=True).first()
    assert cut.objective <= best + 1e-9 <= cut.objective + cut.gap + 2e-9
    two = active.select_batch(p, 2, exact_limit=1).collect()
    assert two[0].objective == pytest.approx(max(active.batch_value(dist, probs + 0.1 * dist.mean(0), c, 0.03) for c in combinations(range(26), 2)))


def test_empty_and_single(spark):
    none = cloud(spark, np.empty((0, 3)))
    assert tree_tops(none).count() == 0 and voxels.occupancy(projections.voxel_index(none, (4, 4, 4), 1.0)).count() == 0
    one = tree_tops(cloud(spark, [[1, 2, 3]])).collect()
    assert len(one) == 1 and one[0].z == 3 and projections.unit_sphere(cloud(spark, [[1, 2, 3]]), ["tree_id"]).first().x == 0
    s = summary(spark.createDataFrame([(1.0,), (3.0,)], "height double")).first()
    assert (s.n, s.mean, s.std_pop) == (2, 2.0, 1.0)


def test_pure_functions():
    assert conv_output_shape(10, 3, "VALID", 2) == 4 and conv_output_shape(10, 3, "SAME", 2) == 5
    assert learning_rate(25, 1.0, 10, 0.5) == 0.25 and learning_rate(10, 1.0, bounds=[10], values=[0.1]) == 1.0
    with pytest.raises(ValueError):
        conv_output_shape(1, 1, "x", 1)


def test_large_pools_are_treated_like_small_ones(spark, monkeypatch):
    p, codes, _ = pool(spark, 40)
    labelled = p.where("id % 9 = 0").withColumn("label", (F.col("id") % 2).cast("int"))

    def results():
        medoids = sorted(r.id for r in active.medoid_ids(p, 4, 6).collect())
        restarted = sorted(tuple(r) for r in active.medoid_ids_restarted(p, 3, 4, 2).collect())
        batch = sorted(tuple(r) for r in active.select_batch(p, 3, labelled, exact_limit=0).collect())
        return medoids, [i for i, _ in restarted], restarted[0][1], [i for i, _, _ in batch], batch[0][1]

    monkeypatch.setattr(active, "BLOCK", 16)
    small = results()
    monkeypatch.setattr(active, "LOCAL", 5)
    large = results()
    assert small[0] == large[0] and small[1] == large[1] and small[3] == large[3]
    assert small[2] == pytest.approx(large[2]) and small[4] == pytest.approx(large[4])
