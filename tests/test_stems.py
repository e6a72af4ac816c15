import numpy as np
import pyarrow as pa
import pytest

from timberline.operators import circles, stems
from timberline.plans.pipelines import extract_stems


def forest(seed=0):
    """12 vertical stems 10 m tall, three metres or more apart."""
    r = np.random.default_rng(seed)
    truth, rows = [], []
    for k in range(12):
        x, y, radius = (k % 4) * 3.5, k // 4 * 3.5, 0.1 + 0.3 * k / 11
        truth.append((x, y, radius))
        z = np.arange(0.01, 10, 0.2 / 80)
        a = r.uniform(0, 2 * np.pi, len(z))
        rows.append(np.column_stack([x + radius * np.cos(a), y + radius * np.sin(a), z]))
    return truth, np.vstack(rows)


def test_planted_stems_are_found(spark):
    truth, xyz = forest()
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xyz)], "pid long, x double, y double, z double")
    trees, shell = extract_stems(points, 0.0, 4.0, 0.2, voxel=0.005)
    places = {(r.x, r.y): r for r in stems.locations(trees).collect()}
    found = [min((np.hypot(x - p[0], y - p[1]), p) for p in places) for x, y, _ in truth]
    # stems on the outer edge of the grid can miss the last half tile
    assert sum(d < 0.05 for d, _ in found) >= 5
    radius = {r.tree_id: r.m for r in trees.groupBy("tree_id").agg({"r": "avg"}).withColumnRenamed("avg(r)", "m").collect()}
    for (x, y, rad), (d, p) in zip(truth, found, strict=True):
        if d < 0.05:
            assert abs(radius[places[p].tree_id] - rad) < 0.02
    assert shell.count() > 0


def test_circle_fits():
    r = np.random.default_rng(1)
    a = r.uniform(0, 2 * np.pi, 400)
    xy = np.column_stack([3 + 0.2 * np.cos(a), -1 + 0.2 * np.sin(a)]) + r.normal(0, 0.003, (400, 2))
    many = stems.find_circles(xy, 5)
    assert len(many) == 1 and np.allclose(many[0, :3], [3, -1, 0.2], atol=0.02)
    assert np.allclose(stems.find_best_circle(xy, 5)[:3], [3, -1, 0.2], atol=0.002)
    assert stems.find_best_circle(xy[:10], 5) is None and len(stems.find_circles(xy[:10], 5)) == 0
    assert np.isnan(stems.circumcircles(np.array([[[0, 0], [1, 1], [2, 2]]], float))).all()


def test_kept_circles_keep_their_limits():
    r = np.random.default_rng(2)
    a = r.uniform(0, 2 * np.pi, 500)
    noise = r.uniform(-1, 1, (50, 2))
    xy = np.vstack([np.column_stack([0.3 * np.cos(a), 0.3 * np.sin(a)]), noise[np.hypot(*noise.T) > 0.4]])
    for x, y, radius, n in stems.find_circles(xy, 3):
        d = np.hypot(xy[:, 0] - x, xy[:, 1] - y) - radius
        assert 0.075 <= radius <= 0.5 and n == (np.abs(d) < 0.05).sum() >= 50 and (d < -0.05).sum() <= 5


def test_line_of_circles():
    z = np.repeat(np.arange(0, 4, 0.2), 2)
    on = np.column_stack([0.05 * z, 1 - 0.02 * z, np.full(len(z), 0.2), z, np.arange(len(z))])
    far = on + [3, 0, 0, 0, 0]
    got = stems.find_stem(np.vstack([on, far[:8]]), 1)
    assert len(got) == 20 and np.allclose(got[:, 0], 0.05 * got[:, 3])
    assert stems.find_stem(on[:4], 1) is None


def test_suppression_and_merging(spark):
    rows = [(0, 0.0, 0.0, 0.2, 1.0, 60), (1, 0.1, 0.0, 0.2, 1.0, 90), (2, 5.0, 0.0, 0.2, 1.0, 50), (3, 0.0, 0.0, 0.2, 2.0, 70)]
    c = spark.createDataFrame(rows, "cid long, x double, y double, r double, z double, n long")
    assert {r.cid for r in stems.suppressed(c).collect()} == {1, 2, 3}
    st = spark.createDataFrame([(0, 0, *rows[0]), (0, 1, *rows[3]), (1, 0, *rows[3]), (1, 1, *rows[1]), (2, 0, *rows[2])], "stem_id long, seq int, cid long, x double, y double, r double, z double, n long")
    trees = {(r.tree_id, r.cid) for r in stems.merge_stems(st).collect()}
    assert trees == {(0, 1), (0, 3), (2, 2)}


def test_results_do_not_depend_on_partitioning(spark):
    _, xyz = forest()
    points = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xyz[:8000])], "pid long, x double, y double, z double")
    a, b = (sorted(map(tuple, stems.circle_stacks(p, 0.4, 0.0, 2.0).collect())) for p in (points.repartition(2), points.repartition(7, "pid")))
    assert a == pytest.approx(b)

def dense_tile(n=9000):
    """Two stems' rings and scatter, all in one tile, and a second group of few points."""
    rng = np.random.default_rng(11)
    a = rng.uniform(0, 2 * np.pi, n)
    ring = np.column_stack([np.cos(a), np.sin(a)]) * np.where(np.arange(n) % 2, 0.2, 0.3)[:, None] + rng.normal(0, 0.004, (n, 2))
    return ring + np.where(np.arange(n) % 2, 0.5, 1.4)[:, None]


def test_large_tiles_are_searched_by_shares(spark):
    """The same circles as in one task, with no share or draw lost."""
    xy = np.vstack([dense_tile(), [[0.0, 0.0], [4.0, 4.0]]])
    rows = [(i, float(x), float(y), 0.1) for i, (x, y) in enumerate(xy)]
    points = spark.createDataFrame(rows, "pid long, x double, y double, z double").repartition(5)
    whole, shared = (sorted(map(tuple, stems.circle_stacks(points, 0.4, 0.0, 0.4, share=s).collect())) for s in (None, 700))
    assert len(whole) >= 2 and shared == whole


def test_large_keys_give_the_best_circle_by_shares(spark):
    xy, search = dense_tile(), stems.CircleSearch(min_inliers=60, inner_band=0.1, max_inner=20, min_bins=11)
    rows = [(i % 2 if i < 8900 else 2, i, float(x), float(y)) for i, (x, y) in enumerate(xy)]
    rows += [(3, 9000 + i, float(i), 0.0) for i in range(900)]  # a line: no circle
    points = spark.createDataFrame(rows, "tree long, pid long, x double, y double").repartition(5)
    whole, shared = ({r.tree: tuple(r)[1:] for r in stems.best_circles(points, "tree", search, s).collect()} for s in (None, 800))
    assert set(whole) == set(shared) >= {0, 1}
    assert all(shared[k] == pytest.approx(whole[k], abs=1e-7) for k in whole)


def test_a_refit_outside_the_limits_gives_way_to_the_next(spark):
    xy = dense_tile()[1::2]
    points = spark.createDataFrame([(7, i, float(x), float(y)) for i, (x, y) in enumerate(xy)], "tree long, pid long, x double, y double")
    for r_max in (0.2003, 0.2, 0.1995):
        search = stems.CircleSearch(min_inliers=60, inner_band=0.1, max_inner=20, min_bins=11, r_max=r_max, band=0.004)
        whole, shared = ([tuple(r) for r in stems.best_circles(points, "tree", search, s).collect()] for s in (None, 900))
        assert len(shared) == len(whole) and all(a == pytest.approx(b, abs=1e-7) for a, b in zip(shared, whole))


def test_groups_of_one_size_are_searched_together(monkeypatch):
    """Equal to one group after another; what is drawn after a circle through all points is not compared."""
    r, search = np.random.default_rng(4), stems.CircleSearch(min_inliers=20, max_inner=30, min_bins=6)
    a = r.uniform(0, 2 * np.pi, (12, 60))
    groups = np.concatenate([np.stack([0.3 * np.cos(a), 0.3 * np.sin(a)], 2) + r.normal(0, 0.02, (12, 60, 2)), r.uniform(-0.6, 0.6, (12, 30, 2))], 1)
    groups[3], groups[5, 7] = 0.0, np.nan
    one = [stems.find_best_circle(xy, k, search) for k, xy in enumerate(groups)]
    got = circles.find_best_circles(groups, list(range(12)), search)
    assert one[3] is None and sum(x is not None for x in one) > 6
    assert np.allclose(got, [[np.nan] * 4 if x is None else x for x in one], atol=1e-9, equal_nan=True)
    seen, whole = [], circles.circumcircles
    monkeypatch.setattr(circles, "circumcircles", lambda t: seen.append(len(t)) or whole(t))
    rings = np.stack([0.3 * np.cos(a), 0.3 * np.sin(a)], 2)
    assert (circles.find_best_circles(rings, list(range(12)), search)[:, 3] == 60).all() and sum(seen) < 12 * search.tests / 4


def test_groups_that_go_over_batches_stay_whole():
    keys = np.repeat([3, 4, 9, 12], [5, 1, 7, 2])
    table = pa.table({"k": keys, "x": np.arange(15.0), "y": -np.arange(15.0)})
    for size in (1, 2, 5, 6, 20):
        parts = list(circles._whole_groups(iter(table.to_batches(size)), "k"))
        assert np.concatenate([p[0] for p in parts]).tolist() == [3, 4, 9, 12] and np.concatenate([p[1] for p in parts]).tolist() == [5, 1, 7, 2]
        assert np.concatenate([p[2] for p in parts]).tolist() == [[k, -k] for k in range(15)]


def test_points_of_large_tiles_are_written_once(spark, monkeypatch):
    """grf8, grf11: not once a tile that they lie in; copies of a place are met once, draws follow the order of pid."""
    from timberline.operators import graph

    r, written = np.random.default_rng(5), []
    a = np.round(r.uniform(0, 2 * np.pi, 3000), 2)  # copies
    ring = np.column_stack([np.cos(a), np.sin(a)]) * np.where(np.arange(3000) % 2, 0.2, 0.3)[:, None] + np.where(np.arange(3000) % 2, 1.5, 2.6)[:, None]
    xy = np.vstack([ring, r.uniform(0, 4, (300, 2)), [[0.0, 0.0], [4.0, 4.0]]])
    rows = [(int(p) - 1000, float(x), float(y), 0.1 + 0.4 * (k % 9 == 0)) for k, (p, (x, y)) in enumerate(zip(r.permutation(len(xy)) * 1_000_003, xy, strict=True))]
    points = spark.createDataFrame(rows, "pid long, x double, y double, z double").repartition(5)
    whole = sorted(map(tuple, stems.circle_stacks(points, 0.4, 0.0, 0.8).collect()))
    kept = graph.checkpointed
    for module in (graph, circles):
        monkeypatch.setattr(module, "checkpointed", lambda df: (out := kept(df), written.append(out.count()))[0])
    monkeypatch.setattr(circles, "RANGE", 400, raising=False)
    for share in (500,):
        assert sorted(map(tuple, stems.circle_stacks(points, 0.4, 0.0, 0.8, share=share).collect())) == whole and len(whole) >= 3
    assert 1500 < max(written) <= len(rows)


def test_spans_are_the_tiles_of_each_point(spark):
    from timberline.operators.spatial import half_overlapping_tiles, tile_spans

    r = np.random.default_rng(2)
    rows = [(k, k % 3, float(x), float(y)) for k, (x, y) in enumerate(np.round(r.uniform(-3, 4, (600, 2)), 1))] + [(600, 1, None, 0.5), (601, 1, 0.5, None), (602, 7, 1.0, 1.0)]
    points = spark.createDataFrame(rows, "pid long, slice int, x double, y double")
    for size in (0.7, 2.0):
        want = sorted((t.slice, t.pid, t.tx, t.ty) for t in half_overlapping_tiles(points, size, ["slice"]).collect())
        got = sorted((t.slice, t.pid, i, j) for t in tile_spans(points, size, "slice").collect() for i in range(t.tx0, t.tx1 + 1) for j in range(t.ty0, t.ty1 + 1))
        assert got == want and len(got) > 1000
