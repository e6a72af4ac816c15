import numpy as np
import pytest
from pyspark.sql import functions as F

from timberline.operators import boxes, ground, neighbours, spatial
from timberline.operators.graph import connected_components


def cloud(spark, xyz):
    return spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(xyz)], "pid long, x double, y double, z double")


def slope(n=3000, seed=0, shift=0.0):
    r = np.random.default_rng(seed)
    xy = r.uniform(0, 40, (n, 2)) + shift
    return np.column_stack([xy, 0.1 * (xy[:, 0] - shift) + r.uniform(0, 0.1, n)])


@pytest.mark.parametrize("shift", [0.0, -57.3])
def test_bare_slope_has_nothing_above_ground(spark, shift):
    assert ground.remove_ground(cloud(spark, slope(shift=shift)), 2.0)[0].count() == 0


def test_low_outliers_take_the_median(spark):
    xyz = np.vstack([slope(), [[5.5, 5.5, -5.0], [20.5, 20.5, -5.0]]])
    g = ground.ground_points(cloud(spark, xyz))
    assert g.agg(F.min("gz")).first()[0] > -0.5


@pytest.mark.parametrize("dims", [("x", "y"), ("x", "y", "z")])
@pytest.mark.parametrize("k", [1, 4])
def test_nearest_equals_brute_force(spark, dims, k):
    r = np.random.default_rng(3)
    q, t = np.round(r.uniform(-30, 30, (200, 3)), 1), np.round(np.vstack([r.uniform(-30, 30, (40, 3)), r.uniform(500, 501, (3, 3))]), 1)
    got = neighbours.nearest(cloud(spark, q), cloud(spark, t).withColumnRenamed("pid", "gid"), k, dims).collect()
    n = len(dims)
    for i in range(200):
        d = np.sqrt(((t[:, :n] - q[i, :n]) ** 2).sum(1))
        want = sorted(zip(d.round(9), range(len(t)), strict=True))[:k]
        mine = sorted((r["rank"], round(r["dist"], 9), r["gid"]) for r in got if r["pid"] == i)
        assert [(a, b) for _, a, b in mine] == [(pytest.approx(a), b) for a, b in want]


def test_nearest_of_far_and_few(spark):
    q = cloud(spark, [[0, 0, 0], [1e5, 0, 0]])
    t = cloud(spark, [[9e4, 9e4, 0]]).withColumnRenamed("pid", "gid")
    assert neighbours.nearest(q, t, 2).count() == 2
    assert neighbours.nearest(q, t.limit(0), 1).count() == 0 and neighbours.nearest(q, t, 1, limit=5.0).count() == 0


def test_labels_of_no_boxes_and_a_permutation(spark):
    c = cloud(spark, [[1, 1, 0], [5, 5, 0], [9, 9, 0]])
    b = spark.createDataFrame([(0, 0.0, 0.0, 2.0, 2.0), (1, 4.0, 4.0, 6.0, 6.0)], "bid long, ymin double, xmin double, ymax double, xmax double")
    assert {r.label for r in spatial.label_points(c, b.limit(0)).collect()} == {0}
    assert {r.pid: r.label for r in spatial.label_points(c, b).collect()} == {0: 1, 1: 2, 2: 0}
    permuted = {r.pid: r.label for r in spatial.label_points(c, b, seed=5).collect()}
    assert permuted[2] == 0 and {permuted[0], permuted[1]} == {1, 2}


@pytest.mark.parametrize("cover", [False, True])
def test_windows_equal_brute_force(spark, cover):
    r = np.random.default_rng(1)
    xyz = np.round(r.uniform(-20, 35, (300, 3)), 2)
    got = {tuple(x) for x in spatial.sliding_windows(cloud(spark, xyz), 7, 11.0, cover).select("pid", "wx", "wy").collect()}
    lo, hi = xyz.min(0), xyz.max(0)
    origins = [range(int(np.floor(lo[k])), int(np.floor(hi[k])) + 1, 7) if cover else range(int(lo[k]), int(hi[k]), 7) for k in (0, 1)]
    want = {(i, a, b) for i, (x, y, _) in enumerate(xyz) for a in origins[0] for b in origins[1] if a < x < a + 11 and b < y < b + 11}
    assert got == want
    if cover:
        assert len({i for i, _, _ in got}) >= 298


def test_spike_filter_in_place_and_at_once(spark):
    cells = spark.createDataFrame([(i, j, 50.0 if (i, j) in ((2, 2), (2, 3)) else 1.0) for i in range(5) for j in range(5)], "ix int, iy int, z double")
    for parity in (False, True):
        assert ground.spike_filter(cells, 5.0, parity).agg(F.max("z")).first()[0] == 1.0


def test_components(spark):
    r = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in r.integers(0, 300, (250, 2))] + [(1000 + k, 1001 + k) for k in range(120)]
    edges += [(5000, 5000), (7, 7)] + [(2000, 2001 + k) for k in range(150)]  # loops and a hub
    df = spark.createDataFrame([*edges, (None, 3), (3, None)], "u long, v long")
    root = {n: n for e in edges for n in e}
    for _ in range(400):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    for one_task in (0, 100, 1 << 17):
        got = [tuple(x) for x in connected_components(df, one_task=one_task).collect()]
        assert dict(got) == root and len(got) == len(root)
    assert connected_components(df.limit(0)).count() == connected_components(df.limit(0), one_task=0).count() == 0


def test_backward_merge(spark):
    rows = [(0, 0, 0, 2, 2), (1, 10, 10, 12, 12), (2, 11, 11, 13, 13), (3, 1, 1, 3, 3), (4, 30, 30, 31, 31)]
    b = spark.createDataFrame([(i, *map(float, x)) for i, *x in rows], "bid long, ymin double, xmin double, ymax double, xmax double")
    whole = {tuple(r) for r in boxes.merged_boxes(b).collect()}
    assert whole == {(0, 0, 3, 3), (10, 10, 13, 13), (30, 30, 31, 31)}
    assert boxes.merged_boxes(b.limit(1), parity=True).count() == 0  # the first box is never returned
    assert {tuple(r) for r in boxes.merged_boxes(b, parity=True).collect()} == {(30, 30, 31, 31), (10, 10, 13, 13)}


def around(*some):
    """The least box around some boxes."""
    low, high = np.array(some)[:, :2].min(axis=0), np.array(some)[:, 2:].max(axis=0)
    return (*low.tolist(), *high.tolist())


def overlapping(one, other):
    """Whether the box around both is no longer, along either axis, than the two laid end to end."""
    both = around(one, other)
    return all(both[k + 2] - both[k] <= one[k + 2] - one[k] + other[k + 2] - other[k] + 1e-12 for k in (0, 1))


def merged_backward(boxes_left):
    """By definition: the last box goes into the first one before it that it overlaps, or comes out if there is none; then the shorter list's."""
    if len(boxes_left) < 2:
        return []
    *earlier, last = boxes_left
    host = next((k for k, box in enumerate(earlier) if overlapping(box, last)), None)
    if host is None:
        return [last, *merged_backward(earlier)]
    return merged_backward([*earlier[:host], around(earlier[host], last), *earlier[host + 1 :]])


@pytest.mark.parametrize("rows", [[(0, 0, 2, 2), (1, 1, 3, 3)], [(50, 50, 51, 51), (0, 0, 2, 2), (1, 1, 3, 3)], None])
def test_backward_merge_equals_the_literal_scan(spark, rows):
    if rows is None:
        r = np.random.default_rng(6)
        low = r.uniform(0, 60, (80, 2)).round(2)
        rows = [(y, x, y + h, x + w) for (y, x), (h, w) in zip(low.tolist(), r.uniform(1, 7, (80, 2)).round(2).tolist(), strict=True)]
    b = spark.createDataFrame([(i, *map(float, x)) for i, x in enumerate(rows)], "bid long, ymin double, xmin double, ymax double, xmax double")
    got = sorted(tuple(r) for r in boxes.merged_boxes(b, parity=True).collect())
    assert got == sorted(merged_backward([tuple(map(float, x)) for x in rows]))


def test_numbered_is_contiguous_in_order(spark):
    from timberline.operators.graph import numbered

    df = spark.createDataFrame([(int(v),) for v in np.random.default_rng(1).integers(0, 500, 900)], "v long").repartition(7)
    got = numbered(df, "v").collect()
    assert sorted(r.number for r in got) == list(range(900)) and [r.v for r in sorted(got, key=lambda r: r.number)] == sorted(r.v for r in got)
    assert numbered(df.limit(0), "v").count() == 0


def test_metrics_of_nothing(spark):
    none = spark.createDataFrame([], "flag int")
    assert tuple(boxes.detection_metrics(none, none).first()) == (0, 0, 0, 0, 0, 0)


@pytest.mark.parametrize("reach,centre,side", [(3, True, 4), (1, False, 3), (2, True, 64)])
def test_neighbourhood_medians_of_blocks(spark, reach, centre, side):
    """Medians across the rims of small blocks, of negative cells and cells without neighbours, are those of all pairs; little more than the cells is sent."""
    r = np.random.default_rng(6)
    z = {(int(i), int(j)): float(v) for (i, j), v in zip(r.integers(-12, 12, (260, 2)), r.integers(0, 9, 260), strict=True)} | {(50, 50): 3.0}
    cells = spark.createDataFrame([(i, j, v, f"{i},{j}") for (i, j), v in z.items()], "ix int, iy int, z double, name string")
    got = {(c.ix, c.iy): c for c in ground.neighbourhood_median(cells, reach, "z", centre, side).collect()}
    assert len(got) == len(z)
    for (i, j), v in z.items():
        near = [z[i + a, j + b] for a in range(-reach, reach + 1) for b in range(-reach, reach + 1) if (centre or a or b) and (i + a, j + b) in z]
        assert (got[i, j].z, got[i, j].name, got[i, j].med) == (v, f"{i},{j}", float(np.median(near)) if near else None)


@pytest.mark.parametrize("seed,side,thresh", [(1, 64, 2.0), (2, 3, 1.0), (3, 4, 0.5)])
def test_spikes_in_place_equal_the_scan(spark, seed, side, thresh):
    """A scan in which changes reach later cells, through several blocks."""
    r = np.random.default_rng(seed)
    z = {(int(i), int(j)): float(v) for (i, j), v in zip(r.integers(-8, 8, (180, 2)), r.normal(0, 2, 180).round(1), strict=True)} | {(40, 40): 9.0}
    want = dict(z)
    for i, j in sorted(want):
        near = [want[c] for a in (-1, 0, 1) for b in (-1, 0, 1) if (a or b) and (c := (i + a, j + b)) in want]
        if near and abs(want[i, j] - float(np.median(near))) > thresh:
            want[i, j] = float(np.median(near))
    cells = spark.createDataFrame([(i, j, v) for (i, j), v in z.items()], "ix int, iy int, z double")
    got = {(c.ix, c.iy): c.z for c in ground.spike_filter(cells, thresh, True, side).collect()}
    assert got == want and got != {(c.ix, c.iy): c.z for c in ground.spike_filter(cells, thresh, False, side).collect()}
