"""Queries on tables that are unlike the small ones: images of one value, many copies of one place, frames that one task must not hold."""

import duckdb
import pytest

from timberline.operators import decisions, neighbours, stems
from timberline.queries import ORACLE_SQL, QUERIES
from timberline.sources import meshes, ply


def plain(v):
    return repr(0.0 if v == 0 else v)  # nan as well


def check_sql(spark, name, folder, *tables):
    con = duckdb.connect()
    for t in tables:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    found = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    wanted = sorted(tuple(map(plain, r)) for r in found.fetchall())
    assert sorted(tuple(plain(r[c]) for c in names) for r in QUERIES[name](spark, folder).collect()) == wanted
    return wanted


@pytest.mark.parametrize("name", ["agg28_rescaled", "agg30_jet"])
def test_an_image_of_one_value_is_that_of_the_sql(spark, tmp_path, name):
    spark.range(30000).selectExpr("id AS event_id", "50.0D AS value").write.parquet(f"{tmp_path}/events.parquet")
    assert len(check_sql(spark, name, str(tmp_path), "events")) == 1600


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("keys", [(), ("tree_id",)])
def test_nearest_sends_no_table_to_the_driver(spark, keys):
    """jn6, udf6 and udf7: queries meet the targets of their leaf in groups dealt by leaf and share."""
    q = spark.range(500).selectExpr("id AS pid", "id % 3 AS tree_id", "id % 23 * 1.0D AS x", "id % 29 * 1.0D AS y", "id % 7 * 0.1D AS z")
    near = neighbours.nearest(q, q.withColumnRenamed("pid", "gid"), 1, ("x", "y", "z"), limit=1.5, keys=keys)
    assert "Broadcast" not in _plan(near) and "Join" not in _plan(near)
    assert near.where("dist = 0").count() == 500


def test_copies_of_a_place_are_met_once_and_queries_are_not_written(spark, monkeypatch):
    """flt11: 1,000 boxes in each of two places, and points that are near to none are never written."""
    written = []
    monkeypatch.setattr(neighbours, "checkpointed", lambda df: written.append(df.count()) or df)
    q = spark.range(3000).selectExpr("id AS pid", "CASE WHEN id < 300 THEN id * 0.01D ELSE id * 1.0D END AS x", "0.0D AS y")
    t = spark.range(2000).selectExpr("id AS gid", "id % 2 * 3.0D AS x", "0.5D AS y")
    got = {r.pid: (r.gid, r.dist) for r in neighbours.nearest(q, t, limit=1.5).collect()}
    assert written[0] == 2 and max(written) <= 300
    assert max(got) < 300
    for p in range(300):
        d = [((p * 0.01 - x) ** 2 + 0.25) ** 0.5 for x in (0.0, 3.0)]
        g = d.index(min(d))
        assert (p in got) == (d[g] < 1.5) and (p not in got or (got[p][0] == g and got[p][1] == pytest.approx(d[g])))


def test_nearest_with_a_limit_in_several_rounds(spark):
    """Cells begin small where targets are dense; far queries go on up to the limit."""
    import numpy as np

    r = np.random.default_rng(5)
    t = np.round(np.vstack([r.uniform(0, 2, (400, 2)), r.uniform(0, 60, (20, 2))]), 2)
    q = np.round(r.uniform(-5, 65, (200, 2)), 2)
    frame = lambda a, i: spark.createDataFrame([(n, *map(float, p)) for n, p in enumerate(a)], f"{i} long, x double, y double")
    got = {x.pid: (round(x.dist, 9), x.gid) for x in neighbours.nearest(frame(q, "pid"), frame(t, "gid"), 1, limit=12.0).collect()}
    for i in range(200):
        d, g = min(zip(np.sqrt(((t - q[i]) ** 2).sum(1)).round(9), range(len(t)), strict=True))
        assert got.get(i) == ((pytest.approx(d), g) if d < 12 else None)


CIRCLES = "cid long, x double, y double, r double, z double, n long"


def _column(spark, copies, levels=12, apart=3.0):
    """Two columns of circles, ``copies`` of each."""
    rows = [(c * 100 + k * 2 + s, s * apart, 0.0, 0.2, k * 0.2, 50 + (k + c) % 7) for c in range(copies) for k in range(levels) for s in (0, 1)]
    return spark.createDataFrame(rows, CIRCLES)


def test_copies_climb_alike(spark):
    """jn12: pairs are met between distinct circles, and minima need no sorted pairs."""
    found = stems.next_up(_column(spark, 40))
    assert "Window" not in _plan(found) and "Broadcast" not in _plan(found)
    got = {r.cid: r.next for r in found.collect()}
    assert got == {c * 100 + k * 2 + s: (k + 1) * 2 + s for c in range(40) for k in range(11) for s in (0, 1)}


def test_copies_are_tied_without_their_pairs(spark, monkeypatch):
    """grf4, grf5, grf7, snk12: edges follow the distinct circles and places, not the pairs of a group."""
    edges = []
    components, decided = stems.connected_components, decisions.decided
    monkeypatch.setattr(stems, "connected_components", lambda e: edges.append(e.count()) or components(e))
    monkeypatch.setattr(decisions, "decided", lambda i, *a, **k: edges.append(i.selectExpr("sum(size(lower))").first()[0]) or decided(i, *a, **k))
    c = _column(spark, 40)
    assert {r.cid for r in stems.suppressed(c).collect()} == {min((k * 2 + s + 100 * i for i in range(40) if (k + i) % 7 == 6), default=None) for k in range(12) for s in (0, 1)}
    places = c.selectExpr("cid AS tree_id", "x", "y")
    assert {r.tree_id for r in stems.unique_locations(places).collect()} == {0, 1}
    st = c.selectExpr("cid AS stem_id", "0 AS seq", "cid % 2 AS cid", "x", "y", "r", "z", "n")
    assert {r.tree_id for r in stems.merge_stems(st).collect()} == {0, 1}
    assert len(edges) == 3 and max(edges) <= 960 and sum(edges[:2]) <= 24


@pytest.mark.parametrize("distance", [0.0, 0.7, 2.0])
def test_unique_locations_equal_the_literal_scan(spark, distance):
    import numpy as np

    xy = np.round(np.random.default_rng(2).uniform(0, 12, (150, 2)), 1)
    kept = []
    for i in range(150):
        if all(np.hypot(*(xy[i] - xy[k])) > distance for k in kept):
            kept.append(i)
    rows = [(i, float(x), float(y)) for i, (x, y) in enumerate(xy)] + [(200, None, 1.0), (201, None, None)]
    got = stems.unique_locations(spark.createDataFrame(rows, "tree_id long, x double, y double"), distance)
    assert sorted(r.tree_id for r in got.collect()) == [*kept, 200, 201]


def test_overlaps_of_copies_are_expanded(spark, monkeypatch):
    """jn11: distances are computed between distinct circles only; shares of copies give each pair once."""
    seen = []
    distinct = stems._overlaps_of_distinct
    monkeypatch.setattr(stems, "_overlaps_of_distinct", lambda c, *a: seen.append(c.count()) or distinct(c, *a))
    shares = stems._in_shares
    monkeypatch.setattr(stems, "_in_shares", lambda m, keys: shares(m, keys, 4))
    rows = [(i, 0.1 * (i % 3), 0.0, 0.2 * (i % 5 > 0), 1.0, 1) for i in range(60)]
    got = [tuple(r) for r in stems.overlapping_at_height(spark.createDataFrame(rows, CIRCLES)).collect()]
    want = [(a[0], b[0]) for a in rows for b in rows if a[0] <= b[0] and abs(a[1] - b[1]) < a[3] + b[3]]
    assert sorted(got) == sorted(want) and seen == [6]


def test_points_meet_distinct_rings(spark, monkeypatch):
    """flt10, jn14: rings are spread over cells once a place, and only over cells that their tree's bounds reach."""
    seen = []
    monkeypatch.setattr(stems, "checkpointed", lambda df: seen.append(df.count()) or df)
    rings = spark.createDataFrame([(i % 2, i, 0.0, 0.0, 1.0 + 8.0 * (i % 3 > 1), 1.0) for i in range(600)], "tree_id long, cid long, x double, y double, r double, z double")
    points = spark.createDataFrame([(0, 1.0, 0.0, 1.0), (1, 0.0, -1.02, 1.2), (2, 9.0, 0.0, 1.0), (3, 1.2, 0.0, 1.0), (4, 1.0, 0.0, 1.25)], "pid long, x double, y double, z double")
    got = sorted((r.tree_id, r.cid, r.pid) for r in stems.stem_points(points, rings).collect())
    assert got == sorted((i % 2, i, p) for i in range(600) if i % 3 < 2 for p in (0, 1))
    assert 4 in seen  # distinct rings of both trees


def test_circles_are_searched_a_few_at_a_time(spark):
    """grf8, grf9, grf11: the inliers of one candidate are held, not of all; keys are read in a row."""
    import numpy as np

    a = np.linspace(0, 2 * np.pi, 90, endpoint=False)
    xy = np.column_stack([np.cos(a), np.sin(a)]) * 0.3
    search = stems.CircleSearch(min_inliers=60, inner_band=0.1, max_inner=20, min_bins=11)
    assert iter(found := stems.candidate_circles(xy, 1, search)) is found and len(list(found)) > 1
    rows = [(k, k * 100 + i, float(x + k), float(y)) for k in range(7) for i, (x, y) in enumerate(xy if k != 3 else xy[:30])]
    points = spark.createDataFrame(rows, "tree long, pid long, x double, y double").repartition(3)
    got = {r.tree: (r.x, r.y, r.r, r.n) for r in stems.best_circles(points, "tree", search).collect()}
    assert got == {k: pytest.approx(tuple(stems.find_best_circle(xy + [k, 0], stems.seed_of(k), search))) for k in range(7) if k != 3}


def test_one_mesh_file_is_read_by_ranges(spark, tmp_path):
    """snk13, snk14: no task reads the whole file, and rows keep their places."""
    v = spark.range(3000).selectExpr("id AS vid", "id * 0.5D AS x", "-id * 1.0D AS y", "0.25D AS z")
    faces = spark.range(2000).selectExpr("id AS a", "id + 1 AS b", "id + 2 AS c", "id + 3 AS d")
    meshes.write_mesh(v, f"{tmp_path}/m.ply", faces)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        points, quads = ply.read_ply(spark, f"{tmp_path}/m.ply"), ply.read_faces(spark, f"{tmp_path}/m.ply")
        assert points.rdd.getNumPartitions() > 4 and quads.rdd.getNumPartitions() > 4
        assert sorted((r.pid, r.x, r.y, r.z, r.cloud_id, r.off_x) for r in points.collect()) == [(i, i * 0.5, -float(i), 0.25, "m.ply", 0.0) for i in range(3000)]
        assert sorted((r.fid, r.v) for r in quads.collect()) == [(i, [i, i + 1, i + 2, i + 3]) for i in range(2000)]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_draws_of_large_groups_are_not_broadcast(spark):
    """grf8, grf11: ranks, candidates and shares of groups grow with the points, so the driver does not collect them."""
    from timberline.operators import circles

    points = spark.range(3000).selectExpr("id AS pid", "id % 2 AS tile", "cos(id) * 0.3 AS x", "sin(id) * 0.3 AS y")
    small, large = circles._by_size(points, ["tile"], 700)
    assert "BroadcastHashJoin" not in _plan(small) + _plan(large)
    placed, groups = circles._dealt(large, ["tile"], 700)
    groups = circles.checkpointed(groups)
    counted = circles._counted(circles.checkpointed(placed), groups, ["tile"], circles.MANY, 700)
    assert "BroadcastHashJoin" not in _plan(counted) and counted.count() > 0
