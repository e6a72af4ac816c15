"""Operators on pairs: copies are compared once, blocks are met by few large tiles, and nothing is held by pair."""

import pytest

from timberline.operators import boxes, spatial
from timberline.operators.graph import connected_components

BOX = "bid long, ymin double, xmin double, ymax double, xmax double"


def _places(spark, n, places=3):
    """Boxes of 4 x 4 in ``places`` places, 3 apart, so neighbours overlap."""
    return spark.createDataFrame([(k, 0.0, k % places * 3.0, 4.0, k % places * 3.0 + 4) for k in range(n)], BOX)


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_overlapping_copies_are_listed_as_often_as_they_occur(spark):
    """jn10, flt6: as the SQL, which has no DISTINCT; blocks smaller than a class change nothing."""
    b = spark.createDataFrame([(0, 0.0, 0.0, 2.0, 2.0), (1, 1.0, 1.0, 3.0, 3.0), (1, 1.0, 1.0, 3.0, 3.0), (2, 9.0, 9.0, 9.5, 9.5), (3, 9.5, 9.5, 30.0, 30.0)], BOX)
    assert sorted(map(tuple, boxes.overlap_pairs(b).collect())) == [(1, 0), (1, 0), (3, 2)]


def test_pairs_of_copies_in_blocks(spark, monkeypatch):
    """jn9, jn10: every pair once, whatever the blocks."""
    monkeypatch.setattr(boxes, "MEMBERS", 7)
    b, n = _places(spark, 60), 60
    near = lambda i, j: abs(i % 3 - j % 3) <= 1
    assert sorted(map(tuple, boxes.overlap_pairs(b).collect())) == sorted((i, j) for i in range(n) for j in range(i) if near(i, j))
    got = boxes.centre_neighbours(b, 3.5)
    assert sorted((r.bid, r.other) for r in got.collect()) == sorted((i, j) for i in range(n) for j in range(n) if near(i, j))
    assert {(r.area, r.off_square) for r in got.collect()} == {(16.0, 0.0)}


def test_ties_of_copies_are_few(spark):
    """grf3, grf_components: fewer links than boxes, with the components of all pairs."""
    b = _places(spark, 600).union(_places(spark, 40).selectExpr("bid + 1000", "ymin + 50", "xmin * 9", "ymax + 50", "xmin * 9 + 1"))
    links = boxes.overlap_links(b)
    assert links.count() < 660
    few, all_ = (sorted(map(tuple, connected_components(e).select("node", "component").collect())) for e in (links, boxes.overlap_pairs(b)))
    assert few == all_ and len({c for _, c in few}) == 4
    inverted = spark.createDataFrame([(0, 5.0, 0.0, 3.0, 2.0), (1, 5.0, 0.0, 3.0, 2.0), (2, 0.0, 0.0, 9.0, 9.0)], BOX)  # overlap not each other, but the third
    assert sorted(map(tuple, boxes.overlap_links(inverted).collect())) == sorted(map(tuple, boxes.overlap_pairs(inverted).collect())) == [(2, 0), (2, 1)]


@pytest.mark.parametrize("by", ["area", "squareness"])
def test_the_best_of_a_centre_stands_for_its_copies(spark, monkeypatch, by):
    """grf1, grf2: classes meet, not boxes."""
    met, near = [], boxes._near_centres
    monkeypatch.setattr(boxes, "_near_centres", lambda c, d: met.append(c.count()) or near(c, d))
    rows = [(k, -1.0 - k % 2, k % 4 * 3.0 - 2, 1.0 + k % 2, k % 4 * 3.0 + 2) for k in range(400)]
    got = {r.keep for r in boxes.unique_boxes(spark.createDataFrame(rows, BOX), 3.5, by).collect()}
    score = (lambda r: (-(r[3] - r[1]) * (r[4] - r[2]), r[0])) if by == "area" else (lambda r: (abs(1 - (r[3] - r[1]) / (r[4] - r[2])), r[0]))
    assert met == [4] and got == {min((r for r in rows if abs(r[0] % 4 - k) <= 1), key=score)[0] for k in range(4)}


def test_points_meet_one_box_of_each_place(spark, monkeypatch):
    """jn2: of copies the last decides, whatever it is labelled by."""
    met, join = [], spatial.points_in_boxes
    monkeypatch.setattr(spatial, "points_in_boxes", lambda p, b, s: met.append(b.count()) or join(p, b, s))
    points = spark.createDataFrame([(0, 1.0, 1.0), (1, 3.5, 1.0), (2, 50.0, 1.0)], "pid long, x double, y double")
    b = _places(spark, 300).selectExpr("*", "bid % 7 AS kind")
    assert {r.pid: r.label for r in spatial.label_points(points, b).collect()} == {0: 298, 1: 299, 2: 0}
    assert {r.pid: r.label for r in spatial.label_points(points, b, classes="kind").collect()} == {0: 297 % 7, 1: 298 % 7, 2: 0}
    assert met == [3, 3]


def test_groups_are_merged_backward_in_a_row(spark):
    """grf3 with parity: a task walks its groups, there is no frame a group."""
    b = spark.createDataFrame([(k, k // 2 * 10.0, 0.0, k // 2 * 10.0 + 1 + k % 2, 1.0) for k in range(600)], BOX)
    merged = boxes.merged_boxes(b, parity=True)
    assert "MapInArrow" in _plan(merged) and "FlatMapGroups" not in _plan(merged)
    assert {r.ymin for r in merged.collect()} == {k * 10.0 for k in range(1, 300)}  # the first of all is never returned
