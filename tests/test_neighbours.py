"""The nearest-neighbour join against a full comparison, and how its work is dealt."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql.pandas.group_ops import PandasCogroupedOps

from timberline.operators import neighbours


def dense(seed, n, low=0.0, high=100.0):
    """Nine tenths of the places in one hundredth of the area, many of them equal."""
    r = np.random.default_rng(seed)
    return np.round(np.vstack([r.uniform(low, high, (n // 10, 3)), r.uniform(40, 50, (n - n // 10, 3))]), 1)


def frame(spark, places, ids, labels):
    return spark.createDataFrame([(n, *map(float, p), int(key)) for n, (p, key) in enumerate(zip(places, labels, strict=True))], f"{ids} long, x double, y double, z double, key int")


@pytest.mark.parametrize(
    "targets,queries,k,dims,limit,keyed,options",
    [
        (500, 400, 1, ("x", "y"), None, False, {"leaf": 16, "share": 32}),
        (500, 300, 4, ("x", "y", "z"), None, False, {"leaf": 16, "share": 32, "asks": 1}),
        (500, 400, 1, ("x", "y", "z"), 5.0, False, {"leaf": 16, "share": 32}),
        (500, 300, 2, ("x", "y", "z"), 5.0, True, {"leaf": 16, "share": 32}),
        (400, 300, 1, ("x", "y"), None, True, {"leaf": 16, "share": 32}),
        (30, 40, 4, ("x",), None, False, {}),
        (3, 20, 5, ("x", "y"), None, False, {}),
    ],
)
def test_equals_brute_force(spark, targets, queries, k, dims, limit, keyed, options):
    t, q = dense(targets, targets), dense(queries, queries, -20, 120)
    r = np.random.default_rng(1)
    of_t, of_q = r.integers(0, 5, len(t)), r.integers(0, 6, len(q))
    got = {}
    for x in neighbours.nearest(frame(spark, q, "pid", of_q), frame(spark, t, "gid", of_t), k, dims, values=("z",), limit=limit, keys=("key",) if keyed else (), **options).collect():
        got.setdefault(x.pid, []).append((x["rank"], x.dist, x.gid, x.z))
    at = ["xyz".index(c) for c in dims]
    for n, place in enumerate(q):
        dist = np.sqrt(((t[:, at] - place[at]) ** 2).sum(axis=1))
        fit = (dist < (np.inf if limit is None else limit)) & ((of_t == of_q[n]) if keyed else True)
        some = np.flatnonzero(fit)
        want = [(m + 1, pytest.approx(dist[x]), x, t[x, 2]) for m, x in enumerate(some[np.lexsort((some, dist[some]))][:k])]
        assert sorted(got.get(n, [])) == want


def test_dense_leaves_are_cut_and_dealt_evenly(spark, monkeypatch):
    """90 % of the points in 1 % of the area: no task meets more than three times the median, neither targets nor queries."""
    sizes, whole = [], PandasCogroupedOps.applyInArrow

    def counted(both, *more):
        sizes.append([np.array([r["count"] for r in side._df.groupBy("_leaf", "_share").count().collect()]) for side in (both._gd1, both._gd2)])
        return whole(both, *more)

    monkeypatch.setattr(PandasCogroupedOps, "applyInArrow", counted)
    t, q = dense(3, 20_000), dense(4, 20_000)
    none = np.zeros(20_000)
    near = neighbours.nearest(frame(spark, q, "pid", none), frame(spark, t, "gid", none), 1, ("x", "y"), leaf=256, share=512)
    assert near.count() == 20_000
    queries, targets = sizes[0]
    assert len(targets) >= 60 and targets.max() <= 3 * np.median(targets) and queries.max() <= 3 * 512 / 2


def test_a_place_with_any_number_of_targets_and_of_queries(spark):
    t = spark.range(5000).selectExpr("id AS gid", "IF(id < 4000, 1.0D, id * 1.0D) AS x", "0.0D AS y")
    q = spark.range(5000).selectExpr("id AS pid", "IF(id < 4000, 1.5D, id * 1.0D) AS x", "0.0D AS y")
    got = {r.pid: (r.gid, r.dist) for r in neighbours.nearest(q, t, 1, leaf=64, share=128).collect()}
    assert got == {k: (0, 0.5) if k < 4000 else (k, 0.0) for k in range(5000)}
    three = neighbours.nearest(q.where("pid < 2"), t, 3).collect()
    assert sorted((r.pid, r["rank"], r.gid) for r in three) == [(p, k + 1, k) for p in range(2) for k in range(3)]


def test_structured_ids_order_ties(spark):
    t = spark.range(6).selectExpr("struct(id % 2 AS a, -id AS b) AS gid", "1.0D AS x", "1.0D AS y")
    q = spark.range(1).selectExpr("struct(id AS c) AS pid", "0.0D AS x", "1.0D AS y")
    (row,) = neighbours.nearest(q, t).collect()
    assert (row.gid.a, row.gid.b, row.dist) == (0, -4, 1.0)


def test_a_large_leaf_is_cut_once_more():
    r = np.random.default_rng(2)
    t, q = np.round(r.uniform(0, 9, (3000, 2)), 1), np.round(r.uniform(-2, 11, (500, 2)), 1)
    for k in (1, 3):
        for same in (None, (r.integers(0, 3, len(t)), r.integers(0, 4, len(q)))):
            one, two = (sorted(zip(*(x.tolist() for x in f), strict=True)) for f in (neighbours.closest(t, q, k, same), neighbours.closest_in_leaf(t, q, k, same, 64)))
            assert one == two


def test_leaves_hold_what_they_should():
    t = dense(5, 10_000)[:, :2]
    tree = neighbours.Tree(t, 64)
    sizes = np.bincount(tree.leaf_of(t), minlength=tree.n_leaves)
    assert sizes.max() <= 64 and sizes.sum() == len(t)
    assert neighbours.Tree(np.zeros((100, 2)), 5).n_leaves == 1 and neighbours.Tree(t, 1, max_leaves=7).n_leaves <= 7
    assert neighbours._in_order(pa.table({"_tid": [3, 1, 2]}), "_tid").column(0).to_pylist() == [1, 2, 3]


def _bounded(targets, leaf):
    tree = neighbours.Tree(targets, leaf)
    mine = tree.leaf_of(targets)
    return tree.bounded(*(np.array([f(targets[mine == n], axis=0) for n in range(tree.n_leaves)]) for f in (np.min, np.max)))


def test_leaves_within_reach_are_found_level_by_level(monkeypatch):
    """All leaves within reach and no others, in chunks of any size; a level of the tree is one step, however many leaves there are."""
    t, q = dense(6, 3000), dense(7, 400, -20, 120)
    tree, reach = _bounded(t, 8), np.random.default_rng(8).uniform(0, 9, 400)
    ends = np.flatnonzero(tree.leaf >= 0)
    gap = np.maximum(np.maximum(tree.low[ends] - q[:, None], q[:, None] - tree.high[ends]), 0.0)
    far = np.sqrt((gap * gap).sum(axis=2))
    want = {(r, int(tree.leaf[ends[n]])): far[r, n] for r, n in zip(*np.nonzero(far <= reach[:, None]), strict=True)}
    steps, one = [], neighbours.Tree._far
    monkeypatch.setattr(neighbours.Tree, "_far", lambda *a: steps.append(1) or one(*a))
    for pairs in (1 << 19, 100):
        monkeypatch.setattr(neighbours, "PAIRS", pairs)
        steps.clear()
        got = list(zip(*(x.tolist() for x in tree.within(q, reach, False)), strict=True))
        assert len(got) == len(want) and all(want[r, n] == pytest.approx(d) for r, n, d in got)
        assert pairs == 100 or len(steps) <= 30 < tree.n_leaves
    own = tree.leaf_of(q)
    assert tree.reached(q, own, 3.0, False).tolist() == [far[r, np.flatnonzero(tree.leaf[ends] == n)[0]] <= 3.0 for r, n in enumerate(own)]
