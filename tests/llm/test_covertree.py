import math

import numpy as np
import pytest

from timberline.llm import covertree


def data(seed=0, n=300, d=16):
    r = np.random.default_rng(seed)
    x = r.normal(size=(n, d))
    x[50:120] = x[50] + r.normal(size=(70, d)) * 0.12
    x[120:150] = x[120] + r.normal(size=(30, d)) * 0.001
    x[150:160] = 3 * x[150]
    return x.astype(np.float32).astype(np.float64)


def brute(x, cosine=0.95):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    g = u @ u.T >= cosine
    return {(i, j) for i in range(len(x)) for j in range(i + 1, len(x)) if g[i, j]}


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_pairs_equal_brute_force(seed):
    x = data(seed)
    assert set(covertree.pairs(x)) == brute(x)


def test_tree_covers_and_nests():
    t = covertree.CoverTree(data())
    assert sorted(t.order.tolist()) == list(range(300))
    for k in range(len(t.centre)):
        below = t.below(k)
        away = np.sqrt(np.maximum(0, 2 - 2 * t.unit[below] @ t.unit[t.centre[k]]))
        assert t.centre[k] in below and away.max() <= t.radius[k] + 1e-7
        for c in range(t.child_at[k], t.child_to[k]):
            assert t.radius[c] <= t.radius[k] + 1e-7 and t.first[k] <= t.first[c] < t.last[c] <= t.last[k]
    copy = covertree.CoverTree.unpack(t.pack())
    assert (copy.order == t.order).all() and (copy.x == t.x).all() and (copy.radius == t.radius).all()


def components(n, pairs):
    root = list(range(n))
    for i, j in sorted(pairs):
        a, b = root[i], root[j]
        if a != b:
            root = [min(a, b) if r in (a, b) else r for r in root]
    return root


@pytest.mark.parametrize(("tile", "cells"), [(40, 1024), (15, 5), (8192, 1024)])
def test_query_equals_brute_force(spark, tile, cells):
    x = data(3)
    x[200:220] = x[200]
    rows = [(i, v.tolist(), 0, "clash") for i, v in enumerate(x)]
    got = covertree.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, rep string"), tile=tile, cells=cells).collect()
    links, root = brute(x), components(len(x), brute(x))
    n = np.zeros(len(x), int)
    for i, j in links:
        n[i] += 1
        n[j] += 1
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got} == {i: (n[i], root[i], root[i] == i) for i in range(len(x))}


def test_awkward_vectors(spark):
    rows = [(0, None), (1, [0.0, 0.0]), (2, [math.nan, 1.0]), (3, [math.inf, 1.0]), (4, [1.0, None]), (5, []), (6, [1.0, 0.0]), (7, [2.0, 0.0]), (8, [1.0, 0.0, 0.0]), (9, [1e308, 0.0]), (10, [-1.0, 0.0]), (None, [1.0, 0.0]), (6, [1.0, 0.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = covertree.near_duplicates(frame).collect()
    assert len(got) == len(rows)
    by = {r.vec_id: r for r in got}
    assert all(by[k].n_links == 0 and by[k].component_id == k and by[k].kept for k in (0, 1, 2, 3, 4, 5, 8, 10))
    assert by[6].n_links == 4 and by[7].component_id == by[9].component_id == by[None].component_id == 6
    assert covertree.near_duplicates(frame.limit(0)).count() == 0


def test_vectors_without_an_id_link_others(spark):
    a, b, c = [1.0, 0.0], [0.97, 0.243], [0.88, 0.475]  # a and c are linked through b only
    assert brute(np.array([a, b, c])) == {(0, 1), (1, 2)}
    rows = [(7, a), (None, b), (3, c), (3, [0.0, 1.0]), (9, [0.0, 2.0])]
    got = {(r.vec_id, r.n_links): (r.component_id, r.kept) for r in covertree.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    assert got == {(7, 1): (3, False), (None, 2): (3, False), (3, 1): (3, True), (9, 1): (3, False)}


def clusters(n=40, each=30, d=24, seed=5):
    r = np.random.default_rng(seed)
    return np.vstack([c + r.normal(size=(each, d)) * 0.03 for c in r.normal(size=(n, d))])


def test_cells_that_cannot_meet_are_not_paired(spark):
    x = clusters()
    frame = spark.createDataFrame([(k, v.tolist(), 1, len(v)) for k, v in enumerate(x)], "node long, vector array<double>, copies long, dims int")
    reach = math.sqrt(2 - 2 * 0.95)
    placed, pairs = covertree._with_cells(frame, 30, 1024, reach)
    rows, n = placed.collect(), placed.select("cell").distinct().count()
    u = x / np.linalg.norm(x, axis=1)[:, None]
    meet = {(r.a, r.b) for r in pairs.collect()}
    assert n > 20 and len(meet) < n * (n + 1) / 2 / 4  # most pairs are ruled out
    cell = {r.node: r.cell for r in rows}
    assert all((min(cell[i], cell[j]), max(cell[i], cell[j])) in meet for i, j in brute(u))


def test_centres_cover_the_sample():
    x = clusters(seed=6)
    for cells in (1, 7, 64):
        c = covertree.top_centres(x, cells)
        assert 1 <= len(c) <= cells and np.allclose(np.linalg.norm(c, axis=1), 1)
