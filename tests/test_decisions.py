"""Suppression, first come first kept and climbing against literal scans, and on long chains and dense cells."""

from functools import reduce

import numpy as np
import pytest

from timberline.operators import decisions, stems

CIRCLES = "cid long, x double, y double, r double, z double, n long"


def frame(spark, rows):
    return spark.createDataFrame(rows, CIRCLES)


def some_circles(seed, n, levels=3, side=3.0):
    """Circles of which many overlap and some are copies, in no order of place."""
    r = np.random.default_rng(seed)
    rows = [(float(np.round(r.uniform(0, side), 1)), float(np.round(r.uniform(0, side), 1)), float(r.choice([0.1, 0.2, 0.3])), float(r.integers(0, levels)), int(r.integers(50, 60))) for _ in range(n)]
    rows += [rows[k] for k in r.integers(0, n, n // 4)]
    return [(int(k), *row) for k, row in zip(r.permutation(len(rows)), rows, strict=True)]


def overlap(a, b):
    return a[4] == b[4] and np.sqrt((a[1] - b[1]) * (a[1] - b[1]) + (a[2] - b[2]) * (a[2] - b[2])) < a[3] + b[3]


def scanned(rows):
    """cids that stand when each circle has had its turn."""

    def turn(standing, c):
        if c[0] not in standing:
            return standing
        met = [o for o in rows if overlap(c, o)]
        return standing if not met else (standing - {o[0] for o in met}) | {min(met, key=lambda o: (-o[5], o[0]))[0]}

    return reduce(turn, sorted(rows), {c[0] for c in rows})


@pytest.mark.parametrize("seed,block", [(1, 1 << 16), (2, 15), (3, 4), (4, 15)])
def test_suppression_equals_the_scan(spark, seed, block):
    rows = some_circles(seed, 80, side=2.0)
    got = stems.suppressed(frame(spark, rows), block=block).collect()
    assert {r.cid for r in got} == scanned(rows) and len(got) < 50


def test_circles_without_extent_or_place_stay(spark):
    rows = [(0, 0.0, 0.0, 0.0, 1.0, 5), (1, 0.0, 0.0, 0.0, 1.0, 9), (2, None, 0.0, 0.2, 1.0, 1), (3, 5.0, 5.0, None, 1.0, 1), (4, 9.0, 9.0, 0.2, 1.0, None), (5, 9.1, 9.0, 0.2, 1.0, 3), (6, 2.0, 2.0, 0.0, 1.0, 7), (7, 2.1, 2.0, 0.3, 1.0, 1)]
    assert {r.cid for r in stems.suppressed(frame(spark, rows)).collect()} == {0, 1, 2, 3, 5} | (scanned([rows[6], rows[7]]))


def test_a_chain_takes_rounds_by_blocks(spark, monkeypatch):
    """3,000 circles, each overlapping the next: as many rounds as blocks about, not as circles."""
    rounds, whole = [], decisions.checkpointed
    monkeypatch.setattr(decisions, "checkpointed", lambda df: rounds.append(1) or whole(df))
    c = spark.range(3000).selectExpr("id AS cid", "id * 0.3D AS x", "0.0D AS y", "0.2D AS r", "1.0D AS z", "50 + id % 3 AS n")
    got = {r.cid for r in stems.suppressed(c, block=400).collect()}
    assert got == scanned_line([(k, 50 + k % 3) for k in range(3000)]) and len(rounds) <= 12


def scanned_line(items):
    standing = [True] * len(items)
    for k in range(len(items)):
        if standing[k]:
            met = range(max(k - 1, 0), min(k + 2, len(items)))
            for o in met:
                standing[o] = False
            standing[min(met, key=lambda o: (-items[o][1], o))] = True
    return {k for k, s in enumerate(standing) if s}


def kept_places(rows, distance):
    kept = []
    for i, x, y in sorted(rows):
        if all(np.sqrt((x - a) * (x - a) + (y - b) * (y - b)) > distance for _, a, b in kept):
            kept.append((i, x, y))
    return {i for i, *_ in kept}


@pytest.mark.parametrize("seed,n,side,distance,at_once,block", [(1, 400, 10.0, 0.9, 32, 1 << 16), (2, 300, 2.0, 1.0, 4, 16), (3, 300, 30.0, 2.5, 1, 16)])
def test_first_come_equals_the_scan(spark, seed, n, side, distance, at_once, block):
    r = np.random.default_rng(seed)
    rows = [(int(k), *map(float, p)) for k, p in zip(r.permutation(n), r.uniform(0, side, (n, 2)), strict=True)]
    got = stems.unique_locations(spark.createDataFrame(rows, "tree_id long, x double, y double"), distance, at_once, block).collect()
    assert {x.tree_id for x in got} == kept_places(rows, distance)


def test_a_dense_cell_is_decided_a_few_at_a_time(spark, monkeypatch):
    """5,000 places in half a metre, beside a line of places a metre apart."""
    listed, whole = [], decisions.decided
    monkeypatch.setattr(decisions, "decided", lambda items, *a, **k: listed.append(items.selectExpr("sum(size(lower))").first()[0]) or whole(items, *a, **k))
    r = np.random.default_rng(7)
    rows = [(k + 100, *map(float, r.uniform(0, 0.5, 2))) for k in range(5000)] + [(k, 3.0 + k, 0.0) for k in range(50)]
    got = {x.tree_id for x in stems.unique_locations(spark.createDataFrame(rows, "tree_id long, x double, y double"), 2.0).collect()}
    assert got == kept_places(rows, 2.0) and sum(listed) < 5000


def climbed(rows, tile, at_least):
    """Stacks of one tile's circles as lists of cids, by following what lies next above circle after circle."""
    rows = sorted(rows, key=lambda c: (c[4], c[0]))
    top, tagged, out = max(c[4] for c in rows), set(), []

    def above(c):
        up = [o for o in rows if c[4] < o[4] <= c[4] + 2.5 and np.sqrt((o[1] - c[1]) ** 2 + (o[2] - c[2]) ** 2) < 0.1 and abs(o[3] - c[3]) < 0.2 * c[3]]
        low = min((o[4] for o in up), default=0)
        return min((o for o in up if o[4] <= low + 0.01), key=lambda o: (abs(o[3] - c[3]), o[4], o[0]), default=None)

    for c in rows:
        if c[0] in tagged or c[4] == top:
            continue
        stack = [c]
        while (n := above(stack[-1])) is not None:
            tagged.add(n[0])
            stack.append(n)
        if len(stack) > at_least:
            out.append([s[0] for s in stack])
    return out if len(rows) >= 10 else []


def columns(seed, n, levels):
    r = np.random.default_rng(seed)
    rows = []
    for x, y in r.uniform(0, 5, (n, 2)).round(1):
        for k in range(levels):
            if r.random() < 0.8:
                rows.append((float(np.round(x + r.uniform(-0.04, 0.04), 2)), float(np.round(y + r.uniform(-0.04, 0.04), 2)), float(r.choice([0.2, 0.21, 0.24])), round(k * 0.2, 1), 60))
    rows += [rows[k] for k in r.integers(0, len(rows), 15)]
    return [(int(k), *row) for k, row in zip(r.permutation(len(rows)), rows, strict=True)]


@pytest.mark.parametrize("seed,at_least", [(1, 10), (2, 3), (3, 0)])
def test_climbing_equals_the_scan(spark, seed, at_least):
    rows = columns(seed, 12, 20)
    got = {}
    for r in stems.climb(frame(spark, rows), 5.0, at_least).collect():
        got.setdefault(r.stem_id, []).append((r.seq, r.cid))
    stacks = [[c for _, c in sorted(got[k])] for k in sorted(got)]
    assert all(sorted(s for s, _ in v) == list(range(len(v))) for v in got.values())
    low, hop, want = [min(c[k] for c in rows) for k in (1, 2)], 2.5, []
    spans = [int(np.ceil((max(c[k] for c in rows) - low[k - 1]) / hop)) - 1 for k in (1, 2)]
    for tx in range(spans[0]):
        for ty in range(spans[1]):
            mine = [c for c in rows if all(low[d] + t * hop <= c[d + 1] < low[d] + t * hop + 5.0 for d, t in ((0, tx), (1, ty)))]
            want += climbed(mine, 5.0, at_least) if mine else []
    assert stacks == want and want


def test_one_tile_of_many_circles(spark):
    """A tile with 40,000 circles in 500 columns."""
    c = spark.range(40_000).selectExpr("id AS cid", "id % 500 DIV 25 * 0.2D AS x", "id % 25 * 0.2D AS y", "0.2D AS r", "id DIV 500 * 0.1D AS z", "60L AS n")
    far = frame(spark, [(50_000, 5.5, 5.5, 0.2, 0.0, 60)])
    found = stems.climb(c.union(far))
    assert found.groupBy("stem_id").count().where("count = 80").count() == found.select("stem_id").distinct().count() > 0
    assert found.where("seq = 79").select("cid").distinct().count() == 500


def test_outcomes():
    acts = {1: True, 2: False}
    assert decisions.outcome([], [], acts) == (True, 0)
    assert decisions.outcome([2, 1], [False, True], acts) == (True, 2) and decisions.outcome([2, 1], [True, False], acts) == (False, 2)
    assert decisions.outcome([3, 1], [False, False], acts) == (False, 2) and decisions.outcome([3, 1], [True, False], acts) == (None, 2)
    assert decisions.outcome([3], [True], acts) == (True, 1) and decisions.outcome([3], [False], acts) == (None, 1)
