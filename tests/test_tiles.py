"""Pairs of codes: tiles meet tiles once, whatever their size, and codes travel as bytes."""

import numpy as np
import pytest

from timberline.operators import active

CODES = "id long, code array<double>, prob double, label int"


@pytest.fixture
def pool(spark, monkeypatch):
    """120 codes of which some are no 4-byte floats and some are copies, in tiles of 16 at most."""
    monkeypatch.setattr(active, "LEAST_TILE", 8)
    monkeypatch.setattr(active, "LARGEST_TILE", 16)
    r = np.random.default_rng(3)
    codes = r.normal(size=(120, 5))
    codes[:60] = codes[:60].astype("f4")
    codes[100:] = codes[:20]
    probs = r.uniform(size=120)
    return spark.createDataFrame([(k, codes[k].tolist(), float(probs[k]), k % 3) for k in range(120)], CODES).repartition(3), codes, probs


def test_mean_distances_by_tiles(pool):
    """jn8, al4, al8: a code is sent once a tile, not once a block of 512."""
    frame, codes, _ = pool
    dist = np.sqrt(((codes[:, None] - codes[None]) ** 2).sum(2))
    got = {r.id: r.spread for r in active.mean_distances(frame.select("id", "code")).collect()}
    assert got == {k: pytest.approx(dist[k].mean()) for k in range(120)}
    assert active._tile_size(720_000) == active.LARGEST_TILE and active._paired_tiles(active._packed(frame, "id"), active.F.lit(8).cast("long")).count() == 120 * 8
    assert {len(r.bits) for r in active._packed(frame.where("id < 60"), "id").collect()} == {20}


def test_nearest_codes_by_tiles(pool):
    """jn7: copies are told apart by id."""
    frame, codes, _ = pool
    dist = np.sqrt(((codes[:, None] - codes[None]) ** 2).sum(2))
    got = sorted((r.id, r["rank"], r.lid, r.label) for r in active.nearest_codes(frame, frame, 5).collect())
    want = [(k, n + 1, int(j), int(j) % 3) for k in range(120) for n, j in enumerate(np.lexsort((np.arange(120), dist[k]))[:5])]
    assert got == want


def test_far_medoids_of_all_starts_together(pool, monkeypatch):
    """al6: the starts share each round's jobs; clusters in one tile or several give what one place gives."""
    frame, codes, probs = pool
    ids = np.arange(120)
    want = []
    for seed in (4, 5):
        order = {r.id: r.h for r in frame.select("id", active.F.xxhash64(active.F.lit(seed), "id").alias("h")).collect()}
        medoids, _, cost = active.k_medoids(codes, probs, 4, 6, start=np.array(sorted(order, key=order.get)))
        want.append(({k % 100 for k in ids[medoids].tolist()}, pytest.approx(cost)))  # of copies either
    for size in (1 << 17, 10):
        monkeypatch.setattr(active, "CLUSTER", size)
        assert [({k % 100 for k in found}, cost) for found, cost in active._far_medoids(frame, 4, 6, 1.0, [4, 5])] == want
