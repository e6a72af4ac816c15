import hashlib
import math
import random

import numpy as np
import pytest

from timberline.llm import vectorcodes

SCHEMA = "vec_id long, embedding array<float>, label int, ints string, code int, upper string, slot int"


def table(spark, rows):
    return spark.createDataFrame([(i, e, label, "x", 1, "u", 2) for i, e, label in rows], SCHEMA)


def brute(rows, parts=16, entries=64, rounds=2):
    """The contract, in Python integers, every part against every entry."""
    kept = [(i, e, label) for i, e, label in rows if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0))
    d = len(kept[0][1]) // parts
    ints = [[math.floor(256 * float(np.float32(x))) for x in e] for _, e, _ in kept]
    cut = [[v[p * d : p * d + d] for p in range(parts)] for v in ints]
    books = [[list(v[p]) for v in cut[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, c, strict=True)), k) for k, c in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            mine = [nearest(v[p], books[p])[1] for v in cut]
            for k in range(len(books[p])):
                own = [v[p] for v, m in zip(cut, mine, strict=True) if m == k]
                if own:
                    books[p][k] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    out = {}
    for (i, _, label), v in zip(kept, cut, strict=True):
        best = [nearest(v[p], books[p]) for p in range(parts)]
        out[i] = ("".join(f"{k:02x}" for _, k in best), sum(e for e, _ in best), label)
    digest = hashlib.sha256(",".join(str(x) for book in books for c in book for x in c).encode()).hexdigest()
    return out, digest


def check(spark, rows, **options):
    want, digest = brute(rows, **options)
    sums = {}
    for _, e, label in want.values():
        sums[label] = sums.get(label, 0) + e
    got = vectorcodes.encode(table(spark, rows), **options).collect()
    assert len(got) == len(want)
    for r in got:
        code, error, label = want[r.vec_id]
        assert (r.code, r.error, r.label_error, r.codebooks_sha256) == (code, error, sums[label], digest)


def some(seed, n, width=64, spread=0.3):
    r = random.Random(seed)
    return [(k, [r.gauss(0, spread) for _ in range(width)], r.choice([None, 0, 1, 2])) for k in range(n)]


@pytest.mark.parametrize("seed,n,options", [(1, 300, {}), (2, 40, {}), (3, 500, {"entries": 5, "rounds": 4}), (4, 200, {"parts": 4, "rounds": 3}), (5, 1, {}), (6, 100, {"entries": 1})])
def test_equals_brute_force(spark, seed, n, options):
    check(spark, some(seed, n), **options)


def test_ties_and_repeated_vectors(spark):
    r = random.Random(9)
    grid = [(k, [r.randint(-2, 2) / 256 for _ in range(32)], r.choice([None, 1])) for k in range(400)]
    check(spark, grid, entries=16, rounds=3)
    check(spark, [(k, [0.25] * 32, 1) for k in range(50)])


def test_far_clusters_are_skipped_by_the_bounds():
    """Entries that move little leave most parts without a full comparison, and the codes are those of a full one."""
    r = np.random.default_rng(3)
    centre = r.integers(-5000, 5000, (20, 4))
    x = (centre[r.integers(0, 20, 5000)] + r.integers(-20, 21, (5000, 4))).astype(np.int64)
    code, best, second = vectorcodes.nearest(x, centre)
    up, down = vectorcodes.up(np.sqrt(best.astype(float))), vectorcodes.down(np.sqrt(second.astype(float)))
    for _ in range(3):
        new = centre + r.integers(-30, 31, centre.shape)
        code, up, down, scanned = vectorcodes.bounded(x, new, vectorcodes.moves(centre, new), code, up, down)
        full, best, second = vectorcodes.nearest(x, new)
        assert (code == full).all() and scanned < 500
        assert (up.astype(float) ** 2 >= best * (1 - 1e-12)).all() and (down.astype(float) ** 2 <= second).all()
        centre = new


def test_awkward_vectors(spark):
    rows = some(7, 80, 32) + [(100, None, 1), (101, [None] * 32, 1), (102, [float("nan")] * 32, 2), (103, [float("inf")] + [0.0] * 31, 2), (104, [-0.001] * 32, None)]
    check(spark, rows)
    # repeated rows and null ids stay, shorter vectors count as followed by zeros
    got = vectorcodes.encode(table(spark, [*rows, rows[0], rows[0], (None, [0.1] * 32, None), (105, [0.5] * 10, 3), (106, [], 3), (107, [0.5] * 10 + [0.0] * 22, 4)])).collect()
    by = {r.vec_id: r for r in got}
    assert len(got) == 81 + 6 and len({r.code for r in got if r.vec_id == 0}) == 1 and by[105].code == by[107].code
    assert vectorcodes.encode(table(spark, [])).collect() == [] and vectorcodes.encode(table(spark, [(1, None, 1)])).collect() == []


def test_huge_components_are_held(spark):
    rows = [(k, [(-1) ** k * 1e37] * 64, 0) for k in range(70)] + [(70, [3.0] * 64, 0)]
    got = vectorcodes.encode(table(spark, rows), entries=1).collect()
    assert len(got) == 71 and all(0 <= r.error < 1 << 63 for r in got) and got[0].label_error == (1 << 63) - 1


def test_both_ways_to_join_label_sums(spark):
    coded = spark.createDataFrame([(k, k % 7 or None, "00", k) for k in range(100)], "vec_id long, label int, code string, error long")
    few = {tuple(r) for r in vectorcodes.with_label_errors(coded).collect()}
    assert few == {tuple(r) for r in vectorcodes.with_label_errors(coded, 2).collect()} and len(few) == 100
