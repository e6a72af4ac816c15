"""Circles by random triples (GRF8, GRF9, GRF11, AGG26): a task for a group of up to ``SHARE`` points, shares of that many for a larger one.

Draws are ranks of points in order of pid, seeded by the group's key, so results do
not depend on partitioning. In a large group the drawn points are joined by rank, every
share counts inliers, inner points and directions for the group's candidates, and the
sums of the counts decide as they would in one task.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.operators.graph import SALTS, checkpointed, numbered
from timberline.operators.predicates import slices
from timberline.operators.spatial import tile_spans

#: Points of a group that one task searches, and of a share of a larger group.
SHARE = 1 << 16
#: Points of a range of pids, in which a task looks for drawn points.
RANGE = 1 << 17
#: A tile, and a span of tiles whose points lie in all of them.
TILE, SPAN = ["slice", "tx", "ty"], ["slice", "tx0", "tx1", "ty0", "ty1"]


@dataclass(frozen=True)
class CircleSearch:
    """Limits of the random circle search (fixed values, lengths in metres)."""

    tests: int = 200
    r_min: float = 0.075
    r_max: float = 0.5
    band: float = 0.05
    inner_band: float = 0.05
    max_inner: int = 5
    min_inliers: int = 50
    bins: int = 11
    min_bins: int = 6
    min_points: int = 20


#: Many circles a tile, no refit.
MANY = CircleSearch()
#: The one best circle, with every angle covered and a least-squares refit.
BEST = CircleSearch(inner_band=0.1, max_inner=20, min_inliers=200, min_bins=11)


def seed_of(*key) -> int:
    return zlib.crc32(repr(tuple(float(k) if isinstance(k, (int, float, np.number)) else str(k) for k in key)).encode())


def circumcircles(triples: np.ndarray) -> np.ndarray:
    """(x, y, r) through each of n triples of points (n, 3, 2); nan for points on a line."""
    a, b, c = triples[:, 0], triples[:, 1], triples[:, 2]
    u, v = b - a, c - a
    cross = 2.0 * (u[:, 0] * v[:, 1] - u[:, 1] * v[:, 0])
    with np.errstate(divide="ignore", invalid="ignore"):
        uu, vv = (u * u).sum(1), (v * v).sum(1)
        x, y = (v[:, 1] * uu - u[:, 1] * vv) / cross, (u[:, 0] * vv - v[:, 0] * uu) / cross
        out = np.column_stack([a[:, 0] + x, a[:, 1] + y, np.hypot(x, y)])
    out[cross == 0] = np.nan
    return out


def angular_bins(dx: np.ndarray, dy: np.ndarray, bins: int = 11) -> np.ndarray:
    """AGG26: counts of directions in equal bins over [-pi, pi]."""
    return np.histogram(np.arctan2(dy, dx), bins=np.linspace(-np.pi, np.pi, bins + 1))[0]


def fit_circle(points: np.ndarray, start: np.ndarray, rounds: int = 20) -> np.ndarray:
    """GRF12: least squares of r - |p - centre| by Gauss-Newton."""
    p = np.array(start, float)
    for _ in range(rounds):
        d = points - p[:2]
        dist = np.maximum(np.hypot(d[:, 0], d[:, 1]), 1e-12)
        jac = np.column_stack([d / dist[:, None], np.ones(len(d))])
        step = np.linalg.lstsq(jac, dist - p[2], rcond=None)[0]
        p += step
        if np.abs(step).max() < 1e-10:
            break
    return p


def candidate_circles(xy: np.ndarray, seed: int, search: CircleSearch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(circle, inliers) of the random triples that pass every limit but :func:`goes_round`, in the order drawn; distances are held for a few circles at a time."""
    if len(xy) < search.min_points:
        return
    rng = np.random.default_rng(seed)
    circles = circumcircles(xy[rng.integers(0, len(xy), (search.tests, 3))])
    circles = circles[(search.r_min <= circles[:, 2]) & (circles[:, 2] <= search.r_max)]  # also drops nan
    step = max(1, (1 << 17) // len(xy))
    for at in range(0, len(circles), step):
        part = circles[at : at + step]
        off = np.hypot(xy[:, 0] - part[:, :1], xy[:, 1] - part[:, 1:2]) - part[:, 2:]
        on = np.abs(off) < search.band
        fits = (np.count_nonzero(on, axis=1) >= search.min_inliers) & (np.count_nonzero(off < -search.inner_band, axis=1) <= search.max_inner)
        for k in np.flatnonzero(fits).tolist():
            yield part[k], np.flatnonzero(on[k])


def goes_round(xy: np.ndarray, circle: np.ndarray, inliers: np.ndarray, search: CircleSearch) -> bool:
    """Whether the inliers lie in enough directions; looked at only where a circle would be taken."""
    d = xy[inliers] - circle[:2]
    return np.count_nonzero(angular_bins(d[:, 0], d[:, 1], search.bins) > 1) >= search.min_bins


def _standing(candidates: Iterable[tuple[np.ndarray, int, Callable[[], bool]]]) -> np.ndarray:
    """Rows (x, y, r, n) that stand when (circle, inliers, whether it goes round) come in the order drawn."""
    kept: list[tuple[float, float, float, int]] = []
    for (x, y, r), n, round_ in candidates:
        over = [k for k, c in enumerate(kept) if np.hypot(c[0] - x, c[1] - y) < c[2] + r]
        if len(over) > 1 or (over and n <= kept[over[0]][3]) or not round_():
            continue
        if not over:
            kept.append((x, y, r, n))
        else:
            kept[over[0]] = (x, y, r, n)
    return np.array(kept).reshape(-1, 4)


def find_circles(xy: np.ndarray, seed: int = 0, search: CircleSearch = MANY) -> np.ndarray:
    """GRF8: rows (x, y, r, n) of circles that do not overlap; of two that do, the one with more inliers stays.

    A candidate that overlaps several kept circles is dropped (only circles
    really kept are compared, Q25).
    """
    return _standing((c, len(on), lambda c=c, on=on: goes_round(xy, c, on, search)) for c, on in candidate_circles(xy, seed, search))


def find_best_circle(xy: np.ndarray, seed: int = 0, search: CircleSearch = BEST) -> np.ndarray | None:
    """GRF9: (x, y, r, n) of the candidate with most inliers, refitted to them; None without one."""
    best = None
    for circle, inliers in candidate_circles(xy, seed, search):
        if (best is None or len(inliers) > best[3]) and goes_round(xy, circle, inliers, search):
            p = fit_circle(xy[inliers], circle)
            if search.r_min < p[2] < search.r_max:
                best = np.array([*p, len(inliers)])
    return best


def _inliers(xy: np.ndarray, circles: np.ndarray, search: CircleSearch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets from the centre along x and along y, whether on the circle) of the points (g, n, 2) of each of g circles; offsets are 0 off the circle."""
    dx, dy = xy[:, :, 0] - circles[:, :1], xy[:, :, 1] - circles[:, 1:2]
    on = np.abs(np.hypot(dx, dy) - circles[:, 2:]) < search.band
    return np.where(on, dx, 0.0), np.where(on, dy, 0.0), on


def _go_round(xy: np.ndarray, circles: np.ndarray, search: CircleSearch) -> np.ndarray:
    """:func:`goes_round` of g circles, each among its own points."""
    dx, dy, on = _inliers(xy, circles, search)
    edges = np.linspace(-np.pi, np.pi, search.bins + 1)
    at = np.minimum(np.searchsorted(edges, np.arctan2(dy, dx), "right") - 1, search.bins - 1) + np.arange(len(xy))[:, None] * search.bins
    return np.count_nonzero(np.bincount(at[on], minlength=len(xy) * search.bins).reshape(-1, search.bins) > 1, axis=1) >= search.min_bins


def _fit_circles(xy: np.ndarray, circles: np.ndarray, search: CircleSearch, rounds: int = 20) -> np.ndarray:
    """:func:`fit_circle` of g circles to their inliers, by normal equations; one by one where these are badly conditioned."""
    on, p = _inliers(xy, circles, search)[2], circles.copy()
    open_, alone = np.arange(len(p)), []
    for _ in range(rounds):
        dx, dy = (np.where(on[open_], xy[open_, :, k] - p[open_, k, None], 0.0) for k in (0, 1))
        dist = np.maximum(np.hypot(dx, dy), 1e-12)
        jac = np.stack([dx / dist, dy / dist, on[open_].astype(float)], axis=2)
        normal = jac.transpose(0, 2, 1) @ jac
        values = np.linalg.eigvalsh(normal)
        bad = ~(values[:, 0] > 1e-6 * values[:, 2])
        alone += open_[bad].tolist()
        step = np.linalg.solve(normal[~bad], (jac[~bad].transpose(0, 2, 1) @ np.where(on[open_], dist - p[open_, 2:], 0.0)[~bad, :, None]))[:, :, 0]
        open_ = open_[~bad]
        p[open_] += step
        open_ = open_[np.abs(step).max(axis=1, initial=0.0) >= 1e-10]
        if not len(open_):
            break
    for k in alone:
        p[k] = fit_circle(xy[k][on[k]], circles[k], rounds)
    return p


def find_best_circles(xy: np.ndarray, seeds: list[int], search: CircleSearch = BEST) -> np.ndarray:
    """:func:`find_best_circle` of g groups of n points (g, n, 2) at once: rows (x, y, r, n), not a number without one.

    Draws are compared in order, a few and then the rest; a group whose best circle holds all of its points is done, as no later draw can hold more.
    """
    groups, n = xy.shape[:2]
    best = np.full((groups, 4), np.nan)
    if n < search.min_points or not groups:
        return best
    ranks = np.stack([np.random.default_rng(s).integers(0, n, (search.tests, 3)) for s in seeds])
    most = np.zeros(groups, np.int64)
    low = 0
    while low < search.tests and len(open_ := np.flatnonzero(most < n)):
        high = min(search.tests, max(8, 4 * low))
        size = high - low
        circles = circumcircles(xy[open_[:, None, None], ranks[open_, low:high]].reshape(-1, 3, 2))
        allowed = np.flatnonzero((search.r_min <= circles[:, 2]) & (circles[:, 2] <= search.r_max))  # also drops nan
        counts = np.zeros(len(circles), np.int64)
        step = max(1, (1 << 17) // n)
        for at in range(0, len(allowed), step):
            part = allowed[at : at + step]
            own = xy[open_[part // size]]
            off = np.hypot(own[:, :, 0] - circles[part, :1], own[:, :, 1] - circles[part, 1:2]) - circles[part, 2:]
            on = np.count_nonzero(np.abs(off) < search.band, axis=1)
            counts[part] = np.where((on >= search.min_inliers) & (np.count_nonzero(off < -search.inner_band, axis=1) <= search.max_inner), on, 0)
        counts, circles = counts.reshape(-1, size), circles.reshape(-1, size, 3)
        while True:  # each group's next candidate with more inliers than its best
            better = counts > most[open_, None]
            asked = np.flatnonzero(better.any(axis=1))
            if not len(asked):
                break
            for at in range(0, len(asked), step):
                rows = asked[at : at + step]
                first = better[rows].argmax(axis=1)
                held, found = counts[rows, first], circles[rows, first]
                counts[rows, first] = 0
                round_ = _go_round(xy[open_[rows]], found, search)
                rows, held, found = rows[round_], held[round_], found[round_]
                p = _fit_circles(xy[open_[rows]], found, search)
                fits = (search.r_min < p[:, 2]) & (p[:, 2] < search.r_max)
                to = open_[rows[fits]]
                best[to] = np.column_stack([p[fits], held[fits]])
                most[to] = held[fits]
        low = high
    return best


def in_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The tables of equal ``keys`` of rows that are sorted by them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(c).to_numpy(zero_copy_only=False) for c in keys]
        starts = [0, *(np.flatnonzero(reduce(np.logical_or, [c[1:] != c[:-1] for c in columns])) + 1).tolist(), batch.num_rows]
        if held and any(held[-1].column(c)[held[-1].num_rows - 1].as_py() != batch.column(c)[0].as_py() for c in keys):
            yield pa.Table.from_batches(held)
            held = []
        for low, high in zip(starts, starts[1:], strict=False):
            held.append(batch.slice(low, high - low))
            if high < batch.num_rows:
                yield pa.Table.from_batches(held)
                held = []
    if held:
        yield pa.Table.from_batches(held)


def _whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(keys, sizes, places of all their points) of the groups that end in each batch of rows sorted by ``key``, which has no nulls."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    whole = lambda own, xy: (own[cuts := np.flatnonzero(np.append(True, own[1:] != own[:-1]))], np.diff(np.append(cuts, len(own))), xy)
    for batch in batches:
        if not batch.num_rows:
            continue
        own, xy = batch.column(key).to_numpy(), np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in "xy"]).astype(float)
        last = int(np.searchsorted(own, own[-1]))  # the last group may go on
        if last or (held and held[-1][0][-1] != own[-1]):
            held.append((own[:last], xy[:last]))
            yield whole(*(np.concatenate(c) for c in zip(*held, strict=True)))
            held = []
        held.append((own[last:], xy[last:]))
    if held:
        yield whole(*(np.concatenate(c) for c in zip(*held, strict=True)))


def _by_size(points: DataFrame, keys: list[str], share: int) -> tuple[DataFrame, DataFrame | None]:
    """The points of groups of at most ``share`` points, and those of larger groups (None without one)."""
    sizes = points.groupBy(*keys).agg(F.count("*").alias("_n"))
    large = checkpointed(sizes.where(F.col("_n") > share).select(*keys))
    if large.isEmpty():
        return points, None
    salted = large.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = points.withColumn("_salt", F.pmod(F.xxhash64("pid"), F.lit(SALTS)).cast("int"))
    return tuple(dealt.join(salted.hint("merge"), [*keys, "_salt"], how).drop("_salt") for how in ("left_anti", "left_semi"))


def _fields(points: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"{k} {points.schema[k].dataType.simpleString()}" for k in keys)


def _dealt(points: DataFrame, keys: list[str], share: int) -> tuple[DataFrame, DataFrame]:
    """(points numbered through all groups in order of pid, with their share; (keys, _start, _n) of each group)."""
    placed = numbered(points.select(*keys, "pid", "x", "y"), *keys, "pid", "x", "y", name="_at")
    placed = placed.withColumn("_share", F.floor(F.col("_at") / share))
    return placed, placed.groupBy(*keys).agg(F.min("_at").alias("_start"), F.count("*").alias("_n"))


def _shares_of(groups: DataFrame, keys: list[str], share: int) -> DataFrame:
    """(keys, _share) of all shares that a group's points lie in."""
    first, last = F.floor(F.col("_start") / share), F.floor((F.col("_start") + F.col("_n") - 1) / share)
    return groups.select(*keys, F.explode(F.sequence(first, last)).alias("_share"))


def _drawn(placed: DataFrame, groups: DataFrame, keys: list[str], search: CircleSearch) -> DataFrame:
    """(keys, draw, cx, cy, cr) of the circles of allowed radius through each group's random triples."""
    fields = _fields(groups, keys)

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for row in pdf.to_dict("records"):
                ranks = np.random.default_rng(seed_of(*[row[k] for k in keys])).integers(0, row["_n"], (search.tests, 3)).ravel()
                yield pd.DataFrame({**{k: row[k] for k in keys}, "_place": np.arange(len(ranks)), "_at": row["_start"] + ranks})

    def through(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        triples = pdf.sort_values("_place")[["x", "y"]].to_numpy().reshape(-1, 3, 2)
        out = pd.DataFrame(circumcircles(triples), columns=["cx", "cy", "cr"])
        for at, (k, v) in enumerate(zip(keys, key, strict=True)):
            out.insert(at, k, v)
        out.insert(len(keys), "draw", np.arange(len(out)))
        return out[(search.r_min <= out["cr"]) & (out["cr"] <= search.r_max)]  # also drops nan

    ranks = groups.where(F.col("_n") >= search.min_points).mapInPandas(draw, f"{fields}, _place long, _at long")
    # as many as groups have draws, though planned as one a group: not to be broadcast by the driver
    return ranks.hint("merge").join(placed.select("_at", "x", "y"), "_at").groupBy(*keys).applyInPandas(through, f"{fields}, draw long, cx double, cy double, cr double")


def _fitting(counts: DataFrame, keys: list[str], search: CircleSearch) -> DataFrame:
    """(keys, draw, cx, cy, cr, n, round) of the candidates with enough inliers and few inner points by the sums of the shares' counts."""
    bins = [f"_b{k}" for k in range(search.bins)]
    sums = counts.groupBy(*keys, "draw").agg(*[F.first(c).alias(c) for c in ("cx", "cy", "cr")], F.sum("_on").alias("n"), F.sum("_inner").alias("_inner"), *[F.sum(b).alias(b) for b in bins])
    filled = reduce(lambda p, q: p + q, [(F.col(b) > 1).cast("int") for b in bins])
    fits = sums.where((F.col("n") >= search.min_inliers) & (F.col("_inner") <= search.max_inner))
    return fits.select(*keys, "draw", "cx", "cy", "cr", "n", (filled >= search.min_bins).alias("round"))


def _counted(placed: DataFrame, groups: DataFrame, keys: list[str], search: CircleSearch, share: int) -> DataFrame:
    """(keys, draw, cx, cy, cr, n, round) of the candidates with enough inliers and few inner points: counts of all shares, summed."""
    circle = F.struct("draw", "cx", "cy", "cr")
    asked = _drawn(placed, groups, keys, search).groupBy(*keys).agg(F.collect_list(circle).alias("c"))  # as many as draws at most
    asked = asked.hint("merge").join(_shares_of(groups, keys, share), keys).select(*keys, "_share", F.explode("c").alias("c")).select(*keys, "_share", "c.*")
    bins = [f"_b{k}" for k in range(search.bins)]

    def count(key: tuple, pdf: pd.DataFrame, circles: pd.DataFrame) -> pd.DataFrame:
        xy, rows = pdf[["x", "y"]].to_numpy(), []
        step = max(1, (1 << 17) // max(1, len(xy)))
        where = circles[["cx", "cy", "cr"]].to_numpy()
        for at in range(0, len(where), step):
            part = where[at : at + step]
            off = np.hypot(xy[:, 0] - part[:, :1], xy[:, 1] - part[:, 1:2]) - part[:, 2:]
            on, inner = np.abs(off) < search.band, np.count_nonzero(off < -search.inner_band, axis=1)
            for k in range(len(part)):
                d = xy[on[k]] - part[k, :2]
                rows.append((len(d), inner[k], *angular_bins(d[:, 0], d[:, 1], search.bins)))
        counts = pd.DataFrame(np.array(rows, np.int64).reshape(-1, 2 + search.bins), columns=["_on", "_inner", *bins])
        out = pd.concat([circles[[*keys, "draw", "cx", "cy", "cr"]].reset_index(drop=True), counts], axis=1)
        return out[(out["_on"] > 0) | (out["_inner"] > 0)]

    schema = f"{_fields(groups, keys)}, draw long, cx double, cy double, cr double, _on long, _inner long, {', '.join(f'{b} long' for b in bins)}"
    both = placed.select(*keys, "_share", "x", "y").groupBy(*keys, "_share").cogroup(asked.groupBy(*keys, "_share"))
    return _fitting(both.applyInPandas(count, schema), keys, search)


def _range_of(bounds: np.ndarray) -> Callable:
    """The place of a pid among ``bounds``, the last one for nulls."""

    @F.pandas_udf("int")
    def place(pid: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, pid.to_numpy(), "right").astype(np.int32))

    return place


def _in_tiles(df: DataFrame) -> DataFrame:
    """A row for each tile (tx, ty) that ``_mask`` has of a span's: bit 4 i + j for tile (tx0 + i, ty0 + j)."""
    bits = F.explode(F.filter(F.sequence(F.lit(0), F.lit(15)), lambda k: F.getbit(F.col("_mask"), k) == 1))
    return df.withColumn("_bit", bits).withColumns({"tx": F.col("tx0") + F.shiftright("_bit", 2), "ty": F.col("ty0") + F.col("_bit").bitwiseAND(F.lit(3))}).drop("_bit")


def _spans_by_size(spans: DataFrame, share: int) -> tuple[DataFrame, DataFrame | None, DataFrame | None]:
    """(points of each tile of at most ``share`` points; points of spans that have larger tiles, which ``_mask`` tells; those spans with _n points each); None without such a tile."""
    alone = lambda df: df.withColumn("tx", F.explode(F.sequence("tx0", "tx1"))).withColumn("ty", F.explode(F.sequence("ty0", "ty1")))
    tiles = alone(checkpointed(spans.groupBy(*SPAN).agg(F.count("*").alias("_n"))))
    large = checkpointed(tiles.groupBy(*TILE).agg(F.sum("_n").alias("_all")).where(F.col("_all") > share).select(*TILE))
    if large.isEmpty():
        return alone(spans).select(*TILE, "pid", "x", "y"), None, None
    own = (F.col("tx") - F.col("tx0")) * 4 + F.col("ty") - F.col("ty0")
    dense = checkpointed(tiles.join(large.hint("merge"), TILE).groupBy(*SPAN).agg(F.bit_or(F.pow(F.lit(2), own).cast("int")).alias("_mask"), F.first("_n").alias("_n")))
    salted = dense.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = spans.withColumn("_salt", F.pmod(F.xxhash64("pid"), F.lit(SALTS)).cast("int"))
    met = dealt.join(salted.hint("merge"), ["tx0", "ty0", "_salt", "slice", "tx1", "ty1"], "left").drop("_salt")
    small = alone(met).where(F.col("_mask").isNull() | (F.getbit(F.col("_mask"), own) == 0))
    return small.select(*TILE, "pid", "x", "y"), met.where(F.col("_mask").isNotNull()), dense


def _draws(points: DataFrame, spans: DataFrame, search: CircleSearch) -> DataFrame:
    """(TILE, _place, x, y) of the points that random triples of each tile of ``_mask`` are made of: those at the drawn ranks in order of pid.

    Pids are cut into ranges of some ``RANGE`` points. Counts by tile and range tell in which range a rank lies; a task has a range.
    """
    parts = max(1, min(1 << 14, -(-spans.agg(F.sum("_n")).first()[0] // RANGE)))
    cuts = points.agg(F.percentile_approx("pid", [k / parts for k in range(1, parts)], max(10_000, 6 * parts))).first()[0] if parts > 1 else None
    placed = points.withColumn("_range", _range_of(np.unique(np.array(cuts or [])))("pid"))
    counts = _in_tiles(placed.groupBy(*SPAN, "_mask", "_range").agg(F.count("*").alias("_n")))
    runs = counts.groupBy(*TILE, "_range").agg(F.sum("_n").alias("_n"))

    def draw(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_range")
        ends = np.cumsum(pdf["_n"].to_numpy())
        tests = search.tests if ends[-1] >= search.min_points else 0
        ranks = np.random.default_rng(seed_of(*key)).integers(0, ends[-1], (tests, 3)).ravel()
        at = np.searchsorted(ends, ranks, "right")
        return pd.DataFrame({**dict(zip(TILE, key, strict=True)), "_place": np.arange(len(ranks)), "_range": pdf["_range"].to_numpy()[at], "_rank": ranks - (ends - pdf["_n"].to_numpy())[at]})

    def pick(pdf: pd.DataFrame, drawn: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["pid", "x", "y"]).reset_index(drop=True)
        tiles = [own.assign(tx=own["tx0"] + k // 4, ty=own["ty0"] + k % 4) for k in range(16) if len(own := pdf[pdf["_mask"].to_numpy() >> k & 1 == 1])]
        if not tiles:
            return drawn[[*TILE, "_place"]].assign(x=0.0, y=0.0)[:0]
        each = pd.concat(tiles).sort_index(kind="stable")
        each["_rank"] = each.groupby(TILE, sort=False).cumcount()
        return drawn.merge(each[[*TILE, "_rank", "x", "y"]], on=[*TILE, "_rank"])[[*TILE, "_place", "x", "y"]]

    ranks = runs.groupBy(*TILE).applyInPandas(draw, "slice int, tx int, ty int, _place long, _range int, _rank long")
    held = placed.select("_range", "slice", "tx0", "ty0", "_mask", "pid", "x", "y")
    return held.groupBy("_range").cogroup(ranks.groupBy("_range")).applyInPandas(pick, "slice int, tx int, ty int, _place long, x double, y double")


def _weighed(points: DataFrame, spans: DataFrame, search: CircleSearch, share: int) -> DataFrame:
    """(TILE, draw, cx, cy, cr, n, round) as :func:`_counted`: each span's places, once with the number of their copies, are dealt into shares that count for the candidates of all of its tiles."""

    def through(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(circumcircles(pdf.sort_values("_place")[["x", "y"]].to_numpy().reshape(-1, 3, 2)), columns=["cx", "cy", "cr"])
        out = pd.concat([pd.DataFrame(dict(zip(TILE, key, strict=True)), index=out.index), out], axis=1)
        out.insert(len(TILE), "draw", np.arange(len(out)))
        return out[(search.r_min <= out["cr"]) & (out["cr"] <= search.r_max)]  # also drops nan

    parts = F.ceil(F.col("_n") / share).cast("int")
    found = _draws(points, spans, search).groupBy(*TILE).applyInPandas(through, "slice int, tx int, ty int, draw long, cx double, cy double, cr double")
    asked = found.hint("merge").join(_in_tiles(spans), TILE).select(*SPAN, F.explode(F.sequence(F.lit(0), parts - 1)).alias("_share"), "tx", "ty", "draw", "cx", "cy", "cr")
    places = points.groupBy(*SPAN, "_n", "x", "y").agg(F.count("*").alias("w"))
    places = places.select(*SPAN, F.pmod(F.xxhash64("x", "y"), parts).cast("int").alias("_share"), "x", "y", "w")
    bins, edges = [f"_b{k}" for k in range(search.bins)], np.linspace(-np.pi, np.pi, search.bins + 1)

    def count(pdf: pd.DataFrame, circles: pd.DataFrame) -> pd.DataFrame:
        xy, w = pdf[["x", "y"]].to_numpy(), pdf["w"].to_numpy(float)
        where, sums = circles[["cx", "cy", "cr"]].to_numpy(), np.zeros((len(circles), 2 + search.bins), np.int64)
        step = max(1, (1 << 17) // max(1, len(xy)))
        for at in range(0, len(where), step):
            part = where[at : at + step]
            dx, dy = xy[:, 0] - part[:, :1], xy[:, 1] - part[:, 1:2]
            off = np.hypot(dx, dy) - part[:, 2:]
            on = np.abs(off) < search.band
            k, p = np.nonzero(on)
            way = np.minimum(np.searchsorted(edges, np.arctan2(dy[on], dx[on]), "right") - 1, search.bins - 1)
            sums[at : at + step] = np.column_stack([on @ w, (off < -search.inner_band) @ w, np.bincount(k * search.bins + way, w[p], len(part) * search.bins).reshape(-1, search.bins)])
        out = pd.concat([circles[[*TILE, "draw", "cx", "cy", "cr"]].reset_index(drop=True), pd.DataFrame(sums, columns=["_on", "_inner", *bins])], axis=1)
        return out[(out["_on"] > 0) | (out["_inner"] > 0)]

    both = places.groupBy(*SPAN, "_share").cogroup(asked.groupBy(*SPAN, "_share"))
    counts = both.applyInPandas(count, f"slice int, tx int, ty int, draw long, cx double, cy double, cr double, _on long, _inner long, {', '.join(f'{b} long' for b in bins)}")
    return _fitting(counts, TILE, search)


def _many_of_large(points: DataFrame, spans: DataFrame, search: CircleSearch, share: int) -> DataFrame:
    """(TILE, k, x, y, r, n): GRF8 for tiles of any size; the draws of a tile, not its points, meet in a task."""

    def decide(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("draw").itertuples(index=False)
        out = pd.DataFrame(_standing(((r.cx, r.cy, r.cr), r.n, lambda r=r: r.round) for r in rows), columns=["x", "y", "r", "n"])
        out.insert(0, "k", np.arange(len(out)))
        for at, (k, v) in enumerate(zip(TILE, key, strict=True)):
            out.insert(at, k, v)
        return out

    return _weighed(checkpointed(points), spans, search, share).groupBy(*TILE).applyInPandas(decide, "slice int, tx int, ty int, k long, x double, y double, r double, n long")


def _refitted(inliers: DataFrame, chosen: DataFrame, shares: DataFrame, key: str, rounds: int = 20) -> DataFrame:
    """(key, x, y, r): GRF12 for each key's inliers by Gauss-Newton; each round is one sum of normal equations over the shares."""
    state = chosen.select(key, F.col("cx").alias("x0"), F.col("cy").alias("y0"), F.col("cr").alias("r0"))
    fields = _fields(chosen, [key])
    sums = ["uu", "uv", "u", "vv", "v", "n", "ue", "ve", "e"]

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            m = pdf[sums].to_numpy(float)
            steps = np.array([np.linalg.lstsq(a.reshape(3, 3), b, rcond=None)[0] for a, b in zip(m[:, [0, 1, 2, 1, 3, 4, 2, 4, 5]], m[:, 6:], strict=True)]).reshape(-1, 3)
            out = pdf[[key]].copy()
            for k, c in enumerate(("x0", "y0", "r0")):
                out[c] = pdf[c] + steps[:, k]
            out["step"] = np.abs(steps).max(1, initial=0.0)
            yield out

    for _ in range(rounds):
        met = inliers.join(state.join(shares, key), [key, "_share"])
        dx, dy = F.col("x") - F.col("x0"), F.col("y") - F.col("y0")
        dist = F.greatest(F.sqrt(dx * dx + dy * dy), F.lit(1e-12))
        each = met.select(key, "x0", "y0", "r0", (dx / dist).alias("u"), (dy / dist).alias("v"), (dist - F.col("r0")).alias("e"))
        products = {"uu": ("u", "u"), "uv": ("u", "v"), "vv": ("v", "v"), "ue": ("u", "e"), "ve": ("v", "e")}
        total = each.groupBy(key).agg(*[F.first(c).alias(c) for c in ("x0", "y0", "r0")], *[F.sum(F.col(a) * F.col(b)).alias(n) for n, (a, b) in products.items()], *[F.sum(c).alias(c) for c in ("u", "v", "e")], F.count("*").alias("n"))
        moved = checkpointed(total.mapInPandas(solve, f"{fields}, x0 double, y0 double, r0 double, step double"))
        state = moved.drop("step")
        if (moved.agg(F.max("step")).first()[0] or 0.0) < 1e-10:
            break
    return state.select(key, F.col("x0").alias("x"), F.col("y0").alias("y"), F.col("r0").alias("r"))


def _best_of_large(points: DataFrame, key: str, search: CircleSearch, share: int) -> DataFrame:
    """(key, x, y, r, n): GRF9 for groups of any size; a candidate whose refit leaves the limits gives way to the next."""
    placed, groups = _dealt(points, [key], share)
    groups = checkpointed(groups)
    shares = _shares_of(groups, [key], share)
    left = checkpointed(_counted(placed, groups, [key], search, share).where("round").drop("round"))
    found: list[DataFrame] = []
    while not left.isEmpty():
        best = F.max(F.struct("n", (-F.col("draw")).alias("_d"), "cx", "cy", "cr")).alias("b")
        chosen = checkpointed(left.groupBy(key).agg(best).select(key, "b.n", (-F.col("b._d")).alias("draw"), "b.cx", "b.cy", "b.cr"))
        off = F.sqrt((F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")) + (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy"))) - F.col("cr")
        inliers = checkpointed(placed.join(chosen.join(shares, key), [key, "_share"]).where(F.abs(off) < search.band).select(key, "_share", "x", "y"))
        fitted = _refitted(inliers, chosen, shares, key).join(chosen.select(key, "n"), key)
        taken = checkpointed(fitted.where((F.col("r") > search.r_min) & (F.col("r") < search.r_max)).select(key, "x", "y", "r", "n"))
        found.append(taken)
        left = checkpointed(left.join(taken, key, "left_anti").join(chosen.select(key, "draw"), [key, "draw"], "left_anti"))
    none = points.sparkSession.createDataFrame([], f"{_fields(points, [key])}, x double, y double, r double, n long")
    return reduce(DataFrame.union, found, none).withColumn("n", F.col("n").cast("double"))


def best_circles(points: DataFrame, key: str, search: CircleSearch = BEST, share: int | None = None) -> DataFrame:
    """GRF9 for each key, a long: (key, x, y, r, n) of the best circle of its points, drawn by the key.

    A key of more than ``share`` points (``SHARE``) is searched by shares; its refit is
    equal to that of one task but for rounding.
    """
    names = [key, "x", "y", "r", "n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for own, sizes, xy in _whole_groups(batches, key):
            starts, best = np.cumsum(sizes) - sizes, np.full((len(own), 4), np.nan)
            for n in np.unique(sizes).tolist():  # groups of one size at once
                at = np.flatnonzero(sizes == n)
                best[at] = find_best_circles(xy[starts[at, None] + np.arange(n)], [seed_of(k) for k in own[at].tolist()], search)
            found = np.flatnonzero(~np.isnan(best[:, 3]))
            yield pa.RecordBatch.from_arrays([pa.array(own[found], pa.int64()), *[pa.array(c) for c in best[found].T]], names=names)

    small, large = _by_size(points.where(F.col(key).isNotNull()).select(key, "pid", "x", "y"), [key], share or SHARE)
    out = small.select(key, "pid", "x", "y").repartition(key).sortWithinPartitions(key, "pid").mapInArrow(run, f"{key} long, x double, y double, r double, n double")
    return out if large is None else out.union(_best_of_large(large, key, search, share or SHARE))


def circle_stacks(points: DataFrame, dh: float = 0.2, low: float | None = None, high: float | None = None, tile: float = 2.0, search: CircleSearch = MANY, share: int | None = None) -> DataFrame:
    """GRF11: (cid, x, y, r, z, n) circles of every slice and half-overlapping tile; tiles of more than ``share`` points (``SHARE``) are searched by shares.

    A cid is made of slice, tile and place there, so ids rise from the ground
    (Q26) without any global order. Points with a null coordinate lie in no
    slice or tile; an empty cloud gives no circles.
    """
    if low is None or high is None:
        least, most = points.agg(F.min("z"), F.max("z")).first()
        least, most = (0.0, 0.0) if least is None else (least, most)
        low = least if low is None else low
        high = most - dh if high is None else high
    spans = tile_spans(slices(points, low, high, dh), tile, "slice").select(*SPAN, "pid", "x", "y")
    small, large, dense = _spans_by_size(spans, share or SHARE)

    def search_group(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["pid", "x", "y"])
        out = pd.DataFrame(find_circles(pdf[["x", "y"]].to_numpy(), seed_of(*key), search), columns=["x", "y", "r", "n"])
        out.insert(0, "k", np.arange(len(out)))
        for at, (k, v) in enumerate(zip(TILE, key, strict=True)):
            out.insert(at, k, v)
        return out

    found = small.groupBy(*TILE).applyInPandas(search_group, "slice int, tx int, ty int, k long, x double, y double, r double, n long")
    if large is not None:
        found = found.union(_many_of_large(large, dense, search, share or SHARE))
    number = reduce(lambda a, b: F.shiftleft(a, 20) + b, [F.col(k).cast("long") for k in TILE])
    return found.select((F.shiftleft(number, 8) + F.col("k")).alias("cid"), "x", "y", "r", (F.lit(float(low)) + F.col("slice") * dh + dh / 2).alias("z"), "n")
