"""Ground model (AGG2-7, JN1, JN4, JN5, FLT4): grid minima, outlier repair, interpolation and removal."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timberline.functions.scalar import cell
from timberline.operators.graph import checkpointed
from timberline.operators.neighbours import nearest
from timberline.operators.spatial import with_bounds

#: Cells on a side of the blocks in which neighbourhoods are looked at.
BLOCK = 64


def celled(points: DataFrame, size: float) -> DataFrame:
    """Points with ix, iy counted from the cloud's least x and y (kept as x0, y0); those with a null coordinate lie in no cell."""
    b = with_bounds(points.dropna(subset=["x", "y", "z"]))
    return b.withColumns({"ix": cell(F.col("x"), F.col("x0"), size), "iy": cell(F.col("y"), F.col("y0"), size)}).drop("x1", "y1")


def grid_minimum(points: DataFrame, size: float = 2.0) -> DataFrame:
    """AGG2: (ix, iy, zmin)."""
    return celled(points, size).groupBy("ix", "iy").agg(F.min("z").alias("zmin"))


def grid_lowest_point(points: DataFrame, size: float = 2.0) -> DataFrame:
    """AGG3: the first point (least pid) that has its cell's least z."""
    low = F.min(F.struct("z", "pid", "x", "y")).alias("low")
    return celled(points, size).groupBy("ix", "iy").agg(low).select("ix", "iy", "low.pid", "low.x", "low.y", "low.z")


def _in_blocks(cells: DataFrame, reach: int, value: str, extra: str, function: Callable[[np.ndarray, pa.Table, np.ndarray], pa.Array], more: tuple[str, ...] = (), side: int = BLOCK) -> DataFrame:
    """``cells`` (ix, iy, value, any others) with the column ``extra`` (double) that ``function`` finds block by block.

    A block has ``side`` cells a side. It gets its own cells whole and of the blocks around
    it the rim that its cells can see, with ``value`` and ``more``, so little more than each
    cell once is sent. ``function`` gets the places of the cells in the block (with its rim), the
    block's rows and which of them are its own.
    """
    if not 0 < reach <= side:
        raise ValueError("a block must be as wide as the reach")
    columns, shared = cells.columns, (value, *more)
    seen = lambda c: F.array_distinct(F.array(*[F.floor((F.col(c) + o) / side) for o in (-reach, 0, reach)]))
    home = (F.col("_bx") == F.floor(F.col("ix") / side)) & (F.col("_by") == F.floor(F.col("iy") / side))
    rest = [c for c in columns if c not in ("ix", "iy", *shared)]
    sent = cells.withColumn("_bx", F.explode(seen("ix"))).withColumn("_by", F.explode(seen("iy"))).withColumn("_own", home)
    sent = sent.select("_bx", "_by", "_own", F.col("ix").cast("long").alias("ix"), F.col("iy").cast("long").alias("iy"), *[F.col(c).cast("double").alias(c) for c in shared], *[F.when(F.col("_own"), F.col(c)).alias(c) for c in rest])

    def run(table: pa.Table) -> pa.Table:
        corner = [table.column(c)[0].as_py() * side - reach for c in ("_bx", "_by")]
        places = np.column_stack([table.column(c).to_numpy() - o for c, o in zip(("ix", "iy"), corner, strict=True)])
        at = np.flatnonzero(table.column("_own").to_numpy())
        return table.take(pa.array(at)).select(columns).append_column(extra, function(places, table, at))

    kinds = dict(cells.dtypes) | {"ix": "long", "iy": "long"} | dict.fromkeys(shared, "double")
    found = sent.groupBy("_bx", "_by").applyInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in columns), f"{extra} double"]))
    return found.withColumns({c: F.col(c).cast(dict(cells.dtypes)[c]) for c in ("ix", "iy")})


def _grid(places: np.ndarray, values: np.ndarray, reach: int, side: int) -> np.ndarray:
    grid = np.full((side + 2 * reach,) * 2, np.nan)
    grid[places[:, 0], places[:, 1]] = values
    return grid


def _around(grid: np.ndarray, places: np.ndarray, reach: int) -> np.ndarray:
    """The cells within ``reach`` of each place, row by row of the neighbourhood."""
    width = 2 * reach + 1
    return np.lib.stride_tricks.sliding_window_view(grid, (width, width))[places[:, 0] - reach, places[:, 1] - reach].reshape(-1, width * width).copy()


def _medians(around: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The median of the numbers in each row, and how many there are."""
    around.sort(axis=1)  # absent ones last
    n, rows = (~np.isnan(around)).sum(axis=1), np.arange(len(around))
    return 0.5 * around[rows, np.maximum(n - 1, 0) // 2] + 0.5 * around[rows, np.minimum(n // 2, around.shape[1] - 1)], n


def neighbourhood_median(cells: DataFrame, reach: int, value: str = "zmin", centre: bool = True, side: int = BLOCK) -> DataFrame:
    """JN15: ``cells`` (ix, iy, value, any others) with med, the median of the value over the occupied cells within ``reach``.

    Values that are null or no numbers count as absent; without any the median is null.
    """

    def medians(places: np.ndarray, table: pa.Table, own: np.ndarray) -> pa.Array:
        around = _around(_grid(places, table.column(value).to_numpy().astype(np.float64), reach, side), places[own], reach)
        if not centre:
            around[:, around.shape[1] // 2] = np.nan
        med, n = _medians(around)
        return pa.array(med, mask=n == 0)

    return _in_blocks(cells, reach, value, "med", medians, side=side)


def ground_points(points: DataFrame, size: float = 2.0, reach: int = 3, tolerance: float = 1.0) -> DataFrame:
    """AGG4: (ix, iy, gx, gy, gz), one ground point for each cell with points.

    Where the cell's least z is within ``tolerance`` of the 7 x 7 median it is
    the lowest point itself, else the cell's centre at the median.
    """
    low = celled(points, size).groupBy("ix", "iy").agg(F.min(F.struct("z", "pid", "x", "y")).alias("low"), F.first("x0").alias("x0"), F.first("y0").alias("y0"))
    low = low.withColumn("zmin", F.col("low.z"))
    near = F.abs(F.col("zmin") - F.col("med")) < tolerance
    pick = lambda a, b: F.when(near, a).otherwise(b)
    return neighbourhood_median(low, reach).select(
        "ix", "iy", pick(F.col("low.x"), F.col("x0") + (F.col("ix") + 0.5) * size).alias("gx"), pick(F.col("low.y"), F.col("y0") + (F.col("iy") + 0.5) * size).alias("gy"), pick(F.col("zmin"), F.col("med")).alias("gz")
    )


def _with_id(ground: DataFrame) -> DataFrame:
    """Ground points with one ordered id: by ix, then iy."""
    return ground.withColumn("gid", F.col("ix").cast("long") * (1 << 31) + F.col("iy"))


def ground_grid(points: DataFrame, ground: DataFrame, size: float = 4.0, k: int = 4, idw: bool = False) -> DataFrame:
    """JN5: (cx, cy, gz) for the cells that have points: the k nearest ground points, weighted by their distance.

    Farther points count more (Q2, kept because it decides which points survive
    removal); ``idw`` weights by the inverse. If all distances are 0, the mean.
    """
    b = with_bounds(points.dropna(subset=["x", "y", "z"]))
    cells = b.select(cell(F.col("x"), F.col("x0"), size).alias("cx"), cell(F.col("y"), F.col("y0"), size).alias("cy"), "x0", "y0").distinct()
    cells = cells.withColumns({"x": F.col("x0") + (F.col("cx") + 0.5) * size, "y": F.col("y0") + (F.col("cy") + 0.5) * size, "qid": F.struct("cx", "cy")})
    near = nearest(cells, _with_id(ground).select("gid", F.col("gx").alias("x"), F.col("gy").alias("y"), "gz"), k=k, query_id="qid", values=("gz",))
    weight = F.when(F.col("dist") > 0, 1.0 / F.col("dist")).otherwise(1e12) if idw else F.col("dist")
    total = F.sum(weight)
    return near.groupBy("qid").agg(F.when(total > 0, F.sum(F.col("gz") * weight) / total).otherwise(F.avg("gz")).alias("gz")).select("qid.cx", "qid.cy", "gz")


def above_ground(points: DataFrame, grid: DataFrame, thresh: float = 2.0, size: float = 4.0) -> DataFrame:
    """FLT4, JN1: points more than ``thresh`` above their cell's ground."""
    b = with_bounds(points.dropna(subset=["x", "y", "z"])).withColumns({"cx": cell(F.col("x"), F.col("x0"), size), "cy": cell(F.col("y"), F.col("y0"), size)})
    return b.join(grid.withColumnRenamed("gz", "_gz"), ["cx", "cy"]).where(F.col("z") > F.col("_gz") + thresh).select(*points.columns)


def remove_ground(points: DataFrame, thresh: float = 2.0, grid_size: float = 4.0) -> tuple[DataFrame, DataFrame]:
    """UDF16: (points above ground, ground points). The ground points always come from 2 m cells (Q16) and are computed once."""
    ground = checkpointed(ground_points(points))
    return above_ground(points, ground_grid(points, ground, grid_size), thresh, grid_size), ground


def height_above_ground(points: DataFrame, ground: DataFrame, crop: bool = False) -> DataFrame:
    """JN4: ``points`` with z relative to the nearest ground point in plan (column ``ground_z`` is added).

    ``crop`` takes only ground strictly inside the points' own bounds, unless
    there is none (Q11); otherwise all ground counts.
    """
    g = _with_id(ground).select("gid", F.col("gx").alias("x"), F.col("gy").alias("y"), F.col("gz").alias("ground_z"))
    if crop:
        b = points.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first()
        if None not in b:
            inside = g.where((F.col("x") > b[0]) & (F.col("x") < b[1]) & (F.col("y") > b[2]) & (F.col("y") < b[3]))
            g = g if inside.isEmpty() else inside
    near = nearest(points, g, k=1, values=("ground_z",)).select("pid", "ground_z")
    return points.join(near, "pid", "left").withColumn("z", F.col("z") - F.col("ground_z"))


def flat_minimum(points: DataFrame, size: float = 2.0) -> DataFrame:
    """AGG5: (ix, iy, z) least z by cell of a dense sensor's grid; a cell whose least z is the cloud's greatest counts as empty."""
    top = points.agg(F.max("z").alias("_top"))
    return grid_minimum(points, size).join(F.broadcast(top), F.lit(True)).where(F.col("zmin") < F.col("_top")).select("ix", "iy", F.col("zmin").alias("z"))


def _despiked_in_place(cells: DataFrame, thresh: float, side: int = BLOCK) -> DataFrame:
    """(ix, iy, z) after a scan by ix, then iy, in which each cell sees the cells before it as they have become.

    What a cell becomes depends on earlier ones only where those change, so guesses are made
    better until none changes: inside a block at once, between blocks by the rim that the
    next round sends. A cell's guess is right once those of the cells before it are; rounds
    follow the changes that lead from block to block, and later ones take only blocks that
    see a changed cell.
    """
    names = ("z", "v")

    def scan(places: np.ndarray, table: pa.Table, own: np.ndarray) -> pa.Array:
        z, v = (_grid(places, table.column(c).to_numpy().astype(np.float64), 1, side) for c in names)
        mine = places[own]
        here, later = z[mine[:, 0], mine[:, 1]], _around(z, mine, 1)[:, 5:]
        while True:
            med, n = _medians(np.concatenate([_around(v, mine, 1)[:, :4], later], axis=1))
            new = np.where((n > 0) & (np.abs(here - med) > thresh), med, here)
            if np.array_equal(new, v[mine[:, 0], mine[:, 1]], equal_nan=True):
                return pa.array(new, from_pandas=True)
            v[mine[:, 0], mine[:, 1]] = new

    state = checkpointed(cells.select("ix", "iy", F.col("z").cast("double").alias("z"), F.col("z").cast("double").alias("v")))
    seen = lambda c: F.array_distinct(F.array(*[F.floor((F.col(c) + o) / side) for o in (-1, 0, 1)]))
    steps = F.array(*[F.struct(F.lit(i).cast("long").alias("i"), F.lit(j).cast("long").alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    in_block = (F.floor(F.col("ix") / side) == F.col("_bx")) & (F.floor(F.col("iy") / side) == F.col("_by"))
    new = checkpointed(_in_blocks(state, 1, "z", "w", scan, ("v",), side))
    while True:
        changed = new.where(~F.col("w").eqNullSafe(F.col("v"))).select("ix", "iy", "w")
        if changed.isEmpty():
            return state.select("ix", "iy", F.col("v").alias("z"))
        state = state.join(changed.select(F.col("ix").alias("_ix"), F.col("iy").alias("_iy"), "w"), (F.col("ix") == F.col("_ix")) & (F.col("iy") == F.col("_iy")), "left")
        state = checkpointed(state.select("ix", "iy", "z", F.coalesce("w", "v").alias("v")))
        # the blocks that see a changed cell are scanned again, with those around them for their rims
        blocks = checkpointed(changed.select(F.explode(seen("ix")).alias("_bx"), "iy").select("_bx", F.explode(seen("iy")).alias("_by")).distinct())
        wide = blocks.withColumn("_s", F.explode(steps)).select((F.col("_bx") + F.col("_s.i")).alias("_bx"), (F.col("_by") + F.col("_s.j")).alias("_by")).distinct()
        new = _in_blocks(state.join(wide, in_block, "left_semi"), 1, "z", "w", scan, ("v",), side)
        new = checkpointed(new.join(blocks, in_block, "left_semi"))


def spike_filter(cells: DataFrame, thresh: float = 5.0, parity: bool = False, side: int = BLOCK) -> DataFrame:
    """AGG6: cells farther than ``thresh`` from the median of their 8 neighbours take it.

    One pass over the unchanged grid; with ``parity`` cell after cell in place (Q22).
    """
    if parity:
        return _despiked_in_place(cells, thresh, side)
    return neighbourhood_median(cells, 1, "z", centre=False, side=side).select("ix", "iy", F.when(F.abs(F.col("z") - F.col("med")) > thresh, F.col("med")).otherwise(F.col("z")).alias("z"))


def export_points(points: DataFrame, size: float = 2.0) -> DataFrame:
    """AGG7: (x, y, z) of each cell's lower corner with its least z."""
    b = points.agg(F.min("x").alias("_x0"), F.min("y").alias("_y0"))
    return flat_minimum(points, size).join(F.broadcast(b), F.lit(True)).select((F.col("_x0") + F.col("ix") * size).alias("x"), (F.col("_y0") + F.col("iy") * size).alias("y"), "z")


def running_minimum(points: DataFrame, size: float = 2.0) -> DataFrame:
    """Least z of absolute cells (counted from 0, not from the bounds), for clouds that arrive in pieces; null coordinates lie in no cell."""
    return points.dropna(subset=["x", "y", "z"]).groupBy(cell(F.col("x"), F.lit(0.0), size).alias("ix"), cell(F.col("y"), F.lit(0.0), size).alias("iy")).agg(F.min("z").alias("zmin"))


def lowest_window(points: DataFrame) -> DataFrame:
    """WIN5: each tree's first, last, lowest and highest point by (z, pid)."""
    w = Window.partitionBy("tree_id").orderBy("z", "pid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return points.select("tree_id", F.first("pid").over(w).alias("lowest"), F.last("pid").over(w).alias("highest")).distinct()
