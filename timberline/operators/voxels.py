"""Voxels and raster layers (AGG8-15, AGG28-30). Grids stay sparse; a missing cell is 0."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.functions.scalar import jet, kernel_table
from timberline.operators.ground import height_above_ground
from timberline.operators.projections import recentred, voxel_index


def occupancy(points: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """AGG8: the distinct occupied cells of points that have ix, iy, iz."""
    return points.select(*(keys or []), "ix", "iy", "iz").distinct()


def voxelised(points: DataFrame, keys: list[str], grid: tuple[int, int, int], res, centre=None) -> DataFrame:
    """PRJ3 then PRJ2: points with ix, iy, iz of their cloud's grid."""
    return voxel_index(recentred(points, keys, grid, res, centre), grid, res)


def convolved(cells: DataFrame, grid: tuple[int, int], size: int, keys: list[str], weighted: bool = True, value: str = "v") -> DataFrame:
    """Sum of a sparse layer's neighbourhood under the window's weights, same size, zero outside.

    Each cell is sent to the cells its window reaches, so the cost follows the
    occupied cells; cells that receive nothing are not rows. For even sizes the
    window leans to the lower side, as a 'same' convolution does.
    """
    shift = 1 if size % 2 == 0 else 0
    table = [(i + shift, j + shift, w) for i, j, w in kernel_table(size, weighted)]
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(w).alias("w")) for i, j, w in table])
    sent = cells.withColumn("_o", F.explode(offsets)).withColumns({"ix": F.col("ix") + F.col("_o.i"), "iy": F.col("iy") + F.col("_o.j")})
    inside = F.col("ix").between(0, grid[0] - 1) & F.col("iy").between(0, grid[1] - 1)
    return sent.where(inside).groupBy(*keys, "ix", "iy").agg(F.sum(F.col(value) * F.col("_o.w")).alias("v"))


def neighbourhood_max(cells: DataFrame, grid: tuple[int, int], size: int, keys: list[str], weighted: bool = True, value: str = "v", floor: float = 0.6) -> DataFrame:
    """Largest value of a sparse non-negative layer within a disc (weights over ``floor``) or a square.

    Cells beyond the border mirror those inside, which adds nothing to a
    maximum over a symmetric window, so they are left out.
    """
    offsets = F.array(*[F.struct(F.lit(-i).alias("i"), F.lit(-j).alias("j")) for i, j, w in kernel_table(size, weighted) if w > floor])
    sent = cells.withColumn("_o", F.explode(offsets)).withColumns({"ix": F.col("ix") + F.col("_o.i"), "iy": F.col("iy") + F.col("_o.j")})
    inside = F.col("ix").between(0, grid[0] - 1) & F.col("iy").between(0, grid[1] - 1)
    return sent.where(inside).groupBy(*keys, "ix", "iy").agg(F.max(value).alias("v"))


def _kernel_sum(size: int, weighted: bool) -> float:
    return sum(w for _, _, w in kernel_table(size, weighted))


def vertical_density(points: DataFrame, keys: list[str], grid: tuple[int, int, int], support: int = 1, weighted: bool = True) -> DataFrame:
    """AGG9: share of occupied voxels in each column, averaged over the window."""
    n = occupancy(points, keys).groupBy(*keys, "ix", "iy").agg(F.count("*").cast("double").alias("v"))
    if support == 1:
        return n.withColumn("v", F.col("v") / grid[2])
    return convolved(n, grid[:2], support, keys, weighted).withColumn("v", F.col("v") / (grid[2] * _kernel_sum(support, weighted)))


def max_height(points: DataFrame, keys: list[str], grid: tuple[int, int, int], support: int = 1, weighted: bool = True, parity: bool = False) -> DataFrame:
    """AGG10: highest occupied voxel of each column, then of the window's disc.

    ``parity`` gives the lowest one at support 1 (Q1), which published weights were trained on.
    """
    top = points.groupBy(*keys, "ix", "iy").agg((F.min if parity and support == 1 else F.max)("iz").cast("double").alias("v"))
    return top if support == 1 else neighbourhood_max(top, grid[:2], support, keys, weighted)


def column_returns(points: DataFrame, keys: list[str], value: str) -> DataFrame:
    """PRJ12: one return a voxel, the last point's."""
    return points.groupBy(*keys, "ix", "iy", "iz").agg(F.max_by(F.col(value), "pid").alias("ret"))


def mean_returns(points: DataFrame, keys: list[str], grid: tuple[int, int, int], value: str = "intensity", support: int = 1, weighted: bool = True) -> DataFrame:
    """AGG11: sum of the column's returns over its full height (Q5), averaged over the window."""
    total = column_returns(points, keys, value).groupBy(*keys, "ix", "iy").agg(F.sum("ret").alias("v"))
    if support == 1:
        return total.withColumn("v", F.col("v") / grid[2])
    return convolved(total, grid[:2], support, keys, weighted).withColumn("v", F.col("v") / (grid[2] * _kernel_sum(support, weighted)))


def max_returns(points: DataFrame, keys: list[str], grid: tuple[int, int, int], value: str = "intensity", support: int = 1, weighted: bool = True, parity: bool = False) -> DataFrame:
    """AGG12: greatest return of the column (0 if all are negative), then of the window; ``parity`` sums the window (Q4)."""
    top = column_returns(points, keys, value).groupBy(*keys, "ix", "iy").agg(F.greatest(F.max("ret"), F.lit(0.0)).alias("v"))
    if support == 1:
        return top
    return convolved(top, grid[:2], support, keys, weighted) if parity else neighbourhood_max(top, grid[:2], support, keys, weighted, floor=-1.0)


def flat_occupancy(points: DataFrame, keys: list[str], grid: tuple[int, int], res: float) -> DataFrame:
    """AGG13: distinct occupied (ix, iy) around the plain mean; points without x or y are left out."""
    points = points.dropna(subset=["x", "y"])
    middle = points.groupBy(*keys).agg(F.avg("x").alias("_mx"), F.avg("y").alias("_my"))
    moved = (points.join(middle, keys) if keys else points.join(F.broadcast(middle), F.lit(True))).withColumns({"x": F.col("x") - F.col("_mx"), "y": F.col("y") - F.col("_my")})
    return voxel_index(moved, grid, res).select(*keys, "ix", "iy").distinct()


def canopy_height(points: DataFrame, ground: DataFrame, keys: list[str], grid: tuple[int, int, int], res, support: int = 1, parity: bool = False) -> DataFrame:
    """AGG14: AGG10 of heights above the nearest ground point."""
    return max_height(voxelised(height_above_ground(points, ground), keys, grid, res), keys, grid, support, parity=parity)


def downsampled(points: DataFrame, size: float = 0.05) -> DataFrame:
    """AGG15: the centroid of each voxel's points, with the least pid; points with a null coordinate are left out."""
    points = points.dropna(subset=["x", "y", "z"])
    cells = [F.floor(F.col(c) / size) for c in "xyz"]
    return points.groupBy(*[c.alias(f"v{n}") for n, c in zip("xyz", cells, strict=True)]).agg(F.min("pid").alias("pid"), *[F.avg(c).alias(c) for c in "xyz"]).drop("vx", "vy", "vz")


def _dense_range(cells: DataFrame, keys: list[str], n_cells: int) -> tuple[Column, Column]:
    """Least and greatest value of the whole image, absent cells being 0."""
    w = Window.partitionBy(*keys)
    empty = F.count("*").over(w) < n_cells
    return (F.when(empty, F.least(F.min("v").over(w), F.lit(0.0))).otherwise(F.min("v").over(w)), F.when(empty, F.greatest(F.max("v").over(w), F.lit(0.0))).otherwise(F.max("v").over(w)))


def rescaled(cells: DataFrame, keys: list[str], grid: tuple[int, int], constant: float = 0.0) -> DataFrame:
    """AGG28: the image's range to 0-1. An image of one value becomes ``constant``. Absent cells take :func:`background`'s value."""
    lo, hi = _dense_range(cells, keys, grid[0] * grid[1])
    return cells.withColumns({"_lo": lo, "_hi": hi}).withColumn("v", F.when(F.col("_hi") > F.col("_lo"), (F.col("v") - F.col("_lo")) / (F.col("_hi") - F.col("_lo"))).otherwise(float(constant))).drop("_lo", "_hi")


def equalised(cells: DataFrame, keys: list[str], grid: tuple[int, int], bins: int = 256) -> DataFrame:
    """AGG29: histogram equalisation of the whole image: each value's share of pixels at or below, interpolated between bin centres."""
    n = grid[0] * grid[1]
    lo, hi = _dense_range(cells, keys, n)
    w = Window.partitionBy(*keys)
    ranged = cells.withColumns({"_lo": lo, "_hi": hi, "_absent": F.lit(n) - F.count("*").over(w)})
    width = (F.col("_hi") - F.col("_lo")) / bins
    bin_of = lambda v: F.least(F.floor((v - F.col("_lo")) / width), F.lit(bins - 1)).cast("int")
    ranged = ranged.where(F.col("_hi") > F.col("_lo")).withColumns({"_bin": bin_of(F.col("v")), "_zero": bin_of(F.lit(0.0))})
    counts = ranged.groupBy(*keys, "_bin").agg(F.count("*").alias("n"))
    zero = ranged.groupBy(*keys).agg(F.first("_zero").alias("_bin"), F.first("_absent").alias("n"))
    counts = counts.union(zero.select(*keys, "_bin", "n")).groupBy(*keys, "_bin").agg(F.sum("n").alias("n"))
    every = counts.select(*keys).distinct().withColumn("_bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    run = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0)
    cdf = every.join(counts, [*keys, "_bin"], "left").withColumn("cdf", F.sum(F.coalesce("n", F.lit(0))).over(run) / n).select(*keys, "_bin", "cdf")
    position = (F.col("v") - F.col("_lo")) / width - 0.5
    ranged = ranged.withColumns({"_a": F.greatest(F.floor(position), F.lit(0)).cast("int"), "_f": position - F.floor(position)}).withColumn("_b", F.least(F.floor(position) + 1, F.lit(bins - 1)).cast("int"))
    a, b = cdf.withColumnsRenamed({"_bin": "_a", "cdf": "_ca"}), cdf.withColumnsRenamed({"_bin": "_b", "cdf": "_cb"})
    joined = ranged.join(a, [*keys, "_a"]).join(b, [*keys, "_b"])
    return joined.withColumn("v", F.col("_ca") + F.col("_f") * (F.col("_cb") - F.col("_ca"))).select(*cells.columns)


def coloured(cells: DataFrame, keys: list[str], grid: tuple[int, int], constant: float = 0.0) -> DataFrame:
    """AGG30: the rescaled layer through the jet colour map: red, green, blue. Not a number takes the map's last colour."""
    r, g, b = jet(F.col("v"))
    return rescaled(cells, keys, grid, constant).withColumns({"red": r, "green": g, "blue": b})


def as_bytes(v: Column) -> Column:
    """0-1 to 0-255, cut off rather than rounded."""
    return F.floor(v * 255).cast("smallint")


def voxel_corners(voxels: DataFrame, grid: tuple[int, int, int], res: float, offset: tuple[float, float, float] = (0, 0, 0), centred: bool = True) -> DataFrame:
    """SNK6-8: x, y, z of each voxel's lower corner; ``centred`` takes the grid's middle as the offset's place."""
    return voxels.withColumns({c: (F.col(f"i{c}") - (n / 2.0 if centred else 0)) * res + float(o) for c, n, o in zip("xyz", grid, offset, strict=True)})


def background(cells: DataFrame, keys: list[str], grid: tuple[int, int]) -> DataFrame:
    """The value that absent cells take in :func:`rescaled`, one row a key."""
    few = F.count("*") < grid[0] * grid[1]
    lo = F.when(few, F.least(F.min("v"), F.lit(0.0))).otherwise(F.min("v"))
    hi = F.when(few, F.greatest(F.max("v"), F.lit(0.0))).otherwise(F.max("v"))
    return cells.groupBy(*keys).agg(F.when(hi > lo, -lo / (hi - lo)).otherwise(0.0).alias("v"))
