"""Projections (PRJ1-21): scaling, voxel and raster coordinates, boxes, labels and augmentation."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.functions.scalar import clamp

#: Word in a file's path -> class number (0 foliage, 1 lower stem, 2 upper stem, 3 clutter), looked for in this order.
PATH_CLASSES = (("foliage", 0), ("hgStem", 1), ("lgStem", 2), ("clutter", 3))


def scaled(points: DataFrame, divisors: dict[str, float]) -> DataFrame:
    """PRJ1: named columns divided by a constant, e.g. intensity by 50000 or 77."""
    return points.withColumns({c: F.col(c) / F.lit(float(d)) for c, d in divisors.items()})


def scaled_colours(points: DataFrame, columns: tuple[str, ...] = ("red", "green", "blue")) -> DataFrame:
    """PRJ1: 16-bit colours to 0-255."""
    return points.withColumns({c: F.col(c) * 256.0 / 65535.0 for c in columns})


def _res(res) -> tuple[float, ...]:
    return tuple(res) if isinstance(res, (tuple, list)) else (res,) * 3


def axis_index(value: Column, size: int, res: float) -> Column:
    """One axis of PRJ2: the cell of a centred coordinate, clamped to the border cells."""
    return clamp(F.floor((value + size / 2.0 * res) / res), 0, size - 1).cast("int")


def voxel_index(points: DataFrame, grid: tuple[int, ...], res) -> DataFrame:
    """PRJ2: ix, iy(, iz) of points centred on the origin; what lies outside is clamped, not dropped (Q23), and points with a null coordinate have no voxel."""
    res = _res(res)
    return points.dropna(subset=[c for c, _ in zip("xyz", grid, strict=False)]).withColumns({f"i{c}": axis_index(F.col(c), n, r) for c, n, r in zip("xyz", grid, res, strict=False)})


def clamped_count(points: DataFrame, grid: tuple[int, int, int], res) -> DataFrame:
    """Q23: how many points lie outside the grid, and so in border voxels that are not theirs."""
    outside = F.lit(False)
    for c, n, r in zip("xyz", grid, _res(res), strict=True):
        outside = outside | (F.col(c) < -n / 2.0 * r) | (F.col(c) >= n / 2.0 * r)
    return points.agg(F.count_if(outside).alias("clamped"))


def centres(points: DataFrame, keys: list[str], grid: tuple[int, int, int], res) -> DataFrame:
    """PRJ3: automatic centre of each cloud: mean x, mean y, and the z that puts the highest point at the grid's top; points with a null coordinate do not count."""
    return points.dropna(subset=["x", "y", "z"]).groupBy(*keys).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"), (F.max("z") - grid[2] / 2.0 * _res(res)[2]).alias("cz"))


def recentred(points: DataFrame, keys: list[str], grid: tuple[int, int, int], res, centre: tuple[float, float, float] | None = None) -> DataFrame:
    """PRJ3: coordinates relative to the automatic or a given centre (which has no z offset)."""
    if centre:
        return points.withColumns({c: F.col(c) - F.lit(float(v)) for c, v in zip("xyz", centre, strict=True)})
    middle = centres(points, keys, grid, res)
    joined = points.join(middle, keys) if keys else points.join(F.broadcast(middle), F.lit(True))  # one row
    return joined.withColumns({c: F.col(c) - F.col(f"c{c}") for c in "xyz"}).drop("cx", "cy", "cz")


def unit_sphere(points: DataFrame, keys: list[str]) -> DataFrame:
    """PRJ4: centroid to the origin, farthest point to radius 1; a cloud of one place stays at the origin."""
    middle = points.groupBy(*keys).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"), F.avg("z").alias("mz"))
    moved = points.join(middle, keys).withColumns({c: F.col(c) - F.col(f"m{c}") for c in "xyz"}).drop("mx", "my", "mz")
    radius = moved.groupBy(*keys).agg(F.max(F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))).alias("radius"))
    scale = F.when(F.col("radius") > 0, F.col("radius")).otherwise(1.0)
    return moved.join(radius, keys).withColumns({c: F.col(c) / scale for c in "xyz"}).drop("radius")


def raster_coords(points: DataFrame, grid: tuple[int, ...], res, centre: tuple[float, float]) -> DataFrame:
    """PRJ5: row from x, col from y, and layer from z if there are three grid dimensions."""
    res, names = _res(res), ("row", "col", "layer")
    middle = (*centre, 0.0)
    return points.withColumns({names[k]: axis_index(F.col(c) - float(middle[k]), grid[k], res[k]) for k, c in enumerate("xyz"[: len(grid)])})


def box_to_world(boxes: DataFrame, grid: tuple[int, int], res: float, centre_x: str | float, centre_y: str | float) -> DataFrame:
    """PRJ6: boxes as fractions of a raster to metres; image rows run along x, so the axes change places."""
    cx = F.col(centre_x) if isinstance(centre_x, str) else F.lit(float(centre_x))
    cy = F.col(centre_y) if isinstance(centre_y, str) else F.lit(float(centre_y))
    world = lambda f, n, c: (F.col(f) * n - n / 2.0) * res + c
    return boxes.withColumns({"xmin": world("ymin", grid[1], cx), "xmax": world("ymax", grid[1], cx), "ymin": world("xmin", grid[0], cy), "ymax": world("xmax", grid[0], cy)})


def window_to_mosaic(boxes: DataFrame, x: float, y: float, shape: tuple[int, int], window: tuple[int, int]) -> DataFrame:
    """PRJ7: boxes as fractions of a window at pixel (x, y) to fractions of the whole image (rows, columns)."""
    return boxes.withColumns(
        {f"y{e}": (F.col(f"y{e}") * window[0] + y) / shape[0] for e in ("min", "max")} | {f"x{e}": (F.col(f"x{e}") * window[1] + x) / shape[1] for e in ("min", "max")}
    )


def voc_to_yolo(boxes: DataFrame, width: str = "width", height: str = "height") -> DataFrame:
    """PRJ8: pixel corners to centre and size as fractions of the image."""
    w, h = F.col(width), F.col(height)
    return boxes.withColumns(
        {"cx": (F.col("xmin") + F.col("xmax")) / 2.0 / w, "cy": (F.col("ymin") + F.col("ymax")) / 2.0 / h, "w": (F.col("xmax") - F.col("xmin")) / w, "h": (F.col("ymax") - F.col("ymin")) / h}
    )


def yolo_to_corners(boxes: DataFrame) -> DataFrame:
    """PRJ9: centre and size to corners."""
    return boxes.withColumns({"ymin": F.col("cy") - F.col("h") / 2.0, "xmin": F.col("cx") - F.col("w") / 2.0, "ymax": F.col("cy") + F.col("h") / 2.0, "xmax": F.col("cx") + F.col("w") / 2.0})


def union_box(a: str, b: str) -> list[Column]:
    """PRJ10: the smallest box around the boxes under two aliases."""
    return [F.least(f"{a}.ymin", f"{b}.ymin").alias("ymin"), F.least(f"{a}.xmin", f"{b}.xmin").alias("xmin"), F.greatest(f"{a}.ymax", f"{b}.ymax").alias("ymax"), F.greatest(f"{a}.xmax", f"{b}.xmax").alias("xmax")]


def label_cubes(voxels: DataFrame, keys: list[str]) -> DataFrame:
    """PRJ11: cube of each voxel from its points' class_id: 2 stem (classes 1, 2) before 1 foliage and clutter; absent voxels are background."""
    return voxels.groupBy(*keys).agg(F.max(F.when(F.col("class_id").isin(1, 2), 2).otherwise(1)).alias("cube"))


def voxel_returns(voxels: DataFrame, keys: list[str], value: str = "ret") -> DataFrame:
    """PRJ12: each voxel's return, that of its last point (largest pid)."""
    return voxels.groupBy(*keys).agg(F.max_by(value, "pid").alias(value))


def rotation(angle_x: float, angle_y: float, angle_z: float, parity: bool = False) -> np.ndarray:
    """PRJ13: Rz Ry Rx for angles in degrees. ``parity`` builds Ry as another rotation about x (Q3)."""
    a, b, c = (math.radians(v) for v in (angle_x, angle_y, angle_z))
    about_x = lambda t: np.array([[1, 0, 0], [0, math.cos(t), -math.sin(t)], [0, math.sin(t), math.cos(t)]])
    ry = about_x(b) if parity else np.array([[math.cos(b), 0, math.sin(b)], [0, 1, 0], [-math.sin(b), 0, math.cos(b)]])
    rz = np.array([[math.cos(c), -math.sin(c), 0], [math.sin(c), math.cos(c), 0], [0, 0, 1]])
    return rz @ ry @ about_x(a)


def rotated(points: DataFrame, angle_x: float, angle_y: float, angle_z: float, parity: bool = False) -> DataFrame:
    """PRJ13 by fixed angles."""
    m = rotation(angle_x, angle_y, angle_z, parity)
    return points.withColumns({c: sum((F.col(d) * float(m[k][n]) for n, d in enumerate("xyz")), F.lit(0.0)) for k, c in enumerate("xyz")})


def draw(seed: int, what: str, *keys: str) -> Column:
    """A number in [0, 1) that depends on the seed, its purpose and the keys only, not on partitioning."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(what), *keys), F.lit(1 << 52)) / float(1 << 52)


def randomly_rotated(points: DataFrame, keys: list[str], limit_x: float, limit_y: float, seed: int = 0) -> DataFrame:
    """PRJ13 with drawn angles for each key: x and y within half their limits, z all around."""
    ax = F.radians((draw(seed, "x", *keys) - 0.5) * limit_x)
    ay = F.radians((draw(seed, "y", *keys) - 0.5) * limit_y)
    az = F.radians(draw(seed, "z", *keys) * 360.0)
    turned = points.withColumns({"_y": F.col("y") * F.cos(ax) - F.col("z") * F.sin(ax), "_z": F.col("y") * F.sin(ax) + F.col("z") * F.cos(ax)})
    turned = turned.withColumns({"_x": F.col("x") * F.cos(ay) + F.col("_z") * F.sin(ay), "_z": F.col("_z") * F.cos(ay) - F.col("x") * F.sin(ay)})
    return turned.withColumns({"x": F.col("_x") * F.cos(az) - F.col("_y") * F.sin(az), "y": F.col("_x") * F.sin(az) + F.col("_y") * F.cos(az), "z": F.col("_z")}).drop("_x", "_y", "_z")


def flipped(points: DataFrame, keys: list[str], seed: int = 0) -> DataFrame:
    """PRJ14: x and y keep or change their signs, one of four ways for each key."""
    way = F.floor(draw(seed, "flip", *keys) * 4)
    return points.withColumns({"x": F.when(way.isin(1, 3), -F.col("x")).otherwise(F.col("x")), "y": F.when(way.isin(2, 3), -F.col("y")).otherwise(F.col("y"))})


def shuffled(points: DataFrame, keys: list[str], seed: int = 0) -> DataFrame:
    """PRJ15: a position for each point in a random order of its cloud; rows keep their columns."""
    return points.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(draw(seed, "shuffle", *keys, "pid"), "pid")))


def translated(points: DataFrame, dx: float = 0.0, dy: float = 0.0, dz: float = 0.0) -> DataFrame:
    """PRJ16: coordinates moved by a vector; the default leaves them, as no translation was ever defined for augmentation."""
    return points.withColumns({"x": F.col("x") + float(dx), "y": F.col("y") + float(dy), "z": F.col("z") + float(dz)})


def one_hot(value: Column, classes: int) -> Column:
    """PRJ17: an array with 1.0 at the label's place; an unknown label has no 1."""
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda k: F.when(k == value, 1.0).otherwise(0.0))


def padded_size(rows: int, cols: int, step: int, window: tuple[int, int]) -> tuple[int, int, int, int]:
    """PRJ18: (rows, cols, first row, first column) of the image filled up so that windows at every ``step`` tile it, and where it begins there."""
    extra = [step - (n - w) % step for n, w in ((rows, window[0]), (cols, window[1]))]
    return rows + extra[0], cols + extra[1], extra[0] // 2, extra[1] // 2


def padded(pixels: DataFrame, rows: int, cols: int, step: int, window: tuple[int, int]) -> DataFrame:
    """PRJ18 on sparse pixels: only their places change, the filling has no rows."""
    _, _, r, c = padded_size(rows, cols, step, window)
    return pixels.withColumns({"row": F.col("row") + r, "col": F.col("col") + c})


def colour_components(points: DataFrame, columns: tuple[str, ...] = ("red", "green", "blue"), k: int = 2) -> tuple[list[float], list[list[float]]]:
    """PRJ19: mean and first ``k`` principal axes of the columns, from one aggregate of sums and products."""
    n = len(columns)
    sums = [F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)]
    products = [F.covar_pop(columns[i], columns[j]).alias(f"c{i}_{j}") for i in range(n) for j in range(i, n)]
    row = points.agg(*sums, *products).first()
    cov = np.array([[row[f"c{min(i, j)}_{max(i, j)}"] or 0.0 for j in range(n)] for i in range(n)])
    values, vectors = np.linalg.eigh(cov)
    axes = vectors[:, np.argsort(-values)[:k]].T
    axes *= np.sign(axes[np.arange(k), np.abs(axes).argmax(1)])[:, None]  # largest loading positive
    return [float(row[f"m{i}"] or 0.0) for i in range(n)], axes.tolist()


def onto_components(points: DataFrame, mean: list[float], axes: list[list[float]], columns: tuple[str, ...] = ("red", "green", "blue")) -> DataFrame:
    """PRJ19: the components pc1.. of each row."""
    return points.withColumns({f"pc{k + 1}": sum(((F.col(c) - m) * w for c, m, w in zip(columns, mean, axis, strict=True)), F.lit(0.0)) for k, axis in enumerate(axes)})


def class_of_path(path: Column) -> Column:
    """PRJ20: class number from a word in the file's path; null without one."""
    out = F.lit(None).cast("int")
    for word, number in reversed(PATH_CLASSES):
        out = F.when(path.contains(word), number).otherwise(out)
    return out


def annotated(pixels: DataFrame, trees: DataFrame, half: int = 4) -> DataFrame:
    """PRJ21: pixels (row, col, v) painted over by squares around trees (tree_id, row, col, species); the last tree wins, species 0 is blue, others white."""
    marks = trees.select(
        "tree_id", "species", F.explode(F.sequence(F.col("row") - half, F.col("row") + half)).alias("row"), "col"
    ).select("tree_id", "species", "row", F.explode(F.sequence(F.col("col") - half, F.col("col") + half)).alias("col"))
    last = marks.groupBy("row", "col").agg(F.max_by("species", "tree_id").alias("species"))
    return pixels.join(last, ["row", "col"], "left").withColumn("colour", F.when(F.col("species") == 0, "blue").when(F.col("species").isNotNull(), "white")).drop("species")
