"""Meshes of circles and stems (SNK13-15, SNK17) as frames of vertices and faces."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from timberline.functions.scalar import hsv_to_rgb
from timberline.operators.graph import numbered
from timberline.operators.projections import draw
from timberline.sources.ply import write_elements

SIDES = 15


def ring_vertices(rings: DataFrame, order: list[str], sides: int = SIDES, turn: list[list[float]] | None = None) -> DataFrame:
    """(order, k, vid, x, y, z) ``sides`` vertices on each circle, numbered along ``order``; ``turn`` is a 3 x 3 rotation."""
    v = numbered(rings, *order, name="_base").withColumn("_base", F.col("_base") * sides).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(sides - 1))))
    angle = F.col("k") * (2 * math.pi / sides)
    v = v.select(*order, "k", (F.col("_base") + F.col("k")).alias("vid"), (F.col("x") + F.col("r") * F.cos(angle)).alias("x"), (F.col("y") + F.col("r") * F.sin(angle)).alias("y"), "z")
    if turn:
        v = v.withColumns({c: F.col("x") * turn[n][0] + F.col("y") * turn[n][1] + F.col("z") * turn[n][2] for n, c in enumerate("xyz")})
    return v


def ring_edges(vertices: DataFrame, sides: int = SIDES) -> DataFrame:
    """SNK13: (a, b) edges around each circle."""
    return vertices.select(F.col("vid").alias("a"), F.when(F.col("k") == sides - 1, F.col("vid") - (sides - 1)).otherwise(F.col("vid") + 1).alias("b"))


def stem_faces(vertices: DataFrame, stem: str, ring: str, sides: int = SIDES) -> DataFrame:
    """SNK14: (a, b, c, d) quads between consecutive rings of a stem."""
    up = F.lead("vid").over(Window.partitionBy(stem, "k").orderBy(ring))
    step = F.when(F.col("k") == sides - 1, -(sides - 1)).otherwise(1)
    return vertices.withColumns({"up": up, "step": step}).where(F.col("up").isNotNull()).select(F.col("vid").alias("a"), (F.col("vid") + F.col("step")).alias("b"), (F.col("up") + F.col("step")).alias("c"), F.col("up").alias("d"))


def coloured_by(points: DataFrame, *keys: str, seed: int = 0) -> DataFrame:
    """SNK15, SNK17: red, green, blue (0-255) of a hue that depends on the keys."""
    rgb = hsv_to_rgb(draw(seed, "hue", *keys), F.lit(1.0), F.lit(1.0))
    return points.withColumns({c: F.floor(v * 255).cast("int") for c, v in zip(("red", "green", "blue"), rgb, strict=True)})


def painted(points: DataFrame, red: int = 255, green: int = 0, blue: int = 0) -> DataFrame:
    """One colour for all points."""
    return points.withColumns({"red": F.lit(red), "green": F.lit(green), "blue": F.lit(blue)})


def write_mesh(vertices: DataFrame, path: str, faces: DataFrame | None = None, edges: DataFrame | None = None) -> None:
    """SNK13, SNK14: an ascii PLY of an export's vertices with faces or edges."""
    quads = faces.orderBy("a").select(F.array("a", "b", "c", "d").alias("v")) if faces is not None else None
    write_elements(path, vertices.orderBy("vid"), ["x", "y", "z"], [("x", "float"), ("y", "float"), ("z", "float")], quads, edges.orderBy("a") if edges is not None else None)
