"""PLY files (SRC4, SRC9, SNK3, SNK4, SNK9, SNK13-17): reader for ascii and binary, writers for points and meshes."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timberline.operators.graph import checkpointed
from timberline.sources.files import _hadoop, write_text_file

_KINDS = {"char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2", "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8"}


def parse(data: bytes) -> tuple[dict[str, np.ndarray], list[float], list[list[int]]]:
    """Columns of the first element, the numbers of the comment lines, and the faces."""
    end = data.index(b"end_header")
    end = data.index(b"\n", end) + 1
    lines = data[:end].decode("latin-1").split("\n")
    if lines[0].strip() != "ply":
        raise ValueError("not a PLY file")
    layout, comments, elements = "ascii", [], []
    for line in lines:
        word = line.split()
        if not word:
            continue
        if word[0] == "format":
            layout = word[1]
        elif word[0] == "comment" and len(word) == 2:
            try:
                comments.append(float(word[1]))
            except ValueError:
                pass
        elif word[0] == "element":
            elements.append((word[1], int(word[2]), []))
        elif word[0] == "property":
            elements[-1][2].append(word[1:])
    columns, faces, rest = {}, [], data[end:]
    text = rest.decode("ascii").split("\n") if layout == "ascii" else []
    order, at = (">" if layout == "binary_big_endian" else "<"), 0
    for k, (name, count, properties) in enumerate(elements):
        listed = properties and properties[0][0] == "list"
        if layout == "ascii":
            rows = [r.split() for r in text[at : at + count]]
            at += count
            if listed:
                faces += [[int(v) for v in r[1 : 1 + int(r[0])]] for r in rows]
            elif k == 0:
                table = np.array(rows, float).reshape(count, len(properties))
                columns = {p[1]: table[:, n].astype(_KINDS[p[0]]) for n, p in enumerate(properties)}
        elif listed:
            size, item = np.dtype(order + _KINDS[properties[0][1]]), np.dtype(order + _KINDS[properties[0][2]])
            for _ in range(count):
                n = int(np.frombuffer(rest, size, 1, at)[0])
                faces.append(np.frombuffer(rest, item, n, at + size.itemsize).tolist())
                at += size.itemsize + n * item.itemsize
        else:
            kind = np.dtype([(p[1], order + _KINDS[p[0]]) for p in properties])
            table = np.frombuffer(rest, kind, count, at)
            at += count * kind.itemsize
            if k == 0:
                columns = {c: table[c].astype(table[c].dtype.newbyteorder("=")) for c in kind.names}
        if k == 0 and name != "vertex" and listed:
            raise ValueError("the first element must be points")
    return columns, comments[:3], faces


def _ascii_rows(spark: SparkSession, path: str) -> tuple[list[tuple[str, int, list[list[str]], int]], list[float], DataFrame] | None:
    """Elements (name, count, properties, first line) of one ascii file, its comments' numbers, and its lines (no, value); None for folders and binary files.

    The lines are read by ranges of the file. A range's first number comes from
    the row counts of the ranges before it.
    """
    jvm, fs, where = _hadoop(spark, path)
    if not fs.exists(where) or not fs.getFileStatus(where).isFile():
        return None
    source = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(fs.open(where), "ISO-8859-1"))
    head: list[str] = []
    try:
        while (line := source.readLine()) is not None:
            head.append(line)
            if line.strip() == "end_header" or head[0].strip() != "ply":
                break
    finally:
        source.close()
    words = [w for line in head if (w := line.split())]
    if not words or words[0] != ["ply"] or ["format", "ascii"] not in [w[:2] for w in words]:
        return None
    elements, comments, at = [], [], len(head)
    for word in words:
        if word[0] == "element":
            elements.append((word[1], int(word[2]), [], at))
            at += int(word[2])
        elif word[0] == "property":
            elements[-1][2].append(word[1:])
        elif word[0] == "comment" and len(word) == 2:
            try:
                comments.append(float(word[1]))
            except ValueError:
                pass
    row = F.monotonically_increasing_id()
    lines = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("_at")).withColumn("_row", row)
    blocks = lines.groupBy(F.col("_at").alias("_block")).agg(F.min("_row").alias("_least"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    blocks = blocks.select("_block", "_least", F.coalesce(before, F.lit(0)).alias("_first"))  # a row a range
    numbered = lines.join(F.broadcast(blocks), F.col("_at") == F.col("_block"))
    return elements, comments[:3], numbered.select((F.col("_first") + F.col("_row") - F.col("_least")).alias("no"), "value")


def read_ply(spark: SparkSession, path: str, scalar: bool = False, colours: bool = False) -> DataFrame:
    """SRC4: (cloud_id, pid, x, y, z[, scalar][, red, green, blue], off_x, off_y, off_z) of a PLY file or folder; no comment lines mean no offset."""
    schema = "cloud_id string, pid long, x double, y double, z double" + (", scalar double" if scalar else "") + (", red int, green int, blue int" if colours else "") + ", off_x double, off_y double, off_z double"
    rows = _ascii_rows(spark, path)
    if rows:
        (_, count, properties, start), *_ = rows[0]
        if properties and properties[0][0] == "list":
            raise ValueError("the first element must be points")
        offset = rows[1] if len(rows[1]) == 3 else [0.0] * 3
        names = [p[1] for p in properties]
        wanted = ["x", "y", "z", *([("scalar" if "scalar" in names else next(n for n in names if n not in ("x", "y", "z")))] if scalar else []), *(["red", "green", "blue"] if colours else [])]
        word = F.split(F.trim("value"), r"\s+")
        inside = (F.col("no") >= start) & (F.col("no") < start + count)
        values = []
        for name in wanted:
            kind, whole = _KINDS[properties[names.index(name)][0]], name in ("red", "green", "blue")
            v = word[names.index(name)].cast("double")
            v = v.cast("float").cast("double") if kind == "f4" else v if kind == "f8" else v.cast("long").cast("double")
            v = F.when(inside, v.cast("int") if whole else v)  # a filter pushed down must not cast other lines
            values.append(v.alias(name if whole or name in ("x", "y", "z") else "scalar"))
        body = rows[2].where(inside)
        return body.select(F.lit(os.path.basename(path)).alias("cloud_id"), (F.col("no") - start).alias("pid"), *values, *[F.lit(o).alias(f"off_{c}") for o, c in zip(offset, "xyz", strict=True)])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                columns, offset, _ = parse(bytes(data))
                offset = offset if len(offset) == 3 else [0.0] * 3
                out = pd.DataFrame({"cloud_id": os.path.basename(name), "pid": np.arange(len(columns["x"])), **{c: columns[c].astype(float) for c in "xyz"}})
                if scalar:
                    extra = [c for c in columns if c not in ("x", "y", "z")]
                    out["scalar"] = columns["scalar" if "scalar" in columns else extra[0]].astype(float)
                for c in ("red", "green", "blue") if colours else ():
                    out[c] = columns[c].astype(int)
                yield out.assign(off_x=offset[0], off_y=offset[1], off_z=offset[2])

    return spark.read.format("binaryFile").option("pathGlobFilter", "*.ply").load(path).select("path", "content").mapInPandas(run, schema)


def read_faces(spark: SparkSession, path: str) -> DataFrame:
    """(cloud_id, fid, v array<int>) faces of mesh files."""
    rows = _ascii_rows(spark, path)
    if rows:
        word, found, before = F.split(F.trim("value"), r"\s+"), F.lit(None).cast("long"), 0
        for _, count, properties, start in rows[0]:
            if properties and properties[0][0] == "list":
                found = F.when((F.col("no") >= start) & (F.col("no") < start + count), F.col("no") - start + before).otherwise(found)
                before += count
        body = rows[2].withColumn("fid", found).where(F.col("fid").isNotNull()).withColumn("_w", word)
        return body.select(F.lit(os.path.basename(path)).alias("cloud_id"), "fid", F.when(F.col("fid").isNotNull(), F.slice("_w", F.lit(2), F.col("_w")[0].cast("int")).cast("array<int>")).alias("v"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for name, data in zip(pdf["path"], pdf["content"], strict=True):
                faces = parse(bytes(data))[2]
                yield pd.DataFrame({"cloud_id": os.path.basename(name), "fid": range(len(faces)), "v": faces})

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "cloud_id string, fid long, v array<int>")


def load_ground_surface(spark: SparkSession, path: str, offset: tuple[float, float, float] = (0.0, 0.0, 0.0)) -> DataFrame:
    """SRC9: mesh vertices in the caller's frame: moved by the file's offset minus the caller's."""
    points = read_ply(spark, path)
    return points.select("pid", *[(F.col(c) + F.col(f"off_{c}") - float(o)).alias(f"g{c}") for c, o in zip("xyz", offset, strict=True)])


_XYZ = [("x", "float"), ("y", "float"), ("z", "float")]
_RGB = [("red", "uchar"), ("green", "uchar"), ("blue", "uchar")]


def write_points(points: DataFrame, path: str, scalar: str | None = None, colours: bool = False, offset: tuple[float, float, float] | None = None) -> None:
    """SNK3, SNK4, SNK15, SNK17: points in order of pid, with a ``scalar`` column or red, green and blue if told.

    Lines are made and written by the executors; null coordinates are written as nan.
    """
    properties = _XYZ + ([("scalar", "float")] if scalar else []) + (_RGB if colours else [])
    columns = ["x", "y", "z", *([scalar] if scalar else []), *(["red", "green", "blue"] if colours else [])]
    write_elements(path, points.orderBy("pid"), columns, properties, offset=offset)


def write_elements(path: str, vertices: DataFrame, columns: list[str], properties: list[tuple[str, str]], faces: DataFrame | None = None, edges: DataFrame | None = None, offset: tuple[float, float, float] | None = None) -> None:
    """An ascii PLY of ordered frames: vertices (``columns`` as ``properties``), faces (v array) and edges (a, b)."""
    vertices = checkpointed(vertices)
    head = "ply\nformat ascii 1.0\n" + "".join(f"comment {o:.4f}\n" for o in offset or ())
    head += f"element vertex {vertices.count()}\n" + "".join(f"property {k} {n}\n" for n, k in properties)
    whole = F.coalesce
    value = [F.format_string("%.4f", whole(F.col(c).cast("double"), F.lit(float("nan")))) if k == "float" else whole(F.col(c).cast("long"), F.lit(0)).cast("string") for c, (_, k) in zip(columns, properties, strict=True)]
    bodies = [vertices.select(F.concat_ws(" ", *value).alias("value"))]
    if faces is not None:
        faces = checkpointed(faces)
        head += f"element face {faces.count()}\nproperty list uchar int vertex_indices\n"
        bodies.append(faces.select(F.concat_ws(" ", F.size("v").cast("string"), F.transform("v", lambda x: x.cast("string"))).alias("value")))
    if edges is not None:
        edges = checkpointed(edges)
        head += f"element edge {edges.count()}\nproperty int vertex1\nproperty int vertex2\n"
        bodies.append(edges.select(F.concat_ws(" ", F.col("a").cast("string"), F.col("b").cast("string")).alias("value")))
    write_text_file(bodies, path, head + "end_header\n")


def delaunay(xy: np.ndarray) -> list[tuple[int, int, int]]:
    """UDF14: Delaunay triangles of points in the plane (incremental, Bowyer and Watson)."""
    n = len(xy)
    if n < 3:
        return []
    middle, span = (xy.min(0) + xy.max(0)) / 2, max(float(np.ptp(xy, axis=0).max()), 1.0)
    p = np.vstack([xy, middle + np.array([[-50, -30], [50, -30], [0, 60]]) * span])
    triangles: dict[tuple[int, int, int], tuple[float, float, float]] = {}

    def add(a: int, b: int, c: int) -> None:
        (ax, ay), (bx, by), (cx, cy) = p[a], p[b], p[c]
        ux, uy, vx, vy = bx - ax, by - ay, cx - ax, cy - ay
        d = 2 * (ux * vy - uy * vx)
        if abs(d) > 1e-12 * span * span:
            x, y = (vy * (ux * ux + uy * uy) - uy * (vx * vx + vy * vy)) / d, (ux * (vx * vx + vy * vy) - vx * (ux * ux + uy * uy)) / d
            triangles[a, b, c] = (ax + x, ay + y, x * x + y * y)

    add(n, n + 1, n + 2)
    for k in np.lexsort((xy[:, 1], xy[:, 0])).tolist():
        x, y = p[k]
        bad = [t for t, (cx, cy, r2) in triangles.items() if (x - cx) ** 2 + (y - cy) ** 2 < r2 * (1 + 1e-12)]
        edges: dict[tuple[int, int], int] = {}
        for a, b, c in bad:
            for e in ((a, b), (b, c), (c, a)):
                key = (min(e), max(e))
                edges[key] = edges.get(key, 0) + 1
            del triangles[a, b, c]
        for (a, b), times in edges.items():
            if times == 1:
                add(a, b, k)
    return [t for t in triangles if max(t) < n]


def save_ground_surface(ground: DataFrame, path: str, offset: tuple[float, float, float] = (0.0, 0.0, 0.0), columns: tuple[str, str, str] = ("gx", "gy", "gz")) -> int:
    """SNK9: the ground mesh (one vertex a 4 m^2 cell at most, so it is small beside the cloud); returns the number of faces."""
    xyz = np.array(sorted(tuple(r) for r in ground.select(*columns).toLocalIterator()), float).reshape(-1, 3)
    faces = [(k, list(t)) for k, t in enumerate(delaunay(xyz[:, :2]))]
    spark = ground.sparkSession
    vertices = ground.select(*[F.col(c).alias(n) for c, n in zip(columns, "xyz", strict=True)]).orderBy(*"xyz")
    write_elements(path, vertices, ["x", "y", "z"], _XYZ, spark.createDataFrame(faces, "fid long, v array<int>").orderBy("fid") if faces else None, offset=offset)
    return len(faces)
