"""Tree detection on rasters (UDF1-4): a pluggable scorer over window images, and the driver around it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.model import RasterConfig
from timberline.operators.boxes import numbered, unique_boxes
from timberline.operators.graph import checkpointed
from timberline.operators.ground import height_above_ground
from timberline.operators.predicates import confident, of_class
from timberline.operators.projections import box_to_world, centres
from timberline.operators.spatial import label_points, sliding_windows
from timberline.operators.voxels import background, coloured, equalised, max_height, max_returns, mean_returns, rescaled, vertical_density, voxelised

#: image rows x columns x 3 in 0..255 -> [(ymin, xmin, ymax, xmax, class, score)] as fractions
Detector = Callable[[np.ndarray], list[tuple[float, float, float, float, int, float]]]


def peak_detector(half: int = 8, least: int = 128) -> Detector:
    """Deterministic stand-in for a trained network: a box around every local peak of the first channel, scored by its height."""

    def detect(image: np.ndarray) -> list[tuple[float, float, float, float, int, float]]:
        v = image[:, :, 0].astype(float)
        rows, cols = v.shape
        order = np.argsort(-v, axis=None, kind="stable")
        taken, out = np.zeros(v.shape, bool), []
        for k in order[: np.count_nonzero(v >= least)]:
            r, c = divmod(int(k), cols)
            if not taken[r, c]:
                taken[max(0, r - half) : r + half + 1, max(0, c - half) : c + half + 1] = True
                out.append(((r - half) / rows, (c - half) / cols, (r + half) / rows, (c + half) / cols, 0, v[r, c] / 255.0))
        return out

    return detect


def onnx_detector(path: str, size: int = 416) -> Callable[[], Detector]:
    """UDF1: a factory that loads an ONNX detector once in each worker; its output rows are (cx, cy, w, h, objectness, class scores)."""

    def load() -> Detector:
        import onnxruntime

        session = onnxruntime.InferenceSession(path)
        name = session.get_inputs()[0].name

        def detect(image: np.ndarray) -> list[tuple[float, float, float, float, int, float]]:
            r, c = (np.arange(size) * n // size for n in image.shape[:2])
            blob = np.ascontiguousarray(image[r][:, c].transpose(2, 0, 1)[None] / 255.0, np.float32)
            found = np.concatenate([o.reshape(-1, o.shape[-1]) for o in session.run(None, {name: blob})])
            best = found[:, 5:].argmax(1)
            return [(y - h / 2, x - w / 2, y + h / 2, x + w / 2, int(k), float(s)) for (x, y, w, h), k, s in zip(found[:, :4].tolist(), best, found[np.arange(len(found)), 5 + best], strict=True)]

        return detect

    return load


def raster_layer(points: DataFrame, name: str, keys: list[str], config: RasterConfig, support: int, colours: tuple[str, ...]) -> DataFrame:
    """UDF3: one sparse layer (keys, ix, iy, v) of voxelised points."""
    grid = config.gridSize
    if name == "vertical_density":
        return vertical_density(points, keys, grid, support)
    if name in ("max_height", "canopy_height"):
        return max_height(points, keys, grid, support)
    channel = colours[int(name[-1]) - 1]
    return (mean_returns if name.startswith("mean") else max_returns)(points, keys, grid, channel, support)


def rasters(points: DataFrame, config: RasterConfig, keys: list[str], ground: DataFrame | None = None, colours: tuple[str, ...] = ("intensity",)) -> DataFrame:
    """UDF3: (keys, layer, row, col, v) of the configured layers, normalised to 0-1.

    The centre is that of the cloud, whatever the first layer is (Q17); all
    layers of one kind share their voxels. ``background`` rows have row and col
    -1 and hold the value of absent cells.
    """
    plain = voxelised(points, keys, config.gridSize, config.res)
    canopy = None
    if ground is not None and "canopy_height" in config.raster_layers:  # no other layer reads heights
        canopy = voxelised(height_above_ground(points, ground), keys, config.gridSize, config.res)
    if sum(n not in ("blank", "canopy_height") for n in config.raster_layers) > 1:
        plain = checkpointed(plain)  # voxels that several layers read
    out = None
    for k, name in enumerate(config.raster_layers):
        if name == "blank":
            continue
        if name == "canopy_height" and canopy is None:
            raise ValueError("canopy_height needs ground points")
        cells = raster_layer(canopy if name == "canopy_height" else plain, name, keys, config, config.support_window[k], colours)
        shape = config.gridSize[:2]
        if config.normalisation == "cmap_jet":
            shown = coloured(cells, keys, shape)
            for n, c in enumerate(("red", "green", "blue")):
                layer = shown.select(*keys, F.lit(n).alias("layer"), F.col("ix").alias("row"), F.col("iy").alias("col"), F.col(c).alias("v"))
                out = layer if out is None else out.unionByName(layer)
            return out
        if config.normalisation == "rescale+histeq" and config.doHisteq[k]:
            cells = equalised(cells, keys, shape)
        zero = background(cells, keys, shape).select(*keys, F.lit(k).alias("layer"), F.lit(-1).alias("row"), F.lit(-1).alias("col"), "v")
        layer = rescaled(cells, keys, shape).select(*keys, F.lit(k).alias("layer"), F.col("ix").alias("row"), F.col("iy").alias("col"), "v").unionByName(zero)
        out = layer if out is None else out.unionByName(layer)
    if out is None:
        raise ValueError("all layers are blank")
    return out


def image_of(pdf: pd.DataFrame, config: RasterConfig) -> np.ndarray:
    """Dense uint8 image of one window's sparse layers; blank layers are 0.5."""
    image = np.full((*config.gridSize[:2], 3), 0.5)
    for k, rows in pdf.groupby("layer"):
        zero = rows[rows["row"] < 0]["v"]
        image[:, :, int(k)] = float(zero.iloc[0]) if len(zero) else 0.0
        cells = rows[rows["row"] >= 0]
        image[cells["row"].to_numpy(int), cells["col"].to_numpy(int), int(k)] = cells["v"]
    return (image * 255).astype(np.uint8)


def detect_windows(layers: DataFrame, config: RasterConfig, detector: Detector | None = None, load: Callable[[], Detector] | None = None, keys: tuple[str, str] = ("wx", "wy")) -> DataFrame:
    """UDF1: (keys, ymin, xmin, ymax, xmax, class_id, score) boxes as fractions of each window's image.

    ``load`` is called once in a Python worker, not once a window.
    """
    cache: dict[str, Detector] = {}

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        if "d" not in cache:
            cache["d"] = detector or (load or peak_detector)()
        out = pd.DataFrame(cache["d"](image_of(pdf, config)), columns=["ymin", "xmin", "ymax", "xmax", "class_id", "score"])
        for k, v in reversed(list(zip(keys, key, strict=True))):
            out.insert(0, k, v)
        return out

    kinds = dict(layers.dtypes)
    head = ", ".join(f"{k} {kinds[k]}" for k in keys)
    return layers.groupBy(*keys).applyInPandas(run, f"{head}, ymin double, xmin double, ymax double, xmax double, class_id int, score double")


def detect_trees(
    points: DataFrame, config: RasterConfig, window: float = 100.0, step: int = 80, overlap: float = 5.0, class_id: int = 0, confidence: float = 0.5, ground: DataFrame | None = None, detector: Detector | None = None, colours: tuple[str, ...] = ("intensity",)
) -> tuple[DataFrame, DataFrame]:
    """UDF2: (labels, boxes): windows, rasters, detection, geo-reference, class filter, one box a tree, points labelled by box.

    The detector's input is a window's dense image inside one Python call; all
    else stays relational. No boxes give all-zero labels (Q19).
    """
    keys = ["wx", "wy"]
    inside = sliding_windows(points, step, window)
    layers = rasters(inside, config, keys, ground, colours)
    found = of_class(confident(detect_windows(layers, config, detector), confidence), class_id)
    middle = centres(inside, keys, config.gridSize, config.res).select(*keys, "cx", "cy")
    world = box_to_world(found.join(middle, keys), config.gridSize[:2], config.res, "cx", "cy")
    boxes = numbered(world.select("ymin", "xmin", "ymax", "xmax", "score"), "ymin", "xmin", "ymax", "xmax", "score")
    kept = boxes.join(unique_boxes(boxes, overlap), F.col("bid") == F.col("keep"), "left_semi")
    kept = numbered(kept.drop("bid"), "ymin", "xmin", "ymax", "xmax", "score")
    return label_points(points, kept), kept


def latent_codes(voxels: DataFrame, grid: tuple[int, int, int], encode: Callable[[np.ndarray], np.ndarray], key: str = "tree_id") -> DataFrame:
    """UDF9: (key, code) of each tree by a pluggable encoder of its dense grid."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pdfs:
            codes = []
            for cells in pdf["cells"]:
                dense = np.zeros(grid)
                at = np.array([(c["ix"], c["iy"], c["iz"]) for c in cells])
                dense[tuple(at.T)] = 1.0
                codes.append(np.asarray(encode(dense), float).ravel().tolist())
            yield pd.DataFrame({key: pdf[key], "code": codes})

    grouped = voxels.groupBy(key).agg(F.collect_set(F.struct("ix", "iy", "iz")).alias("cells"))
    return grouped.mapInPandas(run, f"{key} {dict(voxels.dtypes)[key]}, code array<double>")


def projection_encoder(grid: tuple[int, int, int], size: int = 8, seed: int = 0) -> Callable[[np.ndarray], np.ndarray]:
    """Stand-in encoder: height profile and plan projected on fixed random directions."""
    rng = np.random.default_rng(seed)
    axes = rng.normal(size=(size, grid[2])), rng.normal(size=(size, grid[0] * grid[1]))
    return lambda g: axes[0] @ g.mean((0, 1)) + axes[1] @ g.mean(2).ravel()
