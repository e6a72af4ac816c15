"""Stem segmentation (UDF5-7, JN6, SNK6): voxel tensors, a pluggable network, label transfer and certainty.

No trained weights ship with the engine. ``VoxelNet`` runs the network's
layers in numpy from any weights; ``HeightRule`` is a deterministic stand-in
that needs none.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timberline.operators.neighbours import nearest
from timberline.operators.training import passes_summary

#: (occupancy X x Y x Z, pass number) -> probabilities classes x X x Y x Z
Scorer = Callable[[np.ndarray, int], np.ndarray]


def conv3d(x: np.ndarray, w: np.ndarray, stride: int = 1) -> np.ndarray:
    """'SAME' convolution of (channels, X, Y, Z) by (out, channels, k, k, k)."""
    k = w.shape[-1]
    out = [-(-n // stride) for n in x.shape[1:]]
    pads = [max((o - 1) * stride + k - n, 0) for o, n in zip(out, x.shape[1:], strict=True)]
    x = np.pad(x, [(0, 0), *[(p // 2, p - p // 2) for p in pads]])
    v = np.lib.stride_tricks.sliding_window_view(x, (k, k, k), axis=(1, 2, 3))[:, ::stride, ::stride, ::stride]
    return np.einsum("cxyzijk,ocijk->oxyz", v, w, optimize=True)


def deconv3d(x: np.ndarray, w: np.ndarray, shape: tuple[int, int, int], stride: int = 1) -> np.ndarray:
    """The transpose of a 'SAME' convolution from ``shape``; ``w`` is (channels, out, k, k, k)."""
    k = w.shape[-1]
    full = np.zeros((w.shape[1], *[(n - 1) * stride + k for n in x.shape[1:]]))
    spread = np.einsum("cxyz,coijk->oxyzijk", x, w, optimize=True)
    for i in range(k):
        for j in range(k):
            for m in range(k):
                full[:, i : i + stride * x.shape[1] : stride, j : j + stride * x.shape[2] : stride, m : m + stride * x.shape[3] : stride] += spread[..., i, j, m]
    pads = [max((n - 1) * stride + k - s, 0) // 2 for n, s in zip(x.shape[1:], shape, strict=True)]
    return full[(slice(None), *[slice(p, p + s) for p, s in zip(pads, shape, strict=True)])]


@dataclass
class VoxelNet:
    """Five layers: two convolutions (5, stride 2; 3), their transposes, and a 5-wide convolution to the classes; leaky units, no biases."""

    weights: list[np.ndarray]
    keep_prob: float = 1.0
    leak: float = 0.1

    def __call__(self, grid: np.ndarray, draw: int = 0) -> np.ndarray:
        rng = np.random.default_rng(draw)

        def unit(x: np.ndarray) -> np.ndarray:
            x = np.where(x > 0, x, self.leak * x)
            return x * (rng.random(x.shape) < self.keep_prob) / self.keep_prob if self.keep_prob < 1 else x

        w = self.weights
        a = unit(conv3d(grid[None], w[0], 2))
        b = unit(conv3d(a, w[1]))
        c = unit(deconv3d(b, w[2], a.shape[1:]))
        d = unit(deconv3d(c, w[3], grid.shape, 2))
        e = conv3d(d, w[4])
        e = np.exp(e - e.max(0))
        return e / e.sum(0)

    @classmethod
    def random(cls, classes: int = 3, channels: int = 10, seed: int = 0, keep_prob: float = 1.0) -> VoxelNet:
        rng = np.random.default_rng(seed)
        shapes = [(channels, 1, 5, 5, 5), (channels, channels, 3, 3, 3), (channels, channels, 3, 3, 3), (channels, channels, 5, 5, 5), (classes, channels, 5, 5, 5)]
        return cls([rng.normal(size=s) * np.sqrt(2.0 / np.prod(s[1:])) for s in shapes], keep_prob)


@dataclass
class HeightRule:
    """Stand-in: occupied voxels of the lower part are stem (class 2), others foliage (1); later passes blur the border."""

    stem_share: float = 0.5

    def __call__(self, grid: np.ndarray, draw: int = 0) -> np.ndarray:
        nz = grid.shape[2]
        stem = 1.0 / (1.0 + np.exp((np.arange(nz) + 0.5 - (self.stem_share * nz + 0.25 * draw)) / 2.0))
        stem = np.broadcast_to(stem, grid.shape)
        return np.stack([(1 - grid), grid * (1 - stem), grid * stem])


def densify(pdf: pd.DataFrame, grid: tuple[int, int, int]) -> np.ndarray:
    out = np.zeros(grid)
    out[pdf["ix"], pdf["iy"], pdf["iz"]] = 1.0
    return out


def scored_voxels(voxels: DataFrame, grid: tuple[int, int, int], scorer: Scorer, passes: int = 1, key: str = "tree_id") -> DataFrame:
    """(key, pass, ix, iy, iz, class_id, prob) of every occupied voxel; one tree's dense grid exists at a time."""

    def run(k: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        cells = pdf[["ix", "iy", "iz"]].drop_duplicates().sort_values(["ix", "iy", "iz"])
        dense, parts = densify(cells, grid), []
        for n in [int(k[1])]:
            p = scorer(dense, n)[:, cells["ix"], cells["iy"], cells["iz"]]
            for c in range(len(p)):
                parts.append(cells.assign(class_id=c, prob=p[c], **{"pass": n, key: k[0]}))
        return pd.concat(parts)[[key, "pass", "ix", "iy", "iz", "class_id", "prob"]]

    fan = voxels.select(key, "ix", "iy", "iz").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
    kind = dict(voxels.dtypes)[key]
    return fan.groupBy(key, "pass").applyInPandas(run, f"{key} {kind}, pass int, ix int, iy int, iz int, class_id int, prob double")


def segment(points: DataFrame, grid: tuple[int, int, int], res: float, scorer: Scorer, passes: int = 1, dist_threshold: float = 0.5, key: str = "tree_id") -> DataFrame:
    """UDF6, UDF7: (key, pid, x, y, z, class_id, certainty) of points near a predicted voxel.

    ``points`` are at full resolution with their tree's key. Voxels predicted
    as background go (all other classes are kept, Q12, Q13); each point takes
    the class of the nearest remaining voxel's lower corner within its tree.
    """
    from timberline.operators.projections import centres, voxel_index

    middle = centres(points, [key], grid, res)
    placed = points.join(middle, key)
    local = voxel_index(placed.withColumns({c: F.col(c) - F.col(f"c{c}") for c in "xyz"}), grid, res)
    best = passes_summary(scored_voxels(local, grid, scorer, passes, key), [key, "ix", "iy", "iz"]).where(F.col("class_id") > 0)
    corner = best.join(middle, key).select(key, "class_id", "certainty", F.struct("ix", "iy", "iz").alias("vid"), *[((F.col(f"i{c}") - n / 2.0) * res + F.col(f"c{c}")).alias(c) for c, n in zip("xyz", grid, strict=True)])
    limit = dist_threshold if np.isfinite(dist_threshold) else None
    near = nearest(points, corner, 1, ("x", "y", "z"), "pid", "vid", values=("class_id", "certainty"), limit=limit, keys=(key,))
    return points.select(key, "pid", "x", "y", "z").join(near.select("pid", "class_id", "certainty").hint("merge"), "pid")
