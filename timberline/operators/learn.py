"""Training (UDF8-10, UDF12, UDF13): layers, optimisers, gradients of the two networks, checkpoints and the loop over batches.

Gradients of a batch are computed by tasks, a tree's dense grid at a time, and
summed within each; the driver holds the weights, whose number depends on the
network alone, and takes the optimiser's step.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.functions.scalar import conv_output_shape, learning_rate
from timberline.operators.segment import VoxelNet, conv3d, deconv3d

# ---- layers ------------------------------------------------------------------------------------


def initial_weights(kind: str, shape: tuple[int, ...], seed: int = 0, deviation: float = 0.1, constant: float = 0.1) -> np.ndarray:
    """UDF10: ``gaussian``, ``uniform`` (Glorot's bounds), ``he``, ``constant`` or ``zeros``."""
    rng, fan_in = np.random.default_rng(seed), int(np.prod(shape[:-1])) or 1
    if kind == "gaussian":
        return rng.normal(0, deviation, shape)
    if kind == "uniform":
        limit = np.sqrt(6.0 / (fan_in + shape[-1]))
        return rng.uniform(-limit, limit, shape)
    if kind == "he":
        return rng.normal(0, np.sqrt(2.0 / fan_in), shape)
    if kind in ("constant", "zeros"):
        return np.full(shape, constant if kind == "constant" else 0.0)
    raise ValueError(f"unknown weights {kind!r}; use gaussian, uniform, he, constant or zeros")


def activation(name: str) -> Callable[[np.ndarray], np.ndarray]:
    """UDF10: relu, lrelu (0.2), sigmoid, tanh or linear."""
    found = {"relu": lambda x: np.maximum(x, 0), "lrelu": lambda x: np.where(x > 0, x, 0.2 * x), "sigmoid": lambda x: 1 / (1 + np.exp(-x)), "tanh": np.tanh, "linear": lambda x: x}
    if name not in found:
        raise ValueError(f"unknown activation {name!r}; use one of {sorted(found)}")
    return found[name]


def dense(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """UDF10: (samples, in) by (in, out)."""
    return x @ w + b


def _sides(size: int, kernel: int, padding: str, stride: int) -> tuple[int, int, int]:
    """Output length and padding before and after."""
    if stride < 1:
        raise ValueError(f"stride must be at least 1, not {stride}")
    out = conv_output_shape(size, kernel, padding, stride)
    whole = max((out - 1) * stride + kernel - size, 0) if padding == "SAME" else 0
    return out, whole // 2, whole - whole // 2


def conv1d(x: np.ndarray, w: np.ndarray, b: np.ndarray, stride: int = 1, padding: str = "SAME") -> np.ndarray:
    """UDF10: (samples, length, in) by (kernel, in, out)."""
    out, before, after = _sides(x.shape[1], len(w), padding, stride)
    x = np.pad(x, ((0, 0), (before, after), (0, 0)))
    windows = np.lib.stride_tricks.sliding_window_view(x, len(w), axis=1)[:, ::stride][:, :out]
    return np.einsum("nlck,kco->nlo", windows, w) + b


def deconv1d(x: np.ndarray, w: np.ndarray, b: np.ndarray, length: int, stride: int = 1, padding: str = "SAME") -> np.ndarray:
    """UDF10: the transpose of a convolution of sequences of ``length``; ``w`` is (kernel, out, in)."""
    out, before, after = _sides(length, len(w), padding, stride)
    if out != x.shape[1]:
        raise ValueError(f"a convolution of {length} gives {out}, not {x.shape[1]}")
    full = np.zeros((len(x), length + before + after, w.shape[1]))
    for k in range(len(w)):
        full[:, k : k + stride * out : stride] += x @ w[k].T
    return full[:, before : before + length] + b


def batch_norm(x: np.ndarray, scale: float | np.ndarray = 1.0, shift: float | np.ndarray = 0.0, moments: tuple[np.ndarray, np.ndarray] | None = None, eps: float = 1e-3) -> np.ndarray:
    """UDF10: columns brought to mean 0 and variance 1, by the batch's moments or given ones."""
    mean, variance = moments or (x.mean(0), x.var(0))
    return (x - mean) / np.sqrt(variance + eps) * scale + shift


def dropout(x: np.ndarray, keep: float, seed: int = 0) -> np.ndarray:
    """UDF10: each value kept with the chance ``keep`` and made larger by it."""
    return x if keep >= 1 else x * (np.random.default_rng(seed).random(x.shape) < keep) / keep


# ---- optimisers --------------------------------------------------------------------------------


@dataclass
class Optimiser:
    """UDF12: Adam, SGD or RMS; the rate is constant, exponential in stairs or piecewise constant (as in ``learning_rate``)."""

    method: str = "Adam"
    rate: float = 1e-3
    decay_steps: int | None = None
    decay_rate: float | None = None
    bounds: list[int] | None = None
    values: list[float] | None = None
    step: int = 0
    first: list[np.ndarray] = field(default_factory=list)
    second: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self):
        if self.method not in ("Adam", "SGD", "RMS"):
            raise ValueError(f"unknown method {self.method!r}; use Adam, SGD or RMS")

    def update(self, weights: list[np.ndarray], gradients: list[np.ndarray]) -> list[np.ndarray]:
        """The weights after one step."""
        rate = learning_rate(self.step, self.rate, self.decay_steps, self.decay_rate, self.bounds, self.values)
        self.step += 1
        if self.method == "SGD":
            return [w - rate * g for w, g in zip(weights, gradients, strict=True)]
        if not self.second:
            self.first = [np.zeros_like(w) for w in weights]
            self.second = [np.zeros_like(w) if self.method == "Adam" else np.ones_like(w) for w in weights]
        if self.method == "RMS":  # decay 0.9, no momentum
            self.second = [0.9 * s + 0.1 * g * g for s, g in zip(self.second, gradients, strict=True)]
            return [w - rate * g / np.sqrt(s + 1e-10) for w, g, s in zip(weights, gradients, self.second, strict=True)]
        self.first = [0.9 * m + 0.1 * g for m, g in zip(self.first, gradients, strict=True)]
        self.second = [0.999 * s + 0.001 * g * g for s, g in zip(self.second, gradients, strict=True)]
        rate *= np.sqrt(1 - 0.999**self.step) / (1 - 0.9**self.step)
        return [w - rate * m / (np.sqrt(s) + 1e-8) for w, m, s in zip(weights, self.first, self.second, strict=True)]


# ---- gradients ---------------------------------------------------------------------------------


def _windows(x: np.ndarray, k: int, stride: int) -> np.ndarray:
    """What each output of a 'SAME' convolution sees: (channels, X, Y, Z, k, k, k)."""
    out = [-(-n // stride) for n in x.shape[1:]]
    pads = [max((o - 1) * stride + k - n, 0) for o, n in zip(out, x.shape[1:], strict=True)]
    x = np.pad(x, [(0, 0), *[(p // 2, p - p // 2) for p in pads]])
    return np.lib.stride_tricks.sliding_window_view(x, (k, k, k), axis=(1, 2, 3))[:, ::stride, ::stride, ::stride]


def conv3d_back(x: np.ndarray, w: np.ndarray, dy: np.ndarray, stride: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of ``conv3d`` for its input and its weights."""
    return deconv3d(dy, w, x.shape[1:], stride), np.einsum("oxyz,cxyzijk->ocijk", dy, _windows(x, w.shape[-1], stride), optimize=True)


def deconv3d_back(x: np.ndarray, w: np.ndarray, dy: np.ndarray, stride: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of ``deconv3d`` for its input and its weights."""
    return conv3d(dy, w, stride), np.einsum("cxyz,oxyzijk->coijk", x, _windows(dy, w.shape[-1], stride), optimize=True)


@dataclass
class Segmenter(VoxelNet):
    """UDF8: the segmentation network with the gradient of its weighted softmax cross-entropy (mean over voxels)."""

    def gradient(self, grid: np.ndarray, target: np.ndarray, weights: np.ndarray, draw: int = 0) -> tuple[float, list[np.ndarray]]:
        """Loss and gradients for one tree: ``target`` holds a class a voxel, ``weights`` one number a class."""
        rng, masks, w = np.random.default_rng(draw), [], self.weights

        def unit(x: np.ndarray) -> np.ndarray:
            m = np.where(x > 0, 1.0, self.leak)
            if self.keep_prob < 1:
                m = m * (rng.random(x.shape) < self.keep_prob) / self.keep_prob
            masks.append(m)
            return x * m

        a = unit(conv3d(grid[None], w[0], 2))
        b = unit(conv3d(a, w[1]))
        c = unit(deconv3d(b, w[2], a.shape[1:]))
        d = unit(deconv3d(c, w[3], grid.shape, 2))
        e = conv3d(d, w[4])
        e = e - e.max(0)
        p = np.exp(e) / np.exp(e).sum(0)
        hot = (np.arange(len(p))[:, None, None, None] == target).astype(float)
        share = weights[target] / target.size
        loss = float(-(share * np.log(np.maximum((p * hot).sum(0), 1e-300))).sum())
        dd, g4 = conv3d_back(d, w[4], (p - hot) * share)
        dc, g3 = deconv3d_back(c, w[3], dd * masks[3], 2)
        db, g2 = deconv3d_back(b, w[2], dc * masks[2])
        da, g1 = conv3d_back(a, w[1], db * masks[1])
        return loss, [conv3d_back(grid[None], w[0], da * masks[0], 2)[1], g1, g2, g3, g4]


@dataclass
class LatentNet:
    """UDF9: a variational autoencoder of occupancy grids: two convolutions to mean and log variance, and their transposes back to log-odds."""

    grid: tuple[int, int, int]
    weights: list[np.ndarray]
    alpha: float = 1.0
    leak: float = 0.1

    @classmethod
    def random(cls, grid: tuple[int, int, int], codes: int = 8, channels: int = 4, seed: int = 0, alpha: float = 1.0) -> LatentNet:
        rng, half = np.random.default_rng(seed), [-(-n // 2) for n in grid]
        flat = channels * int(np.prod(half))
        shapes = [(channels, 1, 5, 5, 5), (channels, channels, 3, 3, 3), (flat, 2 * codes), (codes, flat), (channels, channels, 3, 3, 3), (channels, 1, 5, 5, 5)]
        fans = [125, 27 * channels, flat, codes, 27 * channels, 125 * channels]
        return cls(tuple(grid), [rng.normal(size=s) * np.sqrt(1.0 / f) for s, f in zip(shapes, fans, strict=True)], alpha)

    def _unit(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        m = np.where(x > 0, 1.0, self.leak)
        return x * m, m

    def encode(self, grid: np.ndarray) -> np.ndarray:
        """The latent mean."""
        return self._posterior(grid)[0]

    def _posterior(self, grid: np.ndarray):
        a, ma = self._unit(conv3d(grid[None], self.weights[0], 2))
        b, mb = self._unit(conv3d(a, self.weights[1]))
        mean, spread = np.split(b.ravel() @ self.weights[2], 2)
        return mean, spread, a, ma, b, mb

    def decode(self, code: np.ndarray) -> np.ndarray:
        """Probabilities of occupancy."""
        return 1 / (1 + np.exp(-self._logits(code)[0]))

    def _logits(self, code: np.ndarray):
        half = [-(-n // 2) for n in self.grid]
        h, mh = self._unit((code @ self.weights[3]).reshape(-1, *half))
        c, mc = self._unit(deconv3d(h, self.weights[4], half))
        return deconv3d(c, self.weights[5], self.grid, 2)[0], h, mh, c, mc

    def gradient(self, grid: np.ndarray, target: np.ndarray | None = None, weights: np.ndarray | None = None, draw: int = 0) -> tuple[float, list[np.ndarray]]:
        """The negative evidence bound of one tree and its gradients; the sample is drawn by ``draw``."""
        w = self.weights
        mean, spread, a, ma, b, mb = self._posterior(grid)
        noise = np.random.default_rng(draw).normal(size=len(mean))
        code = mean + np.exp(spread / 2) * noise
        logits, h, mh, c, mc = self._logits(code)
        loss = (np.logaddexp(0, logits) - grid * logits).sum() + self.alpha * 0.5 * (np.exp(spread) + mean**2 - 1 - spread).sum()
        dc, g5 = deconv3d_back(c, w[5], (1 / (1 + np.exp(-logits)) - grid)[None], 2)
        dh, g4 = deconv3d_back(h, w[4], dc * mc)
        dh = (dh * mh).ravel()
        dcode = w[3] @ dh
        out = np.concatenate([dcode + self.alpha * mean, dcode * noise * np.exp(spread / 2) / 2 + self.alpha * 0.5 * (np.exp(spread) - 1)])
        db = (w[2] @ out).reshape(b.shape) * mb
        da, g1 = conv3d_back(a, w[1], db)
        return float(loss), [conv3d_back(grid[None], w[0], da * ma, 2)[1], g1, np.outer(b.ravel(), out), np.outer(code, dh), g4, g5]


# ---- checkpoints -------------------------------------------------------------------------------


def save_model(spark: SparkSession, path: str, epoch: int, net: Segmenter | LatentNet, optimiser: Optimiser) -> str:
    """UDF13: weights and the optimiser's state as ``path/epoch_N``, which is returned."""
    rows = [(kind, k, list(map(int, w.shape)), w.ravel().tolist(), optimiser.step) for kind, arrays in (("weight", net.weights), ("first", optimiser.first), ("second", optimiser.second)) for k, w in enumerate(arrays)]
    where = f"{path}/epoch_{epoch}"
    spark.createDataFrame(rows, "kind string, layer int, shape array<int>, data array<double>, step int").coalesce(1).write.mode("overwrite").parquet(where)
    return where


def load_model(spark: SparkSession, where: str, net: Segmenter | LatentNet, optimiser: Optimiser) -> int:
    """UDF13: fill ``net`` and ``optimiser`` from a folder ``.../epoch_N``; returns N + 1, the epoch to go on with."""
    rows = spark.read.parquet(where).orderBy("kind", "layer").collect()  # as many as the network has layers
    arrays = {kind: [np.array(r["data"]).reshape(r["shape"]) for r in rows if r["kind"] == kind] for kind in ("weight", "first", "second")}
    net.weights, optimiser.first, optimiser.second, optimiser.step = arrays["weight"], arrays["first"], arrays["second"], rows[0]["step"]
    return int(re.search(r"epoch_(\d+)/*$", where)[1]) + 1


# ---- the loop ----------------------------------------------------------------------------------


def _summed(net, weights: np.ndarray, grid: tuple[int, int, int], key: str, seed: int):
    """A ``mapInPandas`` function: the summed loss and gradients of a task's trees as one row."""

    def run(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, sums, n = 0.0, None, 0
        for pdf in pdfs:
            for name, slot, cells in zip(pdf[key], pdf["slot"], pdf["voxels"], strict=True):
                full, target = np.zeros(grid), np.zeros(grid, int)
                for c in cells:
                    at = c["ix"], c["iy"], c["iz"]
                    full[at], target[at] = 1.0, c["cube"] if "cube" in c else 1
                draw = np.random.SeedSequence([seed, int(slot), abs(hash(float(name))) if isinstance(name, (int, float, np.number)) else sum(str(name).encode())]).generate_state(1)[0]
                loss, gradients = net.gradient(full, target, weights, int(draw))
                total, n = total + loss, n + 1
                sums = gradients if sums is None else [a + b for a, b in zip(sums, gradients, strict=True)]
        if n:
            yield pd.DataFrame({"n": [n], "loss": [total], "gradient": [np.concatenate([g.ravel() for g in sums]).tobytes()]})

    return run


def train(
    batches: DataFrame, grid: tuple[int, int, int], net: Segmenter | LatentNet, optimiser: Optimiser, epochs: int, path: str, key: str = "tree_id", classes: int = 3,
    save_epochs: tuple[int, ...] = (), resume: str | None = None, seed: int = 0,
) -> list[tuple[int, float]]:
    """UDF8, UDF9: fit ``net`` in place to ``batches`` (key, batch, slot, voxels); (epoch, mean loss a tree) of the epochs run.

    ``voxels`` are occupied cells (ix, iy, iz[, cube]); class weights are the
    batch's largest class over each class, all other cells being class 0. The
    batches are written once under ``path``, one folder each, so a step reads its
    own; ``path/epoch_N`` keeps the last epoch and those of ``save_epochs``, and
    ``resume`` goes on from such a folder. No batches leave the net as it is.
    """
    spark = batches.sparkSession
    start = load_model(spark, resume, net, optimiser) if resume else 0
    stored = f"{path}/batches"
    batches.repartition("batch", "slot").write.mode("overwrite").partitionBy("batch").parquet(stored)
    data = spark.read.schema(batches.schema).parquet(stored)
    cells, counts = int(np.prod(grid)), {}
    has_cube = "cube" in batches.schema["voxels"].dataType.elementType.names
    for r in data.groupBy("batch").agg(F.count("*").alias("trees")).collect():  # a row a batch
        counts[r["batch"]] = np.array([float(r["trees"] * cells), *[0.0] * (classes - 1)])
    if has_cube:
        for r in data.select("batch", F.explode("voxels.cube").alias("cube")).groupBy("batch", "cube").count().collect():
            counts[r["batch"]][r["cube"]] += r["count"]
            counts[r["batch"]][0] -= r["count"]
    history = []
    for epoch in range(start, epochs):
        total, trees = 0.0, 0
        for b in sorted(counts):
            weights = (counts[b].max() + 1) / (counts[b] + 1)
            rows = data.where(F.col("batch") == b).mapInPandas(_summed(net, weights, grid, key, seed + epoch), "n long, loss double, gradient binary").collect()  # a row a task
            n = sum(r["n"] for r in rows)
            flat = sum(np.frombuffer(r["gradient"]) for r in sorted(rows, key=lambda r: (r["loss"], r["n"]))) / n
            cuts = np.cumsum([w.size for w in net.weights])[:-1]
            net.weights = optimiser.update(net.weights, [g.reshape(w.shape) for g, w in zip(np.split(flat, cuts), net.weights, strict=True)])
            total, trees = total + sum(r["loss"] for r in rows), trees + n
        if counts:
            history.append((epoch, total / trees))
        if epoch in save_epochs or epoch == epochs - 1:
            save_model(spark, path, epoch, net, optimiser)
    return history


def reconstructed(voxels: DataFrame, net: LatentNet, key: str = "tree_id") -> DataFrame:
    """UDF9: (key, ix, iy, iz, prob) of every cell that the decoder thinks occupied more likely than not, from each tree's latent mean."""

    def run(name: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        full = np.zeros(net.grid)
        full[pdf["ix"], pdf["iy"], pdf["iz"]] = 1.0
        p = net.decode(net.encode(full))
        at = np.argwhere(p > 0.5)
        return pd.DataFrame({key: name[0], "ix": at[:, 0], "iy": at[:, 1], "iz": at[:, 2], "prob": p[tuple(at.T)]})

    kind = dict(voxels.dtypes)[key]
    return voxels.select(key, "ix", "iy", "iz").groupBy(key).applyInPandas(run, f"{key} {kind}, ix int, iy int, iz int, prob double")
