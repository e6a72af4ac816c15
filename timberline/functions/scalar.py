"""Column expressions and small pure functions."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(value: Column, low, high) -> Column:
    return F.least(F.greatest(value, F.lit(low)), F.lit(high))


def cell(value: Column, origin, size: float) -> Column:
    """Number of the cell of width ``size`` that holds ``value``, counted from ``origin``."""
    return F.floor((value - origin) / F.lit(float(size))).cast("int")


def euclid(*differences: Column) -> Column:
    """Length of a difference vector."""
    total = differences[0] * differences[0]
    for d in differences[1:]:
        total = total + d * d
    return F.sqrt(total)


def array_distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda t, x: t + x))


def kernel_table(size: int, weighted: bool = True, mu: float = 0.0, sigma: float = 1.0) -> list[tuple[int, int, float]]:
    """(row offset, column offset, weight) of a ``size`` x ``size`` window: a Gaussian of the radius on [-1, 1]^2, or ones."""
    axis = np.linspace(-1.0, 1.0, size)
    half = size // 2
    out = []
    for i, y in enumerate(axis.tolist()):
        for j, x in enumerate(axis.tolist()):
            d = math.sqrt(x * x + y * y)
            out.append((i - half, j - half, math.exp(-((d - mu) ** 2) / (2.0 * sigma**2)) if weighted else 1.0))
    return out


def conv_output_shape(size: int, kernel: int, padding: str, stride: int) -> int:
    """Length of a convolution's output along one axis."""
    if padding == "VALID":
        return math.ceil((size - kernel + 1) / stride)
    if padding == "SAME":
        return math.ceil(size / stride)
    raise ValueError(f"unknown padding {padding!r}; use SAME or VALID")


def learning_rate(step: int, rate: float = 1e-3, decay_steps: int | None = None, decay_rate: float | None = None, bounds: list[int] | None = None, values: list[float] | None = None) -> float:
    """The rate at a step: constant, exponential in stairs, or piecewise constant (a bound belongs to the piece before it)."""
    if decay_rate is not None:
        return rate * decay_rate ** (step // decay_steps)
    if bounds is not None:
        return [rate, *values][sum(step > b for b in bounds)]
    return rate


def jet(v: Column) -> list[Column]:
    """Red, green and blue of the jet colour map at ``v`` in [0, 1] (piecewise linear)."""
    # fixed values: the corners of the map's three ramps
    red = _ramp(v, [(0.0, 0.0), (0.35, 0.0), (0.66, 1.0), (0.89, 1.0), (1.0, 0.5)])
    green = _ramp(v, [(0.0, 0.0), (0.125, 0.0), (0.375, 1.0), (0.64, 1.0), (0.91, 0.0), (1.0, 0.0)])
    blue = _ramp(v, [(0.0, 0.5), (0.11, 1.0), (0.34, 1.0), (0.65, 0.0), (1.0, 0.0)])
    return [red, green, blue]


def _ramp(x: Column, points: list[tuple[float, float]]) -> Column:
    out = F.lit(points[-1][1])
    for (x0, y0), (x1, y1) in reversed(list(zip(points, points[1:], strict=False))):
        out = F.when(x <= x1, F.lit(y0) + (x - x0) * ((y1 - y0) / (x1 - x0))).otherwise(out)
    return out


def hsv_to_rgb(h: Column, s: Column, v: Column) -> list[Column]:
    """Hue, saturation and value in [0, 1] to red, green and blue."""
    sector = F.floor(h * 6)
    f = h * 6 - sector
    p, q, t = v * (1 - s), v * (1 - s * f), v * (1 - s * (1 - f))
    k = F.pmod(sector, F.lit(6))
    pick = lambda a: F.element_at(F.array(*a), (k + 1).cast("int"))
    return [pick([v, q, p, p, t, v]), pick([t, v, v, q, p, p]), pick([p, p, t, v, v, q])]
