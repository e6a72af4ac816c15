"""Schemas and configurations of the point-cloud engine.

Row position means nothing in Spark, so every cloud carries a unique ``pid``;
wherever an operator has ties, the smallest id wins. Grids are sparse: only
occupied cells are rows.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import types as T


def _schema(text: str) -> T.StructType:
    return T.StructType([T.StructField(n, {"d": T.DoubleType(), "l": T.LongType(), "i": T.IntegerType(), "s": T.StringType()}[k]) for n, k in (x.split(":") for x in text.split())])


POINTS = _schema("cloud_id:s pid:l x:d y:d z:d intensity:d red:d green:d blue:d")
GROUND_POINTS = _schema("ix:i iy:i gx:d gy:d gz:d")
GROUND_GRID = _schema("cx:i cy:i gz:d")
VOXELS = _schema("cloud_id:s ix:i iy:i iz:i ret:d cls:i")
RASTER = _schema("row:i col:i v:d")
BOXES = _schema("bid:l ymin:d xmin:d ymax:d xmax:d class_id:i score:d")
CIRCLES = _schema("cid:l x:d y:d r:d z:d n:l")
STEMS = _schema("stem_id:l seq:i cid:l x:d y:d r:d z:d n:l")

LAYERS = ("vertical_density", "max_height", "canopy_height", "mean_colour1", "mean_colour2", "mean_colour3", "max_colour1", "max_colour2", "max_colour3", "blank")
NORMALISATIONS = ("rescale", "rescale+histeq", "cmap_jet")


@dataclass
class RasterConfig:
    """Layers of a detector's input image; lists shorter than three are filled up with blank layers."""

    raster_layers: list[str]
    support_window: list[int] = field(default_factory=list)
    normalisation: str = "rescale"
    doHisteq: list[bool] = field(default_factory=list)  # noqa: N815  (name in the files)
    res: float = 0.2
    gridSize: tuple[int, int, int] = (600, 600, 1000)  # noqa: N815

    def __post_init__(self):
        fill = lambda xs, v: [*xs, *[v] * (3 - len(xs))]
        self.raster_layers = fill(list(self.raster_layers), "blank")
        self.support_window = fill(list(self.support_window), 1)
        self.doHisteq = fill(list(self.doHisteq), True)
        self.gridSize = tuple(self.gridSize)
        if not isinstance(self.res, float) or self.res <= 0:
            raise ValueError("res must be a positive float")
        if len(self.gridSize) != 3 or min(self.gridSize) < 1:
            raise ValueError("gridSize must have three positive dimensions")
        if unknown := set(self.raster_layers) - set(LAYERS):
            raise ValueError(f"unknown layers: {sorted(unknown)}")
        if self.normalisation not in NORMALISATIONS:
            raise ValueError(f"unknown normalisation {self.normalisation!r}; use one of {NORMALISATIONS}")
        if self.normalisation == "cmap_jet" and self.raster_layers[1:] != ["blank", "blank"]:
            raise ValueError("cmap_jet takes one layer")

    @classmethod
    def from_json(cls, path: str) -> RasterConfig:
        with open(path, encoding="utf-8") as f:
            return cls(**json.load(f))

    def to_json(self, path: str) -> None:
        with open(path, "w", encoding="utf-8") as f:
            json.dump(self.__dict__, f)


@dataclass
class NetConfig:
    """Three nested groups of settings of a segmentation network."""

    model_dict: dict
    train_op_dict: dict = field(default_factory=dict)
    train_model_dict: dict = field(default_factory=dict)

    @classmethod
    def from_json(cls, path: str) -> NetConfig:
        with open(path, encoding="utf-8") as f:
            return cls(**json.load(f))
