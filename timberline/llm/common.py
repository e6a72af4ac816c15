"""Helpers shared by the corpus operators: lineage cuts, Arrow batches, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from timberline.operators.graph import checkpointed as cut
from timberline.operators.graph import connected_components, ensure_checkpoint_dir

__all__ = ["CHUNK_BYTES", "Forest", "by_text_chunks", "connected_components", "cut", "documents", "ensure_checkpoint_dir", "text_chunks", "texts_of"]

#: Text bytes handled at once inside a Python worker.
CHUNK_BYTES = 1 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_chunks(batch: pa.RecordBatch, column: str | int = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``batch`` with about ``limit`` bytes of text each (a longer text comes alone)."""
    sizes = pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
    total, start = np.cumsum(sizes, dtype=np.int64), 0
    while start < len(sizes):
        base = total[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(total, base + limit, side="right")))
        yield batch.slice(start, end - start)
        start = end


def by_text_chunks(function: Callable[[pa.RecordBatch], pa.RecordBatch | None], column: str = "text"):
    """A ``mapInArrow`` function that applies ``function`` to slices of bounded text size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_chunks(batch, column):
                out = function(part)
                if out is not None and out.num_rows:
                    yield out

    return run


def texts_of(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts; null counts as empty."""
    return [t or "" for t in batch.column(column).to_pylist()]


class Forest:
    """Union-find over 0..n-1 that keeps the smallest member as root."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self) -> np.ndarray:
        p = self.parent
        while True:
            q = p[p]
            if np.array_equal(p, q):
                self.parent = p
                return p
            p = q

    def link(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Join the sets of a[i] and b[i]; the places i that really joined two sets.

        Only distinct pairs of roots are walked one by one.
        """
        none = np.empty(0, np.int64)
        if not len(a):
            return none
        p = self.roots()
        a, b = p[a], p[b]
        lo, hi = np.minimum(a, b), np.maximum(a, b)
        differ = np.flatnonzero(lo != hi)
        if not len(differ):
            return none
        keys, first = np.unique(lo[differ] * np.int64(len(p)) + hi[differ], return_index=True)
        parent, joined = p.copy(), []

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for x, y, at in zip((keys // len(p)).tolist(), (keys % len(p)).tolist(), differ[first].tolist(), strict=True):
            x, y = find(x), find(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
                joined.append(at)
        self.parent = parent
        return np.array(joined, np.int64)
