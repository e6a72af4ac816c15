"""Connected components of a frame of edges, lineage cuts and global numbering."""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Edges that one task joins at the end (16 bytes each).
ONE_TASK = 1 << 17
#: Shares (63 at most) into which the edges of one node are dealt wherever they meet their least neighbour.
SALTS = 32


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a folder of this machine only where none is set and the master is local."""
    context = spark.sparkContext
    configured = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    if not configured and not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(configured or tempfile.mkdtemp(prefix="timberline-"))
    return context._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the reliable checkpoint folder and go on from those files."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _with_least(edges: DataFrame, least: Column) -> DataFrame:
    """``edges`` (u, v) with m, the value of ``least`` over all edges of u.

    The edges of a node are dealt into shares, and its minimum is sent to the
    shares it has, so that no task reads all edges of a hub. The merge join keeps
    the rows of each round away from the driver, which would broadcast them.
    """
    salted = edges.withColumn("_s", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    smallest = salted.groupBy("u").agg(least.alias("m"), F.bit_or(F.expr("shiftleft(1L, _s)")).alias("_shares"))
    shares = F.filter(F.sequence(F.lit(0), F.lit(SALTS - 1)), lambda k: F.getbit(F.col("_shares"), k) == 1)
    sent = smallest.select(F.col("u").alias("_u"), "m", F.explode(shares).alias("_t"))
    return salted.join(sent.hint("merge"), (F.col("u") == F.col("_u")) & (F.col("_s") == F.col("_t"))).select("u", "v", "m")


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Components of one task's edges: roots are hooked to smaller ones until none is left, which halves their number each time."""
    tables = [pa.Table.from_batches([b]) for b in batches]
    if not tables:
        return
    u, v = (np.concatenate([t.column(c).to_numpy() for t in tables]) for c in "uv")
    nodes, place = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b, root = place[: len(u)], place[len(u) :], np.arange(len(nodes))
    while (root[a] != root[b]).any():
        np.minimum.at(root, np.maximum(root[a], root[b]), np.minimum(root[a], root[b]))
        while (root != root[root]).any():
            root = root[root]
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "component"])


def connected_components(edges: DataFrame, rounds: int = 60, one_task: int | None = None) -> DataFrame:
    """(node, component) for the undirected ``edges`` (u, v); component = smallest node reachable.

    Alternating large-star and small-star steps: each round is two aggregations
    and two joins over the remaining edges, converging in O(log n) rounds. Once
    at most ``one_task`` edges (``ONE_TASK``) are left, one task finishes them.
    Nodes without edges are not returned; self-loops keep their node; repeated
    edges are allowed; null ends are dropped; no edges give an empty frame.
    """
    one_task = ONE_TASK if one_task is None else one_task
    edges = edges.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
    given = checkpointed(edges.where(F.col("u").isNotNull() & F.col("v").isNotNull()).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    current = given.where(F.col("u") != F.col("v"))

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    before = state(current)
    for _ in range(rounds):
        if before[0] <= one_task:
            found = checkpointed(current.repartition(1).mapInArrow(_finished, "node long, component long"))
            alone = given.where(F.col("u") == F.col("v")).join(found.withColumnRenamed("node", "u"), "u", "left_anti")
            return found.union(alone.select("u", "v"))
        both = current.union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, F.least("u", F.min("v"))).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = _with_least(large, F.min("v")).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        current = checkpointed(small.select("e.*").where(F.col("u") != F.col("v")).distinct())
        after = state(current)
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("connected components did not converge")
    roots = current.select(F.col("v").alias("u"), "v").union(given.where(F.col("u") == F.col("v")).join(current, "u", "left_anti"))
    return current.union(roots.distinct()).select(F.col("u").alias("node"), F.col("v").alias("component"))


def numbered(df: DataFrame, *order: str | Column, name: str = "number") -> DataFrame:
    """``df`` with a contiguous number from 0 in the given order.

    The frame is sorted by ranges and written; each range's first number comes
    from the row counts of the ranges before it, so no task holds more than a range.
    """
    place = F.monotonically_increasing_id()  # range << 33 | row
    placed = checkpointed(df.orderBy(*order).withColumn("_place", place)).withColumn("_range", F.shiftright("_place", 33))
    before = F.sum("_rows").over(Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1))
    counts = placed.groupBy(F.col("_range").alias("_r")).agg(F.count("*").alias("_rows")).withColumn("_first", F.coalesce(before, F.lit(0)))
    joined = placed.join(F.broadcast(counts), F.col("_range") == F.col("_r"))  # a row a partition
    return joined.withColumn(name, F.col("_first") + F.col("_place").bitwiseAND(F.lit((1 << 33) - 1))).drop("_place", "_range", "_r", "_rows", "_first")
