"""Training-set preparation: batches, augmentation, splits, class weights and losses (IT1-6, SET3, AGG23-25, UDF11)."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.operators.graph import checkpointed, numbered
from timberline.operators.projections import flipped, one_hot, randomly_rotated


def batch_numbers(items: DataFrame, size: int, key: str = "cloud_id", seed: int | None = None) -> DataFrame:
    """(key, batch, slot): items in order of their key, or shuffled by ``seed``, dealt to batches of ``size``; a last short batch wraps around to the first items."""
    order = [F.xxhash64(F.lit(seed), key), F.col(key)] if seed is not None else [F.col(key)]
    ranked = numbered(items.select(key).distinct(), *order, name="_rank")
    ranked = ranked.withColumns({"batch": F.floor(F.col("_rank") / size).cast("int"), "slot": F.pmod("_rank", F.lit(size)).cast("int")})
    n = ranked.agg(F.count("*").alias("_n"), F.max("batch").alias("_last"))
    missing = F.col("_rank") < F.pmod(-F.col("_n"), F.lit(size))
    wrapped = ranked.join(F.broadcast(n), F.lit(True)).where(missing).select(key, F.col("_last").alias("batch"), (F.pmod("_n", F.lit(size)) + F.col("_rank")).cast("int").alias("slot"))
    return ranked.select(key, "batch", "slot").union(wrapped)


def augmented(points: DataFrame, copies: int, key: str = "cloud_id", limit_x: float = 20.0, limit_y: float = 20.0, seed: int = 0) -> DataFrame:
    """IT5: the clean points (copy 0) and ``copies`` turned and flipped ones."""
    fan = points.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(copies))))
    turned = flipped(randomly_rotated(fan, [key, "copy"], limit_x, limit_y, seed), [key, "copy"], seed)
    moved = {c: F.when(F.col("copy") == 0, F.col(f"_{c}")).otherwise(F.col(c)) for c in "xyz"}
    kept = fan.select(key, "copy", "pid", *[F.col(c).alias(f"_{c}") for c in "xyz"])
    return turned.join(kept, [key, "copy", "pid"]).withColumns(moved).drop("_x", "_y", "_z")


def point_batches(points: DataFrame, size: int, key: str = "cloud_id", label: str | None = "class_id", classes: int = 4, ret: str | None = None) -> DataFrame:
    """IT1, IT2: one row a cloud and batch: arrays of xyz (by pid), labels, one-hot labels and returns; clouds keep their own lengths."""
    fields = [F.array("x", "y", "z").alias("xyz")]
    fields += [F.col(label).cast("int").alias("label"), one_hot(F.col(label), classes).alias("one_hot")] if label else []
    fields += [F.col(ret).alias("ret")] if ret else []
    rows = points.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pid", *fields))).alias("rows"))
    named = ["xyz", *(["label", "one_hot"] if label else []), *(["ret"] if ret else [])]
    out = rows.select(key, *[F.col("rows")[n].alias(n) for n in named])
    return batch_numbers(points, size, key).join(out, key)


def voxel_batches(voxels: DataFrame, size: int, key: str = "cloud_id") -> DataFrame:
    """IT3, IT4: one row a cloud and batch with its occupied voxels (ix, iy, iz, cube, ret) in order; dense cubes are made where a model needs them."""
    extra = [F.col(c) for c in ("cube", "ret") if c in voxels.columns]
    cells = voxels.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ix", "iy", "iz", *extra))).alias("voxels"))
    return batch_numbers(voxels, size, key).join(cells, key)


def signed(occupied: Column) -> Column:
    """IT6: 0 and 1 to -1 and 1."""
    return (occupied - 0.5) * 2


def split_random(items: DataFrame, held_out: int, key: str = "cloud_id", seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """SET3: (train, validation) with ``held_out`` random keys in validation; rows with a null key are in train."""
    chosen = checkpointed(items.select(key).distinct().where(F.col(key).isNotNull()).orderBy(F.xxhash64(F.lit(seed), key), key).limit(held_out))
    return items.join(chosen, key, "left_anti"), items.join(chosen, key, "left_semi")


def split_every(items: DataFrame, percent: float, key: str = "cloud_id") -> DataFrame:
    """SET3: ``part`` is test for every (round(100 / percent) + 1)-th key in order, else train."""
    ranked = numbered(items.select(key).distinct(), key, name="_rank")
    return ranked.select(key, F.when(F.pmod(F.col("_rank") + 1, F.lit(round(100 / percent) + 1)) == 0, "test").otherwise("train").alias("part"))


def class_weights(rows: DataFrame, label: str, classes: int) -> DataFrame:
    """AGG24: (label, n, weight): largest count over each count, every count one larger than found; unseen classes included."""
    every = rows.sparkSession.range(classes).select(F.col("id").cast("int").alias(label))
    n = every.join(rows.groupBy(F.col(label).cast("int").alias(label)).agg(F.count("*").alias("n")), label, "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return n.withColumn("weight", (F.max("n").over(Window.partitionBy()) + 1) / (F.col("n") + 1))


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda t, v: t + v)


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda t, v: t + v)


def reconstruction_loss(rows: DataFrame, target: str, predicted: str, kind: str = "SSE") -> DataFrame:
    """UDF11: one row ``loss``: SSE, CSA (one minus cosine), SA (angle) or SID (divergence of the normalised vectors)."""
    t, p = F.col(target), F.col(predicted)
    cosine = _dot(t, p) / F.sqrt(_dot(t, t) * _dot(p, p))
    if kind == "SSE":
        each = _sum(F.zip_with(t, p, lambda x, y: (x - y) * (x - y)))
    elif kind == "CSA":
        each = 1 - cosine
    elif kind == "SA":
        each = F.acos(F.least(F.greatest(cosine, F.lit(-1.0)), F.lit(1.0)))
    elif kind == "SID":
        st, sp = _sum(t), _sum(p)
        each = _sum(F.zip_with(t, p, lambda x, y: (x / st - y / sp) * F.log((x / st) / (y / sp))))
    else:
        raise ValueError(f"unknown loss {kind!r}; use SSE, CSA, SA or SID")
    return rows.agg(F.sum(each).alias("loss"))


def cross_entropy(rows: DataFrame, label: str, logits: str, weights: list[float] | None = None) -> DataFrame:
    """UDF11: softmax cross-entropy of class ``label`` under ``logits``, weighted by class and averaged over rows with a weight."""
    top = F.array_max(logits)
    log_sum = top + F.log(_sum(F.transform(logits, lambda v: F.exp(v - top))))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col(label).cast("int") + 1) if weights else F.lit(1.0)
    loss = weight * (log_sum - F.element_at(logits, F.col(label).cast("int") + 1))
    return rows.agg((F.sum(loss) / F.count_if(weight > 0)).alias("loss"))


def binary_cross_entropy(rows: DataFrame, target: str, predicted: str, eps: float = 1e-12) -> DataFrame:
    """UDF11: mean binary cross-entropy of probabilities."""
    t, p = F.col(target), F.col(predicted)
    return rows.agg(F.avg(-(t * F.log(p + eps) + (1.0 - t) * F.log(1.0 - p + eps))).alias("loss"))


def wasserstein(rows: DataFrame, target: str, predicted: str) -> DataFrame:
    """UDF11: mean product."""
    return rows.agg(F.avg(F.col(target) * F.col(predicted)).alias("loss"))


def l2_penalty(weights: DataFrame, column: str = "w", weighting: float = 1e-6) -> DataFrame:
    """UDF11: ``weighting`` times half the sum of squares."""
    return weights.agg((F.sum(F.col(column) * F.col(column)) / 2 * weighting).alias("loss"))


def kl_normal(rows: DataFrame, mean: str, deviation: str) -> DataFrame:
    """UDF11: mean divergence of diagonal normals from the unit normal."""
    m, s = F.col(mean), F.col(deviation)
    return rows.agg(F.avg(_sum(F.zip_with(m, s, lambda a, b: (a * a + b * b - 1) / 2 - F.log(b)))).alias("loss"))


def passes_summary(passes: DataFrame, keys: list[str]) -> DataFrame:
    """AGG25: (keys, class_id, certainty, variance) of the class with the greatest mean probability over passes."""
    each = passes.groupBy(*keys, "class_id").agg(F.avg("prob").alias("certainty"), F.var_pop("prob").alias("variance"))
    best = F.max_by(F.struct("class_id", "certainty", "variance"), F.struct("certainty", -F.col("class_id"))).alias("b")
    return each.groupBy(*keys).agg(best).select(*keys, "b.*")


def steps_per_epoch(clouds: int, size: int) -> int:
    return math.ceil(clouds / size)
