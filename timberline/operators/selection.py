"""Exact order statistics of groups of any size (AGG16, AGG17)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from timberline.operators.graph import checkpointed

#: Bins into which a group's open range is cut in each pass.
BINS = 1 << 10
#: Values that are sorted in one place.
SORTED = 1 << 12
#: Groups whose rows may be broadcast, and shares of a group where there are more.
BROADCAST_GROUPS = 1 << 16
SALTS = 32


def with_group(rows: DataFrame, groups: DataFrame, key: str, broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """``rows`` joined with ``groups`` (``_key``, values; a row a group) by ``key``, though one group may hold most rows: few groups are broadcast, of many each is dealt into shares."""
    groups = checkpointed(groups)
    if groups.limit(broadcast_groups + 1).count() <= broadcast_groups:
        return rows.join(F.broadcast(groups), F.col(key) == F.col("_key")).drop("_key")
    sent = groups.withColumn("_t", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("_s", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    return salted.join(sent.hint("merge"), (F.col(key) == F.col("_key")) & (F.col("_s") == F.col("_t"))).drop("_key", "_s", "_t")


def at_rank(rows: DataFrame, key: str, value: str, rank: Callable[[Column], Column], bins: int = BINS, most: int = SORTED, broadcast_groups: int = BROADCAST_GROUPS) -> DataFrame:
    """(key, value) the value at place ``rank(n)`` (from 0) of each group's n values in ascending order: nulls first, then numbers, then NaN.

    A pass counts a group's values by bins of its open range, by partial sums, and goes on with the
    bin that holds the place, between that bin's own least and greatest value. Bins keep the order of
    values, so the result is exact. A group with at most ``most`` values left in its range has them
    sorted; no task holds more of it. ``key`` has no nulls.
    """
    v = F.col(value).cast("double")
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))
    numbers = F.when(finite, v)
    found = rows.groupBy(F.col(key).alias("_key")).agg(
        F.count("*").alias("n"), F.count(F.when(v.isNull(), 1)).alias("nulls"), F.count(F.when(v == float("-inf"), 1)).alias("lowest"), F.count(numbers).alias("m"),
        F.count(F.when(v == float("inf"), 1)).alias("highest"), F.min(numbers).alias("lo"), F.max(numbers).alias("hi"),
    )
    place = rank(F.col("n")).cast("long") - F.col("nulls")
    edge = F.when(place < 0, F.lit(None).cast("double")).when(place < F.col("lowest"), float("-inf")).when(place - F.col("lowest") < F.col("m"), F.col("lo")).when(place - F.col("lowest") < F.col("m") + F.col("highest"), float("inf")).otherwise(float("nan"))
    inside = F.coalesce((place >= F.col("lowest")) & (place - F.col("lowest") < F.col("m")), F.lit(False)) & (F.col("lo") < F.col("hi"))
    state = checkpointed(found.select("_key", "lo", "hi", "m", (place - F.col("lowest")).alias("k"), edge.alias("v"), inside.alias("open")))
    done = None
    while True:
        ended = state.where(~F.col("open")).select("_key", "v")
        done = ended if done is None else done.union(ended)
        state = state.where("open").drop("v", "open")
        if state.isEmpty():
            return done.select(F.col("_key").alias(key), F.col("v").alias(value))
        left = with_group(rows.where(finite).select(key, v.alias("_v")), state, key, broadcast_groups).where((F.col("_v") >= F.col("lo")) & (F.col("_v") <= F.col("hi")))
        few = left.where(F.col("m") <= most).groupBy(F.col(key).alias("_key")).agg(F.sort_array(F.collect_list("_v")).alias("all"), F.first("k").alias("k"))
        done = done.union(checkpointed(few.select("_key", F.get("all", F.col("k").cast("int")))))
        wide = F.col("hi") - F.col("lo") == float("inf")
        share = F.when(wide, (F.col("_v") / 2 - F.col("lo") / 2) / F.greatest(F.col("hi") / 2 - F.col("lo") / 2, F.lit(1.0))).otherwise((F.col("_v") - F.col("lo")) / (F.col("hi") - F.col("lo")))
        binned = left.where(F.col("m") > most).withColumn("_b", F.least(F.floor(share * bins), F.lit(bins - 1)))
        counts = binned.groupBy(F.col(key).alias("_key"), "_b").agg(F.count("*").alias("m"), F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.first("k").alias("k"))
        upto = F.sum("m").over(Window.partitionBy("_key").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))  # as many rows as there are bins
        held = counts.withColumn("upto", upto).where((F.col("k") < F.col("upto")) & (F.col("k") >= F.col("upto") - F.col("m")))
        state = checkpointed(held.select("_key", "lo", "hi", "m", (F.col("k") - F.col("upto") + F.col("m")).alias("k"), F.col("lo").alias("v"), (F.col("lo") < F.col("hi")).alias("open")))
