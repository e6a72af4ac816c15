"""Sharding by fixed virtual slots (DataFrame functions only).

A record's key is hashed into one of ``n_slots`` virtual slots, which never
change. A versioned map says which shard owns each slot; rows and bytes are
aggregated by slot, and adding a shard or evening out bytes edits a few
entries of the map instead of hashing records anew. Versions of the map are
stored side by side, each with the totals it was made from. The map has ``n_slots``
rows however large the corpus is, so it can be broadcast.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from timberline.llm.common import cut, ensure_checkpoint_dir

N_SLOTS = 8192
#: Rows of one virtual slot that are counted out together, about.
COUNTED_TOGETHER = 1 << 20
#: Bytes that a record takes besides its text.
ROW_BYTES = 16


def records(docs: DataFrame, n_slots: int = N_SLOTS) -> DataFrame:
    """(doc_id, size, text_crc32, vslot) of each row; a null text has no bytes and checksum 0."""
    text = F.col("text").cast("string")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES).alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
        F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(n_slots)).cast("int").alias("vslot"),
    )


def slot_totals(recs: DataFrame) -> DataFrame:
    """Rows and bytes of each used slot, combined before the shuffle."""
    return recs.groupBy("vslot").agg(F.count("*").alias("rows"), F.sum("size").alias("bytes"))


def initial_map(spark: SparkSession, n_shards: int, n_slots: int = N_SLOTS) -> DataFrame:
    """Version 1: slots dealt to shards in turn."""
    return spark.range(n_slots).select(F.lit(1).alias("version"), F.col("id").cast("int").alias("vslot"), F.pmod("id", F.lit(n_shards)).cast("int").alias("shard"))


def grown_map(slot_map: DataFrame, n_shards: int) -> DataFrame:
    """The next version with shard ``n_shards`` added: every shard gives up one slot in ``n_shards`` + 1, by slot number alone."""
    turn = F.row_number().over(Window.partitionBy("shard").orderBy("vslot"))
    moves = F.pmod(turn - 1 + F.col("shard"), F.lit(n_shards + 1)) == n_shards
    return slot_map.select((F.col("version") + 1).alias("version"), "vslot", F.when(moves, F.lit(n_shards)).otherwise(F.col("shard")).cast("int").alias("shard"))


def evened_map(slot_map: DataFrame, totals: DataFrame, n_shards: int) -> DataFrame:
    """The next version in which shards with too many bytes give their smallest spare slots to those with too few."""
    filled = slot_map.join(F.broadcast(totals), "vslot", "left").withColumn("bytes", F.coalesce("bytes", F.lit(0)))
    running = Window.partitionBy("shard").orderBy(F.desc("bytes"), "vslot").rowsBetween(Window.unboundedPreceding, 0)
    target = (filled.agg(F.sum("bytes")).first()[0] or 0) / n_shards
    marked = filled.withColumn("upto", F.sum("bytes").over(running))
    spare = marked.where((F.col("upto") > target) & (F.col("bytes") > 0))
    pool = spare.withColumn("at", F.sum("bytes").over(Window.orderBy(F.desc("bytes"), "vslot")) - F.col("bytes") / 2)
    kept = marked.where(F.col("upto") <= target).groupBy("shard").agg(F.sum("bytes").alias("has"))
    shards = slot_map.sparkSession.range(n_shards).select(F.col("id").cast("int").alias("to")).join(F.broadcast(kept), F.col("to") == F.col("shard"), "left")
    room = shards.withColumn("room", F.lit(target) - F.coalesce("has", F.lit(0)))
    room = room.withColumn("end", F.sum("room").over(Window.orderBy("to"))).withColumn("begin", F.col("end") - F.col("room"))
    moved = pool.join(F.broadcast(room.select("to", "begin", "end")), (F.col("at") >= F.col("begin")) & (F.col("at") < F.col("end")), "left").select("vslot", "to")
    return slot_map.join(moved, "vslot", "left").select((F.col("version") + 1).alias("version"), "vslot", F.coalesce("to", "shard").cast("int").alias("shard"))


def save_map(slot_map: DataFrame, totals: DataFrame, path: str) -> None:
    """Add this version, with the totals it was made from, to the stored map; older versions stay."""
    slot_map.join(F.broadcast(totals), "vslot", "left").write.mode("append").partitionBy("version").parquet(path)


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """One stored version, the latest unless told."""
    stored = spark.read.parquet(path)
    return stored.where(F.col("version") == (stored.agg(F.max("version")).first()[0] if version is None else version))


def shard(docs: DataFrame, n_shards: int = 40, n_slots: int = N_SLOTS, path: str | None = None, together: int = COUNTED_TOGETHER) -> DataFrame:
    """Each row's shard under the law ``key``, its gapless place there, and its shard after adding one.

    The doc_id and the shard count alone decide, so adding a shard moves rows
    only into it. Version 1 of the map and the edited version 2 with one more
    shard are stored in ``path`` (a new folder in the shared checkpoint folder
    unless told) and read back; ``map_version`` says which one ``shard`` is of.
    Places are counted in the order of virtual slot, then doc_id, checksum and
    size: the window runs inside a virtual slot and the slot's offset comes from
    the per-slot row counts, so no task holds a shard. A slot with more than
    ``together`` rows is counted out in parts, dealt by the rows' places in the
    input, which then decide on the order as well.

    Null doc_ids share one virtual slot; null texts count as empty; repeated
    rows get places of their own; an empty table gives an empty frame; columns
    other than doc_id and text are ignored.
    """
    spark = docs.sparkSession
    recs = cut(records(docs, n_slots).withColumn("turn", F.monotonically_increasing_id()))
    totals = cut(slot_totals(recs))
    path = path or f"{ensure_checkpoint_dir(spark)}/slot-map-{uuid.uuid4().hex}"
    save_map(initial_map(spark, n_shards, n_slots), totals, path)
    save_map(grown_map(load_map(spark, path, 1).select("version", "vslot", "shard"), n_shards), totals, path)
    grown = load_map(spark, path, 2).select("vslot", F.col("shard").alias("grown_shard"))
    owned = load_map(spark, path, 1).join(grown, "vslot").withColumn("rows", F.coalesce("rows", F.lit(0)))
    before = Window.partitionBy("shard").orderBy("vslot").rowsBetween(Window.unboundedPreceding, -1)
    owned = owned.select(
        "vslot", "shard", "grown_shard", F.col("version").alias("map_version"), F.col("bytes").alias("slot_bytes"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"), F.greatest(F.ceil(F.col("rows") / together), F.lit(1)).alias("parts"),
    )
    dealt = recs.join(F.broadcast(owned), "vslot")  # n_slots rows, a parameter
    mixed = F.xxhash64("doc_id", "text_crc32", "size") + F.col("turn")
    dealt = dealt.withColumn("part", F.when(F.col("parts") > 1, F.pmod(mixed, F.col("parts"))).otherwise(F.lit(0)).cast("long"))
    sizes = dealt.where(F.col("parts") > 1).groupBy("vslot", "part").agg(F.count("*").alias("n"))
    ahead = F.sum("n").over(Window.partitionBy("vslot").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    shifts = sizes.select(F.col("vslot").alias("_vslot"), F.col("part").alias("_part"), F.coalesce(ahead, F.lit(0)).alias("shift"))
    place = F.row_number().over(Window.partitionBy("vslot", "part").orderBy("doc_id", "text_crc32", "size"))
    placed = dealt.withColumn("place", place).join(shifts, (F.col("vslot") == F.col("_vslot")) & (F.col("part") == F.col("_part")), "left")
    slot = F.col("offset") + F.coalesce("shift", F.lit(0)) + F.col("place") - 1
    return placed.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", slot.cast("long").alias("slot"), "grown_shard", "vslot", "slot_bytes", "map_version")
