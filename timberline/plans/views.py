"""Frames derived from the generic tables, on which queries run: a cloud, labelled trees, boxes, circles and codes.

Each view has the same integer arithmetic in :data:`SQL`, so both engines get
the same numbers bit by bit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SQL = {
    "cloud": """SELECT event_id AS pid, (event_id*7919 % 5987)/100.0 AS x, (event_id*3571 % 6007)/100.0 AS y, value/10.0 AS z,
        (event_id*31 % 50000)/50000.0 AS intensity, (event_id*7 % 256)/255.0 AS red, (event_id*13 % 256)/255.0 AS green, (event_id*29 % 256)/255.0 AS blue, event_id % 4 AS class_id FROM events""",
    "labelled": """SELECT *, CASE WHEN pid % 10 = 0 THEN 0 ELSE CAST(floor(x/10)*7 + floor(y/10) + 1 AS INT) END AS tree_id FROM cloud""",
    "boxes": """SELECT s_suppkey AS bid, (s_suppkey*13 % 60) - (4 + s_suppkey % 3)/2.0 AS ymin, (s_suppkey*7 % 60) - (4 + s_suppkey % 5)/2.0 AS xmin,
        (s_suppkey*13 % 60) + (4 + s_suppkey % 3)/2.0 AS ymax, (s_suppkey*7 % 60) + (4 + s_suppkey % 5)/2.0 AS xmax, CAST(s_suppkey % 3 AS INT) AS class_id, (s_suppkey*37 % 100)/100.0 AS score FROM supplier""",
    "circles": """SELECT p_partkey AS cid, (p_partkey % 5)*3.0 + (p_partkey*7 % 9)/100.0 AS x, (p_partkey // 5 % 4)*3.0 + (p_partkey*11 % 9)/100.0 AS y, 0.2 + (p_partkey*3 % 7)/200.0 AS r,
        (p_partkey // 20 % 40)/5.0 AS z, 50 + p_partkey*13 % 100 AS n FROM part""",
    "codes": """SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS code, (vec_id*37 % 100)/100.0 AS prob, CAST(label AS INT) AS label FROM embeddings""",
}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    return _table(spark, sf_dir, "events").select(
        e.alias("pid"), (e * 7919 % 5987 / F.lit(100.0)).alias("x"), (e * 3571 % 6007 / F.lit(100.0)).alias("y"), (F.col("value") / F.lit(10.0)).alias("z"),
        (e * 31 % 50000 / F.lit(50000.0)).alias("intensity"), (e * 7 % 256 / F.lit(255.0)).alias("red"), (e * 13 % 256 / F.lit(255.0)).alias("green"), (e * 29 % 256 / F.lit(255.0)).alias("blue"), (e % 4).alias("class_id"),
    )


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = F.when(F.col("pid") % 10 == 0, 0).otherwise((F.floor(F.col("x") / 10) * 7 + F.floor(F.col("y") / 10) + 1).cast("int"))
    return cloud(spark, sf_dir).withColumn("tree_id", tree)


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    y, x, h, w = s * 13 % 60, s * 7 % 60, (4 + s % 3) / F.lit(2.0), (4 + s % 5) / F.lit(2.0)
    return _table(spark, sf_dir, "supplier").select(s.alias("bid"), (y - h).alias("ymin"), (x - w).alias("xmin"), (y + h).alias("ymax"), (x + w).alias("xmax"), (s % 3).cast("int").alias("class_id"), (s * 37 % 100 / F.lit(100.0)).alias("score"))


def circles(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_partkey")
    return _table(spark, sf_dir, "part").select(
        p.alias("cid"), (p % 5 * F.lit(3.0) + p * 7 % 9 / F.lit(100.0)).alias("x"), (F.floor(p / 5) % 4 * F.lit(3.0) + p * 11 % 9 / F.lit(100.0)).alias("y"), (F.lit(0.2) + p * 3 % 7 / F.lit(200.0)).alias("r"),
        (F.floor(p / 20) % 40 / F.lit(5.0)).alias("z"), (50 + p * 13 % 100).alias("n"),
    )


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.col("vec_id")
    return _table(spark, sf_dir, "embeddings").select(v.alias("id"), F.col("embedding").cast("array<double>").alias("code"), (v * 37 % 100 / F.lit(100.0)).alias("prob"), F.col("label").cast("int").alias("label"))
