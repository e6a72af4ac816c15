"""Ground minima of clouds that arrive as files: an associative aggregate kept up to date by a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from timberline.operators.ground import neighbourhood_median, running_minimum


def stream_points(spark: SparkSession, folder: str, schema: str = "pid long, x double, y double, z double", files_per_batch: int = 100) -> DataFrame:
    """New Parquet files of a folder as a stream of points."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def keep_minima(points: DataFrame, table: str, checkpoint: str, size: float = 2.0) -> StreamingQuery:
    """Append each batch's minima to ``table``; :func:`minima` combines them, so a batch that is written twice changes nothing."""

    def add(batch: DataFrame, number: int) -> None:
        running_minimum(batch, size).withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(table)

    return points.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def minima(spark: SparkSession, table: str) -> DataFrame:
    """(ix, iy, zmin) of everything seen."""
    return spark.read.parquet(table).groupBy("ix", "iy").agg(F.min("zmin").alias("zmin"))


def current_ground(spark: SparkSession, table: str, reach: int = 3, tolerance: float = 1.0) -> DataFrame:
    """(ix, iy, gz): minima repaired by the neighbourhood median, computed anew from the kept minima."""
    return neighbourhood_median(minima(spark, table), reach).select("ix", "iy", F.when(F.abs(F.col("zmin") - F.col("med")) < tolerance, F.col("zmin")).otherwise(F.col("med")).alias("gz"))
