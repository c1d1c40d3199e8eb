"""Incremental ingestion of raster tiles: class counts that follow new pixels as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def tile_counts_stream(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str) -> StreamingQuery:
    """Read Parquet tiles (tile, y, x, v) as they are added and append their class counts, one folder per micro-batch.

    A batch that is run again overwrites its own folder, so counts are never doubled. ``totals`` sums the folders.
    """
    tiles = spark.readStream.schema(schema).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        counts = batch.groupBy("tile", "v").agg(F.count(F.lit(1)).alias("n"))
        counts.write.mode("overwrite").parquet(f"{target}/batch={number}")

    return tiles.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def totals(spark: SparkSession, target: str) -> DataFrame:
    """(v, n) over all batches so far."""
    return spark.read.parquet(target).groupBy("v").agg(F.sum("n").alias("n"))
