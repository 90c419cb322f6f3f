"""E(d) over a stream of pixel files: sums by distance are associative, so each micro-batch adds to them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PIXELS = "replicate string, chrom string, bin1 long, bin2 long, cnt double"


def pixel_stream(spark: SparkSession, path: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(PIXELS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def distance_sums(pixels: DataFrame, most: int = 128) -> DataFrame:
    """Running (replicate, chrom, d, total, pixels); state has one row for each distance."""
    d = F.abs(F.col("bin2") - F.col("bin1")).cast("int")
    return pixels.withColumn("d", d).where(F.col("d") < most).groupBy("replicate", "chrom", "d").agg(F.sum("cnt").alias("total"), F.count("*").alias("pixels"))


def run_to_table(pixels: DataFrame, name: str, checkpoint: str):
    """The sums as an in-memory table of the session, over all files there are now."""
    return distance_sums(pixels).writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
