"""Incremental co-occurrence counts (an extension beyond batch models).

Streams of (target, feature, count, time) are summed as they come, in whole or in event-time
windows with a watermark for late rows; a written state table becomes a model at any time.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..model import TermModel, from_triplets


def running_counts(stream: DataFrame, target: str, feature: str, count: str | None = None) -> DataFrame:
    """(target, feature, f) over all rows so far; for output modes update and complete."""
    f = F.lit(1.0) if count is None else F.col(count).cast("double")
    keyed = stream.select(F.col(target).cast("string").alias("target"), F.col(feature).cast("string").alias("feature"), f.alias("f"))
    return keyed.where("target is not null and feature is not null").groupBy("target", "feature").agg(F.sum("f").alias("f"))


def windowed_counts(stream: DataFrame, target: str, feature: str, time: str, window: str = "1 hour", slide: str | None = None, late: str = "10 minutes", count: str | None = None) -> DataFrame:
    """(start, end, target, feature, f) in tumbling or sliding windows; rows later than ``late`` are left out."""
    f = F.lit(1.0) if count is None else F.col(count).cast("double")
    keyed = stream.withWatermark(time, late).select(
        F.col(time).alias("time"), F.col(target).cast("string").alias("target"), F.col(feature).cast("string").alias("feature"), f.alias("f")
    )
    span = F.window("time", window, slide) if slide else F.window("time", window)
    got = keyed.groupBy(span.alias("w"), "target", "feature").agg(F.sum("f").alias("f"))
    return got.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "target", "feature", "f")


def session_counts(stream: DataFrame, target: str, feature: str, time: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(start, end, target, feature, f) in sessions of each target that a gap ends."""
    keyed = stream.withWatermark(time, late).select(F.col(time).alias("time"), F.col(target).cast("string").alias("target"), F.col(feature).cast("string").alias("feature"))
    got = keyed.groupBy(F.session_window("time", gap).alias("w"), "target", "feature").agg(F.count("*").cast("double").alias("f"))
    return got.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "target", "feature", "f")


def keep_table(counts: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write every batch's changed counts under its number; :func:`model_of` reads the newest of each cell."""

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number:012d}")

    return counts.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def model_of(spark, path: str) -> TermModel:
    """The model of a table that :func:`keep_table` writes."""
    rows = spark.read.option("recursiveFileLookup", True).schema("target string, feature string, f double, batch long").parquet(path)
    return from_triplets(rows.groupBy("target", "feature").agg(F.max_by("f", "batch").alias("f")))
