"""Packets: order, failures, chunk statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crestline.constants import MAX_DECODE_ERRORS


def reordered(packets: DataFrame) -> DataFrame:
    """Packets that an ordered consumer starting at 0 would see: those before the first missing number. Adds position."""
    order = Window.partitionBy("track_id").orderBy("seq")
    return packets.dropDuplicates(["track_id", "seq"]).withColumn("position", F.row_number().over(order) - 1).where("seq = position")


def decode_failures(packets: DataFrame) -> DataFrame:
    """Failed packets (no samples) of each track, the longest row of them, and whether that fails the track."""
    order = Window.partitionBy("track_id").orderBy("seq")
    failed = (F.coalesce(F.size("samples"), F.lit(0)) <= 0).cast("int")
    marked = packets.select("track_id", "seq", failed.alias("failed"))
    grouped = marked.withColumn("good_before", F.sum(1 - F.col("failed")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    in_row = grouped.groupBy("track_id", "good_before").agg(F.sum("failed").alias("in_row"), F.count("*").alias("n"))
    out = in_row.groupBy("track_id").agg(F.sum("n").alias("packets"), F.sum("in_row").alias("skipped_packets"), F.max("in_row").alias("longest_failure"))
    return out.withColumn("track_fails", F.col("longest_failure") > MAX_DECODE_ERRORS)


def chunk_stats(chunks: DataFrame, by: list[str], size: str = "n_frames") -> DataFrame:
    """Count, total, least, largest and mean chunk size; zeros rather than nulls for groups without sizes."""
    out = chunks.groupBy(*by).agg(F.count(size).alias("chunks"), F.sum(size).alias("total"), F.min(size).alias("least"), F.max(size).alias("largest"), F.avg(size).alias("mean"))
    return out.fillna(0, ["total", "least", "largest"]).fillna(0.0, ["mean"])


def chunk_distribution(chunks: DataFrame, by: list[str], size: str = "n_frames") -> DataFrame:
    """How often each chunk size occurs, its percentage, and whether it is the commonest (ties: the smallest)."""
    counts = chunks.groupBy(*by, F.col(size).alias("size")).agg(F.count("*").alias("chunks"))
    group = Window.partitionBy(*by)
    place = F.row_number().over(group.orderBy(F.desc("chunks"), "size"))
    return counts.withColumn("percent", 100.0 * F.col("chunks") / F.sum("chunks").over(group)).withColumn("is_mode", place == 1)


def partial_tracks(meta: DataFrame) -> DataFrame:
    """Adds is_partial: fewer frames than the header promised, or packets skipped (where skipped_packets is known). After
    trimming, what is left is what was promised."""
    promised = F.when(F.col("trimmed"), F.col("actual_frames")).otherwise(F.col("expected_frames"))
    skipped = F.coalesce(F.col("skipped_packets") > 0, F.lit(False)) if "skipped_packets" in meta.columns else F.lit(False)
    return meta.withColumn("is_partial", (F.col("actual_frames") < promised) | skipped)
