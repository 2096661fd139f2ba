"""Fixed-count windows of a channel and their levels.

One aggregation over (track, channel, window) is the only step that sees samples. It combines before the shuffle, so what
is shuffled is one row per window and task: all later steps work on data some hundred thousand times smaller, and a
track that holds most samples is still spread over as many keys as it has windows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crestline.constants import WINDOW_SECONDS

CHANNEL = ["track_id", "channel"]


def window_frames(sample_rate: int) -> int:
    return math.floor(sample_rate * WINDOW_SECONDS)


def raw_windows(samples: DataFrame, frames: int) -> DataFrame:
    """n, sum_sq and peak of every window, short last ones included. NaN never raises a peak but makes the sum NaN."""
    x = F.col("sample").cast("double")
    return (
        samples.groupBy(*CHANNEL, F.expr(f"frame_idx div {frames}").alias("win"))
        .agg(F.count("*").alias("n"), F.sum(x * x).alias("sum_sq"), F.coalesce(F.max(F.when(~F.isnan(x), F.abs(x))), F.lit(0.0)).alias("peak"))
        .withColumn("rms", F.sqrt(2 * F.col("sum_sq") / F.col("n")))
    )


def complete(frames: int | Column, flush_tail: bool | Column) -> Column:
    """Which windows count: whole ones, and a last one of two frames or more where tails are flushed at all."""
    flush = F.lit(flush_tail) if isinstance(flush_tail, bool) else flush_tail
    return (F.col("n") == frames) | (flush & (F.col("n") > 1))


def windows(samples: DataFrame, sample_rate: int, flush_tail: bool | Column = True) -> DataFrame:
    """track_id, channel, win, n, sum_sq, peak, rms. Sources of three channels or more never flush their tails: pass
    flush_tail=False for those."""
    frames = window_frames(sample_rate)
    return raw_windows(samples, frames).where(complete(frames, flush_tail))


def below(threshold_db: float) -> Column:
    """Windows that the silence filter drops; one whose level is no number counts as silent."""
    return 20 * F.log10(F.greatest(F.nanvl(F.col("rms"), F.lit(0.0)), F.lit(1e-12))) < threshold_db


def silence_report(found: DataFrame, threshold_db: float) -> DataFrame:
    """Windows kept and dropped by the silence filter in each channel."""
    counts = found.groupBy(*CHANNEL).agg(F.count_if(~below(threshold_db)).alias("valid_windows"), F.count_if(below(threshold_db)).alias("filtered_windows"), F.count("*").alias("total_windows"))
    percent = F.when(F.col("total_windows") > 0, 100.0 * F.col("filtered_windows") / F.col("total_windows")).otherwise(F.lit(0.0))
    return counts.withColumn("filtered_percent", percent)
