"""Edge trimming: long silences at a track's start and end go.

As a state machine: while leading, every full `min_run` of silent frames is dropped; `hysteresis` sounding frames in all
end the lead. Later a silence starts a hold; `hysteresis` sounding frames in a row release it; a track that ends in a hold
whose last silence has `min_run` frames loses the whole hold. Here the same is told over maximal runs of equal frames, with
three running aggregates and no state. Runs are far fewer than frames; a task holds one track's runs, never its frames:
frames are numbered into runs block by block, and runs that meet at a border of blocks are joined afterwards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


#: Frames of a track that one task puts in order.
BLOCK = 1 << 16


def silent_runs(frames: DataFrame, threshold_db: float) -> DataFrame:
    """track_id, run, silent, first_frame, length from (track_id, frame_idx, amplitude)."""

    def numbered(rows: DataFrame, by: list[str], at: str) -> DataFrame:
        order = Window.partitionBy(*by).orderBy(at)
        changed = rows.withColumn("new", (F.coalesce(F.lag("silent").over(order), F.lit(-1)) != F.col("silent")).cast("int"))
        return changed.withColumn("run", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))

    flagged = frames.select("track_id", "frame_idx", F.floor(F.col("frame_idx") / BLOCK).alias("block"), (F.col("amplitude") < 10 ** (threshold_db / 20)).cast("int").alias("silent"))
    parts = numbered(flagged, ["track_id", "block"], "frame_idx").groupBy("track_id", "block", "run")
    parts = parts.agg(F.max("silent").alias("silent"), F.min("frame_idx").alias("first_frame"), F.count("*").alias("length"))
    whole = numbered(parts.drop("run"), ["track_id"], "first_frame").groupBy("track_id", "run")
    return whole.agg(F.max("silent").alias("silent"), F.min("first_frame").alias("first_frame"), F.sum("length").alias("length"))


def trimmed_runs(runs: DataFrame, min_run: int, hysteresis: int) -> DataFrame:
    """Adds drop_first (frames cut at the run's start) and drop_all to the runs."""
    order = Window.partitionBy("track_id").orderBy("run")
    upto, track = order.rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy("track_id")
    sounding = F.when(F.col("silent") == 0, F.col("length")).otherwise(0)
    out = runs.withColumn("heard", F.sum(sounding).over(upto))
    out = out.withColumn("lead_end", F.min(F.when(F.col("heard") >= hysteresis, F.col("run"))).over(track)).withColumn("last_run", F.max("run").over(track))
    stays = (F.col("silent") == 0) & (F.col("run") >= F.col("lead_end")) & ((F.col("run") == F.col("lead_end")) | (F.col("length") >= hysteresis))
    out = out.withColumn("held_from", F.max(F.when(stays, F.col("run"))).over(track))
    ends_silent = F.max(F.when((F.col("run") == F.col("last_run")) & (F.col("silent") == 1) & (F.col("length") >= min_run), 1).otherwise(0)).over(track)
    out = out.withColumn("ends_silent", ends_silent)
    leading = (F.col("silent") == 1) & (F.col("lead_end").isNull() | (F.col("run") < F.col("lead_end")))
    out = out.withColumn("drop_first", F.when(leading, F.expr(f"length div {min_run} * {min_run}")).otherwise(F.lit(0)).cast("long"))
    drop_all = F.coalesce(F.col("held_from").isNotNull() & (F.col("run") > F.col("held_from")) & (F.col("ends_silent") == 1), F.lit(False))
    return out.withColumn("drop_all", drop_all).select("track_id", "run", "silent", "first_frame", "length", "drop_first", "drop_all")


def trim_report(runs: DataFrame) -> DataFrame:
    """Frames dropped at the start and at the end of each track, of all it had."""
    dropped = F.when(F.col("drop_all"), F.col("length")).otherwise(0)
    return runs.groupBy("track_id").agg(
        F.sum("drop_first").alias("leading_frames"), F.sum(dropped).alias("trailing_frames"), F.sum("length").alias("total_frames")
    )


def trim_durations(report: DataFrame, sample_rate: int) -> DataFrame:
    """Adds the seconds cut at the start, at the end and in all to a trim_report."""
    out = report.withColumn("leading_seconds", F.col("leading_frames") / sample_rate).withColumn("trailing_seconds", F.col("trailing_frames") / sample_rate)
    return out.withColumn("trimmed_seconds", F.col("leading_seconds") + F.col("trailing_seconds"))


def trimmed(samples: DataFrame, runs: DataFrame) -> DataFrame:
    """Samples that stay, frames numbered anew without gaps. Kept runs next to each other are one stretch, so a track has
    one stretch more than it has cuts; samples meet the stretches of their own block of frames."""
    order = Window.partitionBy("track_id").orderBy("run")
    cuts = F.sum((F.col("drop_first") > 0).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    kept = runs.withColumn("stretch", cuts).where(~F.col("drop_all") & (F.col("drop_first") < F.col("length")))
    first = F.col("first_frame") + F.col("drop_first")
    kept = kept.groupBy(F.col("track_id").alias("run_track"), "stretch").agg(
        F.min(first).alias("from_frame"), F.max(F.col("first_frame") + F.col("length")).alias("to_frame")
    )
    before = Window.partitionBy("run_track").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    kept = kept.withColumn("start", F.coalesce(F.sum(F.col("to_frame") - F.col("from_frame")).over(before), F.lit(0)))
    block = lambda frame: F.floor(frame / BLOCK)
    kept = kept.withColumn("run_block", F.explode(F.sequence(block(F.col("from_frame")), block(F.col("to_frame") - 1))))
    same = (F.col("track_id") == F.col("run_track")) & (block(F.col("frame_idx")) == F.col("run_block"))
    joined = samples.join(kept, same & (F.col("frame_idx") >= F.col("from_frame")) & (F.col("frame_idx") < F.col("to_frame")))
    return joined.select("track_id", "channel", (F.col("frame_idx") - F.col("from_frame") + F.col("start")).alias("frame_idx"), "sample")
