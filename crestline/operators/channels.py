"""From windows to the levels and the dynamic range of each channel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crestline.constants import BINS
from crestline.functions import levels
from crestline.operators.windows import CHANNEL, below, complete, raw_windows, window_frames

#: Frames whose samples one list holds while the largest two are taken.
BLOCK = 4096


def _finite() -> Column:
    return ~F.isnan("rms") & (F.col("rms") >= 0) & (F.col("rms") < float("inf"))


def _bin() -> Column:
    return F.floor(F.least(F.lit(float(BINS)), BINS * F.col("rms"))).cast("long")


def histogram(found: DataFrame) -> DataFrame:
    """track_id, channel, bin, cnt: windows by their level, at most BINS + 1 rows a channel. Levels that are no finite
    number count in no bin, levels above 1 in the last."""
    return found.where(_finite()).groupBy(*CHANNEL, _bin().alias("bin")).agg(F.count("*").alias("cnt"))


def _taken(bins: DataFrame) -> DataFrame:
    """Adds total, k and take: of the loudest fifth (k windows, one at least) so many are in this bin."""
    channel = Window.partitionBy(*CHANNEL)
    upto = channel.orderBy(F.desc_nulls_last("bin")).rowsBetween(Window.unboundedPreceding, 0)
    counted = bins.withColumn("seen", F.sum("cnt").over(upto)).withColumn("total", F.sum("cnt").over(channel))
    k = F.greatest(F.lit(1).cast("long"), F.expr("total div 5"))
    take = F.greatest(F.lit(0).cast("long"), F.least(F.col("cnt"), k - (F.col("seen") - F.col("cnt"))))
    return counted.withColumn("k", k).withColumn("take", take)


def loudest_fifth(bins: DataFrame) -> DataFrame:
    """rms of the loudest fifth from the histogram: bins from the top, as many windows as are left. The sum is of integers,
    hence exact."""
    total = F.sum(F.col("take") * F.col("bin") * F.col("bin"))
    return _taken(bins).groupBy(*CHANNEL).agg(F.max("total").alias("windows"), F.max("k").alias("k"), F.sqrt(total * 1e-8 / F.max("k")).alias("rms"))


def loudest_fifth_exact(found: DataFrame) -> DataFrame:
    """The same without bins; for diagnosis."""
    ranked = Window.partitionBy(*CHANNEL).orderBy(F.desc("rms"), "win")
    counted = found.where(_finite()).withColumn("windows", F.count("*").over(Window.partitionBy(*CHANNEL)))
    top = counted.withColumn("place", F.row_number().over(ranked)).where(F.col("place") <= F.greatest(F.lit(1), F.expr("windows div 5")))
    return top.groupBy(*CHANNEL).agg(F.max("windows").alias("windows"), F.count("*").alias("k"), F.sqrt(F.avg(F.col("rms") * F.col("rms"))).alias("rms"))


def top_peaks(found: DataFrame) -> DataFrame:
    """The largest and second-largest window peak (equal peaks count separately; of a single window, the same twice)."""
    ranked = Window.partitionBy(*CHANNEL).orderBy(F.desc("peak"), "win")
    two = found.withColumn("place", F.row_number().over(ranked)).where("place <= 2")
    both = two.groupBy(*CHANNEL).agg(F.max(F.when(F.col("place") == 1, F.col("peak"))).alias("primary_peak"), F.max(F.when(F.col("place") == 2, F.col("peak"))).alias("secondary_peak"))
    return both.withColumn("secondary_peak", F.coalesce("secondary_peak", "primary_peak"))


def channel_dr(
    samples: DataFrame,
    sample_rate: int,
    flush_tail: bool = True,
    silence_db: float | None = None,
    rule: levels.PeakRule = levels.prefer_secondary,
    floor: float = 0.0,
) -> DataFrame:
    """track_id, channel, dr_value, rms, peak, primary_peak, secondary_peak, sample_count of every channel. A channel
    without any window that counts has level, peak and range 0."""
    frames = window_frames(sample_rate)
    counts = complete(frames, flush_tail)
    if silence_db is not None:
        counts = counts & ~below(silence_db)
    return from_windows(raw_windows(samples, frames), counts, rule, floor)


def from_windows(raw: DataFrame, counts: Column, rule: levels.PeakRule = levels.prefer_secondary, floor: float = 0.0) -> DataFrame:
    """channel_dr() from raw windows and the condition under which one counts.

    One chain: after the windows are dealt by channel, ranks of peaks, the histogram and its running sums all stay in
    their partition, so samples are read once and windows are shuffled once.
    """
    channel = Window.partitionBy(*CHANNEL)
    placed = raw.withColumn("counts", F.coalesce(counts, F.lit(False)))
    placed = placed.withColumn("place", F.row_number().over(channel.orderBy(F.desc("counts"), F.desc("peak"), "win")))
    level = F.when(F.col("counts") & _finite(), _bin())
    peak = lambda k: F.max(F.when(F.col("counts") & (F.col("place") == k), F.col("peak")))
    bins = placed.groupBy(*CHANNEL, level.alias("bin")).agg(F.count("*").alias("windows"), F.sum("n").alias("frames"), peak(1).alias("first"), peak(2).alias("second"))
    bins = bins.withColumn("cnt", F.when(F.col("bin").isNotNull(), F.col("windows")).otherwise(F.lit(0)).cast("long"))
    taken = _taken(bins).groupBy(*CHANNEL).agg(
        F.sum("frames").alias("sample_count"),
        F.max("first").alias("primary_peak"),
        F.max("second").alias("secondary_peak"),
        F.coalesce(F.sqrt(F.sum(F.col("take") * F.col("bin") * F.col("bin")) * 1e-8 / F.max("k")), F.lit(0.0)).alias("rms"),
    )
    out = taken.withColumn("primary_peak", F.coalesce("primary_peak", F.lit(0.0))).withColumn("secondary_peak", F.coalesce("secondary_peak", "primary_peak"))
    out = out.withColumn("peak", rule(F.col("primary_peak"), F.col("secondary_peak")))
    out = out.withColumn("dr_value", levels.dynamic_range(F.col("rms"), F.col("peak"), floor))
    return out.select(*CHANNEL, "dr_value", "rms", "peak", "primary_peak", "secondary_peak", "sample_count")


def accumulate(samples: DataFrame) -> DataFrame:
    """Whole channels without windows: sum of squares, level without the factor 2, and the two largest samples."""
    x = F.abs(F.col("sample").cast("double"))
    # the two largest of each block of frames, then of the blocks: samples are read once and never sorted as a channel
    block = F.floor(F.col("frame_idx") / BLOCK)
    top = F.sort_array(F.collect_list(x), asc=False)
    blocks = samples.groupBy(*CHANNEL, block.alias("block")).agg(F.count("*").alias("n"), F.sum(x * x).alias("sum_sq"), F.slice(top, 1, 2).alias("top"))
    blocks = blocks.select(*CHANNEL, "n", "sum_sq", F.get("top", F.lit(0)).alias("first"), F.get("top", F.lit(1)).alias("second"))
    placed = blocks.withColumn("place", F.row_number().over(Window.partitionBy(*CHANNEL).orderBy(F.desc("first"))))
    second = F.greatest(F.max(F.when(F.col("place") == 2, F.col("first"))), F.max("second"))
    out = placed.groupBy(*CHANNEL).agg(
        F.sum("n").alias("n"), F.sum("sum_sq").alias("sum_sq"), F.max("first").alias("primary_peak"), F.coalesce(second, F.lit(0.0)).alias("secondary_peak")
    ).withColumn("rms", F.sqrt(F.col("sum_sq") / F.col("n")))
    return out.withColumn("peak", levels.prefer_secondary(F.col("primary_peak"), F.col("secondary_peak")))


def deinterleave(packets: DataFrame, channels: int) -> DataFrame:
    """Interleaved samples (track_id, seq, samples) as rows; a ragged last frame keeps the channels it has."""
    before = Window.partitionBy("track_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = packets.withColumn("start", F.coalesce(F.sum(F.size("samples").cast("long")).over(before), F.lit(0)))
    at = F.col("start") + F.col("pos")
    flat = placed.select("track_id", "start", F.posexplode("samples").alias("pos", "x"))
    return flat.select("track_id", (at % channels).cast("int").alias("channel"), F.expr(f"(start + pos) div {channels}").alias("frame_idx"), F.col("x").cast("double").alias("sample"))


def frame_amplitude(samples: DataFrame) -> DataFrame:
    """track_id, frame_idx, amplitude: the largest level of a frame over its channels."""
    return samples.groupBy("track_id", "frame_idx").agg(F.max(F.abs(F.col("sample").cast("double"))).alias("amplitude"))


def per_channel(samples: DataFrame, function, schema: str) -> DataFrame:  # noqa: ANN001
    """Any function from a channel's samples (pandas, in frame order) to rows, for what the operators here do not offer.
    A channel is one task's memory: prefer the operators above for long tracks."""

    def ordered(pdf):  # noqa: ANN001, ANN202
        return function(pdf.sort_values("frame_idx"))

    return samples.groupBy(*CHANNEL).applyInPandas(ordered, schema)
