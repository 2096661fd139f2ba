"""From channels to tracks: which channels count, the official value and how sure it is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crestline.functions import levels


def fallback_lfe(channels: Column) -> Column:
    """Where low-frequency channels usually are, by channel count."""
    return F.when(channels == 3, F.array(F.lit(2))).when(channels.between(4, 32), F.array(F.lit(3))).otherwise(F.array().cast("array<int>"))


def effective_lfe(channels: Column, indices: Column, has_layout: Column) -> Column:
    """Indices within the channel count, else the usual ones; none without layout metadata."""
    own = F.filter(F.coalesce(indices, F.array().cast("array<int>")), lambda i: i < channels)
    return F.when(~F.coalesce(has_layout, F.lit(False)), F.array().cast("array<int>")).when(F.size(own) > 0, own).otherwise(fallback_lfe(channels))


def with_exclusions(channels: DataFrame, meta: DataFrame | None = None) -> DataFrame:
    """Adds is_silent and is_lfe to channel rows. meta: track_id, channels, lfe_indices, has_channel_layout_metadata;
    one row a track, an inner join on the track."""
    silent = levels.silent(F.col("rms"), F.col("peak"))
    if meta is None:
        return channels.withColumn("is_silent", silent).withColumn("is_lfe", F.lit(False))
    lfe = effective_lfe(F.col("channels"), F.col("lfe_indices"), F.col("has_channel_layout_metadata"))
    known = meta.select("track_id", lfe.alias("lfe"))
    return channels.join(known, "track_id").withColumn("is_silent", silent).withColumn("is_lfe", F.array_contains("lfe", F.col("channel"))).drop("lfe")


def _aggregates(exclude_lfe: bool, suffix: str = "") -> list[Column]:
    lfe = F.col("is_lfe") if exclude_lfe else F.lit(False)
    included = ~F.col("is_silent") & ~lfe
    # silence is counted first, so a silent low-frequency channel is no excluded one of that kind
    return [
        F.avg(F.when(included, F.col("dr_value"))).alias(f"precise_dr{suffix}"),
        F.count_if(~included).alias(f"excluded_channels{suffix}"),
        F.count_if(lfe & ~F.col("is_silent")).alias(f"excluded_lfe{suffix}"),
    ]


def track_dr(channels: DataFrame, exclude_lfe: bool = False) -> DataFrame:
    """official_dr, precise_dr, exclusions and the boundary risk of every track; null values if no channel counts."""
    out = channels.groupBy("track_id").agg(*_aggregates(exclude_lfe)).withColumn("official_dr", levels.rounded(F.col("precise_dr")))
    out = out.withColumn("risk", levels.boundary_risk(F.col("official_dr"), F.col("precise_dr")))
    return out.select("track_id", "official_dr", "precise_dr", "excluded_channels", "excluded_lfe", "risk.*")


def both_aggregates(channels: DataFrame) -> DataFrame:
    """With and without low-frequency channels, in one pass."""
    out = channels.groupBy("track_id").agg(*_aggregates(False, "_all"), *_aggregates(True, "_without_lfe"))
    for suffix in ("_all", "_without_lfe"):
        out = out.withColumn(f"official_dr{suffix}", levels.rounded(F.col(f"precise_dr{suffix}")))
    return out
