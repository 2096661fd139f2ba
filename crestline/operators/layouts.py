"""Channel layouts: lookup of low-frequency channels by layout name and channel count.

The layout table has some twenty fixed rows, so it is broadcast; the joins are left equi-joins on (name, channels).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline.constants import LAYOUT_NAMES, LAYOUTS, RAW_EAC3
from crestline.operators.tracks import fallback_lfe


def channel_layouts(spark: SparkSession) -> DataFrame:
    """layout_name, channel_count, channel_order, lfe_indices of every known layout."""
    rows = [(name, len(order.split()), order.split(), list(lfe)) for name, order, lfe in LAYOUTS]
    return spark.createDataFrame(rows, "layout_name string, channel_count int, channel_order array<string>, lfe_indices array<int>")


def lookup_names(spark: SparkSession) -> DataFrame:
    lfe = {name: list(indices) for name, _, indices in LAYOUTS}
    rows = [(name, channels, lfe[layout]) for name, channels, layout in LAYOUT_NAMES]
    return spark.createDataFrame(rows, "known_name string, known_channels int, known_lfe array<int>")


def with_layout(tracks: DataFrame) -> DataFrame:
    """Adds lfe_indices and layout_match (raw, exact, fuzzy, fallback) to rows with layout, channels and container."""
    names = lookup_names(tracks.sparkSession)
    exact = F.lower(F.trim("layout"))
    bare = F.trim(F.regexp_replace(exact, r"\((side|wide|back)\)", ""))
    out = tracks.withColumn("exact_name", exact).withColumn("bare_name", F.when(bare != exact, bare))

    def joined(left: DataFrame, on: str, into: str) -> DataFrame:
        right = F.broadcast(names.withColumnRenamed("known_lfe", into))
        return left.join(right, (F.col(on) == F.col("known_name")) & (F.col("channels") == F.col("known_channels")), "left").drop("known_name", "known_channels")

    out = joined(joined(out, "exact_name", "exact_lfe"), "bare_name", "fuzzy_lfe")
    raw = F.lit(False)
    for name, channels in RAW_EAC3:
        raw = raw | ((F.col("exact_name") == name) & (F.col("channels") == channels))
    raw = F.coalesce(F.lower("container").isin("eac3", "ac3") & raw, F.lit(False))
    match = F.when(raw, "raw").when(F.col("exact_lfe").isNotNull(), "exact").when(F.col("fuzzy_lfe").isNotNull(), "fuzzy").otherwise("fallback")
    lfe = F.when(raw, F.array(F.lit(5))).otherwise(F.coalesce("exact_lfe", "fuzzy_lfe", fallback_lfe(F.col("channels"))))
    return out.withColumn("lfe_indices", lfe).withColumn("layout_match", match).drop("exact_name", "bare_name", "exact_lfe", "fuzzy_lfe")


def lfe_of_labels(tracks: DataFrame) -> DataFrame:
    """lfe_indices from a label list such as `FL+FR+FC+LFE+SL+SR`, where the column labels holds one."""
    labels = F.transform(F.split("labels", r"\+"), lambda x: F.upper(F.trim(x)))
    at = F.filter(F.transform(labels, lambda x, i: F.when(x.isin("LFE", "LFE2"), i)), lambda i: i.isNotNull())
    return tracks.withColumn("lfe_indices", at)


PROBE = "streams array<struct<sample_rate: string, channels: int, channel_layout: string, codec_name: string, duration: string>>, format struct<format_name: string, duration: string>"


def of_probe_json(probes: DataFrame) -> DataFrame:
    """Format columns from the JSON that an external probe prints (column probe): rate, channels, layout, codec, duration
    and container of the first stream; rates and durations come as text there."""
    p = F.from_json("probe", PROBE)
    stream = F.get(p["streams"], F.lit(0))
    seconds = F.coalesce(stream["duration"].try_cast("double"), p["format"]["duration"].try_cast("double"))
    rate = F.coalesce(stream["sample_rate"].try_cast("int"), F.lit(44100))
    out = probes.withColumn("sample_rate", rate).withColumn("channels", F.coalesce(stream["channels"], F.lit(2))).withColumn("layout", stream["channel_layout"])
    out = out.withColumn("codec", stream["codec_name"]).withColumn("container", p["format"]["format_name"])
    return out.withColumn("sample_count", F.coalesce(F.floor(seconds * F.col("sample_rate")).cast("long"), F.lit(0)))
