"""Exports of analysed tracks: Markdown and JSON with channel tags, and the block on a track's format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crestline.constants import REPORT_SILENT
from crestline.functions import describe, levels


def channel_status(channels: DataFrame, exclude_lfe: bool = False) -> DataFrame:
    """Adds status (silent before lfe before normal), excluded and label to channel rows with is_lfe."""
    silent = levels.silent(F.col("rms"), F.col("peak"), REPORT_SILENT)
    excluded = silent | (F.col("is_lfe") & exclude_lfe)
    tags = F.concat_ws(", ", F.when(F.col("is_lfe"), "LFE"), F.when(silent, "Silent"), F.when(excluded, "excluded"))
    label = F.concat(F.format_string("CH %d", F.col("channel") + 1), F.when(tags != "", F.concat(F.lit(" ["), tags, F.lit("]"))).otherwise(""))
    status = F.when(silent, "silent").when(F.col("is_lfe"), "lfe").otherwise("normal")
    return channels.withColumn("status", status).withColumn("excluded", excluded).withColumn("label", label)


def _risk_line() -> Column:
    line = F.format_string("*%s risk near the %s boundary, %.2f dB*", "risk_level", F.lower("direction"), "distance_db")
    return F.when(F.col("risk_level").isNotNull(), line)


def markdown_exports(channels: DataFrame, tracks: DataFrame, exclude_lfe: bool = False, hide_path: bool = False) -> DataFrame:
    """track_id, report: one Markdown section per track; silent channels have dashes for values."""
    marked = channel_status(channels, exclude_lfe)
    quiet = F.col("status") == "silent"
    values = F.when(quiet, "- | -").otherwise(F.format_string("DR%d | %.2f", levels.rounded(F.col("dr_value")), "dr_value"))
    row = F.concat(F.lit("| "), F.col("label"), F.lit(" | "), values, F.lit(" |"))
    tables = marked.groupBy("track_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("channel", row.alias("row")))), lambda r: r["row"]).alias("rows"))
    name = describe.file_name(F.col("track_id"))
    title = F.concat(F.lit("## "), F.when(F.col("risk_level").isNotNull(), F.concat(F.lit("*"), name, F.lit("*"))).otherwise(name), F.lit("\n"))
    path = F.lit(None).cast("string") if hide_path else F.concat(F.lit("**Path**: "), F.col("track_id"), F.lit("\n"))
    mode = " (excl. LFE)" if exclude_lfe else ""
    official = F.when(F.col("official_dr").isNotNull(), F.format_string(f"\n**Official DR%d{mode}** · Precise %.2f dB", "official_dr", "precise_dr"))
    head = F.array(F.lit("| Channel | Official | Precise |"), F.lit("| --- | --- | --- |"))
    body = F.concat_ws("\n", title, path, head, F.col("rows"), official, F.when(_risk_line().isNotNull(), F.concat(F.lit("\n"), _risk_line())))
    return tables.join(tracks, "track_id").select("track_id", body.alias("report"))


def json_exports(channels: DataFrame, tracks: DataFrame, failures: DataFrame | None = None, exclude_lfe: bool = False) -> DataFrame:
    """track_id, report: one JSON object per track with channel states; failed files (track_id, error) have their error."""
    channel = F.struct((F.col("channel") + 1).alias("channel"), levels.rounded(F.col("dr_value")).alias("drRounded"), F.round("dr_value", 6).alias("drPrecise"), "status", "excluded")
    listed = channel_status(channels, exclude_lfe).groupBy("track_id").agg(F.array_sort(F.collect_list(channel)).alias("channels"))
    risk = F.when(F.col("risk_level").isNotNull(), F.struct(F.col("risk_level").alias("level"), "direction", F.round("distance_db", 6).alias("distanceDb")))
    whole = F.struct(
        describe.file_name(F.col("track_id")).alias("file"), F.col("track_id").alias("path"), F.lit(exclude_lfe).alias("excludeLfe"), F.col("official_dr").alias("officialDr"),
        F.round("precise_dr", 6).alias("preciseDr"), risk.alias("boundaryWarning"), F.col("channels"),
    )
    out = listed.join(tracks, "track_id").select("track_id", F.to_json(whole, {"ignoreNullFields": "false"}).alias("report"))
    if failures is None:
        return out
    failed = F.to_json(F.struct(describe.file_name(F.col("track_id")).alias("file"), F.col("track_id").alias("path"), "error"))
    return out.unionByName(failures.select("track_id", failed.alias("report")))


def format_info(tracks: DataFrame) -> DataFrame:
    """rate_text, bits_text, bitrate_text of tracks with the columns of a format; one-bit sources show their native rate."""
    tier = F.coalesce(F.concat(F.lit("DSD"), F.col("dsd_multiple_of_44k").cast("string")), F.lit("DSD"))
    source = F.when(F.col("dsd_native_rate_hz").isNotNull(), F.format_string("%d Hz (%s)", "dsd_native_rate_hz", tier)).otherwise(F.format_string("%d Hz", "sample_rate"))
    moved = F.col("processed_sample_rate").isNotNull() & (F.col("processed_sample_rate") != F.col("sample_rate"))
    rate = F.when(moved, F.concat(source, F.format_string(" -> %d Hz", "processed_sample_rate"))).otherwise(source)
    bits = F.when(F.col("dsd_native_rate_hz").isNotNull(), F.lit("1 (processed as 32-bit float)")).otherwise(F.col("bits_per_sample").cast("string"))
    kbps = describe.bitrate_kbps(F.col("codec"), F.col("bytes"), F.col("sample_count"), F.col("sample_rate"), F.col("channels"), F.col("bits_per_sample"), F.col("dsd_native_rate_hz").isNotNull(), F.col("is_partial"))
    text = F.coalesce(F.concat(kbps.cast("string"), F.lit(" kbps")), F.lit("N/A"))
    return tracks.withColumn("rate_text", rate).withColumn("bits_text", bits).withColumn("bitrate_text", text)
