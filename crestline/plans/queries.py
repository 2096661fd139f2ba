"""Queries over the test tables, one per operator family, and the same in DuckDB's SQL.

Sums of doubles depend on their order in the last bits, so measured values are rounded to six decimals on both sides.
"""

from __future__ import annotations

import struct
from collections.abc import Callable
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline.functions import describe, levels, pcm
from crestline.operators import batches, channels, export, layouts, packets, report, tracks, trim, windows
from crestline.schema import format_error
from crestline.sources import adapters, alac, dsd, files, flac, mp4, ogg, ranges, sink
from crestline.storage import fresh, written
from crestline.streaming import audio, signals

RATE = adapters.SAMPLE_RATE
FRAMES = windows.window_frames(RATE)
STREAM_TRIM_DB = -20.0
SILENCE_DB, TRIM_DB, MIN_RUN, HYSTERESIS = 1.3, -0.54, 2, 3
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a query under its function's name, with its SQL."""

    def register(function: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[function.__name__] = function
        if sql:
            ORACLES[function.__name__] = sql
        return function

    return register


def rounded(*names: str) -> list[Column]:
    return [(F.round(n, 6) + 0.0).alias(n) for n in names]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- SQL of the common steps ----------------------------------------------------------------------------------------

EMBEDDINGS = """s AS (SELECT label::VARCHAR AS track_id, (vec_id % 2)::INT AS channel,
    row_number() OVER (PARTITION BY label, vec_id % 2 ORDER BY vec_id, pos) - 1 AS frame_idx, x::DOUBLE AS sample
    FROM (SELECT label, vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings))"""
EVENTS = """s AS (SELECT event_type AS track_id, (user_id % 2)::INT AS channel,
    row_number() OVER (PARTITION BY event_type, user_id % 2 ORDER BY ts, event_id) - 1 AS frame_idx, (value - 250) / 250 AS sample FROM events)"""
LINEITEM = """s AS (SELECT l_returnflag AS track_id, (l_linenumber - 1)::INT AS channel,
    row_number() OVER (PARTITION BY l_returnflag, l_linenumber ORDER BY l_orderkey, l_partkey, l_suppkey, l_shipdate) - 1 AS frame_idx,
    l_discount * CASE WHEN l_partkey % 2 = 1 THEN -1 ELSE 1 END AS sample FROM lineitem)"""


def _windows(samples: str, tail: bool = True, silence: bool = False) -> str:
    quiet = f"WHERE NOT 20 * log10(greatest(rms, 1e-12)) < {SILENCE_DB}" if silence else ""
    return f"""WITH {samples},
    raw AS (SELECT track_id, channel, frame_idx // {FRAMES} AS win, count(*) AS n, sum(sample * sample) AS sum_sq, max(abs(sample)) AS peak FROM s GROUP BY ALL),
    whole AS (SELECT *, sqrt(2 * sum_sq / n) AS rms FROM raw WHERE n = {FRAMES} OR ({tail} AND n > 1)),
    w AS (SELECT * FROM whole {quiet}),
    bins AS (SELECT track_id, channel, trunc(least(10000, 10000 * rms))::BIGINT AS bin, count(*) AS cnt FROM w GROUP BY ALL),
    ranked AS (SELECT *, sum(cnt) OVER (PARTITION BY track_id, channel) AS total, sum(cnt) OVER (PARTITION BY track_id, channel ORDER BY bin DESC) AS seen FROM bins),
    fifth AS (SELECT track_id, channel, max(total)::BIGINT AS windows, max(greatest(1, total // 5))::BIGINT AS k,
        sqrt(sum(greatest(0, least(cnt, greatest(1, total // 5) - (seen - cnt))) * bin * bin) * 1e-8 / max(greatest(1, total // 5))) AS rms FROM ranked GROUP BY ALL),
    peaks AS (SELECT track_id, channel, max(peak) AS primary_peak, coalesce(min(peak) FILTER (place = 2), max(peak)) AS secondary_peak
        FROM (SELECT *, row_number() OVER (PARTITION BY track_id, channel ORDER BY peak DESC, win) AS place FROM w) WHERE place <= 2 GROUP BY ALL),
    counts AS (SELECT track_id, channel, count(*) AS sample_count FROM s GROUP BY ALL),
    dr0 AS (SELECT c.track_id, c.channel, coalesce(f.rms, 0) AS rms, coalesce(p.primary_peak, 0) AS primary_peak, coalesce(p.secondary_peak, 0) AS secondary_peak, sample_count
        FROM counts c LEFT JOIN fifth f USING (track_id, channel) LEFT JOIN peaks p USING (track_id, channel)),
    dr1 AS (SELECT *, CASE WHEN secondary_peak > 0 THEN secondary_peak ELSE primary_peak END AS peak FROM dr0),
    dr AS (SELECT *, CASE WHEN rms > 0 AND peak > 0 THEN -20 * log10(rms / peak) ELSE 0 END AS dr_value FROM dr1)"""


def _risk(official: str, precise: str) -> str:
    """level (2, 1, null), upper and distance of the nearer risk, as columns of a select."""
    up, low = f"({official} + 0.5 - {precise})", f"({precise} - ({official} - 0.5))"
    level = lambda d: f"(CASE WHEN {d} < 0 THEN NULL WHEN {d} <= 0.031 THEN 2 WHEN {d} <= 0.051 THEN 1 END)"
    upper = f"(coalesce({level(up)}, 0) > coalesce({level(low)}, 0) OR (coalesce({level(up)}, 0) = coalesce({level(low)}, 0) AND {up} <= {low}))"
    some = f"({level(up)} IS NOT NULL OR {level(low)} IS NOT NULL)"
    return f"""CASE WHEN {some} THEN CASE greatest(coalesce({level(up)}, 0), coalesce({level(low)}, 0)) WHEN 2 THEN 'High' ELSE 'Medium' END END AS risk_level,
        CASE WHEN {some} THEN CASE WHEN {upper} THEN 'Upper' ELSE 'Lower' END END AS direction,
        CASE WHEN {some} THEN CASE WHEN {upper} THEN {up} ELSE {low} END END AS distance_db"""


def _tracks(exclude_lfe: bool) -> str:
    lfe = "channel = 3" if exclude_lfe else "false"
    return f"""t0 AS (SELECT track_id, avg(dr_value) FILTER (NOT (peak <= 1e-12 OR rms <= 1e-12) AND NOT {lfe}) AS precise_dr,
        count(*) FILTER (peak <= 1e-12 OR rms <= 1e-12 OR {lfe}) AS excluded_channels,
        count(*) FILTER (NOT (peak <= 1e-12 OR rms <= 1e-12) AND {lfe}) AS excluded_lfe FROM dr GROUP BY track_id),
    t1 AS (SELECT *, round(precise_dr)::INT AS official_dr FROM t0),
    t AS (SELECT track_id, official_dr, precise_dr, excluded_channels, excluded_lfe, {_risk("official_dr", "precise_dr")} FROM t1)"""


_WARNING = """(CASE WHEN risk_level IS NOT NULL THEN printf('%s risk: %.2f dB lies %.2f dB from a boundary, may round to DR%d instead of DR%d', risk_level, precise_dr, distance_db,
    CASE direction WHEN 'Upper' THEN official_dr + 1 ELSE greatest(official_dr - 1, 0) END, official_dr) END)"""
TRACK_COLUMNS = "track_id, official_dr, round(precise_dr, 6) + 0.0 AS precise_dr, excluded_channels, excluded_lfe, risk_level, direction, round(distance_db, 6) + 0.0 AS distance_db"
_R = "round({0}, 6) + 0.0 AS {0}".format


def _meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven-channel tracks of line items, with their low-frequency channel listed."""
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("track_id")).distinct()
    return rows.select("track_id", F.lit(7).alias("channels"), F.array(F.lit(3)).alias("lfe_indices"), F.lit(True).alias("has_channel_layout_metadata"))


_CODECS = ["FLAC", "WAV/PCM", "MP3", "AAC", "Unknown"]
_TRACKS_SQL = f"""WITH k AS (SELECT o_orderkey, {_CODECS}[o_orderkey % 5 + 1] AS codec, (o_totalprice * 100)::BIGINT AS bytes, o_orderkey * 1013 % 90000000 AS frames, [44100, 48000, 96000][o_orderkey % 3 + 1] AS rate,
    o_orderkey % 7 + 1 AS channels, [16, 24, 32][o_orderkey % 3 + 1] AS bits, o_orderkey % 11 = 0 AS dsd, o_orderkey % 13 = 0 AS partial FROM orders)"""


def _track_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    pick = lambda values, n: F.get(F.array(*map(F.lit, values)), (key % n).cast("int"))
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", pick(_CODECS, 5).alias("codec"), F.round(F.col("o_totalprice") * 100).cast("long").alias("bytes"), (key * 1013 % 90_000_000).alias("frames"), pick([44100, 48000, 96000], 3).alias("rate"),
        (key % 7 + 1).alias("channels"), pick([16, 24, 32], 3).alias("bits"), (key % 11 == 0).alias("dsd"), (key % 13 == 0).alias("partial"),
    )


# ---- windows and channels -------------------------------------------------------------------------------------------


@query(f"{_windows(EMBEDDINGS)} SELECT track_id, channel, win, n, {_R('rms')}, {_R('peak')} FROM w")
def window_rms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = windows.windows(adapters.samples_of_embeddings(spark, sf_dir), RATE)
    return found.select("track_id", "channel", "win", "n", *rounded("rms", "peak"))


@query(f"{_windows(EMBEDDINGS)} SELECT * FROM bins")
def rms_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return channels.histogram(windows.windows(adapters.samples_of_embeddings(spark, sf_dir), RATE))


@query(f"{_windows(EMBEDDINGS)} SELECT track_id, channel, windows, k, {_R('rms')} FROM fifth")
def top20_rms_quantized(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = channels.histogram(windows.windows(adapters.samples_of_embeddings(spark, sf_dir), RATE))
    return channels.loudest_fifth(bins).select("track_id", "channel", "windows", "k", *rounded("rms"))


@query(f"""{_windows(EMBEDDINGS)} SELECT track_id, channel, max(total) AS windows, count(*) AS k, round(sqrt(avg(rms * rms)), 6) + 0.0 AS rms
    FROM (SELECT *, count(*) OVER (PARTITION BY track_id, channel) AS total, row_number() OVER (PARTITION BY track_id, channel ORDER BY rms DESC, win) AS place FROM w)
    WHERE place <= greatest(1, total // 5) GROUP BY ALL""")
def top20_rms_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = channels.loudest_fifth_exact(windows.windows(adapters.samples_of_embeddings(spark, sf_dir), RATE))
    return found.select("track_id", "channel", "windows", "k", *rounded("rms"))


@query(f"{_windows(EMBEDDINGS)} SELECT track_id, channel, {_R('primary_peak')}, {_R('secondary_peak')} FROM peaks")
def window_peaks_top2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = channels.top_peaks(windows.windows(adapters.samples_of_embeddings(spark, sf_dir), RATE))
    return found.select("track_id", "channel", *rounded("primary_peak", "secondary_peak"))


_PEAK_CASES = """WITH p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity / 50 AS primary_peak, l_tax * 10 AS secondary_peak FROM lineitem)"""


def _peak_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", (F.col("l_quantity") / 50).alias("primary_peak"), (F.col("l_tax") * 10).alias("secondary_peak"))


@query(f"""{_PEAK_CASES}, c AS (SELECT *, CASE WHEN secondary_peak > 0 THEN secondary_peak ELSE primary_peak END AS second FROM p)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(second, 6) AS "PreferSecondary", round(CASE WHEN primary_peak >= 0.99999 AND secondary_peak > 0 THEN secondary_peak ELSE primary_peak END, 6) AS "ClippingAware",
    round(primary_peak, 6) AS "AlwaysPrimary", round(second, 6) AS "AlwaysSecondary" FROM c""")
def peak_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _peak_cases(spark, sf_dir)
    peaks = [F.round(rule(F.col("primary_peak"), F.col("secondary_peak")), 6).alias(name) for name, rule in levels.PEAK_RULES.items()]
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *peaks)


@query(f"""{_PEAK_CASES} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, primary_peak >= 0.99999 AS clipped, round(CASE WHEN primary_peak > 0 THEN secondary_peak / primary_peak ELSE 0 END, 6) AS ratio,
    CASE WHEN primary_peak >= 0.99999 THEN 'ClippingAware' WHEN primary_peak > 0 AND secondary_peak / primary_peak > 0.8 THEN 'PreferSecondary' ELSE 'AlwaysPrimary' END AS suggested FROM p""")
def suggest_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = F.col("primary_peak"), F.col("secondary_peak")
    keys = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return _peak_cases(spark, sf_dir).select(*keys, levels.clipped(a).alias("clipped"), F.round(levels.peak_ratio(a, b), 6).alias("ratio"), levels.suggested_rule(a, b).alias("suggested"))


_DR_COLUMNS = ", ".join(["track_id, channel, sample_count", *map(_R, ("dr_value", "rms", "peak", "primary_peak", "secondary_peak"))])


def _dr_columns(found: DataFrame) -> DataFrame:
    return found.select("track_id", "channel", "sample_count", *rounded("dr_value", "rms", "peak", "primary_peak", "secondary_peak"))


@query(f"{_windows(EMBEDDINGS)} SELECT {_DR_COLUMNS} FROM dr")
def channel_dr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dr_columns(channels.channel_dr(adapters.samples_of_embeddings(spark, sf_dir), RATE))


@query(f"{_windows(EVENTS, silence=True)} SELECT {_DR_COLUMNS} FROM dr")
def silence_filtered_dr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dr_columns(channels.channel_dr(adapters.samples_of_events(spark, sf_dir), RATE, silence_db=SILENCE_DB))


@query(f"{_windows(LINEITEM, tail=False)} SELECT {_DR_COLUMNS} FROM dr")
def multichannel_no_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dr_columns(channels.channel_dr(adapters.samples_of_lineitem(spark, sf_dir), RATE, flush_tail=False))


@query(f"""{_windows(EVENTS)}, q AS (SELECT *, 20 * log10(greatest(rms, 1e-12)) < {SILENCE_DB} AS quiet FROM w)
    SELECT track_id, channel, count(*) FILTER (NOT quiet) AS valid_windows, count(*) FILTER (quiet) AS filtered_windows, count(*) AS total_windows,
    round(100.0 * count(*) FILTER (quiet) / count(*), 6) AS filtered_percent FROM q GROUP BY ALL""")
def silence_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = windows.silence_report(windows.windows(adapters.samples_of_events(spark, sf_dir), RATE), SILENCE_DB)
    return found.withColumn("filtered_percent", F.round("filtered_percent", 6))


@query(f"""WITH {EVENTS}, a AS (SELECT track_id, channel, abs(sample) AS x, row_number() OVER (PARTITION BY track_id, channel ORDER BY abs(sample) DESC, frame_idx) AS place, sample * sample AS sq FROM s),
    g AS (SELECT track_id, channel, count(*) AS n, sqrt(sum(sq) / count(*)) AS rms, max(x) AS primary_peak, coalesce(max(x) FILTER (place = 2), 0) AS secondary_peak FROM a GROUP BY ALL)
    SELECT track_id, channel, n, {_R("rms")}, {_R("primary_peak")}, {_R("secondary_peak")}, round(CASE WHEN secondary_peak > 0 THEN secondary_peak ELSE primary_peak END, 6) + 0.0 AS peak FROM g""")
def channel_accumulator(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = channels.accumulate(adapters.samples_of_events(spark, sf_dir))
    return found.select("track_id", "channel", "n", *rounded("rms", "primary_peak", "secondary_peak", "peak"))


@query("""WITH f AS (SELECT label::VARCHAR AS track_id, row_number() OVER (PARTITION BY label ORDER BY vec_id, pos) - 1 AS k, x::DOUBLE AS x
    FROM (SELECT label, vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings))
    SELECT track_id, (k % 3)::INT AS channel, k // 3 AS frame_idx, round(x, 6) + 0.0 AS sample FROM f""")
def deinterleave(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("track_id"), F.col("vec_id").alias("seq"), F.col("embedding").alias("samples"))
    return channels.deinterleave(rows, 3).select("track_id", "channel", "frame_idx", *rounded("sample"))


# ---- tracks ---------------------------------------------------------------------------------------------------------


def _track_columns(found: DataFrame) -> DataFrame:
    return found.select("track_id", "official_dr", "excluded_channels", "excluded_lfe", "risk_level", "direction", *rounded("precise_dr", "distance_db"))


@query(f"{_windows(EMBEDDINGS)}, {_tracks(False)} SELECT {TRACK_COLUMNS} FROM t")
def track_dr(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tracks.with_exclusions(channels.channel_dr(adapters.samples_of_embeddings(spark, sf_dir), RATE))
    return _track_columns(tracks.track_dr(found))


def _seven_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = channels.channel_dr(adapters.samples_of_lineitem(spark, sf_dir), RATE, flush_tail=False)
    return tracks.with_exclusions(found, _meta(spark, sf_dir))


@query(f"{_windows(LINEITEM, tail=False)}, {_tracks(True)} SELECT {TRACK_COLUMNS} FROM t")
def track_dr_exclude_lfe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _track_columns(tracks.track_dr(_seven_channels(spark, sf_dir), exclude_lfe=True))


@query(f"""{_windows(LINEITEM, tail=False)}, {_tracks(True)}, a AS (SELECT track_id, avg(dr_value) FILTER (NOT (peak <= 1e-12 OR rms <= 1e-12)) AS p, count(*) FILTER (peak <= 1e-12 OR rms <= 1e-12) AS x FROM dr GROUP BY ALL)
    SELECT track_id, round(p)::INT AS official_dr_all, round(p, 6) + 0.0 AS precise_dr_all, x AS excluded_channels_all, 0::BIGINT AS excluded_lfe_all,
    official_dr AS official_dr_without_lfe, round(precise_dr, 6) + 0.0 AS precise_dr_without_lfe, excluded_channels AS excluded_channels_without_lfe, excluded_lfe AS excluded_lfe_without_lfe FROM t JOIN a USING (track_id)""")
def dr_both_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tracks.both_aggregates(_seven_channels(spark, sf_dir))
    names = [f"{n}{s}" for s in ("_all", "_without_lfe") for n in ("official_dr", "excluded_channels", "excluded_lfe")]
    return found.select("track_id", *names, *rounded("precise_dr_all", "precise_dr_without_lfe"))


@query(f"{_windows(LINEITEM, tail=False)}, {_tracks(True)} SELECT coalesce(bool_or(excluded_lfe > 0), false) AS any_lfe, coalesce(bool_or(excluded_channels - excluded_lfe > 0), false) AS any_silent FROM t")
def exclusion_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches.exclusion_flags(tracks.track_dr(_seven_channels(spark, sf_dir), exclude_lfe=True))


_PRECISE = "WITH e AS (SELECT event_id, event_id::VARCHAR AS track_id, value / 25 AS precise_dr, round(value / 25)::INT AS official_dr FROM events)"


def _precise(spark: SparkSession, sf_dir: str) -> DataFrame:
    precise = F.col("value") / 25
    return table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("track_id"), precise.alias("precise_dr"), levels.rounded(precise).alias("official_dr"))


@query(f"{_PRECISE} SELECT track_id, official_dr, {_R('precise_dr')}, risk_level, direction, {_R('distance_db')} FROM (SELECT *, {_risk('official_dr', 'precise_dr')} FROM e)")
def boundary_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _precise(spark, sf_dir).withColumn("risk", levels.boundary_risk(F.col("official_dr"), F.col("precise_dr"))).select("*", "risk.*")
    return found.select("track_id", "official_dr", "risk_level", "direction", *rounded("precise_dr", "distance_db"))


@query(f"""{_PRECISE}, r AS (SELECT *, {_risk('official_dr', 'precise_dr')} FROM e)
    SELECT track_id, official_dr, {_R('precise_dr')}, risk_level, direction, {_R('distance_db')}, CASE direction WHEN 'Upper' THEN official_dr + 1 ELSE greatest(official_dr - 1, 0) END AS potential_dr,
    row_number() OVER (ORDER BY risk_level = 'High' DESC, round(distance_db, 9), track_id) AS place FROM r WHERE risk_level IS NOT NULL""")
def warnings_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = batches.ranked_warnings(_precise(spark, sf_dir))
    found = batches.placed(found, "place", (F.col("risk_level") == "High").desc(), F.round("distance_db", 9).asc(), F.col("track_id").asc())
    return found.select("track_id", "official_dr", "risk_level", "direction", "potential_dr", "place", *rounded("precise_dr", "distance_db"))


@query(f"""{_windows(EVENTS, silence=True)}, {_tracks(False)}, n AS (SELECT track_id, CASE WHEN track_id > 'm' THEN precise_dr END AS precise_dr FROM t)
    SELECT track_id, {_R('precise_dr')}, row_number() OVER (ORDER BY precise_dr DESC NULLS LAST, track_id) AS place_down, row_number() OVER (ORDER BY precise_dr ASC NULLS LAST, track_id) AS place_up FROM n""")
def sorted_nulls_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tracks.track_dr(tracks.with_exclusions(channels.channel_dr(adapters.samples_of_events(spark, sf_dir), RATE, silence_db=SILENCE_DB)))
    found = found.select("track_id", F.when(F.col("track_id") > "m", F.col("precise_dr")).alias("precise_dr"))
    down = batches.placed(found, "place_down", F.col("precise_dr").desc_nulls_last(), F.col("track_id").asc())
    return batches.placed(down, "place_up", F.col("precise_dr").asc_nulls_last(), F.col("track_id").asc()).select("track_id", *rounded("precise_dr"), "place_down", "place_up")


_LISTED = "(channel = 1 AND track_id::INT % 2 = 0)"
_JSON_SILENT = "(peak <= 1e-6 OR rms <= 1e-6)"


@query(f"""{_windows(EMBEDDINGS)}, {_tracks(True).replace("channel = 3", _LISTED)}
    SELECT track_id, {RATE}::INT AS sample_rate, (count(*) OVER (PARTITION BY track_id))::INT AS n_channels, 16::INT AS bits, 'WAV/PCM' AS codec, round((max(sample_count) OVER (PARTITION BY track_id)) / {RATE}::DOUBLE, 6) AS seconds,
    official_dr, round(precise_dr, 6) + 0.0 AS precise_dr, lower(risk_level) AS risk_level, lower(direction) AS direction, round(distance_db, 6) + 0.0 AS distance_db, true AS exclude_lfe,
    (channel + 1)::INT AS channel, round(dr_value)::INT AS dr_official, round(dr_value, 6) + 0.0 AS dr_precise, CASE WHEN peak > 0 THEN round(20 * log10(peak), 6) + 0.0 END AS peak_db, CASE WHEN rms > 0 THEN round(20 * log10(rms), 6) + 0.0 END AS rms_db,
    {_JSON_SILENT} AS is_silent, {_LISTED} AS is_lfe, {_JSON_SILENT} OR {_LISTED} AS is_excluded FROM dr JOIN t USING (track_id)""")
def json_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Renders JSON reports and reads all of them back, a row a channel. Even tracks list their second channel as a
    low-frequency one."""
    found = channels.channel_dr(adapters.samples_of_embeddings(spark, sf_dir), RATE)
    lfe = F.when(F.col("track_id").cast("int") % 2 == 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    formats = _formats(found).select("*", F.lit(16).alias("bits_per_sample"), lfe.alias("lfe_indices"), F.lit(True).alias("has_channel_layout_metadata"))
    found = tracks.with_exclusions(found, formats)
    reports = report.json_reports(found, tracks.track_dr(found, True), True, formats)
    shape = """tool string, version string, filePath string, format struct<sampleRate: int, channels: int, bitsPerSample: int, codec: string, durationSeconds: double>, officialDr int, preciseDr double,
        boundaryWarning struct<level: string, direction: string, distanceDb: double>, excludeLfe boolean,
        channels array<struct<channel: int, drOfficial: int, drPrecise: double, peakDb: double, rmsDb: double, isSilent: boolean, isLfe: boolean, isExcluded: boolean>>"""
    r = reports.select(F.from_json("report", shape).alias("r")).select("r.*", F.explode("r.channels").alias("c"))
    named = {
        "track_id": "filePath", "sample_rate": "format.sampleRate", "n_channels": "format.channels", "bits": "format.bitsPerSample", "codec": "format.codec", "seconds": "format.durationSeconds",
        "official_dr": "officialDr", "precise_dr": "preciseDr", "risk_level": "boundaryWarning.level", "direction": "boundaryWarning.direction", "distance_db": "boundaryWarning.distanceDb", "exclude_lfe": "excludeLfe",
        "channel": "c.channel", "dr_official": "c.drOfficial", "dr_precise": "c.drPrecise", "peak_db": "c.peakDb", "rms_db": "c.rmsDb", "is_silent": "c.isSilent", "is_lfe": "c.isLfe", "is_excluded": "c.isExcluded",
    }
    return r.select(*[F.col(of).alias(name) for name, of in named.items()])


@query(f"""{_windows(EMBEDDINGS)}, {_tracks(False)}, l AS (SELECT track_id, channel, '| ' || CASE channel WHEN 0 THEN 'Left' ELSE 'Right' END || ' | ' || printf('%.2f', dr_value) || ' dB | ' || printf('%.2f', 20 * log10(rms)) || ' | ' || printf('%.2f', 20 * log10(peak)) || ' |  |' AS line FROM dr)
    SELECT track_id, '| Channel | DR | RMS | Peak | Note |' || chr(10) || '| --- | --- | --- | --- | --- |' || chr(10) || string_agg(line, chr(10) ORDER BY channel) || chr(10) || 'Official DR: DR' || any_value(official_dr) || ' (' || printf('%.2f', any_value(precise_dr)) || ' dB)'
    || coalesce(chr(10) || any_value({_WARNING}), '') AS report
    FROM l JOIN t USING (track_id) GROUP BY track_id""")
def text_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tracks.with_exclusions(channels.channel_dr(adapters.samples_of_embeddings(spark, sf_dir), RATE))
    return report.text_reports(found, tracks.track_dr(found))


@query(f"""{_windows(LINEITEM, tail=False)}, {_tracks(True)}, q AS (SELECT *, peak <= 1e-6 OR rms <= 1e-6 AS quiet, channel = 3 AS lfe FROM dr),
    l AS (SELECT track_id, channel, '| CH ' || (channel + 1) || CASE WHEN lfe OR quiet THEN ' [' || concat_ws(', ', CASE WHEN lfe THEN 'LFE' END, CASE WHEN quiet THEN 'Silent' END, 'excluded') || ']' ELSE '' END
        || CASE WHEN quiet THEN ' | - | -' ELSE ' | DR' || round(dr_value)::INT || ' | ' || printf('%.2f', dr_value) END || ' |' AS line FROM q)
    SELECT track_id, '## ' || CASE WHEN any_value(risk_level) IS NULL THEN track_id ELSE '*' || track_id || '*' END || chr(10) || chr(10) || '| Channel | Official | Precise |' || chr(10) || '| --- | --- | --- |' || chr(10) || string_agg(line, chr(10) ORDER BY channel)
        || coalesce(chr(10) || chr(10) || '**Official DR' || any_value(official_dr) || ' (excl. LFE)** · Precise ' || printf('%.2f', any_value(precise_dr)) || ' dB', '')
        || coalesce(chr(10) || chr(10) || '*' || any_value(risk_level) || ' risk near the ' || lower(any_value(direction)) || ' boundary, ' || printf('%.2f', any_value(distance_db)) || ' dB*', '') AS report FROM l JOIN t USING (track_id) GROUP BY track_id""")
def markdown_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _seven_channels(spark, sf_dir)
    return export.markdown_exports(found, tracks.track_dr(found, exclude_lfe=True), exclude_lfe=True, hide_path=True)


@query(f"""{_windows(LINEITEM, tail=False)}, {_tracks(True)} SELECT track_id, t.official_dr, (channel + 1)::INT AS channel, round(dr_value)::INT AS dr_rounded, CASE WHEN peak <= 1e-6 OR rms <= 1e-6 THEN 'silent' WHEN channel = 3 THEN 'lfe' ELSE 'normal' END AS status,
    peak <= 1e-6 OR rms <= 1e-6 OR channel = 3 AS excluded FROM dr JOIN t USING (track_id)""")
def json_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON exports, read back."""
    found = _seven_channels(spark, sf_dir)
    reports = export.json_exports(found, tracks.track_dr(found, exclude_lfe=True), exclude_lfe=True)
    shape = "path string, officialDr int, channels array<struct<channel: int, drRounded: int, status: string, excluded: boolean>>"
    r = reports.select(F.from_json("report", shape).alias("r")).select("r.path", "r.officialDr", F.inline("r.channels"))
    return r.select(F.col("path").alias("track_id"), F.col("officialDr").alias("official_dr"), "channel", F.col("drRounded").alias("dr_rounded"), "status", "excluded")


@query(f"""{_TRACKS_SQL}, f AS (SELECT *, CASE WHEN dsd THEN 5644800 END AS native, CASE WHEN o_orderkey % 22 = 0 THEN 128 END AS tier, CASE WHEN o_orderkey % 2 = 0 THEN 48000 END AS processed FROM k)
    SELECT o_orderkey, CASE WHEN native IS NOT NULL THEN '5644800 Hz (DSD' || coalesce(tier::VARCHAR, '') || ')' ELSE rate || ' Hz' END || CASE WHEN processed <> rate THEN ' -> 48000 Hz' ELSE '' END AS rate_text,
    CASE WHEN dsd THEN '1 (processed as 32-bit float)' ELSE bits::VARCHAR END AS bits_text, coalesce(CASE WHEN dsd OR partial THEN NULL WHEN codec IN ('FLAC', 'MP3', 'AAC') THEN CASE WHEN frames > 0 THEN round(bytes * 8.0::DOUBLE / (frames / rate) / 1000)::BIGINT END ELSE (rate * channels * bits) // 1000 END || ' kbps', 'N/A') AS bitrate_text FROM f""")
def format_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    rows = _track_rows(spark, sf_dir).select(
        "o_orderkey", "codec", "bytes", "channels", F.col("frames").alias("sample_count"), F.col("rate").alias("sample_rate"), F.col("bits").alias("bits_per_sample"), F.col("partial").alias("is_partial"),
        F.when(F.col("dsd"), 5644800).alias("dsd_native_rate_hz"), F.when(key % 22 == 0, 128).alias("dsd_multiple_of_44k"), F.when(key % 2 == 0, 48000).alias("processed_sample_rate"),
    )
    return export.format_info(rows).select("o_orderkey", "rate_text", "bits_text", "bitrate_text")


# ---- trimming -------------------------------------------------------------------------------------------------------


def _trim(samples: str, level: float) -> str:
    return f"""WITH {samples}, f AS (SELECT track_id, frame_idx, max(abs(sample)) AS amplitude FROM s GROUP BY ALL),
    g AS (SELECT *, (amplitude < pow(10, {level} / 20))::INT AS silent FROM f),
    h AS (SELECT *, CASE WHEN lag(silent) OVER (PARTITION BY track_id ORDER BY frame_idx) = silent THEN 0 ELSE 1 END AS new FROM g),
    i AS (SELECT *, sum(new) OVER (PARTITION BY track_id ORDER BY frame_idx) AS run FROM h),
    r AS (SELECT track_id, run, max(silent) AS silent, min(frame_idx) AS first_frame, count(*) AS length FROM i GROUP BY ALL),
    r1 AS (SELECT *, sum(CASE WHEN silent = 0 THEN length ELSE 0 END) OVER (PARTITION BY track_id ORDER BY run) AS heard, max(run) OVER (PARTITION BY track_id) AS last_run FROM r),
    r2 AS (SELECT *, min(run) FILTER (heard >= {HYSTERESIS}) OVER (PARTITION BY track_id) AS lead_end FROM r1),
    r3 AS (SELECT *, max(run) FILTER (silent = 0 AND run >= lead_end AND (run = lead_end OR length >= {HYSTERESIS})) OVER (PARTITION BY track_id) AS held_from,
        bool_or(run = last_run AND silent = 1 AND length >= {MIN_RUN}) OVER (PARTITION BY track_id) AS ends_silent FROM r2),
    t AS (SELECT track_id, run, first_frame, length, CASE WHEN silent = 1 AND (lead_end IS NULL OR run < lead_end) THEN length // {MIN_RUN} * {MIN_RUN} ELSE 0 END AS drop_first,
        coalesce(run > held_from AND ends_silent, false) AS drop_all FROM r3)"""


_TRIM = _trim(EVENTS, TRIM_DB)


def _trim_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = channels.frame_amplitude(adapters.samples_of_events(spark, sf_dir))
    return trim.trimmed_runs(trim.silent_runs(frames, TRIM_DB), MIN_RUN, HYSTERESIS)


@query(f"WITH {EVENTS} SELECT track_id, frame_idx, round(max(abs(sample)), 6) AS amplitude FROM s GROUP BY ALL")
def frame_amplitude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return channels.frame_amplitude(adapters.samples_of_events(spark, sf_dir)).withColumn("amplitude", F.round("amplitude", 6))


@query(f"""{_TRIM} SELECT track_id, sum(drop_first)::BIGINT AS leading_frames, sum(CASE WHEN drop_all THEN length ELSE 0 END)::BIGINT AS trailing_frames, sum(length)::BIGINT AS total_frames,
    round(sum(drop_first) / 100, 6) AS leading_seconds, round(sum(CASE WHEN drop_all THEN length ELSE 0 END) / 100, 6) AS trailing_seconds, round(sum(CASE WHEN drop_all THEN length ELSE drop_first END) / 100, 6) AS trimmed_seconds FROM t GROUP BY ALL""")
def edge_trim_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = trim.trim_durations(trim.trim_report(_trim_runs(spark, sf_dir)), RATE)
    return found.select("track_id", "leading_frames", "trailing_frames", "total_frames", *rounded("leading_seconds", "trailing_seconds", "trimmed_seconds"))


@query(f"""{_TRIM}, kept AS (SELECT s.track_id, s.channel, s.frame_idx, s.sample FROM s JOIN t ON s.track_id = t.track_id AND s.frame_idx >= t.first_frame + t.drop_first AND s.frame_idx < t.first_frame + t.length AND NOT drop_all)
    SELECT track_id, channel, dense_rank() OVER (PARTITION BY track_id ORDER BY frame_idx) - 1 AS frame_idx, round(sample, 6) + 0.0 AS sample FROM kept""")
def edge_trim_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trim.trimmed(adapters.samples_of_events(spark, sf_dir), _trim_runs(spark, sf_dir)).select("track_id", "channel", "frame_idx", *rounded("sample"))


@query("SELECT o_orderkey, ceil((o_orderkey % 2000) / 1000 * 44100)::BIGINT AS frames, round(least(greatest((o_orderkey % 2000) * 0.33::DOUBLE, 50), 200), 6) AS hysteresis_ms FROM orders")
def trim_settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    ms = F.col("o_orderkey") % 2000
    return table(spark, sf_dir, "orders").select("o_orderkey", describe.frames_of_ms(ms, F.lit(44100)).alias("frames"), F.round(describe.hysteresis_ms(ms), 6).alias("hysteresis_ms"))


# ---- scalars --------------------------------------------------------------------------------------------------------

_CODES = {"S8": 8, "U8": 8, "S16": 16, "U16": 16, "S24": 24, "U24": 24, "S32": 32, "U32": 32}


def _code_sql(name: str, bits: int) -> str:
    value = f"((l_orderkey * 7919 + l_partkey * 104729 + l_suppkey) % {1 << bits})"
    return f"((({value} - {(1 << (bits - 1)) if name[0] == 'S' else 0})::DOUBLE - {0 if name[0] == 'S' else 1 << (bits - 1)}) / {1 << (bits - 1)})::FLOAT::DOUBLE AS {name.lower()}"


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, " + ", ".join(_code_sql(n, b) for n, b in _CODES.items()) + ", l_discount::FLOAT::DOUBLE AS f64 FROM lineitem")
def sample_conversion_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = []
    for name, bits in _CODES.items():
        value = (F.col("l_orderkey") * 7919 + F.col("l_partkey") * 104729 + F.col("l_suppkey")) % (1 << bits)
        stored = value - (1 << (bits - 1)) if name[0] == "S" else value
        out.append(pcm.to_float(stored, name).cast("double").alias(name.lower()))
    keys = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return table(spark, sf_dir, "lineitem").select(*keys, *out, pcm.to_float(F.col("l_discount"), "F64").cast("double").alias("f64"))


@query("""SELECT event_id, CASE WHEN value - 250 > 0 THEN round(20 * log10(value - 250), 6) + 0.0 END AS db, value - 250 <= 0 AS below_all, CASE WHEN value - 250 > 0 THEN printf('%.2f', 20 * log10(value - 250)) ELSE '-1.#J' END AS text,
    round(pow(10, (value - 250) / 20 / 20), 6) AS amplitude FROM events""")
def db_conversion(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("value") - 250
    db = levels.linear_to_db(x)
    return table(spark, sf_dir, "events").select("event_id", F.when(db > float("-inf"), F.round(db, 6) + 0.0).alias("db"), (db == float("-inf")).alias("below_all"), levels.linear_to_db_text(x).alias("text"), F.round(levels.db_to_linear(x / 20), 6).alias("amplitude"))


_NAMES = ["5.1", " 5.1(SIDE) ", "5.1(back)", "itu_3_4_1", "7.1(wide)", "6.1", "7.1.4", "quad", "2.1", "atmos_9.1.6", "mono", "3.1(side)", "5.1.2"]
_COUNTS = [6, 8, 7, 12, 3, 16, 1, 4, 10, 2, 40]


@query("WITH n AS (SELECT p_partkey, [" + ", ".join(f"'{n}'" for n in _NAMES) + f"][p_partkey % {len(_NAMES)} + 1] AS layout, {_COUNTS}[p_partkey // {len(_NAMES)} % {len(_COUNTS)} + 1]::INT AS channels, CASE WHEN p_partkey % 3 = 0 THEN 'eac3' ELSE 'mov' END AS container FROM part), "
    """known(name, c, lfe) AS (VALUES ('5.1', 6, 3), ('5.1(side)', 6, 3), ('itu_3_2_1', 6, 3), ('mpeg_5_1_a', 6, 3), ('7.1', 8, 3), ('7.1(wide)', 8, 3), ('itu_3_4_1', 8, 3), ('mpeg_7_1_c', 8, 3), ('6.1', 7, 3), ('mpeg_6_1_a', 7, 3),
        ('atmos_5.1.2', 8, 3), ('5.1.2', 8, 3), ('atmos_5.1.4', 10, 3), ('5.1.4', 10, 3), ('atmos_7.1.2', 10, 3), ('7.1.2', 10, 3), ('atmos_7.1.4', 12, 3), ('7.1.4', 12, 3), ('atmos_9.1.6', 16, 3), ('9.1.6', 16, 3), ('2.1', 3, 2), ('3.1', 4, 3)),
    m AS (SELECT n.*, lower(trim(layout)) AS exact, trim(regexp_replace(lower(trim(layout)), '\\((side|wide|back)\\)', '', 'g')) AS bare FROM n),
    j AS (SELECT m.*, e.lfe AS el, z.lfe AS zl, container = 'eac3' AND (exact, channels) IN (('5.1', 6), ('5.1(side)', 6), ('5.1.2', 8), ('7.1', 8), ('7.1(wide)', 8)) AS raw
        FROM m LEFT JOIN known e ON e.name = exact AND e.c = channels LEFT JOIN known z ON z.name = bare AND bare <> exact AND z.c = channels)
    SELECT p_partkey, layout, channels, CASE WHEN raw THEN 'raw' WHEN el IS NOT NULL THEN 'exact' WHEN zl IS NOT NULL THEN 'fuzzy' ELSE 'fallback' END AS layout_match,
    coalesce(CASE WHEN raw THEN 5 ELSE coalesce(el, zl, CASE WHEN channels = 3 THEN 2 WHEN channels BETWEEN 4 AND 32 THEN 3 END) END::VARCHAR, '') AS lfe FROM j""")
def layout_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    name = F.get(F.array(*map(F.lit, _NAMES)), (key % len(_NAMES)).cast("int"))
    count = F.get(F.array(*map(F.lit, _COUNTS)), (F.floor(key / len(_NAMES)) % len(_COUNTS)).cast("int"))
    rows = table(spark, sf_dir, "part").select("p_partkey", name.alias("layout"), count.alias("channels"), F.when(key % 3 == 0, "eac3").otherwise("mov").alias("container"))
    return layouts.with_layout(rows).select("p_partkey", "layout", "channels", "layout_match", F.concat_ws("+", F.col("lfe_indices").cast("array<string>")).alias("lfe"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 8 & 8 <> 0 OR o_orderkey % 16 >= 8 THEN bit_count((o_orderkey % 16) & 7)::VARCHAR ELSE '' END AS mask_lfe,
    ['', '3', '3+4', '0'][o_orderkey % 4 + 1] AS label_lfe FROM orders""")
def lfe_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Low-frequency channels from a channel mask and from a list of labels."""
    labels = F.get(F.array(*map(F.lit, ["FL+FR", "FL+FR+FC+LFE+SL+SR", "FL+FR+FC+LFE+LFE2", "lfe"])), (F.col("o_orderkey") % 4).cast("int"))
    rows = layouts.lfe_of_labels(table(spark, sf_dir, "orders").select("o_orderkey", labels.alias("labels")))
    text = lambda a: F.concat_ws("+", a.cast("array<string>"))
    return rows.select("o_orderkey", text(describe.mask_lfe(F.col("o_orderkey") % 16)).alias("mask_lfe"), text(F.col("lfe_indices")).alias("label_lfe"))


@query(f"""{_TRACKS_SQL} SELECT o_orderkey, codec IN ('FLAC', 'MP3', 'AAC') AS compressed, CASE WHEN dsd OR partial THEN NULL WHEN codec IN ('FLAC', 'MP3', 'AAC') THEN CASE WHEN frames > 0 THEN round(bytes * 8.0::DOUBLE / (frames / rate) / 1000)::BIGINT END ELSE (rate * channels * bits) // 1000 END AS kbps FROM k""")
def bitrate(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    kbps = describe.bitrate_kbps(c("codec"), c("bytes"), c("frames"), c("rate"), c("channels"), c("bits"), c("dsd"), c("partial"))
    return _track_rows(spark, sf_dir).select("o_orderkey", describe.compressed(c("codec")).alias("compressed"), kbps.alias("kbps"))


@query(f"""{_TRACKS_SQL}, d AS (SELECT *, (frames // rate)::BIGINT AS sec FROM k) SELECT o_orderkey, CASE WHEN sec >= 3600 THEN printf('%d:%02d:%02d', sec // 3600, sec % 3600 // 60, sec % 60) ELSE printf('%d:%02d', sec // 60, sec % 60) END AS duration FROM d""")
def duration_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _track_rows(spark, sf_dir).select("o_orderkey", describe.duration_text(F.col("frames"), F.col("rate")).alias("duration"))


@query(f"{_TRACKS_SQL} SELECT o_orderkey, CASE WHEN o_orderkey % 17 = 0 THEN 9223372036854775807 ELSE frames * channels * (bits // 8) END AS pcm_bytes FROM k")
def pcm_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = F.when(F.col("o_orderkey") % 17 == 0, F.lit(9223372036854775000)).otherwise(F.col("frames"))
    return _track_rows(spark, sf_dir).select("o_orderkey", describe.pcm_bytes(frames, F.col("channels"), F.col("bits")).alias("pcm_bytes"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 9 - 1 <= 0 THEN 'sample rate must be positive' WHEN NOT o_orderkey % 40 BETWEEN 1 AND 32 THEN 'channels must be 1 to 32' WHEN [8, 16, 20, 24, 32, 64][o_orderkey % 6 + 1] = 20 THEN 'unsupported bit depth' END AS error FROM orders""")
def format_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    bits = F.get(F.array(*map(F.lit, [8, 16, 20, 24, 32, 64])), (key % 6).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", format_error(key % 9 - 1, key % 40, bits).alias("error"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 3 + 1 = 1 THEN 'Mono' WHEN o_orderkey % 3 + 1 = 2 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'Left' ELSE 'Right' END ELSE 'Ch ' || (o_orderkey % 2 + 1) END AS name,
    CASE WHEN o_orderkey % 5 = 0 THEN 'LFE' WHEN o_orderkey % 7 = 0 THEN 'Silent' ELSE '' END AS note, CASE o_orderkey % 9 WHEN 3 THEN '2.1' WHEN 4 THEN '3.1' WHEN 6 THEN '5.1' WHEN 7 THEN '6.1' WHEN 8 THEN '7.1' ELSE 'multichannel' END AS format FROM orders""")
def channel_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", describe.channel_name(key % 2, key % 3 + 1).alias("name"), describe.channel_note(key % 5 == 0, key % 7 == 0).alias("note"), describe.format_name(key % 9).alias("format"))


@query("""WITH p AS (SELECT page_id, '/music/' || (page_id % 10) || '/a b:' || page_id || ['.FLAC', '.wav', '', '.tar.mp3', '.txt'][page_id % 5 + 1] AS path FROM pages)
    SELECT page_id, path[length('/music/0/') + 1:] AS file_name, regexp_replace(path[length('/music/0/') + 1:], '\\.[^.]*$', '') AS stem, ['FLAC', 'WAV', 'Unknown', 'MP3', 'TXT'][page_id % 5 + 1] AS extension,
    '/music/' || (page_id % 10) AS parent, regexp_replace(path[length('/music/0/') + 1:], '[ :.]', '_', 'g') AS sanitized, page_id % 5 IN (0, 1, 3) AS can_decode FROM p""")
def path_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("page_id")
    tail = F.get(F.array(*map(F.lit, [".FLAC", ".wav", "", ".tar.mp3", ".txt"])), (key % 5).cast("int"))
    path = F.concat(F.lit("/music/"), (key % 10).cast("string"), F.lit("/a b:"), key.cast("string"), tail)
    return table(spark, sf_dir, "pages").select(
        "page_id", describe.file_name(path).alias("file_name"), describe.file_stem(path).alias("stem"), describe.extension(path).alias("extension"), describe.parent_dir(path).alias("parent"),
        describe.sanitized(describe.file_name(path)).alias("sanitized"), describe.can_decode(path).alias("can_decode"),
    )


@query("""WITH k AS (SELECT o_orderkey, o_orderkey * 9973 % 50000000 AS hz, ['teac', 'studio', 'off', 'TEAC'][o_orderkey % 4 + 1] AS mode FROM orders),
    m AS (SELECT *, round(hz / 44100.0::DOUBLE)::INT AS mul FROM k),
    t AS (SELECT *, CASE WHEN mul <= 96 THEN 64 WHEN mul <= 192 THEN 128 WHEN mul <= 384 THEN 256 WHEN mul <= 768 THEN 512 ELSE 1024 END AS tier FROM m)
    SELECT o_orderkey, tier, CASE WHEN lower(mode) = 'off' THEN NULL WHEN lower(mode) = 'teac' THEN round(least(39000.0 * tier / 64, 0.45 * 352800)::DOUBLE, 3) ELSE 20000.0::DOUBLE END AS cutoff,
    concat_ws(',', CASE lower(mode) WHEN 'off' THEN NULL WHEN 'teac' THEN 'lowpass=f=' || least(39000 * tier // 64, 158760) ELSE 'lowpass=f=20000' END, CASE WHEN o_orderkey % 5 > 0 THEN 'volume=' || (o_orderkey % 5) || 'dB' END) AS filters FROM t""")
def dsd_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    tier = describe.dsd_tier(key * 9973 % 50_000_000)
    mode = F.get(F.array(*map(F.lit, ["teac", "studio", "off", "TEAC"])), (key % 4).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", tier.alias("tier"), F.round(describe.dsd_cutoff_hz(mode, tier, F.lit(352800)), 3).alias("cutoff"), describe.dsd_filters(mode, tier, gain_db=key % 5).alias("filters"))


@query("""WITH k AS (SELECT o_orderkey, o_orderkey * o_orderkey * 37 % 2000000000 AS b FROM orders), f AS (SELECT *, trunc(b * 8.0::DOUBLE / CASE WHEN b < 1000000 THEN 128000 WHEN b < 10000000 THEN 256000 ELSE 320000 END * 48000)::BIGINT AS n FROM k)
    SELECT o_orderkey, CASE WHEN n < 1000 OR n > 48000::BIGINT * 86400 THEN 48000 * 60 ELSE n END AS frames, greatest(1, least(least(greatest(o_orderkey % 30 - 3, 1), 16), greatest(o_orderkey % 9, 1))) AS degree FROM f""")
def estimates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames guessed from a file's size, and the degree of parallel work for so many items."""
    key = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select("o_orderkey", describe.opus_frames(key * key * 37 % 2_000_000_000, F.lit(48000)).alias("frames"), describe.parallel_degree(key % 30 - 3, key % 9).alias("degree"))


_ERRORS = ["InvalidInput", "IoError", "FormatError", "DecodingError", "CalculationError", "OutOfMemory", "ResourceError"]
_HINTS = [
    "check the options and the input; --help lists what is accepted", "check that the file exists and can be read",
    "use a file in a supported format (WAV, FLAC, AIFF, ALAC, M4A, MP4, MP3, MP1, AAC, OGG, OPUS, AC3, EC3, EAC3, DTS, DSF, DFF, MKV, WEBM)",
    "the file may be damaged, or its codec needs a registered decoder", "check that the file holds valid samples",
    "give the executors more memory or fewer cores each", "check the resources of the machine or lower the parallelism, then retry",
]


@query(f"SELECT o_orderkey, {_ERRORS}[o_orderkey % 7 + 1] AS kind, ['Other', 'Io', 'Format', 'Decoding', 'Calculation', 'Calculation', 'Other'][o_orderkey % 7 + 1] AS category, [2, 1, 2, 3, 4, 4, 5][o_orderkey % 7 + 1]::INT AS exit_code, {_HINTS}[o_orderkey % 7 + 1] AS hint FROM orders")
def error_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.get(F.array(*map(F.lit, _ERRORS)), (F.col("o_orderkey") % 7).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", kind.alias("kind"), describe.error_category(kind).alias("category"), describe.exit_code(kind).alias("exit_code"), describe.error_hint(kind).alias("hint"))


# ---- packets, batches, benchmarks -----------------------------------------------------------------------------------


@query("SELECT source, count(n_chars) AS chunks, sum(n_chars)::BIGINT AS total, min(n_chars) AS least, max(n_chars) AS largest, round(avg(n_chars), 6) AS mean FROM documents GROUP BY ALL")
def chunk_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets.chunk_stats(table(spark, sf_dir, "documents"), ["source"], "n_chars").withColumn("mean", F.round("mean", 6))


@query("""WITH c AS (SELECT l_returnflag, l_quantity::BIGINT AS size, count(*) AS chunks FROM lineitem GROUP BY ALL)
    SELECT l_returnflag, size, chunks, round(100.0 * chunks / sum(chunks) OVER (PARTITION BY l_returnflag), 6) AS percent, row_number() OVER (PARTITION BY l_returnflag ORDER BY chunks DESC, size) = 1 AS is_mode FROM c""")
def chunk_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_quantity").cast("long").alias("n_frames"))
    return packets.chunk_distribution(rows, ["l_returnflag"]).withColumn("percent", F.round("percent", 6))


_PACKETS = "p AS (SELECT label::VARCHAR AS track_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS seq, vec_id FROM embeddings)"


def _packet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("label").orderBy("vec_id")
    return table(spark, sf_dir, "embeddings").select(F.col("label").cast("string").alias("track_id"), (F.row_number().over(order) - 1).cast("long").alias("seq"), "vec_id", F.when(F.col("vec_id") % 3 != 0, F.col("embedding")).alias("samples"))


@query(f"WITH {_PACKETS} SELECT track_id, seq, vec_id FROM p")
def reorder_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets that come out of order, half of them twice."""
    rows = _packet_rows(spark, sf_dir).repartition(16, F.xxhash64("vec_id"))
    return packets.reordered(rows.unionByName(rows.where("seq % 2 = 0"))).select("track_id", "seq", "vec_id")


@query(f"""WITH {_PACKETS}, q AS (SELECT *, (vec_id % 3 = 0)::INT AS bad FROM p), g AS (SELECT *, sum(1 - bad) OVER (PARTITION BY track_id ORDER BY seq) AS good FROM q), r AS (SELECT track_id, good, sum(bad) AS n, count(*) AS c FROM g GROUP BY ALL)
    SELECT track_id, sum(c)::BIGINT AS packets, sum(n)::BIGINT AS skipped_packets, max(n)::BIGINT AS longest_failure, max(n) > 100 AS track_fails FROM r GROUP BY ALL""")
def decode_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packets.decode_failures(_packet_rows(spark, sf_dir))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN false ELSE o_orderkey % 100 < o_orderkey % 90 END AS is_partial FROM orders")
def partial_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", (key % 100).alias("actual_frames"), (key % 90).alias("expected_frames"), (key % 5 == 0).alias("trimmed"))
    return packets.partial_tracks(rows).select("o_orderkey", "is_partial")


_BATCH = f"WITH b AS (SELECT o_orderkey::INT AS idx, 'track ' || o_orderkey || '.flac' AS file_name, CASE WHEN o_orderkey % 6 = 0 THEN {_ERRORS}[o_orderkey // 6 % 7 + 1] END AS kind, o_orderkey FROM orders), c AS (SELECT *, CASE kind WHEN 'IoError' THEN 'Io' WHEN 'FormatError' THEN 'Format' WHEN 'DecodingError' THEN 'Decoding' WHEN 'CalculationError' THEN 'Calculation' WHEN 'OutOfMemory' THEN 'Calculation' WHEN 'InvalidInput' THEN 'Other' WHEN 'ResourceError' THEN 'Other' END AS error_category FROM b)"


def _batch_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    kind = F.when(key % 6 == 0, F.get(F.array(*map(F.lit, _ERRORS)), (F.floor(key / 6) % 7).cast("int")))
    name = F.concat(F.lit("track "), key.cast("string"), F.lit(".flac"))
    value = F.when(kind.isNull(), key % 2000 / 100)
    return table(spark, sf_dir, "orders").select(
        key.cast("int").alias("idx"), F.concat(F.lit("/Albums/"), name).alias("path"), name.alias("file_name"), F.when(kind.isNotNull(), describe.error_category(kind)).alias("error_category"),
        levels.rounded(value).alias("official_dr"), value.alias("precise_dr"), (key % 3).alias("excluded_channels"), F.least(key % 2, key % 3).alias("excluded_lfe"),
    )


@query(f"{_BATCH} SELECT count(*) FILTER (error_category IS NULL) AS processed, count(*) FILTER (error_category IS NOT NULL) AS failed, round(100.0 * count(*) FILTER (error_category IS NULL) / count(*), 6) AS success_rate FROM c")
def batch_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches.batch_summary(_batch_rows(spark, sf_dir)).withColumn("success_rate", F.round("success_rate", 6))


@query(f"""{_BATCH}, r AS (SELECT *, row_number() OVER (PARTITION BY error_category ORDER BY idx) AS place, count(*) OVER (PARTITION BY error_category) AS n FROM c WHERE error_category IS NOT NULL)
    SELECT error_category, max(n) AS failures, string_agg(file_name, ', ' ORDER BY idx) FILTER (place <= 3) AS file_names, greatest(max(n) - 3, 0) AS more FROM r GROUP BY ALL""")
def error_groups_top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches.error_groups(_batch_rows(spark, sf_dir))


@query(f"""{_BATCH} SELECT idx, CASE WHEN error_category IS NOT NULL THEN '| - | - | ' || file_name || ' |' ELSE '| ' || round(o_orderkey % 2000 / 100)::INT || ' | ' || printf('%.2f', o_orderkey % 2000 / 100) || ' | ' || file_name
    || CASE WHEN least(o_orderkey % 2, o_orderkey % 3) > 0 THEN ' *' ELSE '' END || CASE WHEN o_orderkey % 3 - least(o_orderkey % 2, o_orderkey % 3) > 0 THEN ' †' ELSE '' END || ' |' END AS line FROM c""")
def batch_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.batch_rows(_batch_rows(spark, sf_dir))


@query(f"{_BATCH} SELECT idx, file_name FROM c WHERE file_name LIKE '%99%'")
def search_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return batches.search(_batch_rows(spark, sf_dir), "K 99").select("idx", "file_name").unionByName(batches.search(_batch_rows(spark, sf_dir), "99").where("NOT file_name LIKE 'track 99%'").select("idx", "file_name"))


@query(f"{_BATCH} SELECT idx, error_category, row_number() OVER (ORDER BY idx) AS place FROM c")
def append_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _batch_rows(spark, sf_dir)
    good, bad = rows.where("error_category IS NULL").select("idx", "precise_dr"), rows.where("error_category IS NOT NULL").select("idx", "error_category")
    return batches.placed(batches.appended(good, bad), "place", F.col("idx").asc()).select("idx", "error_category", "place")


@query("""SELECT o_orderpriority, count(*) AS runs, round(avg(o_totalprice), 4) AS mean, round(coalesce(stddev_samp(o_totalprice), 0), 4) AS stddev, round(median(o_totalprice), 4) AS median, round(min(o_totalprice), 4) AS least,
    round(max(o_totalprice), 4) AS largest, round(stddev_pop(o_totalprice), 4) AS stddev_population FROM orders GROUP BY ALL""")
def bench_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = batches.run_stats(table(spark, sf_dir, "orders"), "o_totalprice", ["o_orderpriority"])
    names = ("mean", "stddev", "median", "least", "largest", "stddev_population")
    return out.select("o_orderpriority", "runs", *(F.round(n, 4).alias(n) for n in names))


@query("""WITH a AS (SELECT o_orderpriority AS metric, avg(o_totalprice) AS v FROM orders WHERE o_orderkey % 2 = 0 GROUP BY ALL), b AS (SELECT o_orderpriority AS metric, avg(o_totalprice) AS v FROM orders WHERE o_orderkey % 2 = 1 GROUP BY ALL)
    SELECT metric, round(a.v, 4) AS baseline, round(b.v, 4) AS candidate, round(b.v - a.v, 4) AS delta, round(CASE WHEN a.v <> 0 THEN 100 * (b.v - a.v) / a.v ELSE 0 END, 4) AS percent FROM a JOIN b USING (metric)""")
def ab_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders").withColumn("metric", F.col("o_orderpriority"))
    half = lambda k: rows.where(F.col("o_orderkey") % 2 == k).groupBy("metric").agg(F.avg("o_totalprice").alias("v"))
    return batches.compared(half(0), half(1), "metric", "v").select("metric", *(F.round(n, 4).alias(n) for n in ("baseline", "candidate", "delta", "percent")))


@query("SELECT round(max(value), 4) AS peak_cpu_percent, round(avg(value), 4) AS avg_cpu_percent, max(user_id) AS peak_memory_kb, (sum(user_id) // count(user_id))::BIGINT AS avg_memory_kb FROM events")
def resource_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = batches.resource_summary(table(spark, sf_dir, "events").select(F.col("value").alias("cpu_percent"), F.col("user_id").alias("memory_kb")))
    return out.withColumn("peak_cpu_percent", F.round("peak_cpu_percent", 4)).withColumn("avg_cpu_percent", F.round("avg_cpu_percent", 4))


@query("SELECT vec_id, round(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[]), 6) AS sum_sq FROM embeddings")
def square_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", F.round(levels.square_sum(F.col("embedding")), 6).alias("sum_sq"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 10 > 0 THEN round((o_orderkey % 7) / (o_orderkey % 10), 6) ELSE 0 END AS progress,
    CASE WHEN o_orderkey % 5 > 0 THEN round((o_orderkey % 100000) / (44100 * (o_orderkey % 5)), 6) ELSE 0 END AS seconds, CASE WHEN o_orderkey % 4 > 0 THEN round(o_orderkey / (o_orderkey % 4), 6) ELSE 0 END AS per_second FROM orders""")
def progress_and_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    seconds = describe.sample_seconds(key % 100_000, F.lit(44100), key % 5)
    return table(spark, sf_dir, "orders").select("o_orderkey", F.round(describe.progress(key % 7, key % 10), 6).alias("progress"), F.round(seconds, 6).alias("seconds"), F.round(pcm.rate_per_second(key, key % 4), 6).alias("per_second"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 0 THEN 44100 ELSE 48000 END::INT AS sample_rate, (o_orderkey % 8 + 1)::INT AS channels, CASE WHEN o_orderkey % 3 = 0 THEN '5.1' END AS layout, 'ac3' AS codec, 'eac3' AS container,
    CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE trunc((o_orderkey % 1000) / 8.0::DOUBLE * CASE WHEN o_orderkey % 5 = 0 THEN 44100 ELSE 48000 END)::BIGINT END AS sample_count FROM orders""")
def probe_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    stream = F.struct(
        F.when(key % 5 == 0, "n/a").otherwise("48000").alias("sample_rate"), (key % 8 + 1).cast("int").alias("channels"), F.when(key % 3 == 0, "5.1").alias("channel_layout"), F.lit("ac3").alias("codec_name"),
        F.when(key % 2 == 0, F.when(key % 7 == 0, "n/a").otherwise((key % 1000 / 8).cast("string"))).alias("duration"),
    )
    whole = F.struct(F.lit("eac3").alias("format_name"), F.when(key % 7 == 0, "n/a").otherwise((key % 1000 / 8).cast("string")).alias("duration"))
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.to_json(F.struct(F.array(stream).alias("streams"), whole.alias("format"))).alias("probe"))
    return layouts.of_probe_json(rows).drop("probe")


# ---- compact reports, files and streams -----------------------------------------------------------------------------

_NAME = "CASE channel WHEN 0 THEN 'Left' ELSE 'Right' END"
_DB = "printf('%.2f', 20 * log10({0})) || ' dB'".format
_DIAGNOSTICS = f"""'| Channel | RMS (20 %) | Peak (taken) | Primary | Secondary |' || chr(10) || '| --- | --- | --- | --- | --- |' || chr(10)
    || string_agg('| ' || {_NAME} || ' | ' || {_DB("rms")} || ' | ' || {_DB("peak")} || ' | ' || {_DB("primary_peak")} || ' | ' || {_DB("secondary_peak")} || ' |', chr(10) ORDER BY channel)"""


@query(f"{_windows(EMBEDDINGS)} SELECT track_id, {_DIAGNOSTICS} AS \"table\" FROM dr GROUP BY track_id")
def diagnostics_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.diagnostics_tables(tracks.with_exclusions(channels.channel_dr(adapters.samples_of_embeddings(spark, sf_dir), RATE)))


def _formats(found: DataFrame) -> DataFrame:
    return found.groupBy("track_id").agg(F.lit(RATE).alias("sample_rate"), F.max("sample_count").alias("sample_count"), F.count("*").alias("channels"), F.lit("WAV/PCM").alias("codec"))


@query(f"""{_windows(EMBEDDINGS)}, {_tracks(False)}, p AS (SELECT track_id, '| Channel | DR | Peak |' || chr(10) || '| --- | --- | --- |' || chr(10)
    || string_agg('| ' || {_NAME} || ' | ' || printf('%.2f', dr_value) || ' dB | ' || {_DB("peak")} || ' |', chr(10) ORDER BY channel) AS levels, {_DIAGNOSTICS} AS diagnostics, max(sample_count) // {RATE} AS sec, count(*) AS n FROM dr GROUP BY track_id)
    SELECT track_id, concat_ws(chr(10) || chr(10), 'crestline 0.1.0 | DR' || official_dr || ' (' || printf('%.2f', precise_dr) || ' dB)' || chr(10) || track_id || ' | '
    || CASE WHEN sec >= 3600 THEN printf('%d:%02d:%02d', sec // 3600, sec % 3600 // 60, sec % 60) ELSE printf('%d:%02d', sec // 60, sec % 60) END || ' | {RATE} Hz | ' || n || 'ch | WAV/PCM', levels, diagnostics, '[!] ' || {_WARNING}) AS report FROM p JOIN t USING (track_id)""")
def compact_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tracks.with_exclusions(channels.channel_dr(adapters.samples_of_embeddings(spark, sf_dir), RATE))
    return report.compact_reports(found, tracks.track_dr(found), _formats(found), diagnostics=True)


@query(f"""{_trim(EVENTS, TRIM_DB)}, c AS (SELECT track_id, sum(CASE WHEN drop_all THEN length ELSE drop_first END)::BIGINT AS cut FROM t GROUP BY ALL),
    {_windows(EVENTS).removeprefix(f"WITH {EVENTS},")}, q AS (SELECT track_id, count(*) FILTER (20 * log10(greatest(rms, 1e-12)) < {SILENCE_DB}) AS gone, count(*) AS n FROM w GROUP BY ALL)
    SELECT track_id, concat_ws(chr(10), printf('Edge trimming: %d.%d s removed', (cut + 5) // 10 // 10, (cut + 5) // 10 % 10),
    CASE WHEN n > 0 THEN printf('Silence filter: %d/%d windows (%.1f %%)', gone, n, round(100.0::DOUBLE * gone / n, 1)) END) AS notes FROM c LEFT JOIN q USING (track_id)""")
def run_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = adapters.samples_of_events(spark, sf_dir)
    formats = samples.select("track_id", F.lit(RATE).alias("sample_rate")).distinct()
    return report.run_notes(formats, trim.trim_report(_trim_runs(spark, sf_dir)), windows.silence_report(windows.windows(samples, RATE), SILENCE_DB))


@query(f"{_PRECISE} SELECT event_id, {_WARNING} AS warning FROM (SELECT *, {_risk('official_dr', 'precise_dr')} FROM e)")
def boundary_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _precise(spark, sf_dir)
    return rows.select(F.col("track_id").cast("long").alias("event_id"), levels.boundary_warning(F.col("official_dr"), F.col("precise_dr")).alias("warning"))


@query("""SELECT o_orderkey, ['S8', 'U8', 'S16', 'U16', 'S24', 'U24', 'S32', 'U32', 'F32', 'F64', 'ADPCM'][o_orderkey % 11 + 1] AS format, [8, 8, 16, 16, 24, 24, 32, 32, 32, 64, NULL][o_orderkey % 11 + 1]::INT AS bits,
    CASE WHEN o_orderkey % 11 < 10 THEN o_orderkey % 11 >= 8 END AS floating, CASE WHEN o_orderkey % 11 < 10 THEN o_orderkey % 11 >= 8 OR o_orderkey % 11 % 2 = 0 END AS signed FROM orders""")
def sample_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [*(name for name, *_ in pcm.FORMATS), "ADPCM"]
    name = F.get(F.array(*map(F.lit, names)), (F.col("o_orderkey") % len(names)).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", name.alias("format"), pcm.format_properties(name).alias("p")).select("o_orderkey", "format", "p.*")


@query("""SELECT o_orderstatus, count(*) AS files, CASE WHEN bool_or(o_orderkey % 500 IN (7, 8)) THEN 'One-bit files are converted to 352800 Hz' END AS dsd_note FROM orders GROUP BY ALL""")
def batch_header(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One batch per order status."""
    key = F.col("o_orderkey") % 500
    rows = table(spark, sf_dir, "orders").select("o_orderstatus", F.concat(F.lit("a."), F.when(key == 7, "DSF").when(key == 8, "dff").otherwise("wav")).alias("file_name"))
    out = [report.batch_header(rows.where(F.col("o_orderstatus") == s)).select(F.lit(s).alias("o_orderstatus"), "files", "dsd_note") for s in ("F", "O", "P")]
    return reduce(DataFrame.unionByName, out).where("files > 0")


#: Vectors of a file, and samples of a FLAC frame: small, so that the tables make several files of several frames.
FILE_VECTORS, FLAC_BLOCK = 200, 192
#: So many times these ids are made into files together.
TRACKS_IDS = 4


def _files(rows: pd.DataFrame) -> pd.DataFrame:
    """A track as WAV and FLAC of 16 bits and two channels, from its vectors one after the other."""
    flat = np.concatenate(rows.sort_values("vec_id")["embedding"].to_list()).astype(np.float64)
    codes = np.trunc(np.clip(flat, -1, 1) * 32767).astype(np.int64).reshape(-1, 2)
    raw = codes.astype("<i2").tobytes()
    form = struct.pack("<HHIIHH", 1, 2, RATE, RATE * 4, 4, 16)
    body = b"WAVEfmt " + struct.pack("<I", len(form)) + form + b"data" + struct.pack("<I", len(raw)) + raw
    name = rows["name"].iloc[0]
    return pd.DataFrame({"name": [f"{name}.wav", f"{name}.flac"], "content": [b"RIFF" + struct.pack("<I", len(body)) + body, flac.encode(codes.T, RATE, 16, FLAC_BLOCK)]})


def _audio_folder(spark: SparkSession, sf_dir: str) -> str:
    """Vectors written as audio files, FILE_VECTORS ids a label and file, by the sink of named files."""
    folder = fresh(spark, "audio-files")
    sink.write_files(_track_files(spark, sf_dir, _files), folder)
    return folder


_FILES = f"""s AS (SELECT name AS track_id, (k % 2)::INT AS channel, k // 2 AS frame_idx, trunc(least(greatest(x, -1), 1) * 32767) / 32768 AS sample
    FROM (SELECT name, row_number() OVER (PARTITION BY name ORDER BY vec_id, pos) - 1 AS k, x::DOUBLE AS x
        FROM (SELECT label || '-' || vec_id // {FILE_VECTORS} AS name, vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)))"""


def _window_sql(ending: str) -> str:
    wanted = f"{_windows(_FILES)} SELECT track_id || '.{ending}' AS path, channel, win, n, {_R('rms')}, {_R('peak')} FROM raw_levels"
    return wanted.replace("whole AS (", "raw_levels AS (SELECT *, sqrt(2 * sum_sq / n) AS rms FROM raw), whole AS (")


def _format_sql(ending: str, codec: str) -> str:
    return f"""WITH {_FILES} SELECT track_id || '.{ending}' AS path, {RATE}::INT AS sample_rate, 2::INT AS channels, 16::INT AS bits_per_sample, max(frame_idx) + 1 AS sample_count,
        max(frame_idx) + 1 AS actual_frames, '{codec}' AS codec, 0::BIGINT AS skipped_packets, false AS is_partial FROM s GROUP BY track_id"""


def _windows_read(spark: SparkSession, sf_dir: str, ending: str) -> DataFrame:
    """Windows of files read by ranges of a few thousand bytes; the parts of a window add up."""
    ranges.register(spark)
    found = spark.read.format("audio_windows").option("share", "3000").option("extensions", ending).load(_audio_folder(spark, sf_dir)).where("win IS NOT NULL")
    found = found.groupBy(describe.file_name(F.col("path")).alias("path"), "channel", "win").agg(F.sum("n").alias("n"), F.sum("sum_sq").alias("sum_sq"), F.max("peak").alias("peak"))
    return found.withColumn("rms", F.sqrt(2 * F.col("sum_sq") / F.col("n"))).select("path", "channel", "win", "n", *rounded("rms", "peak"))


def _formats_read(spark: SparkSession, sf_dir: str, ending: str) -> DataFrame:
    found, _ = files.analyse(spark, _audio_folder(spark, sf_dir))
    names = ["sample_rate", "channels", "bits_per_sample", "sample_count", "actual_frames", "codec", "skipped_packets", "is_partial"]
    return found.where(F.col("path").endswith(f".{ending}")).select(describe.file_name(F.col("path")).alias("path"), *names)


@query(_window_sql("wav"))
def wav_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows_read(spark, sf_dir, "wav")


@query(_window_sql("flac"))
def flac_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _windows_read(spark, sf_dir, "flac")


@query(_format_sql("wav", "WAV/PCM"))
def wav_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _formats_read(spark, sf_dir, "wav")


@query(_format_sql("flac", "FLAC"))
def flac_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _formats_read(spark, sf_dir, "flac")


@query(f"{_windows(_FILES)} SELECT track_id || ending AS path, channel, {_R('dr_value')}, {_R('rms')}, {_R('peak')}, sample_count FROM dr, (VALUES ('.wav'), ('.flac')) k(ending)")
def audio_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From files to ranges of channels."""
    _, found = files.analyse(spark, _audio_folder(spark, sf_dir))
    return found.select(describe.file_name(F.col("track_id")).alias("path"), "channel", *rounded("dr_value", "rms", "peak"), "sample_count")


def _tracks_files(spark: SparkSession, sf_dir: str, make: Callable[[list[pd.DataFrame]], pd.DataFrame]) -> DataFrame:
    """name, content of files made of tracks, those of FILE_VECTORS * TRACKS_IDS ids at a time: each has its name and vectors."""
    rows = table(spark, sf_dir, "embeddings").select(F.concat_ws("-", "label", F.expr(f"vec_id div {FILE_VECTORS}")).alias("name"), "vec_id", "embedding")
    made = lambda some: make([track.sort_values("vec_id") for _, track in some.groupby("name")])
    return rows.groupBy(F.expr(f"vec_id div {FILE_VECTORS * TRACKS_IDS}")).applyInPandas(made, "name string, content binary")


def _track_files(spark: SparkSession, sf_dir: str, make: Callable[[pd.DataFrame], pd.DataFrame]) -> DataFrame:
    return _tracks_files(spark, sf_dir, lambda some: pd.concat([make(track) for track in some]))


def _one_bit(rows: pd.DataFrame) -> pd.DataFrame:
    """The signs of a track's vectors, one after the other, as a one-bit file of one channel; a rest of fewer than eight is
    not kept."""
    flat = np.concatenate(rows.sort_values("vec_id")["embedding"].to_list())
    signs = (flat[: len(flat) // 8 * 8] >= 0).astype(np.uint8)[None]
    name = rows["name"].iloc[0]
    return pd.DataFrame({"name": [f"{name}.dsf", f"{name}.dff"], "content": [dsd.write_dsf(signs, 8 * RATE, block=64), dsd.write_dff(signs, 8 * RATE)]})


#: At this clock a sample is a byte's, and the low-pass that of the rate.
_PLAN = dsd.Plan(rate=RATE)
_TAPS = [float(x) for x in dsd.taps(0.45 / 8, 8 * dsd.SPAN, _PLAN.gain_db)]


@query(f"""WITH g AS (SELECT label || '-' || vec_id // {FILE_VECTORS} AS name, vec_id, embedding FROM embeddings),
    b AS MATERIALIZED (SELECT name, row_number() OVER (PARTITION BY name ORDER BY vec_id, pos) - 1 AS k, CASE WHEN x >= 0 THEN 1.0::DOUBLE ELSE -1.0 END AS bit
        FROM (SELECT name, vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM g)),
    h AS (SELECT unnest({_TAPS}) AS weight, generate_subscripts({_TAPS}, 1) - 1 AS j),
    f AS (SELECT name, (k - j + {4 * (dsd.SPAN - 1) // 8 * 8}) // 8 AS frame, sum(bit * weight) AS sample FROM b, h WHERE (k - j + {4 * (dsd.SPAN - 1) // 8 * 8}) % 8 = 0 AND k - j + {4 * (dsd.SPAN - 1) // 8 * 8} >= 0 GROUP BY ALL),
    w AS (SELECT name, frame // {FRAMES} AS win, count(*) AS n, sum(sample * sample) AS sum_sq, max(abs(sample)) AS peak FROM f WHERE frame < (SELECT count(*) // 8 FROM b WHERE b.name = f.name) GROUP BY ALL)
    SELECT name || ending AS path, 0::INT AS channel, win, n, round(sqrt(2 * sum_sq / n), 4) + 0.0 AS rms, round(peak, 4) + 0.0 AS peak FROM w, (VALUES ('.dsf'), ('.dff')) k(ending)""")
def dsd_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One-bit files read by ranges of a few hundred bytes, with the bytes around them that the filter needs."""
    ranges.register(spark)
    folder = fresh(spark, "one-bit-files")
    sink.write_files(_track_files(spark, sf_dir, _one_bit), folder)
    found = spark.read.format("audio_windows").option("share", "300").option("dsd_rate", str(RATE)).load(folder).where("win IS NOT NULL")
    rms = F.round(F.sqrt(2 * F.col("sum_sq") / F.col("n")), 4).alias("rms")
    return found.select(describe.file_name(F.col("path")).alias("path"), "channel", "win", "n", rms, F.round("peak", 4).alias("peak"))


def _packed(rows: pd.DataFrame) -> pd.DataFrame:
    """A track's vectors as packets of an MP4 file: of each the first 8 to 32 pairs of samples, as 16 bits."""
    rows = rows.sort_values("vec_id")
    frames = [int(8 + v % 25) for v in rows["vec_id"]]
    payload = [np.trunc(np.clip(np.asarray(x, np.float64)[: 2 * n], -1, 1) * 32767).astype("<i2").tobytes() for x, n in zip(rows["embedding"], frames, strict=True)]
    return pd.DataFrame({"name": [f"{rows['name'].iloc[0]}.m4a"], "content": [mp4.write_mp4(b"sowt", payload, frames, RATE, 2, 16, front=len(rows) % 2 == 0)]})


@query(f"""WITH g AS (SELECT label || '-' || vec_id // {FILE_VECTORS} AS name, vec_id, 8 + vec_id % 25 AS n_frames, list_transform(embedding[1:2 * (8 + vec_id % 25)], lambda x: trunc(least(greatest(x::DOUBLE, -1), 1) * 32767)::INT) AS codes FROM embeddings)
    SELECT name || '.m4a' AS path, 'WAV/PCM' AS codec, {RATE}::INT AS sample_rate, 2::INT AS channels, row_number() OVER o - 1 AS seq, ((sum(n_frames) OVER o) - n_frames)::BIGINT AS first_frame, n_frames, 4 * n_frames AS length,
    array_to_string(list_transform(codes, lambda c: printf('%02x%02x', c & 255, (c >> 8) & 255)), '') AS payload FROM g WINDOW o AS (PARTITION BY name ORDER BY vec_id)""")
def mp4_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets of written MP4 files: their places from the files' tables, then the bytes there."""
    folder = fresh(spark, "mp4-files")
    sink.write_files(_track_files(spark, sf_dir, _packed), folder)
    found = mp4.payloads(mp4.packet_table(spark, folder))
    return found.select(describe.file_name(F.col("path")).alias("path"), "codec", "sample_rate", "channels", "seq", "first_frame", "n_frames", "length", F.lower(F.hex("payload")).alias("payload"))


_ALAC = alac.Config(FLAC_BLOCK, 16, 40, 10, 14, 2, RATE)


def _lossless(some: list[pd.DataFrame]) -> pd.DataFrame:
    """Tracks' vectors as ALAC packets of MP4 files; the samples are those of the other audio files."""
    flat = [np.concatenate(rows["embedding"].to_list()).astype(np.float64) for rows in some]
    codes = [np.trunc(np.clip(x, -1, 1) * 32767).astype(np.int64).reshape(-1, 2).T for x in flat]
    content = []
    for x, payload in zip(codes, alac.encode_each(codes, _ALAC), strict=True):
        ticks = [min(FLAC_BLOCK, x.shape[1] - a) for a in range(0, x.shape[1], FLAC_BLOCK)]
        content.append(mp4.write_mp4(b"alac", payload, ticks, RATE, 2, 16, mp4.box(b"alac", bytes(4), _ALAC.packed())))
    return pd.DataFrame({"name": [f"{rows['name'].iloc[0]}.m4a" for rows in some], "content": content})


@query(f"""{_windows(_FILES)} SELECT track_id || '.m4a' AS path, channel, {_R('dr_value')}, {_R('rms')}, {_R('peak')}, sample_count, {RATE}::INT AS sample_rate, 'ALAC' AS codec, 0::BIGINT AS skipped_packets FROM dr""")
def alac_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From ALAC in MP4 files to ranges of channels, with what the files say of themselves."""
    folder = fresh(spark, "alac-files")
    sink.write_files(_tracks_files(spark, sf_dir, _lossless), folder)
    known, found = files.analyse(spark, folder)
    found = found.join(known.select(F.col("path").alias("track_id"), "sample_rate", "codec", "skipped_packets"), "track_id")
    return found.select(describe.file_name(F.col("track_id")).alias("path"), "channel", *rounded("dr_value", "rms", "peak"), "sample_count", "sample_rate", "codec", "skipped_packets")


def _paged(rows: pd.DataFrame) -> pd.DataFrame:
    """A track's vectors as packets of 224 to 256 bytes on Ogg pages of at most seven segments, and its samples as FLAC in Ogg."""
    rows = rows.sort_values("vec_id")
    vectors = [np.trunc(np.clip(np.asarray(x, np.float64), -1, 1) * 32767).astype(np.int64) for x in rows["embedding"]]
    payload = [x.astype("<i4").tobytes()[: int(224 + 4 * (v % 9))] for x, v in zip(vectors, rows["vec_id"], strict=True)]
    head = b"OpusHead" + struct.pack("<BBHIhB", 1, 2, 312, RATE, 0, 0)
    codes, name = np.concatenate(vectors).reshape(-1, 2).T, rows["name"].iloc[0]
    whole = ogg.write_ogg([head, *payload], [0, *(312 + 960 * (k + 1) for k in range(len(payload)))], int(rows["vec_id"].iloc[0]), segments=7)
    return pd.DataFrame({"name": [f"{name}.opus", f"{name}.ogg"], "content": [whole, ogg.write_flac(codes, RATE, 16, FLAC_BLOCK, segments=9)]})


def _ogg_folder(spark: SparkSession, sf_dir: str) -> str:
    folder = fresh(spark, "ogg-files")
    sink.write_files(_track_files(spark, sf_dir, _paged), folder)
    return folder


@query(f"""WITH g AS (SELECT label || '-' || vec_id // {FILE_VECTORS} AS name, vec_id, 224 + 4 * (vec_id % 9) AS length, list_transform(embedding, lambda x: trunc(least(greatest(x::DOUBLE, -1), 1) * 32767)::INT) AS codes FROM embeddings),
    h AS (SELECT *, codes[1] & 255 AS toc, (codes[1] >> 8) & 255 AS second FROM g)
    SELECT name || '.opus' AS path, row_number() OVER o AS seq, length, false AS failed,
    (CASE WHEN toc >> 3 < 12 THEN [480, 960, 1920, 2880][(toc >> 3) % 4 + 1] WHEN toc >> 3 < 16 THEN [480, 960][(toc >> 3) % 2 + 1] ELSE [120, 240, 480, 960][(toc >> 3) % 4 + 1] END * CASE toc & 3 WHEN 0 THEN 1 WHEN 3 THEN second & 63 ELSE 2 END)::INT AS samples,
    array_to_string(list_transform(codes[1:length // 4], lambda c: printf('%02x%02x%02x%02x', c & 255, (c >> 8) & 255, (c >> 16) & 255, (c >> 24) & 255)), '') AS payload,
    (960 * count(*) OVER (PARTITION BY name))::BIGINT AS sample_count FROM h WINDOW o AS (PARTITION BY name ORDER BY vec_id)""")
def ogg_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets of written Ogg files: pages found by ranges of 3,000 bytes, packets put together over page borders, lengths of
    streams from their last pages."""
    pages = written(ogg.page_table(spark, _ogg_folder(spark, sf_dir), share=3000, extensions=("opus",)), "ogg-pages")
    found = ogg.payloads(ogg.packets(pages)).where("seq > 0").join(ogg.stream_table(pages).select("path", "sample_count"), "path")
    return found.select(describe.file_name(F.col("path")).alias("path"), "seq", "length", "failed", ogg.opus_samples(F.col("payload")).alias("samples"), F.lower(F.hex("payload")).alias("payload"), "sample_count")


@query(f"""{_windows(_FILES)} SELECT track_id || '.ogg' AS path, channel, {_R('dr_value')}, {_R('rms')}, {_R('peak')}, sample_count, {RATE}::INT AS sample_rate, 'FLAC' AS codec FROM dr
    UNION ALL BY NAME SELECT DISTINCT label || '-' || vec_id // {FILE_VECTORS} || '.opus' AS path, 'DecodingError' AS error_kind FROM embeddings""")
def ogg_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From FLAC in Ogg to ranges of channels; files of a codec without a decoder are rows with an error."""
    known, found = files.analyse(spark, _ogg_folder(spark, sf_dir))
    found = known.select(F.col("path").alias("track_id"), "sample_rate", "codec", "error_kind").join(found, "track_id", "left")
    return found.select(describe.file_name(F.col("track_id")).alias("path"), "channel", *rounded("dr_value", "rms", "peak"), "sample_count", "sample_rate", "codec", "error_kind")


def _streamed(packets: DataFrame, make: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Writes packets in two halves, each by track, streams the files, some a batch, and reads what the stream wrote; numbers
    arrive out of order."""
    spark = packets.sparkSession
    place = fresh(spark, "stream")
    for half in (1, 0):
        packets.where(F.col("seq") % 2 == half).repartition("track_id").write.mode("append").parquet(f"{place}/in")
    source = spark.readStream.schema(packets.schema).option("maxFilesPerTrigger", 8).parquet(f"{place}/in")
    running = make(source).writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    running.awaitTermination()
    return spark.read.parquet(f"{place}/out")


def _stream_packets(rows: DataFrame, *by: str) -> DataFrame:
    from pyspark.sql import Window

    track = Window.partitionBy(*by)
    numbered = rows.withColumn("seq", (F.row_number().over(track.orderBy("vec_id")) - 1).cast("long"))
    return numbered.withColumn("last", F.col("seq") == F.max("seq").over(track)).select("track_id", "channel", "seq", F.col("embedding").alias("samples"), "last")


def _growing(spark: SparkSession, sf_dir: str, read: Callable[[DataFrame, str], object]) -> str:
    """Audio files that are streamed twice: when the WAV files have half their bytes, and when all are there and closed."""
    place = fresh(spark, "audio-stream")
    made = written(_track_files(spark, sf_dir, _files), "audio-bytes")
    halves = made.where("name LIKE '%.wav'").select("name", F.expr("substring(content, 1, length(content) div 2)").alias("content"))
    for rows, settle in ((halves, 86400.0), (made, 0.0)):
        sink.write_files(rows, f"{place}/in")
        read(audio.audio_stream(spark, f"{place}/in", f"{place}/log", settle=settle, share=3000), place).awaitTermination()
    return place


@query(" UNION ALL BY NAME ".join(f"SELECT * FROM ({_window_sql(ending)})" for ending in ("wav", "flac")))
def streamed_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of files that grow while they are streamed: each comes once."""
    place = _growing(spark, sf_dir, lambda f, p: f.writeStream.format("parquet").option("path", f"{p}/out").option("checkpointLocation", f"{p}/state").trigger(availableNow=True).start())
    found = spark.read.parquet(f"{place}/out").where("win IS NOT NULL").withColumn("rms", F.sqrt(2 * F.col("sum_sq") / F.col("n")))
    return found.select(describe.file_name(F.col("path")).alias("path"), "channel", "win", "n", *rounded("rms", "peak"))


@query(ORACLES["audio_analysis"])
def followed_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges of channels, each reported once, as files close."""
    found = spark.read.parquet(f"{_growing(spark, sf_dir, audio.follow)}/channels")
    return found.select(describe.file_name(F.col("track_id")).alias("path"), "channel", *rounded("dr_value", "rms", "peak"), "sample_count")


@query(f"{_windows(EMBEDDINGS)} SELECT track_id, channel, win, n, {_R('rms')}, {_R('peak')} FROM w")
def streamed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").withColumn("track_id", F.col("label").cast("string")).withColumn("channel", F.pmod("vec_id", F.lit(2)).cast("int"))
    found = _streamed(_stream_packets(rows, "track_id", "channel"), lambda f: signals.stream_windows(f, RATE))
    return found.select("track_id", "channel", "win", "n", *rounded("rms", "peak"))


_STEREO = """s AS (SELECT label::VARCHAR AS track_id, (k % 2)::INT AS channel, k // 2 AS frame_idx, x AS sample
    FROM (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id, pos) - 1 AS k, x::DOUBLE AS x FROM (SELECT label, vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings)))"""


@query(f"""{_trim(_STEREO, STREAM_TRIM_DB)}, kept AS (SELECT s.track_id, s.channel, s.frame_idx, s.sample FROM s JOIN t ON s.track_id = t.track_id AND s.frame_idx >= t.first_frame + t.drop_first AND s.frame_idx < t.first_frame + t.length AND NOT drop_all)
    SELECT track_id, channel, dense_rank() OVER (PARTITION BY track_id ORDER BY frame_idx) - 1 AS frame_idx, round(sample, 6) + 0.0 AS sample FROM kept""")
def streamed_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interleaved stereo packets, trimmed as they arrive."""
    rows = table(spark, sf_dir, "embeddings").withColumn("track_id", F.col("label").cast("string")).withColumn("channel", F.lit(0))
    found = _streamed(_stream_packets(rows, "track_id"), lambda f: signals.stream_trimmed(f, 10 ** (STREAM_TRIM_DB / 20), MIN_RUN, HYSTERESIS, channels=2))
    return found.withColumn("sample", F.col("sample").cast("double")).select("track_id", "channel", "frame_idx", *rounded("sample"))
