"""Schemas of the tables that operators exchange, and their validation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crestline.constants import BIT_DEPTHS, MAX_CHANNELS


#: As DDL, for readers, createDataFrame and mapInPandas.
TRACK_META = (
    "track_id STRING, path STRING, sample_rate INT, channels INT, bits_per_sample INT, sample_count BIGINT, codec STRING, "
    "processed_sample_rate INT, dsd_native_rate_hz INT, dsd_multiple_of_44k INT, has_channel_layout_metadata BOOLEAN, "
    "lfe_indices ARRAY<INT>, is_partial BOOLEAN, skipped_packets BIGINT"
)
SAMPLES = "track_id STRING, channel INT, frame_idx BIGINT, sample FLOAT"
PACKETS = "track_id STRING, seq BIGINT, n_frames BIGINT, samples ARRAY<FLOAT>"
BATCH_RESULTS = "idx INT, path STRING, file_name STRING, error_category STRING, official_dr INT, precise_dr DOUBLE"
BENCH_RUNS = "run INT, elapsed_ms DOUBLE, peak_memory_kb BIGINT, avg_memory_kb BIGINT, peak_cpu_percent DOUBLE, avg_cpu_percent DOUBLE, throughput_mb_per_sec DOUBLE"


def format_error(rate: Column, channels: Column, bits: Column) -> Column:
    """Why a format cannot be analysed; null if it can."""
    return (
        F.when(F.coalesce(rate, F.lit(0)) <= 0, F.lit("sample rate must be positive"))
        .when(~F.coalesce(channels, F.lit(0)).between(1, MAX_CHANNELS), F.lit(f"channels must be 1 to {MAX_CHANNELS}"))
        .when(~F.coalesce(bits, F.lit(0)).isin(*BIT_DEPTHS), F.lit("unsupported bit depth"))
    )


def check_options(**options: float | int | None) -> None:
    """Ranges of the analysis options; raises ValueError for one that is out of its range or unknown."""
    ranges = {
        "threads": (1, 16), "batch": (1, 256), "silence_db": (-120, 0), "trim_db": (-120, 0), "min_run_ms": (50, 2000), "dsd_gain_db": (-48, 48),
    }
    rates = (88_200, 176_400, 352_800, 384_000)
    for name, value in options.items():
        if value is None:
            continue
        if name == "dsd_rate":
            if value not in rates:
                raise ValueError(f"dsd_rate must be one of {rates}")
        elif name not in ranges:
            raise ValueError(f"unknown option {name}")
        elif not ranges[name][0] <= value <= ranges[name][1]:
            raise ValueError(f"{name} must be {ranges[name][0]} to {ranges[name][1]}")
