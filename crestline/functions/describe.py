"""Descriptions of tracks: names, durations, sizes, rates, paths, codecs, error categories."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from crestline.constants import COMPRESSED, DSD_EXTENSIONS, DSD_GAIN_DB, DSD_RATE, DSD_TIERS, ERRORS, EXTENSIONS, FORMAT_NAMES, HINTS


def file_name(path: Column) -> Column:
    """The part after the last slash; `Unknown` if there is none."""
    name = F.regexp_extract(path, r"([^/]*)/*$", 1)
    return F.when(name.isNull() | name.isin("", "..", "."), F.lit("Unknown")).otherwise(name)


def file_stem(path: Column) -> Column:
    """The name without its last extension; a leading dot belongs to the name."""
    name = file_name(path)
    return F.when(name == "Unknown", F.lit("audio")).otherwise(F.regexp_replace(name, r"(?<=.)\.[^.]*$", ""))


def extension(path: Column) -> Column:
    """Upper case, `Unknown` if there is none."""
    found = F.regexp_extract(file_name(path), r"(?<=.)\.([^.]*)$", 1)
    return F.when(found == "", F.lit("Unknown")).otherwise(F.upper(found))


def parent_dir(path: Column) -> Column:
    found = F.regexp_extract(path, r"^(.*?)/+[^/]+/*$", 1)
    return F.when(found != "", found).when(path.startswith("/"), F.lit("/")).otherwise(F.lit("."))


def sanitized(name: Column) -> Column:
    """Characters that some file system refuses, blanks, dots and control characters become underscores."""
    return F.regexp_replace(name, r'[<>:"/\\|?* .\x00-\x1f\x7f-\x9f]', "_")


def can_decode(path: Column) -> Column:
    return F.coalesce(F.lower(extension(path)).isin(*EXTENSIONS), F.lit(False))


def duration_text(frames: Column, rate: Column) -> Column:
    """H:MM:SS, or M:SS under an hour; fractions of a second are cut."""
    seconds = F.floor(frames / rate)
    h, m, s = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), seconds % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%d:%02d", m, s))


def pcm_bytes(frames: Column, channels: Column, bits: Column) -> Column:
    """Size as plain PCM, the largest long where that overflows."""
    product = F.try_multiply(F.try_multiply(frames.cast("long"), channels.cast("long")), F.floor(bits / 8).cast("long"))
    return F.coalesce(product, F.lit(9223372036854775807))


def compressed(codec: Column) -> Column:
    return F.coalesce(codec.isin(*COMPRESSED), F.lit(False))


def bitrate_kbps(codec: Column, bytes_: Column, frames: Column, rate: Column, channels: Column, bits: Column, dsd: Column, partial: Column) -> Column:
    """From size and duration for compressed codecs, from the format for PCM; null for one-bit and partial sources."""
    seconds = frames / rate
    real = F.when(seconds > 0, F.round(bytes_ * 8.0 / seconds / 1000).cast("long"))
    plain = F.floor(rate.cast("long") * channels * bits / 1000).cast("long")
    return F.when(~F.coalesce(dsd, F.lit(False)) & ~F.coalesce(partial, F.lit(False)), F.when(compressed(codec), real).otherwise(plain))


def channel_name(channel: Column, channels: Column) -> Column:
    return (
        F.when(channels == 1, F.lit("Mono"))
        .when(channels == 2, F.when(channel == 0, "Left").otherwise("Right"))
        .otherwise(F.concat(F.lit("Ch "), (channel + 1).cast("string")))
    )


def channel_note(is_lfe: Column, is_silent: Column) -> Column:
    """LFE comes before silence."""
    return F.when(is_lfe, "LFE").when(is_silent, "Silent").otherwise("")


def format_name(channels: Column) -> Column:
    out = F.lit("multichannel")
    for n, name in FORMAT_NAMES.items():
        out = F.when(channels == n, name).otherwise(out)
    return out


def error_category(kind: Column) -> Column:
    out = F.lit("Other")
    for name, category, _ in ERRORS:
        out = F.when(kind == name, category).otherwise(out)
    return out


def exit_code(kind: Column) -> Column:
    out = F.lit(1)
    for name, _, code in ERRORS:
        out = F.when(kind == name, code).otherwise(out)
    return F.when(kind.isNull(), 0).otherwise(out)


def error_hint(kind: Column) -> Column:
    """A line of advice for a kind of error; for formats also the list of those supported. Null without an error."""
    out = F.lit("check the input and the options")
    for name, hint in HINTS.items():
        text = f"{hint} ({', '.join(e.upper() for e in EXTENSIONS)})" if name == "FormatError" else hint
        out = F.when(kind == name, text).otherwise(out)
    return F.when(kind.isNotNull(), out)


def is_dsd(path: Column) -> Column:
    return F.lower(extension(path)).isin(*DSD_EXTENSIONS)


def frames_of_ms(ms: Column, rate: Column) -> Column:
    return F.ceil(ms / 1000.0 * rate).cast("long")


def hysteresis_ms(min_run_ms: Column) -> Column:
    return F.least(F.greatest(min_run_ms * 0.33, F.lit(50.0)), F.lit(200.0))


def parallel_degree(asked: Column, items: Column) -> Column:
    return F.least(F.least(F.greatest(asked, F.lit(1)), F.lit(16)), F.greatest(items, F.lit(1)))


def dsd_tier(native_hz: Column) -> Column:
    """The tier nearest to the rate over 44100; the lower one in a tie."""
    multiple = F.round(native_hz / 44100.0).cast("int")
    return F.array_min(F.array(*(F.struct(F.abs(multiple - t).alias("far"), F.lit(t).alias("tier")) for t in DSD_TIERS)))["tier"]


def dsd_cutoff_hz(mode: Column, tier: Column, rate: Column) -> Column:
    """Low-pass of the conversion from one bit: `teac` scales with the tier up to 0.45 of the rate, `studio` is fixed, `off`
    has none. Without a tier the fixed value is taken."""
    scaled = F.coalesce(39000.0 * F.greatest(tier, F.lit(64)) / 64, F.lit(20000.0))
    return F.when(F.lower(mode) == "off", None).when(F.lower(mode) == "teac", F.least(scaled, 0.45 * rate)).otherwise(F.lit(20000.0))


def dsd_filters(mode: Column, tier: Column, rate: Column | None = None, gain_db: Column | None = None) -> Column:
    """Filters of the conversion from one bit, comma-joined: the low-pass and the gain; neither of them is the empty text."""
    cutoff = dsd_cutoff_hz(mode, tier, F.lit(DSD_RATE) if rate is None else rate)
    gain = F.lit(DSD_GAIN_DB) if gain_db is None else gain_db.cast("double")
    lowpass = F.when(cutoff.isNotNull(), F.concat(F.lit("lowpass=f="), F.bround(cutoff).cast("long").cast("string")))
    volume = F.when(F.abs(gain) > 0.0001, F.concat(F.lit("volume="), F.regexp_replace(gain.cast("string"), r"\.0$", ""), F.lit("dB")))
    return F.concat_ws(",", lowpass, volume)


def opus_frames(bytes_: Column, rate: Column) -> Column:
    """Length estimate from a file's size; one minute where that would be absurd."""
    bits = F.when(bytes_ < 1_000_000, 128_000).when(bytes_ < 10_000_000, 256_000).otherwise(320_000)
    frames = F.floor(bytes_ * 8.0 / bits * rate).cast("long")
    return F.when((frames < 1000) | (frames > rate.cast("long") * 86400), rate.cast("long") * 60).otherwise(frames)


def mask_lfe(mask: Column) -> Column:
    """Indices of low-frequency channels (bits 0x8 and 0x800000) of a channel mask: set bits below each."""

    def index(bit: int) -> Column:
        return F.when(mask.bitwiseAND(F.lit(bit)) != 0, F.bit_count(mask.bitwiseAND(F.lit(bit - 1))))

    return F.array_compact(F.array(index(0x8), index(0x800000)))


def progress(done: Column, total: Column) -> Column:
    """Share of the work done; 0 while the total is not known."""
    return F.when(total > 0, done / total).otherwise(F.lit(0.0))


def sample_seconds(samples: Column, rate: Column, channels: Column) -> Column:
    """Duration of interleaved samples; 0 for an invalid format."""
    return F.when((rate > 0) & (channels > 0), samples / (rate * channels)).otherwise(F.lit(0.0))
