"""Reports: JSON and text, one row per track; sinks write them in parallel, small ones can be joined into one file."""

from __future__ import annotations

import unicodedata
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crestline.constants import DSD_RATE, REPORT_SILENT
from crestline.functions import describe, levels
from crestline.operators import batches
from crestline.sources import sink

TOOL, VERSION = "crestline", "0.1.0"


def _channel_struct() -> Column:
    return F.struct("channel", "text")


def _json_channel(exclude_lfe: bool) -> Column:
    db = lambda x: F.when(F.col(x) > 0, F.round(20 * F.log10(x), 6))  # noqa: E731  JSON has no infinity: null
    silent = (F.col("peak") <= REPORT_SILENT) | (F.col("rms") <= REPORT_SILENT)
    return F.struct(
        (F.col("channel") + 1).alias("channel"),
        levels.rounded(F.col("dr_value")).alias("drOfficial"),
        F.round("dr_value", 6).alias("drPrecise"),
        db("peak").alias("peakDb"),
        db("rms").alias("rmsDb"),
        silent.alias("isSilent"),
        F.col("is_listed").alias("isLfe"),
        (silent | (F.lit(exclude_lfe) & F.col("is_listed"))).alias("isExcluded"),
    )


def json_reports(channels: DataFrame, tracks: DataFrame, exclude_lfe: bool = False, formats: DataFrame | None = None) -> DataFrame:
    """track_id, report: one JSON object per track, without a time stamp, so that equal inputs give equal reports. formats
    (track_id, sample_rate, channels, bits_per_sample, codec, sample_count, lfe_indices, a row a track) fills the format
    block, and says which channels are low-frequency ones: here only those listed count. Without it the block is null and
    is_lfe of the channel rows counts."""
    if formats is None:
        known, listed, block = channels, F.col("is_lfe"), F.lit(None).cast("struct<sampleRate: int>")
    else:
        known = channels.join(formats.select("track_id", "lfe_indices"), "track_id")
        listed = F.coalesce(F.array_contains("lfe_indices", F.col("channel")), F.lit(False))
        block = F.struct(
            F.col("sample_rate").alias("sampleRate"),
            F.col("format_channels").alias("channels"),
            F.col("bits_per_sample").alias("bitsPerSample"),
            F.coalesce("codec", F.lit("Unknown")).alias("codec"),
            F.round(F.col("sample_count") / F.col("sample_rate"), 6).alias("durationSeconds"),
        )
    rows = known.withColumn("is_listed", listed).groupBy("track_id").agg(F.array_sort(F.collect_list(_json_channel(exclude_lfe))).alias("channels"))
    rows = rows.join(tracks, "track_id")
    if formats is not None:
        rows = rows.join(formats.select("track_id", "sample_rate", F.col("channels").alias("format_channels"), "bits_per_sample", "codec", "sample_count"), "track_id")
    risk = F.struct(F.lower("risk_level").alias("level"), F.lower("direction").alias("direction"), F.round("distance_db", 6).alias("distanceDb"))
    whole = F.struct(
        F.lit(TOOL).alias("tool"),
        F.lit(VERSION).alias("version"),
        F.col("track_id").alias("filePath"),
        block.alias("format"),
        F.col("official_dr").alias("officialDr"),
        F.round("precise_dr", 6).alias("preciseDr"),
        F.when(F.col("risk_level").isNotNull(), risk).alias("boundaryWarning"),
        F.lit(exclude_lfe).alias("excludeLfe"),
        F.col("channels"),
    )
    return rows.select("track_id", F.to_json(whole, {"ignoreNullFields": "false"}).alias("report"))


def text_reports(channels: DataFrame, tracks: DataFrame) -> DataFrame:
    """track_id, report: a Markdown table per track, then the official value and a warning, if there is one."""
    n = F.count("*").over(_by_track())
    note = describe.channel_note(F.col("is_lfe"), F.col("is_silent"))
    line = F.concat_ws(
        " | ",
        describe.channel_name(F.col("channel"), n),
        F.format_string("%.2f dB", "dr_value"),
        levels.linear_to_db_text(F.col("rms")),
        levels.linear_to_db_text(F.col("peak")),
        note,
    )
    lines = channels.withColumn("text", F.concat(F.lit("| "), line, F.lit(" |")))
    table = lines.groupBy("track_id").agg(F.array_sort(F.collect_list(_channel_struct())).alias("rows"))
    head = F.array(F.lit("| Channel | DR | RMS | Peak | Note |"), F.lit("| --- | --- | --- | --- | --- |"))
    official = F.when(F.col("official_dr").isNotNull(), F.format_string("Official DR: DR%d (%.2f dB)", "official_dr", "precise_dr")).otherwise(F.lit("Official DR: -"))
    warning = levels.boundary_warning(F.col("official_dr"), F.col("precise_dr"))
    body = F.concat_ws("\n", head, F.transform("rows", lambda r: r["text"]), F.array(official), F.array_compact(F.array(warning)))
    return table.join(tracks, "track_id").select("track_id", body.alias("report"))


def _table(channels: DataFrame, head: Column, line: Column) -> DataFrame:
    """track_id, table: a Markdown table per track, a row per channel in their order; head may depend on the number of
    channels, n."""
    lines = channels.withColumn("n", F.count("*").over(_by_track())).withColumn("text", F.concat(F.lit("| "), line, F.lit(" |"))).withColumn("head", head)
    rows = lines.groupBy("track_id").agg(F.first("head").alias("head"), F.array_sort(F.collect_list(_channel_struct())).alias("rows"))
    return rows.select("track_id", F.concat_ws("\n", "head", F.transform("rows", lambda r: r["text"])).alias("table"))


def _decibels(level: str) -> Column:
    return F.concat(levels.linear_to_db_text(F.col(level)), F.lit(" dB"))


def diagnostics_tables(channels: DataFrame) -> DataFrame:
    """track_id, table: level of the loudest fifth, the peak taken, and both peaks it was taken from."""
    note = describe.channel_note(F.col("is_lfe"), F.col("is_silent"))
    name = F.concat(describe.channel_name(F.col("channel"), F.col("n")), F.when(note != "", F.concat(F.lit(" ["), note, F.lit("]"))).otherwise(""))
    line = F.concat_ws(" | ", name, *map(_decibels, ("rms", "peak", "primary_peak", "secondary_peak")))
    return _table(channels, F.lit("| Channel | RMS (20 %) | Peak (taken) | Primary | Secondary |\n| --- | --- | --- | --- | --- |"), line)


def run_notes(formats: DataFrame, trims: DataFrame | None = None, silence: DataFrame | None = None) -> DataFrame:
    """track_id, notes: what trimming (a trim_report) and the silence filter (a silence_report) took from each track of
    formats (track_id, sample_rate), and, where formats has is_partial and skipped_packets, that a track was not read
    whole; empty where nothing of this holds or no window was there to filter."""
    marked = "is_partial" in formats.columns
    out = formats.select("track_id", "sample_rate", *(["is_partial", "skipped_packets"] if marked else []))
    trim_note = silence_note = partial_note = F.lit(None).cast("string")
    if marked:
        partial_note = F.when(F.col("is_partial"), F.format_string("Partial analysis: %d packets skipped", F.coalesce("skipped_packets", F.lit(0))))
    if trims is not None:
        out = out.join(trims.select("track_id", (F.col("leading_frames") + F.col("trailing_frames")).alias("cut")), "track_id", "left")
        trim_note = F.format_string("Edge trimming: %.1f s removed", F.round(F.col("cut") / F.col("sample_rate"), 1))
        trim_note = F.when(F.col("cut").isNotNull(), trim_note)
    if silence is not None:
        sums = silence.groupBy("track_id").agg(F.sum("filtered_windows").alias("filtered"), F.sum("total_windows").alias("total"))
        out = out.join(sums, "track_id", "left")
        silence_note = F.format_string("Silence filter: %d/%d windows (%.1f %%)", "filtered", "total", F.round(100.0 * F.col("filtered") / F.col("total"), 1))
        silence_note = F.when(F.col("total") > 0, silence_note)
    return out.select("track_id", F.concat_ws("\n", trim_note, silence_note, partial_note).alias("notes"))


def compact_reports(channels: DataFrame, tracks: DataFrame, formats: DataFrame, diagnostics: bool = False, notes: DataFrame | None = None) -> DataFrame:
    """track_id, report: two lines on the result and the format (track_id, sample_rate, sample_count, channels, codec), the
    channel table, then as far as asked for or present diagnostics, the boundary warning and run_notes. Tracks without an
    official value show DR0 (0.00 dB)."""
    short = F.col("n") <= 2
    note = describe.channel_note(F.col("is_lfe"), F.col("is_silent"))
    line = F.concat_ws(" | ", describe.channel_name(F.col("channel"), F.col("n")), F.format_string("%.2f dB", "dr_value"), _decibels("peak"), F.when(~short, note))
    head = F.when(short, F.lit("| Channel | DR | Peak |\n| --- | --- | --- |")).otherwise(F.lit("| Channel | DR | Peak | Note |\n| --- | --- | --- | --- |"))
    out = _table(channels, head, line).join(tracks, "track_id").join(formats.select("track_id", "sample_rate", "sample_count", "channels", "codec"), "track_id")
    official, precise = F.coalesce("official_dr", F.lit(0)), F.coalesce("precise_dr", F.lit(0.0))
    codec = F.coalesce("codec", describe.extension(F.col("track_id")))
    first = F.format_string(f"{TOOL} {VERSION} | DR%d (%.2f dB)", official, precise)
    second = F.format_string("%s | %s | %d Hz | %dch | %s", describe.file_name(F.col("track_id")), describe.duration_text(F.col("sample_count"), F.col("sample_rate")), "sample_rate", "channels", codec)
    parts = [F.concat(first, F.lit("\n"), second), F.col("table")]
    if diagnostics:
        out = out.join(diagnostics_tables(channels).withColumnRenamed("table", "diagnostics"), "track_id")
        parts.append(F.col("diagnostics"))
    parts.append(F.concat(F.lit("[!] "), levels.boundary_warning(F.col("official_dr"), F.col("precise_dr"))))
    if notes is not None:
        out = out.join(notes, "track_id", "left")
        parts.append(F.when(F.col("notes") != "", F.col("notes")))
    return out.select("track_id", F.concat_ws("\n\n", *parts).alias("report"))


def batch_header(results: DataFrame, dsd_rate: int = DSD_RATE) -> DataFrame:
    """One row: files, and a note on the conversion if any of them (by file_name) is a one-bit source."""
    some = F.coalesce(F.bool_or(describe.is_dsd(F.col("file_name"))), F.lit(False))
    return results.agg(F.count("*").alias("files"), F.when(some, f"One-bit files are converted to {dsd_rate} Hz").alias("dsd_note"))


def _by_track():  # noqa: ANN202
    from pyspark.sql import Window

    return Window.partitionBy("track_id")


def batch_rows(results: DataFrame) -> DataFrame:
    """idx, line of a batch table: official and precise value and the name, marked * for excluded low-frequency and † for
    silent channels; failures have dashes."""
    marks = F.concat(F.when(F.col("excluded_lfe") > 0, " *").otherwise(""), F.when(F.col("excluded_channels") - F.col("excluded_lfe") > 0, " †").otherwise(""))
    good = F.format_string("| %d | %.2f | %s%s |", "official_dr", "precise_dr", "file_name", F.coalesce(marks, F.lit("")))
    return results.select("idx", F.when(F.col("official_dr").isNull(), F.concat(F.lit("| - | - | "), F.col("file_name"), F.lit(" |"))).otherwise(good).alias("line"))


def batch_report(results: DataFrame, summary: DataFrame, groups: DataFrame, warnings: DataFrame) -> str:
    """The text of a whole batch. Only rendered lines reach the driver, in order, a partition at a time."""
    s = summary.first()
    out = [f"{TOOL} {VERSION}", f"Files: {s['processed'] + s['failed']}, processed {s['processed']}, failed {s['failed']} ({s['success_rate']:.1f} % succeeded)", *([note, ""] if (note := batch_header(results).first()["dsd_note"]) else [""]), "| Official | Precise | File |", "| --- | --- | --- |"]
    out += [r["line"] for r in batch_rows(results).orderBy("idx").toLocalIterator()]
    marks = batches.exclusion_flags(results.where("official_dr IS NOT NULL")).first()
    legend = " / ".join(text for text, some in (("*LFE excluded", marks["any_lfe"]), ("†Silent channels excluded", marks["any_silent"])) if some)
    out += ["", legend] if legend else []
    risky = [f"- {r['track_id']}: DR{r['official_dr']} ({r['precise_dr']:.2f} dB), {r['risk_level']} risk, may be DR{r['potential_dr']}" for r in warnings.toLocalIterator()]
    failed = [f"- {r['error_category']}: {r['failures']} ({r['file_names']}" + (f", +{r['more']} more)" if r["more"] else ")") for r in groups.toLocalIterator()]
    for title, lines in (("Boundary warnings", risky), ("Errors", failed)):
        if lines:
            out += ["", title, *lines]
    return "\n".join(out) + "\n"


def output_path(source: str) -> str:
    return str(Path(source).with_name(f"{Path(source).stem}_DR_Analysis.txt"))


def batch_path(directory: str, now: datetime | None = None) -> str:
    """Name of a batch report, by its directory and the UTC time."""
    return f"{directory.rstrip('/')}_BatchDR_{(now or datetime.now(UTC)).strftime('%Y%m%d_%H%M%S')}.txt"


def write_reports(reports: DataFrame, folder: str) -> None:
    """One `<stem>_DR_Analysis.txt` for each (track_id, report) in a folder, written by the tasks, all or none. Tracks of one
    stem from several places keep apart by their own folder's name."""
    stem, parent = describe.file_stem(F.col("track_id")), describe.parent_dir(F.col("track_id"))
    named = reports.withColumn("stem", stem).withColumn("parent", parent)
    shared = named.groupBy("stem").agg(F.count("*").alias("alike"))  # a row a stem; the join keeps reports where they are if it is small
    own = F.concat(F.regexp_replace(F.coalesce("parent", F.lit("")), "[^A-Za-z0-9._-]+", "_"), F.lit("/"))
    name = F.concat(F.when(F.col("alike") > 1, own).otherwise(""), F.col("stem"), F.lit("_DR_Analysis.txt"))
    sink.write_files(named.join(shared, "stem").select(name.alias("name"), F.col("report").cast("binary").alias("content")), folder)


def display_width(text: str) -> int:
    """Columns of a terminal: wide characters take two, combining ones none."""
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text)


def padded(text: str, width: int) -> str:
    return text + " " * max(0, width - display_width(text))


def padded_table(rows: list[list[str]]) -> str:
    widths = [max(map(display_width, column)) for column in zip(*rows, strict=True)]
    return "\n".join("| " + " | ".join(padded(c, w) for c, w in zip(row, widths, strict=True)) + " |" for row in rows)
