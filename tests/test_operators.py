"""Rules of the operators on hand-made inputs."""

import math
import random
import time

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from crestline.functions import describe, levels, pcm
from crestline.operators import batches, channels, layouts, packets, report, tracks, trim, windows
from crestline.schema import check_options, format_error


def samples(spark, tracks_):
    """{(track, channel): [samples]} as rows."""
    rows = [(t, c, i, float(x)) for (t, c), xs in tracks_.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "track_id string, channel int, frame_idx long, sample double")


def scalar(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def brute_dr(xs, frames, tail=True):
    found = []
    for a in range(0, len(xs), frames):
        part = xs[a : a + frames]
        if len(part) == frames or (tail and len(part) > 1):
            found.append((math.sqrt(2 * sum(x * x for x in part) / len(part)), max(0.0, *(abs(x) for x in part if not math.isnan(x)), 0.0)))
    bins = sorted((int(min(10000, 10000 * r)) for r, _ in found if r >= 0 and math.isfinite(r)), reverse=True)
    k = max(1, int(0.2 * len(bins)))
    rms = math.sqrt(sum(b * b for b in bins[:k]) * 1e-8 / k) if bins else 0.0
    peaks = sorted((p for _, p in found), reverse=True) or [0.0]
    first, second = peaks[0], peaks[1] if len(peaks) > 1 else peaks[0]
    peak = second if second > 0 else first
    return rms, first, second, peak, -20 * math.log10(rms / peak) if rms > 0 and peak > 0 else 0.0


def test_window_lengths():
    assert [windows.window_frames(r) for r in (44100, 48000, 96000, 192000)] == [132480, 144195, 288391, 576783]


def test_constant_window(spark):
    found = windows.windows(samples(spark, {("a", 0): [0.5] * 300}), 100).collect()
    assert len(found) == 1 and found[0]["peak"] == 0.5 and found[0]["rms"] == pytest.approx(0.5 * math.sqrt(2))


@pytest.mark.parametrize("extra,count", [(0, 2), (1, 2), (2, 3), (299, 3)])
def test_tails(spark, extra, count):
    signal = samples(spark, {("a", 0): [0.1] * (600 + extra)})
    assert windows.windows(signal, 100).count() == count
    assert windows.windows(signal, 100, flush_tail=False).count() == 2


def test_channel_dr_equals_brute_force(spark):
    rng = random.Random(1)
    signals = {(t, c): [rng.uniform(-1, 1) * rng.random() ** 3 for _ in range(rng.choice([0, 1, 2, 299, 300, 301, 2000, 5003]))] for t in "abcdef" for c in range(2)}
    got = {(r["track_id"], r["channel"]): r for r in channels.channel_dr(samples(spark, signals).repartition(5), 100).collect()}
    for key, xs in signals.items():
        if xs:
            r = got[key]
            assert (r["rms"], r["primary_peak"], r["secondary_peak"], r["peak"], r["dr_value"]) == pytest.approx(brute_dr(xs, 300))
            assert r["sample_count"] == len(xs)


def test_special_values(spark):
    nan, inf = float("nan"), float("inf")
    signal = samples(spark, {("nan", 0): [0.5] * 300 + [nan] + [0.9] * 299, ("inf", 0): [0.5] * 300 + [inf] * 300, ("loud", 0): [1.0] * 300, ("silent", 0): [0.0] * 700})
    got = {r["track_id"]: r for r in channels.channel_dr(signal, 100).collect()}
    assert got["nan"]["primary_peak"] == 0.9 and got["nan"]["rms"] == pytest.approx(0.7071)
    assert got["inf"]["rms"] == pytest.approx(0.7071) and got["inf"]["peak"] == 0.5
    assert got["loud"]["rms"] == 1.0 and got["loud"]["dr_value"] == 0
    assert (got["silent"]["rms"], got["silent"]["peak"], got["silent"]["dr_value"]) == (0, 0, 0)


def test_thousand_windows_take_two_hundred(spark):
    bins = spark.createDataFrame([("a", 0, b, 1) for b in range(1000)], "track_id string, channel int, bin long, cnt long")
    r = channels.loudest_fifth(bins).first()
    assert (r["windows"], r["k"]) == (1000, 200) and r["rms"] == pytest.approx(math.sqrt(sum(b * b for b in range(800, 1000)) * 1e-8 / 200))


def test_permuted_rows_give_equal_windows(spark):
    rng = random.Random(2)
    signal = samples(spark, {("a", 0): [rng.uniform(-1, 1) for _ in range(1500)]})
    a = windows.windows(signal, 100).select("win", F.round("rms", 9), "peak").orderBy("win").collect()
    assert a == windows.windows(signal.orderBy(F.rand(3)), 100).select("win", F.round("rms", 9), "peak").orderBy("win").collect()


@pytest.mark.parametrize("official,precise,risk,direction", [
    (10, 10.48, "High", "Upper"), (10, 10.47, "High", "Upper"), (10, 10.45, "Medium", "Upper"), (10, 10.46, "Medium", "Upper"), (10, 10.44, None, None), (10, 10.3, None, None), (11, 10.6, None, None),
    (11, 10.52, "High", "Lower"), (11, 10.55, "Medium", "Lower"),
])
def test_boundary_risk(spark, official, precise, risk, direction):
    r = scalar(spark, levels.boundary_risk(F.lit(official), F.lit(precise)))
    assert (r and r["risk_level"], r and r["direction"]) == (risk, direction)
    text = scalar(spark, levels.boundary_warning(F.lit(official), F.lit(precise)))
    assert (text is None) == (risk is None)


def test_potential_is_not_negative(spark):
    assert scalar(spark, levels.potential_official(F.lit(0), F.lit("Lower"))) == 0
    assert scalar(spark, levels.potential_official(F.lit(4), F.lit("Upper"))) == 5


@pytest.mark.parametrize("a,b,want", [(1.0, 0.8, (0.8, 0.8, 1.0, 0.8)), (1.0, 0.0, (1.0, 1.0, 1.0, 1.0)), (0.99999, 0.7, (0.7, 0.7, 0.99999, 0.7)), (0.5, 0.3, (0.3, 0.5, 0.5, 0.3))])
def test_peak_rules(spark, a, b, want):
    assert tuple(scalar(spark, rule(F.lit(a), F.lit(b))) for rule in levels.PEAK_RULES.values()) == want


def test_levels(spark):
    assert scalar(spark, levels.linear_to_db(F.lit(0.0))) == float("-inf")
    assert scalar(spark, levels.linear_to_db_text(F.lit(0.0))) == "-1.#J"
    assert scalar(spark, levels.linear_to_db_text(F.lit(0.1))) == "-20.00"
    assert scalar(spark, levels.rounded(F.lit(-2.5))) == -3
    assert scalar(spark, levels.dynamic_range(F.lit(1e-13), F.lit(0.5), 1e-12)) == 0
    assert scalar(spark, levels.dynamic_range(F.lit(1.0), F.lit(0.5))) < 0


def test_conversion(spark):
    for value, want in ((0, 0), (16384, 0.5), (-16384, -0.5), (32767, 0.9999695), (-32768, -1)):
        assert scalar(spark, pcm.to_float(F.lit(value), "S16")) == pytest.approx(want, abs=1e-7)
    assert scalar(spark, pcm.to_float(F.lit(0), "U8")) == -1 and scalar(spark, pcm.to_float(F.lit(1 << 31), "U32")) == 0
    with pytest.raises(ValueError):
        pcm.to_float(F.lit(1), "S20")
    assert scalar(spark, pcm.format_properties(F.lit("F64"))) == Row(bits=64, floating=True, signed=True)


def test_track_rules(spark):
    rows = [("a", 0, 10.0, 0.1, 0.5), ("a", 1, 12.0, 0.1, 0.5), ("a", 2, 3.0, 0.1, 0.5), ("a", 3, 9.0, 0.0, 0.5), ("s", 0, 0.0, 0.0, 0.0)]
    found = spark.createDataFrame(rows, "track_id string, channel int, dr_value double, rms double, peak double")
    meta = spark.createDataFrame([("a", 4, [2, 9], True), ("s", 1, [], False)], "track_id string, channels int, lfe_indices array<int>, has_channel_layout_metadata boolean")
    got = {r["track_id"]: r for r in tracks.track_dr(tracks.with_exclusions(found, meta), exclude_lfe=True).collect()}
    assert (got["a"]["official_dr"], got["a"]["precise_dr"], got["a"]["excluded_channels"], got["a"]["excluded_lfe"]) == (11, 11.0, 2, 1)
    assert (got["s"]["official_dr"], got["s"]["precise_dr"], got["s"]["excluded_channels"]) == (None, None, 1)
    both = {r["track_id"]: r for r in tracks.both_aggregates(tracks.with_exclusions(found, meta)).collect()}
    assert both["a"]["precise_dr_all"] == pytest.approx(25 / 3) and both["a"]["precise_dr_without_lfe"] == 11
    fallback = tracks.effective_lfe(F.lit(6), F.array(F.lit(9)), F.lit(True))
    assert scalar(spark, fallback) == [3] and scalar(spark, tracks.effective_lfe(F.lit(6), F.array(F.lit(3)), F.lit(False))) == []


def machine(amplitudes, threshold, min_run, hysteresis):
    """Edge trimming as a plain state machine."""
    out, held, phase, heard, quiet_run = [], [], "lead", 0, 0
    for i, a in enumerate(amplitudes):
        quiet = a < threshold
        if phase == "lead":
            if quiet:
                held.append(i)
                if len(held) == min_run:
                    held = []
            else:
                out += [*held, i]
                held, heard = [], heard + 1
                if heard >= hysteresis:
                    phase = "pass"
        elif phase == "pass":
            if quiet:
                phase, held, quiet_run, heard = "hold", [i], 1, 0
            else:
                out.append(i)
        else:
            held.append(i)
            quiet_run, heard = (quiet_run + 1, 0) if quiet else (0, heard + 1)
            if heard >= hysteresis:
                out, held, phase = out + held, [], "pass"
    return out if phase == "hold" and quiet_run >= min_run else out + held


@pytest.mark.parametrize("block", [7, 1 << 16])
def test_trimming_equals_state_machine(spark, monkeypatch, block):
    monkeypatch.setattr(trim, "BLOCK", block)  # of frames that one task puts in order
    rng = random.Random(7)
    signals = {(f"t{i}", 0): [rng.choice([0.0, 0.0, 0.5]) for _ in range(rng.randint(1, 40))] for i in range(300)}
    signal = samples(spark, signals)
    for min_run, hysteresis in ((3, 2), (1, 1), (5, 4)):
        runs = trim.trimmed_runs(trim.silent_runs(channels.frame_amplitude(signal), -20), min_run, hysteresis)
        kept = {t: len(machine(xs, 0.1, min_run, hysteresis)) for (t, _), xs in signals.items()}
        for r in trim.trim_report(runs).collect():
            assert r["total_frames"] - r["leading_frames"] - r["trailing_frames"] == kept[r["track_id"]]
        got = {}
        for r in trim.trimmed(signal, runs).collect():
            got.setdefault(r["track_id"], []).append((r["frame_idx"], r["sample"]))
        for (t, _), xs in signals.items():
            assert sorted(got.get(t, [])) == [(n, xs[i]) for n, i in enumerate(machine(xs, 0.1, min_run, hysteresis))]


def test_layouts(spark):
    rows = [("5.1", 6, "mov"), (" 5.1(SIDE)", 6, "mov"), ("mpeg_5_1_a", 6, "mov"), ("5.1(back)", 6, "mov"), ("5.1", 6, "eac3"), ("quad", 4, "mov"), ("2.1", 3, "mov"), ("stereo", 2, "mov"), (None, 6, None)]
    got = [(r["lfe_indices"], r["layout_match"]) for r in layouts.with_layout(spark.createDataFrame(rows, "layout string, channels int, container string").coalesce(1)).collect()]
    assert got == [([3], "exact"), ([3], "exact"), ([3], "exact"), ([3], "fuzzy"), ([5], "raw"), ([3], "fallback"), ([2], "exact"), ([], "fallback"), ([3], "fallback")]
    assert layouts.channel_layouts(spark).count() == 19
    assert scalar(spark, describe.mask_lfe(F.lit(0x3F))) == [3]


def test_packets(spark):
    rows = [("a", s, 1, [0.5] if s % 3 else []) for s in (2, 0, 1, 5, 4, 1)]
    frame = spark.createDataFrame(rows, "track_id string, seq long, n_frames long, samples array<float>")
    assert [r["seq"] for r in packets.reordered(frame).orderBy("seq").collect()] == [0, 1, 2]
    many = spark.createDataFrame([("a", s, None) for s in range(101)] + [("b", s, None) for s in range(100)], "track_id string, seq long, samples array<float>")
    assert {r["track_id"]: r["track_fails"] for r in packets.decode_failures(many).collect()} == {"a": True, "b": False}
    stats = packets.chunk_stats(spark.createDataFrame([("a", 3), ("a", 5), ("b", None)], "k string, n_frames long"), ["k"])
    assert {r["k"]: tuple(r)[1:] for r in stats.collect()} == {"a": (2, 8, 3, 5, 4.0), "b": (0, 0, 0, 0, 0.0)}


def test_batches(spark):
    rows = [(i, f"/p/{i}", f"f{i}", "Format" if i in (1, 2, 3, 4) else "Io" if i == 5 else None, None if 1 <= i <= 5 else i, None if 1 <= i <= 5 else i + 0.48, 0, 0) for i in range(9)]
    results = spark.createDataFrame(rows, "idx int, path string, file_name string, error_category string, official_dr int, precise_dr double, excluded_channels int, excluded_lfe int")
    assert tuple(batches.batch_summary(results).first()) == (4, 5, pytest.approx(400 / 9))
    assert tuple(batches.batch_summary(results.where("idx < 0")).first()) == (0, 0, 0.0)
    assert [tuple(r) for r in batches.error_groups(results).collect()] == [("Format", 4, "f1, f2, f3", 1), ("Io", 1, "f5", 0)]
    ranked = batches.ranked_warnings(results.where("official_dr is not null").withColumnRenamed("path", "track_id"))
    text = report.batch_report(results, batches.batch_summary(results), batches.error_groups(results), ranked)
    assert "processed 4, failed 5" in text and "| - | - | f1 |" in text and "Format: 4 (f1, f2, f3, +1 more)" in text and "may be DR9" in text
    one = batches.run_stats(spark.createDataFrame([("m", 3.0)], "k string, v double"), "v", ["k"]).first()
    assert one["stddev"] == 0
    empty = batches.resource_summary(spark.createDataFrame([], "cpu_percent double, memory_kb long")).first()
    assert tuple(empty) == (0.0, 0.0, 0, 0)


def test_paths(spark):
    for path, want in {
        "/a/b.tar.gz": ("b.tar.gz", "b.tar", "GZ", "/a"), "x.wav": ("x.wav", "x", "WAV", "."), "/x": ("x", "x", "Unknown", "/"), "/a/.hidden": (".hidden", ".hidden", "Unknown", "/a"), "": ("Unknown", "audio", "Unknown", "."),
    }.items():
        p = F.lit(path)
        assert tuple(scalar(spark, f(p)) for f in (describe.file_name, describe.file_stem, describe.extension, describe.parent_dir)) == want
    assert scalar(spark, describe.sanitized(F.lit("test<>file a.b"))) == "test__file_a_b"
    assert scalar(spark, describe.can_decode(F.lit("/a/b.FLAC"))) and not scalar(spark, describe.can_decode(F.lit("/a/b")))


def test_descriptions(spark):
    assert scalar(spark, describe.duration_text(F.lit(44100 * 3725), F.lit(44100))) == "1:02:05"
    assert scalar(spark, describe.duration_text(F.lit(44100 * 65), F.lit(44100))) == "1:05"
    assert scalar(spark, describe.dsd_tier(F.lit(2822400))) == 64 and scalar(spark, describe.dsd_tier(F.lit(5644800))) == 128
    assert scalar(spark, describe.opus_frames(F.lit(10), F.lit(48000))) == 48000 * 60
    assert scalar(spark, describe.exit_code(F.lit(None).cast("string"))) == 0
    assert scalar(spark, format_error(F.lit(44100), F.lit(33), F.lit(16))) is not None and scalar(spark, format_error(F.lit(44100), F.lit(2), F.lit(16))) is None
    check_options(threads=4, silence_db=-60, dsd_rate=352_800)
    for bad in ({"threads": 0}, {"silence_db": 1}, {"dsd_rate": 1}, {"min_run_ms": 10}):
        with pytest.raises(ValueError):
            check_options(**bad)


def test_reports(spark):
    found = spark.createDataFrame([("a", 0, 10.48, 0.1, 0.5, False, False), ("a", 1, 10.48, 0.0, 0.0, False, True)], "track_id string, channel int, dr_value double, rms double, peak double, is_lfe boolean, is_silent boolean")
    whole = tracks.track_dr(found)
    import json

    r = json.loads(report.json_reports(found, whole).first()["report"])
    assert r["officialDr"] == 10 and r["boundaryWarning"]["level"] == "high" and r["channels"][1]["rmsDb"] is None and r["channels"][1]["isSilent"]
    assert r["format"] is None and [c["drOfficial"] for c in r["channels"]] == [10, 10] and [c["isExcluded"] for c in r["channels"]] == [False, True]
    formats = spark.createDataFrame([("a", 44100, 2, 24, "FLAC", 88200, [0])], "track_id string, sample_rate int, channels int, bits_per_sample int, codec string, sample_count long, lfe_indices array<int>")
    r = json.loads(report.json_reports(found, whole, True, formats).first()["report"])
    assert r["format"] == {"sampleRate": 44100, "channels": 2, "bitsPerSample": 24, "codec": "FLAC", "durationSeconds": 2.0} and r["channels"][0]["isLfe"] and r["channels"][0]["isExcluded"]
    text = report.text_reports(found, whole).first()["report"]
    assert "| Left | 10.48 dB | -20.00 | -6.02 |  |" in text and "-1.#J" in text and "Silent" in text and "High risk" in text
    assert report.padded("日本", 6) == "日本  " and report.output_path("/a/b.wav") == "/a/b_DR_Analysis.txt"


def test_report_files(spark, tmp_path):
    """A file per track by its stem; a failing task leaves nothing."""
    rows = [("/a/x.wav", "one"), ("/b/x.flac", "two"), ("/b/y.wav", "drei ä")]
    report.write_reports(spark.createDataFrame(rows, "track_id string, report string").repartition(3), str(tmp_path / "out"))
    assert {str(p.relative_to(tmp_path / "out")): p.read_text() for p in (tmp_path / "out").rglob("*") if p.is_file()} == {
        "_a/x_DR_Analysis.txt": "one", "_b/x_DR_Analysis.txt": "two", "y_DR_Analysis.txt": "drei ä"
    }
    from crestline.sources import sink

    bad = spark.range(40).repartition(8).select(F.when(F.col("id") == 33, F.lit("../out")).otherwise(F.concat(F.lit("f"), "id")).alias("name"), F.lit(b"x").alias("content"))
    with pytest.raises(Exception, match="no name"):
        sink.write_files(bad, str(tmp_path / "none"))
    assert not [p for p in (tmp_path / "none").rglob("*")] and not (tmp_path / "out").parent.joinpath("out", "_staging").exists()


def test_places(spark):
    rows = spark.createDataFrame([(i, float(i % 37) if i % 5 else None) for i in range(500)], "i int, v double").repartition(7)
    got = batches.placed(rows, "place", F.col("v").desc_nulls_last(), F.col("i").asc()).collect()
    want = sorted(((i, float(i % 37) if i % 5 else None) for i in range(500)), key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert {r["i"]: r["place"] for r in got} == {i: n for n, (i, _) in enumerate(want, 1)}
    assert batches.placed(rows.where("i < 0"), "place", F.col("i").asc()).collect() == []


def test_legend_and_partial_note(spark):
    schema = "idx int, path string, file_name string, error_category string, official_dr int, precise_dr double, excluded_channels int, excluded_lfe int"
    text = lambda lfe, all_: report.batch_report(f := spark.createDataFrame([(0, "/p", "f", None, 9, 9.1, all_, lfe)], schema), batches.batch_summary(f), batches.error_groups(f), spark.createDataFrame([], "track_id string"))
    assert "\n\n*LFE excluded / †Silent channels excluded\n" in text(1, 2) and "\n\n*LFE excluded\n" in text(1, 1) and "\n\n†Silent channels excluded\n" in text(0, 1) and "xcluded" not in text(0, 0)
    formats = spark.createDataFrame([("a", 100, True, 3), ("b", 100, False, 0)], "track_id string, sample_rate int, is_partial boolean, skipped_packets long")
    assert {r["track_id"]: r["notes"] for r in report.run_notes(formats).collect()} == {"a": "Partial analysis: 3 packets skipped", "b": ""}


def test_silence_filter_drops_windows_without_a_level(spark):
    nan = float("nan")
    rows = [("t", 0, i, v) for i, v in enumerate([0.9, nan] + [0.1] * 298 + [0.5] * 300)]
    frame = spark.createDataFrame(rows, "track_id string, channel int, frame_idx long, sample double")
    assert channels.channel_dr(frame, 100, silence_db=-60.0).first()["primary_peak"] == 0.5
    assert channels.channel_dr(frame, 100).first()["primary_peak"] == 0.9


def test_deinterleave_and_plugged_function(spark):
    rows = spark.createDataFrame([("a", 0, [1.0, 2.0, 3.0]), ("a", 1, [4.0, 5.0])], "track_id string, seq long, samples array<float>")
    got = {(r["channel"], r["frame_idx"]): r["sample"] for r in channels.deinterleave(rows, 2).collect()}
    assert got == {(0, 0): 1.0, (1, 0): 2.0, (0, 1): 3.0, (1, 1): 4.0, (0, 2): 5.0}
    mean = channels.per_channel(channels.deinterleave(rows, 2), lambda p: p.assign(mean=p["sample"].mean())[["track_id", "channel", "mean"]].head(1), "track_id string, channel int, mean double")
    assert {r["channel"]: r["mean"] for r in mean.collect()} == {0: 3.0, 1: 3.0}
    accumulated = channels.accumulate(channels.deinterleave(rows, 2)).where("channel = 0").first()
    assert (accumulated["primary_peak"], accumulated["secondary_peak"]) == (5.0, 3.0)


def test_compact_report_of_many_channels(spark):
    rows = [("/m/x.flac", c, 10.0 + c, 0.1 * (c != 3), 0.5 * (c != 3), 0.5, 0.4, 4410, c == 3, c == 2) for c in range(4)]
    found = spark.createDataFrame(rows, "track_id string, channel int, dr_value double, rms double, peak double, primary_peak double, secondary_peak double, sample_count long, is_silent boolean, is_lfe boolean")
    whole = tracks.track_dr(found)
    formats = spark.createDataFrame([("/m/x.flac", 44100, 44100 * 3725, 4, None)], "track_id string, sample_rate int, sample_count long, channels int, codec string")
    trims = spark.createDataFrame([("/m/x.flac", 441, 44100)], "track_id string, leading_frames long, trailing_frames long")
    quiet = spark.createDataFrame([("/m/x.flac", c, 1, 4) for c in range(2)], "track_id string, channel int, filtered_windows long, total_windows long")
    text = report.compact_reports(found, whole, formats, diagnostics=True, notes=report.run_notes(formats, trims, quiet)).first()["report"]
    blocks = text.split("\n\n")
    assert blocks[0] == "crestline 0.1.0 | DR11 (11.00 dB)\nx.flac | 1:02:05 | 44100 Hz | 4ch | FLAC"
    assert blocks[1].split("\n")[0] == "| Channel | DR | Peak | Note |" and blocks[1].split("\n")[4] == "| Ch 3 | 12.00 dB | -6.02 dB | LFE |"
    assert blocks[2].split("\n")[5].startswith("| Ch 4 [Silent] | ")
    assert blocks[3] == "Edge trimming: 1.0 s removed\nSilence filter: 2/8 windows (25.0 %)" and len(blocks) == 4
    plain = report.run_notes(formats).first()["notes"]
    none = report.compact_reports(found, whole.withColumn("official_dr", F.lit(None).cast("int")).withColumn("precise_dr", F.lit(None).cast("double")), formats).first()["report"]
    assert plain == "" and "DR0 (0.00 dB)" in none and len(none.split("\n\n")) == 2


def test_accumulate_takes_the_two_largest(spark, monkeypatch):
    monkeypatch.setattr(channels, "BLOCK", 3)
    signals = {("a", 0): [0.1, -0.9, 0.9, 0.2, 0.3], ("a", 1): [0.5], ("b", 0): [0.1, 0.2, 0.3, -0.8, 0.7, 0.1], ("c", 0): [0.0] * 7}
    got = {(r["track_id"], r["channel"]): (r["n"], r["primary_peak"], r["secondary_peak"]) for r in channels.accumulate(samples(spark, signals)).collect()}
    assert got == {("a", 0): (5, 0.9, 0.9), ("a", 1): (1, 0.5, 0.0), ("b", 0): (6, 0.8, 0.7), ("c", 0): (7, 0.0, 0.0)}


def test_emission_in_order(spark):
    rows = spark.range(100).select((F.col("id") * 37 % 100).cast("int").alias("idx")).repartition(7)
    got = list(batches.emitted(rows))
    assert [r["idx"] for _, _, r in got] == list(range(100)) and got[24][:2] == (25, 0.25) and got[-1][1] == 1.0
    assert list(batches.emitted(rows.where("false"))) == []


def test_cancel(spark):
    from concurrent.futures import ThreadPoolExecutor

    def slow():
        with batches.cancellable(spark, "slow-batch"):
            return spark.range(0, 1 << 34, 1, 8).where(F.sin(F.col("id")) > 2).count()

    with ThreadPoolExecutor(1) as pool:
        running = pool.submit(slow)
        for _ in range(200):
            batches.cancel(spark, "slow-batch")
            if running.done():
                break
            time.sleep(0.1)
        with pytest.raises(Exception, match="(?i)cancel"):
            running.result(timeout=1)
    assert spark.range(5).count() == 5


def test_hints_and_filters(spark):
    assert scalar(spark, describe.error_hint(F.lit("OutOfMemory"))).startswith("give the executors")
    assert "AIFF" in scalar(spark, describe.error_hint(F.lit("FormatError"))) and scalar(spark, describe.error_hint(F.lit(None).cast("string"))) is None
    assert scalar(spark, describe.error_hint(F.lit("unknown"))) == "check the input and the options"
    filters = lambda mode, tier, gain: scalar(spark, describe.dsd_filters(F.lit(mode), F.lit(tier), gain_db=gain))
    assert filters("teac", 64, None) == "lowpass=f=39000,volume=6dB" and filters("teac", 1024, F.lit(0)) == "lowpass=f=158760"
    assert filters("off", 64, F.lit(-2.5)) == "volume=-2.5dB" and filters("off", 64, F.lit(0)) == ""
    rows = spark.createDataFrame([("a.DFF",), ("b.wav",)], "file_name string")
    assert tuple(report.batch_header(rows, 88200).first()) == (2, "One-bit files are converted to 88200 Hz")
    assert tuple(report.batch_header(rows.where("false")).first()) == (0, None)
