"""WAV files of all kinds, scans, the command line and streams."""

import math
import struct
import sys
import wave

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from crestline import cli
from crestline.operators import channels, tracks, trim, windows
from crestline.sources import files, registry, wav
from crestline.sources.aiff import decode_aiff
from crestline.streaming import signals


def write(path, frames, rate=44100, bits=16):
    frames = np.atleast_2d(np.asarray(frames).T).T
    with wave.open(str(path), "wb") as out:
        out.setnchannels(frames.shape[1])
        out.setsampwidth(bits // 8)
        out.setframerate(rate)
        flat = frames.reshape(-1).astype(np.int64)
        out.writeframes(flat.astype("<i2").tobytes() if bits == 16 else b"".join(int(x & 0xFFFFFF).to_bytes(3, "little") for x in flat))


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("wav")
    write(d / "zero_length.wav", np.zeros((0, 2)))
    write(d / "single_sample.wav", [[16384]])
    write(d / "tiny_duration.wav", np.column_stack([np.trunc(np.arange(441) / 441 * 16384)] * 2))
    write(d / "silence.wav", np.zeros((44100, 2)))
    write(d / "full_scale_clipping.wav", np.column_stack([np.where(np.arange(44100) % 2 == 0, 32767, -32768)] * 2))
    write(d / "edge_cases.wav", np.column_stack([np.tile([0, 1, -1, 32767, -32768, 100, -100], 44100)] * 2))
    write(d / "high_sample_rate.wav", np.column_stack([np.trunc(np.sin(2 * np.pi * 440 * np.arange(192000) / 192000) * 8388607)] * 2), 192000, 24)
    write(d / "3_channels.wav", np.column_stack([np.trunc(np.sin(2 * np.pi * 1000 * np.arange(44100) / 44100) * 16384)] * 3))
    (d / "empty.wav").write_bytes(b"")
    (d / "fake_audio.wav").write_bytes(b"this is no audio at all")
    write(d / "truncated.wav", np.column_stack([np.trunc(np.arange(1000) / 1000 * 16384)] * 2))
    (d / "truncated.wav").write_bytes((d / "truncated.wav").read_bytes()[:200])
    (d / "other.flac").write_bytes(b"fLaC")
    (d / "notes.txt").write_bytes(b"text")
    return d


def test_files(spark, folder):
    given, found = files.analyse(spark, str(folder))
    meta = {r["path"].rsplit("/", 1)[1]: r for r in given.collect()}
    kinds = {name: r["error_kind"] for name, r in meta.items() if r["error_kind"]}
    assert kinds == {"zero_length.wav": "InvalidInput", "single_sample.wav": "InvalidInput", "empty.wav": "FormatError", "fake_audio.wav": "FormatError", "other.flac": "FormatError"}
    got = {}
    for r in found.collect():
        got.setdefault(r["track_id"].rsplit("/", 1)[1], []).append((r["channel"], r["rms"], r["peak"], r["dr_value"]))
    expected = {
        "tiny_duration.wav": (0.4075, 0.49884033, 1.756679), "full_scale_clipping.wav": (1.0, 1.0, 0.0), "edge_cases.wav": (0.7559, 1.0, 2.430713),
        "high_sample_rate.wav": (0.9999, 0.99999988, 0.000868), "truncated.wav": (0.0155, 0.01898193, 1.760175), "silence.wav": (0, 0, 0), "3_channels.wav": (0, 0, 0),
    }
    assert got.keys() == expected.keys()
    for name, values in expected.items():
        assert len(got[name]) == meta[name]["channels"]
        for _, *measured in got[name]:
            assert measured == pytest.approx(list(values), abs=2e-6)
    assert (meta["truncated.wav"]["sample_count"], meta["truncated.wav"]["actual_frames"]) == (1000, 39)
    whole = {r["track_id"].rsplit("/", 1)[1]: r["official_dr"] for r in tracks.track_dr(tracks.with_exclusions(found)).collect()}
    assert whole["silence.wav"] is None and whole["3_channels.wav"] is None and whole["edge_cases.wav"] == 2


def test_samples_give_the_same(spark, folder):
    given = files.contents(spark, str(folder)).where(F.col("path").rlike("edge_cases|truncated"))
    by_samples = channels.channel_dr(files.sample_files(given), 44100)
    _, direct = files.analyse(spark, str(folder))
    want = {(r["track_id"], r["channel"]): r["dr_value"] for r in direct.collect()}
    rows = by_samples.collect()
    assert len(rows) == 4 and all(r["dr_value"] == pytest.approx(want[r["track_id"], r["channel"]]) for r in rows)


def test_pieces_of_large_files(spark, folder):
    from crestline.sources import ranges

    ranges.register(spark)
    key = lambda r: (r["path"].rsplit("/", 1)[1], r["channel"], r["win"])
    want = {key(r): (r["n"], pytest.approx(r["sum_sq"]), r["peak"]) for r in files.window_files(files.contents(spark, str(folder))).collect()}
    for share in (100_000, 529_964, ranges.SHARE_BYTES):
        pieces = spark.read.format("audio_windows").option("share", share).load(str(folder)).collect()
        windows_ = [r for r in pieces if r["win"] is not None]
        assert {key(r): (r["n"], r["sum_sq"], r["peak"]) for r in windows_} == want and len(windows_) == len(want)
        assert {r["path"].rsplit("/", 1)[1] for r in pieces if r["error"]} == {"empty.wav", "fake_audio.wav", "other.flac"}
        assert sum(r["actual_frames"] for r in pieces if r["path"].endswith("edge_cases.wav") and r["win"] is None) == 308700
    assert want["edge_cases.wav", 0, 2][0] == 308700 - 2 * 132480


def test_pieces_after_a_long_chunk(spark, tmp_path):
    from crestline.sources import ranges

    ranges.register(spark)
    write(tmp_path / "plain.wav", np.column_stack([np.arange(5000)] * 2))
    raw = (tmp_path / "plain.wav").read_bytes()
    for name, at in (("before.WAV", 12), ("between.wav", 36)):  # before the format, and between it and the samples
        (tmp_path / name).write_bytes(raw[:at] + b"JUNK" + struct.pack("<I", 99_999) + b"\1" * 100_000 + raw[at:])
    got = {}
    for r in spark.read.format("audio_windows").load(str(tmp_path)).where("win IS NOT NULL").collect():
        got.setdefault(r["path"].rsplit("/", 1)[1], set()).add((r["channel"], r["win"], r["n"], r["sum_sq"], r["peak"]))
    assert got.keys() == {"plain.wav", "before.WAV", "between.wav"}
    assert got["plain.wav"] == got["before.WAV"] == got["between.wav"]


def test_many_short_files_are_dealt_by_number(tmp_path):
    """Files of some bytes are neither one task all together nor one task each, whatever a range's bytes."""
    from crestline.sources import ranges

    for k in range(200):
        (tmp_path / f"{k:03}.wav").write_bytes(b"RIFF" * 100)
    for share, pieces in ((300, 400), (ranges.SHARE_BYTES, 200)):
        found = [p.pieces for p in ranges.AudioWindowsReader(str(tmp_path), False, share, ("wav",), None).partitions()]
        assert [(p.path, p.first) for x in found for p in x] == [(str(tmp_path / f"{k:03}.wav"), a) for k in range(200) for a in range(0, 400, share)]
        assert len(found) == -(-pieces // 64) and max(map(len, found)) == 64
    long = [ranges.Piece("a", 10**9, a, a + 10**8) for a in range(0, 10**9, 10**8)]
    assert ranges.dealt(long, 10**8) == [[x] for x in long]


@pytest.mark.parametrize("recursive", [False, True])
def test_listing_without_a_process_a_file(spark, tmp_path, monkeypatch, recursive):
    """Files without a byte are found by pyarrow alone, and the same by Hadoop where pyarrow does not know the store; neither asks
    for the places of blocks, which costs a process a file on a local disk."""
    from types import SimpleNamespace

    from crestline.sources import ranges

    (tmp_path / "in a").mkdir()
    for name in ("a.mp3", "b +%20.M4A", "c.txt", "in a/d.mp3"):
        (tmp_path / name).write_bytes(b"")
    (tmp_path / "full.mp3").write_bytes(b"x")
    given = registry.known_decoders()
    told = lambda rows: sorted(r["path"].removeprefix("file:").lstrip("/") for r in rows.collect())
    want = sorted(str(tmp_path / n).lstrip("/") for n in ("a.mp3", "b +%20.M4A", *(["in a/d.mp3"] if recursive else [])))
    assert told(files.failed_files(SimpleNamespace(createDataFrame=spark.createDataFrame), str(tmp_path), recursive, given)) == want
    monkeypatch.setattr(ranges, "readable", lambda path: False)
    assert told(files.failed_files(spark, str(tmp_path), recursive, given)) == want


def test_extensible_mask_and_encodings():
    fmt = struct.pack("<HHIIHHHHIH14s", wav.EXTENSIBLE, 6, 48000, 48000 * 12, 12, 16, 22, 16, 0x3F, 1, b"\0" * 14)
    data = b"RIFF" + struct.pack("<I", 0) + b"WAVE" + b"junk" + struct.pack("<I", 3) + b"abc\0" + b"fmt " + struct.pack("<I", 40) + fmt + b"data" + struct.pack("<I", 24) + b"\0" * 24
    found, blocks = wav.decode_wav(data)
    assert found.lfe_indices == [3] and found.has_channel_layout_metadata and sum(map(len, blocks)) == 2
    assert wav.to_float(b"\x00\x00\x80\xff\xff\x7f", "s24le").tolist() == [-1.0, pytest.approx(0.99999988)]
    assert wav.to_float(struct.pack("<2i", -(2**31), 2**30), "s32le").tolist() == [-1.0, 0.5]
    assert wav.to_float(b"\x00\x80", "u8").tolist() == [-1.0, 0.0]
    assert wav.to_float(struct.pack("<d", 0.25), "f64le").tolist() == [0.25]


def test_scan(spark, folder):
    found = registry.scan(spark, str(folder)).collect()
    names = [r["file_name"] for r in found]
    assert "notes.txt" not in names and "other.flac" in names and [r["path"] for r in found] == sorted(r["path"] for r in found)
    assert registry.totals(registry.scan(spark, str(folder))).first()["files"] == len(names)
    with pytest.raises(Exception):  # noqa: B017
        registry.scan(spark, str(folder / "missing")).count()
    assert registry.decodes_alone("mp3") and not registry.decodes_alone("wav")


def test_scan_in_any_case(spark, tmp_path):
    for name in ("a.wav", "b.WAV", "c.Wav", "d.fLaC", "e.txt"):
        (tmp_path / name).write_bytes(b"x")
    assert [r["file_name"] for r in registry.scan(spark, str(tmp_path)).collect()] == ["a.wav", "b.WAV", "c.Wav", "d.fLaC"]


def test_decoder_that_fails_on_the_way(spark, tmp_path):
    """A file whose decoder gives some blocks and then fails is an error, and counts in no channel."""
    from crestline.operators.windows import window_frames

    def fails(data, extension):
        def blocks():
            yield np.ones((2 * window_frames(44100), 1), np.float32)
            raise RuntimeError("torn")

        return registry.AudioFormat(44100, 1, 16, 10**6, "X"), blocks()

    registry.register_decoder("ape", fails)
    (tmp_path / "torn.ape").write_bytes(b"1")
    write(tmp_path / "good.wav", np.column_stack([np.arange(5000)] * 2))
    both = files._read_files(registry.known_decoders())(iter([pa.RecordBatch.from_pydict({"path": ["torn.ape"], "content": [b"1"]})]))
    rows = [r for b in both for r in b.to_pylist()]
    assert [r["win"] for r in rows] == [0, 1, None] and rows[-1]["error"] == "torn" and rows[-1]["error_kind"] == "DecodingError"
    meta, found = files.analyse(spark, str(tmp_path))
    assert {r["track_id"].rsplit("/", 1)[1] for r in found.collect()} == {"good.wav"}
    failed = meta.where("error IS NOT NULL").collect()
    assert len(failed) == 1 and failed[0]["error"] == "torn" and failed[0]["path"].endswith("torn.ape")  # the decoder ran on the worker
    del registry._DECODERS["ape"]


def test_decoders_reach_the_workers(spark, tmp_path):
    """Programs given to analyse(), and those registered, decode files in the tasks; other files of the folder do not count."""
    rng = np.random.default_rng(8)
    x = rng.normal(0, 0.1, (300_000, 2)).clip(-1, 1).astype("<f4")
    for name in ("a.mkv", "b.dts"):
        (tmp_path / name).write_bytes(x.tobytes())
    (tmp_path / "c.ac3").write_bytes(b"no decoder")
    (tmp_path / "cover.jpg").write_bytes(b"picture")
    (tmp_path / "notes.txt").write_bytes(b"text")
    copy = [sys.executable, "-c", "import sys, shutil; shutil.copyfileobj(sys.stdin.buffer, sys.stdout.buffer)"]
    registry.register_decoder("dts", registry.process_decoder(copy, 44100, 2))
    meta, found = files.analyse(spark, str(tmp_path), decoders={"mkv": registry.process_decoder(copy, 44100, 2)})
    kinds = {r["path"].rsplit("/", 1)[1]: (r["error_kind"], r["actual_frames"]) for r in meta.collect()}
    assert kinds == {"a.mkv": (None, 300_000), "b.dts": (None, 300_000), "c.ac3": ("DecodingError", None)}
    write(tmp_path / "same.wav", np.trunc(x * 32768))
    assert {r["track_id"].rsplit("/", 1)[1] for r in found.collect()} == {"a.mkv", "b.dts"}
    rows = spark.createDataFrame([("x", c, i, float(v)) for c in range(2) for i, v in enumerate(x[:, c])], "track_id string, channel int, frame_idx long, sample float")
    want = {r["channel"]: r["dr_value"] for r in channels.channel_dr(rows, 44100).collect()}
    assert all(r["dr_value"] == pytest.approx(want[r["channel"]]) for r in found.collect())
    del registry._DECODERS["dts"]


def test_missing_program(spark, tmp_path):
    (tmp_path / "x.mkv").write_bytes(b"12345678")
    decoders = {"mkv": registry.process_decoder(["no-such-program"], 44100, 2)}
    row = files.probe_files(files.contents(spark, str(tmp_path), decoders=decoders), decoders).first()
    assert "not installed" in row["error"] and row["error_kind"] == "ResourceError"


def aiff(frames, bits=16, kind=None, rate=44100, order=">"):
    """AIFF, or AIFF-C if a compression type is named."""
    frames = np.asarray(frames)
    if kind in (b"fl32", b"fl64"):
        raw = frames.astype(f">f{bits // 8}").tobytes()
    else:
        raw = b"".join(int(x).to_bytes(bits // 8, "big" if order == ">" else "little", signed=True) for x in frames.reshape(-1))
    power = 16383 + rate.bit_length() - 1
    common = struct.pack(">hIhHQ", frames.shape[1], len(frames), bits, power, rate << (64 - rate.bit_length())) + (kind + b"\0\0" if kind else b"")
    chunks = [b"COMM" + struct.pack(">I", len(common)) + common, b"SSND" + struct.pack(">III", len(raw) + 8, 0, 0) + raw]
    body = (b"AIFC" if kind else b"AIFF") + b"ANNO" + struct.pack(">I", 3) + b"abc\0" + b"".join(chunks)
    return b"FORM" + struct.pack(">I", len(body)) + body


def test_aiff(spark, tmp_path):
    ramp = np.column_stack([np.arange(-300, 300) * 100, np.arange(600)])
    write(tmp_path / "same.wav", ramp)
    (tmp_path / "same.aiff").write_bytes(aiff(ramp))
    (tmp_path / "little.AIFF").write_bytes(aiff(ramp, kind=b"sowt", order="<"))
    (tmp_path / "float.aiff").write_bytes(aiff(ramp / 32768, 32, b"fl32"))
    (tmp_path / "packed.aiff").write_bytes(aiff(ramp, kind=b"ima4"))
    (tmp_path / "cut.aiff").write_bytes(aiff(ramp)[:71])
    meta, found = files.analyse(spark, str(tmp_path))
    kinds = {r["path"].rsplit("/", 1)[1]: (r["error_kind"], r["sample_rate"], r["actual_frames"]) for r in meta.collect()}
    good = (None, 44100, 600)
    assert kinds == {"same.wav": good, "same.aiff": good, "little.AIFF": good, "float.aiff": good, "packed.aiff": ("DecodingError", None, None), "cut.aiff": ("InvalidInput", None, None)}
    levels = {}
    for r in found.collect():
        levels.setdefault(r["channel"], set()).add((r["rms"], r["peak"], r["dr_value"]))
    assert [len(levels[c]) for c in (0, 1)] == [1, 1]
    _, blocks = decode_aiff(aiff([[-128], [127], [64]], 8))
    assert np.concatenate(list(blocks)).reshape(-1).tolist() == [-1.0, 127 / 128, 0.5]
    _, blocks = decode_aiff(aiff([[-(2**23)], [2**22]], 24))
    assert np.concatenate(list(blocks)).reshape(-1).tolist() == [-1.0, 0.5]
    with pytest.raises(registry.AudioError):
        decode_aiff(b"FORM\0\0\0\4AIFF")


def test_piped_program():
    """A stand-in program that copies floats; its output is longer than one piece and than a pipe holds."""
    copy = [sys.executable, "-c", "import sys, shutil; shutil.copyfileobj(sys.stdin.buffer, sys.stdout.buffer)"]
    tell = [sys.executable, "-c", "import sys; n = len(sys.stdin.buffer.read()); print('{\"streams\": [{\"codec_type\": \"video\"}, {\"sample_rate\": \"48000\", \"channels\": 2, \"codec_name\": \"eac3\"}]}')"]
    data = np.arange(700_001, dtype="<f4").tobytes()  # one sample over
    found, blocks = registry.process_decoder(copy, probe=tell)(data, "mp4")
    got = list(blocks)
    assert (found.sample_rate, found.channels, found.codec, found.sample_count) == (48000, 2, "EAC3", 350_000)
    assert len(got) > 1 and np.concatenate(got).reshape(-1).tobytes() == data[:-4]
    found, blocks = registry.process_decoder(copy, 44100, 1)(data, "mp3")
    next(blocks)
    blocks.close()  # a reader that stops early leaves no program behind
    fails = [sys.executable, "-c", "import sys; sys.stdout.buffer.write(bytes(8)); sys.exit('torn')"]
    _, blocks = registry.process_decoder(fails, 44100, 2)(data, "mp3")
    with pytest.raises(registry.AudioError, match="torn"):
        list(blocks)
    with pytest.raises(registry.AudioError, match="not installed"):
        registry.process_decoder(["no-such-program"], 44100, 2)(data, "mp3")
    with pytest.raises(registry.AudioError, match="no stream"):
        registry.process_decoder(copy, probe=[sys.executable, "-c", "print('{}')"])(data, "mp3")
    with pytest.raises(ValueError, match="probe"):
        registry.process_decoder(copy)


def test_command_line(spark, folder, tmp_path, capsys):
    code = cli.main([str(folder), "--output", str(tmp_path / "out.txt"), "--json", str(tmp_path / "json")])
    text = (tmp_path / "out.txt").read_text()
    assert code == 2 and "processed 7, failed 5" in text and "| 2 | 2.43 | edge_cases.wav |" in text
    lines = [line.rsplit("| ", 1)[1].split(" ")[0] for line in text.splitlines() if line.startswith("| ") and (".wav" in line or ".flac" in line)]
    assert lines == sorted(lines) and len(lines) == 12
    assert cli.main([str(folder), "--silence-db", "5"]) == 2


# ---- streams --------------------------------------------------------------------------------------------------------


def packet_rows(seed=5):
    rng = np.random.default_rng(seed)
    out = []
    for t in ("a", "b"):
        for c in range(2):
            x = np.where(rng.random(2003) < 0.4, 0.0, rng.normal(0, 0.3, 2003)).astype(np.float32)
            x[:40], x[-60:] = 0, 0
            cuts = [0, *sorted(rng.choice(np.arange(1, 2003), 12, replace=False).tolist()), 2003]
            parts = list(zip(cuts[:-1], cuts[1:], strict=True))
            out += [(t, c, s, x[a:b].tolist(), s == len(parts) - 1) for s, (a, b) in enumerate(parts)]
    return [out[i] for i in rng.permutation(len(out))]


def streamed(spark, tmp_path, name, rows, make):
    """Feeds rows in four files, one a batch, and returns what the stream wrote."""
    source = tmp_path / f"{name}-in"
    schema = "track_id string, channel int, seq long, samples array<float>, last boolean"
    for i in range(4):
        spark.createDataFrame(rows[i::4], schema).coalesce(1).write.mode("append").parquet(str(source))
    frame = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = make(frame).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    return spark.table(name).collect()


def test_stream_equals_batch(spark, tmp_path):
    rows = packet_rows()
    flat = {}
    for t, c, _, xs, _ in sorted(rows):
        flat.setdefault((t, c), []).extend(xs)
    signal = spark.createDataFrame([(t, c, i, x) for (t, c), xs in flat.items() for i, x in enumerate(xs)], "track_id string, channel int, frame_idx long, sample float")
    got = streamed(spark, tmp_path, "stream_windows", rows, lambda f: signals.stream_windows(f, 100))
    want = windows.windows(signal, 100).collect()
    key = lambda r: (r["track_id"], r["channel"], r["win"])
    assert len(got) == len(want)
    for a, b in zip(sorted(got, key=key), sorted(want, key=key), strict=True):
        assert key(a) == key(b) and a["n"] == b["n"] and a["peak"] == b["peak"] and a["rms"] == pytest.approx(b["rms"])


def test_stream_order(spark, tmp_path):
    rows = packet_rows(6)
    got = streamed(spark, tmp_path, "stream_ordered", rows, signals.stream_ordered)
    assert sorted((r["track_id"], r["channel"], r["seq"], tuple(r["samples"])) for r in got) == sorted((t, c, s, tuple(x)) for t, c, s, x, _ in rows)
    for t, c in {(r["track_id"], r["channel"]) for r in got}:
        seqs = [r["seq"] for r in got if (r["track_id"], r["channel"]) == (t, c)]
        assert seqs == sorted(seqs)


def test_stream_trim(spark, tmp_path):
    rows = [(f"{t}{c}", 0, s, x, last) for t, c, s, x, last in packet_rows(7)]
    flat = {}
    for t, _, _, xs, _ in sorted(rows):
        flat.setdefault(t, []).extend(xs)
    signal = spark.createDataFrame([(t, 0, i, x) for t, xs in flat.items() for i, x in enumerate(xs)], "track_id string, channel int, frame_idx long, sample float")
    level = 0.05
    runs = trim.trimmed_runs(trim.silent_runs(channels.frame_amplitude(signal), 20 * math.log10(level)), 10, 3)
    want = sorted(map(tuple, trim.trimmed(signal, runs).select("track_id", "frame_idx", "sample").collect()))
    got = streamed(spark, tmp_path, "stream_trimmed", rows, lambda f: signals.stream_trimmed(f, level, 10, 3))
    assert sorted((r["track_id"], r["frame_idx"], r["sample"]) for r in got) == want


@pytest.mark.parametrize("channels_", [1, 3])
def test_stream_trim_of_frames(spark, tmp_path, channels_):
    """Interleaved packets, cut anywhere, against the batch operators; one track ends in a ragged frame."""
    rng = np.random.default_rng(channels_)
    rows, flat = [], {}
    for t in ("a", "b", "c"):
        x = np.where(np.repeat(rng.random(700) < 0.7, channels_), 0.0, rng.normal(0, 0.3, 700 * channels_)).astype(np.float32)
        x[: 25 * channels_] = x[-33 * channels_ :] = 0
        flat[t] = x.tolist()
        ragged = np.concatenate([x, [0.5] * (channels_ - 1)]).astype(np.float32)
        cuts = [0, *sorted(rng.choice(np.arange(1, len(x)), 9, replace=False).tolist()), len(ragged)]
        rows += [(t, 0, s, ragged[a:b].tolist(), s == 9) for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
    signal = spark.createDataFrame([(t, i % channels_, i // channels_, x) for t, xs in flat.items() for i, x in enumerate(xs)], "track_id string, channel int, frame_idx long, sample float")
    runs = trim.trimmed_runs(trim.silent_runs(channels.frame_amplitude(signal), 20 * math.log10(0.05)), 7, 4)
    want = sorted(map(tuple, trim.trimmed(signal, runs).select("track_id", "channel", "frame_idx", "sample").collect()))
    rows = [rows[i] for i in rng.permutation(len(rows))]
    got = streamed(spark, tmp_path, f"trimmed_{channels_}", rows, lambda f: signals.stream_trimmed(f, 0.05, 7, 4, channels_))
    assert sorted((r["track_id"], r["channel"], r["frame_idx"], r["sample"]) for r in got) == want
    assert 0 < len(want) < 3 * 700 * channels_


def test_late_repeats_emit_nothing(spark, tmp_path):
    """Packets that come again, within a batch, in later ones, and after the end of their channel."""
    x = np.arange(700, dtype=np.float32) / 700
    rows = [("one", 0, 0, x[:5].tolist(), True)] + [("t", 0, k, x[100 * k : 100 * k + 100].tolist(), k == 6) for k in range(7)]
    again = rows + rows[::-1] + rows  # four files: every packet is in several batches
    got = streamed(spark, tmp_path, "again", again, signals.stream_ordered)
    assert sorted((r["track_id"], r["seq"]) for r in got) == [("one", 0), *[("t", k) for k in range(7)]]
    assert all(r["samples"] == pytest.approx(x[100 * r["seq"] : 100 * r["seq"] + 100].tolist()) for r in got if r["track_id"] == "t")
    windows_ = streamed(spark, tmp_path, "again_windows", again, lambda f: signals.stream_windows(f, 100))
    assert sorted((r["track_id"], r["win"], r["n"]) for r in windows_) == [("one", 0, 5), ("t", 0, 300), ("t", 1, 300), ("t", 2, 100)]


def test_silent_channel_closes_and_its_state_goes(spark, tmp_path):
    """A channel without a last packet and with a gap ends by its timer; what is left of its state is the tombstone."""
    import time

    schema = "track_id string, channel int, seq long, samples array<float>, last boolean"
    source = tmp_path / "idle-in"
    feed = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
    feed([("t", 0, k, [0.5] * 200, False) for k in (0, 1, 3)])
    frame = spark.readStream.schema(schema).parquet(str(source))
    query = signals.stream_windows(frame, 100, idle_ms=3000).writeStream.format("memory").queryName("idle").outputMode("append").option("checkpointLocation", str(tmp_path / "idle-state")).trigger(processingTime="500 milliseconds").start()
    try:
        for _ in range(120):
            time.sleep(0.5)
            assert query.exception() is None
            if spark.table("idle").count() >= 2:
                break
        assert sorted((r["win"], r["n"]) for r in spark.table("idle").collect()) == [(0, 300), (1, 100)]
        feed([("t", 0, 2, [0.5] * 200, False), ("t", 0, 4, [0.5] * 200, True)])  # too late
        for _ in range(60):  # batches for timers never end, so the query is never idle
            time.sleep(0.5)
            if sum(p["numInputRows"] for p in query.recentProgress) >= 5:
                break
        assert sum(p["numInputRows"] for p in query.recentProgress) == 5 and spark.table("idle").count() == 2
    finally:
        query.stop()
    held = {name: spark.read.format("statestore").option("path", str(tmp_path / "idle-state")).option("stateVarName", name).load().count() for name in ("head", "done", "closed")}
    assert held == {"head": 0, "done": 0, "closed": 1}


def test_restarted_stream_gives_each_window_once(spark, tmp_path):
    """A query that is stopped and started again goes on where it was, over state in the checkpoint."""
    rows = sorted(packet_rows(7), key=lambda r: r[2])
    schema = "track_id string, channel int, seq long, samples array<float>, last boolean"
    source, out, state = (str(tmp_path / n) for n in ("restart-in", "restart-out", "restart-state"))
    for half in (rows[: len(rows) // 2], rows[len(rows) // 2 :]):
        spark.createDataFrame(half, schema).write.mode("append").parquet(source)
        frame = spark.readStream.schema(schema).parquet(source)
        query = signals.stream_windows(frame, 100).writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None
    got = [(r["track_id"], r["channel"], r["win"], r["n"]) for r in spark.read.parquet(out).collect()]
    assert len(got) == len(set(got)) and len(got) == 4 * 7 and sum(n for *_, n in got) == 4 * 2003
