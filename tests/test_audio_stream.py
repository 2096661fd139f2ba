"""The stream of audio files: growing files, replays, restarts, results as files close."""

import json
import os
import struct

import numpy as np
import pytest

from crestline.operators.windows import window_frames
from crestline.sources import flac, ranges
from crestline.streaming import audio

RATE = 100
STEP = window_frames(RATE)


def wav_bytes(x, declared=None):
    raw = np.asarray(x, "<i2").T.tobytes()
    form = struct.pack("<HHIIHH", 1, len(x), RATE, RATE * 2 * len(x), 2 * len(x), 16)
    return b"RIFF" + struct.pack("<I", 36 + len(raw)) + b"WAVEfmt " + struct.pack("<I", 16) + form + b"data" + struct.pack("<I", len(raw) if declared is None else declared) + raw


def signal(n, seed, channels=2):
    return np.random.default_rng(seed).integers(-30000, 30000, (channels, n))


def old(path):
    os.utime(path, (1_000_000_000, 1_000_000_000))


def windows_of(x, name):
    out = {}
    for c, row in enumerate(x / 32768):
        for win, a in enumerate(range(0, len(row), STEP)):
            part = row[a : a + STEP]
            out[name, c, win] = (len(part), pytest.approx(float(part @ part)), pytest.approx(float(np.abs(part).max())))
    return out


def run(spark, folder, place, **options):
    stream = audio.audio_stream(spark, str(folder), f"{place}/log", **options)
    query = stream.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert query.exception() is None
    rows = spark.read.parquet(f"{place}/out").collect()
    return {(r["path"].rsplit("/", 1)[1], r["channel"], r["win"]): (r["n"], r["sum_sq"], r["peak"]) for r in rows if r["win"] is not None}, [r for r in rows if r["win"] is None], len(rows)


@pytest.mark.parametrize("share", [500, 1 << 20])
def test_growing_files_give_each_window_once(spark, tmp_path, share):
    folder, place = tmp_path / "in", tmp_path / "work"
    folder.mkdir()
    x, y = signal(5 * STEP + 17, 1), signal(2 * STEP, 2)
    whole, path = wav_bytes(x, 0), folder / "grow.wav"  # a header that does not tell the length
    want = windows_of(x, "grow.wav")
    for cut in (20, 44, 44 + 4 * STEP - 3, 44 + 4 * STEP, 44 + 4 * STEP + 1, 44 + 13 * STEP, len(whole)):
        path.write_bytes(whole[:cut])
        got, told, _ = run(spark, folder, place, settle=3600, share=share)
        full = max(0, cut - 44) // (4 * STEP)
        assert got == {k: v for k, v in want.items() if k[2] < full} and not told
    (folder / "b.WAV").write_bytes(wav_bytes(y))
    (folder / "c.flac").write_bytes(flac.encode(y, RATE, 16, 100))
    (folder / "bad.wav").write_bytes(b"nothing of that kind")
    (folder / "none.wav").write_bytes(b"")
    (folder / "note.txt").write_bytes(b"text")
    for f in folder.iterdir():
        old(f)
    got, told, n = run(spark, folder, place, settle=3600, share=share)
    assert got == want | windows_of(y, "b.WAV") | windows_of(y, "c.flac")
    kinds = {r["path"].rsplit("/", 1)[1]: (r["actual_frames"], r["sample_count"], r["error_kind"]) for r in told}
    assert len(told) == len(kinds) and kinds == {
        "grow.wav": (5 * STEP + 17, 5 * STEP + 17, None), "b.WAV": (2 * STEP, 2 * STEP, None), "c.flac": (2 * STEP, 2 * STEP, None), "bad.wav": (0, None, "FormatError"), "none.wav": (0, None, "FormatError"),
    }
    assert run(spark, folder, place, settle=3600, share=share)[2] == n  # nothing new
    # a query of its own over the same plans reads all of it again
    again, told, n_again = run(spark, folder, place, settle=3600, share=share)
    fresh = audio.audio_stream(spark, str(folder), f"{place}/log", settle=3600, share=share).writeStream.format("parquet")
    query = fresh.option("path", f"{place}/out2").option("checkpointLocation", f"{place}/state2").trigger(availableNow=True).start()
    query.awaitTermination(120)
    rows = spark.read.parquet(f"{place}/out2").where("win IS NOT NULL").collect()
    assert len(rows) == len(again) and {(r["path"].rsplit("/", 1)[1], r["channel"], r["win"]): (r["n"], pytest.approx(r["sum_sq"]), pytest.approx(r["peak"])) for r in rows} == again


def test_plan_written_before_its_offset_is_used(tmp_path):
    """A driver that dies between the plan and Spark's own log loses and repeats nothing."""
    folder = tmp_path / "in"
    folder.mkdir()
    make = lambda: audio.AudioStreamReader(str(folder), str(tmp_path / "log"), False, 3600.0, 1 << 20, None)
    first = make()
    assert first.latestOffset() == first.initialOffset() == {"plan": 0}
    (folder / "a.wav").write_bytes(wav_bytes(signal(STEP, 1)))
    assert first.latestOffset() == {"plan": 1} and first.latestOffset() == {"plan": 1}
    second = make()  # started anew; knows the plan
    assert second.latestOffset() == {"plan": 1}
    old(folder / "a.wav")
    assert second.latestOffset() == {"plan": 2}
    for reader in (first, second, make()):
        told = [(p.first, p.last, p.closing) for shares in reader.partitions({"plan": 0}, {"plan": 2}) for p in shares.parts]
        assert len(reader.partitions({"plan": 0}, {"plan": 2})) == 1  # small shares share a task
        assert told == [(0, 44 + 4 * STEP, False), (44 + 4 * STEP, 44 + 4 * STEP, True)]
    for k in range(audio.KEEP):  # a list of the files seen stands for the plans before it
        (folder / f"n{k}.wav").write_bytes(wav_bytes(signal(3, k)))
        second.latestOffset()
    assert (tmp_path / "log" / f"seen-{audio.KEEP}").exists()
    third = make()
    assert third.latestOffset() == {"plan": audio.KEEP + 2} and third.seen == second.seen == json.loads(json.dumps(second.seen))


def test_short_shares_share_a_task(tmp_path):
    """Also where a share has fewer bytes than the files."""
    for k in range(150):
        (tmp_path / f"{k}.wav").write_bytes(wav_bytes(signal(100, k)))
    reader = audio.AudioStreamReader(str(tmp_path), str(tmp_path / "log"), False, 3600.0, 300, None)
    found = [shares.parts for shares in reader.partitions(reader.initialOffset(), reader.latestOffset())]
    assert sum(map(len, found)) == 300 and len(found) == 5 and max(map(len, found)) == 64


def test_results_as_files_close(spark, tmp_path):
    folder, place = tmp_path / "in", str(tmp_path / "work")
    folder.mkdir()
    signals = {f"{k}.wav": signal(3 * STEP + 40 * k, k) for k in range(3)}
    for name, x in signals.items():
        (folder / name).write_bytes(wav_bytes(x)[: -2 * STEP])

    def go():
        query = audio.follow(audio.audio_stream(spark, str(folder), f"{place}/log", settle=3600), place)
        query.awaitTermination(120)
        assert query.exception() is None
        return {r["path"].rsplit("/", 1)[1] for r in spark.read.parquet(f"{place}/files").collect()}

    assert go() == set()
    for k, name in enumerate(signals):
        (folder / name).write_bytes(wav_bytes(signals[name]))
        old(folder / name)
        assert go() == set(list(signals)[: k + 1])
    assert go() == set(signals)
    ranges.register(spark)
    from crestline.sources import files

    _, want = files.analyse(spark, str(folder))
    keyed = lambda df: sorted((r["track_id"].rsplit("/", 1)[1], r["channel"], round(r["dr_value"], 9), round(r["rms"], 9), r["peak"], r["sample_count"]) for r in df.collect())
    got = spark.read.parquet(f"{place}/channels")
    assert got.count() == 6 and keyed(got) == keyed(want)
