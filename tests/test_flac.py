"""FLAC: every kind of frame bit for bit, ranges of files, broken frames."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from crestline.operators import channels
from crestline.sources import bits, files, flac


def signal(n, count, width, seed=1, shift=0):
    rng, t = np.random.default_rng(seed), np.arange(n)
    x = np.stack([0.3 * np.sin(t / (20 + 5 * k)) + rng.normal(0, 0.02, n) for k in range(count)])
    x[:, n // 3 : n // 2] *= 0.001  # quiet, so that parameters change
    top = 1 << (width - 1)
    return np.clip(np.round(x * top), -top, top - 1).astype(np.int64) >> shift << shift


def decoded(data):
    info = flac.stream_info(lambda n, at: data[at : at + n], len(data))
    return [samples for _, samples in flac.frames_of(bits.padded(data), info, info.start)]


KINDS = [
    {}, {"kind": "verbatim"}, {"kind": ["fixed0", "fixed1", "fixed2", "fixed3", "fixed4"]}, {"kind": ["lpc1", "lpc8", "lpc12", "lpc32"]}, {"escape": [False, True, True], "parts": [0, 3]},
    {"stereo": ["left", "right", "mid", "plain"], "parts": [0, 1, 2, 4, 6]}, {"kind": ["fixed2", "verbatim", "lpc4", "constant", "best"]},
]


@pytest.mark.parametrize("width", [8, 16, 20, 24, 32])
@pytest.mark.parametrize("how", KINDS, ids=str)
def test_round_trip(width, how):
    for count in (1, 2, 6):
        for x in (signal(4500, count, width), signal(4500, count, width, shift=3), np.full((count, 2500), 7)):
            if "constant" in str(how) and x.shape[1] == 4500:
                x[:, 3 * 1024 : 4 * 1024] = -3  # the fourth block
            data = flac.encode(x, 44100, width, block=1024, **how)
            got = decoded(data)
            assert all(g is not None for g in got) and (np.concatenate(got, axis=1) == x).all()
            own, told = flac.md5(data)
            assert own == told


def test_block_sizes_and_empty():
    for block in (16, 192, 256, 576, 1000, 4096, 4608, 65535):
        x = signal(70000 if block > 5000 else 3000, 2, 16)
        got = decoded(flac.encode(x, 48000, 16, block=block))
        assert (np.concatenate(got, axis=1) == x).all()
    assert decoded(flac.encode(np.zeros((2, 0)), 48000)) == []


def test_full_scale_and_long_codes():
    """Square waves at full scale, and single spikes among silence: codes with long runs of zeros."""
    square = np.where(np.arange(6000) // 50 % 2, 32767, -32768)[None].repeat(2, axis=0)
    spikes = np.zeros((2, 6000), np.int64)
    spikes[0, ::977], spikes[1, ::1409] = 8_388_607, -8_388_608
    for x, width in ((square, 16), (spikes, 24)):
        for kind in ("fixed0", "fixed2", "lpc2"):
            assert (np.concatenate(decoded(flac.encode(x, 44100, width, kind=kind, stereo="plain", parts=0)), axis=1) == x).all()


def test_crc():
    data = np.random.default_rng(1).integers(0, 256, 5000, dtype=np.uint8)
    starts, ends = np.array([0, 10, 700, 30]), np.array([5, 4000, 5000, 30])
    assert flac.CRC16.many(data, starts, ends).tolist() == [flac.CRC16.one(data[a:b].tobytes()) for a, b in zip(starts, ends, strict=True)]
    assert flac.CRC8.one(b"123456789") == 0xF4 and flac.CRC16.one(b"123456789") == 0xFEE8


def test_tags_and_metadata_before_frames():
    x = signal(5000, 2, 16)
    data = flac.encode(x, 44100)
    info, frames = data[4:42], data[42:]
    tag = b"ID3\4\0\0" + bytes([0, 0, 1, 5]) + b"t" * 133
    long = tag + b"fLaC" + b"\x00" + info[1:] + b"\x04" + (3000).to_bytes(3, "big") + b"\xff\xf8" * 1500 + b"\x81" + (10).to_bytes(3, "big") + bytes(10) + frames
    assert (np.concatenate(decoded(long), axis=1) == x).all()


def test_broken_frames():
    x = signal(40_960, 2, 16)
    data = bytearray(flac.encode(x, 44100, 16, block=1024))
    for at in (len(data) // 2, len(data) // 2 + 40, len(data) * 3 // 4):
        data[at] ^= 0x55
    info = flac.stream_info(lambda n, at: bytes(data[at : at + n]), len(data))
    found = list(flac.frames_of(bits.padded(bytes(data)), info, info.start))
    lost = [place for place, samples in found if samples is None]
    assert len(lost) == 2 and len(found) == 40
    for place, samples in found:
        assert samples is None or (samples == x[:, place : place + 1024]).all()
    known, blocks = flac.decode_flac(bytes(data))
    assert sum(map(len, blocks)) == 38 * 1024 and known.skipped_packets == 2
    garbage = bytes(data[: info.start]) + b"".join(bytes(data[info.start + 5 * k : info.start + 5 * k + 0]) for k in range(3))
    assert decoded(garbage) == []


def test_frame_header_within_a_frame():
    """Sample data that look like the header of a frame, checksum and all, are not taken for one."""
    false = flac.encode_frame(signal(4096, 2, 16), 3, 16)[:7]
    x = signal(8192, 2, 16, 2)
    x[:, 100:107] = 0
    raw = np.frombuffer(false + b"\0", ">i2").astype(np.int64)
    x[0, 1000 : 1000 + len(raw)] = raw
    data = flac.encode(x, 44100, 16, kind="verbatim", stereo="plain")
    assert (np.concatenate(decoded(data), axis=1) == x).all()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("flac")
    for k, (count, width, rate, how) in enumerate([(2, 16, 44100, {}), (1, 24, 48000, {"kind": "lpc4"}), (6, 16, 44100, {"parts": 4}), (2, 32, 44100, {})]):
        (d / f"{k}.flac").write_bytes(flac.encode(signal(150_000, count, width, k), rate, width, **how))
    broken = bytearray((d / "0.flac").read_bytes())
    broken[len(broken) // 2] ^= 0xFF
    (d / "broken.FLAC").write_bytes(bytes(broken))
    (d / "cut.flac").write_bytes((d / "0.flac").read_bytes()[:100_000])
    (d / "empty.flac").write_bytes(b"")
    (d / "false.flac").write_bytes(b"fLaC" + b"\x84\0\0\x04abcd")
    return d


@pytest.mark.parametrize("share", [90_000, 64 << 20])
def test_ranges_equal_whole_files(spark, folder, share):
    meta, found = files.analyse(spark, str(folder), share=share)
    meta = {r["path"].rsplit("/", 1)[1]: r for r in meta.collect()}
    assert {n for n, r in meta.items() if r["error"]} == {"empty.flac", "false.flac"}
    assert {n: (r["actual_frames"], r["skipped_packets"], r["is_partial"]) for n, r in meta.items() if not r["error"] and n != "cut.flac"} == {
        **{f"{k}.flac": (150_000, 0, False) for k in range(4)}, "broken.FLAC": (150_000 - 4096, 1, True)
    }
    assert meta["cut.flac"]["is_partial"] and meta["cut.flac"]["actual_frames"] % 4096 == 0
    assert meta["2.flac"]["lfe_indices"] == [3] and meta["1.flac"]["bits_per_sample"] == 24 and meta["0.flac"]["codec"] == "FLAC"
    got = {(r["track_id"].rsplit("/", 1)[1], r["channel"]): r["dr_value"] for r in found.collect()}
    for k, (count, width, rate) in enumerate([(2, 16, 44100), (1, 24, 48000), (6, 16, 44100), (2, 32, 44100)]):
        x = signal(150_000, count, width, k) / (1 << (width - 1))
        rows = spark.range(150_000).select(F.lit("t").alias("track_id"), F.col("id").alias("frame_idx"))
        want = []
        for c in range(count):
            values = spark.createDataFrame([(i, float(np.float32(v))) for i, v in enumerate(x[c])], "frame_idx long, sample double") if k == 1 and share == 90_000 else None
            if values is not None:
                want = channels.channel_dr(rows.join(values, "frame_idx").withColumn("channel", F.lit(c)), rate).collect()
                assert got[f"{k}.flac", c] == pytest.approx(want[0]["dr_value"], abs=1e-9)
    whole = files.window_files(files.contents(spark, str(folder)).where(~F.col("path").contains("broken")))
    want = {(r["path"].rsplit("/", 1)[1], r["channel"], r["win"]): (r["n"], r["sum_sq"], r["peak"]) for r in whole.collect()}
    parts = spark.read.format("audio_windows").option("share", share).load(str(folder)).where("win IS NOT NULL").where(~F.col("path").contains("broken"))
    parts = parts.groupBy("path", "channel", "win").agg(F.sum("n").alias("n"), F.sum("sum_sq").alias("s"), F.max("peak").alias("p")).collect()
    assert {(r["path"].rsplit("/", 1)[1], r["channel"], r["win"]): (r["n"], pytest.approx(r["s"]), pytest.approx(r["p"])) for r in parts} == want


def test_digest_is_that_of_the_samples():
    x = signal(3000, 2, 24)
    data = flac.encode(x, 96000, 24)
    raw = b"".join(int(v).to_bytes(3, "little", signed=True) for v in x.T.reshape(-1))
    assert flac.md5(data) == (hashlib.md5(raw, usedforsecurity=False).digest(),) * 2


def test_short_files_are_decoded_side_by_side(tmp_path, monkeypatch):
    """As many decoding steps as there are block sizes, not as there are files; broken files fail alone."""
    from crestline.sources import dsd, ranges

    tracks = {f"{k:02d}.flac": signal(192 * 4 + 50 * (k % 3), 2, 16, seed=k) for k in range(60)}
    for name, x in tracks.items():
        (tmp_path / name).write_bytes(flac.encode(x, 300, 16, block=192))
    broken = bytearray((tmp_path / "07.flac").read_bytes())
    broken[len(broken) // 2] ^= 0x10
    (tmp_path / "07.flac").write_bytes(bytes(broken))
    (tmp_path / "20a.flac").write_bytes(b"no such file")
    (tmp_path / "20b.flac").write_bytes(b"")
    calls, own = [], flac._decode
    monkeypatch.setattr(flac, "_decode", lambda data, frames, room: calls.append(len(frames)) or own(data, frames, room))
    reader = ranges.AudioWindowsReader(str(tmp_path), False, 64 << 20, ("flac",), dsd.Plan())
    rows = [row for part in reader.partitions() for batch in reader.read(part) for row in batch.to_pylist()]
    assert len(calls) <= 3 + 3  # three block sizes; the broken frame alone
    told = {row["path"].rsplit("/", 1)[-1]: row for row in rows if row["win"] is None}
    assert len(told) == len(tracks) + 2 and {k for k, v in told.items() if v["error"]} == {"20a.flac", "20b.flac"}
    assert {k: v["skipped_packets"] for k, v in told.items() if v["skipped_packets"]} == {"07.flac": 1}
    for name, x in tracks.items():
        found = sorted((row["channel"], row["win"], row["n"], row["sum_sq"]) for row in rows if row["win"] is not None and row["path"].endswith(name))
        if name == "07.flac":
            assert sum(n for c, _, n, _ in found if c == 0) == told[name]["actual_frames"] == x.shape[1] - 192
            continue
        assert told[name]["actual_frames"] == x.shape[1]
        wanted = [(c, w, x[c, 900 * w : 900 * (w + 1)]) for c in range(2) for w in range(-(-x.shape[1] // 900))]
        assert [(c, w, n) for c, w, n, _ in found] == [(c, w, len(part)) for c, w, part in wanted]
        assert np.allclose([s for *_, s in found], [((part / 32768) ** 2).sum() for *_, part in wanted])


def test_one_bad_frame_among_many_is_found_by_halves(monkeypatch):
    """A frame whose checksum is right but that cannot be decoded costs some calls, and only itself."""
    x = signal(192 * 64, 2, 16)
    data = flac.encode(x, 44100, block=192)
    info = flac.stream_info(lambda n, at: data[at : at + n], len(data))
    calls, own = [], flac._decode
    bad = [h.at for h in flac._part(bits.padded(data), info, info.start, None).heads][37]

    def decode(data, frames, room):
        calls.append(len(frames))
        if any(h.at == bad for h in frames):
            raise ValueError("bad")
        return own(data, frames, room)

    monkeypatch.setattr(flac, "_decode", decode)
    found = list(flac.frames_of(bits.padded(data), info, info.start))
    assert [k for k, (_, samples) in enumerate(found) if samples is None] == [37] and len(calls) <= 2 * 6 + 2
    assert all((samples == x[:, place : place + 192]).all() for place, samples in found if samples is not None)
