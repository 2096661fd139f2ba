"""MP4: boxes, packets, decoding and routing."""

import struct
import sys

import numpy as np
import pytest

from crestline.sources import files, flac, mp4, registry


def reader(data):
    return lambda n, at: data[at : at + n]


def flac_parts(x, rate, width=16, block=512):
    whole = flac.encode(x, rate, width, block)
    frames = [flac.encode_frame(x[:, a : a + block], k, width) for k, a in enumerate(range(0, x.shape[1], block))]
    assert whole.endswith(b"".join(frames))
    return mp4.box(b"dfLa", b"\0\0\0\0", whole[4:42]), frames


def signal(n, seed=1):
    return np.round(np.random.default_rng(seed).normal(0, 3000, (2, n))).astype(np.int64)


@pytest.mark.parametrize("front", [True, False])
@pytest.mark.parametrize("per_chunk", [1, 3, 100])
def test_packets_of_made_files(front, per_chunk):
    rng = np.random.default_rng(per_chunk)
    payload = [rng.bytes(int(n)) for n in rng.integers(1, 90, 20)]
    ticks = [1024] * 12 + [512] * 7 + [100]
    data = mp4.write_mp4(b"mp4a", payload, ticks, 48000, 2, 16, mp4.box(b"esds", bytes(20)), per_chunk, front)
    track = mp4.audio_track(reader(data), len(data))
    assert (track.codec, track.rate, track.channels, track.bits, track.timescale, track.duration) == (b"mp4a", 48000, 2, 16, 48000, sum(ticks)) and b"esds" in track.setup
    first, length, at, size = mp4.packets(track)
    assert [data[a : a + n] for a, n in zip(at, size, strict=True)] == payload
    assert length.tolist() == ticks and first.tolist() == (np.cumsum(ticks) - ticks).tolist()


def test_tables_with_runs_wide_places_and_small_sizes():
    track = mp4.Track(rate=48000, timescale=48000)
    full = lambda *numbers: struct.pack(f">I{len(numbers)}I", 0, *numbers)
    track.tables = {
        b"stts": full(2, 3, 10, 6, 20), b"stsc": full(3, 1, 2, 1, 2, 1, 1, 4, 3, 1), b"stz2": struct.pack(">IIB3xI", 0, 4, 0, 9)[:4] + struct.pack(">I", 4) + struct.pack(">I", 9) + bytes([0x12, 0x34, 0x56, 0x78, 0x90]),
        b"co64": struct.pack(">II5Q", 0, 5, 1 << 33, 100, 200, 300, 400),
    }
    first, ticks, at, size = mp4.packets(track)
    assert size.tolist() == [1, 2, 3, 4, 5, 6, 7, 8, 9]
    assert at.tolist() == [1 << 33, (1 << 33) + 1, 100, 200, 300, 305, 311, 400, 408] and ticks.tolist() == [10] * 3 + [20] * 6 and first[-1] == 130


def test_malformed():
    good = mp4.write_mp4(b"sowt", [b"ab"], [1], 8000, 1, 16)
    for data in (b"", b"short", b"x" * 100, good[:200], good[:40], good.replace(b"soun", b"vide"), good.replace(b"stsz", b"xxxx")):
        with pytest.raises(registry.AudioError):
            known, blocks = mp4.decode_mp4(data)
    bad = struct.pack(">I4s", 4, b"moov")
    with pytest.raises(registry.AudioError, match="no room"):
        mp4.audio_track(reader(b"\0\0\0\x08ftyp" + bad), 16)
    wide = b"\0\0\0\x08ftyp" + struct.pack(">I4sQ", 1, b"free", 20) + b"abcd" + struct.pack(">I4s", 0, b"mdat") + b"rest"
    assert [(n, b - a) for n, a, b in mp4.boxes(reader(wide), 0, len(wide))] == [(b"ftyp", 0), (b"free", 4), (b"mdat", 4)]


@pytest.mark.parametrize("codec", [b"sowt", b"twos", b"fl32"])
def test_plain_samples(codec):
    x = signal(1000).T
    raw = {b"sowt": x.astype("<i2"), b"twos": x.astype(">i2"), b"fl32": (x / 32768).astype(">f4")}[codec].tobytes()
    step = len(raw) // 10
    data = mp4.write_mp4(codec, [raw[k * step : (k + 1) * step] for k in range(10)], [100] * 10, 44100, 2, 32 if codec == b"fl32" else 16)
    known, blocks = mp4.decode_mp4(data)
    assert np.array_equal(np.concatenate(list(blocks)), (x / 32768).astype(np.float32)) and known.sample_count == 1000


def test_files_through_spark(spark, tmp_path):
    x = signal(5000)
    setup, frames = flac_parts(x, 44100)
    ticks = [512] * (len(frames) - 1) + [5000 - 512 * (len(frames) - 1)]
    (tmp_path / "a.m4a").write_bytes(mp4.write_mp4(b"fLaC", frames, ticks, 44100, 2, 16, setup))
    broken = [f if k != 4 else f[:20] + b"\0\0\0" + f[23:] for k, f in enumerate(frames)]
    (tmp_path / "broken.m4a").write_bytes(mp4.write_mp4(b"fLaC", broken, ticks, 44100, 2, 16, setup, front=False))
    samples = (x.T / 32768).astype("<f4").tobytes()
    (tmp_path / "atmos.MP4").write_bytes(mp4.write_mp4(b"ec-3", [samples], [5000], 44100, 2, 16))
    (tmp_path / "lossy.m4a").write_bytes(mp4.write_mp4(b"mp4a", [b"abc"], [1024], 44100, 2, 16))
    (tmp_path / "none.mp4").write_bytes(b"nothing of that kind")
    # a stand-in program: takes the packets out of the file as they are
    program = "import sys; d = sys.stdin.buffer.read(); a = d.index(b'mdat') + 4; sys.stdout.buffer.write(d[a : a + 40000])"
    decoders = {"eac3": registry.process_decoder([sys.executable, "-c", program], 44100, 2)}
    meta, found = files.analyse(spark, str(tmp_path), decoders=decoders)
    got = {r["path"].rsplit("/", 1)[1]: (r["error_kind"], r["codec"], r["actual_frames"], r["skipped_packets"]) for r in meta.collect()}
    assert got == {
        "a.m4a": (None, "FLAC", 5000, 0), "broken.m4a": (None, "FLAC", 4488, 1), "atmos.MP4": (None, "MP4", 5000, 0),
        "lossy.m4a": ("DecodingError", None, None, None), "none.mp4": ("FormatError", None, None, None),
    }
    values = {(r["track_id"].rsplit("/", 1)[1], r["channel"]): r["dr_value"] for r in found.collect()}
    assert values["a.m4a", 0] == pytest.approx(values["atmos.MP4", 0]) and values["a.m4a", 1] == pytest.approx(values["atmos.MP4", 1])

    table = mp4.packet_table(spark, str(tmp_path))
    assert {r["path"].rsplit("/", 1)[1] for r in table.where("error IS NOT NULL").collect()} == {"none.mp4"}
    rows = mp4.payloads(table).where("path LIKE '%/a.m4a'").orderBy("seq").collect()
    assert [bytes(r["payload"]) for r in rows] == frames and [r["n_frames"] for r in rows] == ticks and rows[-1]["first_frame"] == sum(ticks[:-1])
