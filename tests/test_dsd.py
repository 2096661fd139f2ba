"""One-bit files: a made sine comes back, ranges equal one task, plans, broken files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from crestline.functions import describe
from crestline.operators.windows import window_frames
from crestline.sources import dsd, files, ranges
from crestline.sources.registry import AudioError


def modulated(x):
    """Second-order noise shaping: ones and zeros whose local mean follows x."""
    out, a, b = np.zeros(len(x), np.uint8), 0.0, 0.0
    for i, v in enumerate(x.tolist()):
        y = 1.0 if b >= 0 else -1.0
        a += v - y
        b += a - 2 * y
        out[i] = y > 0
    return out


def reader(data):
    return lambda n, at: data[at : at + n]


def whole(data, plan=dsd.Plan()):
    known, blocks = dsd.decoder(plan)(data)
    return known, np.concatenate(list(blocks))


RATE = 2_822_400


@pytest.fixture(scope="module")
def sine():
    t = np.arange(RATE // 10) / RATE
    return np.stack([modulated(0.4 * np.sin(2 * np.pi * 1000 * t)), modulated(0.25 * np.sin(2 * np.pi * 5000 * t))])


def test_sine_comes_back(sine):
    known, got = whole(dsd.write_dsf(sine, RATE))
    assert (known.sample_rate, known.processed_sample_rate, known.sample_count, known.codec) == (352800, 352800, RATE // 80, "DSD")
    t = (np.arange(len(got)) * 8 + 3.5) / RATE  # a sample stands over the middle of its byte
    gain = 10 ** (6 / 20)
    for c, (level, tone) in enumerate([(0.4, 1000), (0.25, 5000)]):
        want = gain * level * np.sin(2 * np.pi * tone * t)
        assert np.abs(got[200:-200, c] - want[200:-200]).max() < 0.03
        assert np.sqrt(np.mean((got[200:-200, c] - want[200:-200]) ** 2)) < 0.008


def test_orders_blocks_and_formats_give_the_same(sine):
    bits = sine[:, : 8 * 12_345]
    _, want = whole(dsd.write_dsf(bits, RATE))
    for data in (dsd.write_dsf(bits, RATE, low_first=False), dsd.write_dsf(bits, RATE, block=512), dsd.write_dff(bits, RATE)):
        assert np.array_equal(whole(data)[1], want)


def test_filter_is_a_plain_convolution():
    rng = np.random.default_rng(3)
    bits = rng.integers(0, 2, (1, 8 * 900)).astype(np.uint8)
    for plan in (dsd.Plan(), dsd.Plan(rate=RATE // 16), dsd.Plan(rate=RATE // 32, mode="studio", gain_db=0.0), dsd.Plan(mode="off")):
        data = dsd.write_dff(bits, RATE)
        info = dsd.probe(reader(data), len(data))
        step = dsd.step_bytes(info, plan)
        length = 8 * dsd.SPAN * step
        h = dsd.taps(dsd.cutoff(info, plan), length, plan.gain_db)
        signs = np.concatenate([np.zeros(length), bits[0] * 2.0 - 1, np.zeros(length)])
        want = []
        for n in range(bits.shape[1] // 8 // step):
            begin = length + 8 * (n * step - (dsd.SPAN * step - step) // 2)
            want.append(signs[begin : begin + length] @ h)
        assert np.allclose(dsd.samples(info, plan, reader(data), 0, len(want))[0], want)


def test_plan_is_that_of_the_columns(spark):
    modes, rates = ["teac", "studio"], [2_822_400, 5_644_800, 11_289_600, 3_072_000]
    rows = spark.createDataFrame([(m, r) for m in modes for r in rates], "mode string, native int")
    tier = describe.dsd_tier(F.col("native"))
    found = rows.select("mode", "native", describe.dsd_cutoff_hz(F.col("mode"), tier, F.lit(352800)).alias("hz")).collect()
    for r in found:
        info = dsd.Info(r["native"], 2, 8000, 0, 1, False, "DFF")
        if r["native"] % (8 * 352800) == 0:
            assert dsd.cutoff(info, dsd.Plan(mode=r["mode"])) * r["native"] == pytest.approx(r["hz"])
    assert dsd.step_bytes(dsd.Info(5_644_800, 2, 8000, 0, 1, False, "DFF"), dsd.Plan()) == 2


def test_broken():
    good = dsd.write_dsf(np.zeros((2, 8 * 5000), np.uint8), RATE)
    for data in (b"", b"DSD ", good[:60], b"FRM8" + good, good[:28] + b"junk"):
        with pytest.raises(AudioError):
            dsd.decoder()(data)
    known, got = whole(good[: 92 + 4096 + 100])  # the second channel has 100 bytes
    assert known.sample_count == len(got) == 100


@pytest.mark.parametrize("share", [100_000, 64 << 20])
def test_ranges_equal_whole_files(spark, tmp_path, share):
    rng = np.random.default_rng(4)
    low = 16_000  # a slow clock, so that windows are short
    bits = rng.integers(0, 2, (2, 8 * 150_001)).astype(np.uint8)
    (tmp_path / "a.dsf").write_bytes(dsd.write_dsf(bits, low))
    (tmp_path / "b.DFF").write_bytes(dsd.write_dff(bits, low))
    (tmp_path / "c.dsf").write_bytes(b"no such file")
    plan = dsd.Plan(rate=1000)
    meta, found = files.analyse(spark, str(tmp_path), share=share, plan=plan)
    got = {r["path"].rsplit("/", 1)[1]: (r["error_kind"], r["sample_rate"], r["processed_sample_rate"], r["actual_frames"], r["is_partial"]) for r in meta.collect()}
    assert got == {"a.dsf": (None, 2000, 1000, 75_000, False), "b.DFF": (None, 2000, 1000, 75_000, False), "c.dsf": ("FormatError", None, None, None, None)}
    decoders = {e: dsd.decoder(plan) for e in ("dsf", "dff")}
    want = files.window_files(files.contents(spark, str(tmp_path)), decoders)
    want = {(r["path"].rsplit("/", 1)[1], r["channel"], r["win"]): (r["n"], r["sum_sq"], r["peak"]) for r in want.collect()}
    assert len(want) == 2 * 2 * -(-75_000 // window_frames(2000))
    rows = spark.read.format("audio_windows").option("share", share).option("dsd_rate", 1000).load(str(tmp_path)).where("win IS NOT NULL").collect()
    assert {(r["path"].rsplit("/", 1)[1], r["channel"], r["win"]): (r["n"], pytest.approx(r["sum_sq"]), r["peak"]) for r in rows} == want and len(rows) == len(want)
    values = {(r["track_id"].rsplit("/", 1)[1], r["channel"]): r["dr_value"] for r in found.collect()}
    assert values["a.dsf", 1] == values["b.DFF", 1]


def test_levels_are_those_of_the_sums_in_doubles(tmp_path):
    """Samples once became float32 before they were squared, and some levels were rounded another way than by SQL."""
    plan, rng = dsd.Plan(rate=100), np.random.default_rng(5)
    wanted = {}
    for k in range(20):
        data = dsd.write_dff(rng.integers(0, 2, (1, 1280)).astype(np.uint8), 800)
        (tmp_path / f"{k}.dff").write_bytes(data)
        wanted[f"{k}.dff"] = dsd.samples(dsd.probe(reader(data), len(data)), plan, reader(data), 0, 160)[0]
        assert np.array_equal(whole(data, plan)[1][:, 0], wanted[f"{k}.dff"])
    source = ranges.AudioWindowsReader(str(tmp_path), False, 300, ranges.CUT, plan)
    rows = [r for part in source.partitions() for batch in source.read(part) for r in batch.to_pylist() if r["win"] is not None]
    assert len(rows) == len(wanted)
    for r in rows:
        x = wanted[r["path"].rsplit("/", 1)[1]]
        assert (r["n"], r["peak"]) == (160, np.abs(x).max()) and r["sum_sq"] == pytest.approx(x @ x, rel=1e-14)
