"""ALAC: packets against a plain decoder, one code and one sample at a time, and files through Spark."""

import numpy as np
import pytest

from crestline.sources import alac, bits, files, flac, mp4


def config(channels, width=16, frames=256):
    return alac.Config(frames, width, 40, 10, 14, channels, 44100)


def signal(channels, n, width, seed=1):
    rng, t, top = np.random.default_rng(seed), np.arange(n), 1 << (width - 1)
    x = np.stack([np.round(top * 0.6 * np.sin(t * (0.02 + 0.01 * k)) + rng.normal(0, 30, n)).astype(np.int64) for k in range(channels)])
    x[:, n // 3 : n // 2] = 0  # runs of zeros, also over packets
    x[0, n // 2 : n // 2 + 40] = rng.integers(-top, top, 40)  # errors that codes cannot hold
    return x


def decoded(packets, c):
    size = np.array([len(p) for p in packets], np.int64)
    return alac.decode_packets(bits.padded(b"".join(packets)), np.cumsum(size) - size, np.cumsum(size), c)


def wrap(x, width):
    return (x + (1 << (width - 1))) % (1 << width) - (1 << (width - 1))


class Plain:
    """One packet of elements of one and two channels, as the format is described; nothing is shared with the library."""

    def __init__(self, data, c):
        self.text, self.at, self.c = "".join(f"{b:08b}" for b in data), 0, c

    def take(self, n, signed=False):
        value = int(self.text[self.at : self.at + n] or "0", 2)
        self.at += n
        return value - (1 << n) if signed and n and value >> (n - 1) else value

    def code(self, k, m, wide):
        ones = 0
        while ones < 9 and self.take(1):
            ones += 1
        if ones == 9:
            return self.take(wide)
        if k == 1:
            return ones * m
        rest = int(self.text[self.at : self.at + k].ljust(k, "0"), 2)
        self.at += k - (rest < 2)
        return ones * m + max(0, rest - 1)

    def errors(self, n, pace, width):
        out, mean, zmode = [], self.c.mb, 0
        while len(out) < n:
            k = min(((mean >> 9) + 3).bit_length() - 1, self.c.kb)
            value = self.code(k, (1 << k) - 1, width)
            whole = value + zmode
            out.append(-(whole + 1) // 2 if whole % 2 else whole // 2)
            mean = pace * whole + mean - (pace * mean >> 9)
            if value > 65535:
                mean = 65535
            zmode = 0
            if mean * 4 < 512 and len(out) < n:
                k = 32 - mean.bit_length() - 24 + (mean + 16 >> 6)
                run = self.code(k, (1 << k) - 1 & (1 << self.c.kb) - 1, 16)
                out += [0] * run
                zmode, mean = int(run < 65535), 0
        return out

    def samples(self, missed, weights, shift, width):
        order = len(weights)
        if order == 0:
            return missed
        out = [missed[0]]
        for j in range(1, len(missed)):
            if order == 31 or j <= order:
                out.append(wrap(out[-1] + missed[j], width))
                continue
            top, miss = out[j - order - 1], missed[j]
            total = sum(w * (out[j - 1 - k] - top) for k, w in enumerate(weights))
            out.append(wrap(miss + top + (wrap(total + (1 << (shift - 1)), 32) >> shift), width))
            sign, left = (miss > 0) - (miss < 0), miss
            for k in range(order - 1, -1, -1):
                if left * sign <= 0:
                    break
                apart = top - out[j - 1 - k]
                way = (apart > 0) - (apart < 0)
                weights[k] -= way * sign
                left -= (order - k) * (sign * abs(apart) >> shift)
        return out

    def element(self, own):
        self.take(16)
        short, shifted, plain = self.take(1), self.take(2), self.take(1)
        n = self.take(32) if short else self.c.frames
        if plain:
            rows = [[self.take(self.c.bits, True) for _ in range(own)] for _ in range(n)]
            return [list(x) for x in zip(*rows, strict=True)]
        mix_bits, mix = self.take(8), self.take(8, True)
        told = [(self.take(4), self.take(4), self.take(3), [self.take(16, True) for _ in range(self.take(5))]) for _ in range(own)]
        low = [[self.take(8 * shifted) for _ in range(own)] for _ in range(n)]
        width, found = self.c.bits - 8 * shifted + (own == 2), []
        for mode, shift, pace, weights in told:
            missed = self.errors(n, self.c.pb * pace // 4, width)
            if mode:
                missed = self.samples(missed, [0] * 31, 0, width)
            found.append(self.samples(missed, weights, shift, width))
        if own == 2 and mix:
            left = [u + v - (mix * v >> mix_bits) for u, v in zip(*found, strict=True)]
            found = [left, [a - v for a, v in zip(left, found[1], strict=True)]]
        return [[(x << 8 * shifted) | low[i][k] for i, x in enumerate(row)] for k, row in enumerate(found)]

    def packet(self):
        out = []
        while (tag := self.take(3)) != 7:
            if tag == 6:
                self.take(8 * self.take(4))
            else:
                out += self.element(2 if tag == 1 else 1)
        return np.array(out)


CASES = [
    (2, 16, {}), (1, 16, {}), (2, 24, {"shifted": 1}), (2, 24, {"order": 8}), (6, 16, {"order": 8}), (2, 16, {"plain": True}), (2, 16, {"mode": 15}),
    (2, 16, {"order": 31}), (2, 20, {"order": 0}), (2, 32, {"shifted": 2}), (8, 24, {"mix": (0, 0)}), (3, 16, {"between": b"\xff\x00x"}), (2, 16, {"order": 30, "shift": 7}),
]


@pytest.mark.parametrize(("channels", "width", "how"), CASES)
def test_round_trip_and_plain_decoder(channels, width, how):
    c, x = config(channels, width), signal(channels, 900, width)
    packets = alac.encode(x, c, **how)
    got = decoded(packets, c)
    assert [g.shape for g in got] == [(channels, 256)] * 3 + [(channels, 132)]
    assert np.array_equal(np.concatenate(got, axis=1), x)
    for k, packet in enumerate(packets):
        assert np.array_equal(Plain(packet, c).packet(), got[k])


def test_packets_of_all_kinds_side_by_side():
    c = config(2)
    parts = [signal(2, 256, 16, seed) for seed in range(30)]
    parts[3][:], parts[4][:, 5:] = 0, 7
    how = [{}, {"order": 8}, {"plain": True}, {"mode": 15}, {"order": 0}, {"shift": 5, "order": 2}]
    packets = [alac.encode(x, c, **how[k % len(how)])[0] for k, x in enumerate(parts)]
    assert all(np.array_equal(a, b) for a, b in zip(decoded(packets, c), parts, strict=True))


def test_failed_packets():
    c, x = config(2), signal(2, 256 * 6, 16)
    packets = alac.encode(x, c)
    packets[1], packets[2], packets[3] = packets[1][:40], b"", b"\x40\xff" + packets[3][2:]  # cut, empty, header bits that must be zero
    packets[4] = alac.encode(x[:1, :256], config(1))[0]  # one channel of two
    got = decoded(packets, c)
    assert [g is None for g in got] == [False, True, True, True, True, False]
    assert np.array_equal(got[5], x[:, 256 * 5 :])
    rng = np.random.default_rng(5)
    decoded([rng.bytes(int(n)) for n in rng.integers(1, 200, 300)], c)  # noise ends


def test_files_through_spark(spark, tmp_path):
    c = config(6, 24)
    x = signal(6, 3000, 24)
    packets = alac.encode(x, c, shifted=1)
    ticks = [256] * (len(packets) - 1) + [3000 - 256 * (len(packets) - 1)]
    setup = mp4.box(b"alac", bytes(4), c.packed())
    (tmp_path / "a.m4a").write_bytes(mp4.write_mp4(b"alac", packets, ticks, 44100, 6, 24, setup))
    (tmp_path / "a.flac").write_bytes(flac.encode(x, 44100, 24))
    broken = [p if k != 2 else p[:30] for k, p in enumerate(packets)]
    (tmp_path / "broken.m4a").write_bytes(mp4.write_mp4(b"alac", broken, ticks, 44100, 6, 24, setup))
    (tmp_path / "odd.m4a").write_bytes(mp4.write_mp4(b"alac", packets, ticks, 44100, 6, 24, mp4.box(b"alac", bytes(28))))
    meta, found = files.analyse(spark, str(tmp_path))
    got = {r["path"].rsplit("/", 1)[1]: (r["codec"], r["actual_frames"], r["skipped_packets"], r["is_partial"], r["lfe_indices"], r["error_kind"]) for r in meta.collect()}
    assert got == {"a.m4a": ("ALAC", 3000, 0, False, [5], None), "a.flac": ("FLAC", 3000, 0, False, [3], None), "broken.m4a": ("ALAC", 2744, 1, True, [5], None), "odd.m4a": (None, None, None, None, None, "FormatError")}
    values = {(r["track_id"].rsplit("/", 1)[1], r["channel"]): (r["dr_value"], r["rms"], r["peak"]) for r in found.collect()}
    assert all(values["a.m4a", k] == pytest.approx(values["a.flac", k]) for k in range(6))


def test_short_files_are_decoded_and_made_side_by_side(monkeypatch):
    """Packets of 50 files in one call, with the results of each file by itself; a broken file fails alone."""
    import pyarrow as pa

    from crestline.sources import files, mp4, registry

    rng, c = np.random.default_rng(3), alac.Config(192, 16, 40, 10, 14, 2, 300)
    tracks = [rng.integers(-9000, 9000, (2, 192 * 3 + 40 * (k % 3))) for k in range(50)]
    each = alac.encode_each(tracks, c)
    assert each == [alac.encode(x, c) for x in tracks]
    made = []
    for x, payload in zip(tracks, each, strict=True):
        ticks = [min(192, x.shape[1] - a) for a in range(0, x.shape[1], 192)]
        made.append(mp4.write_mp4(b"alac", payload, ticks, 300, 2, 16, mp4.box(b"alac", bytes(4), c.packed())))
    made[11] = made[11].replace(each[11][1], b"\xff" * len(each[11][1]))  # a packet that fails
    made[30] = made[30][:40]
    batch = pa.RecordBatch.from_pydict({"path": [f"file:/{k:02d}.m4a" for k in range(50)], "content": made})
    calls, own = [], alac.decode_packets
    monkeypatch.setattr(alac, "decode_packets", lambda data, starts, *rest: calls.append(len(starts)) or own(data, starts, *rest))
    read = files._read_files(registry.known_decoders())
    together = [row for out in read(iter([batch])) for row in out.to_pylist()]
    assert len(calls) == 1
    alone = [row for k in range(50) for out in read(iter([batch.slice(k, 1)])) for row in out.to_pylist()]
    order = lambda rows: sorted(map(str, rows))
    assert order(together) == order(alone) and len(calls) == 50
    told = {row["path"]: row for row in together if row["win"] is None}
    assert [p for p, row in told.items() if row["error"]] == ["file:/30.m4a"] and told["file:/11.m4a"]["skipped_packets"] == 1
    assert all(told[f"file:/{k:02d}.m4a"]["actual_frames"] == x.shape[1] for k, x in enumerate(tracks) if k not in (11, 30))
