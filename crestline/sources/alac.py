"""Apple Lossless packets: adaptive Golomb codes and a predictor that follows the signs of its errors; and an encoder.

A packet stands alone: it brings the predictor's first weights, and the mean that chooses the code of each error starts anew.
Within it all is sequential: a code's length depends on those before it, and each error moves the weights by one. Sample n of
all packets of a group is therefore decoded in one step of array operations, then sample n + 1. Elements (one channel, two
channels, low frequencies) are taken in the order in which packets hold them, those of one kind together.

A packet that reads beyond its end, has the wrong number of channels or an unknown element is a failed packet.
"""

from __future__ import annotations

import struct
from collections.abc import Hashable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np

from crestline.constants import MAX_CHANNELS
from crestline.sources import bits
from crestline.sources.registry import AudioError, AudioFormat, Packets

#: Fixed values of the format: elements, bits of the fraction of the mean, most ones of a code, bits of a long run of zeros,
#: the largest error that counts for the mean, the order that means differences alone.
ONE, TWO, LOW, DATA, FILL, END = 0, 1, 3, 4, 6, 7
MEAN_BITS, MOST_ONES, RUN_BITS, MOST, DIFFERENCES = 9, 9, 16, 0xFFFF, 31
#: Place of the low-frequency channel by number of channels.
LOW_PLACE = {6: 5, 7: 6, 8: 7}
#: Packets decoded side by side.
GROUP = Packets.GROUP
_ONES = np.array([MOST_ONES - (~x & 511).bit_length() for x in range(512)])


@dataclass(frozen=True)
class Config:
    frames: int
    bits: int
    pb: int
    mb: int
    kb: int
    channels: int
    rate: int

    def format(self, total: int) -> AudioFormat:
        low = [LOW_PLACE[self.channels]] if self.channels in LOW_PLACE else []
        return AudioFormat(self.rate, self.channels, self.bits, total, "ALAC", low, bool(low))

    def packed(self) -> bytes:
        return struct.pack(">IBBBBBBHIII", self.frames, 0, self.bits, self.pb, self.mb, self.kb, self.channels, 255, 0, 0, self.rate)


def config(raw: bytes) -> Config:
    if len(raw) < 24:
        raise AudioError("FormatError", "no ALAC configuration")
    frames, version, width, pb, mb, kb, channels, _, _, _, rate = struct.unpack_from(">IBBBBBBHIII", raw)
    if version or not 1 <= channels <= MAX_CHANNELS or width not in (16, 20, 24, 32) or not 0 < frames <= 1 << 16 or not rate or not 1 <= kb <= 16:
        raise AudioError("FormatError", f"ALAC of {rate} Hz, {channels} channels, {width} bits, {frames} frames a packet")
    return Config(frames, width, pb, mb, kb, channels, rate)


def _wrapped(x: np.ndarray, width: np.ndarray) -> np.ndarray:
    half = np.int64(1) << (width - 1)
    return ((x + half) & (2 * half - 1)) - half


def _code_bits(mean: np.ndarray, most: int) -> np.ndarray:
    return np.minimum(np.frexp(((mean >> MEAN_BITS) + 3).astype(np.float64))[1].astype(np.int64) - 1, most)


def _run_bits(mean: np.ndarray) -> np.ndarray:
    return 8 - np.frexp(mean.astype(np.float64))[1].astype(np.int64) + ((mean + 16) >> 6)


def _next_mean(mean: np.ndarray, value: np.ndarray, after: np.ndarray, pace: np.ndarray) -> np.ndarray:
    out = pace * (value + after) + mean - ((pace * mean) >> MEAN_BITS)
    return np.where(value > MOST, MOST, out)


def _code(w: np.ndarray, at: np.ndarray, k: np.ndarray, m: np.ndarray, wide: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Value and length of the code at each place: ones, each for m, then k bits or, for a rest of 0, one bit less. After
    nine ones the value stands plainly."""
    ones = _ONES[(bits.peek(w, at) >> np.uint64(55)).astype(np.int64)]
    rest = bits.read(w, at + ones + 1, k)
    none = rest < 2
    value, used = ones * m + np.where(none, 0, rest - 1), ones + 1 + k - none
    plain = ones == MOST_ONES
    if plain.any():
        value = np.where(plain, bits.read(w, at + MOST_ONES, wide), value)
        used = np.where(plain, MOST_ONES + wide, used)
    return value, used


def _errors(w: np.ndarray, at: np.ndarray, n: np.ndarray, c: Config, pace: np.ndarray, width: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Errors of prediction, (samples, packets), and where their codes end."""
    at, most = at.copy(), int(n.max(initial=0))
    out = np.zeros((most, len(at)), np.int64)
    mean, zeros, after = np.full(len(at), c.mb, np.int64), np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    for i in range(most):
        busy = np.flatnonzero((n > i) & (zeros == 0))
        zeros -= zeros > 0
        if not len(busy):
            continue
        k = _code_bits(mean[busy], c.kb)
        value, used = _code(w, at[busy], k, (1 << k) - 1, width[busy])
        here = np.minimum(at[busy] + used, end[busy] + 1)  # a place beyond the end stays there
        whole = value + after[busy]
        out[i, busy] = np.where(whole & 1, -((whole + 1) >> 1), whole >> 1)
        now = _next_mean(mean[busy], value, after[busy], pace[busy])
        after[busy] = 0
        run = np.flatnonzero((now < 128) & (i + 1 < n[busy]))
        if len(run):
            k = _run_bits(now[run])
            value, used = _code(w, here[run], k, ((1 << k) - 1) & ((1 << c.kb) - 1), RUN_BITS)
            here[run] = np.minimum(here[run] + used, end[busy[run]] + 1)
            zeros[busy[run]], after[busy[run]], now[run] = value, value < MOST, 0
        mean[busy], at[busy] = now, here
    return out, np.where(zeros > 0, end + 1, at)  # a run of zeros cannot leave the packet


def _follow(values: np.ndarray, weights: np.ndarray, order: int, shift: np.ndarray, width: np.ndarray, encode: bool = False) -> np.ndarray:
    """Samples from errors, (samples, packets), or errors from samples. weights: (order, packets), the oldest sample's
    first; they move."""
    if order == 0:
        return values
    if encode:
        first = _wrapped(np.diff(values, axis=0, prepend=0), width)
    else:
        first = _wrapped(np.cumsum(values[: None if order == DIFFERENCES else order + 1], axis=0), width)
    if order == DIFFERENCES:
        return first
    made = np.empty_like(values)
    made[: order + 1] = first[: order + 1]
    x = values if encode else made
    half, factor = np.where(shift > 0, np.int64(1) << np.maximum(shift - 1, 0), 0), np.arange(1, order + 1)[:, None]
    for j in range(order + 1, len(values)):
        top = x[j - order - 1]
        apart = top - x[j - order : j]
        total = (half - (weights * apart).sum(axis=0)).astype(np.int32).astype(np.int64)  # 32 bits, as the format's own sums
        guess = top + (total >> shift)
        if encode:
            miss = _wrapped(values[j] - guess, width)
            made[j] = miss
        else:
            miss = values[j]
            made[j] = _wrapped(miss + guess, width)
        sign = np.sign(miss)
        # from the oldest weight on, as long as something of the error is left
        steps = ((sign * np.abs(apart)) >> shift) * factor
        left = miss - (np.cumsum(steps, axis=0) - steps)
        weights -= np.where(left * sign > 0, np.sign(apart) * sign, 0)
    return made


def _predicted(missed: np.ndarray, weights: np.ndarray, order: np.ndarray, shift: np.ndarray, mode: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Packets of one order together; weights: (packets, 32), the newest sample's first."""
    out = np.empty_like(missed)
    for o in np.unique(order):
        for twice in (False, True):
            some = np.flatnonzero((order == o) & ((mode != 0) == twice))
            if len(some):
                errors = _follow(missed[:, some], weights[:0, :0], DIFFERENCES, shift[some], width[some]) if twice else missed[:, some]
                out[:, some] = _follow(errors, weights[some, :o].T[::-1].copy(), int(o), shift[some], width[some])
    return out


def _coded(w: np.ndarray, at: np.ndarray, n: np.ndarray, shifted: np.ndarray, own: int, c: Config, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Samples (channels, samples, packets) of one element of each packet, and where it ends."""
    mix_bits, mix = bits.read(w, at, 8), bits.read_signed(w, at + 8, 8)
    at = at + 16
    told = []
    for _ in range(own):
        mode, shift, pace, order = (bits.read(w, at + p, k) for p, k in ((0, 4), (4, 4), (8, 3), (11, 5)))
        at = at + 16
        weights = np.zeros((len(at), 32), np.int64)
        for j in range(int(order.max(initial=0))):
            some = order > j
            weights[some, j] = bits.read_signed(w, at[some], 16)
            at = np.where(some, np.minimum(at + 16, end), at)
        told.append((mode, shift, c.pb * pace // 4, order, weights))
    low, low_bits = at, 8 * shifted
    at = np.minimum(at + low_bits * own * n, end + 1)
    width = c.bits - low_bits + (own == 2)
    found = []
    for mode, shift, pace, order, weights in told:
        missed, at = _errors(w, at, n, c, pace, width, end)
        found.append(_predicted(missed, weights, order, shift, mode, width))
    if own == 2:
        u, v = found
        left = np.where(mix != 0, u + v - ((mix * v) >> mix_bits), u)
        found = [left, np.where(mix != 0, left - v, v)]
    out = np.stack(found)
    if low_bits.any():
        i = np.arange(out.shape[1])[:, None]
        for k in range(own):
            place = np.minimum(low + (i * own + k) * low_bits, end)
            out[k] = (out[k] << low_bits) | bits.read(w, place, np.broadcast_to(low_bits, place.shape))
    return out, at


def decode_packets(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, c: Config) -> list[np.ndarray | None]:
    """Samples (channels, frames) of each packet of a padded buffer, None for those that fail."""
    w, lanes = bits.words(data), len(starts)
    at, end = starts.astype(np.int64) * 8, ends.astype(np.int64) * 8
    out = np.zeros((c.channels, c.frames, lanes), np.int64)
    filled, count, good = np.zeros(lanes, np.int64), np.full(lanes, -1), np.ones(lanes, bool)
    open_ = end > at
    good &= open_
    while open_.any():
        tag = np.where(open_, bits.read(w, np.minimum(at, end), 3), -1)
        closed = tag == END
        at, open_ = at + 3 * closed, open_ & ~closed
        for k in np.flatnonzero((tag == DATA) | (tag == FILL)):
            at[k] = _skipped(w, int(at[k]), int(tag[k]))
        strange = open_ & ~np.isin(tag, (ONE, TWO, LOW, DATA, FILL))
        for kind, own in (((ONE, LOW), 1), ((TWO,), 2)):
            some = np.flatnonzero(np.isin(tag, kind) & (filled + own <= c.channels))
            strange |= np.isin(tag, kind) & (filled + own > c.channels)
            if not len(some):
                continue
            here = at[some] + 7
            unused, short, shifted, plain = (bits.read(w, here + p, k) for p, k in ((0, 12), (12, 1), (13, 2), (15, 1)))
            n = np.where(short, bits.read(w, here + 16, 32), c.frames)
            here = here + 16 + 32 * short
            bad = (unused != 0) | (shifted == 3) | (n > c.frames) | (n < 1) | (here > end[some]) | ((count[some] >= 0) & (count[some] != n))
            strange[some[bad]] = True
            for mask in (~bad & (plain == 1), ~bad & (plain == 0)):
                rows = some[mask]
                if not len(rows):
                    continue
                if plain[mask][0]:
                    most = int(n[mask].max())
                    k = np.arange(most)[:, None] * own
                    found = np.stack([bits.read_signed(w, np.minimum(here[mask] + (k + ch) * c.bits, end[rows]), np.full((most, len(rows)), c.bits)) for ch in range(own)])
                    at[rows] = here[mask] + n[mask] * own * c.bits
                else:
                    found, at[rows] = _coded(w, here[mask], n[mask], shifted[mask], own, c, end[rows])
                for ch in range(own):
                    out[filled[rows] + ch, : found.shape[1], rows] = found[ch].T
                filled[rows] += own
                count[rows] = n[mask]
        strange |= open_ & (at > end)
        good &= ~strange
        open_ = open_ & ~strange
    good &= (filled == c.channels) & (at <= end)
    return [out[:, : count[k], k] if good[k] else None for k in range(lanes)]


class Lossless(Packets):
    def __init__(self, known: AudioFormat, told: Config, packets: list[bytes]):
        super().__init__(known, packets)
        self.told = told

    def alike(self) -> Hashable:
        return self.told

    def samples(self) -> Iterator[np.ndarray | None]:
        for a in range(0, len(self.packets), GROUP):
            part = self.packets[a : a + GROUP]
            ends = np.cumsum([len(x) for x in part])
            yield from decode_packets(bits.padded(b"".join(part)), ends - [len(x) for x in part], ends, self.told)

    @staticmethod
    def together(some: list[Lossless]) -> None:
        found = Lossless(some[0].known, some[0].told, [x for f in some for x in f.packets]).samples()
        for f in some:
            f.ready = list(islice(found, len(f.packets)))


def _skipped(w: np.ndarray, at: int, tag: int) -> int:
    """Where an element without samples ends."""
    read = lambda p, k: int(bits.read(w, np.array([p]), k)[0])
    if tag == FILL:
        n, at = read(at + 3, 4), at + 7
        if n == 15:
            n, at = n + read(at, 8) - 1, at + 8
        return at + 8 * n
    aligned, n, at = read(at + 7, 1), read(at + 8, 8), at + 16
    if n == 255:
        n, at = n + read(at, 8), at + 8
    return (-(-at // 8) * 8 if aligned else at) + 8 * n


# ---- Encoder --------------------------------------------------------------------------------------------------------


def _put(value: np.ndarray, k: np.ndarray, m: np.ndarray, wide: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """Codes and their lengths."""
    ones, rest = value // m, value % m
    width = ones + k + (rest > 0)
    plain = (ones >= MOST_ONES) | (width > 25)
    ones = np.where(plain, MOST_ONES, ones)
    code = (((1 << ones) - 1) << np.maximum(width - ones, 0)) + np.where(rest > 0, rest + 1, 0)
    return np.where(plain, (((1 << MOST_ONES) - 1) << wide) + value, code), np.where(plain, MOST_ONES + wide, width)


def _codes(missed: np.ndarray, c: Config, pace: int, width: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    n, lanes = missed.shape
    ahead = np.zeros((n + 1, lanes), np.int64)
    for i in range(n - 1, -1, -1):
        ahead[i] = np.where(missed[i] == 0, ahead[i + 1] + 1, 0)
    mean, zeros, after = np.full(lanes, c.mb, np.int64), np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    values, widths = [], []

    def emit(some: np.ndarray, code: tuple[np.ndarray, np.ndarray]) -> None:
        for out, x in zip((values, widths), code, strict=True):
            row = np.zeros(lanes, np.int64)
            row[some] = x
            out.append(row)

    for i in range(n):
        busy = np.flatnonzero(zeros == 0)
        zeros -= zeros > 0
        if not len(busy):
            continue
        x = missed[i, busy]
        value = np.where(x < 0, -2 * x - 1, 2 * x) - after[busy]
        k = _code_bits(mean[busy], c.kb)
        emit(busy, _put(value, k, (1 << k) - 1, width))
        now = _next_mean(mean[busy], value, after[busy], np.full(len(busy), pace))
        after[busy] = 0
        run = np.flatnonzero((now < 128) & (i + 1 < n))
        if len(run):
            k = _run_bits(now[run])
            value = np.minimum(ahead[i + 1, busy[run]], MOST)
            emit(busy[run], _put(value, k, ((1 << k) - 1) & ((1 << c.kb) - 1), RUN_BITS))
            zeros[busy[run]], after[busy[run]], now[run] = value, value < MOST, 0
        mean[busy] = now
    return values, widths


def _element(x: np.ndarray, kind: int, c: Config, order: int, shift: int, mode: int, mix: tuple[int, int], shifted: int, plain: bool) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Fields of one element of packets alike in length; x: (channels, samples, packets)."""
    own, n, lanes = x.shape
    fields: list[tuple[object, int]] = [(kind, 3), (0, 4), (0, 12), (int(n != c.frames), 1), (0 if plain else shifted, 2), (int(plain), 1)]
    if n != c.frames:
        fields.append((n, 32))
    every = lambda v: np.broadcast_to(np.asarray(v, np.int64), (lanes,))
    if plain:
        fields += [(x[k, i] & ((1 << c.bits) - 1), c.bits) for i in range(n) for k in range(own)]
        return [every(v) for v, _ in fields], [every(k) for _, k in fields]
    low, parts = x & ((1 << 8 * shifted) - 1), list(x >> 8 * shifted)
    width = c.bits - 8 * shifted + (own == 2)
    mix_bits, res = mix if own == 2 else (0, 0)
    if own == 2 and res:
        left, right = parts
        parts = [(res * left + ((1 << mix_bits) - res) * right) >> mix_bits, left - right]
    fields += [(mix_bits, 8), (res & 255, 8)]
    start = [0] * max(order, 3)
    start[:3] = [(k << 9) >> 4 for k in (38, -29, -2)]
    weights = np.array(start[:order] if order < DIFFERENCES else [0] * order, np.int64)
    for _ in range(own):
        fields += [(mode, 4), (shift, 4), (4, 3), (order, 5), *((int(v) & 0xFFFF, 16) for v in weights)]
    if shifted:
        fields += [(low[k, i], 8 * shifted) for i in range(n) for k in range(own)]
    values, widths = [every(v) for v, _ in fields], [every(k) for _, k in fields]
    wide = np.full(lanes, width)
    for part in parts:
        missed = _follow(part, np.repeat(weights[::-1, None], lanes, axis=1), order, np.full(lanes, shift), wide, encode=True)
        if mode:
            missed = _follow(missed, weights[:0, None], DIFFERENCES, wide, wide, encode=True)
        v, k = _codes(missed, c, c.pb, width)
        values, widths = values + v, widths + k
    return values, widths


#: Elements by number of channels, in the order of the format.
ELEMENTS = {
    1: (ONE,), 2: (TWO,), 3: (ONE, TWO), 4: (ONE, TWO, ONE), 5: (ONE, TWO, TWO), 6: (ONE, TWO, TWO, LOW),
    7: (ONE, TWO, TWO, ONE, LOW), 8: (ONE, TWO, TWO, TWO, LOW),
}


def encode_each(tracks: list[np.ndarray], c: Config, order: int = 4, shift: int = 9, mode: int = 0, mix: tuple[int, int] = (2, 1), shifted: int = 0, plain: bool = False, between: bytes = b"") -> list[list[bytes]]:
    """Packets of the samples (channels, frames) of each track; those of one length are made side by side. `between` goes into
    a fill element before the end."""
    out = [[b""] * -(-x.shape[1] // c.frames) for x in tracks]
    alike: dict[int, list[tuple[int, int]]] = {}
    for t, x in enumerate(tracks):
        for p, a in enumerate(range(0, x.shape[1], c.frames)):
            alike.setdefault(min(c.frames, x.shape[1] - a), []).append((t, p))
    for n, every in alike.items():
        for a in range(0, len(every), GROUP):
            some = every[a : a + GROUP]
            part = np.stack([tracks[t][:, p * c.frames : p * c.frames + n] for t, p in some], axis=2).astype(np.int64)
            values, widths, at, lanes = [], [], 0, len(some)
            for kind in ELEMENTS[c.channels]:
                own = 2 if kind == TWO else 1
                v, k = _element(part[at : at + own], kind, c, order, shift, mode, mix, shifted, plain)
                values, widths, at = values + v, widths + k, at + own
            tail = [(FILL, 3), (len(between), 4), *((b, 8) for b in between), (END, 3)] if between else [(END, 3)]
            values += [np.full(lanes, v) for v, _ in tail]
            widths += [np.full(lanes, k) for _, k in tail]
            all_values, all_widths = np.array(values).T, np.array(widths).T
            for (t, p), v, k in zip(some, all_values, all_widths, strict=True):
                out[t][p] = bits.pack(v, k).tobytes()
    return out


def encode(x: np.ndarray, c: Config, **how: object) -> list[bytes]:
    """Packets of samples (channels, frames); `how` as in encode_each."""
    return encode_each([x], c, **how)[0]
