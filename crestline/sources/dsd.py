"""One-bit files, DSF and DFF: from bits to samples by a low-pass that keeps one result in so many bits.

The filter's sum over the bits of a byte is one of 256 values, so for each byte position under the filter there is a table,
and a sample is the sum of as many looked-up values as the filter has bytes. A sample needs bytes from before and after its
place: a range of a file is read with those (a halo), so ranges give what one task gives. Beyond the ends there is nothing,
and nothing is added. Sums stay doubles: as float32 some levels near a half of their last place are rounded the other way.

The cutoff, the gain and the rate are those of the conversion plan (functions/describe.py). The file's rate is told as that
of its bytes, an eighth of that of its bits, and windows are counted by it, also where the rate after conversion is another.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from crestline.constants import DSD_GAIN_DB, DSD_RATE, DSD_TIERS, MAX_CHANNELS
from crestline.operators.windows import window_frames
from crestline.sources.registry import AudioError, AudioFormat, Decoder, register_decoder

#: Bytes under the filter for each byte that the result moves on, and shape of the filter's edges.
SPAN, KAISER = 24, 9.0
#: Stands for a byte beyond the ends.
NOTHING = 256
_REVERSED = np.array([int(f"{b:08b}"[::-1], 2) for b in range(256)], np.int16)

ReadAt = Callable[[int, int], bytes]


@dataclass(frozen=True)
class Plan:
    """How bits become samples: rate wanted, filter (teac, studio, off) and gain."""

    rate: int = DSD_RATE
    mode: str = "teac"
    gain_db: float = DSD_GAIN_DB


@dataclass
class Info:
    rate: int
    channels: int
    #: Bits of a channel.
    samples: int
    #: Where the bits begin, and bytes of a channel that lie together.
    start: int
    block: int
    low_first: bool
    kind: str

    @property
    def bytes(self) -> int:
        return self.samples // 8

    def place(self, byte: int) -> int:
        """Where in the file a channel's byte group begins."""
        return self.start + byte // self.block * self.block * self.channels

    def read(self, read: ReadAt, first: int, last: int) -> np.ndarray:
        """(channels, last - first): bytes of every channel, highest bit first in time; NOTHING beyond the ends."""
        out = np.full((self.channels, last - first), NOTHING, np.int16)
        a, b = max(0, first), min(last, self.bytes)
        if a >= b:
            return out
        groups = a // self.block, -(-b // self.block)
        raw = np.frombuffer(read((groups[1] - groups[0]) * self.block * self.channels, self.place(a)), np.uint8)
        whole = len(raw) // (self.block * self.channels)
        parts = raw[: whole * self.block * self.channels].reshape(whole, self.channels, self.block).transpose(1, 0, 2).reshape(self.channels, -1).astype(np.int16)
        rest = raw[whole * self.block * self.channels :]
        if len(rest) >= self.channels and self.block > 1:  # a last group may be cut: what all channels have
            last_part = min(self.block, max(0, len(rest) - (self.channels - 1) * self.block))
            if last_part:
                parts = np.concatenate([parts, np.stack([rest[c * self.block : c * self.block + last_part] for c in range(self.channels)]).astype(np.int16)], axis=1)
        got = parts[:, a - groups[0] * self.block : b - groups[0] * self.block]
        out[:, a - first : a - first + got.shape[1]] = _REVERSED[got] if self.low_first else got
        return out

    def format(self, plan: Plan) -> AudioFormat:
        step = step_bytes(self, plan)
        return AudioFormat(self.rate // 8, self.channels, 8, self.bytes // step, "DSD", processed_sample_rate=self.rate // (8 * step))


def _dsf(read: ReadAt, size: int) -> Info:
    head = read(28, 0)
    if len(head) < 28:
        raise AudioError("FormatError", "no header")
    at, form = struct.unpack_from("<Q", head, 4)[0], None
    while at + 12 <= size:
        name, length = struct.unpack("<4sQ", read(12, at))
        if name == b"fmt ":
            body = read(40, at + 12)
            if len(body) < 40:
                break
            _, kind, _, channels, rate, order, samples, block, _ = struct.unpack("<IIIIIIQII", body)
            if kind != 0 or order not in (1, 8):
                raise AudioError("FormatError", f"one-bit format {kind}, order {order}")
            form = rate, channels, samples, block, order == 1
        elif name == b"data":
            if form is None:
                break
            rate, channels, samples, block, low_first = form
            if block < 1 or not 1 <= channels <= MAX_CHANNELS:
                raise AudioError("FormatError", f"{channels} channels in blocks of {block}")
            held = min(length - 12, size - at - 12) // (block * channels) * block
            tail = min(length - 12, size - at - 12) - held * channels
            held += max(0, min(block, tail - (channels - 1) * block))
            return Info(rate, channels, min(samples, 8 * held), at + 12, block, low_first, "DSF")
        if length < 12:
            break
        at += length
    raise AudioError("FormatError", "no samples")


def _dff(read: ReadAt, size: int) -> Info:
    at, rate, channels = 16, 0, 0

    def properties(start: int, end: int) -> None:
        nonlocal rate, channels
        here = start
        while here + 12 <= end:
            name, length = struct.unpack(">4sQ", read(12, here))
            if name == b"FS  ":
                rate = struct.unpack(">I", read(4, here + 12))[0]
            elif name == b"CHNL":
                channels = struct.unpack(">H", read(2, here + 12))[0]
            elif name == b"CMPR" and read(4, here + 12) != b"DSD ":
                raise AudioError("DecodingError", "compressed one-bit samples")
            here += 12 + length + length % 2

    while at + 12 <= size:
        name, length = struct.unpack(">4sQ", read(12, at))
        if name == b"PROP":
            properties(at + 16, min(size, at + 12 + length))
        elif name == b"DSD ":
            if not rate or not 1 <= channels <= MAX_CHANNELS:
                break
            held = min(length, size - at - 12) // channels
            return Info(rate, channels, 8 * held, at + 12, 1, False, "DFF")
        at += 12 + length + length % 2
    raise AudioError("FormatError", "no samples")


def probe(read: ReadAt, size: int) -> Info:
    try:
        head = read(16, 0)
        if head[:4] == b"DSD ":
            found = _dsf(read, size)
        elif head[:4] == b"FRM8" and head[12:16] == b"DSD ":
            found = _dff(read, size)
        else:
            raise AudioError("FormatError", "not a one-bit file")
    except struct.error as e:
        raise AudioError("FormatError", "a header is cut off") from e
    if found.rate < 16:
        raise AudioError("FormatError", f"{found.rate} bits a second")
    return found


def step_bytes(info: Info, plan: Plan) -> int:
    """Bytes from one sample to the next: the whole number whose rate is nearest to the one wanted."""
    return max(1, round(info.rate / (8 * plan.rate)))


def cutoff(info: Info, plan: Plan) -> float:
    """The plan's low-pass, as a share of the bits' rate; without one, half of the result's rate."""
    rate = info.rate / (8 * step_bytes(info, plan))
    multiple = round(info.rate / 44100)
    tier = min(DSD_TIERS, key=lambda t: (abs(multiple - t), t))
    if plan.mode == "off":
        return 0.5 * rate / info.rate
    wanted = min(39000.0 * max(tier, 64) / 64, 0.45 * rate) if plan.mode == "teac" else 20000.0
    return min(wanted, 0.45 * rate) / info.rate


@lru_cache(maxsize=8)
def taps(edge: float, length: int, gain_db: float) -> np.ndarray:
    """A windowed low-pass of `length` bits with the gain; a constant signal keeps its level but for the gain."""
    t = np.arange(length) - (length - 1) / 2
    h = np.sinc(2 * edge * t) * np.kaiser(length, KAISER)
    return h / h.sum() * 10 ** (gain_db / 20)


@lru_cache(maxsize=8)
def tables(edge: float, size: int, gain_db: float) -> np.ndarray:
    """(size, 257): the part of the sum that each byte under the filter gives; none for NOTHING."""
    signs = np.where(np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1), 1.0, -1.0)
    return np.concatenate([taps(edge, 8 * size, gain_db).reshape(size, 8) @ signs.T, np.zeros((size, 1))], axis=1)


def samples(info: Info, plan: Plan, read: ReadAt, first: int, last: int) -> np.ndarray:
    """(channels, last - first) samples from one place in the result to another."""
    step = step_bytes(info, plan)
    size = SPAN * step
    sums = tables(cutoff(info, plan), size, plan.gain_db)
    begin = first * step - (size - step) // 2  # the middle of the filter lies over that of the sample's own bytes
    found = info.read(read, begin, begin + (last - first - 1) * step + size)
    out = np.zeros((info.channels, last - first))
    for j in range(size):
        out += sums[j][found[:, j : j + (last - first - 1) * step + 1 : step]]
    return out


def decoder(plan: Plan = Plan()) -> Decoder:
    def decode(data: bytes, extension: str = "dsf") -> tuple[AudioFormat, Iterator[np.ndarray]]:
        read = lambda n, at: data[at : at + n]
        info = probe(read, len(data))
        known = info.format(plan)
        width = window_frames(known.sample_rate)
        return known, (samples(info, plan, read, a, min(a + width, known.sample_count)).T for a in range(0, known.sample_count, width))

    return decode


def write_dsf(bits: np.ndarray, rate: int, low_first: bool = True, block: int = 4096) -> bytes:
    """A DSF file of (channels, samples) zeros and ones; a last block is filled up."""
    packed = np.packbits(bits, axis=1, bitorder="little" if low_first else "big")
    groups = -(-packed.shape[1] // block)
    room = np.full((len(bits), groups * block), 0x69, np.uint8)
    room[:, : packed.shape[1]] = packed
    data = room.reshape(len(bits), groups, block).transpose(1, 0, 2).tobytes()
    form = struct.pack("<IIIIIIQII", 1, 0, min(7, len(bits)), len(bits), rate, 1 if low_first else 8, bits.shape[1], block, 0)
    return b"DSD " + struct.pack("<QQQ", 28, 28 + 52 + 12 + len(data), 0) + b"fmt " + struct.pack("<Q", 52) + form + b"data" + struct.pack("<Q", 12 + len(data)) + data


def write_dff(bits: np.ndarray, rate: int) -> bytes:
    data = np.packbits(bits, axis=1).T.tobytes()
    chunk = lambda name, body: name + struct.pack(">Q", len(body)) + body + b"\0" * (len(body) % 2)
    props = chunk(b"FS  ", struct.pack(">I", rate)) + chunk(b"CHNL", struct.pack(">H", len(bits)) + b"SLFTSRGT"[: 4 * len(bits)]) + chunk(b"CMPR", b"DSD \x0enot compressed\0")
    return chunk(b"FRM8", b"DSD " + chunk(b"FVER", b"\1\5\0\0") + chunk(b"PROP", b"SND " + props) + chunk(b"DSD ", data))


for _extension in ("dsf", "dff"):
    register_decoder(_extension, decoder())
