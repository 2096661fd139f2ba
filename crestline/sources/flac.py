"""FLAC: frames found anywhere in a file, many of them decoded side by side; and an encoder.

A frame begins with a sync code and a header that has its own checksum, so frames can be found from any byte on: a file is
cut into ranges, and a task decodes the frames that begin in its range. Decoding is sequential within a frame (each code
says where the next one begins, each sample is predicted from those before it), but frames do not depend on each other.
Sample n of all frames of a group is therefore decoded in one step of array operations, then sample n + 1; a group holds
frames of as many files as it takes.

A frame whose checksum fails is a failed packet: it is counted and its samples are missing; those after it keep the places
that their frame's number gives them.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Hashable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np

from crestline.constants import MAX_DECODE_ERRORS
from crestline.sources import bits
from crestline.sources.registry import AudioError, AudioFormat, Packets, register_decoder

CRC8, CRC16 = bits.Crc(0x07, 8), bits.Crc(0x8005, 16)
#: Frames decoded side by side.
GROUP = Packets.GROUP
#: Bytes of the longest frame header.
LONGEST_HEADER = 16
#: Fixed values of the format: block sizes, sample rates and sample sizes by code (0: said elsewhere), fixed predictors.
BLOCK_SIZES = {1: 192, **{k: 576 << (k - 2) for k in range(2, 6)}, **{k: 256 << (k - 8) for k in range(8, 16)}}
RATES = {1: 88200, 2: 176400, 3: 192000, 4: 8000, 5: 16000, 6: 22050, 7: 24000, 8: 32000, 9: 44100, 10: 48000, 11: 96000}
SAMPLE_BITS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}
FIXED = ((), (1,), (2, -1), (3, -3, 1), (4, -6, 4, -1))
LEFT_SIDE, RIGHT_SIDE, MID_SIDE = 8, 9, 10
#: Samples beyond this many bits are predicted in whole numbers; up to it doubles are exact.
EXACT_BITS = 28


@dataclass
class StreamInfo:
    least_block: int
    most_block: int
    least_frame: int
    most_frame: int
    rate: int
    channels: int
    bits: int
    samples: int
    md5: bytes
    #: Where frames begin.
    start: int = 0

    @property
    def frame_bytes(self) -> int:
        """No frame is longer: as told, else that of samples stored plainly."""
        return self.most_frame or 64 + self.most_block * self.channels * (self.bits + 1) // 8

    def format(self) -> AudioFormat:
        # six and eight channels have a fixed order, with the low-frequency one at 3
        return AudioFormat(self.rate, self.channels, self.bits, self.samples, "FLAC", [3] if self.channels in (6, 8) else [], True)


@dataclass
class Header:
    at: int
    body: int
    block: int
    assignment: int
    bits: int
    #: Place of the first sample in the stream.
    first: int
    #: Where the next header begins, and whether the checksum is right up to there.
    end: int = 0
    right: bool = False

    @property
    def channels(self) -> int:
        return self.assignment + 1 if self.assignment < LEFT_SIDE else 2


def stream_info(read_at, size: int) -> StreamInfo:  # noqa: ANN001
    """From any source of bytes, read_at(length, offset); of metadata other than the stream's own only lengths are read."""
    at = 0
    tag = read_at(10, 0)
    if tag[:3] == b"ID3" and len(tag) == 10:
        at = 10 + sum((b & 0x7F) << (7 * (3 - k)) for k, b in enumerate(tag[6:]))
    if read_at(4, at) != b"fLaC":
        raise AudioError("FormatError", "not a FLAC file")
    at, info = at + 4, None
    while at + 4 <= size:
        head = read_at(4, at)
        length = int.from_bytes(head[1:], "big")
        if head[0] & 0x7F == 0:
            body = read_at(34, at + 4)
            if len(body) < 34:
                break
            least, most = struct.unpack(">HH", body[:4])
            packed = int.from_bytes(body[10:18], "big")
            info = StreamInfo(
                least, most, int.from_bytes(body[4:7], "big"), int.from_bytes(body[7:10], "big"), packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1, body[18:34]
            )
        at += 4 + length
        if head[0] & 0x80:
            break
    if info is None:
        raise AudioError("FormatError", "no stream information")
    if not info.rate or info.bits < 4:
        raise AudioError("FormatError", f"{info.rate} Hz, {info.bits} bits")
    info.start = at
    return info


def _number(data: np.ndarray, at: int) -> tuple[int, int]:
    """A number of up to 36 bits, coded like a character of UTF-8, and where it ends."""
    first = int(data[at])
    more = 8 - (first ^ 0xFF).bit_length()
    if more == 0:
        return first, at + 1
    if more == 1 or more > 7:
        raise ValueError("no number")
    value = first & (0x7F >> more)
    for k in range(1, more):
        byte = int(data[at + k])
        if byte >> 6 != 2:
            raise ValueError("no number")
        value = value << 6 | byte & 0x3F
    return value, at + more


def header(data: np.ndarray, at: int, info: StreamInfo) -> Header | None:
    """The frame header at a byte, if there is one that suits the stream."""
    size_code, rate_code = int(data[at + 2]) >> 4, int(data[at + 2]) & 15
    assignment, bits_code, spare = int(data[at + 3]) >> 4, int(data[at + 3]) >> 1 & 7, int(data[at + 3]) & 1
    if size_code == 0 or rate_code == 15 or assignment > MID_SIDE or bits_code == 3 or spare:
        return None
    if (assignment + 1 if assignment < LEFT_SIDE else 2) != info.channels or SAMPLE_BITS.get(bits_code, info.bits) != info.bits:
        return None
    try:
        number, end = _number(data, at + 4)
    except ValueError:
        return None
    if size_code in (6, 7):
        block, end = int.from_bytes(data[end : end + size_code - 5].tobytes(), "big") + 1, end + size_code - 5
    else:
        block = BLOCK_SIZES[size_code]
    if rate_code in (12, 13, 14):
        end += 1 if rate_code == 12 else 2
    elif RATES.get(rate_code, info.rate) != info.rate:
        return None
    if block > max(info.most_block, 16) or CRC8.one(data[at:end].tobytes()) != data[end]:
        return None
    variable = data[at + 1] & 1
    return Header(at, end + 1, block, assignment, info.bits, number if variable else number * info.most_block)


def _sub_header(w: np.ndarray, at: np.ndarray, width: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kind, bits of a sample, and shift of each subframe; `at` moves on."""
    head = bits.read(w, at, 8)
    if (head & 0x80).any():
        raise ValueError("no subframe")
    at += 8
    shift = np.zeros(len(at), np.int64)
    for k in np.flatnonzero(head & 1):
        shift[k] = bits.zeros_before_one(w, int(at[k]), end) + 1
        at[k] += shift[k]
    if (shift >= width).any():
        raise ValueError("no bits left")
    return head >> 1 & 63, width - shift, shift


def _codes(w: np.ndarray, at: np.ndarray, k: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Where one Rice code at each position ends, and its number; runs of zeros may have any length."""
    v = bits.peek(w, at)
    zeros = 1075 - ((v >> np.uint64(11)).astype(np.float64).view(np.int64) >> 52)
    for j in np.flatnonzero(zeros > 52):
        zeros[j] = bits.zeros_before_one(w, int(at[j]), end)
    rest = at + zeros + 1
    folded = (zeros << k) | bits.read(w, rest, k)
    return rest + k, (folded >> 1) ^ -(folded & 1)


def _residuals(w: np.ndarray, at: np.ndarray, block: int, order: np.ndarray, end: int) -> np.ndarray:
    """(block, frames): what the predictors of frames missed; rows before a frame's order stay 0. `at` moves on."""
    method = bits.read(w, at, 2)
    parts = bits.read(w, at + 2, 4)
    at += 6
    length = block >> parts
    if (method > 1).any() or ((length << parts) != block).any() or (length < order).any():
        raise ValueError("no partitions")
    wide = method + 4
    out = np.zeros((block, len(at)), np.int64)
    # at which sample which frames begin a partition
    events: dict[int, list[np.ndarray]] = {}
    for n in np.unique(order):
        events.setdefault(int(n), []).append(np.flatnonzero(order == n))
    for n in np.unique(length):
        frames = np.flatnonzero(length == n)
        for step in range(int(n), block, int(n)):
            events.setdefault(step, []).append(frames)
    k, raw, width = np.zeros(len(at), np.int64), np.zeros(len(at), bool), np.zeros(len(at), np.int64)
    plain, last = False, int(order.max())
    value, zeros, moved, real = (np.zeros(len(at), t) for t in (np.uint64, np.int64, np.int64, np.float64))
    ahead, down, exponent = np.ones(len(at), np.int64), np.full(len(at), 64, np.uint64), real.view(np.int64)
    for n in range(block):
        for frames in events.get(n, ()):
            here, size = at[frames], wide[frames]
            given = bits.read(w, here, size)
            here += size
            escaped = given == (1 << size) - 1
            if escaped.any():
                width[frames[escaped]] = bits.read(w, here[escaped], 5)
                here[escaped] += 5
            at[frames], k[frames], raw[frames] = here, np.where(escaped, 0, given), escaped
            ahead[frames], down[frames] = k[frames] + 1, (64 - k[frames]).view(np.uint64)
            plain = bool(raw.any())
        if n < last or plain:
            some = np.flatnonzero((order <= n) & ~raw)
            at[some], out[n, some] = _codes(w, at[some], k[some], end)
            if plain:
                some = np.flatnonzero((order <= n) & raw)
                out[n, some] = bits.read_signed(w, at[some], width[some])
                at[some] += width[some]
            continue
        # one code of every frame: the float made of the next bits has the place of the first one in its exponent
        np.right_shift(at, 3, out=moved)
        np.take(w, moved, out=value, mode="clip")
        np.bitwise_and(at, 7, out=moved)
        np.left_shift(value, moved.view(np.uint64), out=value)
        np.right_shift(value, np.uint64(11), out=real, casting="unsafe")
        np.right_shift(exponent, 52, out=zeros)
        np.subtract(1075, zeros, out=zeros)
        np.add(zeros, ahead, out=moved)
        if moved.max() > 55:
            at[:], out[n] = _codes(w, at, k, end)
            continue
        at += moved
        zeros += 1
        np.left_shift(value, zeros.view(np.uint64), out=value)
        np.right_shift(value, down, out=value)
        zeros -= 1
        np.left_shift(zeros, k, out=zeros)
        np.bitwise_or(zeros, value.view(np.int64), out=zeros)
        np.bitwise_and(zeros, 1, out=moved)
        np.negative(moved, out=moved)
        np.right_shift(zeros, 1, out=zeros)
        np.bitwise_xor(zeros, moved, out=out[n])
    return out


def _predicted(warm: np.ndarray, missed: np.ndarray, order: np.ndarray, weights: np.ndarray, shift: np.ndarray, width: int) -> np.ndarray:
    """(block, frames) samples: each the weighted sum of those before it, shifted down, plus what that missed. Row o - j of
    the weights is that of the sample j places back."""
    block, o = len(missed), len(weights)
    if not o:
        return missed
    exact = width <= EXACT_BITS
    kind = np.float64 if exact else np.int64
    held, weights, missed = np.zeros((o + block, missed.shape[1]), kind), weights.astype(kind), missed.astype(kind)
    scale = np.ldexp(1.0, -shift)
    for n in range(block):
        total = np.einsum("ij,ij->j", weights, held[n : n + o])
        value = missed[n] + (np.floor(total * scale) if exact else total >> shift)
        held[o + n] = np.where(order > n, warm[n], value) if n < o else value
    return held[o:].astype(np.int64)


def _subframes(w: np.ndarray, at: np.ndarray, block: int, width: np.ndarray, end: int) -> np.ndarray:
    """(block, frames): the samples of one channel of frames of equal block size; `at` moves behind it."""
    kind, width, shift = _sub_header(w, at, width, end)
    out = np.zeros((block, len(at)), np.int64)
    constant = np.flatnonzero(kind == 0)
    if len(constant):
        out[:, constant] = bits.read_signed(w, at[constant], width[constant])
        at[constant] += width[constant]
    for k in np.flatnonzero(kind == 1):
        out[:, k] = bits.read_signed(w, at[k] + np.arange(block) * width[k], width[k])
        at[k] += block * width[k]
    coded = np.flatnonzero(((kind >= 8) & (kind <= 12)) | (kind >= 32))
    if len(coded) + len(constant) + (kind == 1).sum() < len(at):
        raise ValueError("no such subframe")
    if len(coded):
        linear = kind[coded] >= 32
        order = np.where(linear, kind[coded] - 31, kind[coded] - 8)
        here, size, most = at[coded], width[coded], int(order.max())
        if most > block:
            raise ValueError("more predictors than samples")
        warm, weights, down = np.zeros((most, len(coded)), np.int64), np.zeros((most, len(coded)), np.int64), np.zeros(len(coded), np.int64)
        for k in range(most):
            some = np.flatnonzero(order > k)
            warm[k, some] = bits.read_signed(w, here[some], size[some])
            here[some] += size[some]
        some = np.flatnonzero(linear)
        if len(some):
            precision = bits.read(w, here[some], 4) + 1
            down[some] = bits.read_signed(w, here[some] + 4, 5)
            here[some] += 9
            for k in range(int(order[some].max())):
                left = order[some] > k
                mine = some[left]
                weights[most - 1 - k, mine] = bits.read_signed(w, here[mine], precision[left])
                here[mine] += precision[left]
        for k in np.flatnonzero(~linear):
            for j, weight in enumerate(FIXED[order[k]]):
                weights[most - 1 - j, k] = weight
        missed = _residuals(w, here, block, order, end)
        out[:, coded] = _predicted(warm, missed, order, weights, down, int(size.max()))
        at[coded] = here
    return out << shift


def _decode(data: np.ndarray, frames: list[Header], room: int) -> tuple[np.ndarray, np.ndarray]:
    """(channels, frames, block) samples of frames alike in block size and number of channels, and the byte after each; none
    is longer than `room`."""
    base, stop = frames[0].at, min(frames[-1].at + room, len(data) - bits.PAD)
    w, end = bits.words(data[base : stop + bits.PAD]).astype(np.uint64), 8 * (stop - base)
    at = np.array([8 * (f.body - base) for f in frames], np.int64)
    kind = np.array([f.assignment for f in frames])
    count = frames[0].channels
    with np.errstate(over="ignore", invalid="ignore"):
        parts = []
        for c in range(count):
            side = (kind == RIGHT_SIDE) if c == 0 else (kind == LEFT_SIDE) | (kind == MID_SIDE) if c == 1 else np.zeros(len(frames), bool)
            parts.append(_subframes(w, at, frames[0].block, frames[0].bits + side.astype(np.int64), end))
    if count == 2:
        a, b = parts
        middle = (a << 1) | (b & 1)
        parts = [np.where(kind == RIGHT_SIDE, a + b, np.where(kind == MID_SIDE, (middle + b) >> 1, a)), np.where(kind == LEFT_SIDE, a - b, np.where(kind == MID_SIDE, (middle - b) >> 1, b))]
    return np.stack([np.ascontiguousarray(p.T) for p in parts]), base + (at + 7) // 8


def _alone(data: np.ndarray, frame: Header, room: int, size: int) -> tuple[np.ndarray, int] | None:
    """A frame's samples and where it ends, if its checksum holds there."""
    try:
        samples, end = _decode(data, [frame], room)
    except (ValueError, IndexError):
        return None
    stop = int(end[0]) + 2
    if stop > size or CRC16.one(data[frame.at : stop].tobytes()):
        return None
    return samples[:, 0], stop


@dataclass
class _Part:
    """Headers in a stretch of a buffer, and which frames count: those that begin in [first, last)."""

    data: np.ndarray
    info: StreamInfo
    first: int
    last: int
    size: int
    heads: list[Header]


def _part(data: np.ndarray, info: StreamInfo, first: int, last: int | None) -> _Part:
    size = len(data) - bits.PAD
    body = data[:size]
    found = np.flatnonzero((body[:-1] == 0xFF) & ((body[1:] & 0xFE) == 0xF8)) if size > 1 else np.zeros(0, np.int64)
    heads = [h for at in found[found >= first].tolist() if (h := header(data, at, info))]
    for head, end in zip(heads, [*(h.at for h in heads[1:]), size], strict=False):
        head.end = end
    return _Part(data, info, first, size if last is None else last, size, heads)


def _decoded(data: np.ndarray, heads: list[Header], room: int) -> dict[int, np.ndarray]:
    """Samples by place of the frames whose checksums are right, those alike side by side."""
    alike: dict[tuple[int, int, int], list[Header]] = {}
    for h in heads:
        if h.right:
            alike.setdefault((h.block, h.channels, h.bits), []).append(h)
    out, groups = {}, list(alike.values())
    while groups:
        group = groups.pop()
        try:
            samples, _ = _decode(data, group, room)
            out |= {h.at: samples[:, j] for j, h in enumerate(group)}
        except (ValueError, IndexError):  # one that its checksum does not show to be wrong: it is looked for by halves
            if len(group) > 1:
                groups += [group[: len(group) // 2], group[len(group) // 2 :]]
    return out


def _in_order(data: np.ndarray, part: _Part, ready: dict[int, np.ndarray] | None = None) -> Iterator[tuple[int, np.ndarray | None]]:
    """Frames of a part, decoded GROUP at a time unless they are `ready`."""
    heads, room, done, at, lost = part.heads, part.info.frame_bytes, part.first, 0, 0
    while at < len(heads) and heads[at].at < part.last:
        some = [h for h in heads[at : at + GROUP] if h.at < part.last]
        out = _decoded(data, some, room) if ready is None else ready
        for h in some:
            if h.at < done:  # a sync code within the frame before
                continue
            if h.at in out:
                done, lost = h.end, 0
                yield h.first, out[h.at]
            elif one := _alone(data, h, room, part.size):
                done, lost = one[1], 0
                yield h.first, one[0]
            else:
                lost += 1
                if lost > MAX_DECODE_ERRORS:
                    raise AudioError("DecodingError", f"more than {MAX_DECODE_ERRORS} frames fail in a row")
                yield h.first, None
        at += len(some)


def _side_by_side(parts: list[_Part]) -> Iterator[Iterator[tuple[int, np.ndarray | None]]]:
    """Parts with GROUP frames at most are laid into one buffer; a longer one comes alone."""
    data = parts[0].data
    if len(parts) > 1:
        data, base = bits.padded(b"".join(p.data[: p.size].data for p in parts)), 0
        for p in parts:
            for h in p.heads:
                h.at, h.body, h.end = h.at + base, h.body + base, h.end + base
            p.first, p.last, p.size, base = p.first + base, p.last + base, p.size + base, base + p.size
    heads = [h for p in parts for h in p.heads]
    right = CRC16.many(data, np.array([h.at for h in heads], np.int64), np.array([h.end for h in heads], np.int64)) == 0
    for h, r in zip(heads, right.tolist(), strict=True):
        h.right = r
    ready = None
    if len(parts) > 1:
        ready = _decoded(data, [h for p in parts for h in p.heads if h.at < p.last], max(p.info.frame_bytes for p in parts))
    for p in parts:
        yield _in_order(data, p, ready)


def frames_of_each(parts: Iterable[tuple[np.ndarray, StreamInfo, int, int | None]]) -> Iterator[Iterator[tuple[int, np.ndarray | None]]]:
    """frames_of each of several stretches, in their order; frames of short ones are decoded side by side, since a group of a few
    frames takes nearly the time of a full one."""
    held: list[_Part] = []
    for one in parts:
        part = _part(*one)
        if held and sum(len(p.heads) for p in held) + len(part.heads) > GROUP:
            yield from _side_by_side(held)
            held = []
        held.append(part)
    if held:
        yield from _side_by_side(held)


def frames_of(data: np.ndarray, info: StreamInfo, first: int = 0, last: int | None = None) -> Iterator[tuple[int, np.ndarray | None]]:
    """(place in the stream, samples of shape (channels, block)) of the frames that begin in [first, last) of padded data,
    in order; None for one that is there but fails."""
    yield from next(frames_of_each([(data, info, first, last)]))


def to_float(samples: np.ndarray, width: int) -> np.ndarray:
    return (samples / float(1 << (width - 1))).astype(np.float32)


class Frames(Packets):
    """A file's frames, or what holds them."""

    def __init__(self, known: AudioFormat, info: StreamInfo, packets: list[bytes], count: int | None = None):
        super().__init__(known, packets, count)
        self.info = info

    def alike(self) -> Hashable:
        return "flac"

    def samples(self) -> Iterator[np.ndarray | None]:
        for a in range(0, len(self.packets), GROUP):
            for _, found in frames_of(bits.padded(b"".join(self.packets[a : a + GROUP])), self.info):
                yield found

    @staticmethod
    def together(some: list[Frames]) -> None:
        each = list(frames_of_each((bits.padded(b"".join(f.packets)), f.info, 0, None) for f in some))
        for f, found in zip(some, each, strict=True):
            f.ready = (samples for _, samples in found)


def decode_flac(data: bytes, extension: str = "flac") -> tuple[AudioFormat, Frames]:
    """A whole file: its format, and blocks of (frames, channels); failed frames are left out and counted in the format."""
    info = stream_info(lambda n, at: data[at : at + n], len(data))
    count = -(-info.samples // max(16, info.least_block)) if info.samples else GROUP
    return (known := info.format()), Frames(known, info, [data[info.start :]], count)


def md5(data: bytes) -> tuple[bytes, bytes]:
    """Digest of the decoded samples and the one that the file gives."""
    info, digest = stream_info(lambda n, at: data[at : at + n], len(data)), hashlib.md5(usedforsecurity=False)
    size = (info.bits + 7) // 8
    for _, samples in frames_of(bits.padded(data), info, info.start):
        if samples is not None:
            wide = np.ascontiguousarray(samples.T.reshape(-1)).astype("<i8").view(np.uint8).reshape(-1, 8)
            digest.update(np.ascontiguousarray(wide[:, :size]).tobytes())
    return digest.digest(), info.md5


def _rice(missed: np.ndarray, parts: int, order: int, block: int, escape: bool = False) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Fields (value, width, length) of residuals in 2**parts partitions, each with the parameter that suits its mean."""
    folded = np.where(missed < 0, -2 * missed - 1, 2 * missed)
    out, at, length = [], 0, block >> parts
    for k in range(1 << parts):
        some = folded[at : at + length - (order if k == 0 else 0)]
        plain = missed[at : at + len(some)]
        at += len(some)
        width = int((plain ^ (plain >> 63)).max(initial=0)).bit_length() + 1 if plain.any() else 0
        if escape and width < 32:
            out.append((np.array([31, width]), np.array([5, 5]), np.array([5, 5])))
            out.append((plain & ((1 << width) - 1), np.full(len(plain), width), np.full(len(plain), width)))
            continue
        mean = float(some.mean()) if len(some) else 0.0
        r = min(30, max(0, int(np.log2(mean + 1e-9)))) if mean >= 1 else 0
        out.append((np.array([r]), np.array([5]), np.array([5])))
        out.append(((1 << r) | (some & ((1 << r) - 1)), np.full(len(some), r + 1), (some >> r) + r + 1))
    return out


def _subframe(x: np.ndarray, width: int, kind: str, parts: int, escape: bool) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Fields of one channel's samples of a block: `constant`, `verbatim`, `fixedN`, `lpcN`, or `best` (of the fixed ones, a
    constant where it will do)."""
    field = lambda values, sizes: (np.asarray(values, np.int64), np.asarray(sizes, np.int64), np.asarray(sizes, np.int64))
    shift = 0
    if x.any():
        low = int(np.bitwise_or.reduce(x))
        shift = (low & -low).bit_length() - 1
    x, width = x >> shift, width - shift
    cut = lambda values, size: np.asarray(values, np.int64) & ((1 << size) - 1)
    head = lambda code: [field([code << 1 | (shift > 0)], [8]), *([field([1], [shift])] if shift else [])]
    if (kind in ("best", "constant")) and (x == x[0]).all():
        return [*head(0), field(cut(x[:1], width), [width])]
    if kind == "verbatim":
        return [*head(1), field(cut(x, width), np.full(len(x), width))]
    if kind.startswith("lpc"):
        order, precision, down = int(kind[3:]), 12, 9
        lags = np.array([float((x[: len(x) - j] * 1.0 * x[j:]).sum()) for j in range(order + 1)])
        table = lags[np.abs(np.subtract.outer(np.arange(order), np.arange(order)))] + np.eye(order) * (1e-3 * lags[0] + 1)
        weights = np.clip(np.round(np.linalg.solve(table, lags[1:]) * (1 << down)), -2048, 2047).astype(np.int64)
        total = sum(int(c) * x[order - 1 - j : len(x) - 1 - j] for j, c in enumerate(weights))
        fields = [*head(31 + order), field(cut(x[:order], width), np.full(order, width)), field([precision - 1, down], [4, 5]), field(cut(weights, precision), np.full(order, precision))]
        missed = x[order:] - (total >> down)
    else:
        tries = [int(kind[5:])] if kind.startswith("fixed") else range(5)
        missed, order = min(((np.diff(x, n=o), o) for o in tries if o < len(x)), key=lambda t: float(np.abs(t[0]).sum()) / max(1, len(t[0])))
        fields = [*head(8 + order), field(cut(x[:order], width), np.full(order, width))]
    while len(x) % (1 << parts) or (len(x) >> parts) <= order:
        parts -= 1
    coded = _rice(missed, max(0, parts), order, len(x), escape)
    return [*fields, field([1, max(0, parts)], [2, 4]), *coded]


def encode_frame(x: np.ndarray, number: int, width: int, kind: str = "best", stereo: str = "best", parts: int = 3, escape: bool = False) -> bytes:
    """One frame from (channels, block) whole numbers; stereo is plain, left, right, mid or best."""
    channels, block = x.shape
    modes = {"plain": channels - 1}
    if channels == 2 and width < 32:
        modes |= {"left": LEFT_SIDE, "right": RIGHT_SIDE, "mid": MID_SIDE}
    if channels != 2 or width >= 32:
        stereo = "plain"
    side = x[0] - x[1] if channels == 2 else x[0]
    pairs = {"plain": list(x), "left": [x[0], side], "right": [side, x[1] if channels == 2 else x[0]], "mid": [(x[0] + x[-1]) >> 1, side]}
    if stereo == "best":
        rough = lambda rows: sum(float(np.abs(np.diff(r, n=2)).sum()) for r in rows)
        stereo = min(modes, key=lambda m: rough(pairs[m]))
    code = next((k for k, v in BLOCK_SIZES.items() if v == block), 7)
    head = bytes([0xFF, 0xF8, code << 4, modes[stereo] << 4 | next((k for k, v in SAMPLE_BITS.items() if v == width), 0) << 1])
    if number < 128:
        head += bytes([number])
    else:
        more = next(n for n in range(2, 8) if number < 1 << (6 * (n - 1) + 7 - n))
        head += bytes([(0xFF00 >> more) & 0xFF | number >> 6 * (more - 1), *[0x80 | number >> 6 * k & 0x3F for k in range(more - 2, -1, -1)]])
    if code == 7:
        head += (block - 1).to_bytes(2, "big")
    head += bytes([CRC8.one(head)])
    fields = []
    for c, row in enumerate(pairs[stereo]):
        wider = stereo == "right" if c == 0 else stereo in ("left", "mid")
        fields += _subframe(row.astype(np.int64), width + wider, kind, parts, escape)
    body = head + bits.pack(*(np.concatenate([f[k] for f in fields]) for k in range(3))).tobytes()
    return body + CRC16.one(body).to_bytes(2, "big")


def encode(x: np.ndarray, rate: int, width: int = 16, block: int = 4096, **how: object) -> bytes:
    """A FLAC file of (channels, samples) whole numbers; `how` as in encode_frame, values may be lists to take in turn."""
    x = np.asarray(x, np.int64)
    turn = lambda k: {name: v[k % len(v)] if isinstance(v, list) else v for name, v in how.items()}
    frames = [encode_frame(x[:, at : at + block], k, width, **turn(k)) for k, at in enumerate(range(0, x.shape[1], block))]
    sizes = [len(f) for f in frames] or [0]
    size = (width + 7) // 8
    raw = np.ascontiguousarray(np.ascontiguousarray(x.T.reshape(-1)).astype("<i8").view(np.uint8).reshape(-1, 8)[:, :size]).tobytes()
    packed = rate << 44 | (x.shape[0] - 1) << 41 | (width - 1) << 36 | x.shape[1]
    info = struct.pack(">HH", block, block) + min(sizes).to_bytes(3, "big") + max(sizes).to_bytes(3, "big") + packed.to_bytes(8, "big") + hashlib.md5(raw, usedforsecurity=False).digest()
    return b"fLaC" + bytes([0x80]) + len(info).to_bytes(3, "big") + info + b"".join(frames)


register_decoder("flac", decode_flac)
