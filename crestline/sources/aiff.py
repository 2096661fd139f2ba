"""AIFF and AIFF-C files with plain samples: big-endian integers or floats, or little-endian ones (`sowt`)."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

from crestline.constants import BIT_DEPTHS, MAX_CHANNELS
from crestline.operators.windows import window_frames
from crestline.sources.registry import AudioError, AudioFormat, register_decoder
from crestline.sources.wav import to_float

#: Compression types of plain samples: whether they are little-endian, whether they are floats.
PLAIN = {b"NONE": (False, False), b"twos": (False, False), b"sowt": (True, False), b"fl32": (False, True), b"FL32": (False, True), b"fl64": (False, True), b"FL64": (False, True)}


def extended(raw: bytes) -> float:
    """An 80-bit float: sign and exponent in 16 bits, then a mantissa of 64 with its leading one."""
    power, mantissa = struct.unpack(">HQ", raw)
    return (-1.0 if power >> 15 else 1.0) * mantissa * 2.0 ** ((power & 0x7FFF) - 16383 - 63)


def probe(data: bytes) -> tuple[AudioFormat, bool, str, int, int]:
    """Format, whether bytes are reversed, encoding, and where the samples begin and end."""
    if len(data) < 12 or data[:4] != b"FORM" or data[8:12] not in (b"AIFF", b"AIFC"):
        raise AudioError("FormatError", "not an AIFF file")
    at, common, samples = 12, None, None
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from(">I", data, at + 4)[0]
        body = at + 8
        if name == b"COMM" and body + 18 <= len(data):
            channels, frames, bits = struct.unpack_from(">hIh", data, body)
            kind = data[body + 18 : body + 22] if data[8:12] == b"AIFC" else b"NONE"
            common = channels, frames, bits, extended(data[body + 8 : body + 18]), kind
        elif name == b"SSND" and body + 8 <= len(data):
            offset = struct.unpack_from(">I", data, body)[0]
            samples = body + 8 + offset, min(len(data), body + size)
        at = body + size + size % 2
    if common is None or samples is None:
        raise AudioError("FormatError", "no format" if common is None else "no samples")
    channels, frames, bits, rate, kind = common
    if kind not in PLAIN:
        raise AudioError("DecodingError", f"compression {kind.decode('latin-1')}")
    little, floating = PLAIN[kind]
    encodings = {32: "f32le", 64: "f64le"} if floating else {8: "u8", 16: "s16le", 24: "s24le", 32: "s32le"}
    if not 1 <= rate <= 2**31 - 1 or not 1 <= channels <= MAX_CHANNELS or bits not in BIT_DEPTHS or bits not in encodings:
        raise AudioError("FormatError", f"{rate:g} Hz, {channels} channels, {bits} bits")
    return AudioFormat(round(rate), channels, bits, frames, "AIFF"), not little, encodings[bits], *samples


def decode_aiff(data: bytes, extension: str = "aiff") -> tuple[AudioFormat, Iterator[np.ndarray]]:
    """Blocks of one window of frames; a cut file gives the whole frames that are there, never more than it declares."""
    found, reverse, encoding, start, end = probe(data)
    size = found.bits_per_sample // 8
    width = found.channels * size
    step = window_frames(found.sample_rate) * width

    def blocks() -> Iterator[np.ndarray]:
        whole = start + min(found.sample_count, max(0, end - start) // width) * width
        for at in range(start, whole, step):
            raw = np.frombuffer(data[at : min(at + step, whole)], np.uint8).reshape(-1, size)
            if size == 1:
                raw = raw ^ 0x80  # signed here, unsigned there
            yield to_float((raw[:, ::-1] if reverse else raw).tobytes(), encoding).reshape(-1, found.channels)

    return found, blocks()


register_decoder("aiff", decode_aiff)
