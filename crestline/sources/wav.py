"""WAV files and raw PCM, decoded block by block; blocks are whole windows of frames."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

from crestline.constants import BIT_DEPTHS, MAX_CHANNELS
from crestline.operators.windows import window_frames
from crestline.sources.registry import AudioError, AudioFormat, register_decoder

PCM, FLOAT, EXTENSIBLE = 1, 3, 0xFFFE
LFE_BITS = (0x8, 0x800000)


def to_float(raw: bytes, encoding: str) -> np.ndarray:
    """Little-endian samples as 32-bit floats in [-1, 1)."""
    if encoding == "u8":
        return ((np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128).astype(np.float32)
    if encoding == "s16le":
        return (np.frombuffer(raw[: len(raw) // 2 * 2], "<i2").astype(np.float64) / 32768).astype(np.float32)
    if encoding == "s24le":
        three = np.frombuffer(raw[: len(raw) // 3 * 3], np.uint8).reshape(-1, 3).astype(np.int32)
        value = three[:, 0] | (three[:, 1] << 8) | (three[:, 2] << 16)
        return ((value - ((value & 0x800000) << 1)) / 8388608).astype(np.float32)
    if encoding == "s32le":
        return (np.frombuffer(raw[: len(raw) // 4 * 4], "<i4").astype(np.float64) / 2147483648).astype(np.float32)
    if encoding == "f32le":
        return np.frombuffer(raw[: len(raw) // 4 * 4], "<f4")
    if encoding == "f64le":
        return np.frombuffer(raw[: len(raw) // 8 * 8], "<f8").astype(np.float32)
    raise AudioError("FormatError", f"unsupported encoding {encoding}")


def probe(data: bytes) -> tuple[AudioFormat, str, int, int]:
    """Format, encoding, and where the samples begin and end in the file."""
    if len(data) < 12 or data[:4] != b"RIFF" or data[8:12] != b"WAVE":
        raise AudioError("FormatError", "not a WAV file")
    at, known, mask = 12, None, 0
    while at + 8 <= len(data):
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        body = at + 8
        if name == b"fmt " and size >= 16 and body + 16 <= len(data):
            tag, channels, rate, _, _, bits = struct.unpack_from("<HHIIHH", data, body)
            if tag == EXTENSIBLE and size >= 40 and body + 40 <= len(data) and struct.unpack_from("<H", data, body + 16)[0] >= 22:
                mask = struct.unpack_from("<I", data, body + 20)[0]
                tag = struct.unpack_from("<H", data, body + 24)[0]
            known = (tag, channels, rate, bits)
        elif name == b"data":
            if known is None:
                raise AudioError("FormatError", "samples before their format")
            tag, channels, rate, bits = known
            if rate <= 0 or not 1 <= channels <= MAX_CHANNELS or bits not in BIT_DEPTHS:
                raise AudioError("FormatError", f"{rate} Hz, {channels} channels, {bits} bits")
            encoding = {(PCM, 8): "u8", (PCM, 16): "s16le", (PCM, 24): "s24le", (PCM, 32): "s32le", (FLOAT, 32): "f32le", (FLOAT, 64): "f64le"}.get((tag, bits))
            if encoding is None:
                raise AudioError("FormatError", f"encoding {tag} with {bits} bits")
            frames = size // (channels * bits // 8)
            lfe = [(mask & (bit - 1)).bit_count() for bit in LFE_BITS if mask & bit]
            return AudioFormat(rate, channels, bits, frames, "WAV/PCM", lfe, mask != 0), encoding, body, min(len(data), body + size)
        at = body + size + size % 2
    raise AudioError("FormatError", "no samples")


def decode_wav(data: bytes, extension: str = "wav") -> tuple[AudioFormat, Iterator[np.ndarray]]:
    """Blocks of one window of frames; a cut file gives the whole frames that are there."""
    found, encoding, start, end = probe(data)
    width = found.channels * found.bits_per_sample // 8
    step = window_frames(found.sample_rate) * width

    def blocks() -> Iterator[np.ndarray]:
        whole = start + (end - start) // width * width
        for at in range(start, whole, step):
            yield to_float(data[at : min(at + step, whole)], encoding).reshape(-1, found.channels)

    return found, blocks()


register_decoder("wav", decode_wav)
