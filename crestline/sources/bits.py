"""Bits of many places at once: arrays of bit positions into one buffer, and checksums of many stretches of it."""

from __future__ import annotations

import numpy as np

#: Bytes after the end that may be looked at.
PAD = 64
#: Most bits of a value.
WIDEST = 56


def padded(data: bytes | memoryview) -> np.ndarray:
    out = np.zeros(len(data) + PAD, np.uint8)
    out[: len(data)] = np.frombuffer(data, np.uint8)
    return out


def words(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each byte on as a big-endian number; a view, nothing is copied."""
    return np.ndarray((len(data) - 7,), ">u8", data, strides=(1,))


def peek(w: np.ndarray, at: np.ndarray) -> np.ndarray:
    """64-bit numbers whose highest 57 bits are those from each bit position on."""
    return w[at >> 3].astype(np.uint64) << (at & 7).view(np.uint64)


def read(w: np.ndarray, at: np.ndarray, bits: np.ndarray | int) -> np.ndarray:
    """Unsigned numbers of so many bits (WIDEST at most) at each position."""
    n = np.asarray(bits, np.int64)
    return ((peek(w, at) >> np.uint64(1)) >> (63 - n).astype(np.uint64)).astype(np.int64)


def read_signed(w: np.ndarray, at: np.ndarray, bits: np.ndarray | int) -> np.ndarray:
    n = np.asarray(bits, np.int64)
    value, half = read(w, at, n), np.int64(1) << np.maximum(n - 1, 0)
    return np.where(n > 0, (value ^ half) - half, 0)


def zeros_before_one(w: np.ndarray, at: int, end: int) -> int:
    """Zeros from one bit position on, however many."""
    here = at
    while here < end:
        top = int(peek(w, np.array([here]))[0]) >> 7
        if top:
            return here - at + 57 - top.bit_length()
        here += 57
    raise ValueError("no one among the rest")


def pack(values: np.ndarray, widths: np.ndarray, lengths: np.ndarray | None = None) -> np.ndarray:
    """Bytes of numbers one after the other, highest bit first; a number has `widths` bits, in a field of `lengths` (zeros in
    front). The last byte is filled up with zeros."""
    lengths = widths if lengths is None else lengths
    ends = np.cumsum(lengths)
    bits = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint8)
    for k in range(int(widths.max(initial=0))):
        some = widths > k
        bits[(ends - 1 - k)[some]] = (values[some] >> k) & 1
    return np.packbits(bits)


def _table(polynomial: int, bits: int) -> np.ndarray:
    out, top = np.arange(256, dtype=np.int64) << (bits - 8), 1 << (bits - 1)
    for _ in range(8):
        out = np.where(out & top, (out << 1) ^ polynomial, out << 1) & ((1 << bits) - 1)
    return out


class Crc:
    """A checksum of up to 32 bits, highest bit first."""

    BLOCK = 64

    def __init__(self, polynomial: int, bits: int):
        self.bits, self.table = bits, _table(polynomial, bits).astype(np.uint32)
        # what a block of zeros makes of each byte of a checksum
        step = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(bits // 8)])
        for _ in range(self.BLOCK):
            step = self._next(step, np.uint32(0))
        self.over = step

    def _next(self, state: np.ndarray, byte: np.ndarray) -> np.ndarray:
        mask = np.uint32((1 << self.bits) - 1)
        return ((state << np.uint32(8)) & mask) ^ self.table[(state >> np.uint32(self.bits - 8)) ^ byte]

    def one(self, data: bytes) -> int:
        state, table, mask, down = 0, self.table.tolist(), (1 << self.bits) - 1, self.bits - 8
        for byte in data:
            state = ((state << 8) & mask) ^ table[(state >> down) ^ byte]
        return state

    def many(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Checksums of the stretches, from 0 on: blocks of all of them side by side, then the blocks of each. Zeros in front
        change nothing, so stretches are filled up to whole blocks there."""
        if not len(starts):
            return np.zeros(0, np.uint32)
        blocks = -(-(ends - starts) // self.BLOCK)
        most = int(blocks.max())
        owner = np.repeat(np.arange(len(starts)), blocks)
        number = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks) + (most - blocks)[owner]
        at = ends[owner] - (most - number) * self.BLOCK
        state = np.zeros(len(owner), np.uint32)
        for k in range(self.BLOCK):
            here = at + k
            state = self._next(state, np.where(here >= starts[owner], data[np.maximum(here, 0)], 0).astype(np.uint32))
        grid = np.zeros((most, len(starts)), np.uint32)
        grid[number, owner] = state
        total = np.zeros(len(starts), np.uint32)
        for row in grid:
            total = np.bitwise_xor.reduce([self.over[k][(total >> np.uint32(8 * k)) & np.uint32(255)] for k in range(self.bits // 8)]) ^ row
        return total
