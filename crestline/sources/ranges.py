"""Large files in pieces: spark.read.format("audio_windows").load(directory).

PCM has frames of a fixed size, one-bit files bytes of a fixed order, and the frames of FLAC can be found from any byte on,
so such files can be cut and their pieces read by different tasks; each reads its own bytes (and, for what begins there,
some of its neighbours').
Rows are windows (path, channel, win, n, sum_sq, peak), of FLAC in parts that add up, and one row a piece that says what the
file is, how many frames the piece had, or why it failed. Small files share a task, by their number as well as by their bytes:
opening and decoding a file of a few bytes takes its time too. Files are opened through pyarrow's file
systems (local paths and URIs it knows). The driver lists files and opens none; a task reads the header, chunk by chunk.
"""

from __future__ import annotations

import struct
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Protocol, TypeVar

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from crestline.operators.windows import window_frames
from crestline.sources import bits, dsd, files, flac, wav
from crestline.sources.registry import AudioError, AudioFormat

#: Bytes of a file that are one task's share, and bytes of a format chunk that say what is needed.
SHARE_BYTES, FORMAT_BYTES = 64 << 20, 64
#: Most ranges of a task, and bytes that a task has room for however short the ranges are.
TOGETHER, LEAST_BYTES = 64, 4 << 20
#: Extensions of files that can be cut.
CUT = ("wav", "flac", "dsf", "dff")


@dataclass
class Piece:
    path: str
    size: int
    first: int
    last: int


@dataclass
class Pieces(InputPartition):
    pieces: list[Piece]


class Range(Protocol):
    first: int
    last: int


AnyRange = TypeVar("AnyRange", bound=Range)


def dealt(found: Iterable[AnyRange], share: int) -> list[list[AnyRange]]:
    """Ranges, in order, by task: each counts as a TOGETHERth of a task's room at least, so neither long nor many ranges meet
    in one task, and neither bytes nor tasks are as many as short ranges."""
    room, left, out = max(share, LEAST_BYTES), 0, []
    for part in found:
        cost = max(part.last - part.first, room // TOGETHER)
        if cost > left:
            out.append([])
            left = max(room, cost)
        out[-1].append(part)
        left -= cost
    return out


def system_of(path: str) -> tuple[fs.FileSystem, str, str]:
    """File system, path within it, and what stands before such paths."""
    if "://" in path:
        system, base = fs.FileSystem.from_uri(path)
        return system, base, path.split("://")[0] + "://"
    return fs.LocalFileSystem(), path.removeprefix("file:"), "file:"


def readable(path: str) -> bool:
    """Whether pyarrow knows the store of a path and finds it there."""
    try:
        system, base, _ = system_of(path)
        return system.get_file_info(base).type == fs.FileType.Directory
    except (pa.ArrowException, OSError):
        return False


def probe(file: pa.NativeFile, size: int) -> tuple[AudioFormat, str, int]:
    """Format, encoding and start of the samples of a file of any length; of other chunks only their names are read."""
    head, at = file.read_at(12, 0), 12
    if head[:4] != b"RIFF" or head[8:] != b"WAVE":
        raise AudioError("FormatError", "not a WAV file")
    while at + 8 <= size:
        chunk = file.read_at(8, at)
        name, length = chunk[:4], struct.unpack_from("<I", chunk, 4)[0]
        if name == b"data":
            known, encoding, _, _ = wav.probe(head + chunk)
            return known, encoding, at + 8
        if name == b"fmt ":
            body = file.read_at(min(length, FORMAT_BYTES, size - at - 8), at + 8)
            head += chunk[:4] + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)
        at += 8 + length + length % 2
    raise AudioError("FormatError", "no samples")


class _At:
    """A stretch of an open file that may end early."""

    def __init__(self, file: pa.NativeFile, size: int):
        self.file, self.size = file, size

    def __call__(self, length: int, at: int) -> bytes:
        return self.file.read_at(max(0, min(length, self.size - at)), at) if at < self.size else b""


def _wav(file: pa.NativeFile, piece: Piece, levels: files.Levels, plan: dsd.Plan) -> tuple[AudioFormat, int]:
    known, encoding, start = probe(file, piece.size)
    width = known.channels * known.bits_per_sample // 8
    step = window_frames(known.sample_rate) * width
    end, frames = start + min(known.sample_count, max(0, piece.size - start) // width) * width, 0
    # the first window that begins at or after the piece's first byte, counted from the samples' start
    win = max(0, -(-(piece.first - start) // step))
    for at in range(start + win * step, min(end, piece.last), step):
        raw = file.read_at(min(step, end - at), at)
        if encoding == "s16le":  # the commonest: whole numbers, scaled once
            levels.add(win, np.frombuffer(raw, "<i2").reshape(-1, known.channels).T, 32768.0)
        else:
            levels.add(win, wav.to_float(raw, encoding).reshape(-1, known.channels).T)
        frames += len(raw) // width
        win += 1
    return known, frames


def _flac_part(file: pa.NativeFile, piece: Piece) -> tuple[np.ndarray, flac.StreamInfo, int]:
    """The bytes in which frames of the piece lie, the file's format, and how many of them are the piece's own."""
    read = _At(file, piece.size)
    info = flac.stream_info(read, piece.size)
    begin = max(piece.first, info.start)
    if begin >= piece.last:
        return bits.padded(b""), info, 0
    return bits.padded(read(piece.last + info.frame_bytes + flac.LONGEST_HEADER - begin, begin)), info, piece.last - begin


def _flac(info: flac.StreamInfo, found: Iterable[tuple[int, np.ndarray | None]], levels: files.Levels) -> tuple[AudioFormat, int]:
    known, step, frames = info.format(), window_frames(info.rate), 0
    held: list[np.ndarray] = []

    def flush(first: int) -> None:
        if held:
            joined = np.concatenate(held, axis=1)
            if info.bits > 24:
                levels.add_from(first, flac.to_float(joined, info.bits), step)
            else:
                levels.add_from(first, joined, step, float(1 << (info.bits - 1)))
            held.clear()

    first = at = 0
    for place, samples in found:
        if samples is None:
            known.skipped_packets += 1
            continue
        if place != at or len(held) >= 64:
            flush(first)
        if not held:
            first = place
        held.append(samples)
        at, frames = place + samples.shape[1], frames + samples.shape[1]
    flush(first)
    return known, frames


def _dsd(file: pa.NativeFile, piece: Piece, levels: files.Levels, plan: dsd.Plan) -> tuple[AudioFormat, int]:
    read = _At(file, piece.size)
    info = dsd.probe(read, piece.size)
    known, step = info.format(plan), dsd.step_bytes(info, plan)
    width, frames = window_frames(known.sample_rate), 0
    # windows whose first byte lies in the piece; all channels of a byte lie in one group
    first = max(0, piece.first - info.start) // info.channels // (width * step)
    for win in range(max(0, first - 1), -(-known.sample_count // width)):
        place = info.place(win * width * step)
        if place >= piece.last:
            break
        if place >= piece.first:
            found = dsd.samples(info, plan, read, win * width, min((win + 1) * width, known.sample_count))
            levels.add(win, found)
            frames += found.shape[1]
    return known, frames


READERS = {"wav": _wav, "dsf": _dsd, "dff": _dsd}
FAILURES = (AudioError, ValueError, IndexError, struct.error)


@dataclass
class Read:
    """What a piece gave: its windows, the file's format and the piece's frames, or why it failed."""

    piece: Piece
    levels: files.Levels
    known: AudioFormat | None = None
    frames: int = 0
    error: Exception | None = None


def read_pieces(pieces: Iterable[Piece], system: fs.FileSystem, before: str, plan: dsd.Plan) -> Iterator[Read]:
    """Pieces read one after the other, those of FLAC files last: their frames are decoded side by side over short files."""
    coded: list[Piece] = []
    for piece in pieces:
        kind = piece.path.rsplit(".", 1)[-1].lower()
        if kind == "flac" and piece.size:
            coded.append(piece)
            continue
        out = Read(piece, files.Levels(before + piece.path))
        try:
            if not piece.size:
                raise AudioError("FormatError", "empty file")
            with system.open_input_file(piece.path) as file:
                out.known, out.frames = READERS[kind](file, piece, out.levels, plan)
        except FAILURES as e:
            out.error = e
        yield out
    opened, failed = deque(), deque()

    def parts() -> Iterator[tuple[np.ndarray, flac.StreamInfo, int, int]]:
        for piece in coded:
            out = Read(piece, files.Levels(before + piece.path))
            try:
                with system.open_input_file(piece.path) as file:
                    data, info, own = _flac_part(file, piece)
            except FAILURES as e:
                out.error = e
                failed.append(out)
                continue
            opened.append((out, info))
            yield data, info, 0, own

    for found in flac.frames_of_each(parts()):
        out, info = opened.popleft()
        try:
            out.known, out.frames = _flac(info, found, out.levels)
        except FAILURES as e:
            out.error = e
        yield out
    yield from failed


class AudioWindowsReader(DataSourceReader):
    def __init__(self, path: str, recursive: bool, share: int, extensions: tuple[str, ...], plan: dsd.Plan):
        self.path, self.recursive, self.share, self.extensions, self.plan = path, recursive, share, extensions, plan

    def partitions(self) -> list[InputPartition]:
        system, base, _ = system_of(self.path)
        found = system.get_file_info(fs.FileSelector(base, recursive=self.recursive))
        pieces: list[Piece] = []
        for info in sorted(found, key=lambda x: x.path):
            if info.type != fs.FileType.File or info.extension.lower() not in self.extensions:
                continue
            pieces += [Piece(info.path, info.size, first, min(first + self.share, info.size)) for first in range(0, max(info.size, 1), self.share)]
        return [Pieces(found) for found in dealt(pieces, self.share)] or [Pieces([])]

    def read(self, partition: Pieces) -> Iterator[pa.RecordBatch]:
        system, _, before = system_of(self.path)
        yield from files.joined(batch for found in read_pieces(partition.pieces, system, before, self.plan) for batch in files.batches(found.levels, found.known, found.frames, found.error))


class AudioWindows(DataSource):
    @classmethod
    def name(cls) -> str:
        return "audio_windows"

    def schema(self) -> str:
        return files.BOTH

    def reader(self, schema: object) -> DataSourceReader:
        extensions = tuple(self.options.get("extensions", ",".join(CUT)).split(","))
        plan = dsd.Plan(int(self.options.get("dsd_rate", dsd.DSD_RATE)), self.options.get("dsd_filter", "teac"), float(self.options.get("dsd_gain_db", dsd.DSD_GAIN_DB)))
        return AudioWindowsReader(self.options["path"], self.options.get("recursive", "false").lower() == "true", int(self.options.get("share", SHARE_BYTES)), extensions, plan)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(AudioWindows)
