"""MP4: the tree of boxes, the sample tables joined into packets, and where each codec goes.

A file is boxes within boxes, each with its length in front, so a walk reads a few bytes a box wherever the table of contents
lies. A track's packets follow from four tables: how many packets each chunk has (stsc, in runs), where chunks begin (stco,
co64), how long each packet is (stsz, stz2), and how many ticks it lasts (stts, in runs). They are joined by sums over runs.

Plain samples, FLAC and ALAC are decoded here. For other codecs the decoder given for the codec itself takes the whole file (`ac3`
and `eac3` for those found in an MP4, `aac`, `opus`, `mp3`); without one the file is an error row.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from crestline.sources import alac, flac
from crestline.sources.registry import AudioError, AudioFormat, Routed, register_decoder, scan
from crestline.sources.wav import to_float

#: Boxes that hold boxes.
NESTED = (b"moov", b"trak", b"mdia", b"minf", b"stbl")
#: Codec of a sample entry, the extension whose decoder takes it, and its name in reports.
CODECS = {
    b"mp4a": ("aac", "AAC"), b"alac": ("alac", "ALAC"), b"ac-3": ("ac3", "AC3"), b"ec-3": ("eac3", "EAC3"), b"Opus": ("opus", "Opus"), b".mp3": ("mp3", "MP3"),
    b"fLaC": ("flac", "FLAC"), b"sowt": ("", "WAV/PCM"), b"twos": ("", "WAV/PCM"), b"fl32": ("", "WAV/PCM"), b"fl64": ("", "WAV/PCM"),
}
#: Deepest nesting, and bytes of a table read at once: what is longer is no table of contents.
DEEPEST, TABLE_BYTES = 12, 1 << 28
PACKETS = "path string, codec string, sample_rate int, channels int, seq bigint, first_frame bigint, n_frames bigint, offset bigint, length bigint, error string"

ReadAt = Callable[[int, int], bytes]


@dataclass
class Track:
    codec: bytes = b""
    rate: int = 0
    channels: int = 0
    bits: int = 0
    timescale: int = 0
    duration: int = 0
    sound: bool = False
    setup: dict[bytes, bytes] = field(default_factory=dict)
    tables: dict[bytes, bytes] = field(default_factory=dict)


def boxes(read: ReadAt, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Name, begin and end of the body of each box of a stretch. A length of 0 reaches to its end, 1 means 64 bits follow."""
    at = start
    while at + 8 <= end:
        size, name = struct.unpack(">I4s", read(8, at))
        body = at + 8
        if size == 1:
            wide = read(8, body)
            if len(wide) < 8:
                return
            size, body = struct.unpack(">Q", wide)[0], body + 8
        elif size == 0:
            size = end - at
        if size < body - at:
            raise AudioError("FormatError", f"box {name!r} has no room for itself")
        yield name, body, min(end, at + size)
        at += size


def _sample_entry(track: Track, raw: bytes) -> None:
    """The first entry of stsd: codec, and what it says of the samples; boxes within are kept."""
    if len(raw) < 44:
        raise AudioError("FormatError", "no sample entry")
    size, track.codec = struct.unpack_from(">I4s", raw, 8)
    version, track.channels, track.bits, rate = struct.unpack_from(">H6xHH4xI", raw, 24)
    track.rate = rate >> 16
    inner = 44 + (16 if version == 1 else 0)
    read = lambda n, at: raw[at : at + n]
    for name, a, b in boxes(read, inner, min(len(raw), 8 + size)):
        track.setup[name] = raw[a:b]
    if track.codec == b"alac" and len(own := track.setup.get(b"alac", b"")) >= 28:
        track.bits, track.channels, track.rate = own[9], own[13], struct.unpack_from(">I", own, 24)[0]
    if track.codec == b"fLaC" and len(own := track.setup.get(b"dfLa", b"")) >= 42:
        info = flac.stream_info(lambda n, at: (b"fLaC" + own[4:])[at : at + n], len(own))
        track.bits, track.channels, track.rate = info.bits, info.channels, info.rate


def tracks(read: ReadAt, size: int) -> list[Track]:
    out: list[Track] = []

    def walk(start: int, end: int, depth: int) -> None:
        for name, a, b in boxes(read, start, end):
            if name in NESTED and depth < DEEPEST:
                if name == b"trak":
                    out.append(Track())
                walk(a, b, depth + 1)
            elif out and name in (b"mdhd", b"hdlr", b"stsd", b"stts", b"stsc", b"stsz", b"stz2", b"stco", b"co64"):
                if b - a > TABLE_BYTES:
                    raise AudioError("FormatError", f"table {name!r} of {b - a} bytes")
                raw, track = read(b - a, a), out[-1]
                if name == b"mdhd":
                    track.timescale, track.duration = struct.unpack_from(">16xIQ" if raw[:1] == b"\1" else ">8xII", raw, 4)
                elif name == b"hdlr":
                    track.sound = raw[8:12] == b"soun"
                elif name == b"stsd":
                    _sample_entry(track, raw)
                else:
                    track.tables[name] = raw

    try:
        walk(0, size, 0)
    except struct.error as e:
        raise AudioError("FormatError", "a box is cut off") from e
    return out


def audio_track(read: ReadAt, size: int) -> Track:
    """The first sound track."""
    if size < 8 or read(8, 0)[4:8] not in (b"ftyp", b"moov", b"free", b"skip", b"wide", b"mdat"):
        raise AudioError("FormatError", "not an MP4 file")
    found = next((t for t in tracks(read, size) if t.sound and t.codec), None)
    if found is None:
        raise AudioError("FormatError", "no sound track")
    found.rate = found.rate or found.timescale
    return found


def _runs(table: bytes, width: int) -> np.ndarray:
    """Rows of a table of 32-bit numbers behind its version and count."""
    if len(table) < 8:
        return np.zeros((0, width), np.int64)
    count = min(struct.unpack_from(">I", table, 4)[0], (len(table) - 8) // (4 * width))
    return np.frombuffer(table, ">u4", count * width, 8).astype(np.int64).reshape(count, width)


def packets(track: Track) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First tick, ticks, place in the file and bytes of every packet, as far as all tables reach."""
    sizes = track.tables.get(b"stsz", b"")
    if sizes:
        one, count = struct.unpack_from(">II", sizes, 4)
        length = np.full(count, one, np.int64) if one else np.frombuffer(sizes, ">u4", min(count, (len(sizes) - 12) // 4), 12).astype(np.int64)
    elif compact := track.tables.get(b"stz2", b""):
        bits_, count = compact[7], struct.unpack_from(">I", compact, 8)[0]
        raw = np.frombuffer(compact, np.uint8, -1, 12)
        length = (np.stack([raw >> 4, raw & 15], axis=1).reshape(-1) if bits_ == 4 else raw if bits_ == 8 else raw[: len(raw) // 2 * 2].view(">u2")).astype(np.int64)[:count]
    else:
        raise AudioError("FormatError", "no sizes of packets")
    wide = track.tables.get(b"co64", b"")
    chunks = np.frombuffer(wide, ">u8", min(struct.unpack_from(">I", wide, 4)[0], (len(wide) - 8) // 8), 8).astype(np.int64) if wide else _runs(track.tables.get(b"stco", b""), 1)[:, 0]
    runs = _runs(track.tables.get(b"stsc", b""), 3)
    # packets of each chunk: a run holds up to the chunk that begins the next one
    firsts = np.clip(runs[:, 0] - 1, 0, len(chunks))
    many = np.repeat(runs[:, 1], np.maximum(np.diff(np.append(firsts, len(chunks))), 0))[: len(chunks)]
    chunk = np.repeat(np.arange(len(many)), many)[: len(length)]
    length = length[: len(chunk)]
    before = np.cumsum(length) - length
    opens = np.searchsorted(chunk, np.arange(len(many)), "left")
    inside = before - before[np.minimum(opens[chunk], max(0, len(before) - 1))] if len(chunk) else before
    times = _runs(track.tables.get(b"stts", b""), 2)
    ticks = np.repeat(times[:, 1], times[:, 0])[: len(length)]
    n = len(ticks)
    return np.cumsum(ticks) - ticks, ticks, chunks[chunk[:n]] + inside[:n], length[:n]


def _frames(track: Track, ticks: np.ndarray) -> np.ndarray:
    return ticks if track.timescale in (0, track.rate) else ticks * track.rate // track.timescale


def decode_mp4(data: bytes, extension: str = "m4a") -> tuple[AudioFormat, Iterable[np.ndarray]]:
    read = lambda n, at: data[at : at + n]
    track = audio_track(read, len(data))
    to, name = CODECS.get(track.codec, ("", track.codec.decode("latin-1")))
    first, ticks, at, length = packets(track)
    total = int(_frames(track, ticks).sum())
    if track.codec in (b"sowt", b"twos", b"fl32", b"fl64"):
        known = AudioFormat(track.rate, track.channels, track.bits, total, name)
        encoding = {b"fl32": "f32le", b"fl64": "f64le"}.get(track.codec) or {8: "u8", 16: "s16le", 24: "s24le", 32: "s32le"}.get(track.bits)
        if encoding is None or not track.rate or not track.channels:
            raise AudioError("FormatError", f"{track.rate} Hz, {track.channels} channels, {track.bits} bits")

        def plain() -> Iterator[np.ndarray]:
            size = track.bits // 8
            # packets that lie together are read together
            breaks = np.flatnonzero(at[1:] != at[:-1] + length[:-1]) + 1
            for a, b in zip(np.append(0, breaks), np.append(breaks, len(at)), strict=True):
                raw = np.frombuffer(data, np.uint8)[int(at[a]) : int(at[b - 1] + length[b - 1])] if b > a else np.zeros(0, np.uint8)
                raw = raw[: len(raw) // (size * track.channels) * size * track.channels].reshape(-1, size)
                turned = raw if track.codec == b"sowt" else raw[:, ::-1]
                yield to_float((turned ^ 0x80 if size == 1 else turned).tobytes(), encoding).reshape(-1, track.channels)

        return known, plain()
    if track.codec == b"fLaC" and b"dfLa" in track.setup:
        own = track.setup[b"dfLa"][4:]
        info = flac.stream_info(lambda n, at_: (b"fLaC" + own)[at_ : at_ + n], len(own) + 4)
        known = info.format()
        known.sample_count = known.sample_count or total

        return known, flac.Frames(known, info, [data[int(o) : int(o + n)] for o, n in zip(at, length, strict=True)])  # packets are frames
    if track.codec == b"alac" and b"alac" in track.setup:
        told = alac.config(track.setup[b"alac"][4:])
        known = told.format(total)

        return known, alac.Lossless(known, told, [data[int(o) : int(o + n)] for o, n in zip(at, length, strict=True)])
    raise Routed(to, name)


def packet_table(spark: SparkSession, directory: str, recursive: bool = False, extensions: tuple[str, ...] = ("mp4", "m4a")) -> DataFrame:
    """The packets of the first sound track of every MP4 file, from the files' tables alone: no sample is read. A file that
    is no such one has one row with its error."""
    from crestline.sources.ranges import system_of

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = pa.schema([("path", pa.string()), ("codec", pa.string()), ("sample_rate", pa.int32()), ("channels", pa.int32()), *[(c, pa.int64()) for c in ("seq", "first_frame", "n_frames", "offset", "length")], ("error", pa.string())])
        for batch in batches:
            for path in batch.column("path").to_pylist():
                try:
                    system, place, _ = system_of(path)
                    with system.open_input_file(place) as file:
                        size = file.size()
                        track = audio_track(lambda n, at, file=file, size=size: file.read_at(max(0, min(n, size - at)), at), size)
                    first, ticks, at, length = packets(track)
                except (AudioError, OSError, struct.error, ValueError) as e:
                    yield pa.RecordBatch.from_pylist([dict.fromkeys(types.names) | {"path": path, "error": str(e)}], types)
                    continue
                n, name = len(at), CODECS.get(track.codec, ("", track.codec.decode("latin-1")))[1]
                fixed = [pa.array([v] * n, t) for v, t in ((path, pa.string()), (name, pa.string()), (track.rate, pa.int32()), (track.channels, pa.int32()))]
                yield pa.RecordBatch.from_arrays([*fixed, pa.array(np.arange(n)), *[pa.array(x) for x in (_frames(track, first), _frames(track, ticks), at, length)], pa.nulls(n, pa.string())], schema=types)

    wanted = scan(spark, directory, recursive).where(" OR ".join(f"lower(path) LIKE '%.{e}'" for e in extensions))
    return wanted.select("path").mapInArrow(walk, PACKETS)


def payloads(table: DataFrame) -> DataFrame:
    """Adds `payload`, the bytes of each packet, read where the task is; null where the file ends before them."""
    from pyspark.sql import types as T

    from crestline.sources.ranges import system_of

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, path, file = [], None, None
            for name, at, n in zip(batch.column("path").to_pylist(), batch.column("offset").to_pylist(), batch.column("length").to_pylist(), strict=True):
                if name != path:
                    if file is not None:
                        file.close()
                    system, place, _ = system_of(name)
                    path, file = name, system.open_input_file(place)
                raw = file.read_at(n, at) if at + n <= file.size() else None
                out.append(raw)
            if file is not None:
                file.close()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.binary())], [*batch.schema.names, "payload"])

    good = table.where("error IS NULL")
    return good.mapInArrow(fetch, T.StructType([*good.schema.fields, T.StructField("payload", T.BinaryType())]))


def box(name: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I4s", len(body) + 8, name) + body


def write_mp4(codec: bytes, payload: list[bytes], ticks: list[int], rate: int, channels: int, width: int, setup: bytes = b"", per_chunk: int = 3, front: bool = True) -> bytes:
    """A file of one sound track; its table of contents stands before the packets or behind them."""
    full = lambda name, body: box(name, b"\0\0\0\0", body)
    entry = box(codec, bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", channels, width, 0, 0, (rate if rate < 65536 else 0) << 16), setup)
    runs: list[list[int]] = []
    for t in ticks:
        if runs and runs[-1][1] == t:
            runs[-1][0] += 1
        else:
            runs.append([1, t])
    chunks = [payload[a : a + per_chunk] for a in range(0, len(payload), per_chunk)]
    spread = [(1, per_chunk, 1)] + ([(len(chunks), len(chunks[-1]), 1)] if len(chunks) > 1 and len(chunks[-1]) != per_chunk else [])
    if len(chunks) == 1:
        spread = [(1, len(chunks[0]), 1)]
    start = box(b"ftyp", b"M4A \0\0\0\0M4A mp42")

    def contents(base: int) -> bytes:
        places, at = [], base
        for chunk in chunks:
            places.append(at)
            at += sum(map(len, chunk))
        table = box(
            b"stbl", full(b"stsd", struct.pack(">I", 1) + entry), full(b"stts", struct.pack(">I", len(runs)) + b"".join(struct.pack(">II", *r) for r in runs)),
            full(b"stsc", struct.pack(">I", len(spread)) + b"".join(struct.pack(">III", *r) for r in spread)),
            full(b"stsz", struct.pack(">II", 0, len(payload)) + b"".join(struct.pack(">I", len(p)) for p in payload)), full(b"stco", struct.pack(">I", len(places)) + b"".join(struct.pack(">I", p) for p in places)),
        )
        media = box(b"mdia", full(b"mdhd", struct.pack(">IIIIHH", 0, 0, rate, sum(ticks), 0, 0)), full(b"hdlr", bytes(4) + b"soun" + bytes(13)), box(b"minf", full(b"smhd", bytes(4)), table))
        return box(b"moov", full(b"mvhd", bytes(96)), box(b"trak", full(b"tkhd", bytes(80)), media))

    data = box(b"mdat", *payload)
    if front:
        size = len(contents(0))
        return start + contents(len(start) + size + 8) + data
    return start + data + contents(len(start) + 8)


for _extension in ("mp4", "m4a"):
    register_decoder(_extension, decode_mp4)
