"""From audio files to windows: whole files through decoders, files that can be cut by ranges.

Decoders travel to the workers inside the tasks: those built in, those registered on the driver, and those passed to
analyse(). Only files with an extension that some decoder or the fixed list knows are read at all. A file that cannot be
decoded gives an error row and the batch goes on.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Hashable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline.constants import EXTENSIONS
from crestline.functions import describe
from crestline.operators.windows import WINDOW_SECONDS, below, complete, window_frames
from crestline.sources import dsd
from crestline.sources.registry import AudioError, AudioFormat, Decoder, Packets, Routed, decoder_for, extensions_glob, known_decoders
from crestline.storage import written

#: What a file is, or why it failed; frames and failed packets as decoded.
META = (
    "path string, sample_rate int, channels int, bits_per_sample int, sample_count bigint, actual_frames bigint, codec string, "
    "lfe_indices array<int>, has_channel_layout_metadata boolean, processed_sample_rate int, skipped_packets bigint, error string, error_kind string"
)
WINDOWS = "path string, channel int, win bigint, n bigint, sum_sq double, peak double"
_WINDOW_TYPES = pa.schema([("path", pa.string()), ("channel", pa.int32()), ("win", pa.int64()), ("n", pa.int64()), ("sum_sq", pa.float64()), ("peak", pa.float64())])
_META_TYPES = pa.schema([
    ("path", pa.string()), ("sample_rate", pa.int32()), ("channels", pa.int32()), ("bits_per_sample", pa.int32()), ("sample_count", pa.int64()), ("actual_frames", pa.int64()), ("codec", pa.string()),
    ("lfe_indices", pa.list_(pa.int32())), ("has_channel_layout_metadata", pa.bool_()), ("processed_sample_rate", pa.int32()), ("skipped_packets", pa.int64()), ("error", pa.string()), ("error_kind", pa.string()),
])
BOTH = META + WINDOWS.removeprefix("path string")
BOTH_TYPES = pa.schema([*_META_TYPES, *list(_WINDOW_TYPES)[1:]])
#: Bytes beyond which Spark hands no file over whole.
LONGEST = (1 << 31) - 16
#: Rows of a batch that tasks hand over.
JOINED = 256


def _opened(path: str, data: bytes, decoders: dict[str, Decoder]) -> tuple[AudioFormat, Iterable[np.ndarray]]:
    extension = path.rsplit(".", 1)[-1].lower()
    try:
        return decoder_for(extension, decoders)(data, extension)
    except Routed as e:
        if e.extension not in decoders or e.extension == extension:
            raise
        return decoders[e.extension](data, extension)


def level_row(channels: np.ndarray, scale: float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Sums of squares and peaks of the rows of (channels, samples); NaN raises no peak. Samples are divided by scale."""
    wide = channels.astype(np.float64, order="C")
    sums = np.array([row @ row for row in wide]) / (scale * scale)
    peaks = np.maximum(wide.max(axis=1), -wide.min(axis=1)) / scale
    if np.isnan(peaks).any():
        peaks = np.where(np.isnan(wide), 0, np.abs(wide)).max(axis=1) / scale
    return sums, peaks


class Levels:
    """Windows of one file as they are found, in pieces that add up."""

    def __init__(self, path: str):
        self.path, self.found = path, {}

    def add(self, win: int, channels: np.ndarray, scale: float = 1.0) -> None:
        sums, peaks = level_row(channels, scale)
        n, s, p = self.found.get(win, (0, 0.0, 0.0))
        self.found[win] = (n + channels.shape[1], s + sums, np.maximum(p, peaks))

    def add_from(self, first: int, channels: np.ndarray, step: int, scale: float = 1.0) -> None:
        """Samples from a place in the stream on; they may lie in several windows."""
        at = 0
        while at < channels.shape[1]:
            win = (first + at) // step
            stop = min(channels.shape[1], (win + 1) * step - first)
            self.add(win, channels[:, at:stop], scale)
            at = stop

    def batch(self) -> pa.RecordBatch:
        """The windows as rows of BOTH_TYPES."""
        wins = list(self.found)
        counts = [len(np.atleast_1d(self.found[w][1])) for w in wins]
        columns = {
            "path": pa.array([self.path] * sum(counts), pa.string()),
            "channel": pa.array([c for k in counts for c in range(k)], pa.int32()),
            "win": pa.array(np.repeat(np.array(wins, np.int64), counts)),
            "n": pa.array(np.repeat(np.array([self.found[w][0] for w in wins], np.int64), counts)),
            "sum_sq": pa.array([x for w in wins for x in self.found[w][1]], pa.float64()),
            "peak": pa.array([x for w in wins for x in self.found[w][2]], pa.float64()),
        }
        rows = sum(counts)
        return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(rows, f.type)) for f in BOTH_TYPES], schema=BOTH_TYPES)


def meta_batch(path: str, found: AudioFormat | None, frames: int, error: Exception | None = None) -> pa.RecordBatch:
    """What a file, or a range of one, is, as a row of BOTH_TYPES."""
    row = dict.fromkeys(BOTH_TYPES.names) | {"path": path, "actual_frames": frames}
    if found is not None:
        row |= {"sample_rate": found.sample_rate, "channels": found.channels, "bits_per_sample": found.bits_per_sample, "sample_count": found.sample_count, "codec": found.codec}
        row |= {"lfe_indices": found.lfe_indices, "has_channel_layout_metadata": found.has_channel_layout_metadata, "skipped_packets": found.skipped_packets, "processed_sample_rate": found.processed_sample_rate}
    if error is not None:
        row |= {"error": str(error), "error_kind": error.kind if isinstance(error, AudioError) else "DecodingError"}
    return pa.RecordBatch.from_pylist([row], BOTH_TYPES)


def batches(levels: Levels, found: AudioFormat | None, frames: int, error: Exception | None = None) -> Iterator[pa.RecordBatch]:
    """Windows and format of a file or a range, or only why it failed."""
    if error is not None:
        yield meta_batch(levels.path, None, 0, error)
        return
    if levels.found:
        yield levels.batch()
    yield meta_batch(levels.path, found, frames)


def joined(some: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of JOINED rows or somewhat more: a batch of a row or two takes its time to hand over."""
    held: list[pa.RecordBatch] = []
    for batch in some:
        held.append(batch)
        if sum(b.num_rows for b in held) >= JOINED:
            yield pa.concat_batches(held)
            held = []
    if held:
        yield pa.concat_batches(held)


def _read_files(decoders: dict[str, Decoder], windows: bool = True) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The windows of each file, then one row that says what the file is or why it failed: a file is decoded once."""

    def told(path: str, found: AudioFormat | None, blocks: Iterable[np.ndarray], error: Exception | None) -> Iterator[pa.RecordBatch]:
        frames, levels = 0, Levels(path)
        try:
            if error is not None:
                raise error
            step = window_frames(found.sample_rate)
            for block in blocks:  # decoders may cut blocks anywhere
                if windows and len(block):
                    levels.add_from(frames, block.T, step)
                frames += len(block)
        except Exception as e:  # a decoder of the user's may raise anything; the batch goes on
            error = e
        if windows and levels.found:
            yield levels.batch()
        yield meta_batch(path, found if error is None else None, frames, error)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[Hashable, list[tuple[str, AudioFormat, Packets]]] = {}

        def taken(key: Hashable) -> Iterator[pa.RecordBatch]:
            some = held.pop(key)
            if len(some) > 1:
                with contextlib.suppress(Exception):  # then each is decoded by itself, and the one at fault told
                    some[0][2].together([blocks for *_, blocks in some])
            for path, found, blocks in some:
                yield from told(path, found, blocks, None)

        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                found, blocks, error = None, (), None
                try:
                    found, blocks = _opened(path, data, decoders)
                except Exception as e:
                    error = e
                if not isinstance(blocks, Packets) or blocks.count >= Packets.GROUP:
                    yield from told(path, found, blocks, error)
                    continue
                key = type(blocks), blocks.alike()
                if sum(b.count for *_, b in held.get(key, ())) + blocks.count > Packets.GROUP:
                    yield from taken(key)
                held.setdefault(key, []).append((path, found, blocks))
            for key in list(held):  # the batch's bytes are let go
                yield from taken(key)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from joined(rows(batches))

    return read


def _whole(rows: DataFrame) -> DataFrame:
    """META of each file from rows that may describe ranges of it; files of fewer than two frames are errors too."""
    once = lambda c: F.first(c, ignorenulls=True).alias(c)
    names = [f.name for f in _META_TYPES][1:]
    added = {"actual_frames", "skipped_packets"}
    failed = {"error": F.min("error").alias("error"), "error_kind": F.min("error_kind").alias("error_kind")}
    out = rows.where("win IS NULL").groupBy("path").agg(*[F.sum(c).alias(c) if c in added else failed.get(c, once(c)) for c in names])
    short = F.col("error").isNull() & (F.col("actual_frames") < 2)
    out = out.withColumn("error_kind", F.when(short, "InvalidInput").otherwise(F.col("error_kind"))).withColumn("error", F.when(short, "fewer than two frames").otherwise(F.col("error")))
    return out.select("path", *[F.when(F.col("error").isNull(), F.col(c)).alias(c) if c not in failed else F.col(c) for c in names])


def _windows(rows: DataFrame) -> DataFrame:
    return rows.where("win IS NOT NULL").groupBy("path", "channel", "win").agg(F.sum("n").alias("n"), F.sum("sum_sq").alias("sum_sq"), F.max("peak").alias("peak"))


def _files(spark: SparkSession, directory: str, recursive: bool, decoders: dict[str, Decoder], without: tuple[str, ...] = ()) -> DataFrame:
    """path, length, content of the files with an extension that counts; Spark leaves empty ones out."""
    wanted = [e for e in dict.fromkeys([*EXTENSIONS, *decoders]) if e not in without]
    files = spark.read.format("binaryFile").option("pathGlobFilter", extensions_glob(wanted)).option("recursiveFileLookup", str(recursive).lower()).load(directory)
    return files.where(describe.extension(F.col("path")).isin([e.upper() for e in wanted]))


def contents(spark: SparkSession, directory: str, recursive: bool = False, decoders: dict[str, Decoder] | None = None, without: tuple[str, ...] = ()) -> DataFrame:
    """path, content of the audio files of a directory."""
    return _files(spark, directory, recursive, known_decoders(decoders), without).where(F.col("length") <= LONGEST).select("path", "content")


def listed(spark: SparkSession, directory: str, recursive: bool) -> Iterator[tuple[str, int]]:
    """Path and length of every file of a directory: one call where pyarrow knows the store, else a walk by Hadoop that asks for
    no places of blocks, which on some stores costs a process a file."""
    from pyarrow import fs

    from crestline.sources import ranges

    if ranges.readable(directory):
        system, base, before = ranges.system_of(directory)
        yield from ((before + x.path, x.size) for x in system.get_file_info(fs.FileSelector(base, recursive=recursive)) if x.type == fs.FileType.File)
        return
    top = spark._jvm.org.apache.hadoop.fs.Path(directory)
    system, folders = top.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), [top]
    while folders:
        found = system.listStatusIterator(folders.pop())
        while found.hasNext():
            status = found.next()
            if not status.isDirectory():
                yield status.getPath().toString(), status.getLen()
            elif recursive:
                folders.append(status.getPath())


def failed_files(spark: SparkSession, directory: str, recursive: bool, decoders: dict[str, Decoder], without: tuple[str, ...] = ()) -> DataFrame:
    """META rows for audio files that Spark's file source cannot hand over: those without a byte and those too long."""
    wanted, rows = {e for e in (*EXTENSIONS, *decoders) if e not in without}, []
    for path, length in listed(spark, directory, recursive):
        if path.rsplit("/", 1)[-1].rpartition(".")[2].lower() in wanted and (length == 0 or length > LONGEST):
            told = {"error": "empty file", "error_kind": "FormatError"} if not length else {"error": "too long for a format that cannot be cut", "error_kind": "ResourceError"}
            rows.append(dict.fromkeys(_META_TYPES.names) | {"path": path} | told)
    return spark.createDataFrame(rows, META)


def probe_files(files: DataFrame, decoders: dict[str, Decoder] | None = None) -> DataFrame:
    """Format or error of each file of (path, content)."""
    return _whole(files.mapInArrow(_read_files(known_decoders(decoders), windows=False), BOTH))


def window_files(files: DataFrame, decoders: dict[str, Decoder] | None = None) -> DataFrame:
    """Raw windows of each readable file; levels are computed where the bytes are, samples never leave their task."""
    rows = files.mapInArrow(_read_files(known_decoders(decoders)), BOTH)
    return _windows(rows)


def sample_files(files: DataFrame, decoders: dict[str, Decoder] | None = None) -> DataFrame:
    """track_id, channel, frame_idx, sample of each readable file, for operators that need the samples themselves."""
    known = known_decoders(decoders)

    def samples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                try:
                    _, blocks = _opened(path, data, known)
                    start = 0
                    for block in blocks:
                        n, c = block.shape
                        columns = [pa.array([path] * (n * c)), pa.array(np.tile(np.arange(c, dtype=np.int32), n)), pa.array(np.repeat(np.arange(start, start + n), c)), pa.array(block.reshape(-1).astype(np.float32))]
                        yield pa.RecordBatch.from_arrays(columns, ["track_id", "channel", "frame_idx", "sample"])
                        start += n
                except Exception:  # noqa: S112  told by probe_files
                    continue

    return files.mapInArrow(samples, "track_id string, channel int, frame_idx bigint, sample float")


def _one_path(path: Column) -> Column:
    return F.regexp_replace(path, "^file:/+", "file:/")


def analyse(
    spark: SparkSession, directory: str, recursive: bool = False, silence_db: float | None = None, decoders: dict[str, Decoder] | None = None, share: int | None = None, plan: dsd.Plan | None = None
) -> tuple[DataFrame, DataFrame]:
    """(files, channels): format or error of every audio file, and level, peak and range of every channel of those readable.

    Formats that can be cut are read by ranges of `share` bytes, where pyarrow knows the store; the rest are one task a file.
    Each file is decoded once: windows (a row per channel and three seconds) and formats are written to the shared folder.
    `plan` is that of one-bit files. What a
    decoder gave before it failed does not count. is_partial: packets failed, or fewer frames than the file promises.
    """
    from crestline.operators import channels
    from crestline.sources import ranges

    one_bit = {e: dsd.decoder(plan) for e in ("dsf", "dff")} if plan else {}
    known = known_decoders(one_bit | (decoders or {}))
    cut = tuple(e for e in ranges.CUT if e not in (decoders or {})) if ranges.readable(directory) else ()
    rows = contents(spark, directory, recursive, decoders, cut).mapInArrow(_read_files(known), BOTH)
    if cut:
        ranges.register(spark)
        reader = spark.read.format("audio_windows").option("recursive", str(recursive).lower()).option("extensions", ",".join(cut))
        if plan:
            reader = reader.option("dsd_rate", str(plan.rate)).option("dsd_filter", plan.mode).option("dsd_gain_db", str(plan.gain_db))
        rows = rows.unionByName(reader.option("share", str(share or ranges.SHARE_BYTES)).load(directory))
    both = written(rows.withColumn("path", _one_path(F.col("path"))), "audio")
    failed = failed_files(spark, directory, recursive, known, cut).withColumn("path", _one_path(F.col("path")))
    meta = _whole(both).unionByName(failed)
    partial = (F.col("skipped_packets") > 0) | (F.col("actual_frames") < F.col("sample_count"))
    meta = meta.withColumn("is_partial", F.when(F.col("error").isNull(), F.coalesce(partial, F.lit(False))))
    good = meta.where("error IS NULL")
    raw = _windows(both).join(good.select("path", "sample_rate", "channels"), "path").withColumnRenamed("path", "track_id")
    raw = raw.withColumn("rms", F.sqrt(2 * F.col("sum_sq") / F.col("n")))
    full = F.floor(F.col("sample_rate") * F.lit(WINDOW_SECONDS))
    counts = complete(full, F.col("channels") <= 2)
    if silence_db is not None:
        counts = counts & ~below(silence_db)
    return meta, channels.from_windows(raw, counts)
