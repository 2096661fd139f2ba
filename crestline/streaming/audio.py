"""A stream of audio files: spark.readStream.format("audio_stream").option("log", folder).load(directory).

New files are found batch by batch, and WAV files are read while they grow. Each batch is a numbered plan of ranges of bytes
that is written to `log` before Spark sees its number; the offset is that number. A batch that is run again reads the same
ranges, and a query that starts anew goes on behind the last plan, so each window comes once. A window of a WAV file belongs
to the range in which its last byte lies; the task that has the range reads what it needs of the bytes before. A file that was
not changed for `settle` seconds (10 unless said otherwise) is closed: its short last window and a row that says what it is,
or why it failed, come then. Files of other formats that can be read by ranges are taken when they close, FLAC by one task a
file. Bytes that are added to a closed file are not read.

Rows are those of `audio_windows`. The plans of a directory, and every 64 plans a list of the files seen, are all that the
driver keeps; it lists files and opens none of them. `follow` turns the stream into results of files as they close.
"""

from __future__ import annotations

import json
import struct
import time
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming import StreamingQuery

from crestline.operators import channels
from crestline.operators.windows import WINDOW_SECONDS, complete, window_frames
from crestline.sources import dsd, files, ranges, wav
from crestline.sources.registry import AudioError, AudioFormat

#: Seconds without a change after which a file is closed, and plans between two lists of the files seen.
SETTLE, KEEP = 10.0, 64

@dataclass
class Share:
    """Bytes first to last of a file that had `size` bytes; the last share of a closed file is `closing`."""

    path: str
    size: int
    first: int
    last: int
    closing: bool


@dataclass
class Shares(InputPartition):
    parts: list[Share]


class AudioStreamReader(DataSourceStreamReader):
    def __init__(self, path: str, log: str, recursive: bool, settle: float, share: int, plan: dsd.Plan):
        self.path, self.log, self.recursive, self.settle, self.share, self.plan = path, log, recursive, settle, share, plan
        self.seen: dict[str, list] | None = None
        self.number = 0

    # ---- plans, on the driver ----

    def _log(self) -> tuple[fs.FileSystem, str]:
        system, base, _ = ranges.system_of(self.log)
        return system, base.rstrip("/")

    def _get(self, name: str) -> object:
        system, base = self._log()
        with system.open_input_stream(f"{base}/{name}") as file:
            return json.loads(file.read())

    def _put(self, name: str, value: object) -> None:
        system, base = self._log()
        with system.open_output_stream(f"{base}/.{name}") as out:
            out.write(json.dumps(value).encode())
        system.move(f"{base}/.{name}", f"{base}/{name}")

    def _recover(self) -> None:
        """The number of the last plan, and of each file how far it was read and whether it is closed."""
        system, base = self._log()
        system.create_dir(base, recursive=True)
        names = [x.base_name for x in system.get_file_info(fs.FileSelector(base))]
        numbers = lambda kind: sorted(int(n.removeprefix(kind)) for n in names if n.startswith(kind))
        plans, lists = numbers("plan-"), numbers("seen-")
        start = lists[-1] if lists else 0
        self.seen = self._get(f"seen-{start}") if start else {}
        for n in plans:
            if n > start:
                self._note(self._get(f"plan-{n}"))
        self.number = max([start, *plans])

    def _note(self, plan: list[list]) -> None:
        for path, size, _, closing in plan:
            self.seen[path] = [size, closing]

    def initialOffset(self) -> dict:  # noqa: N802
        return {"plan": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        if self.seen is None:
            self._recover()
        system, base, _ = ranges.system_of(self.path)
        plan, now = [], time.time()
        for info in sorted(system.get_file_info(fs.FileSelector(base, recursive=self.recursive)), key=lambda x: x.path):
            extension = info.extension.lower()
            if info.type != fs.FileType.File or extension not in ranges.CUT:
                continue
            read, closed = self.seen.get(info.path, (0, False))
            closing = now - info.mtime.timestamp() >= self.settle
            if not closed and (closing or (extension == "wav" and info.size > read)):
                plan.append([info.path, info.size, read, closing])
        if plan:
            self._put(f"plan-{self.number + 1}", plan)
            self.number += 1
            self._note(plan)
            if self.number % KEEP == 0:
                self._put(f"seen-{self.number}", self.seen)
        return {"plan": self.number}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        found: list[Share] = []
        for n in range(start["plan"] + 1, end["plan"] + 1):
            for path, size, first, closing in self._get(f"plan-{n}"):
                step = self.share if not path.lower().endswith(".flac") else max(size, 1)
                cuts = [*range(first, max(size, first + 1), step), size]
                found += [Share(path, size, a, b, closing and k == len(cuts) - 2) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
        return [Shares(parts) for parts in ranges.dealt(found, self.share)]  # small shares share a task

    # ---- ranges, in tasks ----

    def read(self, partition: Shares) -> Iterator[pa.RecordBatch]:
        yield from files.joined(self._rows(partition.parts))

    def _rows(self, parts: list[Share]) -> Iterator[pa.RecordBatch]:
        system, _, before = ranges.system_of(self.path)
        growing = [part for part in parts if part.path.lower().endswith(".wav")]
        for part in growing:
            levels, known, frames, error = files.Levels(before + part.path), None, 0, None
            try:
                with system.open_input_file(part.path) as file:
                    known, frames = _grown(file, part, levels)
            except ranges.FAILURES as e:
                error = e
            yield from _told(part, levels, known, frames, error)
        closed = [part for part in parts if not part.path.lower().endswith(".wav")]
        shares = {(part.path, part.first): part for part in closed}
        for found in ranges.read_pieces([ranges.Piece(part.path, part.size, part.first, part.last) for part in closed], system, before, self.plan):
            yield from _told(shares[found.piece.path, found.piece.first], found.levels, found.known, found.frames, found.error)

    def commit(self, end: dict) -> None:
        """Nothing to let go: plans stay, so that a new query can read all from the start."""


def _told(part: Share, levels: files.Levels, known: AudioFormat | None, frames: int, error: Exception | None) -> Iterator[pa.RecordBatch]:
    """Windows of a share that did not fail; of a file's last share also what the file is."""
    if levels.found and error is None:
        yield levels.batch()
    if part.closing:
        yield files.meta_batch(levels.path, known if error is None else None, frames, error)


def _grown(file: pa.NativeFile, share: Share, levels: files.Levels) -> tuple[AudioFormat | None, int]:
    """The windows that end within the share. A header that does not tell the length, as that of a file being written, means
    all that is there. Frames: all of the file."""
    try:
        known, encoding, start = ranges.probe(file, share.size)
    except (AudioError, struct.error):
        if share.closing:
            raise
        return None, 0  # the header is still to come
    width, rate = known.channels * known.bits_per_sample // 8, known.sample_rate
    there = max(0, share.size - start) // width
    told = known.sample_count if 0 < known.sample_count * width < 0xFFFFFFFF - width else there
    frames, step = min(told, there), window_frames(rate) * width
    known.sample_count = told
    end = start + frames * width
    win = max(0, (share.first - start) // step)
    for win in range(win, -(-(end - start) // step)):
        a, b = start + win * step, min(start + (win + 1) * step, end)
        whole = b - a == step
        if whole and b > share.last:
            break
        if (whole and b > share.first) or (not whole and share.closing):
            levels.add(win, wav.to_float(file.read_at(b - a, a), encoding).reshape(-1, known.channels).T)
    return known, frames


class AudioStream(DataSource):
    @classmethod
    def name(cls) -> str:
        return "audio_stream"

    def schema(self) -> str:
        return files.BOTH

    def streamReader(self, schema: object) -> DataSourceStreamReader:  # noqa: N802
        o = self.options
        plan = dsd.Plan(int(o.get("dsd_rate", dsd.DSD_RATE)), o.get("dsd_filter", "teac"), float(o.get("dsd_gain_db", dsd.DSD_GAIN_DB)))
        return AudioStreamReader(o["path"], o["log"], o.get("recursive", "false").lower() == "true", float(o.get("settle", SETTLE)), int(o.get("share", ranges.SHARE_BYTES)), plan)


def audio_stream(spark: SparkSession, directory: str, log: str, **options: object) -> DataFrame:
    spark.dataSource.register(AudioStream)
    reader = spark.readStream.format("audio_stream").option("log", log)
    for name, value in options.items():
        reader = reader.option(name, str(value))
    return reader.load(directory)


def follow(stream: DataFrame, place: str, **trigger: object) -> StreamingQuery:
    """Writes the results of files as they close: place/files (a row per file) and place/channels (a row per channel), a folder
    a batch. Windows of files that are still open are carried from batch to batch in place/open, so a batch reads nothing but
    its own rows and those. A batch that runs again writes the same folders again: each file is reported once."""

    def take(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        own = f"{place}/rows/batch={number}"
        batch.write.mode("overwrite").parquet(own)
        rows = spark.read.schema(batch.schema).parquet(own)
        windows = rows.where("win IS NOT NULL").select("path", "channel", "win", "n", "sum_sq", "peak")
        if number:
            windows = windows.unionByName(spark.read.schema(windows.schema).parquet(f"{place}/open/batch={number - 1}"))
        closed = rows.where("win IS NULL").select(*[c for c in batch.columns if c not in windows.columns or c == "path"])
        windows.join(closed, "path", "left_anti").write.mode("overwrite").parquet(f"{place}/open/batch={number}")
        closed.write.mode("overwrite").parquet(f"{place}/files/batch={number}")
        raw = windows.join(closed.where("error IS NULL").select("path", "sample_rate", F.col("channels").alias("width")), "path").withColumnRenamed("path", "track_id")
        raw = raw.withColumn("rms", F.sqrt(2 * F.col("sum_sq") / F.col("n")))
        full = F.floor(F.col("sample_rate") * F.lit(WINDOW_SECONDS))
        channels.from_windows(raw, complete(full, F.col("width") <= 2)).write.mode("overwrite").parquet(f"{place}/channels/batch={number}")

    return stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{place}/checkpoint").trigger(**(trigger or {"availableNow": True})).start()
