"""Directory scans and the decoders that files go to.

A decoder turns one file's bytes into its format and blocks of samples. Several formats are built in; other codecs need a
decoder of the user's (a library or an external program), else their files get an error row and the batch goes on. What is
registered lives on the driver: known_decoders() takes the mapping that tasks carry to the workers, so a decoder must be a
function that can be sent there (closures can). Programs are looked for where they run, on the worker.
"""

from __future__ import annotations

import contextlib
import json
import shutil
import subprocess
import threading
from collections.abc import Callable, Hashable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline.constants import EXTENSIONS, MAX_CHANNELS, STATEFUL
from crestline.functions import describe


#: Bytes of a program's output taken at once.
PIECE_BYTES = 1 << 20


class AudioError(Exception):
    """kind is one of the kinds of constants.ERRORS."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


class Routed(AudioError):
    """A container holds a codec that another decoder takes, by its extension."""

    def __init__(self, extension: str, codec: str):
        super().__init__("DecodingError", f"no decoder for {codec} in a container is given")
        self.extension = extension


@dataclass
class AudioFormat:
    sample_rate: int
    channels: int
    bits_per_sample: int
    sample_count: int
    codec: str
    lfe_indices: list[int] = field(default_factory=list)
    has_channel_layout_metadata: bool = False
    #: Packets that failed so far; known once the blocks have been read.
    skipped_packets: int = 0
    #: Rate after conversion, where it differs from that of the file.
    processed_sample_rate: int | None = None


class Packets:
    """Blocks of a file whose packets stand alone: iterated, it decodes them by itself; `together` decodes those of several
    short files side by side, since a group of a few packets takes nearly the time of a full one."""

    #: Packets decoded side by side.
    GROUP = 1024

    def __init__(self, known: AudioFormat, packets: list[bytes], count: int | None = None):
        self.known, self.packets, self.count = known, packets, len(packets) if count is None else count
        self.ready: Iterable[np.ndarray | None] | None = None

    def alike(self) -> Hashable:
        """Equal for files that can be decoded side by side."""
        raise NotImplementedError

    def samples(self) -> Iterator[np.ndarray | None]:
        """Whole numbers (channels, samples) packet by packet; None for one that failed."""
        raise NotImplementedError

    @staticmethod
    def together(some: list[Packets]) -> None:
        """Makes files `ready` that are alike and have GROUP packets at most in all."""
        raise NotImplementedError

    def __iter__(self) -> Iterator[np.ndarray]:
        scale = float(1 << (self.known.bits_per_sample - 1))
        for found in self.samples() if self.ready is None else self.ready:
            if found is None:
                self.known.skipped_packets += 1
            else:
                yield (found.T / scale).astype(np.float32)


#: (bytes, extension) -> the format and an iterator of blocks, float32 (of one-bit files float64) arrays of shape (frames, channels).
Decoder = Callable[[bytes, str], tuple[AudioFormat, Iterable[np.ndarray]]]
_DECODERS: dict[str, Decoder] = {}


def register_decoder(extension: str, decoder: Decoder) -> None:
    _DECODERS[extension.lower()] = decoder


def known_decoders(more: dict[str, Decoder] | None = None) -> dict[str, Decoder]:
    """By extension: those built in or registered here, and `more`, which come first."""
    from crestline import sources  # noqa: F401  built-in ones register themselves

    return _DECODERS | {extension.lower(): decoder for extension, decoder in (more or {}).items()}


def decoder_for(extension: str, decoders: dict[str, Decoder] | None = None) -> Decoder:
    found = (known_decoders() if decoders is None else decoders).get(extension.lower())
    if found is None:
        if extension.lower() in EXTENSIONS:
            raise AudioError("DecodingError", f"no decoder for .{extension.lower()} is registered")
        raise AudioError("FormatError", f".{extension.lower()} is not an audio format")
    return found


def decodes_alone(extension: str) -> bool:
    """Whether packets of the codec depend on each other; a file is one task here in any case."""
    return extension.lower() in STATEFUL


def probed(command: list[str], data: bytes) -> dict:
    """What a program that reads a file from its input tells as JSON of the first stream with a sample rate."""
    done = subprocess.run(command, input=data, capture_output=True, check=False)
    if done.returncode:
        raise AudioError("FormatError", done.stderr.decode(errors="replace")[-200:])
    try:
        return next(s for s in json.loads(done.stdout)["streams"] if int(s.get("sample_rate") or 0) > 0)
    except (ValueError, KeyError, StopIteration) as e:
        raise AudioError("FormatError", "the probe tells no stream with a sample rate") from e


def process_decoder(command: list[str], sample_rate: int | None = None, channels: int | None = None, probe: list[str] | None = None) -> Decoder:
    """A decoder that pipes a file through a program that writes 32-bit floats, e.g. for codecs without a library. Rate and
    channels are given, or told by a probe program. Output is taken block by block, never held whole; the length is known
    once it has ended."""
    if probe is None and (sample_rate is None or channels is None):
        raise ValueError("give sample_rate and channels, or a probe")

    def decode(data: bytes, extension: str) -> tuple[AudioFormat, Iterator[np.ndarray]]:
        for program in (command, probe or command):
            if shutil.which(program[0]) is None:
                raise AudioError("ResourceError", f"{program[0]} is not installed")
        told = probed(probe, data) if probe else {}
        width = channels or int(told.get("channels") or 0)
        if not 1 <= width <= MAX_CHANNELS:
            raise AudioError("FormatError", f"{width} channels")
        found = AudioFormat(sample_rate or int(told["sample_rate"]), width, 32, 0, str(told.get("codec_name") or extension).upper())
        return found, _piped(command, data, found)

    return decode


def _piped(command: list[str], data: bytes, found: AudioFormat) -> Iterator[np.ndarray]:
    """Blocks of a program's output; counts the frames into found. The file is fed and errors are read by threads."""
    with subprocess.Popen(command, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.PIPE) as running:
        errors: list[bytes] = []

        def feed() -> None:
            with contextlib.suppress(BrokenPipeError), running.stdin:
                running.stdin.write(data)

        threads = [threading.Thread(target=feed, daemon=True), threading.Thread(target=lambda: errors.append(running.stderr.read()), daemon=True)]
        for thread in threads:
            thread.start()
        width, rest = 4 * found.channels, b""
        try:
            while piece := running.stdout.read(PIECE_BYTES):
                rest += piece
                whole = len(rest) // width * width
                found.sample_count += whole // width
                yield np.frombuffer(rest[:whole], "<f4").reshape(-1, found.channels)
                rest = rest[whole:]
        except GeneratorExit:
            running.kill()
            raise
        for thread in threads:
            thread.join()
        if running.wait():
            raise AudioError("DecodingError", b"".join(errors).decode(errors="replace")[-200:])


def extensions_glob(extensions: Iterable[str]) -> str:
    """A pattern of file names with these extensions in any letter case."""
    any_case = lambda e: "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in e)
    return "*.{" + ",".join(map(any_case, extensions)) + "}"


def scan(spark: SparkSession, directory: str, recursive: bool = False) -> DataFrame:
    """path, file_name, length of the audio files of a directory, in order of their paths; no contents are read. Fails for
    a directory that does not exist."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", extensions_glob(EXTENSIONS)).option("recursiveFileLookup", str(recursive).lower()).load(directory)
    files = files.select("path", "length", "modificationTime").where(describe.can_decode(F.col("path")))
    return files.select("path", describe.file_name(F.col("path")).alias("file_name"), "length").orderBy("path")


def totals(files: DataFrame) -> DataFrame:
    return files.agg(F.count("*").alias("files"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
