"""Helpers shared by the operators: shared-folder cuts of the lineage, sizing and packed hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that one bucket of a packed shuffle stands for.
BUCKET_BYTES = 16 << 20
#: Bytes of a batch handed to Python (a single larger row is a batch of its own).
BATCH_BYTES = 16 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir). Where that is unset, a local folder serves a
    local master; a cluster, whose machines share no such folder, is an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="crestline-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: lineage ends here, and nothing above runs twice."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table._cut_path = path
    return table


def drop(*tables: DataFrame) -> None:
    """Deletes tables that cut() wrote; only for those that nothing still to be run reads."""
    for table in tables:
        spark, path = table.sparkSession, getattr(table, "_cut_path", None)
        if path:
            jvm = spark.sparkContext._jvm
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(place, True)
            table._cut_path = None


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Rows and bytes of a batch handed to Python, for what runs inside: rows that carry whole texts or sets are large."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": BATCH_BYTES}
    before = {key: spark.conf.get(key) for key in wanted}
    in_bytes = spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes  # sizes may carry a unit
    for key, most in wanted.items():
        now = in_bytes(before[key])
        spark.conf.set(key, str(min(most, now) if now > 0 else most))
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def pieces(batch: pa.RecordBatch, column: str, most: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose strings in a column have some `most` bytes together (a single larger one is a slice of its
    own), for operators that do not settle the session's batch size."""
    if not batch.num_rows:
        return
    values = batch.column(column)
    ends = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1].astype(np.int64)
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(ends, ends[at] + most, "right")) - 1)
        yield batch.slice(at, stop - at)
        at = stop


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_bytes(text: str | Column = "text") -> Column:
    """UTF-8 length of a text; null counts as empty."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long")


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers (xor-shift, multiply)."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class RollingHash:
    """Fingerprints of any substring of bytes from one prefix sum, modulo 2**64.

    The sum over j < i of code(byte j) * BASE**j is kept for every i; a difference of two such sums, scaled by
    BASE**-start, names the bytes between them wherever they stand.
    """

    BASE = 0x9E3779B97F4A7C15

    def __init__(self, seed: int = 7):
        self.codes = np.random.default_rng(seed).integers(1, 2**63, 256, dtype=np.uint64)
        self.up, self.down = np.ones(1, np.uint64), np.ones(1, np.uint64)

    def _grow(self, n: int) -> None:
        if len(self.up) <= n:
            size = max(1 << 16, 1 << int(n).bit_length())
            for name, base in (("up", self.BASE), ("down", pow(self.BASE, -1, 1 << 64))):
                powers = np.full(size, base, np.uint64)
                powers[0] = 1
                setattr(self, name, np.cumprod(powers, dtype=np.uint64))

    def sums(self, data: np.ndarray) -> np.ndarray:
        n = len(data)
        self._grow(n)
        out = np.zeros(n + 1, np.uint64)
        np.cumsum(self.codes[data] * self.up[:n], out=out[1:])
        return out

    def spans(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Names of [start, end); lengths are not part of the name."""
        return (sums[end] - sums[start]) * self.down[start]

    def every(self, sums: np.ndarray, length: int) -> np.ndarray:
        """Names of all substrings of one length, in order of their starts."""
        n = len(sums) - length
        return (sums[length:] - sums[:n]) * self.down[:n] if n > 0 else np.zeros(0, np.uint64)


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the maximal runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.astype(np.int8), [0]))))
    return edge[::2], edge[1::2]
