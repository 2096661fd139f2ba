"""Vectors as short codes: one byte a part, from integer codebooks trained on all rows, with VA-file filtering.

Components become integers, vectors are cut into PARTS parts, and each part position has a codebook of ENTRIES entries. To
find the entry nearest to a part, the coordinates of the entries are quantised to BITS bits: a cell per coordinate, with
the least and largest value in it. For each part looked up, two small tables give the least and the largest squared
distance from its coordinate to any value of a cell; sums over coordinates bound the distance to every entry from both
sides without looking at it. Entries whose lower bound exceeds the least upper bound are out; the distance to the
others is taken exactly, in integers, so codes do not depend on how rows are dealt.

Each training round is one pass: tasks assign their rows and add them up by (part, entry, coordinate), Spark adds the
tasks' sums, and the driver gets ENTRIES x dimensions of them, whatever the number of rows. Codebooks of that size go to
the tasks; nothing else does.

Defined results: rows whose vector is null, or holds null or non-finite components, are dropped, as are vectors of another
length than the commonest (ties: the longest); a length that PARTS does not divide is filled up with zeros; integers
beyond 2**27 either way are held there, so that sums of squares fit 64 bits; null ids sort last among the first entries,
equal ids by the bytes of their integers; repeated rows are rows of their own; an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crestline.llm.common import cut

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Bits of a cell number, and parts looked up at once.
BITS, LOOKUPS = 3, 4096
#: Integers are held within this distance of 0.
LIMIT = 1 << 27


class Cells:
    """One part position's codebook as a VA file: cell numbers of the entries, least and largest value of each cell."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        count, width = entries.shape
        low, high = entries.min(axis=0), entries.max(axis=0)
        self.cell = (entries - low) * (1 << BITS) // (high - low + 1)
        self.least = np.full((width, 1 << BITS), 2 * LIMIT, np.int64)
        self.largest = np.full((width, 1 << BITS), -2 * LIMIT, np.int64)
        axis = np.tile(np.arange(width), (count, 1))
        np.minimum.at(self.least, (axis, self.cell), entries)
        np.maximum.at(self.largest, (axis, self.cell), entries)
        self.used = self.largest >= self.least

    def bounds(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(parts, entries): least and largest possible squared distance, summed from the lookup tables."""
        x = parts[:, :, None]
        least, largest = np.where(self.used, self.least, 0), np.where(self.used, self.largest, 0)
        near = np.maximum(np.maximum(least - x, x - largest), 0) ** 2
        far = np.maximum(np.abs(x - least), np.abs(largest - x)) ** 2
        lower = upper = np.zeros((len(parts), len(self.entries)), np.int64)
        for k in range(parts.shape[1]):
            lower = lower + near[:, k, self.cell[:, k]]
            upper = upper + far[:, k, self.cell[:, k]]
        return lower, upper

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry (ties: the lowest) and its squared distance."""
        lower, upper = self.bounds(parts)
        row, entry = np.nonzero(lower <= upper.min(axis=1, keepdims=True))  # by row, then by entry; one a row at least
        distance = ((parts[row] - self.entries[entry]) ** 2).sum(axis=1)
        starts = np.flatnonzero(np.diff(row, prepend=-1))
        best = np.minimum.reduceat(distance, starts)
        hit = np.flatnonzero(distance == best[row])
        return entry[hit[np.flatnonzero(np.diff(row[hit], prepend=-1))]], best


def finite(vector: str = "embedding") -> Column:
    v = F.col(vector)
    return v.isNotNull() & F.coalesce(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))), F.lit(False))


def _width(dims: int) -> int:
    return max(1, -(-dims // PARTS))


def integers(table: DataFrame, dims: int) -> DataFrame:
    """vec_id, label, ints: components as little-endian 32-bit integers, parts of equal length."""
    room, types = PARTS * _width(dims), {f.name: f.dataType.simpleString() for f in table.schema}

    def scaled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                values = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dims)
                whole = np.zeros((batch.num_rows, room), "<i4")
                with np.errstate(over="ignore"):
                    whole[:, :dims] = np.floor(SCALE * values).clip(-LIMIT, LIMIT)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([row.tobytes() for row in whole], pa.binary())], ["vec_id", "label", "ints"])

    given = table.where(finite() & (F.size("embedding") == dims)).select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vector"))
    return given.mapInArrow(scaled, f"vec_id {types['vec_id']}, label {types['label']}, ints binary")


def _blocks(batch: pa.RecordBatch, width: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, parts of some rows as (rows, PARTS, width) integers)."""
    blobs = batch.column("ints").to_pylist()
    for at in range(0, len(blobs), LOOKUPS):
        some = blobs[at : at + LOOKUPS]
        yield at, np.frombuffer(b"".join(some), "<i4").astype(np.int64).reshape(len(some), PARTS, width)


def _summed(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """part, entry, place, n, total: rows assigned to each entry and the sums of their coordinates, added up in each task
    before they are shuffled."""
    width = books.shape[2]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(book) for book in books]
        totals, counts = np.zeros(books.shape, np.int64), np.zeros(books.shape[:2], np.int64)
        for batch in batches:
            for _, parts in _blocks(batch, width):
                for k in range(PARTS):
                    entry, _ = cells[k].nearest(parts[:, k])
                    np.add.at(totals[k], entry, parts[:, k])
                    counts[k] += np.bincount(entry, minlength=books.shape[1])
        part, entry, place = np.nonzero(np.broadcast_to(counts[:, :, None] > 0, totals.shape))
        columns = [part.astype(np.int32), entry.astype(np.int32), place.astype(np.int32), counts[part, entry], totals[part, entry, place]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["part", "entry", "place", "n", "total"])

    sums = rows.select("ints").mapInArrow(add, "part int, entry int, place int, n bigint, total bigint")
    return sums.groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def train(rows: DataFrame, width: int, entries: int = ENTRIES, rounds: int = ROUNDS) -> np.ndarray:
    """(PARTS, entries, width) codebooks, from the rows of the smallest ids on, or fewer entries where there are fewer."""
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "ints").select("ints").limit(entries).collect()
    books = np.stack([np.frombuffer(r["ints"], "<i4") for r in first]).astype(np.int64).reshape(-1, PARTS, width).transpose(1, 0, 2).copy()
    for _ in range(rounds):
        for r in _summed(rows, books).collect():  # ENTRIES x dimensions rows at most
            books[r["part"], r["entry"], r["place"]] = r["total"] // r["n"]
    return books


def encoded(rows: DataFrame, books: np.ndarray) -> DataFrame:
    """vec_id, label, code, error."""
    width, types = books.shape[2], {f.name: f.dataType.simpleString() for f in rows.schema}

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = [Cells(book) for book in books]
        for batch in batches:
            codes, errors = np.zeros((batch.num_rows, PARTS), np.uint8), np.zeros(batch.num_rows, np.int64)
            for at, parts in _blocks(batch, width):
                for k in range(PARTS):
                    entry, distance = cells[k].nearest(parts[:, k])
                    codes[at : at + len(parts), k] = entry
                    errors[at : at + len(parts)] += distance
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(errors)], ["vec_id", "label", "code", "error"])

    return rows.mapInArrow(code, f"vec_id {types['vec_id']}, label {types['label']}, code string, error bigint")


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def decoded(codes: DataFrame, books: np.ndarray, code: str = "code") -> DataFrame:
    """Adds `vector`: the entries that a code names, as numbers again; each is within half a step of its cell's middle."""
    table = F.array(*[F.array(*[F.array(*[F.lit((int(x) + 0.5) / SCALE) for x in entry]) for entry in book]) for book in books])
    byte = lambda k: F.conv(F.substring(code, 2 * k + 1, 2), 16, 10).cast("int")
    return codes.withColumn("vector", F.concat(*[F.get(F.get(table, F.lit(k)), byte(k)) for k in range(PARTS)]))


def compress(table: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 for every vector that can be coded."""
    result = f"vec_id {table.schema['vec_id'].dataType.simpleString()}, code string, error bigint, label_error bigint, codebooks_sha256 string"
    shape = table.where(finite()).groupBy(F.size("embedding").alias("dims")).count()
    top = shape.orderBy(F.desc("count"), F.desc("dims")).first()
    if top is None:
        return table.sparkSession.createDataFrame([], result)
    rows = cut(integers(table, top["dims"]), "code-ints")
    books = train(rows, _width(top["dims"]))
    codes = cut(encoded(rows, books), "codes")
    sums = codes.groupBy(F.col("label").alias("of")).agg(F.sum("error").alias("label_error"))
    out = codes.join(sums, F.col("label").eqNullSafe(F.col("of")))
    return out.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
