"""Removal of every byte that lies in a string of THRESHOLD bytes which also starts elsewhere.

Distributed prefix doubling over the positions that have a chance. A window is a string of THRESHOLD bytes.

Sieve. Of the strings of a quarter of that length in a window one is its anchor: the one with the smallest fingerprint,
the leftmost of equals, so equal windows have equal anchors at equal offsets, and about one position in 150 is an anchor.
Anchors whose fingerprint occurs once in the corpus drop out, and with them every window that chose them.

Doubling. The windows of one anchor, and the bytes below them, are a stretch; equal stretches are one row with their
number, so a passage that a third of all documents share is a few rows. From each anchor a grid of quarters reaches back
over its stretch; every window holds three whole quarters of the grid. Spark sorts the pairs of ranks at a position and
one quarter further on, drops those that are unique and numbers the others in their order, which ranks half the length;
then the pairs of that rank and the rank two quarters on, which ranks three quarters.

The rest. Positions of equal rank meet with the bytes around them, in sorted order. Ranks are confirmed on those bytes
and extended byte by byte to both sides, pair by pair (old rank, next byte), up to the threshold: what is left there of a
window is decided by its bytes, never by a fingerprint. A rank with more than CROWD different surroundings is dealt by
the windows themselves instead, which Spark groups by their digest, so no task holds more than a CROWD of one rank.

Equal texts are one class: of two or more copies with THRESHOLD bytes everything goes; one copy stands for all in the
search. Texts are read three times and, from the second time on, only those that still matter are shuffled, told apart
by a bit map of fixed size while scanning (when it saturates more are shuffled; none is missed).

Defined results: null texts are empty; matches never cross documents; repeated rows and ids count each for itself; a
null doc_id is kept as it is; extra columns are ignored; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crestline.llm.common import RollingHash, arrow_rows, cut, drop, runs, shuffle_partitions, text_bytes

THRESHOLD = 400
#: Bytes of a text that are handled at once, and bytes of stretches that a task settles among themselves.
PIECE, FLUSH = 1 << 20, 8 << 20
#: Rows that Python gets at once.
BATCH = 1000
MAP_BITS = 1 << 25
#: Different surroundings of one rank that meet in one task; rows of several ranks that are compared in one go.
CROWD, TOGETHER = 2048, 16_384
#: Rows of a partition when ranks are dealt out.
DEALT = 50_000
#: Low bits of a fingerprint that make room for a position when anchors are chosen.
_PLACE = np.uint64((1 << 21) - 1)


@lru_cache(maxsize=1)
def _rolling() -> RollingHash:
    return RollingHash(21)


def _class(sha: Column) -> Column:
    return F.unhex(F.substring(sha, 1, 32))


def class_of(data: bytes) -> bytes:
    return hashlib.sha256(data).digest()[:16]


def _pieces(data: bytes, threshold: int, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """Pieces that together hold every window once, and where they begin."""
    for at in range(0, len(data) - threshold + 1, size):
        yield at, np.frombuffer(data, np.uint8)[at : at + size + threshold - 1]


def anchors(piece: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all strings of a quarter of the threshold, and the anchor of each window."""
    names = _rolling().every(_rolling().sums(piece), threshold // 4)
    least, reach, width = names & ~_PLACE | np.arange(len(names), dtype=np.uint64), 1, threshold - threshold // 4 + 1
    while 2 * reach <= width:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if reach < width:
        least = np.minimum(least[: len(least) - (width - reach)], least[width - reach :])
    return names, (least & _PLACE).astype(np.int64)


ANCHORS = "rank long, class binary, twice boolean"


def _choose(threshold: int, size: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The fingerprints that a text's anchors have, each once, and whether two of its anchors have it."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen, ranks, classes, twice = set(), [], [], []
            for text in batch.column("text").to_pylist():
                data = (text or "").encode("utf-8", "surrogatepass")
                if len(data) < threshold or (own := class_of(data)) in seen:
                    continue
                seen.add(own)
                found = {}  # pieces overlap, so an anchor may be met twice
                for at, piece in _pieces(data, threshold, size):
                    names, place = anchors(piece, threshold)
                    place = place[np.concatenate(([True], place[1:] != place[:-1]))]
                    found |= dict(zip((at + place).tolist(), names[place].tolist(), strict=True))
                rank, times = np.unique(np.fromiter(found.values(), np.uint64, len(found)), return_counts=True)
                ranks.append(rank.view(np.int64))
                classes += [own] * len(rank)
                twice.append(times > 1)
            if ranks:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ranks)), pa.array(classes, pa.binary()), pa.array(np.concatenate(twice))], ["rank", "class", "twice"])

    return choose


STRETCHES = "class binary, start long, digest binary, body binary, anchor int, n1 array<long>, n2 array<long>, n3 array<long>, times long"
_STRETCH_TYPES = [pa.binary(), pa.int64(), pa.binary(), pa.binary(), pa.int32(), *[pa.list_(pa.int64())] * 3, pa.int64()]


def _grid(anchor: int, windows: int, short: int) -> Iterator[tuple[int, int, int]]:
    """Grid positions of a stretch with the first and the last of its windows that belong to each: the position is the
    first of the grid at or after the window's start."""
    for back in range((anchor - windows + 1) // short, anchor // short + 1):
        at = anchor - back * short
        yield at, max(0, at - short + 1), min(at, windows - 1)


def _stretches(threshold: int, size: int, flush: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows with a class say where a stretch stands; rows with a body say what it is, once per flush, and how often."""
    short = threshold // 4
    names = [c.split()[0] for c in STRETCHES.split(", ")]

    def stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: list[tuple] = []
        bodies: dict[bytes, list] = {}
        held = 0

        def settled() -> pa.RecordBatch:
            rows = places + [(None, None, digest, *rest) for digest, rest in bodies.items()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _STRETCH_TYPES, strict=True)], names)

        for batch in batches:
            for text, own, ranks in zip(batch.column("text").to_pylist(), batch.column("class").to_pylist(), batch.column("ranks").to_pylist(), strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                repeated = np.array(ranks, np.int64).view(np.uint64)
                for at, piece in _pieces(data, threshold, size):
                    found, place = anchors(piece, threshold)
                    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
                    count = np.diff(np.append(first, len(place)))
                    left = np.flatnonzero(np.isin(found[place[first]], repeated))
                    signed = found.view(np.int64)
                    for s, n, a in zip(first[left].tolist(), count[left].tolist(), place[first[left]].tolist(), strict=True):
                        body = data[at + s : at + s + n - 1 + threshold]
                        digest = hashlib.sha256(body).digest()[:16]
                        places.append((own, at + s, digest, None, None, None, None, None, None))
                        if digest in bodies:
                            bodies[digest][-1] += 1
                            held += 40
                        else:
                            grid = np.array([s + g for g, _, _ in _grid(a - s, n, short)])
                            bodies[digest] = [body, a - s, *(signed[grid + k * short].tolist() for k in range(3)), 1]
                            held += len(body) + 200
                    if held >= flush:
                        yield settled()
                        places, bodies, held = [], {}, 0
        if places:
            yield settled()

    return stretches


def _reranked(rows: DataFrame, pair: tuple[str, str], rank: str) -> DataFrame:
    """Rows whose pair of ranks is not unique, with the place of the pair among all such pairs, in sorted order."""
    counted = rows.groupBy(*pair).agg(F.sum("times").alias("every")).where("every > 1")
    ranked = cut(counted.orderBy(*pair).select(*pair, F.monotonically_increasing_id().alias(rank)), f"repeats-{rank}")
    kept = cut(rows.join(ranked, list(pair)), f"repeats-by-{rank}")
    drop(ranked)
    return kept


def _matrix(parts: list[bytes], width: int) -> np.ndarray:
    """Bytes of each part as a row, 0 beyond its end; column by column in memory."""
    flat = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), np.uint8)
    return np.ascontiguousarray(flat.reshape(len(parts), width).T).astype(np.int64)


def _ids(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1]


FOUND = "digest binary, first int, count int"


def _compared(rows: list[tuple], threshold: int) -> pa.RecordBatch:
    """Of rows (digest, body, at, low, high, times) the windows that are there twice, as runs. `at` is the place of three
    quarters of a window in the body, low and high are the first and last window."""
    short = threshold // 4
    core = threshold - 3 * short
    known: dict[bytes, int] = {}
    at, low, high, times = (np.array([r[k] for r in rows], np.int64) for k in (2, 3, 4, 5))
    same = np.array([known.setdefault(r[1][r[2] : r[2] + 3 * short], len(known)) for r in rows])
    ahead = _matrix([r[1][r[2] + 3 * short : r[4] + threshold] for r in rows], core)
    back = _matrix([r[1][r[3] : r[2]][::-1] for r in rows], short)
    # ranks[k]: three quarters and k bytes after them; then those before them join one by one
    ranks = [same]
    for byte in ahead:
        ranks.append(_ids(ranks[-1] << 8 | byte))
    repeats = np.zeros((len(rows), short), bool)
    left = same
    for r in range(short):
        own = np.flatnonzero((at - r >= low) & (at - r <= high))
        if len(own):
            group = _ids(left[own] * len(rows) + ranks[core - r][own])
            repeats[own, r] = (np.bincount(group, times[own]) > 1)[group]
        left = _ids(left << 8 | back[r])
    out = []
    for row, flags in zip(rows, repeats[:, ::-1], strict=True):  # by rising place of the window
        for a, b in zip(*runs(flags), strict=True):
            out.append((row[0], row[2] - short + 1 + int(a), int(b - a)))
    columns = zip(*out, strict=True) if out else ([], [], [])
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.int32(), pa.int32()), strict=True)], ["digest", "first", "count"])


def _compare(threshold: int, together: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows come in order of their rank; whole ranks are compared, several in one go."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last, whole = None, 0
        for batch in batches:
            for rank, *row in zip(*(batch.column(c).to_pylist() for c in ("rank", "digest", "body", "at", "low", "high", "times")), strict=True):
                if rank != last:
                    last, whole = rank, len(held)
                    if whole >= together:
                        yield _compared(held, threshold)
                        held, whole = [], 0
                held.append(tuple(row))
        if held:
            yield _compared(held, threshold)

    return compare


def _crowded(rows: DataFrame, threshold: int) -> DataFrame:
    """The same for ranks of very many surroundings: every window is a row, dealt by its digest."""
    each = rows.select("digest", "times", F.explode(F.sequence("low", "high")).alias("first"), "body")
    each = each.select("digest", "times", "first", F.sha2(F.expr(f"substring(body, first + 1, {threshold})"), 256).alias("window"))
    counted = each.groupBy("window").agg(F.sum("times").alias("every")).where("every > 1").select("window")
    return each.join(counted, "window", "left_semi").select("digest", "first", F.lit(1).alias("count"))


def _repeated_windows(bodies: DataFrame, threshold: int) -> DataFrame:
    """digest, first, count: runs of windows, by the stretch that they lie in, which occur twice or more."""
    short = threshold // 4
    grid = bodies.select("digest", "times", (F.octet_length("body") - threshold + 1).alias("windows"), "anchor", F.posexplode(F.arrays_zip("n1", "n2", "n3")).alias("pos", "names"))
    # the grid's first position is the one nearest to the last window
    at = F.col("anchor") - (F.floor((F.col("anchor") - F.col("windows") + 1) / short) + F.col("pos")) * short
    grid = grid.select("digest", "times", "windows", at.cast("int").alias("at"), "names.n1", "names.n2", "names.n3")
    halves = _reranked(grid, ("n1", "n2"), "rank2")
    kept = _reranked(halves.select("digest", "times", "windows", "at", "rank2", "n3"), ("rank2", "n3"), "rank3")
    drop(halves)
    low, high = F.greatest(F.lit(0), F.col("at") - short + 1), F.least(F.col("at"), F.col("windows") - 1)
    slim = kept.select("digest", "times", "at", low.alias("low"), high.cast("int").alias("high"), F.col("rank3").alias("rank"))
    sizes = slim.groupBy("rank").agg(F.count("*").alias("n"))
    crowds = cut(sizes.where(F.col("n") > CROWD).select("rank"), "repeats-crowds")
    total, crowded = kept.count(), not crowds.isEmpty()
    full = slim.join(bodies.select("digest", "body"), "digest")
    parts = max(shuffle_partitions(bodies.sparkSession), -(-total // DEALT))
    calm = full.join(crowds, "rank", "left_anti") if crowded else full
    calm = calm.select("rank", "digest", "body", "at", "low", "high", "times").repartition(parts, "rank").sortWithinPartitions("rank")
    found = calm.mapInArrow(_compare(threshold, TOGETHER), FOUND)
    if crowded:
        found = found.unionByName(_crowded(full.join(crowds, "rank", "left_semi"), threshold))
    found = cut(found, "repeats-windows")
    drop(kept, crowds)
    return found


def covered(n: int, starts: np.ndarray, counts: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal stretches of bytes under windows that start in [start, start + count)."""
    change = np.zeros(n + 1, np.int64)
    np.add.at(change, starts, 1)
    np.add.at(change, starts + counts - 1 + threshold, -1)
    return runs(np.cumsum(change[:-1]) > 0)


def _remover(threshold: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for sha, text, starts, counts in zip(*(batch.column(c).to_pylist() for c in ("sha", "text", "starts", "counts")), strict=True):
                data = (text or "").encode("utf-8", "surrogatepass")
                a, b = covered(len(data), np.array(starts, np.int64), np.array(counts, np.int64), threshold)
                edges = [0, *np.column_stack([a, b]).reshape(-1).tolist(), len(data)]
                kept = b"".join(data[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True))
                out.append((sha, len(data) - len(kept), len(a), hashlib.sha256(kept).hexdigest()))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["sha", "n_removed", "n_spans", "kept_sha256"])

    return remove


def _bit_map(classes: DataFrame) -> np.ndarray:
    """Bits of the classes; at most MAP_BITS / 64 rows reach the driver, whatever the input's size."""
    bit = F.pmod(F.conv(F.substring("sha", 1, 8), 16, 10).cast("long"), F.lit(MAP_BITS))
    words = classes.select(F.floor(bit / 64).cast("int").alias("w"), F.pmod(bit, F.lit(64)).cast("int").alias("b"))
    words = words.groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("bits"))
    out = np.zeros(MAP_BITS // 64, np.int64)
    for row in words.toLocalIterator():
        out[row["w"]] = row["bits"]
    return out


def _sieve(bits: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def sieve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for sha in batch.column("sha").to_pylist():
                bit = int(sha[:8], 16) % MAP_BITS
                keep.append(bool((int(bits[bit // 64]) >> (bit % 64)) & 1))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return sieve


def _with_text(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """wanted (sha, rep, class, ...) with the text of one row of each class."""
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = texts.select("doc_id", F.sha2("text", 256).alias("sha"), "text")
    texts = texts.mapInArrow(_sieve(_bit_map(wanted)), texts.schema)
    ask = wanted.withColumnRenamed("sha", "__sha")
    return texts.join(ask, (F.col("sha") == F.col("__sha")) & F.col("doc_id").eqNullSafe(F.col("rep"))).drop("__sha")


def remove_repeats(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row."""
    with arrow_rows(docs.sparkSession, BATCH):
        return _remove_repeats(docs, threshold)


def _remove_repeats(docs: DataFrame, threshold: int) -> DataFrame:
    docs = docs.select("doc_id", "text")
    info = docs.select("doc_id", text_bytes().alias("n_bytes"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    info = cut(info, "repeats-info")
    classes = info.groupBy("sha").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n"), F.first("n_bytes").alias("n_bytes"))
    classes = cut(classes.withColumn("class", _class(F.col("sha"))), "repeats-classes")

    chosen = cut(docs.select("text").mapInArrow(_choose(threshold, PIECE), ANCHORS), "repeats-anchors")
    ranks = chosen.groupBy("rank").agg(F.min(F.xxhash64("class")).alias("a"), F.max(F.xxhash64("class")).alias("b"), F.max("twice").alias("twice"))
    repeated = cut(ranks.where("a < b OR twice").select("rank"), "repeats-ranks")
    of_class = chosen.join(repeated, "rank").groupBy("class").agg(F.collect_set("rank").alias("ranks"))
    left = cut(classes.where(F.col("n_bytes") >= threshold).join(of_class, "class").select("sha", "rep", "class", "n", "ranks"), "repeats-left")
    drop(chosen, repeated)

    stretches = cut(_with_text(docs, left).select("class", "ranks", "text").mapInArrow(_stretches(threshold, PIECE, FLUSH), STRETCHES), "repeats-stretches")
    bodies = stretches.where("class IS NULL").groupBy("digest", "body", "anchor", "n1", "n2", "n3").agg(F.sum("times").alias("times"))
    bodies = cut(bodies, "repeats-bodies")
    found = _repeated_windows(bodies, threshold)
    placed = stretches.where("class IS NOT NULL").select("class", "start", "digest").join(found, "digest")
    # all of a class of copies goes, so its text isn't needed again
    alone = left.where("n = 1").select("sha", "rep", "class")
    runs_of = placed.groupBy("class").agg(F.collect_list(F.col("start") + F.col("first")).alias("starts"), F.collect_list(F.col("count").cast("long")).alias("counts"))
    hit = cut(alone.join(runs_of, "class"), "repeats-found")
    drop(stretches, bodies, found, left)

    cleaned = _with_text(docs, hit).select("sha", "text", "starts", "counts")
    cleaned = cut(cleaned.mapInArrow(_remover(threshold), "sha string, n_removed long, n_spans long, kept_sha256 string"), "repeats-cleaned")
    drop(hit)
    whole = (F.col("n") > 1) & (F.col("n_bytes") >= threshold)
    result = classes.join(cleaned, "sha", "left").select(
        "sha",
        F.when(whole, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.when(whole, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(whole, F.sha2(F.lit(""), 256)).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )
    # a written table on both sides, so that the planner can split the rows of a text that very many documents share
    result = cut(result, "repeats-result")
    drop(classes, cleaned)
    return info.join(result, "sha").select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
