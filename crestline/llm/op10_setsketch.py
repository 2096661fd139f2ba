"""Near-duplicate documents by SetSketch registers.

A document is the set of its word shingles. Each of REGISTERS registers holds the smallest of an exponential variate per
shingle on a logarithmic scale (base SCALE), cut off at both ends: registers of a union are the maxima of registers, and
two sets agree in a register about as often as they share elements. Bands of BAND registers are candidates' keys; from
the counts of larger, smaller and equal registers the similarity is estimated by maximum likelihood, and what is not
clearly below the threshold is verified on the full sets.

Equal sets are one class from the start and take part through their smallest doc_id. In each band bucket every member is
first tested against the smallest member (a star, so a bucket of any size gives one edge a member, joined with
skew handling); members that then still lie outside the largest component of their bucket are compared with it and with each other, block
by block, first on their registers, then on their sets, so no link inside a bucket is left out, no task holds more than two
blocks, and what leaves a block are only links that connect parts of it. A pair at the threshold of 0.85 shares no bucket with probability 6e-11, at 0.8 5e-8.

Sets are 64-bit hashes of shingles, made again from the texts of candidates only; a bit map of fixed size tells those
while scanning (when it saturates, more texts than needed are read, none is missed).

Defined results: documents without words (null, empty, white space) have empty sets and link with nothing; rows of one
doc_id count as one document for links; a null doc_id is linked only through an equal set; extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crestline.llm.common import RollingHash, arrow_rows, cut, mix64, shuffle_partitions
from crestline.llm.graph import components

REGISTERS, BAND = 128, 4
#: Base of the registers' scale, rate of the variates, and the largest register less one.
SCALE, RATE, TOP = 1.001, 20.0, (1 << 16) - 2
#: Standard errors below the threshold from which on an estimate settles that there is no link.
MARGIN = 6.0
#: Members of a band bucket, and shingles of all of them, that are compared with each other in one piece, on average.
BLOCK, BLOCK_ITEMS = 4096, 1 << 19
#: Bits of the map of candidates.
MAP_BITS = 1 << 25
#: Rows that Python gets at once.
BATCH = 1000
#: Bytes of texts that are hashed in one go.
TOGETHER = 1 << 18
#: Bytes from which on a text is hashed in stretches.
LONG = 1 << 20
_GAP = re.compile(rb"[\x20\x09-\x0D]")
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


@lru_cache(maxsize=1)
def _rolling() -> RollingHash:
    return RollingHash(11)


@lru_cache(maxsize=1)
def _seeds() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(12)
    odd = rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return odd, rng.integers(0, 1 << 63, REGISTERS, dtype=np.uint64)


def _stretches(data: bytes) -> Iterator[tuple[int, bytes]]:
    """A long text in stretches that end between words, with their starts."""
    at = 0
    while at < len(data):
        end = at + LONG
        if end < len(data):
            gap = _GAP.search(data, end)
            end = gap.start() if gap else len(data)
        yield at, data[at:end]
        at = end


def _words(data: bytes, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of texts joined by a space, and the number of the text it is in."""
    roll, hashes, texts = _rolling(), [], []
    for at, part in _stretches(data):
        raw = np.frombuffer(part, np.uint8)
        edge = np.flatnonzero(np.diff(np.concatenate(([True], _SPACE[raw], [True])).view(np.int8)))
        a, b = edge[::2], edge[1::2]
        named = roll.spans(roll.sums(raw), a, b) ^ ((b - a).astype(np.uint64) << np.uint64(1))
        hashes.append(mix64(named))
        texts.append(np.searchsorted(starts, at + a, side="right") - 1)
    return (np.concatenate(hashes), np.concatenate(texts)) if hashes else (np.zeros(0, np.uint64), np.zeros(0, np.int64))


def shingle_sets(texts: list[str | None], width: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    at = 0
    raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]  # bytes.lower() lowers A to Z alone
    while at < len(raw):
        end, size = at + 1, len(raw[at])
        while end < len(raw) and size + len(raw[end]) < TOGETHER:
            size += len(raw[end]) + 1
            end += 1
        part = raw[at:end]
        starts = np.concatenate(([0], np.cumsum([len(x) + 1 for x in part])[:-1]))
        words, of = _words(b" ".join(part), starts)
        bounds = np.searchsorted(of, np.arange(len(part) + 1))
        full = words[: max(0, len(words) - width + 1)]
        for k in range(1, width):
            full = mix64(full * np.uint64(0x9FB21C651E98DF25) + words[k : k + len(full)])
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a >= width:
                yield np.unique(full[a : b - width + 1])
            elif b > a:
                whole = words[a : a + 1]
                for k in range(a + 1, b):
                    whole = mix64(whole * np.uint64(0x9FB21C651E98DF25) + words[k : k + 1])
                yield mix64(whole + np.uint64(b - a))
            else:
                yield np.zeros(0, np.uint64)
        at = end


def registers(items: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set of hashes (all 0 for the empty set)."""
    if not len(items):
        return np.zeros(REGISTERS, np.uint16)
    odd, add = _seeds()
    least = np.full(REGISTERS, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(items), 512):
        np.minimum(least, (items[a : a + 512, None] * odd + add).min(axis=0), out=least)
    variate = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(np.maximum(variate, 1e-300)) / np.log(SCALE)), 0, TOP + 1).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union."""
    return np.maximum(a, b)


def estimate(larger: np.ndarray, smaller: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Likeliest Jaccard similarities, given how many registers of the first are larger and smaller, and the set sizes."""
    n, m = np.asarray(n, np.float64), np.asarray(m, np.float64)
    u, v = n / (n + m), m / (n + m)
    equal = REGISTERS - larger - smaller
    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (SCALE - 1) / SCALE) / np.log(SCALE)

    def likelihood(j: np.ndarray) -> np.ndarray:
        up, down = p(u - v * j), p(v - u * j)
        tiny = 1e-12
        return larger * np.log(up + tiny) + smaller * np.log(down + tiny) + equal * np.log(np.maximum(1 - up - down, 0) + tiny)

    for _ in range(24):  # the likelihood is concave in j
        a, b = low + (high - low) / 3, high - (high - low) / 3
        rising = likelihood(a) < likelihood(b)
        low, high = np.where(rising, a, low), np.where(rising, high, b)
    return (low + high) / 2


def _may_link(x: np.ndarray, y: np.ndarray, n: np.ndarray, m: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs (rows of registers) are not clearly below the threshold."""
    sure = threshold - MARGIN * np.sqrt(threshold * (1 - threshold) / REGISTERS)
    return estimate((x > y).sum(axis=1), (x < y).sum(axis=1), n, m) >= sure


def _sketcher(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, held = [], [], []
            for items in shingle_sets(batch.column("text").to_pylist(), width):
                n.append(len(items))
                other = mix64(items ^ np.uint64(0xD6E8FEB86659FD93))
                keys.append(np.array([items.sum(dtype=np.uint64), other.sum(dtype=np.uint64)]).tobytes() if len(items) else None)
                held.append(registers(items).tobytes() if len(items) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(held, pa.binary())], ["doc_id", "n", "key", "registers"])

    return sketch


def _bit_map(ids: DataFrame) -> np.ndarray:
    """Bits of the hashed ids; at most MAP_BITS / 64 rows reach the driver, whatever the input's size."""
    bit = F.pmod(F.xxhash64("id"), F.lit(MAP_BITS))
    words = ids.select(F.floor(bit / 64).cast("int").alias("w"), F.pmod(bit, F.lit(64)).cast("int").alias("b"))
    words = words.groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("bits"))
    out = np.zeros(MAP_BITS // 64, np.int64)
    for row in words.toLocalIterator():
        out[row["w"]] = row["bits"]
    return out


def _set_maker(width: int, bits: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bit = batch.column("bit").to_numpy()
            here = (bits[bit // 64].view(np.uint64) >> (bit % 64).astype(np.uint64)) & np.uint64(1)
            some = batch.filter(pa.array(here.astype(bool)))
            if some.num_rows:
                blobs = [s.tobytes() for s in shingle_sets(some.column("text").to_pylist(), width)]
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(blobs, pa.binary())], ["id", "items"])

    return sets


def _verifier(percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("x"), batch.column("y"), strict=True):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(a, b, assume_unique=True))
                good.append(100 * both >= percent * (len(a) + len(b) - both))
            yield batch.select(["u", "v"]).filter(pa.array(good, pa.bool_()))

    return verify


def _pruner(threshold: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("rx", "ry"))
                yield batch.select(["u", "v"]).filter(pa.array(_may_link(x, y, batch.column("nx").to_numpy(), batch.column("ny").to_numpy(), threshold)))

    return prune


def _block_links(threshold: float, percent: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Links between members of block i and block j of a bucket that are not connected yet; of those that connect the same
    parts one is given. Rows come by (key, i, j)."""
    least = REGISTERS * (threshold - MARGIN * np.sqrt(threshold * (1 - threshold) / REGISTERS))

    def compare(rows: list[tuple]) -> list[tuple[int, int]]:
        i, j = rows[0][1], rows[0][2]
        rows.sort(key=lambda r: (r[3] != i, r[4]))
        first = sum(r[3] == i for r in rows)
        registers = np.frombuffer(b"".join(r[7] for r in rows), np.uint16).reshape(-1, REGISTERS)
        sets = [np.frombuffer(r[8], np.uint64) for r in rows]
        sizes = np.array([len(x) for x in sets])
        edges = np.concatenate(([0], np.cumsum(sizes)))
        _, flat = np.unique(np.concatenate(sets), return_inverse=True)
        part = np.unique([r[5] for r in rows], return_inverse=True)[1]
        here = np.zeros(flat.max() + 1, bool)
        out = []
        for k in range(first):
            other = part != part[k]
            other[: k + 1 if i == j else first] = False
            at = np.flatnonzero(other & (100 * np.minimum(sizes, sizes[k]) >= percent * np.maximum(sizes, sizes[k])))
            at = at[(registers[at] == registers[k]).sum(axis=1) >= least]
            if not len(at):
                continue
            here[flat[edges[k] : edges[k + 1]]] = True
            common = np.array([np.count_nonzero(here[flat[edges[x] : edges[x + 1]]]) for x in at])
            here[flat[edges[k] : edges[k + 1]]] = False
            for x in at[100 * common >= percent * (sizes[at] + sizes[k] - common)]:
                if part[x] != part[k]:
                    part[part == part[x]] = part[k]
                    out.append((max(rows[k][4], rows[x][4]), min(rows[k][4], rows[x][4])))
        return out

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        names = ("key", "i", "j", "block", "id", "component", "n", "registers", "items")
        for batch in batches:
            found: list[tuple[int, int]] = []
            for row in zip(*(batch.column(c).to_pylist() for c in names), strict=True):
                if held and held[0][:3] != row[:3]:
                    found += compare(held)
                    held = []
                held.append(row)
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["u", "v"])
        if held and (found := compare(held)):
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["u", "v"])

    return links


def _sets(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """id, items: the sets of the documents with those ids."""
    bits = _bit_map(ids)
    hashed = docs.where("doc_id IS NOT NULL").select("doc_id", "text", F.pmod(F.xxhash64("doc_id"), F.lit(MAP_BITS)).alias("bit"))
    return hashed.mapInArrow(_set_maker(width, bits), "id long, items binary").join(ids, "id", "left_semi")


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row; links need 100 * common >= percent * all shingles."""
    with arrow_rows(docs.sparkSession, BATCH):
        return _near_duplicates(docs, width, percent)


def _near_duplicates(docs: DataFrame, width: int, percent: int) -> DataFrame:
    threshold = percent / 100
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = cut(docs.mapInArrow(_sketcher(width), "doc_id long, n long, key binary, registers binary"), "near-sketches")
    known = sketches.where("key IS NOT NULL AND doc_id IS NOT NULL")
    classes = cut(known.groupBy("key").agg(F.min("doc_id").alias("id"), F.max("n").alias("n"), F.max("registers").alias("registers")), "near-classes")

    slices = [F.xxhash64(F.lit(k), F.substring("registers", 1 + 2 * BAND * k, 2 * BAND)) for k in range(REGISTERS // BAND)]
    bands = classes.select("id", "n", F.explode(F.array(*slices)).alias("key"))
    shared = bands.groupBy("key").agg(F.min("id").alias("hub"), F.max("id").alias("last"), F.count("*").alias("size"), F.sum("n").alias("shingles")).where("hub < last").drop("last")
    members = cut(bands.drop("n").join(shared, "key"), "near-members")

    light = classes.select("id", "n", "registers")
    star = members.where("id <> hub").select(F.col("id").alias("u"), F.col("hub").alias("v")).distinct()
    star = star.join(light.select(F.col("id").alias("v"), F.col("n").alias("ny"), F.col("registers").alias("ry")), "v")
    star = star.join(light.select(F.col("id").alias("u"), F.col("n").alias("nx"), F.col("registers").alias("rx")), "u")
    star = cut(star.select("u", "v", "nx", "ny", "rx", "ry").mapInArrow(_pruner(threshold), "u long, v long"), "near-star")
    sets = cut(_sets(docs, members.select("id").distinct(), width), "near-sets")
    held = star.join(sets.select(F.col("id").alias("v"), F.col("items").alias("y")), "v").join(sets.select(F.col("id").alias("u"), F.col("items").alias("x")), "u")
    links = cut(held.select("u", "v", "x", "y").mapInArrow(_verifier(percent), "u long, v long"), "near-links")
    found = components(links)

    # buckets of three or more whose members are not all connected yet
    wide = members.where("size > 2").select("key", "id", "size", "shingles")
    placed = wide.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    open_keys = placed.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select("key")
    # a bucket's largest component is not compared with itself: its members are dealt over blocks 0 to `mains` - 1, each of
    # which meets the blocks of all other members; those meet each other too
    placed = placed.select("key", "id", "component").join(open_keys, "key", "left_semi").join(light.select("id", F.col("n").alias("items_of")), "id")
    parts = placed.groupBy("key", "component").agg(F.count("*").alias("n"), F.sum("items_of").alias("shingles"))
    main = parts.groupBy("key").agg(F.max(F.struct("n", "component", "shingles")).alias("main"), F.sum("n").alias("n"), F.sum("shingles").alias("shingles"))
    blocks = lambda n, shingles: F.greatest(F.lit(1), F.ceil(n / BLOCK), F.ceil(shingles / BLOCK_ITEMS)).cast("int")
    main = main.select("key", F.col("main.component").alias("main"), blocks(F.col("main.n"), F.col("main.shingles")).alias("mains"), blocks(F.col("n") - F.col("main.n"), F.col("shingles") - F.col("main.shingles")).alias("others"))
    deal = F.xxhash64("id")
    block = F.when(F.col("component") == F.col("main"), F.pmod(deal, F.col("mains"))).otherwise(F.col("mains") + F.pmod(deal, F.col("others"))).cast("int")
    rest = placed.join(main, "key").withColumn("block", block)
    across = F.sequence(F.lit(0), F.col("mains") + F.col("others") - 1)
    partners = F.when(F.col("component") == F.col("main"), F.filter(across, lambda b: b >= F.col("mains"))).otherwise(across)
    rest = rest.withColumn("with", F.explode(partners)).join(light, "id").join(sets, "id")
    rest = rest.select("key", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), "block", "id", "component", "n", "registers", "items")
    rest = rest.repartition(shuffle_partitions(docs.sparkSession), "key", "i", "j").sortWithinPartitions("key", "i", "j")
    more = cut(rest.mapInArrow(_block_links(threshold, percent), "u long, v long").distinct(), "near-rest")
    if not more.isEmpty():
        found = components(links.unionByName(more))

    of_class = classes.select("key", "id").join(found.withColumnRenamed("node", "id"), "id", "left")
    of_class = of_class.select("key", F.coalesce("component", "id").alias("component"))
    out = sketches.select("doc_id", "n", "key").join(of_class, "key", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def one_of_each(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """The rows that are kept: of each group of near-duplicates the one with the smallest doc_id, nulls last. Each row is a
    document of its own here, so unlike texts of one id all stay; rows without words link with nothing and stay."""
    # written, so that a row's number is the same wherever it is read
    rows = cut(docs.withColumn("__row", F.monotonically_increasing_id()), "near-rows")
    found = near_duplicates(rows.select(F.col("__row").alias("doc_id"), "text"), width, percent)
    found = found.where("NOT kept").select(F.col("doc_id").alias("__row"), F.col("component_id").alias("__group"))
    # only rows of groups of two or more are compared by doc_id; all others stay
    linked = cut(found.unionByName(found.select(F.col("__group").alias("__row"), "__group").distinct()), "near-linked")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "__row")
    stays = linked.join(rows.select("__row", "doc_id"), "__row").groupBy("__group").agg(F.min(order)["__row"].alias("__row")).select("__row")
    goes = linked.select("__row").join(stays, "__row", "left_anti")
    return rows.join(goes, "__row", "left_anti").drop("__row")
