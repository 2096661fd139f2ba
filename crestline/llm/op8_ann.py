"""Nearest neighbours by largest inner product from a hash-prefix forest.

Vectors are lifted by one coordinate to equal length and queries are not, so that the largest inner product is the smallest
angle; each of TREES trees gives a vector a string of BITS sign bits of random hyperplanes. A tree is the sorted array of
its strings, dealt over tasks by its first bits and, where those are shared by many rows, over several chunks, to each of
which the queries of that prefix go; so no block is large, however the strings cluster.

A query descends to its longest matches; then all trees ascend together, one prefix length at a time, until they hold
FIRST * k rows between them (or as many as there are), and those are scored exactly. The k-th best angle found bounds the
true one from above, and two vectors at an angle t share l bits in one of T trees or more with probability
1 - (1 - (1 - t / pi)^l)^T. Where that is below CONFIDENCE the trees ascend again, to the longest prefix at which it is not.
So the rows scored follow from the data: few where neighbours are near, about half of all where vectors have no structure
(at which no index prunes much). Prefixes shorter than the DEPTH bits by which trees are dealt are several blocks of each
tree; a query that no prefix gives the confidence, or that finds fewer than k rows, meets every row of one tree.

Equal vectors are one row of the index, with the k + 1 smallest ids of theirs; all rows are indexed. Queries are rows of
the table; nothing is broadcast but the hyperplanes.

Defined results: vectors that are null, zero, or hold null or non-finite components, and rows without an id, take no
part; vectors of another length than the commonest (ties: the longest) take no part either; repeated ids are rows of
their own; ties go to the smaller id; an empty table gives none; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crestline.llm.common import cut

TREES, BITS = 16, 60
#: Rows first scored, as a multiple of those asked for (repeats in several trees counted), and the probability with which
#: a row as near as the last one asked for must have been met.
FIRST, CONFIDENCE = 50, 0.88
#: Bits by which a tree is dealt, and rows of a chunk, on average.
DEPTH, CHUNK = 3, 8192


def planes(dims: int, seed: int) -> np.ndarray:
    """(dims + 1, TREES * BITS): the normals of the hyperplanes."""
    return np.random.default_rng(seed).normal(size=(dims + 1, TREES * BITS))


def codes(vectors: np.ndarray, norm: float, normals: np.ndarray, lifted: bool = True) -> np.ndarray:
    """(rows, TREES) integers of BITS bits, first bit highest."""
    lift = np.sqrt(np.maximum(norm**2 - (vectors**2).sum(axis=1), 0)) if lifted else np.zeros(len(vectors))
    bits = (np.column_stack([vectors, lift]) @ normals > 0).reshape(len(vectors), TREES, BITS)
    return bits @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))


def _coder(norm: float, dims: int, seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each vector's strings as a row of the index, then as a query if it asks."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normals = planes(dims, seed)
        for batch in batches:
            if not batch.num_rows:
                continue
            flat = batch.column("vector").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            reps, asks = batch.column("rep").to_numpy(), batch.column("asks").to_numpy(zero_copy_only=False).astype(bool)
            wide = flat.astype(np.float32)
            narrow = np.array_equal(wide.astype(np.float64), flat)
            blobs = np.array([row.tobytes() for row in (wide if narrow else flat)], object)
            for asking, some in ((False, np.arange(len(flat))), (True, np.flatnonzero(asks))):
                if len(some):
                    found = codes(flat[some], norm, normals, lifted=not asking)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.tile(np.arange(TREES, dtype=np.int32), len(some))), pa.array(found.reshape(-1)), pa.array(np.repeat(reps[some], TREES)), pa.array(np.full(TREES * len(some), asking)), pa.array(np.repeat(blobs[some], TREES).tolist(), pa.binary())],
                        ["tree", "code", "rep", "asks", "vector"],
                    )

    return code


def _ranges(sorted_codes: np.ndarray, code: int) -> tuple[np.ndarray, np.ndarray]:
    """Stretch of the sorted array that shares the first l bits with code, for l = 0 to BITS (at least DEPTH bits)."""
    lengths = np.maximum(np.arange(BITS + 1), DEPTH)
    low = (code >> (BITS - lengths)) << (BITS - lengths)
    high = low + (np.int64(1) << (BITS - lengths))
    return np.searchsorted(sorted_codes, low, "left"), np.searchsorted(sorted_codes, high, "left")


def _count(rows: pd.DataFrame) -> pd.DataFrame:
    """For each query of a block, how many rows share at least l bits."""
    held = np.sort(rows.loc[~rows["asks"], "code"].to_numpy())
    asks = rows[rows["asks"]]
    out = []
    for code in asks["code"].to_numpy():
        a, b = _ranges(held, code)
        out.append((b - a).tolist())
    return pd.DataFrame({"rep": asks["rep"].to_numpy(), "counts": pd.Series(out, dtype=object)})


def _vectors(blobs: pd.Series, dims: int) -> np.ndarray:
    return np.vstack([np.frombuffer(b, np.float32 if len(b) == 4 * dims else np.float64) for b in blobs]).astype(np.float64)


SCORED = "rep long, near long, score double, scored long"


def _scorer(dims: int, keep: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The best rows of a block for each of its queries; the first of them tells how many were compared."""

    def score(rows: pd.DataFrame) -> pd.DataFrame:
        asks = rows[rows["asks"]]
        rows = rows[~rows["asks"]].sort_values(["code", "rep"])
        out = []
        if len(rows) and len(asks):
            held, reps, vectors, wanted = rows["code"].to_numpy(), rows["rep"].to_numpy(), _vectors(rows["vector"], dims), _vectors(asks["vector"], dims)
            for rep, code, level, own in zip(asks["rep"], asks["code"], asks["level"], wanted, strict=True):
                a, b = (0, len(held)) if level < DEPTH else (x[int(level)] for x in _ranges(held, code))
                if a == b:
                    continue
                near = vectors[a:b] @ own
                best = np.arange(b - a) if b - a <= keep else np.flatnonzero(near >= np.partition(near, -keep)[-keep] - 1e-9 * abs(near).max())
                exact = (vectors[a + best] * own).sum(axis=1)
                order = np.lexsort((reps[a + best], -exact))[:keep]
                out.append(pd.DataFrame({"rep": rep, "near": reps[a + best[order]], "score": exact[order], "scored": [b - a, *[0] * (len(order) - 1)]}))
        return pd.concat(out) if out else pd.DataFrame({"rep": [], "near": [], "score": [], "scored": []}).astype({"rep": "int64", "near": "int64", "score": "float64", "scored": "int64"})

    return score


def confident_level(score: Column, most: Column) -> Column:
    """The longest prefix that a row of that inner product shares with the query in some tree with CONFIDENCE; `most` is the
    largest possible product. 0 if none is long enough, or nothing was found."""
    cosine = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), score / most))
    alike = 1 - F.acos(cosine) / math.pi
    needed = math.log(1 - (1 - CONFIDENCE) ** (1 / TREES))
    level = F.when(score.isNull() | (alike <= 1e-12), 0).when(alike >= 1 - 1e-12, BITS).otherwise(F.least(F.lit(float(BITS)), F.floor(F.lit(needed) / F.log(alike))))
    return level.cast("int")


def usable(vector: str = "embedding") -> Column:
    v = F.col(vector)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return v.isNotNull() & F.coalesce(finite & F.exists(v, lambda x: x != 0), F.lit(False))


def nearest(table: DataFrame, asks: Column, k: int = 20, seed: int = 1) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest found for the rows for which `asks` (of vec_id) is true; scored: rows that
    the query was compared with, repeats counted."""
    given = table.where(usable() & F.col("vec_id").isNotNull())
    given = given.select("vec_id", F.transform("embedding", lambda x: x.cast("double") + 0.0).alias("vector"), asks.alias("asks"))
    shape = given.groupBy(F.size("vector").alias("dims")).agg(F.count("*").alias("n"), F.max(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x)).alias("norm"))
    top = shape.orderBy(F.desc("n"), F.desc("dims")).first()
    result = "query_id long, rank int, vec_id long, score double, scored long"
    if top is None:
        return table.sparkSession.createDataFrame([], result)
    dims, norm = top["dims"], float(np.sqrt(top["norm"]))
    given = given.where(F.size("vector") == dims).withColumn("key", F.struct(F.xxhash64("vector"), F.xxhash64(F.lit(1), "vector")))
    rows = cut(given, "ann-rows")

    # classes of equal vectors: the smallest id stands for them, and the k + 1 smallest answer for them
    classes = rows.groupBy("key").agg(F.min("vec_id").alias("rep"), F.max("asks").alias("asks"), F.first("vector").alias("vector"))
    own = Window.partitionBy("key").orderBy("vec_id")
    ids = rows.select("key", "vec_id").withColumn("n", F.row_number().over(own)).where(F.col("n") <= k + 1)
    ids = ids.groupBy("key").agg(F.min("vec_id").alias("near"), F.array_sort(F.collect_list("vec_id")).alias("ids"))

    n = classes.count()
    chunks = max(1, -(-n // ((1 << DEPTH) * CHUNK)))
    wanted = min(FIRST * (k + 1), n)
    coded = classes.select("rep", "asks", "vector").mapInArrow(_coder(norm, dims, seed), "tree int, code long, rep long, asks boolean, vector binary")
    index = cut(coded.withColumn("prefix", F.shiftright("code", BITS - DEPTH).cast("int")), "ann-index")
    held = index.where("NOT asks").withColumn("chunk", F.pmod(F.xxhash64("rep"), F.lit(chunks)).cast("int"))
    asking = index.where("asks").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))))
    block = ["tree", "prefix", "chunk"]

    def scored(levels: DataFrame) -> DataFrame:
        """The best rows of each query of (q, level): from the blocks that share so many bits, or from all of one tree."""
        asked = asking.join(levels, F.col("rep") == F.col("q")).drop("q").where((F.col("level") > 0) | (F.col("tree") == 0))
        wide = F.lit(1).cast("int") * F.expr(f"shiftleft(1, greatest(0, {DEPTH} - level))")
        from_ = (F.floor(F.col("prefix") / wide) * wide).cast("int")
        asked = asked.withColumn("prefix", F.explode(F.sequence(from_, (from_ + wide - 1).cast("int"))))
        both = asked.unionByName(held.withColumn("level", F.lit(0)))
        return both.groupBy(block).applyInPandas(_scorer(dims, k + 1), SCORED)

    def ranked(hits: DataFrame) -> DataFrame:
        best = hits.groupBy("rep", "near").agg(F.max("score").alias("score"), F.sum("scored").alias("scored"))
        first = Window.partitionBy("rep").orderBy(F.desc("score"), "near")
        total = F.sum("scored").over(Window.partitionBy("rep"))
        return best.withColumn("scored", total).withColumn("n", F.row_number().over(first)).where(F.col("n") <= k + 1)

    slim = [*block, "code", "rep", "asks"]
    counted = held.select(slim).unionByName(asking.select(slim)).groupBy(block).applyInPandas(_count, "rep long, counts array<long>")
    summed = F.aggregate(F.collect_list("counts"), F.array_repeat(F.lit(0).cast("long"), BITS + 1), lambda s, c: F.zip_with(s, c, lambda a, b: a + b))
    levels = counted.groupBy("rep").agg(summed.alias("counts"))
    levels = cut(levels.select(F.col("rep").alias("q"), F.greatest(F.lit(DEPTH), F.size(F.filter("counts", lambda c: c >= wanted)) - 1).alias("level")), "ann-levels")
    hits = cut(scored(levels), "ann-hits")

    # how near the last one found is says how far the trees must ascend; a query with fewer than asked for meets every row
    size = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    last = ranked(hits).where(F.col("n") == min(k + 1, n)).select("rep", "score")
    sizes = classes.where("asks").select("rep", size.alias("size")).join(last, "rep", "left")
    needs = sizes.select("rep", confident_level(F.col("score"), F.col("size") * norm).alias("needed"))
    again = levels.join(needs, F.col("rep") == F.col("q")).where(F.col("needed") < F.col("level")).select("q", F.col("needed").alias("level"))
    best = ranked(hits.unionByName(scored(again))).drop("n")
    named = best.join(ids.select("near", "ids"), "near").select("rep", "score", "scored", F.explode("ids").alias("vec_id"))
    listed = named.withColumn("n", F.row_number().over(Window.partitionBy("rep").orderBy(F.desc("score"), "vec_id"))).where(F.col("n") <= k + 1)
    answers = listed.groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("n", "vec_id", "score"))).alias("found"), F.max("scored").alias("scored"))

    queries = rows.where("asks").select("key", F.col("vec_id").alias("query_id")).join(classes.select("key", "rep"), "key").join(answers, "rep")
    others = F.slice(F.filter("found", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    out = queries.select("query_id", "scored", F.posexplode(others).alias("pos", "hit"))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("hit.vec_id").alias("vec_id"), F.col("hit.score").alias("score"), "scored")
