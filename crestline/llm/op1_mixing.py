"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

A source's share follows its weight but stops at REPEATS times what it holds; the excess is shared again by weight.
Documents are dealt over shards; a source of many documents or words spans many shards, a small one lies in a single shard. In
each shard the seats (blocks of equally many words) go to the sources by highest quotients weight / (2 * seats + 1).
A source then fills its quota from its own blocks there: whole rounds over all of them, and for the rest a seeded
choice. The only shuffles carry ids, sizes and hashes, never texts; a hash of the text deals rows that share id and size over shards.

Defined results: null and empty texts have size 0 and nothing taken; a null source is a source of its own, last in
order; repeated rows and rows without an id count each for itself; an empty table gives an empty result; columns beyond doc_id, text and
source are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crestline.llm.common import cut

WORD = r"[^\x20\x09-\x0D]+"
#: How often a document may be used.
REPEATS = 3
#: Words of a block, unless the smallest source of a shard is too small for BLOCKS_OF_SMALLEST of them.
BLOCK_WORDS, BLOCKS_OF_SMALLEST = 64, 200
#: Documents and words of one source in one shard, about.
DOCS_OF_SHARD, WORDS_OF_SHARD = 256, 1 << 20
#: Sources up to which their table is sent to every task; beyond, a join that AQE may split.
BROADCAST_SOURCES = 10_000


def highest_quotients(weights: np.ndarray, seats: int) -> np.ndarray:
    """Seats of each weight by the quotients weight / (2 * seats + 1); ties go to the earlier weight.

    A divisor found by bisection gives nearly all seats at once; only the last few are dealt one by one.
    """
    given = np.zeros(len(weights), np.int64)
    total = float(weights.sum())
    if seats <= 0 or total <= 0:
        return given
    low, high = 0.0, 2.0 * seats / total + 1.0 / total
    for _ in range(80):
        middle = (low + high) / 2
        if np.floor(weights * middle + 0.5).sum() <= seats:
            low = middle
        else:
            high = middle
    given = np.floor(weights * low * (1 - 1e-12) + 0.5).astype(np.int64)
    queue = [(-w / (2 * g + 1), i) for i, (w, g) in enumerate(zip(weights, given, strict=True)) if w > 0]
    heapq.heapify(queue)
    for _ in range(seats - int(given.sum())):
        i = queue[0][1]
        given[i] += 1
        heapq.heapreplace(queue, (-weights[i] / (2 * given[i] + 1), i))
    return given


def quotas(weights: np.ndarray, blocks: np.ndarray) -> np.ndarray:
    """Blocks each source gives, by highest quotients; what a source cannot give in REPEATS rounds goes to the others."""
    most, given = REPEATS * blocks, np.zeros(len(weights), np.int64)
    free = np.ones(len(weights), bool)
    seats = min(int(round(weights.sum())), int(most.sum()))
    while free.any():
        given[free] = highest_quotients(weights[free], seats - int(given[~free].sum()))
        over = free & (given > most)
        if not over.any():
            break
        given[over], free[over] = most[over], False
    return given


def take(sizes: np.ndarray, quota: int, block: int, rng: np.random.Generator) -> np.ndarray:
    """Words taken of each document when `quota` of the blocks of their joined words are used."""
    ends = np.cumsum(sizes)
    words = int(ends[-1]) if len(ends) else 0
    blocks = -(-words // block)
    if not blocks:
        return np.zeros(len(sizes), np.int64)
    rounds, rest = divmod(min(quota, REPEATS * blocks), blocks)
    used = np.full(blocks, rounds, np.int64)
    used[rng.permutation(blocks)[:rest]] += 1
    edges = np.minimum(np.arange(blocks + 1, dtype=np.int64) * block, words)
    upto = np.concatenate(([0], np.cumsum(used * np.diff(edges))))
    at = np.concatenate(([0], ends))
    k = np.minimum(at // block, blocks - 1)
    return np.diff(upto[k] + (at - edges[k]) * used[k])


def sources_of(sizes: DataFrame) -> DataFrame:
    """One row per source: its size, documents, weight and target, by water filling over the sorted caps."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weighed = totals.withColumn("weight", ((F.row_number().over(order) - 1) % 3 + 1).cast("double"))
    weighed = weighed.withColumn("cap", (REPEATS * F.col("source_size")).cast("double"))
    caps = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = caps.rowsBetween(Window.unboundedPreceding, -1)
    every = caps.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (
        F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    )
    leveled = weighed.withColumn("own", level)
    # the first source, by rising cap per weight, that the level leaves under its cap sets the level of all after it
    first = F.min(F.when(F.col("own") * F.col("weight") <= F.col("cap"), F.struct((F.col("cap") / F.col("weight")).alias("at"), F.col("own").alias("own")))).over(every)
    return leveled.withColumn("level", first["own"]).withColumn(
        "target", F.least(F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap")))
    ).select("source", "source_size", "docs", "target")


def _shard_function(seed: int) -> Callable[[pa.Table], pa.Table]:
    def shard(rows: pa.Table) -> pa.Table:
        order = [(c, "ascending") for c in ("source_no", "deal", "doc_id", "size", "key")]
        rows = rows.take(pc.sort_indices(rows, sort_keys=order))
        no, sizes = rows.column("source_no").to_numpy(), rows.column("size").to_numpy()
        starts = np.flatnonzero(np.concatenate(([True], no[1:] != no[:-1])))
        ends = np.append(starts[1:], len(no))
        words = np.add.reduceat(sizes, starts)
        ratio = np.nan_to_num(rows.column("target").to_numpy()[starts] / np.maximum(rows.column("source_size").to_numpy()[starts], 1))
        due = ratio * words
        block = int(max(1, min(BLOCK_WORDS, min(due[due > 0], default=0) // BLOCKS_OF_SMALLEST)))
        blocks = -(-words // block)
        given = quotas(ratio * blocks, blocks)
        taken = np.zeros(len(no), np.int64)
        for s, (a, b) in enumerate(zip(starts, ends, strict=True)):
            taken[a:b] = take(sizes[a:b], int(given[s]), block, np.random.default_rng([seed, rows.column("shard")[0].as_py(), s]))
        return rows.select(["doc_id", "size", "source_size", "target"]).append_column("taken", pa.array(taken)).append_column("key", rows.column("key"))

    return shard


def mix_sources(docs: DataFrame, seed: int = 1) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document; see the module's text."""
    return _mix(docs, seed, F.xxhash64("text")).drop("key")


def _mix(docs: DataFrame, seed: int, key: Column) -> DataFrame:
    """The mix with a key of each row."""
    spark = docs.sparkSession
    sizes = cut(
        docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"), key.cast("long").alias("key")),
        "mix-sizes",
    )
    spare = cut(sources_of(sizes), "mix-sources")
    span = F.greatest(F.ceil(F.col("docs") / DOCS_OF_SHARD), F.ceil(F.col("source_size") / WORDS_OF_SHARD), F.lit(1))
    n_sources, spans = spare.agg(F.count("*"), F.sum(span)).first()
    shards = max(1, spans or 0)
    numbered = spare.withColumn("source_no", F.xxhash64(F.lit(seed), F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))).withColumnRenamed("source", "source_name")
    small = F.broadcast(numbered) if n_sources <= BROADCAST_SOURCES else numbered
    deal = F.xxhash64(F.lit(seed), "doc_id", "size", "key")
    dealt = (
        sizes.join(small, F.col("source").eqNullSafe(F.col("source_name")))
        .withColumn("deal", deal)
        .withColumn("span", span)
        .withColumn("shard", F.pmod(F.pmod(F.col("source_no"), F.lit(shards)) + F.pmod(F.col("deal"), F.col("span")), F.lit(shards)))
        .select("shard", "source_no", "deal", "doc_id", "size", "source_size", "target", "key")
    )
    out = "doc_id long, size long, source_size long, target double, taken long, key long"
    return dealt.groupBy("shard").applyInArrow(_shard_function(seed), out)


def mixed_documents(docs: DataFrame, seed: int = 1) -> DataFrame:
    """The documents the mix uses, whole: taken / size times each, rounded down or up by a seeded hash of the row, so that
    a source's words keep to its target in expectation. Each row has its own share, also where ids repeat or are null.
    Documents without words stay once: no share is due to them."""
    row = F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("="), F.coalesce("source", F.lit("")), F.lit("="), "text")
    part = F.col("taken") / F.greatest("size", F.lit(1))
    chance = F.pmod(F.xxhash64(F.lit(seed), F.lit("use"), "key"), F.lit(1 << 30)) / (1 << 30)
    # rows alike in all of these have one key, and take what is due to them in any order
    uses = (
        _mix(docs, seed, row)
        .select(F.col("key").alias("__row"), F.when(F.col("size") == 0, 1).otherwise(F.floor(part + chance)).cast("int").alias("__uses"))
        .groupBy("__row")
        .agg(F.array_sort(F.collect_list("__uses")).alias("__uses"))
    )
    numbered = docs.withColumn("__row", row).withColumn("__n", F.row_number().over(Window.partitionBy("__row").orderBy("__row")))
    own = F.get("__uses", F.col("__n") - 1)
    copies = F.when(own > 0, F.sequence(F.lit(1), own)).otherwise(F.array().cast("array<int>"))
    return numbered.join(uses, "__row").withColumn("__use", F.explode(copies)).select(*docs.columns)
