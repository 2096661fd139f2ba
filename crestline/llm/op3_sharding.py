"""Two-pass external shuffle into shards.

Pass one scatters whole records over buckets that fit in a task's memory, by a seeded hash of the row. Pass two brings
each bucket into a fixed order, Fisher-Yates shuffles it with a generator seeded by the bucket, and writes it. Buckets
follow each other, so every record has a place in one long shuffled order; the shards are equal stretches of that order.
Law: `rows` (the counts of the shards differ by one at most).

The shuffle moves each record once. Buckets hold BUCKET_BYTES of text on average and BUCKET_ROWS rows at most on
average; their counts and starts are rows of a table, joined by bucket, not gathered on the driver.

The scatter hashes whole rows; where rows alike in everything would crowd a bucket, it numbers rows and hashes those too.

Defined results: null texts are empty for size and checksum and stay null in the shards; wholly equal rows are
exchangeable; an empty table gives an empty result; the record keeps all columns, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crestline.llm.common import BUCKET_BYTES, cut, shared_dir, text_bytes

LAW = "rows"
BUCKET_ROWS = 4096


def fisher_yates(n: int, rng: np.random.Generator) -> np.ndarray:
    """A uniform permutation: numpy's shuffle swaps each place, from the last on, with one at or below it."""
    order = np.arange(n)
    rng.shuffle(order)
    return order


def _bucket_function(seed: int, shards: int, total: int) -> Callable[[pa.Table], pa.Table]:
    low, more = divmod(total, shards)

    def bucket(rows: pa.Table) -> pa.Table:
        # rows arrive in any order; the checksum of the text and the scatter hash make it one
        keys = pa.table({"deal": rows.column("deal"), "tie": rows.column("tie")})
        rows = rows.take(pc.sort_indices(keys, sort_keys=[("deal", "ascending"), ("tie", "ascending")]))
        at = fisher_yates(rows.num_rows, np.random.default_rng([seed, rows.column("bucket")[0].as_py()]))
        rows = rows.take(pa.array(at))
        place = rows.column("first").to_numpy() + np.arange(rows.num_rows)
        cut = more * (low + 1)
        shard = np.where(place < cut, place // (low + 1), more + (place - cut) // max(low, 1))
        start = np.where(shard <= more, shard * (low + 1), cut + (shard - more) * low)
        return pa.table({"shard": pa.array(shard, pa.int32()), "slot": pa.array(place - start, pa.int64()), "record": rows.column("record")})

    return bucket


def shuffle_into_shards(records: DataFrame, shards: int = 16, seed: int = 1, text: str = "text") -> DataFrame:
    """shard int, slot long, record struct (all columns of the input)."""
    total, size = records.agg(F.count("*"), F.sum(text_bytes(text) + 64)).first()
    buckets = int(max(1, -(-(size or 0) // BUCKET_BYTES), -(-total // BUCKET_ROWS)))
    columns = records.columns
    short = [c for c, kind in records.dtypes if kind != "void" and not kind.startswith(("map", "variant"))]
    row = F.xxhash64(F.lit(seed), *short)
    same = cut(records.select(row.alias("row"), text_bytes(text).alias("bytes")).groupBy("row").agg(F.count("*").alias("count"), F.sum("bytes").alias("bytes")), "shuffle-rows")
    most, heaviest = same.agg(F.coalesce(F.max("count"), F.lit(0)), F.coalesce(F.max(F.when(F.col("count") > 1, F.col("bytes"))), F.lit(0))).first()
    if most > BUCKET_ROWS or heaviest > BUCKET_BYTES:
        # rows alike in everything would fill one bucket, by their number or their size: written with numbers, which then have a part in the scatter
        records = cut(records.withColumn("__number", F.monotonically_increasing_id()), "shuffle-numbered")
        deal = F.xxhash64(F.lit(seed), *short, "__number")
        counts = records.select(F.pmod(deal, F.lit(buckets)).cast("int").alias("bucket")).groupBy("bucket").count()
    else:
        deal = row
        counts = same.groupBy(F.pmod("row", F.lit(buckets)).cast("int").alias("bucket")).agg(F.sum("count").alias("count"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.select(F.col("bucket").alias("b"), F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    packed = records.select(deal.alias("deal"), F.xxhash64(text).alias("tie"), F.struct(*columns).alias("record"))
    packed = packed.withColumn("bucket", F.pmod("deal", F.lit(buckets)).cast("int"))
    joined = packed.join(firsts, F.col("bucket") == F.col("b")).select("bucket", "first", "deal", "tie", "record")
    out = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType()), T.StructField("record", packed.schema["record"].dataType)])
    return joined.groupBy("bucket").applyInArrow(_bucket_function(seed, shards, total), out)


def write_shards(records: DataFrame, path: str, shards: int = 16, seed: int = 1) -> str:
    """Writes shuffle_into_shards() under path, a folder per shard; each file holds a stretch of slots in order."""
    shuffle_into_shards(records, shards, seed).write.partitionBy("shard").option("compression", "zstd").parquet(path)
    return path


def shard_digests(records: DataFrame, shards: int = 16, seed: int = 1) -> DataFrame:
    """Writes the shards to the shared folder and describes what the files hold."""
    spark = records.sparkSession
    path = write_shards(records, f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}", shards, seed)
    schema = T.StructType([T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType()), T.StructField("record", T.StructType(records.schema.fields))])
    written = spark.read.schema(schema).parquet(path)
    text = F.coalesce(F.col("record.text"), F.lit(""))
    return written.select(
        F.col("record.doc_id").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(F.encode(text, "utf-8")).alias("text_crc32"),
        F.lit(LAW).alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
