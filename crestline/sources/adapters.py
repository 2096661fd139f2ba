"""The test tables seen as signals.

Real sources carry frame numbers; these adapters make them by ranking, which needs one sort per track. They exist for
tests and benchmarks, so a track's ranking is the only step here that does not spread over more than its track.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A nominal rate at which a window is 300 frames, so that small tables have many windows.
SAMPLE_RATE = 100


def packets_of_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track_id, channel, seq, n_frames, samples: one packet per vector; tracks are labels, channels parities of the id."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    channel = F.pmod("vec_id", F.lit(2)).cast("int")
    order = Window.partitionBy("label", channel).orderBy("vec_id")
    return rows.select(
        F.col("label").cast("string").alias("track_id"),
        channel.alias("channel"),
        (F.row_number().over(order) - 1).cast("long").alias("seq"),
        F.size("embedding").cast("long").alias("n_frames"),
        F.col("embedding").alias("samples"),
    )


def samples_of_packets(packets: DataFrame) -> DataFrame:
    """track_id, channel, frame_idx, sample: packets in order of seq, unpacked."""
    before = Window.partitionBy("track_id", "channel").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = packets.withColumn("start", F.coalesce(F.sum("n_frames").over(before), F.lit(0)))
    return placed.select("track_id", "channel", "start", F.posexplode("samples").alias("pos", "x")).select(
        "track_id", "channel", (F.col("start") + F.col("pos")).alias("frame_idx"), F.col("x").cast("double").alias("sample")
    )


def samples_of_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples_of_packets(packets_of_embeddings(spark, sf_dir))


def samples_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks are event types, channels parities of the user, frames in order of time."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    channel = F.pmod("user_id", F.lit(2)).cast("int")
    order = Window.partitionBy("event_type", channel).orderBy("ts", "event_id")
    return rows.select(
        F.col("event_type").alias("track_id"),
        channel.alias("channel"),
        (F.row_number().over(order) - 1).cast("long").alias("frame_idx"),
        ((F.col("value") - 250) / 250).alias("sample"),
    )


def samples_of_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tracks are return flags with seven channels, the line numbers less one."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    order = Window.partitionBy("l_returnflag", "l_linenumber").orderBy("l_orderkey", "l_partkey", "l_suppkey", "l_shipdate")
    sign = F.when(F.pmod("l_partkey", F.lit(2)) == 1, -1).otherwise(1)
    return rows.select(
        F.col("l_returnflag").alias("track_id"),
        (F.col("l_linenumber") - 1).cast("int").alias("channel"),
        (F.row_number().over(order) - 1).cast("long").alias("frame_idx"),
        (F.col("l_discount") * sign).alias("sample"),
    )
