"""Batches of files: outcome statistics, error groups, warnings in order, and benchmark runs."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F

from crestline.functions import levels
from crestline.storage import written


def batch_summary(results: DataFrame) -> DataFrame:
    """Files processed and failed, and the success rate; one row, also for an empty batch."""
    out = results.agg(F.count_if(F.col("error_category").isNull()).alias("processed"), F.count_if(F.col("error_category").isNotNull()).alias("failed"))
    total = F.col("processed") + F.col("failed")
    return out.withColumn("success_rate", F.when(total > 0, 100.0 * F.col("processed") / total).otherwise(F.lit(0.0)))


def error_groups(results: DataFrame, names: int = 3) -> DataFrame:
    """Failures by category, commonest first, with the first few file names by index and how many more there are."""
    failed = results.where("error_category IS NOT NULL")
    first = Window.partitionBy("error_category").orderBy("idx")
    counts = failed.groupBy("error_category").agg(F.count("*").alias("failures"))
    shown = failed.withColumn("place", F.row_number().over(first)).where(F.col("place") <= names)
    shown = shown.groupBy("error_category").agg(F.concat_ws(", ", F.transform(F.array_sort(F.collect_list(F.struct("idx", "file_name"))), lambda r: r["file_name"])).alias("file_names"))
    out = counts.join(shown, "error_category").withColumn("more", F.greatest(F.col("failures") - names, F.lit(0)))
    return out.orderBy(F.desc("failures"), "error_category")


def ranked_warnings(tracks: DataFrame) -> DataFrame:
    """Tracks near a rounding boundary: high risk first, then the nearer ones."""
    risk = levels.boundary_risk(F.col("official_dr"), F.col("precise_dr"))
    out = tracks.withColumn("risk", risk).where("risk IS NOT NULL").select("track_id", "official_dr", "precise_dr", "risk.*")
    out = out.withColumn("potential_dr", levels.potential_official(F.col("official_dr"), F.col("direction")))
    return out.orderBy((F.col("risk_level") == "High").desc(), "distance_db", "track_id")


def exclusion_flags(tracks: DataFrame) -> DataFrame:
    """Whether any track of the batch left out a low-frequency or a silent channel."""
    silent = F.col("excluded_channels") - F.col("excluded_lfe")
    return tracks.agg(F.coalesce(F.bool_or(F.col("excluded_lfe") > 0), F.lit(False)).alias("any_lfe"), F.coalesce(F.bool_or(silent > 0), F.lit(False)).alias("any_silent"))


def by_precision(tracks: DataFrame, descending: bool = True) -> DataFrame:
    """In order of the precise value, tracks without one last either way."""
    value = F.col("precise_dr").desc_nulls_last() if descending else F.col("precise_dr").asc_nulls_last()
    return tracks.orderBy(value, "track_id")


def placed(rows: DataFrame, name: str, *order: Column, start: int = 1) -> DataFrame:
    """Adds each row's place in a total order. Rows are dealt by ranges of the order and numbered within each; only how many
    each range holds is summed in one task."""
    spark = rows.sparkSession
    dealt = written(rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *order).withColumn("__range", F.spark_partition_id()), "placed")
    counts = dealt.groupBy("__range").agg(F.count("*").alias("__n"))
    before = counts.withColumn("__before", F.coalesce(F.sum("__n").over(Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    own = F.row_number().over(Window.partitionBy("__range").orderBy(*order))
    out = dealt.withColumn("__own", own).join(F.broadcast(before.select("__range", "__before")), "__range")  # a row a range
    return out.withColumn(name, (F.col("__before") + F.col("__own") + (start - 1)).cast("long")).drop("__range", "__own", "__before")


def search(files: DataFrame, text: str) -> DataFrame:
    """Files whose name or path holds the text, in any case."""
    return files.where(F.lower("file_name").contains(text.lower()) | F.lower("path").contains(text.lower()))


def appended(successes: DataFrame, failures: DataFrame) -> DataFrame:
    """Both kinds of result in the order of their index."""
    return successes.unionByName(failures, allowMissingColumns=True).orderBy("idx")


def emitted(results: DataFrame, total: int | None = None) -> Iterator[tuple[int, float, Row]]:
    """Rows one by one in the order of their index as their partitions finish, with how many came and the share of all;
    the driver holds one partition and the next."""
    whole = results.count() if total is None else total
    for done, row in enumerate(results.orderBy("idx").toLocalIterator(prefetchPartitions=True), 1):
        yield done, done / whole if whole else 0.0, row


@contextmanager
def cancellable(spark: SparkSession, name: str) -> Iterator[None]:
    """Jobs started inside by this thread can be stopped from any other one by cancel()."""
    spark.sparkContext.addJobTag(name)
    try:
        yield
    finally:
        spark.sparkContext.removeJobTag(name)


def cancel(spark: SparkSession, name: str) -> None:
    """Stops the running jobs of that name; their callers get an error, files not begun are not read."""
    spark.sparkContext.cancelJobsWithTag(name)


def run_stats(runs: DataFrame, metric: str, by: list[str], population: bool = False) -> DataFrame:
    """Mean, standard deviation (0 for one run; also that of the runs as a whole population), median, least and largest of
    a metric, in one aggregation."""
    spread: Column = F.stddev_pop(metric) if population else F.coalesce(F.stddev_samp(metric), F.lit(0.0))
    return runs.groupBy(*by).agg(F.count("*").alias("runs"), F.avg(metric).alias("mean"), spread.alias("stddev"), F.stddev_pop(metric).alias("stddev_population"), F.median(metric).alias("median"), F.min(metric).alias("least"), F.max(metric).alias("largest"))


def compared(baseline: DataFrame, candidate: DataFrame, on: str, value: str) -> DataFrame:
    """Baseline and candidate value of each metric, their difference, and that in percent (0 from a baseline of 0)."""
    a = baseline.select(on, F.col(value).alias("baseline"))
    b = candidate.select(on, F.col(value).alias("candidate"))
    delta = F.col("candidate") - F.col("baseline")
    return a.join(b, on).withColumn("delta", delta).withColumn("percent", F.when(F.col("baseline") != 0, 100 * delta / F.col("baseline")).otherwise(F.lit(0.0)))


def resource_summary(samples: DataFrame) -> DataFrame:
    """Peak and mean of sampled processor share and memory; the mean memory is a whole number; zeros without samples."""
    mean = F.coalesce(F.expr("sum(memory_kb) div count(memory_kb)"), F.lit(0))
    out = samples.agg(F.max("cpu_percent").alias("peak_cpu_percent"), F.avg("cpu_percent").alias("avg_cpu_percent"), F.max("memory_kb").alias("peak_memory_kb"), mean.cast("long").alias("avg_memory_kb"))
    return out.fillna(0.0, ["peak_cpu_percent", "avg_cpu_percent"]).fillna(0, ["peak_memory_kb"])
