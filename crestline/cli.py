"""python -m crestline.cli DIRECTORY: analyses the audio files of a directory and writes a report."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from crestline.functions import describe
from crestline.operators import batches, report, tracks
from crestline.schema import check_options
from crestline.sources import files as audio


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="crestline", description=__doc__)
    parser.add_argument("directory")
    parser.add_argument("--deep", action="store_true", help="with subdirectories")
    parser.add_argument("--exclude-lfe", action="store_true", help="leave low-frequency channels out")
    parser.add_argument("--silence-db", type=float, help="drop windows below this level")
    parser.add_argument("--json", help="a folder for one JSON report per file")
    parser.add_argument("--reports", help="a folder for one text report per file")
    parser.add_argument("--output", help="report file; else standard output")
    given = parser.parse_args(args)
    try:
        check_options(silence_db=given.silence_db)
    except ValueError as e:
        print(e, file=sys.stderr)
        return 2
    spark = SparkSession.builder.appName("crestline").getOrCreate()
    files, found = audio.analyse(spark, given.directory, given.deep, given.silence_db)
    files = files.withColumn("track_id", F.col("path"))
    channels = tracks.with_exclusions(found, files.where("error IS NULL"))
    whole = tracks.track_dr(channels, given.exclude_lfe)
    kind = describe.error_category(F.col("error_kind"))
    results = files.join(whole, "track_id", "left").select(
        "path", describe.file_name(F.col("path")).alias("file_name"), F.when(F.col("error_kind").isNotNull(), kind).alias("error_category"),
        "official_dr", "precise_dr", "excluded_channels", "excluded_lfe", F.col("path").alias("idx"),
    )
    text = report.batch_report(results, batches.batch_summary(results), batches.error_groups(results), batches.ranked_warnings(whole.where("official_dr IS NOT NULL")))
    if given.reports:
        formats = files.where("error IS NULL").withColumn("sample_count", F.col("actual_frames"))
        report.write_reports(report.compact_reports(channels, whole, formats, notes=report.run_notes(formats)), given.reports)
    if given.json:
        report.json_reports(channels, whole, given.exclude_lfe, files.where("error IS NULL").withColumn("sample_count", F.col("actual_frames"))).write.mode("overwrite").json(given.json)
    if given.output:
        with open(given.output, "w", encoding="utf-8") as out:
            out.write(text)
    else:
        print(text)
    return max((r["code"] for r in files.select(describe.exit_code(F.col("error_kind")).alias("code")).distinct().collect()), default=0)


if __name__ == "__main__":
    sys.exit(main())
