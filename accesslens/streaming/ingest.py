"""Incremental ingest: micro-batches of log lines into the minute tables.

Each batch is written under its load to a table of records, by site, hour and
server; then every such hour that it touches is rolled up again from all
records of that hour, whichever loads they came with.  A batch that is repeated
after a failure replaces what it wrote, so each line counts once, and servers,
files and runs add up.
"""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..config import Settings
from ..operators.parse import parse_lines
from ..operators.rollup import placed
from ..plans.store import PLACE, apply_retention, with_place, write_roll_up
from ..sources.logs import read_lines, site_of, with_line_numbers, with_splits
from ..sources.tail import LogTail

#: Columns of the records' partitions, and the day of lines whose file has no time at all.
LOADED = [*PLACE, "load"]
NO_DAY = "none"


def take_in(lines: DataFrame, settings: Settings, root: str, load: str) -> None:
    """Add the lines (``value, site, server, file, seq``) of one load; those of an earlier load of that name are replaced where it has new ones.

    Lines that no minute can be found for stay with the records, under a day of
    their own, and count with the rejected ones alone.
    """
    spark = lines.sparkSession
    rows = with_place(placed(parse_lines(lines, settings)))
    rows = rows.withColumn("day", F.coalesce("day", F.lit(NO_DAY))).withColumn("hour", F.coalesce("hour", F.lit(NO_DAY))).withColumn("load", F.lit(load))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*LOADED).parquet(f"{root}/records")
    stored = spark.read.schema(rows.schema).parquet(f"{root}/records")
    new = stored.where(F.col("load") == load)
    bad = new.where("not is_valid").groupBy("site", "day", "server", "load", "invalid_reason").agg(F.count("*").alias("lines"))
    bad.select("invalid_reason", "lines", "site", "day", "server", "load").coalesce(1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("site", "day", "server", "load").parquet(f"{root}/rejected")
    touched = new.where(F.col("day") != NO_DAY).select(*PLACE).distinct()
    again = stored.where(F.col("day") != NO_DAY).join(F.broadcast(touched), PLACE, "left_semi")
    write_roll_up(again.drop("day", "hour", "load"), settings, root, ordered=True)
    if settings.keep_days is not None:
        today = F.date_format(F.current_date(), "yyyyMMdd")
        last = touched.agg(F.least(F.max("day"), today)).first()[0]  # a line from the future drops nothing
        if last is not None:
            apply_retention(spark, root, last, settings.keep_days)


def rejected(spark: SparkSession, root: str) -> DataFrame:
    """``invalid_reason, lines, site, day, server, load``: how many lines of each load could not be read, and why."""
    return spark.read.schema("invalid_reason string, lines long, site string, day string, server string, load string").parquet(f"{root}/rejected")


def batch_writer(settings: Settings, root: str, job: str = "batch"):
    """The ``foreachBatch`` function for lines ``value, site, server, seq`` and maybe ``file``; ``job`` names what numbers the batches."""

    def write(lines: DataFrame, batch_id: int) -> None:
        take_in(lines, settings, root, f"{job}-{batch_id}")

    return write


def _run(rows: DataFrame, settings: Settings, root: str, checkpoint: str) -> StreamingQuery:
    """One run over all that is new; loads are named by the query's id, which its checkpoint keeps."""

    def write(lines: DataFrame, batch_id: int) -> None:
        job = lines.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or hashlib.sha1(checkpoint.encode()).hexdigest()
        batch_writer(settings, root, job)(with_line_numbers(lines) if "split" in lines.columns else lines, batch_id)

    return rows.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingest_files(spark: SparkSession, path: str, server: str, settings: Settings, root: str, checkpoint: str, files_per_batch: int = 100) -> StreamingQuery:
    """Take in all whole log files under ``path``, in any store that Spark reads, that the checkpoint hasn't seen, then stop."""
    lines = with_splits(spark.readStream.option("maxFilesPerTrigger", files_per_batch).text(path))
    return _run(lines.withColumn("site", site_of(F.col("file"))).withColumn("server", F.lit(server)), settings, root, checkpoint)


def follow_logs(spark: SparkSession, settings: Settings, server: str, root: str, checkpoint: str, paths: list[str] | None = None) -> StreamingQuery:
    """Take in what growing and rotated logs have got since the last run of this checkpoint, then stop.

    ``paths`` are globs, the settings' one if not given.
    """
    spark.dataSource.register(LogTail)
    reader = spark.readStream.format("logtail")
    if not paths:
        reader = reader.option("exclude", json.dumps(list(settings.exclude)))
    lines = reader.load(json.dumps(paths or [settings.log_path]))
    named = lines.withColumn("site", site_of(F.regexp_replace("file", "#[0-9]+$", ""))).withColumn("server", F.lit(server))
    return _run(named, settings, root, checkpoint)


def ingest(spark: SparkSession, settings: Settings, server: str, root: str, paths: list[str] | None = None) -> None:
    """Take in whole files in one load, named by server and paths: the same files again replace themselves, others add to them."""
    lines = read_lines(spark, settings, server, paths)
    name = json.dumps([server, sorted(paths or [settings.log_path])])
    take_in(lines, settings, root, "files-" + hashlib.sha1(name.encode()).hexdigest())


def streaming_totals(lines: DataFrame, settings: Settings, delay: str = "10 minutes") -> DataFrame:
    """Hits, errors, bytes and time by site, server and minute of a stream, for lines up to ``delay`` late."""
    records = parse_lines(lines, settings).where("is_valid").withColumn("minute", F.to_timestamp("minute_key", "yyyyMMddHHmm"))
    grouped = records.withWatermark("minute", delay).groupBy("site", "server", F.window("minute", "1 minute").alias("w"))
    sums = grouped.agg(F.count("*").alias("hits"), F.sum((F.col("status") >= 400).cast("long")).alias("error_hits"), F.sum("bytes").alias("bytes"), F.sum("time_ms").alias("time_ms"))
    return sums.select("site", "server", F.date_format("w.start", "yyyyMMddHHmm").alias("minute_key"), "hits", "error_hits", "bytes", "time_ms")
