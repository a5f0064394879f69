"""Reads log lines with their site, server and place in the file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings


def site_of(path: Column) -> Column:
    """The site of a log file: its base name with ``.`` as ``_``."""
    return F.replace(F.regexp_extract(path, r"([^/]*)$", 1), F.lit("."), F.lit("_"))


def read_lines(spark: SparkSession, settings: Settings, server: str | Column, paths: Sequence[str] | None = None) -> DataFrame:
    """``value, site, server, file, seq`` of all files of the settings' glob, or of ``paths``.

    Files named in ``exclude`` are left out of the glob.
    """
    frame = spark.read.text(list(paths) if paths else settings.log_path)
    rows = numbered(frame)
    if not paths and settings.exclude:
        rows = rows.where(~F.regexp_extract("file", r"([^/]*)$", 1).isin(*settings.exclude))
    owner = F.lit(server) if isinstance(server, str) else server
    return rows.withColumn("site", site_of(F.col("file"))).withColumn("server", owner)


#: Bytes that two splits of a file are apart at least, and bits for the lines of a task.
SPLIT_BITS, LINE_BITS = 20, 33


def numbered(frame: DataFrame) -> DataFrame:
    """``value, file, seq`` of lines that Spark's text source has read; ``seq`` orders the lines of a file and is theirs alone.

    It is made of the place of the line's split in the file and of the line's
    number in its task, in which a split's lines stand in order.
    """
    return with_line_numbers(with_splits(frame))


def with_splits(frame: DataFrame) -> DataFrame:
    """``value, file, split``: what a stream can tell of its lines."""
    split = F.shiftleft(F.shiftright(F.col("_metadata.file_block_start"), SPLIT_BITS), LINE_BITS)
    return frame.select("value", F.col("_metadata.file_path").alias("file"), split.alias("split"))


def with_line_numbers(lines: DataFrame) -> DataFrame:
    """``seq`` in place of ``split``, for lines of a batch."""
    line = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << LINE_BITS) - 1))
    return lines.withColumn("seq", F.col("split") + line).drop("split")


def file_stats(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``path, size, modified`` of files, without reading them."""
    found = spark.read.format("binaryFile").load(paths if isinstance(paths, str) else list(paths))
    return found.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
