"""The minute tables as Parquet, partitioned by site, day, hour and server."""

from __future__ import annotations

import tempfile
import uuid
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.requests import retention_cutoff
from ..operators.rollup import SOURCES, TABLES, roll_up

_KEY = "minute_key string"
_SUMS = "hits long, time_ms long, bytes long"
_STATS = ", ".join(f"{q}_{kind} double" for kind in ("time_ms", "bytes") for q in ("q2", "q3", "max"))
_SOURCES = ", ".join(f"{s}_{x} long" for s in SOURCES.values() for x in ("hits", "bytes", "time_ms"))
#: Columns of the stored tables, before those of ``PLACE``.
SCHEMAS = {
    "minute_totals": f"{_KEY}, total_hits long, invalid_hits long, error_hits long, total_bytes long, total_time_ms long, {_SOURCES}, unclassified_hits long",
    "minute_uri": f"{_KEY}, uri_abs string, {_SUMS}, {_STATS}, rank int",
    "minute_args": f"{_KEY}, uri_abs string, args_abs string, {_SUMS}, {_STATS}, method string",
    "minute_error": f"{_KEY}, uri_abs string, error_code int, {_SUMS}, {_STATS}, method string",
    "minute_ip": f"{_KEY}, uri_abs string, type string, ip string, {_SUMS}, rank int",
}


#: What the stored tables are partitioned by: a server's hour is written anew as a whole.
PLACE = ["site", "day", "hour", "server"]


def with_place(rows: DataFrame) -> DataFrame:
    """``rows`` with the day and hour of their minute."""
    return rows.withColumn("day", F.substring("minute_key", 1, 8)).withColumn("hour", F.substring("minute_key", 9, 2))


def write_tables(tables: dict[str, DataFrame], root: str) -> None:
    """Write tables side by side, replacing just the partitions (a site's hour on a server) that they hold."""

    def write(name: str) -> None:
        with_place(tables[name]).repartition(*PLACE).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PLACE).parquet(f"{root}/{name}")

    with ThreadPoolExecutor(len(tables)) as pool:
        list(pool.map(write, tables))


def write_roll_up(records: DataFrame, settings: Settings, root: str, ordered: bool = False) -> None:
    """Roll up a written table of records and write the five tables.

    What they share is written once, under ``root``, and deleted at the end.
    """
    spark, work = records.sparkSession, f"{root}/_work-{uuid.uuid4().hex}"

    def stage(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{work}/{name}")
        return spark.read.schema(df.schema).parquet(f"{work}/{name}")

    try:
        write_tables(roll_up(records, settings, stage, ordered), root)
    finally:
        delete(spark, work)


_OWN: dict[str, str] = {}


def work_root(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share: under ``spark.checkpoint.dir``, or a temporary one where Spark runs in one process."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = _OWN.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="accesslens-"))
    return f"{base.rstrip('/')}/root-{uuid.uuid4().hex}"


def delete(spark: SparkSession, path: str) -> None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def read_tables(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables; filters on minutes reach the day partitions through ``day_bounds``."""
    return {name: spark.read.schema(f"{SCHEMAS[name]}, site string, day string, hour string, server string").parquet(f"{root}/{name}") for name in TABLES}


def day_bounds(table: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """``table`` limited to the days of a range of minute keys, so that other partitions are not read; as it is where it has no days."""
    if "day" in table.columns:
        if start:
            table = table.where(F.col("day") >= start[:8])
        if end:
            table = table.where(F.col("day") <= end[:8])
    return table


def apply_retention(spark: SparkSession, root: str, as_of: str, keep_days: int) -> list[str]:
    """Delete the day partitions of all tables, records and rejected lines before the ``keep_days`` days that end with ``as_of``; returns their paths."""
    cutoff = spark.range(1).select(retention_cutoff(F.lit(as_of), keep_days)).first()[0]
    gone = []
    path_of = spark._jvm.org.apache.hadoop.fs.Path
    for name in (*TABLES, "records", "rejected"):
        base = path_of(f"{root}/{name}")
        fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
        if not fs.exists(base):
            continue
        for site in fs.listStatus(base):
            if not site.isDirectory() or not site.getPath().getName().startswith("site="):
                continue
            for day in fs.listStatus(site.getPath()):
                label = day.getPath().getName()
                if label.startswith("day=") and label[4:] < cutoff:
                    fs.delete(day.getPath(), True)
                    gone.append(day.getPath().toString())
    return gone
