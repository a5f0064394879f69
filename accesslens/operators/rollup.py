"""Minute roll-ups: five flat tables keyed by site, server and minute.

Times are whole milliseconds and sums are integers, so results don't depend on
the order of rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.quartiles import quartiles

KEY = ["site", "server", "minute_key"]
SOURCES = {"cdn": "from_cdn", "proxy": "from_reverse_proxy", "direct": "from_client_directly"}
IP_TYPES = ("last_cdn_ip", "user_ip_via_cdn", "user_ip_via_proxy", "remote_addr")
TABLES = ("minute_totals", "minute_uri", "minute_args", "minute_error", "minute_ip")


#: Line numbers that one window orders together.
BLOCK = 1 << 20


def placed(records: DataFrame) -> DataFrame:
    """Lines without a time get that of the last line before them in their file that has one (of the first one after, at the start).

    Lines are ordered within blocks of line numbers; what a block takes over
    from those before it comes from one row a block, so no task orders a whole
    file.
    """
    if "file" not in records.columns:
        return placed(records.withColumn("file", F.lit(""))).drop("file")
    file = ["site", "server", "file"]
    has, minute = F.col("minute_key").isNotNull(), F.col("minute_key").cast("long")
    slim = records.select(*file, "seq", minute.alias("minute"), F.floor(F.col("seq") / BLOCK).alias("block"))
    seq = F.when(F.col("minute").isNotNull(), F.col("seq"))
    ends = slim.groupBy(*file, "block").agg(F.max_by("minute", seq).alias("last"), F.min_by("minute", seq).alias("first"), F.max(F.col("minute").isNull().cast("int")).alias("lacks"))
    order = Window.partitionBy(*file).orderBy("block")
    before, after = F.last("last", True).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.first("first", True).over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    carried = ends.select(*file, "block", "lacks", before.alias("carried"), after.alias("coming")).where("lacks = 1").drop("lacks")
    within = F.last("minute", True).over(Window.partitionBy(*file, "block").orderBy("seq"))
    lost = slim.join(carried, [*file, "block"]).withColumn("within", within).where("minute is null")
    found = lost.groupBy(*file, "seq").agg(F.max(F.coalesce("within", "carried", "coming")).alias("found"))
    named = records.where(~has).join(found, [*file, "seq"], "left").withColumn("minute_key", F.lpad(F.col("found").cast("string"), 12, "0"))
    return records.where(has).unionByName(named.select(*records.columns))


def minute_totals(records: DataFrame) -> DataFrame:
    """Hits (valid lines), invalid and error hits, and hits, bytes and time of each source.

    Bytes and time are the sums over the three sources; unclassified requests
    count as hits alone, and apart.  Invalid lines carry no time: they are
    counted under the minute they were placed in, if they were.
    """
    valid = F.col("is_valid")
    count = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    add = lambda c, x: F.sum(F.when(c, F.col(x)).otherwise(0)).cast("long")
    known = F.col("source").isin(*SOURCES)
    sums = [count(valid).alias("total_hits"), count(~valid).alias("invalid_hits"), count(valid & (F.col("status") >= 400)).alias("error_hits"), add(known, "bytes").alias("total_bytes"), add(known, "time_ms").alias("total_time_ms")]
    for source, name in SOURCES.items():
        own = F.col("source") == source
        sums += [count(own).alias(f"{name}_hits"), add(own, "bytes").alias(f"{name}_bytes"), add(own, "time_ms").alias(f"{name}_time_ms")]
    sums.append(count(F.col("source") == "unclassified").alias("unclassified_hits"))
    return records.groupBy(*KEY).agg(*sums)


def grains(records: DataFrame, keys: list[str]) -> DataFrame:
    """Hits, sums, the method of the first line and all times and sizes by ``keys``.

    A group is one request class in one minute of one server.
    """
    first = F.struct("seq", "file") if "file" in records.columns else F.col("seq")
    return records.groupBy(*keys).agg(F.count("*").alias("hits"), F.sum("time_ms").alias("time_ms"), F.sum("bytes").alias("bytes"), F.min("seq").alias("first_seq"), F.min_by("method", first).alias("method"), F.collect_list("time_ms").alias("times"), F.collect_list("bytes").alias("sizes"))


def regrouped(grain: DataFrame, keys: list[str]) -> DataFrame:
    """Grains by fewer ``keys``, without the method."""
    sums = [F.sum(c).alias(c) for c in ("hits", "time_ms", "bytes")]
    return grain.groupBy(*keys).agg(*sums, F.min("first_seq").alias("first_seq"), *(F.flatten(F.collect_list(c)).alias(c) for c in ("times", "sizes")))


def measured(grain: DataFrame, keys: list[str], method: bool = False) -> DataFrame:
    """Grains with quartiles and maxima instead of all values."""
    q = grain.withColumn("qt", quartiles(F.sort_array("times"))).withColumn("qb", quartiles(F.sort_array("sizes")))
    stats = [F.col(f"{c}.{f}").cast("double").alias(n) for c, kind in (("qt", "time_ms"), ("qb", "bytes")) for f, n in (("q2", f"q2_{kind}"), ("q3", f"q3_{kind}"), ("max", f"max_{kind}"))]
    return q.select(*keys, "hits", "time_ms", "bytes", *stats, "first_seq", *(["method"] if method else []))


def top(rows: DataFrame, keys: list[str], n: int | None, *ties: Column | str) -> DataFrame:
    """The ``n`` rows with the most hits of each group, with their ``rank``."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("hits"), *ties)))
    return ranked if n is None else ranked.where(F.col("rank") <= n)


def address_rows(records: DataFrame) -> DataFrame:
    """One row for each address of a request: two for those through a CDN."""
    pair = lambda kind, ip: F.struct(F.lit(kind).alias("type"), F.col(ip).alias("ip"))
    cdn, proxy, direct = (F.col("source") == s for s in SOURCES)
    pairs = F.when(cdn, F.array(pair("user_ip_via_cdn", "user_ip"), pair("last_cdn_ip", "last_cdn_ip"))).when(proxy, F.array(pair("user_ip_via_proxy", "user_ip"))).when(direct, F.array(pair("remote_addr", "remote_addr")))
    return records.select(*KEY, "uri_abs", "seq", "bytes", "time_ms", F.explode(pairs).alias("x")).select(*KEY, "uri_abs", "seq", "bytes", "time_ms", "x.type", "x.ip")


def roll_up(records: DataFrame, settings: Settings, stage: Callable[[DataFrame, str], DataFrame] = lambda df, name: df, ordered: bool = False) -> dict[str, DataFrame]:
    """The five tables of parsed records.

    Only a minute's ``top_uris`` requests with the most hits are kept, and what
    belongs to them; of their addresses, ``top_ips`` of each type.  ``stage``
    may write what several tables share, the values by request and arguments and
    the requests that are kept, and read it again.  ``ordered`` says that lines
    without a time have got one already.
    """
    valid = records.where("is_valid")
    at = [*KEY, "uri_abs"]
    grain = stage(grains(valid, [*at, "args_abs"]), "grains")
    uri = stage(top(measured(regrouped(grain, at), at), KEY, settings.top_uris, "first_seq", "uri_abs"), "uris")
    args = measured(grain, [*at, "args_abs"], method=True)
    failed = grains(valid.where("status >= 400").withColumnRenamed("status", "error_code"), [*at, "error_code"])
    error = measured(failed, [*at, "error_code"], method=True)
    ips = address_rows(valid).groupBy(*at, "type", "ip").agg(F.count("*").alias("hits"), F.sum("time_ms").alias("time_ms"), F.sum("bytes").alias("bytes"), F.min("seq").alias("first_seq"))
    if settings.top_uris is not None:
        kept = uri.select(*at)
        args, error, ips = (t.join(kept, at, "left_semi") for t in (args, error, ips))
    ip = top(ips, [*at, "type"], settings.top_ips, "first_seq", "ip")
    tables = {"minute_totals": minute_totals(records if ordered else placed(records)), "minute_uri": uri, "minute_args": args, "minute_error": error, "minute_ip": ip}
    return {name: t.drop("first_seq") for name, t in tables.items()}


def nested(tables: dict[str, DataFrame]) -> DataFrame:
    """One document a minute: totals with an array of requests, each with its arguments, errors and addresses."""
    at = [*KEY, "uri_abs"]
    leaf = lambda t, name: t.groupBy(*at).agg(F.sort_array(F.collect_list(F.struct(*[c for c in t.columns if c not in at]))).alias(name))
    uri = tables["minute_uri"]
    for name, table in (("args", "minute_args"), ("errors", "minute_error"), ("ips", "minute_ip")):
        uri = uri.join(leaf(tables[table], name), at, "left")
    requests = uri.groupBy(*KEY).agg(F.sort_array(F.collect_list(F.struct("rank", *[c for c in uri.columns if c not in (*KEY, "rank")]))).alias("requests"))
    return tables["minute_totals"].join(requests, KEY, "left")


def flatten_requests(documents: DataFrame) -> DataFrame:
    """The request rows of documents; reads just the leaves it returns."""
    names = ["uri_abs", "hits", "bytes", "time_ms"]
    zipped = F.explode(F.arrays_zip(*(F.col(f"requests.{n}").alias(n) for n in names))).alias("x")
    return documents.select(*KEY, zipped).select(*KEY, *(F.col(f"x.{n}") for n in names))
