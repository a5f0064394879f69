"""The nine questions: summary, distribution and detail of requests, addresses and errors.

All work on the minute tables.  Sums add up over minutes; ``avg_*`` columns are
plain means over minute rows.  Percents are of the totals named with each cell,
and null where such a total is zero.  Rows tied in their measure follow their
key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.requests import abstract_request, percent_decode, period, share, split_request, time_bound
from ..operators.rollup import IP_TYPES, SOURCES
from .store import day_bounds

STATS = ("q2_time_ms", "q3_time_ms", "max_time_ms", "q2_bytes", "q3_bytes", "max_bytes")


class UnknownSite(LookupError):
    """No minute of that site is stored."""


class NothingFound(LookupError):
    """No line of a site is stored in that range or of that server."""


@dataclass(frozen=True)
class Scope:
    """Which minutes count: one site, from ``start`` up to before ``end``, of one server or all."""

    site: str
    start: str | None = None
    end: str | None = None
    server: str | None = None
    #: The day meant where neither bound is given, ``yyyyMMdd``; all days, if None.
    today: str | None = None

    def of(self, table: DataFrame) -> DataFrame:
        rows = table.where(F.col("site") == self.site)
        start, end = self.start and time_bound(self.start), self.end and time_bound(self.end)
        if start:
            rows = rows.where(F.col("minute_key") >= start)
        if end:
            rows = rows.where(F.col("minute_key") < end)
        if not start and not end and self.today:
            start = end = self.today
            rows = rows.where(F.col("minute_key").startswith(self.today))
        rows = day_bounds(rows, start, end)
        return rows.where(F.col("server") == self.server) if self.server else rows


def sites(tables: dict[str, DataFrame]) -> DataFrame:
    return tables["minute_totals"].select("site").distinct()


def require_site(tables: dict[str, DataFrame], site: str) -> None:
    if not sites(tables).where(F.col("site") == site).take(1):
        raise UnknownSite(site)


def sums(names: tuple[str, ...] = ("hits", "bytes", "time_ms"), prefix: str = "") -> list[Column]:
    return [F.sum(n).cast("long").alias(f"{prefix}{n}") for n in names]


def means() -> list[Column]:
    return [F.avg(n).alias(f"avg_{n}") for n in STATS]


def totals(tables: dict[str, DataFrame], scope: Scope) -> DataFrame:
    """One row with the totals of all requests."""
    names = ("total_hits", "invalid_hits", "error_hits", "total_bytes", "total_time_ms")
    return scope.of(tables["minute_totals"]).agg(*(F.coalesce(F.sum(n), F.lit(0)).cast("long").alias(n) for n in names))


def part_totals(rows: DataFrame) -> DataFrame:
    """One row with the totals of some rows."""
    return rows.agg(*(F.coalesce(F.sum(n), F.lit(0)).cast("long").alias(f"total_{n}") for n in ("hits", "bytes", "time_ms")))


def with_shares(groups: DataFrame, total: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """``groups`` with percents of the one row of ``total``, which is a single row by its making."""
    kept = total.select(*(f"total_{n}" for n in names))
    joined = groups.crossJoin(F.broadcast(kept))
    return joined.withColumns({f"{n}_percent": share(F.col(n), F.col(f"total_{n}")) for n in names}).drop(*(f"total_{n}" for n in names))


def first(rows: DataFrame, limit: int, *order: Column | str) -> DataFrame:
    ordered = rows.orderBy(*order)
    return ordered.limit(limit) if limit else ordered


def request_summary(tables: dict[str, DataFrame], scope: Scope, by: str = "hits", limit: int = 5) -> DataFrame:
    """Requests with the most hits, bytes or time; percents of all requests."""
    if by not in ("hits", "bytes", "time_ms"):
        raise ValueError("by is hits, bytes or time_ms")
    groups = scope.of(tables["minute_uri"]).groupBy("uri_abs").agg(*sums((by,)), *means())
    return first(with_shares(groups, totals(tables, scope), (by,)), limit, F.desc(by), "uri_abs")


def request_of(text: str, scope: Scope, settings: Settings, spark) -> tuple[str, str]:
    """Abstracted URI and arguments of a request as typed, by the rules of its site."""
    uri, args = split_request(F.lit(text))
    uri, args = abstract_request(percent_decode(uri), percent_decode(args), F.lit(scope.site), settings.rules)
    row = spark.range(1).select(uri.alias("uri"), args.alias("args")).first()
    return row["uri"], row["args"]


def _distribution(rows: DataFrame, total: DataFrame, group_by: str, limit: int, names: tuple[str, ...], stats: bool) -> DataFrame:
    groups = rows.groupBy(period(F.col("minute_key"), group_by).alias("period")).agg(*sums(names), *(means() if stats else []))
    return first(with_shares(groups, total, names), limit, "period")


def request_distribution(tables: dict[str, DataFrame], scope: Scope, request: str | None = None, group_by: str = "hour", limit: int = 5, settings: Settings | None = None) -> DataFrame:
    """Hits and bytes by period, of all requests or of those like ``request``; percents of their totals."""
    names = ("hits", "bytes")
    if request is None:
        return _distribution(scope.of(tables["minute_uri"]), totals(tables, scope), group_by, limit, names, True)
    uri, args = request_of(request, scope, settings or Settings(), tables["minute_uri"].sparkSession)
    rows = scope.of(tables["minute_args" if args else "minute_uri"]).where(F.col("uri_abs") == uri)
    if args:
        rows = rows.where(F.col("args_abs") == args)
    return _distribution(rows, part_totals(rows), group_by, limit, names, True)


def _detail(rows: DataFrame, total: DataFrame, key: str, limit: int, stats: bool) -> DataFrame:
    names = ("hits", "bytes", "time_ms")
    groups = rows.groupBy(key).agg(*sums(names), *(means() if stats else []))
    return first(with_shares(groups, total, names), limit, F.desc("hits"), key)


def request_detail(tables: dict[str, DataFrame], scope: Scope, uri: str, limit: int = 5, settings: Settings | None = None) -> DataFrame:
    """Arguments of one request; percents of that request."""
    name, _ = request_of(uri, scope, settings or Settings(), tables["minute_uri"].sparkSession)
    whole = scope.of(tables["minute_uri"]).where(F.col("uri_abs") == name)
    return _detail(scope.of(tables["minute_args"]).where(F.col("uri_abs") == name), part_totals(whole), "args_abs", limit, True)


def ip_summary(tables: dict[str, DataFrame], scope: Scope, type: str, limit: int = 5) -> DataFrame:  # noqa: A002
    """Addresses of one type with the most hits; percents of all requests."""
    if type not in IP_TYPES:
        raise ValueError(f"type is one of {', '.join(IP_TYPES)}")
    return _detail(scope.of(tables["minute_ip"]).where(F.col("type") == type), totals(tables, scope), "ip", limit, False)


def source_summary(tables: dict[str, DataFrame], scope: Scope) -> DataFrame:
    """Hits, bytes and time of each source; percents of all requests."""
    rows = scope.of(tables["minute_totals"])
    parts = ", ".join(f"'{name}', {name}_hits, {name}_bytes, {name}_time_ms" for name in SOURCES.values())
    long = rows.selectExpr(f"stack({len(SOURCES)}, {parts}) as (source, hits, bytes, time_ms)")
    return _detail(long, totals(tables, scope), "source", 0, False)


def ip_distribution(tables: dict[str, DataFrame], scope: Scope, ip: str, group_by: str = "hour", limit: int = 5) -> DataFrame:
    """Hits and bytes of an address by period, whatever its type; percents of that address."""
    rows = scope.of(tables["minute_ip"]).where(F.col("ip") == ip)
    return _distribution(rows, part_totals(rows), group_by, limit, ("hits", "bytes"), False)


def ip_detail(tables: dict[str, DataFrame], scope: Scope, ip: str, limit: int = 5) -> DataFrame:
    """Requests of an address; percents of that address."""
    rows = scope.of(tables["minute_ip"]).where(F.col("ip") == ip)
    return _detail(rows, part_totals(rows), "uri_abs", limit, False)


def error_summary(tables: dict[str, DataFrame], scope: Scope, limit: int = 5) -> DataFrame:
    """Error codes with the most hits; percents of all requests."""
    return _detail(scope.of(tables["minute_error"]), totals(tables, scope), "error_code", limit, True)


def error_distribution(tables: dict[str, DataFrame], scope: Scope, error_code: int, group_by: str = "hour", limit: int = 5) -> DataFrame:
    """Hits and bytes of an error code by period; percents of that code."""
    rows = scope.of(tables["minute_error"]).where(F.col("error_code") == error_code)
    return _distribution(rows, part_totals(rows), group_by, limit, ("hits", "bytes"), True)


def error_detail(tables: dict[str, DataFrame], scope: Scope, error_code: int, limit: int = 5) -> DataFrame:
    """Requests with an error code; percents of that code."""
    rows = scope.of(tables["minute_error"]).where(F.col("error_code") == error_code)
    return _detail(rows, part_totals(rows), "uri_abs", limit, True)
