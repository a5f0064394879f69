"""Named queries over the driver's tables, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import JSON_FORMAT, ArgsRule, Settings, UriRule
from ..fixtures import ROWS_SQL, event_rows, json_lines, plain_lines
from ..functions.requests import PERIODS, abstract_args, abstract_request, abstract_uri, forwarded, human_size, minute_key, percent_decode, period, retention_cutoff, source_class, split_request
from ..operators.parse import parse_lines
from ..operators.rollup import IP_TYPES, KEY, flatten_requests, minute_totals, nested, placed, roll_up, top
from . import cells
from .cells import Scope
from .store import read_tables, work_root

SITE = "shop_access_log"
Query = Callable[[SparkSession, str], DataFrame]

#: Rules of the fixture's second site.
RULES = {
    "api_access_log": (
        UriRule(r"^/api/v[0-9]+/", "/api/v*/"),
        UriRule("^/search$", None, (ArgsRule(r"^uid=[0-9]+&(k=.+)", r"uid=*&\1"),)),
        UriRule(r"^/view/([0-9]+)/[0-9]+/[0-9]+\.js", r"/seen/\1/*/*.js", (ArgsRule(r"^(k=.+)&uid=.+", r"\1&uid=*"),)),
    )
}


def records(spark: SparkSession, sf_dir: str, settings: Settings = Settings(), form: str = "plaintext") -> DataFrame:
    rows = event_rows(spark.read.parquet(f"{sf_dir}/events.parquet"))
    return parse_lines(json_lines(rows) if form == "json" else plain_lines(rows), settings)


def tables(spark: SparkSession, sf_dir: str, settings: Settings = Settings()) -> dict[str, DataFrame]:
    return roll_up(records(spark, sf_dir, settings), settings)


RECORD = ["site", "server", "seq", "minute_key", "uri_abs", "args_abs", "method", "status", "bytes", "time_ms", "remote_addr", "user_ip", "last_cdn_ip", "source"]


def _parsed(form: str) -> Query:
    settings = Settings(log_type="json", log_format=JSON_FORMAT) if form == "json" else Settings()
    return lambda spark, d: records(spark, d, settings, form).where("is_valid").select(*RECORD)


def _table(name: str) -> Query:
    return lambda spark, d: (t := tables(spark, d)[name]).select(*(F.col(c).cast("long") if c == "rank" else F.col(c) for c in t.columns))


def _cell(function, *args, scope: Scope = Scope(SITE), **options) -> Query:
    return lambda spark, d: function(tables(spark, d), scope, *args, **options)


def ingested(spark: SparkSession, d: str) -> str:
    """The root of a store that has taken in the fixture's lines: a load for each server, one of them repeated as after a failure."""
    from ..streaming.ingest import take_in

    root, settings = work_root(spark), Settings(keep_days=None)
    lines = plain_lines(event_rows(spark.read.parquet(f"{d}/events.parquet")))
    for server in ("web1", "web2", "web2", "web3"):
        take_in(lines.where(F.col("server") == server), settings, root, f"{server}-0")
    return root


def _stored(name: str) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        t = read_tables(spark, ingested(spark, d))[name].drop("day", "hour")
        return t.select(*(F.col(c).cast("long") if c == "rank" else F.col(c) for c in t.columns))

    return query


def rejected_lines(spark: SparkSession, d: str) -> DataFrame:
    from ..streaming.ingest import rejected

    return rejected(spark, ingested(spark, d)).groupBy("site", "server", "invalid_reason").agg(F.sum("lines").alias("lines"))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    path = F.regexp_replace("url", "^[a-z]+://[^/?#]*", "")
    return spark.read.parquet(f"{d}/pages.parquet").select("page_id", F.regexp_replace(path, "#.*$", "").alias("request"))


def uri_abstract_pages(spark: SparkSession, d: str) -> DataFrame:
    uri, _ = split_request(F.col("request"))
    named = _pages(spark, d).select(abstract_uri(percent_decode(uri)).alias("uri_abs"))
    return named.groupBy("uri_abs").agg(F.count("*").alias("hits"))


def args_abstract_pages(spark: SparkSession, d: str) -> DataFrame:
    _, args = split_request(F.col("request"))
    return _pages(spark, d).select("page_id", abstract_args(percent_decode(args)).alias("args_abs"))


def custom_abstraction(spark: SparkSession, d: str) -> DataFrame:
    settings = Settings(rules=RULES)
    return records(spark, d, settings).where("is_valid").groupBy("site", "uri_abs", "args_abs").agg(F.count("*").alias("hits"))


def _truncated(name: str, **caps) -> Query:
    return lambda spark, d: (t := tables(spark, d, Settings(**caps))[name]).select(*KEY, *(["uri_abs"] if name == "minute_uri" else ["uri_abs", "type", "ip"]), "hits", F.col("rank").cast("long").alias("rank"))


def source_totals(spark: SparkSession, d: str) -> DataFrame:
    valid = records(spark, d).where("is_valid")
    return valid.groupBy("site", "source").agg(F.count("*").alias("hits"), F.sum("bytes").alias("bytes"), F.sum("time_ms").alias("time_ms"))


def nested_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return flatten_requests(nested(tables(spark, d)))


def nested_documents(spark: SparkSession, d: str) -> DataFrame:
    doc = nested(tables(spark, d))
    leaves = lambda name: F.aggregate("requests", F.lit(0).cast("long"), lambda a, r: a + F.coalesce(F.size(r[name]), F.lit(0)).cast("long"))
    return doc.select(*KEY, "total_hits", F.size("requests").cast("long").alias("n_requests"), leaves("args").alias("n_args"), F.aggregate("requests", F.lit(0).cast("long"), lambda a, r: a + F.coalesce(F.when(r["errors"].isNotNull(), F.size(r["errors"])), F.lit(0)).cast("long")).alias("n_errors"))


def _values(spark: SparkSession, d: str) -> DataFrame:
    return event_rows(spark.read.parquet(f"{d}/events.parquet"))


def period_keys(spark: SparkSession, d: str) -> DataFrame:
    v = records(spark, d).where("is_valid")
    one = lambda p: v.groupBy(F.lit(p).alias("kind"), period(F.col("minute_key"), p).alias("period")).agg(F.count("*").alias("hits"))
    first, *rest = map(one, PERIODS)
    for x in rest:
        first = first.unionByName(x)
    return first


def forwarded_addresses(spark: SparkSession, d: str) -> DataFrame:
    user, last = forwarded(F.col("forwarded"))
    rows = _values(spark, d).select(user.alias("user_ip"), last.alias("last_cdn_ip"))
    return rows.withColumn("source", source_class(F.col("user_ip"), F.col("last_cdn_ip"))).groupBy("user_ip", "last_cdn_ip", "source").agg(F.count("*").alias("hits"))


def human_sizes(spark: SparkSession, d: str) -> DataFrame:
    return _values(spark, d).select("id", human_size(F.col("size") * F.col("size")).alias("human"))


def retention(spark: SparkSession, d: str) -> DataFrame:
    day = F.date_format("ts", "yyyyMMdd")
    return spark.read.parquet(f"{d}/events.parquet").select(day.alias("day"), retention_cutoff(day, 10).alias("cutoff")).distinct()


def times(spark: SparkSession, d: str) -> DataFrame:
    ts = spark.read.parquet(f"{d}/events.parquet").select("event_id", F.concat(F.date_format("ts", "dd/MMM/yyyy:HH:mm:ss"), F.lit(" +0530")).alias("a"), F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("Z")).alias("b"))
    return ts.select("event_id", minute_key(F.col("a")).alias("local_key"), minute_key(F.col("b")).alias("iso_key"))


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {
        "parse_plaintext": _parsed("plaintext"),
        "parse_json": _parsed("json"),
        "invalid_lines": lambda s, d: records(s, d).where("not is_valid").select("site", "server", "seq", "invalid_reason"),
        "error_lines": lambda s, d: records(s, d).where("is_valid and status >= 400").select("site", "server", "seq", "status"),
        "invalid_minutes": lambda s, d: placed(records(s, d)).where("not is_valid").select("site", "server", "seq", "minute_key"),
        "uri_abstract_pages": uri_abstract_pages,
        "args_abstract_pages": args_abstract_pages,
        "custom_abstraction": custom_abstraction,
        "source_class": forwarded_addresses,
        "source_totals": source_totals,
        "time_keys": times,
        "period_keys": period_keys,
        "human_size": human_sizes,
        "retention_cutoff": retention,
        "topn_uri": _truncated("minute_uri", top_uris=3),
        "topn_ip": _truncated("minute_ip", top_ips=2),
        "nested_roundtrip": nested_roundtrip,
        "nested_documents": nested_documents,
        "stored_minute_totals": _stored("minute_totals"),
        "stored_minute_uri": _stored("minute_uri"),
        "rejected_lines": rejected_lines,
        "sites": lambda s, d: cells.sites(tables(s, d)),
        "total_all": _cell(cells.totals),
        "time_range_filter": _cell(cells.totals, scope=Scope(SITE, "240102", "2024010309")),
        "server_filter": _cell(cells.totals, scope=Scope(SITE, server="web2")),
        "today_filter": _cell(cells.totals, scope=Scope(SITE, today="20240103")),
        "source_summary": _cell(cells.source_summary),
        "ip_detail": _cell(cells.ip_detail, "10.0.1.7"),
        "error_summary": _cell(cells.error_summary),
        "error_detail": _cell(cells.error_detail, 404),
        "request_detail": _cell(cells.request_detail, "/view/1/2/3.js"),
        "request_summary_unlimited": _cell(cells.request_summary, limit=0, scope=Scope("api_access_log")),
    }
    for name in ("minute_totals", "minute_uri", "minute_args", "minute_error", "minute_ip"):
        out[name] = _table(name)
    for by in ("hits", "bytes", "time_ms"):
        out[f"request_summary_{by}"] = _cell(cells.request_summary, by=by)
    for p in PERIODS:
        out[f"request_dist_all_{p}"] = _cell(cells.request_distribution, group_by=p, limit=7)
        out[f"request_dist_uri_{p}"] = _cell(cells.request_distribution, "/view/1/2/3.js", group_by=p)
        out[f"request_dist_args_{p}"] = _cell(cells.request_distribution, "/view/1/2/3.js?uid=3&k=9", group_by=p)
        out[f"ip_dist_{p}"] = _cell(cells.ip_distribution, "10.0.1.7", group_by=p)
        out[f"error_dist_{p}"] = _cell(cells.error_distribution, 404, group_by=p)
    for kind in IP_TYPES:
        out[f"ip_summary_{kind}"] = _cell(cells.ip_summary, kind)
    return out


# --- SQL ---------------------------------------------------------------------

_Q = lambda a: f"({a}[len({a}) // 2 + 1] + {a}[len({a}) - len({a}) // 2]) / 2.0"
_Q3 = lambda a: f"CASE WHEN len({a}) = 1 THEN {a}[1] / 1.0 ELSE ({a}[len({a}) - len({a}) // 2 + (len({a}) // 2) // 2 + 1] + {a}[len({a}) - (len({a}) // 2) // 2]) / 2.0 END"
_STATS = ", ".join(f"CAST({f} AS DOUBLE) AS {n}" for a, kind in (("ts", "time_ms"), ("bs", "bytes")) for f, n in ((_Q(a), f"q2_{kind}"), (_Q3(a), f"q3_{kind}"), (f"{a}[len({a})]", f"max_{kind}")))
_LISTS = "count(*) AS hits, CAST(sum(time_ms) AS BIGINT) AS time_ms, CAST(sum(bytes) AS BIGINT) AS bytes, min(seq) AS first_seq, arg_min(method, seq) AS method, list_sort(list(time_ms)) AS ts, list_sort(list(bytes)) AS bs"


def _measured(keys: str, rows: str = "v") -> str:
    return f"(SELECT {keys}, hits, time_ms, bytes, first_seq, method, {_STATS} FROM (SELECT {keys}, {_LISTS} FROM {rows} GROUP BY {keys}))"


_MINUTE = "site, server, minute_key"
_PLACED = """, o AS (SELECT *, CASE WHEN garbage THEN NULL ELSE minute END AS m FROM r),
p AS (SELECT *, coalesce(last_value(m IGNORE NULLS) OVER (PARTITION BY site, server ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
        first_value(m IGNORE NULLS) OVER (PARTITION BY site, server ORDER BY seq ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS minute_key,
        NOT garbage AND method <> 'PATCH' AS ok FROM o)"""
_SUM = lambda c, x="1": f"CAST(coalesce(sum(CASE WHEN {c} THEN {x} ELSE 0 END), 0) AS BIGINT)"
_SRC = {"cdn": "from_cdn", "proxy": "from_reverse_proxy", "direct": "from_client_directly"}
_KNOWN = "ok AND source <> 'unclassified'"
_SOURCES = ", ".join(f"{_SUM(f'ok AND source = {chr(39)}{s}{chr(39)}', x)} AS {n}_{y}" for s, n in _SRC.items() for x, y in (("1", "hits"), ("bytes", "bytes"), ("time_ms", "time_ms")))
_TOTALS = f"""(SELECT {_MINUTE}, {_SUM('ok')} AS total_hits, {_SUM('NOT ok')} AS invalid_hits, {_SUM('ok AND status >= 400')} AS error_hits,
  {_SUM(_KNOWN, 'bytes')} AS total_bytes, {_SUM(_KNOWN, 'time_ms')} AS total_time_ms, {_SOURCES}, {_SUM("ok AND source = 'unclassified'")} AS unclassified_hits FROM p GROUP BY {_MINUTE})"""
_PAIRS = """(SELECT *, 'user_ip_via_cdn' AS type, user_ip AS ip FROM v WHERE source = 'cdn' UNION ALL SELECT *, 'last_cdn_ip', last_cdn_ip FROM v WHERE source = 'cdn'
  UNION ALL SELECT *, 'user_ip_via_proxy', user_ip FROM v WHERE source = 'proxy' UNION ALL SELECT *, 'remote_addr', remote_addr FROM v WHERE source = 'direct')"""
_IPS = f"(SELECT {_MINUTE}, uri_abs, type, ip, count(*) AS hits, CAST(sum(time_ms) AS BIGINT) AS time_ms, CAST(sum(bytes) AS BIGINT) AS bytes, min(seq) AS first_seq FROM {_PAIRS} GROUP BY {_MINUTE}, uri_abs, type, ip)"
_STAT_NAMES = ", ".join(cells.STATS)
_MEANS = ", ".join(f"avg({n}) AS avg_{n}" for n in cells.STATS)


def _shares(group: str, key: str, total: str, names: tuple[str, ...], order: str, limit: int | None = 5) -> str:
    percents = ", ".join(f"g.{n} * 100.0 / nullif(t.total_{n}, 0) AS {n}_percent" for n in names)
    return f"SELECT g.*, {percents} FROM {group} g CROSS JOIN {total} t ORDER BY {order}" + (f" LIMIT {limit}" if limit else "")


def _grouped(rows: str, key: str, names: tuple[str, ...], stats: bool, where: str) -> str:
    sums = ", ".join(f"CAST(sum({n}) AS BIGINT) AS {n}" for n in names)
    return f"(SELECT {key}, {sums}{', ' + _MEANS if stats else ''} FROM {rows} WHERE {where} GROUP BY 1)"


def _part(rows: str, where: str) -> str:
    return f"(SELECT CAST(sum(hits) AS BIGINT) AS total_hits, CAST(sum(bytes) AS BIGINT) AS total_bytes, CAST(sum(time_ms) AS BIGINT) AS total_time_ms FROM {rows} WHERE {where})"


def _all(where: str) -> str:
    return "(SELECT " + ", ".join(f"CAST(coalesce(sum({n}), 0) AS BIGINT) AS {n}" for n in ("total_hits", "invalid_hits", "error_hits", "total_bytes", "total_time_ms")) + f" FROM {_TOTALS} WHERE {where})"


def oracle_sql() -> dict[str, str]:
    base, placed_sql, at = ROWS_SQL, ROWS_SQL + _PLACED, f"site = '{SITE}'"
    uri, args = _measured(f"{_MINUTE}, uri_abs"), _measured(f"{_MINUTE}, uri_abs, args_abs")
    error = _measured(f"{_MINUTE}, uri_abs, error_code", "(SELECT *, status AS error_code FROM v WHERE status >= 400)")
    rank = lambda part: f"row_number() OVER (PARTITION BY {part} ORDER BY hits DESC, first_seq) AS rank"
    hbt, hb = ("hits", "bytes", "time_ms"), ("hits", "bytes")
    one = "uri_abs = '/view/*/*/*.js'"
    out = {
        "parse_plaintext": f"{base} SELECT {', '.join(RECORD)} FROM v",
        "parse_json": f"{base} SELECT {', '.join(RECORD)} FROM v",
        "invalid_lines": f"{base} SELECT site, server, seq, CASE WHEN garbage THEN 'format' ELSE 'request' END AS invalid_reason FROM r WHERE garbage OR method = 'PATCH'",
        "error_lines": f"{base} SELECT site, server, seq, status FROM v WHERE status >= 400",
        "invalid_minutes": f"{placed_sql} SELECT site, server, seq, minute_key FROM p WHERE NOT ok",
        "source_totals": f"{base} SELECT site, source, count(*) AS hits, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(time_ms) AS BIGINT) AS time_ms FROM v GROUP BY ALL",
        "source_class": f"{base} SELECT user_ip, last_cdn_ip, source, count(*) AS hits FROM r GROUP BY ALL",
        "time_keys": "SELECT event_id, strftime(ts, '%Y%m%d%H%M') AS local_key, strftime(ts, '%Y%m%d%H%M') AS iso_key FROM events",
        "period_keys": base + " " + " UNION ALL ".join(f"SELECT '{p}' AS kind, substr(minute_key, 1, {n}) AS period, count(*) AS hits FROM v GROUP BY 2" for p, n in PERIODS.items()),
        "human_size": f"{base} SELECT id, CASE WHEN x < 1024 THEN printf('%.2f B', x) WHEN x < 1048576 THEN printf('%.2f KB', x / 1024) WHEN x < 1073741824 THEN printf('%.2f MB', x / 1048576) ELSE printf('%.2f GB', x / 1073741824) END AS human FROM (SELECT id, CAST(bytes * bytes AS DOUBLE) AS x FROM r)",
        "retention_cutoff": "SELECT DISTINCT strftime(ts, '%Y%m%d') AS day, strftime(CAST(ts AS DATE) - INTERVAL 9 DAY, '%Y%m%d') AS cutoff FROM events",
        "uri_abstract_pages": r"""WITH q AS (SELECT regexp_replace(regexp_replace(url, '^[a-z]+://[^/?#]*', ''), '#.*$', '') AS x FROM pages), u AS (SELECT split_part(x, '?', 1) AS u FROM q)
SELECT split_part(u, '/', 1) || coalesce('/' || array_to_string(list_transform(string_split(u, '/')[2:], lambda s: regexp_replace(s, '^[0-9_-]+(\.|$)', '*\1')), '/'), '') AS uri_abs, count(*) AS hits FROM u GROUP BY 1""",
        "args_abstract_pages": "WITH q AS (SELECT page_id, regexp_replace(regexp_replace(url, '^[a-z]+://[^/?#]*', ''), '#.*$', '') AS x FROM pages) SELECT page_id, regexp_replace(CASE WHEN strpos(x, '?') > 0 THEN substr(x, strpos(x, '?') + 1) ELSE '' END, '=[^&=]+', '=*', 'g') AS args_abs FROM q",
        "custom_abstraction": base
        + """, w AS (SELECT v.*, d.u, d.k FROM v JOIN d USING (id)),
x AS (SELECT site, CASE WHEN site = 'api_access_log' AND uri_abs LIKE '/api/v%' THEN '/api/v*/' || split_part(uri_abs, '/', 4) || '/' || CAST(k AS VARCHAR)
    WHEN site = 'api_access_log' AND uri_abs = '/view/*/*/*.js' THEN '/seen/' || CAST(u AS VARCHAR) || '/*/*.js' ELSE uri_abs END AS uri_abs,
  CASE WHEN site = 'api_access_log' AND uri_abs LIKE '/api/v%' THEN CASE (id // 3) % 4 WHEN 0 THEN '' WHEN 1 THEN 'uid=' || CAST(u AS VARCHAR) || '&k=' || CAST(k AS VARCHAR) WHEN 2 THEN 'k=' || CAST(k AS VARCHAR) || '&uid=' || CAST(u AS VARCHAR) ELSE 'q=a b+' || CAST(k AS VARCHAR) || '&empty=' END
    WHEN site = 'api_access_log' AND uri_abs = '/search' AND args_abs = 'uid=*&k=*' THEN 'uid=*&k=' || CAST(k AS VARCHAR)
    WHEN site = 'api_access_log' AND uri_abs = '/view/*/*/*.js' AND args_abs = 'k=*&uid=*' THEN 'k=' || CAST(k AS VARCHAR) || '&uid=*' ELSE args_abs END AS args_abs FROM w)
SELECT site, uri_abs, args_abs, count(*) AS hits FROM x GROUP BY ALL""",
        "minute_totals": f"{placed_sql} SELECT * FROM {_TOTALS}",
        "minute_uri": f"{base} SELECT {_MINUTE}, uri_abs, hits, time_ms, bytes, {_STAT_NAMES}, {rank(_MINUTE)} FROM {uri}",
        "minute_args": f"{base} SELECT {_MINUTE}, uri_abs, args_abs, hits, time_ms, bytes, {_STAT_NAMES}, method FROM {args}",
        "minute_error": f"{base} SELECT {_MINUTE}, uri_abs, error_code, hits, time_ms, bytes, {_STAT_NAMES}, method FROM {error}",
        "minute_ip": f"{base} SELECT {_MINUTE}, uri_abs, type, ip, hits, time_ms, bytes, {rank(_MINUTE + ', uri_abs, type')} FROM {_IPS}",
        "topn_uri": f"{base} SELECT * FROM (SELECT {_MINUTE}, uri_abs, hits, {rank(_MINUTE)} FROM {uri}) WHERE rank <= 3",
        "topn_ip": f"{base} SELECT * FROM (SELECT {_MINUTE}, uri_abs, type, ip, hits, {rank(_MINUTE + ', uri_abs, type')} FROM {_IPS}) WHERE rank <= 2",
        "nested_roundtrip": f"{base} SELECT {_MINUTE}, uri_abs, hits, bytes, time_ms FROM {uri}",
        "nested_documents": f"""{placed_sql} SELECT {', '.join('t.' + k for k in KEY)}, t.total_hits, coalesce(u.n, 0) AS n_requests, coalesce(a.n, 0) AS n_args, coalesce(x.n, 0) AS n_errors FROM {_TOTALS} t
LEFT JOIN (SELECT {_MINUTE}, count(*) AS n FROM {uri} GROUP BY {_MINUTE}) u USING ({_MINUTE}) LEFT JOIN (SELECT {_MINUTE}, count(*) AS n FROM {args} GROUP BY {_MINUTE}) a USING ({_MINUTE})
LEFT JOIN (SELECT {_MINUTE}, count(*) AS n FROM {error} GROUP BY {_MINUTE}) x USING ({_MINUTE})""",
        "rejected_lines": f"{base} SELECT site, server, CASE WHEN garbage THEN 'format' ELSE 'request' END AS invalid_reason, count(*) AS lines FROM r WHERE garbage OR method = 'PATCH' GROUP BY ALL",
        "sites": f"{base} SELECT DISTINCT site FROM r",
        "total_all": f"{placed_sql} SELECT * FROM {_all(at)}",
        "time_range_filter": f"{placed_sql} SELECT * FROM {_all(at + chr(32) + 'AND minute_key >= ' + repr('20240102') + ' AND minute_key < ' + repr('2024010309'))}",
        "server_filter": f"{placed_sql} SELECT * FROM {_all(at + ' AND server = ' + repr('web2'))}",
        "today_filter": f"{placed_sql} SELECT * FROM {_all(at + ' AND minute_key LIKE ' + repr('20240103%'))}",
        "source_summary": f"""{placed_sql}, s AS (SELECT * FROM (SELECT source, CAST(sum(hits) AS BIGINT) AS hits, CAST(sum(bytes) AS BIGINT) AS bytes, CAST(sum(time_ms) AS BIGINT) AS time_ms FROM (
{' UNION ALL '.join(f"SELECT '{n}' AS source, {n}_hits AS hits, {n}_bytes AS bytes, {n}_time_ms AS time_ms FROM {_TOTALS} WHERE {at}" for n in _SRC.values())}) GROUP BY source)) {_shares('s', 'source', _all(at), hbt, 'hits DESC, source', None)}""",
        "error_summary": f"{placed_sql} {_shares(_grouped(error, 'error_code', hbt, True, at), 'error_code', _all(at), hbt, 'hits DESC, error_code')}",
        "error_detail": f"{base} {_shares(_grouped(error, 'uri_abs', hbt, True, at + ' AND error_code = 404'), 'uri_abs', _part(error, at + ' AND error_code = 404'), hbt, 'hits DESC, uri_abs')}",
        "ip_detail": f"{base} {_shares(_grouped(_IPS, 'uri_abs', hbt, False, at + ' AND ip = ' + repr('10.0.1.7')), 'uri_abs', _part(_IPS, at + ' AND ip = ' + repr('10.0.1.7')), hbt, 'hits DESC, uri_abs')}",
        "request_detail": f"{base} {_shares(_grouped(args, 'args_abs', hbt, True, f'{at} AND {one}'), 'args_abs', _part(uri, f'{at} AND {one}'), hbt, 'hits DESC, args_abs')}",
    }
    for name in ("minute_totals", "minute_uri"):
        out[f"stored_{name}"] = out[name]
    for by in hbt:
        out[f"request_summary_{by}"] = f"{placed_sql} {_shares(_grouped(uri, 'uri_abs', (by,), True, at), 'uri_abs', _all(at), (by,), f'{by} DESC, uri_abs')}"
    other = "site = 'api_access_log'"
    out["request_summary_unlimited"] = f"{placed_sql} {_shares(_grouped(uri, 'uri_abs', ('hits',), True, other), 'uri_abs', _all(other), ('hits',), 'hits DESC, uri_abs', None)}"
    for p, n in PERIODS.items():
        key = f"substr(minute_key, 1, {n}) AS period"
        some, ip, code = f"{at} AND {one}", f"{at} AND ip = '10.0.1.7'", f"{at} AND error_code = 404"
        with_args = f"{some} AND args_abs = 'uid=*&k=*'"
        out[f"request_dist_all_{p}"] = f"{placed_sql} {_shares(_grouped(uri, key, hb, True, at), 'period', _all(at), hb, 'period', 7)}"
        out[f"request_dist_uri_{p}"] = f"{base} {_shares(_grouped(uri, key, hb, True, some), 'period', _part(uri, some), hb, 'period')}"
        out[f"request_dist_args_{p}"] = f"{base} {_shares(_grouped(args, key, hb, True, with_args), 'period', _part(args, with_args), hb, 'period')}"
        out[f"ip_dist_{p}"] = f"{base} {_shares(_grouped(_IPS, key, hb, False, ip), 'period', _part(_IPS, ip), hb, 'period')}"
        out[f"error_dist_{p}"] = f"{base} {_shares(_grouped(error, key, hb, True, code), 'period', _part(error, code), hb, 'period')}"
    for kind in IP_TYPES:
        out[f"ip_summary_{kind}"] = f"{placed_sql} {_shares(_grouped(_IPS, 'ip', hbt, False, at + ' AND type = ' + repr(kind)), 'ip', _all(at), hbt, 'hits DESC, ip')}"
    return out
