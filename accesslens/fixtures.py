"""Access logs made from the driver's ``events``, by integer and string arithmetic alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _pick(index: Column, values: list[Column]) -> Column:
    out = values[-1]
    for i, v in reversed(list(enumerate(values[:-1]))):
        out = F.when(index == i, v).otherwise(out)
    return out


def event_rows(events: DataFrame) -> DataFrame:
    """Fields of one request for each event."""
    i, u, et = F.col("event_id"), F.col("user_id"), F.col("event_type")
    k = F.get_json_object("props", "$.k").cast("long")
    div = lambda n: F.floor(i / n)
    text = lambda c: c.cast("string")
    minute = F.concat(F.lit("2024010"), text(F.dayofmonth("ts") % 3 + 1), F.when(F.hour("ts") < 12, "09").otherwise("21"), _pick(div(5) % 4, [F.lit(x) for x in ("03", "04", "15", "59")]))
    uri = _pick(div(7) % 6, [F.concat(F.lit("/"), et, F.lit("/"), text(u), F.lit(".html")), F.concat(F.lit("/api/v"), text(u % 3), F.lit("/"), et, F.lit("/"), text(k)), F.concat(F.lit("/view/"), text(u), F.lit("/"), text(k), F.lit("/"), text(i), F.lit(".js")), F.concat(F.lit("/static/a_"), text(k % 4), F.lit(".css")), F.concat(F.lit("/"), et, F.lit("/%E4%BD%A0/"), text(k)), F.lit("/search")])
    query = _pick(div(3) % 4, [F.lit(""), F.concat(F.lit("?uid="), text(u), F.lit("&k="), text(k)), F.concat(F.lit("?k="), text(k), F.lit("&uid="), text(u)), F.concat(F.lit("?q=a%20b+"), text(k), F.lit("&empty="))])
    status = F.when(et == "error", _pick(k % 4, [F.lit(x) for x in (404, 500, 502, 499)])).when(i % 11 == 0, 304).otherwise(200)
    xff = F.when(k == 4, "-, 198.51.100.1").when(k % 5 == 0, "-").when(k % 5 == 1, F.concat(F.lit("10.0."), text(u % 4), F.lit(".7"))).otherwise(F.concat(F.lit("10.1.0."), text(u % 12), F.lit(", 203.0.113."), text(k % 8)))
    return events.select(
        i.alias("id"),
        ((minute.cast("long") - 202401000000) * 1000000000 + i).alias("seq"),
        minute.alias("minute"),
        F.when(div(2) % 2 == 0, "shop_access_log").otherwise("api_access_log").alias("site"),
        F.concat(F.lit("web"), text(i % 3 + 1)).alias("server"),
        F.when(i % 97 == 0, "PATCH").when(i % 5 == 0, "POST").otherwise("GET").alias("verb"),
        uri.alias("path"),
        query.alias("query"),
        status.alias("code"),
        (u * 131 + k * 17 + i % 1009).alias("size"),
        ((i * 37 + k * 11) % 3000).alias("ms"),
        xff.alias("forwarded"),
        F.concat(F.lit("192.168.0."), text(u % 20)).alias("client"),
        (i % 251 == 0).alias("garbage"),
    )


def plain_lines(rows: DataFrame) -> DataFrame:
    """The rows as lines of the default plaintext format."""
    stamp = F.concat(F.date_format(F.to_timestamp(F.concat("minute", F.lpad((F.col("id") % 60).cast("string"), 2, "0")), "yyyyMMddHHmmss"), "dd/MMM/yyyy:HH:mm:ss"), F.lit(" +0800"))
    seconds = F.concat(F.floor(F.col("ms") / 1000).cast("string"), F.lit("."), F.lpad((F.col("ms") % 1000).cast("string"), 3, "0"))
    line = F.concat(F.col("client"), F.lit(" - ["), stamp, F.lit('] "'), F.col("verb"), F.lit(" "), F.col("path"), F.col("query"), F.lit(' HTTP/1.1" '), F.col("code").cast("string"), F.lit(" "), F.col("size").cast("string"), F.lit(" "), seconds, F.lit(' "-" "Mozilla \\"q\\" 5.0" - '), F.col("forwarded"))
    return rows.select(F.when(F.col("garbage"), F.concat(F.lit("~~ "), F.col("id").cast("string"))).otherwise(line).alias("value"), "site", "server", "seq")


def json_lines(rows: DataFrame) -> DataFrame:
    """The rows as lines of the documented JSON format; arguments without their question mark."""
    stamp = F.concat(F.date_format(F.to_timestamp("minute", "yyyyMMddHHmm"), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+08:00"))
    seconds = F.concat(F.floor(F.col("ms") / 1000).cast("string"), F.lit("."), F.lpad((F.col("ms") % 1000).cast("string"), 3, "0"))
    cell = F.to_json(F.struct(stamp.alias("timestamp"), F.col("client").alias("remote_addr"), F.lit("https").alias("scheme"), F.col("verb").alias("method"), F.col("path").alias("uri"), F.substring("query", 2, 1000).alias("args"), seconds.alias("request_time"), F.col("code").cast("string").alias("status"), F.col("size").cast("string").alias("body_bytes_sent"), F.col("forwarded").alias("http_x_forwarded_for")))
    return rows.select(F.when(F.col("garbage"), '{"broken').otherwise(cell).alias("value"), "site", "server", "seq")


#: The same rows in SQL, parsed by their rules and not from lines.
ROWS_SQL = """
WITH e AS (SELECT event_id AS id, user_id AS u, event_type AS et, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, ts FROM events),
d AS (SELECT *, '2024010' || CAST(day(ts) % 3 + 1 AS VARCHAR) || CASE WHEN hour(ts) < 12 THEN '09' ELSE '21' END
        || CASE (id // 5) % 4 WHEN 0 THEN '03' WHEN 1 THEN '04' WHEN 2 THEN '15' ELSE '59' END AS minute FROM e),
r AS (SELECT id, (CAST(minute AS BIGINT) - 202401000000) * 1000000000 + id AS seq, minute,
        CASE WHEN (id // 2) % 2 = 0 THEN 'shop_access_log' ELSE 'api_access_log' END AS site,
        'web' || CAST(id % 3 + 1 AS VARCHAR) AS server,
        CASE WHEN id % 97 = 0 THEN 'PATCH' WHEN id % 5 = 0 THEN 'POST' ELSE 'GET' END AS method,
        CASE (id // 7) % 6 WHEN 0 THEN '/' || et || '/*.html' WHEN 1 THEN '/api/v' || CAST(u % 3 AS VARCHAR) || '/' || et || '/*' WHEN 2 THEN '/view/*/*/*.js'
          WHEN 3 THEN '/static/a_' || CAST(k % 4 AS VARCHAR) || '.css' WHEN 4 THEN '/' || et || '/你/*' ELSE '/search' END AS uri_abs,
        CASE (id // 3) % 4 WHEN 0 THEN '' WHEN 1 THEN 'uid=*&k=*' WHEN 2 THEN 'k=*&uid=*' ELSE 'q=*&empty=' END AS args_abs,
        CAST(CASE WHEN et = 'error' THEN CASE k % 4 WHEN 0 THEN 404 WHEN 1 THEN 500 WHEN 2 THEN 502 ELSE 499 END WHEN id % 11 = 0 THEN 304 ELSE 200 END AS INTEGER) AS status,
        u * 131 + k * 17 + id % 1009 AS bytes, (id * 37 + k * 11) % 3000 AS time_ms,
        '192.168.0.' || CAST(u % 20 AS VARCHAR) AS remote_addr,
        CASE WHEN k = 4 THEN '-' WHEN k % 5 = 0 THEN '-' WHEN k % 5 = 1 THEN '10.0.' || CAST(u % 4 AS VARCHAR) || '.7' ELSE '10.1.0.' || CAST(u % 12 AS VARCHAR) END AS user_ip,
        CASE WHEN k = 4 THEN '198.51.100.1' WHEN k % 5 = 0 THEN '-' WHEN k % 5 = 1 THEN '10.0.' || CAST(u % 4 AS VARCHAR) || '.7' ELSE '203.0.113.' || CAST(k % 8 AS VARCHAR) END AS last_cdn_ip,
        CASE WHEN k = 4 THEN 'unclassified' WHEN k % 5 = 0 THEN 'direct' WHEN k % 5 = 1 THEN 'proxy' ELSE 'cdn' END AS source,
        id % 251 = 0 AS garbage FROM d),
v AS (SELECT *, minute AS minute_key FROM r WHERE NOT garbage AND method <> 'PATCH')"""
