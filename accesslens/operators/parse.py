"""From log lines to typed records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Settings
from ..functions.requests import abstract_request, forwarded, minute_key, percent_decode, source_class, split_request
from ..sources.formats import JsonFormat, PlainFormat, compile_json, compile_plain

SEPARATOR = "\u0001"


def once(frame: DataFrame, **columns: Column) -> DataFrame:
    """``frame`` with columns that are computed once a row.

    A generator of one row stands between: filters and projections above refer
    to its output, so that the optimizer does not copy the expressions.
    """
    made = F.explode(F.array(F.struct(*(c.alias(n) for n, c in columns.items())))).alias("made")
    return frame.select("*", made).select(*frame.columns, *(F.col(f"made.{n}") for n in columns))


def _plain_fields(line: Column, form: PlainFormat) -> dict[str, Column]:
    """All fields of a line by one regex replacement."""
    joined = F.when(line.rlike(form.regex), F.regexp_replace(line, form.regex, SEPARATOR.join(f"${i + 1}" for i in range(len(form.fields)))))
    cells = F.split(joined, SEPARATOR, -1)
    return {name: F.get(F.col("cells"), i) for i, name in enumerate(form.fields)} | {"": cells}


def parse_lines(lines: DataFrame, settings: Settings) -> DataFrame:
    """Records of ``lines`` (``value, site, server, seq`` and maybe ``file``): one row a line, bad ones marked.

    ``seq`` orders the lines of one file.  Columns: ``site, server, file, seq, minute_key, uri_abs, args_abs, method, status,
    bytes, time_ms, remote_addr, user_ip, last_cdn_ip, source, is_valid,
    invalid_reason``.  A line is valid if it fits the format, its request can be
    read, and its time and numbers are what they claim to be.
    """
    if "file" not in lines.columns:
        lines = lines.withColumn("file", F.lit(""))
    if settings.log_type == "json":
        form: JsonFormat | PlainFormat = compile_json(settings.log_format)
        rows = once(lines, cells=F.from_json("value", "map<string,string>"))
        field = lambda name: F.col("cells")[form.keys[name]] if name in form.keys else F.lit(None).cast("string")
        known = set(form.keys)
    else:
        form = compile_plain(settings.log_format, settings.methods)
        cells = _plain_fields(F.col("value"), form)
        rows = once(lines, cells=cells[""])
        field = lambda name: cells.get(name, F.lit(None).cast("string"))
        known = set(form.fields)

    methods = "|".join(settings.methods)
    if "request" in known:
        pattern = f"(?s)^({methods}) (.*?) (.*)$"
        request = field("request")
        read = request.rlike(pattern)
        method = F.when(read, F.regexp_extract(request, pattern, 1))
        uri, args = split_request(F.when(read, F.regexp_extract(request, pattern, 2)))
    else:
        method = field("request_method")
        uri, args = split_request(field("request_uri")) if "request_uri" in known else (field("uri"), F.coalesce(field("args"), F.lit("")))
        read = method.rlike(f"^({methods})$")
        method, uri = F.when(read, method), F.when(read, uri)

    rows = once(rows, method=method, raw_uri=uri, raw_args=args)
    rows = once(rows, uri=percent_decode(F.col("raw_uri")), args=percent_decode(F.col("raw_args")))
    uri_abs, args_abs = abstract_request(F.col("uri"), F.col("args"), F.col("site"), settings.rules)
    user_ip, last_cdn_ip = forwarded(field("xff"))
    rows = once(
        rows,
        uri_abs=uri_abs,
        args_abs=args_abs,
        minute_key=minute_key(field("time")),
        status=field("status").try_cast("int"),
        bytes=field("bytes").try_cast("long"),
        time_ms=(field("request_time").try_cast("decimal(18,3)") * 1000).cast("long"),
        remote_addr=field("remote_addr"),
        user_ip=user_ip,
        last_cdn_ip=last_cdn_ip,
    )
    reason = (
        F.when(F.col("cells").isNull(), "format")
        .when(F.col("uri_abs").isNull() | (F.col("uri_abs") == ""), "request")
        .when(F.col("minute_key").isNull(), "time")
        .when(F.col("status").isNull() | F.col("bytes").isNull() | F.col("time_ms").isNull(), "number")
    )
    rows = once(rows, invalid_reason=reason)
    rows = rows.withColumn("is_valid", F.col("invalid_reason").isNull())
    rows = rows.withColumn("source", F.when(F.col("is_valid"), source_class(F.col("user_ip"), F.col("last_cdn_ip"))))
    return rows.select("site", "server", "file", "seq", "minute_key", "uri_abs", "args_abs", "method", "status", "bytes", "time_ms", "remote_addr", "user_ip", "last_cdn_ip", "source", "is_valid", "invalid_reason")
