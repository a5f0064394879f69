"""Log formats: compilation, validation and parsing of odd lines."""

import re

import pytest

from accesslens.config import JSON_FORMAT, PLAIN_FORMAT, Settings
from accesslens.operators.parse import parse_lines
from accesslens.sources.formats import FormatError, compile_json, compile_plain

METHODS = Settings().methods


def test_compile_plain():
    form = compile_plain(PLAIN_FORMAT, METHODS)
    line = '1.2.3.4 - [20/Feb/2019:01:02:03 +0800] "GET /a?b=1 HTTP/1.1" 200 5 0.031 "-" "M "q" 5" - 9.9.9.9, 8.8.8.8'
    got = dict(zip(form.fields, re.match(form.regex, line).groups(), strict=True))
    assert got["request"] == "GET /a?b=1 HTTP/1.1" and got["xff"] == "9.9.9.9, 8.8.8.8" and got["http_user_agent"] == 'M "q" 5'


def test_literals_and_unknown_variables():
    form = compile_plain("($remote_addr) $what|$time_iso8601 $request_method $request_uri $status.$bytes_sent $request_time", METHODS)
    assert re.match(form.regex, "(h) zz|2019-02-25T01:01:00+08:00 GET /x 200.7 0.1").groups() == ("h", "2019-02-25T01:01:00+08:00", "GET", "/x", "200", "7", "0.1")


def test_validation():
    with pytest.raises(FormatError):
        compile_plain(PLAIN_FORMAT.replace("$status ", ""), METHODS)
    with pytest.raises(FormatError):
        compile_json({k: v for k, v in JSON_FORMAT.items() if v != "$args"})
    assert compile_json(JSON_FORMAT).keys["time"] == "timestamp"


def lines(spark, rows):
    return spark.createDataFrame([(r, "s", "w", i) for i, r in enumerate(rows)], "value string, site string, server string, seq long")


def test_bad_lines(spark):
    good = '1.2.3.4 - [20/Feb/2019:01:02:03 +0800] "GET /a/1?b=1 HTTP/1.1" 200 5 0.031 "-" "-" - -'
    rows = [good, good.replace("GET", "PATCH"), good.replace(" 200 ", " x "), good.replace("Feb", "Foo"), "", None, good.replace("/a/1?b=1", "")]
    got = parse_lines(lines(spark, rows), Settings()).orderBy("seq").collect()
    assert [g["invalid_reason"] for g in got] == [None, "request", "number", "time", "format", "format", "request"]
    assert (got[0]["uri_abs"], got[0]["args_abs"], got[0]["time_ms"], got[0]["source"]) == ("/a/*", "b=*", 31, "direct")


def test_json_variants(spark):
    spec = {"t": "$time_local", "a": "$remote_addr", "r": "$request", "rt": "$request_time", "s": "$status", "b": "$bytes_sent"}
    rows = ['{"t":"20/Feb/2019:01:02:03 +0800","a":"h","r":"POST /x/2 HTTP/1.0","rt":0.5,"s":404,"b":7}', "{", "[]"]
    got = parse_lines(lines(spark, rows), Settings(log_type="json", log_format=spec)).orderBy("seq").collect()
    assert [g["is_valid"] for g in got] == [True, False, False]
    assert (got[0]["method"], got[0]["status"], got[0]["time_ms"], got[0]["source"]) == ("POST", 404, 500, "direct")
