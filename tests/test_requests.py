"""Column expressions on literal rows."""

import pytest
from pyspark.sql import functions as F

from accesslens.config import ArgsRule, UriRule
from accesslens.functions import requests as R
from accesslens.functions.quartiles import quartiles


def values(spark, column, rows, kind="string"):
    frame = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, x {kind}")
    return [r[0] for r in frame.orderBy("i").select(column(F.col("x"))).collect()]


URIS = {
    "/shop/2024.html": "/shop/*.html",
    "/shop/77": "/shop/*",
    "/item_5/90/81/tab_3": "/item_5/*/*/tab_3",
    "/item/90/7b/5": "/item/*/7b/*",
    "/feed/3/20240105/88": "/feed/*/*/*",
    "/9x/40": "/9x/*",
    "/3.7.css": "/*.7.css",
    "/_/-_-": "/*/*",
    "/b-2/6_1-9.xml": "/b-2/*.xml",
    "8/5": "8/*",
    "/": "/",
    "": "",
}


def test_uri(spark):
    assert values(spark, R.abstract_uri, list(URIS)) == list(URIS.values())
    assert values(spark, R.abstract_uri, [None]) == [None]


def test_args(spark):
    assert values(spark, R.abstract_args, ["cart=7&note=x9y", "k=1=2", "k=", "k", ""]) == ["cart=*&note=*", "k=*=*", "k=", "k", ""]


def test_decode(spark):
    assert values(spark, R.percent_decode, ["a+b", "%E4%BD%A0", "%zz", "100%", "%ff", "a%20b", None]) == ["a+b", "你", "%zz", "100%", "�", "a b", None]


def test_split(spark):
    both = lambda x: F.concat_ws("|", *R.split_request(x))
    assert values(spark, both, ["/a?b=1?c", "/a", "/a?"]) == ["/a|b=1?c", "/a|", "/a|"]


def test_times(spark):
    rows = ["20/Feb/2019:01:02:03 +0800", "2019-02-25T01:01:00+08:00", "31/Foo/2019:01:02:03 +0800", "", None]
    assert values(spark, R.minute_key, rows) == ["201902200102", "201902250101", None, None, None]


def test_periods(spark):
    for name, want in {"minute": "201803091654", "ten_min": "20180309165", "hour": "2018030916", "day": "20180309"}.items():
        assert values(spark, lambda x, n=name: R.period(x, n), ["201803091654"]) == [want]
    with pytest.raises(ValueError):
        R.period(F.col("x"), "week")


def test_time_bounds():
    assert R.time_bound("180314") == "20180314"
    assert R.time_bound("2018031416") == "2018031416"
    assert R.time_bound("18031416") == "2018031416"
    for bad in ("", "2018", "20180314165", "today"):
        with pytest.raises(ValueError):
            R.time_bound(bad)


def test_forwarded(spark):
    pick = lambda x: F.concat_ws("|", *R.forwarded(x), R.source_class(*R.forwarded(x)))
    rows = ["9.9.9.9, 8.8.8.8", "9.9.9.9", "-", "-, 8.8.8.8", ", 1.2.3.4", "", None, "1.1.1.1,2.2.2.2"]
    assert values(spark, pick, rows) == [
        "9.9.9.9|8.8.8.8|cdn", "9.9.9.9|9.9.9.9|proxy", "-|-|direct", "-|8.8.8.8|unclassified", "|1.2.3.4|cdn", "-|-|direct", "-|-|direct", "1.1.1.1,2.2.2.2|1.1.1.1,2.2.2.2|proxy",
    ]


def test_sizes_and_cutoff(spark):
    assert values(spark, R.human_size, [0, 1023, 1024, 1048576, 2**41], "long") == ["0.00 B", "1023.00 B", "1.00 KB", "1.00 MB", "2048.00 GB"]
    assert values(spark, lambda x: R.retention_cutoff(x, 10), ["20180315"]) == ["20180306"]


def test_quartiles(spark):
    def want(x):
        x, n = sorted(x), len(x)
        mid = lambda y: (y[len(y) // 2] + y[~(len(y) // 2)]) / 2
        if n == 1:
            return (x[0],) * 4
        return mid(x[: n // 2]), mid(x), mid(x[(n + 1) // 2 :]), x[-1]

    rows = [[(7 * i * i + 3 * n) % 101 for i in range(n)] for n in range(1, 51)]
    got = values(spark, lambda x: quartiles(F.sort_array(x)), rows, "array<int>")
    assert [tuple(map(float, g)) for g in got] == [tuple(map(float, want(r))) for r in rows]


def test_custom_rules(spark):
    tracks = UriRule(r"^/track/([a-z]+)/[0-9]+\.mp3", r"/audio/\1/*.mp3", (ArgsRule("^(quality=.+&codec=.+)", r"\1"),))
    rules = {"music": (tracks, UriRule(r"^/beta[0-9]+/search", "/beta*/search"), UriRule("^/login/done", None, (ArgsRule("^token=.+&(lang=.+)", r"token=*&\1"),)))}
    rows = [
        ("music", "/track/jazz/41.mp3", "quality=hi&codec=opus", "/audio/jazz/*.mp3", "quality=hi&codec=opus"),
        ("music", "/track/jazz/41.mp3", "t=30", "/audio/jazz/*.mp3", "t=*"),
        ("music", "/beta12/search", "q=blues", "/beta*/search", "q=blues"),
        ("music", "/login/done", "token=9f&lang=de", "/login/done", "token=*&lang=de"),
        ("books", "/beta12/search", "q=blues", "/beta12/search", "q=*"),
    ]
    frame = spark.createDataFrame([(i, *r[:3]) for i, r in enumerate(rows)], "i int, site string, uri string, args string")
    got = frame.orderBy("i").select(*R.abstract_request(F.col("uri"), F.col("args"), F.col("site"), rules)).collect()
    assert [tuple(g) for g in got] == [r[3:] for r in rows]
    assert R.java_template(r"a\1$b$2") == r"a$1\$b$2"
