"""Roll-ups, cells, store, ingest and text on the fixture logs."""

import argparse
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from accesslens import cli, render
from accesslens.config import Settings
from accesslens.fixtures import event_rows, plain_lines
from accesslens.operators.parse import parse_lines
from accesslens.operators.rollup import placed, roll_up
from accesslens.plans import catalog, cells
from accesslens.plans.store import apply_retention, read_tables, write_roll_up, write_tables
from accesslens.sources.logs import numbered
from accesslens.sources.tail import LogTail, complete_end
from accesslens.streaming.ingest import batch_writer, ingest, ingest_files, rejected, streaming_totals

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    db = duckdb.connect()
    db.execute(f"CREATE VIEW events AS SELECT * FROM '{DATA}/events.parquet'")
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{DATA}/pages.parquet'")
    return db


@pytest.fixture(scope="module")
def records(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("records"))
    parse_lines(plain_lines(event_rows(spark.read.parquet(f"{DATA}/events.parquet"))), Settings()).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def stored(spark, records, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("store"))
    write_roll_up(records, Settings(), root)
    return root


def same(a: pd.DataFrame, b: pd.DataFrame) -> None:
    assert sorted(a.columns) == sorted(b.columns)
    names = sorted(a.columns)
    rows = lambda f: sorted(tuple(None if pd.isna(v) else float(v) if isinstance(v, float) else v for v in r) for r in f[names].astype(object).itertuples(index=False))
    assert [tuple(map(str, r)) for r in rows(a)] == [tuple(map(str, r)) for r in rows(b)]


@pytest.mark.parametrize("name", ["parse_plaintext", "parse_json", "minute_totals", "minute_uri", "minute_error", "topn_ip", "request_summary_hits", "request_dist_args_hour", "ip_summary_last_cdn_ip", "error_detail", "custom_abstraction", "nested_documents", "uri_abstract_pages"])
def test_against_sql(spark, oracle, name):
    same(catalog.queries()[name](spark, DATA).toPandas(), oracle.execute(catalog.oracle_sql()[name]).fetchdf())


def test_catalog_is_whole():
    assert set(catalog.queries()) == set(catalog.oracle_sql())
    assert set(catalog.queries()) <= set(__spark_entry__.queries())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 5


def test_invariants(spark, stored):
    t = {k: v.toPandas() for k, v in read_tables(spark, stored).items()}
    total, key = t["minute_totals"], ["site", "server", "minute_key"]
    sources = total[[c for c in total if c.startswith("from_") and c.endswith("_hits")]].sum(axis=1)
    assert (sources + total["unclassified_hits"] == total["total_hits"]).all()
    uri = t["minute_uri"].set_index([*key, "uri_abs"])["hits"].sort_index()
    args = t["minute_args"].groupby([*key, "uri_abs"])["hits"].sum().sort_index()
    assert (uri == args).all() and uri.sum() == total["total_hits"].sum()


def test_truncation(spark, records):
    small = roll_up(records, Settings(top_uris=2, top_ips=1))
    uri, args, ip = (small[n].toPandas() for n in ("minute_uri", "minute_args", "minute_ip"))
    key = ["site", "server", "minute_key"]
    assert uri.groupby(key).size().max() == 2
    assert set(map(tuple, args[[*key, "uri_abs"]].values)) == set(map(tuple, uri[[*key, "uri_abs"]].values))
    assert ip.groupby([*key, "uri_abs", "type"]).size().max() == 1


def test_lines_without_time(spark):
    rows = [("s", "w", 0, None), ("s", "w", 1, "202001010000"), ("s", "w", 2, None), ("s", "w", (1 << 21) + 5, None), ("s", "w", (1 << 22), "202001010001"), ("t", "w", 1, None)]
    frame = spark.createDataFrame(rows, "site string, server string, seq long, minute_key string")
    got = {(r["site"], r["seq"]): r["minute_key"] for r in placed(frame).collect()}
    assert got == {("s", 0): "202001010000", ("s", 1): "202001010000", ("s", 2): "202001010000", ("s", (1 << 21) + 5): "202001010000", ("s", 1 << 22): "202001010001", ("t", 1): None}


def test_store_is_idempotent_and_pruned(spark, records, stored):
    before = read_tables(spark, stored)["minute_uri"].count()
    write_tables(roll_up(records, Settings()), stored)
    assert read_tables(spark, stored)["minute_uri"].count() == before
    plan = cells.Scope(catalog.SITE, "20240102", "20240103").of(read_tables(spark, stored)["minute_uri"])._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    filters = plan[plan.index("PartitionFilters") :].splitlines()[0]
    assert "day" in filters and "site" in filters


def test_retention(spark, records, tmp_path):
    root = str(tmp_path / "store")
    write_tables(roll_up(records, Settings()), root)
    assert apply_retention(spark, root, "20240103", 2)
    assert {r[0] for r in read_tables(spark, root)["minute_totals"].select("day").distinct().collect()} == {"20240102", "20240103"}


def test_unknown_site(spark, stored):
    with pytest.raises(cells.UnknownSite):
        cells.require_site(read_tables(spark, stored), "nowhere")


def test_empty_range(spark, stored):
    tables, scope = read_tables(spark, stored), cells.Scope(catalog.SITE, "990101")
    assert cells.request_summary(tables, scope).count() == 0
    assert cells.totals(tables, scope).first()["total_hits"] == 0


def test_batches_equal_whole(spark, records, stored, tmp_path):
    lines = plain_lines(event_rows(spark.read.parquet(f"{DATA}/events.parquet")))
    write = batch_writer(Settings(keep_days=None), str(tmp_path))
    write(lines.where("seq % 2 = 0"), 0)
    write(lines.where("seq % 2 = 1"), 1)
    write(lines.where("seq % 2 = 1"), 1)  # repeated after a failure
    got = read_tables(spark, str(tmp_path))["minute_uri"].select("site", "server", "minute_key", "uri_abs", "hits", "bytes", "q3_bytes").toPandas()
    same(got, read_tables(spark, stored)["minute_uri"].select("site", "server", "minute_key", "uri_abs", "hits", "bytes", "q3_bytes").toPandas())


def test_stream_of_files(spark, tmp_path):
    logs, root = tmp_path / "logs", str(tmp_path / "root")
    logs.mkdir()
    line = '1.2.3.4 - [20/Feb/2019:01:0{}:03 +0800] "GET /a/1 HTTP/1.1" 200 5 0.031 "-" "-" - -\n'
    (logs / "shop.access.log").write_text(line.format(1) * 3)
    ingest_files(spark, str(logs), "w", Settings(), root, str(tmp_path / "ck")).awaitTermination()
    (logs / "shop.access.log.2").write_text(line.format(2))
    ingest_files(spark, str(logs), "w", Settings(), root, str(tmp_path / "ck")).awaitTermination()
    rows = read_tables(spark, root)["minute_totals"].select("site", "minute_key", "total_hits").collect()
    assert sorted(map(tuple, rows)) == [("shop_access_log", "201902200101", 3), ("shop_access_log_2", "201902200102", 1)]


def test_streaming_totals(spark, tmp_path):
    lines = plain_lines(event_rows(spark.read.parquet(f"{DATA}/events.parquet")))
    lines.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(lines.schema).parquet(str(tmp_path / "in"))
    query = streaming_totals(stream, Settings()).writeStream.format("memory").queryName("totals").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    want = parse_lines(lines, Settings()).where("is_valid").count()
    assert spark.table("totals").selectExpr("sum(hits)").first()[0] == want


def test_tail_follows_rotation(spark, tmp_path):
    log = tmp_path / "a.log"
    log.write_bytes(b"one\ntwo\npart")
    assert complete_end(str(log), 0, log.stat().st_size) == 8
    spark.dataSource.register(LogTail)

    def run():
        spark.readStream.format("logtail").load(str(tmp_path / "*.log")).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start().awaitTermination()
        return sorted((r["value"], r["seq"]) for r in spark.read.schema("value string, file string, seq long").parquet(str(tmp_path / "out")).collect())

    assert run() == [("one", 0), ("two", 4)]
    with log.open("ab") as f:
        f.write(b"ial\n")
    os.rename(log, tmp_path / "a.log.1")
    log.write_bytes(b"new\n")
    assert run() == [("new", 0), ("one", 0), ("partial", 8), ("two", 4)]


LINE = '1.2.3.4 - [20/Feb/2019:0{}:0{}:03 +0800] "GET /a/1 HTTP/1.1" 200 5 0.031 "-" "-" - -\n'


def hits(spark, root):
    return {(r["site"], r["server"], r["minute_key"]): (r["total_hits"], r["invalid_hits"]) for r in read_tables(spark, root)["minute_totals"].collect()}


def test_servers_files_and_runs_add_up(spark, tmp_path, capsys):
    """Two servers with logs of one name, growing and rotated, take in one after the other into one root."""
    root, logs = str(tmp_path / "root"), {s: tmp_path / s for s in ("web1", "web2")}
    for folder in logs.values():
        folder.mkdir()
    take = lambda server: cli.take(spark, root, server, Settings(keep_days=None), [str(logs[server] / "shop.log")])
    (logs["web1"] / "shop.log").write_text(LINE.format(1, 1) * 2 + "broken\n")
    (logs["web2"] / "shop.log").write_text(LINE.format(1, 1) * 3)
    take("web1")
    assert "shop_log: 1 lines rejected (format)" in capsys.readouterr().err
    take("web2")
    want = {("shop_log", "web1", "201902200101"): (2, 1), ("shop_log", "web2", "201902200101"): (3, 0)}
    assert hits(spark, root) == want
    with (logs["web1"] / "shop.log").open("a") as f:
        f.write(LINE.format(1, 1) + LINE.format(2, 5) + "unfinished")
    take("web1")
    want |= {("shop_log", "web1", "201902200101"): (3, 1), ("shop_log", "web1", "201902200205"): (1, 0)}
    assert hits(spark, root) == want
    os.rename(logs["web1"] / "shop.log", logs["web1"] / "shop.log.1")
    (logs["web1"] / "shop.log").write_text(LINE.format(2, 5) * 4)
    take("web1")
    take("web1")  # nothing new
    want |= {("shop_log", "web1", "201902200205"): (5, 0)}
    assert hits(spark, root) == want
    more = tmp_path / "more.log"
    more.write_text("\n".join(["no time at all"] * 2) + "\n")
    ingest(spark, Settings(keep_days=None), "web1", root, [str(more)])
    assert hits(spark, root) == want
    assert sorted((r["site"], r["day"], r["lines"]) for r in rejected(spark, root).collect()) == [("more_log", "none", 2), ("shop_log", "20190220", 1)]


def test_files_add_up_and_replace_themselves(spark, tmp_path):
    root = str(tmp_path / "root")
    one, two = tmp_path / "x" / "a.log", tmp_path / "y" / "a.log"
    for p, n in ((one, 2), (two, 3)):
        p.parent.mkdir()
        p.write_text(LINE.format(3, 3) * n)
        ingest(spark, Settings(), "w", root, [str(p)])
    one.write_text(LINE.format(3, 3) * 4)
    ingest(spark, Settings(), "w", root, [str(one)])
    assert hits(spark, root) == {("a_log", "w", "201902200303"): (7, 0)}


def test_retention_follows_ingest(spark, tmp_path):
    root, log = str(tmp_path / "root"), tmp_path / "a.log"
    for day in ("09", "18", "19"):
        log.write_text(LINE.format(3, 3).replace("20/Feb", f"{day}/Feb"))
        ingest(spark, Settings(keep_days=10), day, root, [str(log)])
    assert {r["day"] for r in read_tables(spark, root)["minute_uri"].select("day").collect()} == {"20190218", "20190219"}
    log.write_text(LINE.format(3, 3).replace("2019", "2999"))
    ingest(spark, Settings(keep_days=10_000), "w", root, [str(log)])
    assert len({r["day"] for r in read_tables(spark, root)["minute_uri"].select("day").collect()}) == 3
    assert {p.name for p in (tmp_path / "root" / "records" / "site=a_log").glob("day=*")} == {"day=20190218", "day=20190219", "day=29990220"}


def test_line_numbers(spark, tmp_path):
    """Lines of large files keep their order and get numbers of their own, whatever the splits."""
    path = tmp_path / "big.log"
    path.write_text("".join(f"{i:07d} {'x' * 60}\n" for i in range(60_000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(1 << 20))
    try:
        rows = sorted((r["seq"], r["value"][:7]) for r in numbered(spark.read.text(str(path))).collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [v for _, v in rows] == [f"{i:07d}" for i in range(60_000)] and len({s for s, _ in rows}) == 60_000


def test_command_line(spark, stored, tmp_path, capsys):
    (tmp_path / "a.log").write_text("x" * 70)
    assert cli.main(["--root", stored, "files", str(tmp_path / "a.log")]) == 0 and " 70 " in capsys.readouterr().out
    assert cli.main(["--root", stored, "show", catalog.SITE, "request", "-f", "19990101", "-t", "19990102"]) == 1 and "nothing is stored" in capsys.readouterr().err
    assert cli.main(["--root", stored, "show", "nowhere", "request"]) == 1 and "no such site" in capsys.readouterr().err


def test_today_is_shown(spark, tmp_path):
    from datetime import date

    root, log = str(tmp_path / "root"), tmp_path / "a.log"
    for stamp in (date.today().strftime("%d/%b/%Y"), "20/Feb/2019"):
        log.write_text(LINE.format(3, 3).replace("20/Feb/2019", stamp) * 2)
        ingest(spark, Settings(keep_days=None), stamp.replace("/", ""), root, [str(log)])
    show = lambda *a: cli.show(spark, root, cli.parser().parse_args(["--root", root, "show", "a_log", "request", *a]))
    assert "Total_hits:2" in show().replace(" ", "") and "Total_hits:4" in show("--all").replace(" ", "")
    assert "Total_hits:2" in show("--today", "20190220").replace(" ", "") and "Total_hits:2" in show("-f", "20190220", "-t", "20190221").replace(" ", "")


def test_text(spark, stored):
    assert render.human(2**41) == "2048.00 GB" and render.human(1023) == "1023.00 B"
    assert render.percent(None, 6) == "  null%"
    assert render.spread("123", 20) == "%50<1 %75<2 %100<3  "
    args = lambda *a: cli.parser().parse_args(["--root", stored, "show", catalog.SITE, "--all", *a])
    text = cli.show(spark, stored, args("request"))
    assert text.count("Total_") == 3 and "Invalid_hits:" in text and "uri_abs" in text
    assert "Last_cdn_ip" in cli.show(spark, stored, args("ip")) and "From_reverse_proxy" in cli.show(spark, stored, args("ip"))
    assert "error_code" in cli.show(spark, stored, args("error"))
    for a in (["request", "distribution"], ["request", "distribution", "/view/1/2/3.js?uid=1&k=2"], ["request", "detail", "/search"], ["ip", "distribution", "10.0.1.7"], ["ip", "detail", "10.0.1.7"], ["error", "distribution", "404"], ["error", "detail", "404"]):
        assert "hits(%)" in cli.show(spark, stored, args(*a, "-g", "day"))
    assert isinstance(args("request", "-l", "0"), argparse.Namespace)
