"""Command line: ``show`` answers the nine questions, ``ingest`` takes in logs.

    python -m accesslens.cli --root DIR ingest --server HOST [LOG ...]
    python -m accesslens.cli --root DIR show SITE {request,ip,error} [distribution [X] | detail X] [-f -t -l -s -g -a]

``ingest`` takes in what the logs have got since its last run for that server,
through rotations too, drops days beyond the retention and reports lines that it
could not read.  Servers share a root; each keeps a checkpoint of its own there.
"""

from __future__ import annotations

import argparse
import fcntl
import hashlib
import os
import sys
import tempfile
from dataclasses import replace
from datetime import date

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import render
from .config import SESSION, Settings
from .operators.rollup import IP_TYPES
from .plans import cells
from .plans.store import read_tables
from .sources.logs import file_stats
from .streaming.ingest import follow_logs, rejected

LOCKED, USAGE = 11, 12
SECTIONS = {"last_cdn_ip": ("From_cdn/Proxy", "from_cdn"), "user_ip_via_cdn": (None, None), "user_ip_via_proxy": ("From_reverse_proxy", "from_reverse_proxy"), "remote_addr": ("From_client_directly", "from_client_directly")}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="accesslens", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    out.add_argument("--root", required=True, help="folder of the minute tables")
    sub = out.add_subparsers(dest="command", required=True)
    take = sub.add_parser("ingest")
    take.add_argument("--server", default=os.uname().nodename)
    take.add_argument("--keep-days", type=int, default=Settings.keep_days, help="days that are kept, the last stored one included; 0 keeps all")
    take.add_argument("logs", nargs="*")
    files = sub.add_parser("files", help="sizes and times of logs")
    files.add_argument("logs", nargs="*")
    show = sub.add_parser("show")
    show.add_argument("site")
    show.add_argument("subject", choices=("request", "ip", "error"))
    show.add_argument("view", nargs="?", choices=("distribution", "detail"))
    show.add_argument("key", nargs="?")
    show.add_argument("-f", "--from", dest="start")
    show.add_argument("-t", "--to", dest="end")
    show.add_argument("-l", "--limit", type=int, default=5, help="0 means no limit")
    show.add_argument("-s", "--server")
    show.add_argument("-g", "--group_by", default="hour", choices=("minute", "ten_min", "hour", "day"))
    show.add_argument("--today", help="yyyyMMdd; the day shown where no bound is given, today if not named")
    show.add_argument("-a", "--all", action="store_true", help="all days where no bound is given")
    return out


def show(spark: SparkSession, root: str, args: argparse.Namespace, settings: Settings = Settings()) -> str:
    """The text of one cell."""
    tables = read_tables(spark, root)
    site = args.site.replace(".", "_")
    cells.require_site(tables, site)
    today = None if args.all else args.today or date.today().strftime("%Y%m%d")
    scope = cells.Scope(site, args.start, args.end, args.server, today)
    total = cells.totals(tables, scope).first()
    if not total["total_hits"] + total["invalid_hits"]:
        raise cells.NothingFound(args.site)
    part = lambda rows: cells.part_totals(rows).first()
    of = lambda name, **eq: scope.of(tables[name]).where(" and ".join(f"{k} = {v!r}" for k, v in eq.items()))
    if args.view is None:
        if args.subject == "request":
            return "\n".join(render.request_summary(by, total, cells.request_summary(tables, scope, by, args.limit).collect()) for by in ("hits", "bytes", "time_ms"))
        if args.subject == "error":
            return render.error_summary(total, cells.error_summary(tables, scope, args.limit).collect())
        sources = {r["source"]: r for r in cells.source_summary(tables, scope).collect()}
        texts = (render.ip_section(kind, SECTIONS[kind][0], sources.get(SECTIONS[kind][1]), cells.ip_summary(tables, scope, kind, args.limit).collect()) for kind in IP_TYPES)
        return "\n".join(t for t in texts if t)
    if args.key is None and not (args.subject == "request" and args.view == "distribution"):
        raise SystemExit(USAGE)
    if args.subject == "request":
        uri, query = cells.request_of(args.key, scope, settings, spark) if args.key else (None, None)
        if args.view == "detail":
            rows = cells.request_detail(tables, scope, args.key, args.limit, settings).collect()
            return render.detail(f"uri_abs: {uri}", part(of("minute_uri", uri_abs=uri)), rows, "args_abs", True, True)
        rows = cells.request_distribution(tables, scope, args.key, args.group_by, args.limit, settings).collect()
        if not args.key:
            return render.distribution("", args.group_by, total, rows)
        whole = part(of("minute_args", uri_abs=uri, args_abs=query) if query else of("minute_uri", uri_abs=uri))
        return render.distribution(f"uri_abs: {uri}" + (f"  args_abs: {query}" if query else ""), args.group_by, whole, rows)
    if args.subject == "ip":
        whole = part(of("minute_ip", ip=args.key))
        if args.view == "detail":
            return render.detail(f"IP: {args.key}", whole, cells.ip_detail(tables, scope, args.key, args.limit).collect(), "uri_abs")
        return render.distribution(f"IP: {args.key}", args.group_by, whole, cells.ip_distribution(tables, scope, args.key, args.group_by, args.limit).collect(), False, False)
    code = int(args.key)
    whole = part(of("minute_error", error_code=code))
    if args.view == "detail":
        return render.detail(f"Error_code:{code}", whole, cells.error_detail(tables, scope, code, args.limit).collect(), "uri_abs", True, False, False)
    return render.distribution(f"Error_code:{code}", args.group_by, whole, cells.error_distribution(tables, scope, code, args.group_by, args.limit).collect(), False, True, False)


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("accesslens").config("spark.sql.session.timeZone", "UTC").config(map=SESSION).getOrCreate()
    if args.command == "show":
        try:
            print(show(spark, args.root, args))
        except cells.UnknownSite as e:
            print(f"no such site: {e}", file=sys.stderr)
            return 1
        except cells.NothingFound as e:
            print(f"nothing is stored of {e} in that range", file=sys.stderr)
            return 1
        return 0
    if args.command == "files":
        for r in file_stats(spark, args.logs or Settings().log_path).orderBy("path").collect():
            print(f"{r['modified']:%Y-%m-%d %H:%M:%S}  {r['size']:>14}  {r['path']}")
        return 0
    # a lock for each root and server on this machine; runs of other servers write other partitions
    own = hashlib.sha1(f"{args.root} {args.server}".encode()).hexdigest()[:16]
    with open(os.path.join(tempfile.gettempdir(), f"accesslens-{own}.lock"), "w") as lock:
        try:
            fcntl.flock(lock, fcntl.LOCK_EX | fcntl.LOCK_NB)
        except OSError:
            print("another ingest is running", file=sys.stderr)
            return LOCKED
        take(spark, args.root, args.server, replace(Settings(), keep_days=args.keep_days or None), [os.path.abspath(p) for p in args.logs] or None)
    return 0


def take(spark: SparkSession, root: str, server: str, settings: Settings, logs: list[str] | None = None) -> None:
    """Take in what is new, and report the lines that could not be read."""
    query = follow_logs(spark, settings, server, root, f"{root}/_checkpoints/{server}", logs)
    query.awaitTermination()
    loads = [f"{query.id}-{p['batchId']}" for p in query.recentProgress]
    try:
        bad = rejected(spark, root).where(F.col("load").isin(loads)).groupBy("site", "invalid_reason").agg(F.sum("lines").alias("lines")).orderBy("site", "invalid_reason").collect()
    except AnalysisException:  # nothing has been taken in yet
        bad = []
    for r in bad:
        print(f"{r['site']}: {r['lines']} lines rejected ({r['invalid_reason']})", file=sys.stderr)


if __name__ == "__main__":
    sys.exit(main())
