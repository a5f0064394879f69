"""Fixed-width text of the nine cells; works on rows that are limited already."""

from __future__ import annotations

from collections.abc import Iterable

RULE = "=" * 20
#: Labels, alignments and widths of columns (``r``, ``l`` or ``c``).
TIMES, SIZES = ("time_distribution(s)", 30), ("bytes_distribution(B)", 36)


def human(n: float) -> str:
    for unit in ("B", "KB", "MB"):
        if n < 1024:
            return f"{n:.2f} {unit}"
        n /= 1024
    return f"{n:.2f} GB"


def percent(x: float | None, width: int) -> str:
    return ("null" if x is None else f"{x:.2f}").rjust(width) + "%"


def seconds(ms: float) -> str:
    return str(round(ms / 1000, 2))


def spread(values: Iterable[str], width: int) -> str:
    low, mid, high = values
    return f"%50<{low} %75<{mid} %100<{high}".ljust(width)


def time_spread(row) -> str:
    return spread((seconds(row[f"avg_{n}_time_ms"]) for n in ("q2", "q3", "max")), TIMES[1])


def size_spread(row) -> str:
    return spread((str(int(row[f"avg_{n}_bytes"])) for n in ("q2", "q3", "max")), SIZES[1])


def heads(*columns: tuple[str, int]) -> list[str]:
    return [name.rjust(width) for name, width in columns]


def spreads(times: bool, sizes: bool) -> list[str]:
    return [name.center(width) for on, (name, width) in ((times, TIMES), (sizes, SIZES)) if on]


def table(head: list[str], rows: Iterable[list[str]]) -> list[str]:
    return ["  ".join(head), *("  ".join(r) for r in rows)]


def request_summary(by: str, total, rows) -> str:
    first = {"hits": ("hits", lambda v: str(v)), "bytes": ("bytes", human), "time_ms": ("cum. time", lambda v: f"{v / 1000:.0f}")}[by]
    label = {"hits": f"Total_hits:{total['total_hits']}  Invalid_hits:{total['invalid_hits']}  Error_hits:{total['error_hits']}", "bytes": f"Total_bytes:{human(total['total_bytes'])}", "time_ms": f"Total_time:{total['total_time_ms'] / 1000:.0f}s"}[by]
    body = ([first[1](r[by]).rjust(10), percent(r[f"{by}_percent"], 6), time_spread(r), size_spread(r), r["uri_abs"]] for r in rows)
    return "\n".join([RULE, label, RULE, *table([*heads((first[0], 10), ("percent", 7)), *spreads(True, True), "uri_abs"], body)])


def distribution(title: str, group_by: str, total, rows, sizes: bool = True, times: bool = True, size_column: bool = True) -> str:
    head = [*heads((group_by, 10), ("hits", 10), ("hits(%)", 7)), *(heads(("bytes", 10)) if size_column else []), *heads(("bytes(%)", 8)), *spreads(times, sizes)]
    body = ([r["period"].rjust(10), str(r["hits"]).rjust(10), percent(r["hits_percent"], 6), *([human(r["bytes"]).rjust(10)] if size_column else []), percent(r["bytes_percent"], 7), *([time_spread(r)] if times else []), *([size_spread(r)] if sizes else [])] for r in rows)
    return "\n".join([RULE, *([title] if title else []), f"Total_hits:{total['total_hits']}  Total_bytes:{human(total['total_bytes'])}", RULE, *table(head, body)])


def detail(title: str, total, rows, key: str, times: bool = False, sizes: bool = False, size_column: bool = True) -> str:
    head = [*heads(("hits", 8), ("hits(%)", 7)), *(heads(("bytes", 9)) if size_column else []), *heads(("bytes(%)", 8), ("time(%)", 7)), *spreads(times, sizes), key]
    body = ([str(r["hits"]).rjust(8), percent(r["hits_percent"], 6), *([human(r["bytes"]).rjust(9)] if size_column else []), percent(r["bytes_percent"], 7), percent(r["time_ms_percent"], 6), *([time_spread(r)] if times else []), *([size_spread(r)] if sizes else []), str(r[key]) or '""'] for r in rows)
    return "\n".join([RULE, title, f"Total_hits:{total['total_hits']}  Total_bytes:{human(total['total_bytes'])}", RULE, *table(head, body)])


def ip_section(kind: str, source: str | None, source_row, rows) -> str:
    """Addresses of one type under the header of their source; nothing if there are none."""
    if not rows:
        return ""
    line = lambda name, r: [name, str(r["hits"]).rjust(10), percent(r["hits_percent"], 6), human(r["bytes"]).rjust(10), percent(r["bytes_percent"], 7), percent(r["time_ms_percent"], 6)]
    out = []
    if source:
        out += [RULE, "  ".join([source.ljust(20), *heads(("hits", 10), ("hits(%)", 7), ("bytes", 10), ("bytes(%)", 8), ("time(%)", 7))]), "  ".join(line(RULE, source_row))]
    return "\n".join([*out, kind.capitalize().rjust(20), *("  ".join(line(r["ip"].rjust(20), r)) for r in rows)])


def error_summary(total, rows) -> str:
    head = [*heads(("error_code", 10), ("hits", 7), ("hits(%)", 7), ("bytes(%)", 8), ("time(%)", 7)), *spreads(True, False)]
    body = ([str(r["error_code"]).rjust(10), str(r["hits"]).rjust(7), percent(r["hits_percent"], 6), percent(r["bytes_percent"], 7), percent(r["time_ms_percent"], 6), time_spread(r)] for r in rows)
    return "\n".join([RULE, f"Total_hits:{total['total_hits']} Errors:{total['error_hits']}", RULE, *table(head, body)])
