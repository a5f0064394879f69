"""Column expressions: decoding and abstraction of requests, addresses, times and sizes."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import UriRule

#: Length of the key of each period, a prefix of ``yyyyMMddHHmm``.
PERIODS = {"minute": 12, "ten_min": 11, "hour": 10, "day": 8}


def percent_decode(text: Column) -> Column:
    """Percent escapes as UTF-8; broken escapes and plus signs stay."""
    guarded = F.regexp_replace(F.regexp_replace(text, "%(?![0-9A-Fa-f]{2})", "%25"), r"\+", "%2B")
    return F.when(text.contains("%"), F.url_decode(guarded)).otherwise(text)


def split_request(request_uri: Column) -> tuple[Column, Column]:
    """URI and arguments around the first question mark; arguments are empty without one."""
    parts = F.split(request_uri, r"\?", 2)
    return F.get(parts, 0), F.coalesce(F.get(parts, 1), F.lit(""))


def abstract_uri(uri: Column) -> Column:
    """Segments of digits, dashes and underscores alone, up to the next slash, dot or the end, become ``*``."""
    return F.regexp_replace(uri, r"/[0-9_-]+(?=[/.]|\z)", "/*")


def abstract_args(args: Column) -> Column:
    """Values of arguments become ``*``; empty ones stay."""
    return F.regexp_replace(args, "=[^&=]+", "=*")


def java_template(template: str) -> str:
    r"""A template with ``\1`` or ``$1`` references for Java; other dollars and backslashes stand for themselves."""
    out = re.sub(r"\\(?!\d)", r"\\\\", template)
    return re.sub(r"\\(\d)", r"$\1", re.sub(r"\$(?!\d)", r"\\$", out))


def abstract_request(uri: Column, args: Column, site: Column, rules: dict[str, tuple[UriRule, ...]]) -> tuple[Column, Column]:
    """Abstracted URI and arguments of a decoded request; a site's own rules come before the defaults."""
    out_uri, out_args = abstract_uri(uri), abstract_args(args)
    for name, of_site in rules.items():
        for rule in reversed(of_site):
            fits = (site == name) & uri.rlike(rule.pattern)
            new_args = abstract_args(args) if rule.args else args
            for a in reversed(rule.args):
                new_args = F.when(args.rlike(a.pattern), F.regexp_replace(args, a.pattern, java_template(a.template))).otherwise(new_args)
            new_uri = uri if rule.template is None else F.regexp_replace(uri, rule.pattern, java_template(rule.template))
            out_uri, out_args = F.when(fits, new_uri).otherwise(out_uri), F.when(fits, new_args).otherwise(out_args)
    return out_uri, out_args


def minute_key(time: Column) -> Column:
    """``yyyyMMddHHmm`` of a local or ISO time as written, whatever its zone and seconds; null for anything else."""
    local = F.try_to_timestamp(F.substring(time, 1, 17), F.lit("dd/MMM/yyyy:HH:mm"))
    iso = F.try_to_timestamp(F.replace(F.substring(time, 1, 16), F.lit("T"), F.lit(" ")), F.lit("yyyy-MM-dd HH:mm"))
    return F.date_format(F.coalesce(local, iso), "yyyyMMddHHmm")


def period(key: Column, group_by: str) -> Column:
    if group_by not in PERIODS:
        raise ValueError(f"group_by is one of {', '.join(PERIODS)}")
    return F.substring(key, 1, PERIODS[group_by])


def time_bound(text: str) -> str:
    """A bound of times, ``[yy]yyMMdd[HH[mm]]``, as a prefix of minute keys."""
    if not text.isdigit() or len(text) not in (6, 8, 10, 12):
        raise ValueError("a time is yyyyMMdd[HH[mm]] or yyMMdd[HH[mm]]")
    if len(text) == 6 or not text.startswith(("19", "20")):
        text = "20" + text
    if len(text) not in (8, 10, 12):
        raise ValueError("a time is yyyyMMdd[HH[mm]] or yyMMdd[HH[mm]]")
    return text


def forwarded(xff: Column) -> tuple[Column, Column]:
    """First address without trailing commas, and last address, of a forwarded-for header; an empty one counts as ``-``."""
    plain = F.trim(F.coalesce(xff, F.lit("-")))
    tokens = F.split(F.when(plain == "", "-").otherwise(plain), r"\s+")
    return F.regexp_replace(F.get(tokens, 0), ",+$", ""), F.element_at(tokens, -1)


def source_class(user_ip: Column, last_cdn_ip: Column) -> Column:
    """Where a request came from: a CDN, a reverse proxy, the client itself, or unclassified."""
    return (
        F.when((user_ip != "-") & (user_ip != last_cdn_ip), "cdn")
        .when((user_ip != "-") & (user_ip == last_cdn_ip), "proxy")
        .when((user_ip == "-") & (last_cdn_ip == "-"), "direct")
        .otherwise("unclassified")
    )


def human_size(n: Column) -> Column:
    """Bytes in B, KB, MB or GB with two decimals."""
    x = n.cast("double")
    sized = lambda v, unit: F.format_string(f"%.2f {unit}", v)
    return F.when(x < 1024, sized(x, "B")).when(x < 1024**2, sized(x / 1024, "KB")).when(x < 1024**3, sized(x / 1024**2, "MB")).otherwise(sized(x / 1024**3, "GB"))


def retention_cutoff(day: Column, keep_days: int) -> Column:
    """The first day that is kept, as ``yyyyMMdd``."""
    return F.date_format(F.date_sub(F.to_date(day, "yyyyMMdd"), keep_days - 1), "yyyyMMdd")


def share(part: Column, whole: Column) -> Column:
    """Percent of a total; null where the total is zero."""
    return F.try_divide(part.cast("double") * 100.0, whole.cast("double"))
