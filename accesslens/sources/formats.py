"""Compiles a web server's log format into a Java regex or a map of JSON keys."""

from __future__ import annotations

import json
import re
from dataclasses import dataclass

#: The format's variables and the field each one fills.
FIELDS = {
    "remote_addr": "remote_addr",
    "time_local": "time",
    "time_iso8601": "time",
    "request": "request",
    "request_method": "request_method",
    "status": "status",
    "body_bytes_sent": "bytes",
    "bytes_sent": "bytes",
    "request_time": "request_time",
    "http_referer": "http_referer",
    "http_user_agent": "http_user_agent",
    "http_x_forwarded_for": "xff",
    "scheme": "scheme",
    "request_uri": "request_uri",
    "uri": "uri",
    "document_uri": "uri",
    "args": "args",
    "query_string": "args",
    "server_protocol": "server_protocol",
    "server_name": "http_host",
    "host": "http_host",
    "http_host": "http_host",
    "request_length": "request_length",
    "remote_user": "remote_user",
    "gzip_ratio": "gzip_ratio",
    "connection_requests": "connection_requests",
    "connection": "connection",
    "upstream_addr": "upstream_addr",
    "upstream_status": "upstream_status",
}
#: Each entry needs one of its alternatives; an alternative is a set of fields.
NEEDED = (({"remote_addr"},), ({"request"}, {"request_method", "request_uri"}, {"request_method", "uri", "args"}), ({"request_time"},), ({"status"},), ({"bytes"},), ({"time"},))
VARIABLE = re.compile(r"\$([a-z0-9_]+)")


class FormatError(ValueError):
    """The format lacks a variable that the engine needs."""


@dataclass(frozen=True)
class PlainFormat:
    """``regex`` matches a whole line; group i + 1 is ``fields[i]``."""

    regex: str
    fields: tuple[str, ...]


@dataclass(frozen=True)
class JsonFormat:
    """``keys`` gives the JSON key of each field."""

    keys: dict[str, str]


def _validate(fields: set[str]) -> None:
    for alternatives in NEEDED:
        if not any(a <= fields for a in alternatives):
            raise FormatError("the log format needs " + " or ".join(", ".join(sorted(a)) for a in alternatives))


def compile_plain(text: str, methods: tuple[str, ...]) -> PlainFormat:
    """A variable takes as little as it can, forwarded addresses as much; literals stand for themselves.

    Unknown variables match anything and fill nothing; of two variables for one
    field the first fills it.
    """
    parts, fields, at = ["(?s)^"], [], 0
    for m in VARIABLE.finditer(text):
        parts.append(re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", text[at : m.start()]))
        at = m.end()
        field = FIELDS.get(m[1])
        body = "|".join(methods) if m[1] == "request_method" else ".*" if field == "xff" else ".*?"
        if field is None or field in fields:
            parts.append(f"(?:{body})")
        else:
            fields.append(field)
            parts.append(f"({body})")
    parts.append(re.sub(r"([\\^$.|?*+()\[\]{}])", r"\\\1", text[at:]) + "$")
    _validate(set(fields))
    return PlainFormat("".join(parts), tuple(fields))


def compile_json(spec: str | dict[str, str]) -> JsonFormat:
    keys: dict[str, str] = {}
    for key, variable in (json.loads(spec) if isinstance(spec, str) else spec).items():
        field = FIELDS.get(variable.lstrip("$"))
        if field is not None:
            keys.setdefault(field, key)
    _validate(set(keys))
    return JsonFormat(keys)
