"""Settings of the engine, as one immutable value."""

from __future__ import annotations

from dataclasses import dataclass, field

#: The web server's documented example formats.
PLAIN_FORMAT = '$remote_addr - [$time_local] "$request" $status $body_bytes_sent $request_time "$http_referer" "$http_user_agent" - $http_x_forwarded_for'
JSON_FORMAT = {
    "timestamp": "$time_iso8601",
    "remote_addr": "$remote_addr",
    "scheme": "$scheme",
    "http_host": "$http_host",
    "method": "$request_method",
    "uri": "$uri",
    "args": "$args",
    "request_time": "$request_time",
    "status": "$status",
    "request_length": "$request_length",
    "body_bytes_sent": "$body_bytes_sent",
    "http_referer": "$http_referer",
    "http_user_agent": "$http_user_agent",
    "http_x_forwarded_for": "$http_x_forwarded_for",
}


#: For sessions that roll up: groups that gather values are hashed, not sorted, up to this number a task.
SESSION = {"spark.sql.objectHashAggregate.sortBased.fallbackThreshold": "100000"}


@dataclass(frozen=True)
class ArgsRule:
    """Where ``pattern`` is found in the arguments, all its matches become ``template``."""

    pattern: str
    template: str


@dataclass(frozen=True)
class UriRule:
    """For URIs in which ``pattern`` is found: a template for its matches, and rules for their arguments, the first that fits counting.

    Without ``template`` the URI stays as it is; without ``args`` so do the
    arguments; with ``args`` of which none fits the default rule applies.
    """

    pattern: str
    template: str | None = None
    args: tuple[ArgsRule, ...] = ()


@dataclass(frozen=True)
class Settings:
    log_type: str = "plaintext"
    log_format: str | dict[str, str] = PLAIN_FORMAT
    log_path: str = "/var/log/web/*.log"
    exclude: tuple[str, ...] = ()
    #: Requests and, of each kind of address, addresses kept per minute; None keeps all.
    top_uris: int | None = 80
    top_ips: int | None = 30
    #: Days that are kept, the last one included; None keeps all.
    keep_days: int | None = 10
    #: Rules by site (the log's base name with ``.`` as ``_``).
    rules: dict[str, tuple[UriRule, ...]] = field(default_factory=dict)
    methods: tuple[str, ...] = ("GET", "POST", "HEAD", "DELETE", "PUT", "OPTIONS", "CONNECT")
