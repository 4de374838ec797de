"""Url columns that need a parser: canonical form and safety."""

from __future__ import annotations

import ipaddress
import re
from urllib.parse import parse_qsl, quote_plus, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_TRACKING = re.compile(r"^utm_|^(fbclid|gclid)$", re.I)


def safe(value: str | None) -> bool:
    """https on its own port, without credentials, on a public host."""
    try:
        u = urlsplit((value or "").strip())
        host = (u.hostname or "").rstrip(".")
        port = u.port
    except ValueError:
        return False
    if u.scheme != "https" or not host or u.username is not None or u.password is not None or port not in (None, 443):
        return False
    if host == "localhost" or host.endswith((".localhost", ".local", ".internal")):
        return False
    try:
        ip = ipaddress.ip_address(host)
    except ValueError:
        return True
    return ip.is_global and not ip.is_multicast


def canonical(value: str | None) -> str | None:
    """Without fragment, tracking parameters and trailing slashes, parameters in order;
    None if unsafe."""
    if not safe(value):
        return None
    u = urlsplit(value.strip())
    query = sorted(((k, v) for k, v in parse_qsl(u.query, keep_blank_values=True) if not _TRACKING.search(k)), key=lambda p: p[0])
    path = u.path.rstrip("/") or "/"
    return f"https://{u.hostname}{path}" + ("?" + "&".join(f"{quote_plus(k)}={quote_plus(v)}" for k, v in query) if query else "")


def canonical_url(col) -> Column:
    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(canonical, na_action=None)

    return run(col)


def is_safe(col) -> Column:
    @F.pandas_udf("boolean")
    def run(s: pd.Series) -> pd.Series:
        return s.map(safe, na_action=None).astype("bool")

    return run(col)
