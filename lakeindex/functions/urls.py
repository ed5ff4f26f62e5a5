"""URL parsing and joining after the URL standard's rules for http(s), and what needs it: the only Python on hot rows."""

from __future__ import annotations

import ipaddress
import re
from functools import lru_cache
from typing import NamedTuple
from urllib.parse import unquote

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

PORTS = {"http": "80", "https": "443"}
_HEAD = re.compile(r"([A-Za-z][A-Za-z0-9+.-]*):")
_KEEP_PATH = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789-._~!$&'()*+,;=:@/%[]\\|^")
_KEEP_QUERY = _KEEP_PATH | frozenset("?`{}")
_DOT = {".": 1, "%2e": 1, "..": 2, ".%2e": 2, "%2e.": 2, "%2e%2e": 2}


class Url(NamedTuple):
    """An http(s) URL in its parts; path is encoded and starts with a slash, port is "" where it is the scheme's own."""

    scheme: str
    host: str
    port: str
    path: str
    query: str | None

    def __str__(self) -> str:
        return f"{self.origin}{self.path}" + ("" if self.query is None else f"?{self.query}")

    @property
    def origin(self) -> str:
        return f"{self.scheme}://{self.host}" + (f":{self.port}" if self.port else "")

    @property
    def segments(self) -> list[str]:
        return self.path[1:].split("/")


def encode(text: str, keep: frozenset) -> str:
    """Percent-encodes what may not stand in this part; what is encoded stays."""
    return "".join(c if c in keep else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in text)


def normal_host(host: str) -> str | None:
    """The host in lower case, IDNA-encoded; IPv4 in dotted decimals; None if it can't be one."""
    if host.startswith("["):
        try:
            return f"[{ipaddress.IPv6Address(host.strip('[]')).compressed}]"
        except ValueError:
            return None
    host = unquote(host).lower()
    if not host.isascii():
        try:
            host = host.encode("idna").decode("ascii")
        except UnicodeError:
            return None
    if not host or re.search(r"[\x00-\x20#%/:<>?@\[\\\]^|\x7f]", host):
        return None
    last = host.rstrip(".").rpartition(".")[2]
    if last and (last.isdigit() or re.fullmatch(r"0x[0-9a-f]*", last)):
        return _ipv4(host.removesuffix("."))
    return host


def _ipv4(host: str) -> str | None:
    parts = host.split(".")
    if not 1 <= len(parts) <= 4:
        return None
    try:
        numbers = [int(p, 16) if p.startswith("0x") and p != "0x" else 0 if p == "0x" else int(p, 8) if len(p) > 1 and p.startswith("0") else int(p) for p in parts]
    except ValueError:
        return None
    *front, tail = numbers
    if any(n > 255 for n in front) or tail >= 256 ** (5 - len(parts)):
        return None
    return str(ipaddress.IPv4Address(sum(n << 8 * (3 - i) for i, n in enumerate(front)) + tail))


def _path(segments: list[str]) -> str:
    """Segments after a path's first slash, dot segments resolved."""
    out: list[str] = []
    for i, s in enumerate(segments):
        dots = _DOT.get(s.lower(), 0)
        if dots == 2 and out:
            out.pop()
        if dots:
            if i + 1 == len(segments):
                out.append("")
        else:
            out.append(encode(s, _KEEP_PATH))
    return "/" + "/".join(out)


def parse(text: str | None) -> Url | None:
    """An absolute http(s) URL, None for anything else. The fragment is dropped."""
    return join(None, text)


@lru_cache(4096)
def join(base: Url | None, text: str | None) -> Url | None:
    """The URL that a link means on a page; None if it is broken or not http(s)."""
    if text is None:
        return None
    text = re.sub(r"[\t\n\r]", "", text.strip("".join(map(chr, range(33)))))
    text = text.partition("#")[0]
    head = _HEAD.match(text)
    scheme = head[1].lower() if head else None
    if scheme and scheme not in PORTS:
        return None
    rest = text[head.end() :] if head else text
    rest, mark, query = rest.partition("?")
    rest = rest.replace("\\", "/")
    asked = encode(query, _KEEP_QUERY - {"'"}) if mark else None
    if scheme and (base is None or scheme != base.scheme or rest.startswith("//")) or rest.startswith("//"):
        scheme = scheme or (base.scheme if base else None)
        if scheme is None:
            return None
        authority, slash, path = rest.lstrip("/").partition("/")
        authority = authority.rpartition("@")[2]
        cut = re.fullmatch(r"(\[[^\]]*\]|[^:]*)(?::([0-9]*))?", authority)
        host = normal_host(cut[1]) if cut else None
        if host is None or cut[2] and int(cut[2]) > 65535:
            return None
        port = str(int(cut[2])) if cut[2] else ""
        return Url(scheme, host, "" if port == PORTS[scheme] else port, _path(path.split("/")), asked)
    if base is None:
        return None
    if not rest:
        return Url(*base[:3], base.path, asked if mark else base.query)
    segments = rest[1:].split("/") if rest.startswith("/") else base.segments[:-1] + rest.split("/")
    return Url(*base[:3], _path(segments), asked)


def decoded(text: str) -> str:
    """Percent-decoded, broken UTF-8 replaced; a plus is a plus."""
    return unquote(text, errors="replace")


def name_of(url: Url) -> str:
    """The last non-empty segment, decoded; "" if there is none."""
    return decoded(next((s for s in reversed(url.segments) if s), ""))


def is_child(base: Url, url: Url) -> bool:
    """A file or folder directly in the folder of the base, without a query."""
    folder = base.path[: base.path.rfind("/") + 1]
    if url.origin != base.origin or url.query is not None or not url.path.startswith(folder):
        return False
    rest = url.path[len(folder) :].removesuffix("/")
    return bool(rest) and "/" not in rest


def public_host(host: str | None) -> bool:
    """A host that the public can reach: a domain name that is not local, or an address outside the special ranges."""
    if not host:
        return False
    if host.startswith("["):
        a = ipaddress.IPv6Address(host.strip("[]"))
        mapped = a.ipv4_mapped
        if mapped:
            return not (_within(mapped, ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16")) or int(mapped) == 0)
        return not (int(a) in (0, 1) or _within(a, ("fc00::/7", "fe80::/10")))
    try:
        a4 = ipaddress.IPv4Address(host)
    except ValueError:
        h = host.rstrip(".").lower()
        return "." in h and not re.search(r"(?:^|\.)(?:localhost|local|internal|lan|home\.arpa|intranet)$", h)
    special = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "127.0.0.0/8", "169.254.0.0/16", "100.64.0.0/10", "192.0.2.0/24", "198.51.100.0/24", "203.0.113.0/24")
    return not (_within(a4, special) or int(a4) in (0, 2**32 - 1))


def _within(address, networks) -> bool:
    return any(address in ipaddress.ip_network(n) for n in networks)


def normal_domain(entry: str) -> str:
    """A list's entry as a bare domain: of a URL its host, without *. in front and dots behind, IDNA-encoded."""
    entry = entry.strip()
    url = parse(entry) if "://" in entry else None
    host = url.host if url else entry
    while host.startswith("*."):
        host = host[2:]
    host = host.rstrip(".")
    return normal_host(host) or host.lower()


def normal_prefix(entry: str) -> str:
    """A URL as the standard writes it, or the entry itself."""
    url = parse(entry)
    return str(url) if url else entry


@F.pandas_udf(StringType())
def percent_decode(text: pd.Series) -> pd.Series:
    return text.map(lambda t: decoded(t) if isinstance(t, str) and "%" in t else t)


@F.pandas_udf(BooleanType())
def is_public(url: pd.Series) -> pd.Series:
    return url.map(lambda t: bool(isinstance(t, str) and (u := parse(t)) and public_host(u.host)))


def decoded_path(path: Column) -> Column:
    """Only paths with an escape go to Python."""
    return F.when(path.contains("%"), percent_decode(path)).otherwise(path)
