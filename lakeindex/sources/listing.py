"""Directory listings: pages of HTML or JSON to typed rows, by plain Python over Arrow batches."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeindex.functions.rules import MAX_SIZE, canonical_url
from lakeindex.functions.urls import Url, is_child, join, name_of, parse
from lakeindex.ship import ship

ENTRY = "struct<url:string,name:string,is_dir:boolean,size:bigint,mtime:string>"
LISTING = f"struct<server:string,entries:array<{ENTRY}>,other_dirs:array<string>,external_dirs:array<string>>"
# Fixed values of the pages that servers make.
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'", "nbsp": " "}
NAMED_SHARE, DATED_LEAST = (8, 10), 3
FLUSH, BATCH = 5_000, 4 << 20  # entries that a worker makes before it hands them on; bytes of pages that it gets at once
_ENTRY_NAMES = ("url", "name", "is_dir", "size", "mtime")
_PARSED = pa.schema({"url": pa.string(), "server": pa.string(), "entries": pa.list_(pa.struct(list(zip(_ENTRY_NAMES, (pa.string(), pa.string(), pa.bool_(), pa.int64(), pa.string()))))), "other_dirs": pa.list_(pa.string()), "external_dirs": pa.list_(pa.string())})

_TIME = r"(?P<h>[0-9]{1,2}):(?P<mi>[0-9]{2})(?::(?P<s>[0-9]{2}))?"
_HALF = r"(?:\s*(?P<half>[AaPp][Mm]))?"
#: One pattern for each way to write a date, with the same names for its parts.
DATES = [
    re.compile(p)
    for p in (
        rf"(?P<y>[0-9]{{4}})-(?P<mo>[0-9]{{2}})-(?P<d>[0-9]{{2}})[ T]{_TIME}",
        rf"(?P<d>[0-9]{{1,2}})-(?P<mon>[A-Za-z]{{3}})-(?P<y>[0-9]{{4}}) {_TIME}",
        rf"(?P<d>[0-9]{{1,2}})\s+(?P<mon>[A-Za-z]{{3,9}})\.?\s+(?P<y>[0-9]{{4}}),?\s+{_TIME}{_HALF}",
        rf"(?P<y>[0-9]{{4}})-(?P<mon>[A-Za-z]{{3}})-(?P<d>[0-9]{{1,2}}) {_TIME}",
        rf"(?P<mo>[0-9]{{1,2}})/(?P<d>[0-9]{{1,2}})/(?P<y>[0-9]{{4}})\s+{_TIME}{_HALF}",
        rf"(?P<d>[0-9]{{1,2}})\.(?P<mo>[0-9]{{1,2}})\.(?P<y>[0-9]{{4}})\s+{_TIME}",
        rf"(?:[A-Za-z]+,\s+)?(?P<mon>[A-Za-z]{{3,9}})\s+(?P<d>[0-9]{{1,2}}),\s+(?P<y>[0-9]{{4}})\s+{_TIME}{_HALF}",
    )
]
_SIZE = r"(?:-|<dir>|(?P<n>[0-9]+(?:\.[0-9]+)?)\s*(?P<u>[KMGTP])?(?:i?B(?:ytes)?)?)"
_SIZE_FIRST = re.compile(rf"\s*{_SIZE}(?=\s|\Z)", re.I)
_SIZE_ONLY = re.compile(_SIZE, re.I)
ANCHOR = r"""<a\s(?:[^>]*?\s)?href\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))[^>]*>(.*?)</a\s*>"""
_ANCHOR = re.compile(ANCHOR, re.I | re.S)
_COMMENT, _TAG, _ENTITY = re.compile(r"<!--.*?-->", re.S), re.compile(r"<[^>]*>"), re.compile(r"&([^;&]{1,10});")
SORT_LINK = r"""href\s*=\s*["']?\?c=[nmsd](?:;|&amp;|&)o=[ad]"""
HEADING = r"(?s)<(?:title|h1|h2)[^>]*>\s*(?:index of\b|directory listing for\b)"
IIS_ROW = r"<br>\s*[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4}\s+[0-9]{1,2}:[0-9]{2}(?::[0-9]{2})?\s*(?:[ap]m)?\s+(?:&lt;dir&gt;|[0-9]+)\s+<a\s"
IIS_MARK, TABLE_LIST = "[to parent directory]", '<table id="list">'
#: Marks of servers in the order in which they are looked for, on a page that announces a listing.
SERVER_MARKS = (("lighttpd", ('<div class="list">', "lighttpd/")), ("python-http", ("directory listing for",)), ("apache", ("?c=n;o=", "<address>apache")), ("nginx", (TABLE_LIST, '<a href="../">../</a>')))


def detect_server(lower: str) -> str | None:
    """The server that made a page (in lower case, without comments), None for a page that shows no sign of a listing."""
    if IIS_MARK in lower or re.search(IIS_ROW, lower):
        return "iis"
    if re.search(HEADING, lower):
        return next((name for name, marks in SERVER_MARKS if any(m in lower for m in marks)), "other")
    if re.search(SORT_LINK, lower):
        return "nginx" if TABLE_LIST in lower else "apache"
    return None


def server_of(body: str) -> str | None:
    return detect_server(_COMMENT.sub("", body).lower())


def decode_entities(text: str) -> str:
    """The few named entities and numeric ones; anything else, and control characters, stay as they are."""

    def one(m: re.Match) -> str:
        name = m[1]
        if name in ENTITIES:
            return ENTITIES[name]
        number = re.fullmatch(r"#(?:[xX]([0-9A-Fa-f]+)|([0-9]+))", name)
        if not number:
            return m[0]
        code = int(number[1], 16) if number[1] else int(number[2])
        if code > 0x10FFFF or 0xD800 <= code <= 0xDFFF or code < 32 or 127 <= code < 160:
            return m[0]
        return " " if code == 0xA0 else chr(code)

    return _ENTITY.sub(one, text)


def clean_text(html: str) -> str:
    return " ".join(decode_entities(_TAG.sub(" ", html)).split())


def find_date(text: str) -> tuple[str, int, int] | None:
    """The leftmost valid date, normalised, and where it stands; each pattern's first match is tried."""
    found = []
    for pattern in DATES:
        if m := pattern.search(text):
            p = m.groupdict()
            mon = (p.get("mon") or "")[:3].lower()
            month = int(p["mo"]) if p.get("mo") else MONTHS.index(mon) + 1 if mon in MONTHS else 0
            hour, half = int(p["h"]), (p.get("half") or "").lower()
            if half:
                hour = hour % 12 + 12 * (half == "pm") if hour <= 12 else hour + 12 * (half == "pm")
            if 1 <= month <= 12 and 1 <= int(p["d"]) <= 31 and hour <= 23 and int(p["mi"]) <= 59:
                tail = f":{p['s']}" if p["s"] else ""
                found.append((m.start(), m.end(), f"{int(p['y']):04d}-{month:02d}-{int(p['d']):02d} {hour:02d}:{p['mi']}{tail}"))
    return min(((t, a, b) for a, b, t in found), key=lambda x: x[1]) if found else None


def size_of(m: re.Match) -> int | None:
    """A size token's bytes; None for an explicit absence and for more than anyone has."""
    if m["n"] is None:
        return None
    n = float(m["n"]) * 1024.0 ** (" KMGTP".index(m["u"].upper()) if m["u"] else 0)
    n = int(n + 0.5)
    return n if n <= MAX_SIZE else None


def details(text: str) -> tuple[str | None, int | None]:
    """Date and size in a row's text: the size follows the date, or is all that stands before it."""
    date = find_date(text)
    if not date:
        return None, None
    m = _SIZE_FIRST.match(text, date[2]) or _SIZE_ONLY.fullmatch(text[: date[1]].strip())
    return date[0], size_of(m) if m else None


@dataclass
class Listing:
    server: str
    entries: list[tuple] = field(default_factory=list)  # (url, name, is_dir, size, mtime)
    other_dirs: list[str] = field(default_factory=list)
    external_dirs: list[str] = field(default_factory=list)


def _same_spelling(url: Url, base: Url) -> Url:
    """The host as the base writes it, where both mean one site."""
    return url._replace(host=base.host) if url.host != base.host and url.host.rstrip(".") == base.host.rstrip(".") else url


def parse_page(base_url: str, content_type: str | None, body: str | None) -> Listing | None:
    """The rows of a listing, None for a page that is none."""
    base = parse(base_url)
    if base is None or body is None:
        return None
    return parse_json(base, body) if "json" in (content_type or "").lower() else parse_html(base, body)


def parse_json(base: Url, body: str) -> Listing | None:
    """A JSON array of files; one item that lacks a part voids the page."""
    try:
        items = json.loads(body)
        rows = []
        for x in items:
            size, href, when, is_dir = x["size"], x["url"], x["mod_time"], x["is_dir"]
            if not (isinstance(size, int) and not isinstance(size, bool) and size >= 0 and isinstance(href, str) and isinstance(when, str) and isinstance(is_dir, bool)):
                return None
            rows.append((size, href, when, is_dir))
    except (ValueError, TypeError, KeyError):
        return None
    if not isinstance(items, list):
        return None
    out = Listing("caddy")
    for size, href, when, is_dir in rows:
        url = join(base, href)
        if url is None or not is_child(base, url) or not (name := name_of(url)):
            continue
        mtime = re.match(r"([0-9]{4}-[0-9]{2}-[0-9]{2})T([0-9]{2}:[0-9]{2}:[0-9]{2})", when)
        out.entries.append((str(url), name, is_dir, None if is_dir or size > MAX_SIZE else size, f"{mtime[1]} {mtime[2]}" if mtime else None))
    return out


def parse_html(base: Url, body: str) -> Listing | None:
    body = _COMMENT.sub("", body)
    server = detect_server(body.lower())
    out, at, named = Listing(server or "other"), {}, []
    anchors = list(_ANCHOR.finditer(body))
    for i, a in enumerate(anchors):
        url = join(base, decode_entities(a[1] if a[1] is not None else a[2] if a[2] is not None else a[3] or ""))
        if url is None or url.query is not None:
            continue
        url = _same_spelling(url, base)
        if url.host != base.host:
            if url.path.endswith("/"):
                out.external_dirs.append(str(url))
            continue
        if not is_child(base, url):
            if url.origin == base.origin and url.path.endswith("/") and not base.path.startswith(url.path):
                out.other_dirs.append(str(url))
            continue
        name, is_dir = name_of(url), url.path.endswith("/")
        if not name:
            continue
        if server == "iis":
            row = body[anchors[i - 1].end() if i else 0 : a.start()]
        else:
            row = body[a.end() : anchors[i + 1].start() if i + 1 < len(anchors) else len(body)]
            cut = row.lower().find("</tr")
            row = row[: cut if cut >= 0 else row.find("\n") if "\n" in row else len(row)]
        mtime, size = details(clean_text(row))
        entry = (str(url), name, is_dir, None if is_dir else size, mtime)
        k = at.setdefault(entry[0], len(out.entries))
        if k == len(out.entries):
            out.entries.append(entry)
            named.append(False)
        named[k] = named[k] or _is_name(clean_text(a[4]), out.entries[k][1])
        if out.entries[k][4] is None and mtime is not None:
            out.entries[k] = entry
    if server is None:
        dated = sum(e[4] is not None for e in out.entries)
        if dated < DATED_LEAST or sum(named) * NAMED_SHARE[1] < len(out.entries) * NAMED_SHARE[0]:
            return None
    return out


def _is_name(text: str, name: str) -> bool:
    """The link's text is the file's name, or the beginning of it that a server cut short."""
    text = text.rstrip("/")
    for cut in ("..>", "…"):
        if text.endswith(cut) and text != cut:
            return name.startswith(text.removesuffix(cut).rstrip("."))
    return text == name


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Listings go on as soon as about FLUSH entries are there, so a worker holds few pages' entries however many a batch has."""
    made, held = [], 0
    for batch in batches:
        for url, kind, body in zip(*(batch.column(c) for c in ("url", "content_type", "body"))):
            got = parse_page(url.as_py(), kind.as_py(), body.as_py()) if url.is_valid else None
            if not got:
                continue
            made.append({"url": url.as_py(), "server": got.server, "entries": [dict(zip(_ENTRY_NAMES, e)) for e in got.entries], "other_dirs": got.other_dirs, "external_dirs": got.external_dirs})
            held += 1 + len(got.entries) + len(got.other_dirs) + len(got.external_dirs)
            if held >= FLUSH:
                yield pa.RecordBatch.from_pylist(made, _PARSED)
                made, held = [], 0
    yield pa.RecordBatch.from_pylist(made, _PARSED)


def parse_pages(pages: DataFrame) -> DataFrame:
    """Of rows (url, content_type, body): a row (url, server, entries, other_dirs, external_dirs) for each page that is a listing.

    Pages may be of any size, so a worker gets them by bytes: at most BATCH a batch, or one page. This holds for the session.
    """
    spark = pages.sparkSession
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH))
    return pages.select(*[F.col(c).cast("string").alias(c) for c in ("url", "content_type", "body")]).mapInArrow(_rows, f"url string, server string, entries array<{ENTRY}>, other_dirs array<string>, external_dirs array<string>")


def entry_rows(listings: DataFrame, keep: list[str] = ()) -> DataFrame:
    """One row for each entry of each listing: (dir_url, the listing's columns `keep`, pos, url, name, is_dir, size, mtime)."""
    return listings.select(canonical_url(F.col("url")).alias("dir_url"), *keep, F.posexplode("entries").alias("pos", "e")).select("dir_url", *keep, "pos", "e.*")
