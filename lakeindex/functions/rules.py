"""Predicates and scalars on names, hosts, paths and sizes: columns in, columns out, no UDF.

Regular expressions are written for Java: \\z for the end of the text, (?s) where a name may hold line ends, and a possessive or
anchored form where a long name could make a match slow.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values of the rules.
BIG_FILE = 10 * 1024 * 1024
TEXT_FILE_MIN = 100 * 1024
MAX_SIZE = 1 << 53
USEFUL = (
    "zip 7z rar tar gz tgz bz2 xz zst lz lzma iso img dmg vhd vhdx vmdk qcow2 wim squashfs "
    "exe msi deb rpm apk appimage pkg whl bin z lzh lha cab sit arj zoo "
    "pdf epub mobi azw3 djvu cbz cbr doc docx odt ppt pptx tex "
    "mp3 flac ogg opus wav m4a aac wma ape mid midi mp4 mkv webm avi mov wmv flv mpg mpeg m4v vob ogv "
    "csv tsv json parquet sqlite sqlite3 nc h5 hdf5 fits grib grib2 shp kml kmz gpx geojson pbf xls xlsx mat rdata npy npz arrow "
    "tif tiff psd cr2 nef arw dng raw svs torrent"
).split()
USEFUL_IF_BIG = "txt dat xml rtf ps".split()
COMPRESSED = "gz bz2 xz zst lz lzma".split()
USER_HOSTED = "wordpress.com blogspot.com github.io gitlab.io netlify.app herokuapp.com appspot.com pages.dev workers.dev vercel.app weebly.com wixsite.com tumblr.com neocities.org 000webhostapp.com".split()
LOCAL_SUFFIXES = "localhost local internal lan home.arpa intranet".split()
HOST_TOKEN = r"(?:ftp|mirrors?|dl|downloads?|files|archives?|dist|distros?|releases?|pub|data|opendata|dumps|software|isos?|cdimage|edu|gov|ac)[0-9]*"
PATH_SEGMENT = r"(?:pub|mirrors?|dist|distrib|downloads?|dl|releases?|isos?|archives?|software|data|datasets?|ebooks?|books|library|papers|publications|linux|gnu|bsd|opendata|ftp)"
STRONG = (
    r"(?i)\A\.env(?:\.[\w.-]+)?\z",
    r"\Aid_(?:rsa|dsa|ecdsa|ed25519)\z",
    r"(?i)\A\.(?:git|svn|hg|ssh|aws|gnupg|bash_history|zsh_history|htpasswd)\z",
    r"(?i)\Awp-config\.php",
    r"(?i)\.(?:kdbx|ppk)\z",
    r"(?i)\Awallet\.dat\z",
    r"(?i)\A[a-z0-9_.-]+-(?:wordpress|joomla|phpbb[0-9]*|boxbilling|whmcs|vbulletin|drupal|magento|opencart|prestashop|smf|mybb|moodle)[0-9]*\.txt404\z",
)
WEAK = (
    r"(?i)\.(?:pst|ost)\z",
    r"(?i)(?:backup|dump|database|mysql|db)[^/]*\.sql(?:\.(?:gz|bz2|xz|zip|7z))?\z",
    r"(?i)\A(?:backup|bak)[-_]?[0-9]{4}",
    r"(?i)\A(?:public_html|htdocs|wwwroot)[^/]*\.(?:zip|tar|tgz|tar\.gz|7z|rar)\z",
    r"(?i)\A(?:passport|payroll|tax[-_ ]?return|bank[-_ ]?statement)[^/]*\.(?:pdf|jpe?g|png|tiff?|heic|docx?|xlsx?|odt|ods)\z",
)
SENSITIVE_PATHS = (r"\A/home/[^/]+/", r"\A/root/", r"\A/Users/[^/]+/", r"(?i)(?:\A|/)sym404(?:/|\z)")
INFRINGING = (
    r"(?i)\b(?:2160p|1080p|720p|x26[45]|hevc|web-?dl|webrip|blu-?ray|brrip|hdrip|dvdrip|remux)\b",
    r"(?i)\bS[0-9]{1,2}E[0-9]{1,3}\b",
    r"(?i)\b(?:crack|cracked|keygen)\b.*\.(?:exe|zip|rar|7z|iso)\z",
    r"\.[A-Za-z0-9-]+-[A-Za-z0-9]{2,12}\.(?:mkv|mp4|avi)\z",
)
SKIP_FOLDERS = (
    "pool dists indices repodata Packages SRPMS debug src/contrib bin/windows/contrib bin/macosx web/packages web/checks authors/id maven2 distfiles "
    "wp-content wp-includes wp-admin cgi-bin node_modules thumbs thumbnails cache tmp logs backup backups bak"
).split()


def any_of(c: Column, patterns) -> Column:
    """Whether one of the patterns is found, as one alternation with each part's own flags."""
    return c.rlike("|".join(p.replace("(?i)", "(?i:", 1) + ")" if p.startswith("(?i)") else p for p in patterns))


def either(conditions) -> Column:
    return reduce(or_, conditions, F.lit(False))


def canonical_host(host: Column) -> Column:
    """Without trailing dots, in lower case."""
    return F.lower(F.regexp_replace(host, r"\.+\z", ""))


def url_host(url: Column) -> Column:
    """The host of an http(s) URL, canonical, without user and port; null for other texts."""
    host = F.regexp_extract(url, r"(?i)\Ahttps?://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)", 1)
    return F.nullif(canonical_host(host), F.lit(""))


def url_path(url: Column) -> Column:
    """The still encoded path; a URL without one has /."""
    path = F.regexp_extract(url, r"\A[^:/?#]*:?//[^/?#]*([^?#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def url_query(url: Column) -> Column:
    """The query without its mark, null if there is none."""
    return F.when(url.rlike(r"\A[^#]*\?"), F.regexp_extract(url, r"\A[^?#]*\?([^#]*)", 1))


def canonical_url(url: Column) -> Column:
    """The same URL with a host that has no trailing dots."""
    return F.regexp_replace(url, r"(?i)\A(https?://(?:[^/?#@]*@)?[^/?#:]*?)\.+(?=[:/?#]|\z)", "$1")


def url_depth(url: Column) -> Column:
    """How many non-empty segments the path has."""
    path = F.regexp_extract(url, r"\A(?:[^/?#]*://)?[^/?#]*([^?#]*)", 1)
    return F.size(F.filter(F.split(path, "/"), lambda s: s != "")).cast("int")


def folder_of(url: Column) -> Column:
    """A URL up to and with the slash before its last part."""
    return F.regexp_extract(url, r"(?s)\A(.*?)[^/]*/?\z", 1)


def leaf_of(url: Column) -> Column:
    """The last part of a URL, without a trailing slash."""
    return F.regexp_extract(url, r"([^/]*)/?\z", 1)


def entry_url(dir_url: Column, href: Column, name: Column, is_dir: Column) -> Column:
    """The full URL of an entry of a folder."""
    return F.concat(dir_url, F.coalesce(href, name), F.when(is_dir, "/").otherwise(""))


def folder_url(dir_url: Column, href: Column, name: Column, is_dir: Column) -> Column:
    """The same for folders, null for files."""
    return F.when(is_dir, F.concat(dir_url, F.coalesce(href, name), F.lit("/")))


def extension(name: Column) -> Column:
    """What follows the last dot, in lower case, if both sides are non-empty and it has at most 10 bytes."""
    ext = F.regexp_extract(name, r"(?s)\A.+\.([^.]{1,10})\z", 1)
    return F.when((ext != "") & (F.octet_length(ext) <= 10), F.lower(ext))


def rotated_log(name: Column) -> Column:
    """A compressed log with rotation numbers or dates."""
    return F.lower(name).rlike(rf"(?s)\A(?:.*[._-])?log(?:[._-][0-9]+)*\.(?:{'|'.join(COMPRESSED)})\z")


def is_useful(name: Column, size: Column) -> Column:
    """Whether people look for files of this kind; plain text only when it is large."""
    ext = extension(name)
    kind = ext.isin(*USEFUL) | (ext.isin(*USEFUL_IF_BIG) & (F.coalesce(size, F.lit(-1)) >= TEXT_FILE_MIN))
    return F.coalesce(kind & ~rotated_log(name), F.lit(False))


def is_big(size: Column) -> Column:
    return F.coalesce(size >= BIG_FILE, F.lit(False))


def sensitivity(name: Column) -> Column:
    """2 for names of credentials, 1 for names that often are an accident, else 0; a folder may end in a slash."""
    bare = F.regexp_replace(name, r"/+\z", "")
    return F.when(any_of(bare, STRONG), 2).when(any_of(bare, WEAK), 1).otherwise(0)


def sensitive_path(path: Column) -> Column:
    return any_of(path, SENSITIVE_PATHS)


def likely_infringing(name: Column) -> Column:
    return any_of(name, INFRINGING)


def user_hosted(host: Column) -> Column:
    """Hosts under services where anyone takes a name."""
    return domain_match(host, USER_HOSTED)


def domain_match(host: Column, domains) -> Column:
    """The host is one of the domains or below one."""
    h = canonical_host(host)
    return either([(h == d.lower()) | h.endswith("." + d.lower()) for d in domains])


def host_suffixes(host: Column) -> Column:
    """The host and all its parents: an equi join on these replaces a suffix join for long lists."""
    parts = F.split(canonical_host(host), r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def hosts_in(hosts: DataFrame, domains: DataFrame) -> DataFrame:
    """Distinct hosts of a column host that are one of the domains or below one: an equi join, however long the list."""
    each = hosts.select("host", F.explode(host_suffixes(F.col("host"))).alias("domain"))
    return each.join(domains.select(F.lower("domain").alias("domain")).distinct(), "domain", "left_semi").select("host").distinct()


def archive_host(host: Column) -> Column:
    """A part of the host's name suggests a file server."""
    h = canonical_host(host)
    return F.coalesce(~user_hosted(h) & F.exists(F.split(h, "[.-]"), lambda t: t.rlike(rf"\A{HOST_TOKEN}\z")), F.lit(False))


def archive_signal(host: Column, decoded_path: Column) -> Column:
    """So does the host, or a folder of the (decoded) path."""
    folder = F.exists(F.split(F.lower(decoded_path), "/"), lambda s: s.rlike(rf"\A{PATH_SEGMENT}\z"))
    return F.coalesce(~user_hosted(host) & (archive_host(host) | folder), F.lit(False))


def skip_folder(decoded_path: Column, patterns=SKIP_FOLDERS) -> Column:
    """The (decoded) path runs through one of the folders, in any case."""
    p = F.lower(decoded_path)
    return either([p.contains("/" + x.lower().strip("/") + "/") for x in patterns])


def taken_down(url: Column, prefixes) -> Column:
    return either([url.startswith(p) for p in prefixes])


def sort_query(query: Column) -> Column:
    """The query of a listing's column header."""
    return query.rlike(r"\A\?*C=[NMSD][;&]O=[AD]\z")


def sort_query_sargable(query: Column) -> Column:
    """The same with a part that Parquet readers can prune by."""
    return query.isNotNull() & (query.startswith("C=") | query.startswith("?")) & sort_query(query)


def listing_dir(url: Column) -> Column:
    """The folder whose listing has this sort link, null if the URL is none."""
    bare = F.regexp_extract(url, r"(?i)\A(https?://[^/?#]+/(?:[^?#]*/)?)(?=\?)", 1)
    return F.when(sort_query(url_query(url)) & (bare != ""), bare)


def repeating_segments(path: Column) -> Column:
    """Some run of segments stands three times in a row at the path's end."""
    return F.rtrim(path, F.lit("/")).rlike(r"((?:/[^/]+)+)\1\1\z")


def parse_extensions(text: str | None) -> list[str]:
    """A list of extensions as users write it: split at commas and blanks, leading dots dropped, lower case."""
    words = (text or "").replace(",", " ").split()
    return [w for w in (x.lstrip(".").lower() for x in words) if w]


def ext_in(name: Column, is_dir: Column, extensions: list[str]) -> Column:
    """Files whose name ends in one of the extensions; no extensions, no filter."""
    if not extensions:
        return F.lit(True)
    lower = F.lower(name)
    return ~is_dir & either([lower.endswith("." + e) for e in extensions])


def min_size(size: Column, least: int | None) -> Column:
    """Files of at least this size; a null size is below any."""
    return F.lit(True) if least is None else F.coalesce(size >= F.lit(min(least, (1 << 63) - 1)), F.lit(False))


def human_bytes(n: Column, largest: str = "PiB") -> Column:
    """Exact bytes below 1024, else one decimal of KiB to PiB, or to a smaller `largest` unit.

    The decimal is that of the nearest double, rounded exactly, halves to even, as the C library and Rust print it; texts of
    doubles round twice.
    """
    units = ["KiB", "MiB", "GiB", "TiB", "PiB"]
    units = units[: units.index(largest) + 1]
    n = n.cast("long")
    whole, made = n.cast("double").cast("long"), F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B")))
    for i, unit in enumerate(units):
        shift = 10 * (i + 1)
        rest = whole.bitwiseAND(F.lit((1 << shift) - 1).cast("long")) * 10
        tenth, over = F.shiftright(rest, shift), rest.bitwiseAND(F.lit((1 << shift) - 1).cast("long")) * 2
        tenth += ((over > 1 << shift) | (over == 1 << shift) & (tenth % 2 == 1)).cast("long")
        label = F.concat(F.shiftright(whole, shift) + F.floor(tenth / 10), F.lit("."), tenth % 10, F.lit(f" {unit}"))
        made = made.when(F.lit(True) if i + 1 == len(units) else n < 1024 ** (i + 2), label)
    return made


def truncate(text: Column, most: int) -> Column:
    """At most this many characters, the last an ellipsis where something is cut."""
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most - 1), F.lit("…"))).otherwise(text)


def utc_minute(epoch: Column) -> Column:
    """Seconds since 1970 as YYYY-MM-DD HH:MM UTC, whatever the session's zone."""
    at = F.timestamp_seconds(epoch)
    return F.concat(F.date_format(F.convert_timezone(F.current_timezone(), F.lit("UTC"), at.cast("timestamp_ntz")), "yyyy-MM-dd HH:mm"), F.lit(" UTC"))


def create_sql_functions(spark) -> None:
    """The scalar functions that SQL users have, as SQL functions that Catalyst inlines."""
    text = lambda values: ", ".join(f"'{v}'" for v in values)
    esc = lambda p: p.replace("\\", "\\\\").replace("'", "\\'")
    joined = lambda ps: esc("|".join(p.replace("(?i)", "(?i:", 1) + ")" if p.startswith("(?i)") else p for p in ps))
    ext = "lower(regexp_extract(name, '(?s)^.+\\\\.([^.]{1,10})\\\\z', 1))"
    log = esc(rf"(?s)\A(?:.*[._-])?log(?:[._-][0-9]+)*\.(?:{'|'.join(COMPRESSED)})\z")
    bodies = {
        "is_useful(name STRING, size BIGINT) RETURNS BOOLEAN": f"coalesce(octet_length({ext}) <= 10 AND ({ext} IN ({text(USEFUL)}) OR {ext} IN ({text(USEFUL_IF_BIG)}) AND size >= {TEXT_FILE_MIN}) AND NOT lower(name) RLIKE '{log}', false)",
        "url_depth(url STRING) RETURNS INT": "size(regexp_extract_all(regexp_extract(url, '^(?:[^/?#]*://)?[^/?#]*([^?#]*)', 1), '[^/]+', 0))",
        "sensitivity(name STRING) RETURNS INT": f"CASE WHEN rtrim('/', name) RLIKE '{joined(STRONG)}' THEN 2 WHEN rtrim('/', name) RLIKE '{joined(WEAK)}' THEN 1 ELSE 0 END",
        "hidden(url STRING, host STRING, name STRING, prefixes ARRAY<STRING>, domains ARRAY<STRING>) RETURNS BOOLEAN": f"exists(prefixes, p -> startswith(url, p)) OR exists(domains, d -> lower(host) = d OR endswith(lower(host), concat('.', d))) OR name RLIKE '{joined(INFRINGING)}'",
        "ext_in(name STRING, list STRING) RETURNS BOOLEAN": "lower(name) RLIKE concat('\\\\.(?:\\\\Q', array_join(regexp_extract_all(lower(list), '[^, .][^, ]*', 0), '\\\\E|\\\\Q'), '\\\\E)\\\\z')",
    }
    for head, body in bodies.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURN {body}")
