import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakeindex.functions import rules as R
from lakeindex.functions.urls import is_child, is_public, join, normal_domain, normal_prefix, parse, percent_decode
from lakeindex.plans import demo
from lakeindex.plans.crawl import useful
from lakeindex.plans.demo import values
from lakeindex.sources import listing as L


def column(spark, rows, make):
    """The expression's values over one string column, in order."""
    df = spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], "i int, a string" + (", b long" if isinstance(rows[0], tuple) else ""))
    return [r.x for r in df.select("i", make(F.col("a"), F.col("b") if isinstance(rows[0], tuple) else None).alias("x")).orderBy("i").collect()]


def test_names(spark):
    cases = {".env": 2, ".ENV.local": 2, "environment": 0, "id_rsa": 2, "id_rsa.pub": 0, "ID_RSA": 0, ".git/": 2, "x.kdbx": 2, "Wallet.dat": 2, "a-phpbb31.txt404": 2, "mail.PST": 1, "my_db_2020.sql.gz": 1, "dump.sqlx": 0, "backup-2024.zip": 1, "bak20.zip": 0, "htdocs-old.tar.gz": 1, "passport.jpeg": 1, "passport_1.0.tar.gz": 0, "tax return 2020.pdf": 1, "plain.txt": 0}
    assert column(spark, list(cases), lambda a, _: R.sensitivity(a)) == list(cases.values())
    cases = {"A.1080p.mkv": True, "a S1E02 b": True, "x264": True, "crack me.zip": True, "keygen.txt": False, "Some.Film-GRP.mkv": True, "holiday.mp4": False, "720px.png": False}
    assert column(spark, list(cases), lambda a, _: R.likely_infringing(a)) == list(cases.values())
    cases = {"/home/me/": True, "/pub/home/me/": False, "/root/": True, "/rooted/": False, "/Users/x/y": True, "/a/SYM404/": True, "/a/sym404x/": False}
    assert column(spark, list(cases), lambda a, _: R.sensitive_path(a)) == list(cases.values())


def test_useful_agrees_with_the_walks_own(spark):
    rng = random.Random(1)
    rows = [("a.iso", None), ("b.TXT", 102400), ("b.txt", 102399), ("b.txt", None), ("access.log.3.gz", 9), ("log.gz", 9), ("catalog.gz", 9), ("x_log-2020.01.xz", 1), (".iso", 1), ("a.", 1), ("a.b.c", 1)]
    rows += [("".join(rng.choice(["log", ".", "-", "_", "1", "a", "gz", "iso", "txt"]) for _ in range(rng.randrange(1, 8))), rng.randrange(300_000)) for _ in range(500)]
    assert column(spark, rows, R.is_useful) == [useful(*r) for r in rows]
    assert [useful(*r) for r in rows[:8]] == [True, True, False, False, False, False, True, False]


def test_urls():
    base = parse("http://Example.COM:80/a/b/")
    assert str(base) == "http://example.com/a/b/"
    joined = {"c.txt": "http://example.com/a/b/c.txt", "../d/": "http://example.com/a/d/", "/x/./y/../z": "http://example.com/x/z", "//o.org": "http://o.org/", "?C=N": "http://example.com/a/b/?C=N", "a b": "http://example.com/a/b/a%20b", "https:/e": "https://e/", "\\up": "http://example.com/up", "c#f": "http://example.com/a/b/c", "": "http://example.com/a/b/"}
    assert {k: str(join(base, k)) for k in joined} == joined
    assert [join(base, x) for x in ("mailto:a@b", "ftp://x/", "http://", "http://a:99999/")] == [None] * 4
    assert [is_child(base, join(base, x)) for x in ("c", "c/", "c/d", "../b/x", "?q", "", "//o.org/a/b/c")] == [True, True, False, True, False, False, False]
    assert normal_domain(" *.Bücher.DE. ") == "xn--bcher-kva.de" and normal_domain("https://A.org/x") == "a.org" and normal_prefix("HTTP://A.org") == "http://a.org/"
    assert parse("http://0x7f.1/").host == "127.0.0.1"


def test_hosts_and_paths(spark):
    public = {"http://a.org/": True, "http://localhost/": False, "http://x.local./": False, "http://10.1.2.3/": False, "http://8.8.8.8/": True, "http://100.64.0.1/": False, "http://[::1]/": False, "http://[2606:4700::1]/": True, "http://[fd00::1]/": False, "http://[::ffff:10.0.0.1]/": False, "nothing": False, "http://intranet/": False}
    assert column(spark, list(public), lambda a, _: is_public(a)) == list(public.values())
    depth = {"http://a.org": 0, "http://a.org/": 0, "http://a.org/x/y/": 2, "http://a.org//x//?q=/a": 1, "a.org/x": 1, "http://a.org/x#/y": 1}
    assert column(spark, list(depth), lambda a, _: R.url_depth(a)) == list(depth.values())
    trap = {"/a/a/a": True, "/x/a/b/a/b/a/b/": True, "/a/a": False, "/ab/b/b": False, "/aa/a/a": False}
    assert column(spark, list(trap), lambda a, _: R.repeating_segments(a)) == list(trap.values())
    assert column(spark, ["http://a.org./x", "http://a.org.:8/", "http://a.org/b."], lambda a, _: R.canonical_url(a)) == ["http://a.org/x", "http://a.org:8/", "http://a.org/b."]
    assert column(spark, ["a+b%20c", "%zz%ff", None], lambda a, _: percent_decode(a)) == ["a+b c", "%zz�", None]
    assert column(spark, ["a.b.c"], lambda a, _: R.host_suffixes(a)) == [["a.b.c", "b.c", "c"]]
    assert column(spark, ["http://a.org/x/y/", "http://a.org/x/y", "http://a.org/"], lambda a, _: F.concat_ws(" ", R.folder_of(a), R.leaf_of(a))) == ["http://a.org/x/ y", "http://a.org/x/ y", "http:// a.org"]


DATES = {
    "2026-09-28 14:04  37M": "2026-09-28 14:04", "28-Sep-2026 10:15": "2026-09-28 10:15", "22 Sept 2026, 09:01": "2026-09-22 09:01", "2026-Aug-03 11:22:33": "2026-08-03 11:22:33", "9/28/2026 12:15 AM": "2026-09-28 00:15", "9/8/2026  1:05 PM": "2026-09-08 13:05", "28.09.2026 10:15": "2026-09-28 10:15",
    "Monday, September 28, 2026 10:15 PM": "2026-09-28 22:15", "2026-13-01 10:00": None, "31-Foo-2026 10:15": None, "2026-09-28 24:00": None, "no date": None, "13/9/2026 10:00 then 2026-01-02 03:04": "2026-01-02 03:04", "2026-09-28T14:04:77": "2026-09-28 14:04:77",
}


def test_dates_and_sizes(spark):
    assert {t: (L.find_date(t) or (None,))[0] for t in DATES} == DATES
    sizes = {"37M": 37 << 20, "1.5K": 1536, "-": None, "12.3 KiB": 12595, "87 MB": 87 << 20, "123": 123, "9000P": None, "x": None}
    assert {t: L.details(f"{t} 2026-09-28 14:04")[1] for t in sizes} == sizes
    assert [L.details(t) for t in ("2026-09-28 14:04 1K tail 5", "12.3 KiB 2026-Sep-28 10:15", "about 5 2026-09-28 14:04", "5K")] == [("2026-09-28 14:04", 1024), ("2026-09-28 10:15", 12595), ("2026-09-28 14:04", None), (None, None)]
    assert L.decode_entities("a&amp;b &lt;&#65;&#x42;&nbsp;&bogus; &#10; &toolongname12; &amp") == "a&b <AB &bogus; &#10; &toolongname12; &amp"


def test_formatting(spark):
    assert [r.x for r in values(spark, [(0,), (1023,), (1536,), (5 << 30,), (1 << 62,)], "n").select(R.human_bytes(F.col("n").cast("long")).alias("x")).collect()] == ["0 B", "1023 B", "1.5 KiB", "5.0 GiB", "4096.0 PiB"]
    assert column(spark, ["abcdef", "abc"], lambda a, _: R.truncate(a, 4)) == ["abc…", "abc"]
    assert spark.range(1).select(R.utc_minute(F.lit(86400 * 365)).alias("x")).first().x == "1971-01-01 00:00 UTC"


def page(rows, head="<title>Index of /</title>"):
    return head + "<pre>" + "\n".join(f'<a href="{h}">{t}</a>   {d}' for h, t, d in rows) + "</pre>"


def test_listings(spark):
    base = "http://h.org/pub/"
    got = L.parse_page(base, "text/html", page([("../", "../", ""), ("a%20b.iso", "a b.iso", "28-Sep-2026 10:15   5K"), ("d/", "d/", "28-Sep-2026 10:15  -"), ("a%20b.iso", "icon", ""), ("http://o.org/x/", "o", ""), ("/other/", "other", ""), ("?C=N;O=D", "Name", ""), ("mailto:x", "m", "")]))
    assert got.entries == [("http://h.org/pub/a%20b.iso", "a b.iso", False, 5120, "2026-09-28 10:15"), ("http://h.org/pub/d/", "d", True, None, "2026-09-28 10:15")]
    assert (got.server, got.other_dirs, got.external_dirs) == ("apache", ["http://h.org/other/"], ["http://o.org/x/"])
    unannounced = [(f"f{i}.zip", f"f{i}.zip", "2026-01-02 03:04  1M") for i in range(4)]
    assert len(L.parse_page(base, None, page(unannounced, "<h1>My files</h1>")).entries) == 4
    assert L.parse_page(base, None, page([(f"p{i}.html", "Read the article", "2026-01-02 03:04") for i in range(9)], "<h1>Blog</h1>")) is None
    iis = "[To Parent Directory]<br> 9/28/2026 10:15 AM  &lt;dir&gt; <A HREF='/pub/x/'>x</A><br> 9/28/2026 10:16 AM  77 <A HREF=/pub/y.bin>y.bin</A>"
    assert [(e[1], e[3], e[4]) for e in L.parse_page(base, None, iis).entries] == [("x", None, "2026-09-28 10:15"), ("y.bin", 77, "2026-09-28 10:16")]
    caddy = '[{"name":"a","size":5,"url":"./a%20b","mod_time":"2026-01-02T03:04:05.6Z","mode":1,"is_dir":false}]'
    assert L.parse_page(base, "application/json", caddy).entries == [("http://h.org/pub/a%20b", "a b", False, 5, "2026-01-02 03:04:05")]
    assert L.parse_page(base, "application/json", caddy.replace('"size":5,', "")) is None and L.parse_page(base, "text/html", "<p>hello") is None and L.parse_page(base, None, "<!-- <title>Index of</title> -->") is None
    df = spark.createDataFrame([(base, None, page(unannounced)), (base, None, None), (None, None, "x"), ("http://h.org/no/", "text/html", "plain")], "url string, content_type string, body string")
    rows = L.entry_rows(L.parse_pages(df)).orderBy("pos").collect()
    assert [(r.dir_url, r.name, r.size) for r in rows] == [(base, f"f{i}.zip", 1 << 20) for i in range(4)]


@pytest.mark.parametrize("body, server", [("<title>Index of /</title><address>Apache", "apache"), ('<a href="?C=M;O=D">', "apache"), ('<table id="list"><a href="?C=N&amp;O=A">', "nginx"), ("<h1>Directory listing for /</h1>", "python-http"), ("<p>", None)])
def test_servers(spark, body, server):
    assert L.server_of(body) == server


def test_lists_and_robots(tmp_path):
    from lakeindex.sources.lists import read_list, read_seeds
    from lakeindex.sources.robots import Robots, retry_after

    (tmp_path / "a.TXT").write_bytes("﻿http://b.org/ # note\r\n\r\n# all\nhttp://a.org\n".encode("utf-16-le"))
    (tmp_path / "b.txt").write_text("http://b.org/\nnot a url\nftp://c.org/\n")
    (tmp_path / "c.md").write_text("http://no.org/")
    assert read_list(f"{tmp_path}/a.TXT") == ["http://b.org/", "http://a.org"] and read_list(f"{tmp_path}/none") == []
    assert read_seeds(str(tmp_path), ["http://t.org/x"]) == ["http://t.org/x", "http://b.org/", "http://a.org/"]
    r = Robots("User-agent: lake\nDisallow: /a\nAllow: /a/b\nDisallow: /*.tmp$\nCrawl-delay: 2\n\nUser-agent: *\nDisallow: /", "lakeindex")
    assert [r.allows(p) for p in ("/a/x", "/a/b/c", "/x.tmp", "/x.tmpx", "/")] == [False, True, False, True, True] and r.delay == 2
    assert not Robots("User-agent: *\nCrawl-delay: 100", "x").allows("/") and Robots("", "x").allows("/")
    assert [retry_after(x) for x in ("5", "9999", "soon", None)] == [5, 300, None, None]


def test_workers_hand_on_listings_as_they_come(spark):
    """However many pages a batch has, and whatever they hold, a worker keeps few entries."""
    rows = "\n".join(f'<a href="f{i}">f{i}</a>  2026-09-28 10:15  {i}' for i in range(900))
    pages = pa.RecordBatch.from_pylist([{"url": f"http://h.org/{k}/", "content_type": None, "body": f"<title>Index of /</title><pre>{rows}" if k != 5 else None} for k in range(20)] + [{"url": None, "content_type": None, "body": "x"}])
    sizes = [sum(map(len, b.column("entries").to_pylist())) for b in L._rows(iter([pages, pages]))]
    assert sum(sizes) == 2 * 19 * 900 and max(sizes) < L.FLUSH + 900
    L.parse_pages(spark.createDataFrame([], "url string, content_type string, body string"))
    assert spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(L.BATCH)


def test_pages_of_tables_stay_small(spark, monkeypatch):
    """The page that shows sizes or dates does not grow with the table, and no row is lost."""
    found, parse = [], L.parse_pages
    monkeypatch.setattr(L, "parse_pages", lambda pages: found.append(pages.selectExpr("size(split(body, '\\n')) AS n")) or parse(pages))
    rows = spark.range(5_000, numPartitions=2).select((F.col("id") * 1000).cast("string").alias("name"), F.lit(" 3K   2026-08-03 11:22").alias("text"))
    got = demo._read_back(rows)
    assert got.count() == 5_000 and got.where("size = 3072").select("name").distinct().count() == 5_000
    assert max(r.n for r in found[0].collect()) <= demo.PAGE + 1


def test_listings_are_parsed_once_with_their_server(spark):
    from lakeindex.plans.demo_lake import listing_rows

    assert listing_rows(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    pages = spark.createDataFrame([("http://h.org/a/", "text/html", '<title>Index of /</title><pre><a href="../">../</a>\n<a href="x.iso">x.iso</a>  2026-09-28 10:15  5')], "url string, content_type string, body string")
    assert [tuple(r) for r in L.entry_rows(L.parse_pages(pages), ["server"]).select("dir_url", "server", "name", "size").collect()] == [("http://h.org/a/", "nginx", "x.iso", 5)]


def test_sizes_in_a_largest_unit_and_exact_halves(spark):
    rng = random.Random(4)
    numbers = [1024 + 256 * k for k in range(40)] + [round(4194304.35 * 2**30) + k for k in range(-3, 4)] + [rng.randrange(1 << rng.randrange(30, 63)) for _ in range(2000)]
    rows = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", R.human_bytes(F.col("n"), "GiB").alias("g"), R.human_bytes(F.col("n")).alias("p")).collect()
    for n, g, p in rows:
        at = max(0, min(5, (n.bit_length() - 1) // 10))
        text = lambda k: f"{n} B" if k == 0 else f"{n / 1024**k:.1f} {'KMGTP'[k - 1]}iB"
        assert (g, p) == (text(min(at, 3)), text(at))


def test_plain_texts_do_not_go_to_python(spark, monkeypatch):
    from lakeindex.operators import search

    make = search._plain.func

    @F.pandas_udf("string")
    def only_others(text):
        assert not [t for t in text if t is not None and t.isascii()]
        return make(text)

    monkeypatch.setattr(search, "_plain", only_others)
    assert column(spark, ["Abc D", "Ébc", None, "ＡÅx"], lambda a, _: search.folded(a)) == ["abc d", "ebc", None, "ａax"]
