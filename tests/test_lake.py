import random

import pytest

from lakeindex.lake import Conflict, Lake
from lakeindex.operators.quality import Thresholds
from lakeindex.plans.crawl import Options, crawl
from lakeindex.sources import index
from lakeindex.streaming.messages import apply_stream, read_log, strike_stream


@pytest.fixture
def lake(spark, tmp_path):
    return Lake(spark, f"file://{tmp_path}/lake")


def put(host, folder, files, leaf=True):
    return {"kind": "entries", "host": host, "leaf": leaf, "entries": [{"url": f"http://{host}{folder}{n}", "name": n.rstrip("/"), "is_dir": n.endswith("/"), "size": s, "mtime": None} for n, s in files]}


def done(host, status="done", **more):
    return {"kind": "host_done", "host": host, "status": status, "dirs": 1} | more


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=str)


def test_versions_and_conflicts(spark, lake, tmp_path):
    with pytest.raises(FileNotFoundError):
        Lake(spark, f"file://{tmp_path}/none", create=False)
    first = lake.version()
    lake.commit(hosts=spark.createDataFrame([("a", "done", None, 1, 1, 1, 1, None, True, 0)], lake.table("hosts").schema))
    assert lake.table("hosts").count() == 1 and lake.version() == first + 1
    with pytest.raises(Conflict):
        lake._commit_manifest(first + 1, {})
    for _ in range(4):
        lake.commit(hosts=lake.table("hosts"))
    assert lake.vacuum() > 0 and lake.table("hosts").count() == 1 and lake.vacuum() == 0


def test_listings_replace_and_hosts_roll_up(lake):
    lake.send(put("a.org", "/x/", [("1.iso", 5), ("2.txt", None), ("d/", None)], False), put("a.org", "/y/", [("3", 7)]), put("a.org.", "/x/", [("1.iso", 6)]), {"kind": "entries", "host": "a.org", "entries": []}, done("a.org", server="nginx"), {"kind": "odd", "host": "b"})
    assert rows(lake.table("entries"), "dir_url", "name", "size") == [("http://a.org/x/", "1.iso", 6), ("http://a.org/y/", "3", 7)]
    assert rows(lake.table("hosts"), "host", "files", "bytes", "dirs", "server") == [("a.org", 2, 13, 1, "nginx")]
    assert rows(lake.table("dead_letters"), "kind", "why") == [("odd", "unknown kind")]
    lake.send(done("a.org", "paused", server=None), done("a.org", dirs=4))
    assert rows(lake.table("hosts"), "dirs", "server") == [(5, "nginx")]
    assert [r.url for r in lake.files().orderBy("url").collect()] == ["http://a.org/x/1.iso", "http://a.org/y/3"]


def test_candidates_trust_and_pause(lake):
    lake.send(done("read.org"), done("later.org", "paused"), done("gone.org", "unreachable"))
    lake.add_candidates(["http://read.org/x/", "http://later.org/x/", "http://new.org/b/", "http://new.org/a/c/", "http://new.org/b/"])
    lake.send({"kind": "candidates", "urls": ["http://later.org/r/"], "source": "resume"})
    assert rows(lake.table("candidates"), "url", "source") == [("http://later.org/r/", "resume"), ("http://new.org/a/c/", "link"), ("http://new.org/b/", "link")]
    lake.add_seeds(["http://gone.org/s/", "http://new.org/b/", "http://read.org/"])
    assert rows(lake.table("hosts"), "host", "trusted") == [("later.org", False), ("read.org", True)]
    assert ("http://new.org/b/", "seed") in rows(lake.table("candidates"), "url", "source")
    lake.send({"kind": "candidates", "urls": ["http://new.org/b/", "http://new.org/a/c/"], "source": "moved"})
    assert rows(lake.table("candidates").where("host = 'new.org'"), "url", "source") == [("http://new.org/a/c/", "moved"), ("http://new.org/b/", "seed")]
    p = {r.host: r for r in lake.pending(10).collect()}
    assert p["new.org"].urls == ["http://new.org/b/", "http://new.org/a/c/"] and p["new.org"].seeds == ["http://new.org/b/"] and p["new.org"].trusted and set(p) == {"new.org", "gone.org", "later.org"}
    lake.send({"kind": "paused", "host": "new.org", "finished": ["http://new.org/b/"], "frontier": ["http://new.org/z/"]}, done("new.org", "paused"))
    assert rows(lake.table("candidates").where("host = 'new.org'"), "url", "source") == [("http://new.org/z/", "resume")]
    assert rows(lake.table("hosts").where("host = 'new.org'"), "trusted") == [(True,)]
    n = lake.named_sites(["http://new.org/typed/", "http://other.org/"]).collect()
    assert [(r.host, r.urls) for r in n] == [("new.org", ["http://new.org/typed/", "http://new.org/z/"]), ("other.org", ["http://other.org/"])]
    assert lake.forget(["new.org"]) and not lake.forget(["new.org"]) and lake.pending(10).where("host = 'new.org'").count() == 0


def test_strikes_end_a_site(lake):
    for i in range(5):
        lake.send({"kind": "paused", "host": "s.org", "finished": [], "frontier": ["http://s.org/"]}, done("s.org", "paused", failed=True, reason="down"))
        expected = "unreachable" if i == 4 else "paused"
        assert rows(lake.table("hosts"), "status", "fails") == [(expected, 0 if i == 4 else i + 1)]
    assert lake.table("candidates").count() == 0 and "5 runs" in lake.table("hosts").first().reason


def test_verdicts(lake):
    judge = Thresholds()
    junk = [(f"p{i}.html", 10) for i in range(120)]
    lake.send(put("junk.org", "/", junk), done("junk.org", judge=judge), put("yours.org", "/", junk), done("yours.org", judge=judge, trusted=True), put("good.org", "/", [(f"{i}.iso", 1) for i in range(20)]), done("good.org", judge=judge), put("few.org", "/", junk[:50]), done("few.org", "unreachable", judge=judge))
    assert rows(lake.table("hosts"), "host", "status") == [("few.org", "unreachable"), ("good.org", "done"), ("junk.org", "low_value"), ("yours.org", "done")]
    assert lake.table("entries").where("host = 'junk.org'").count() == 0
    lake.send(*[put("deep.org", f"/d{i}/", [("a.html", 1)] * 1 + [(f"{k}.php", 1) for k in range(5)]) for i in range(20)], done("deep.org", "paused", judge=judge))
    assert lake.table("hosts").where("host = 'deep.org'").first().status == "low_value"


def test_clean_in_order_and_idempotent(lake):
    big = [(f"{i}.iso", 20 << 20) for i in range(3)]
    lake.send(
        *[x for h in ("out.org", "skip.org", "keys.org", "weak.org", "mine.org", "home.org") for x in (put(h, "/", big), done(h, trusted=h == "mine.org"))], put("sub.out.org", "/", big), put("mine.org", "/x/", [("backup-2020.zip", 5), ("passport.pdf", 5), ("ok.iso", 5)]), put("mine.org", "/y/", [("backup2021/", None)], False), put("mine.org", "/y/backup2021/", [("z", 1)]),
        put("mine.org", "/pub/logs/", [("a", 1)]), put("keys.org", "/k/", [("id_rsa", 1)]), put("weak.org", "/k/", [("db.sql", 1)]), put("home.org", "/home/me/", [("a", 1)]), put("low.org", "/", [("a.html", 1)]), done("low.org"),
    )
    args = dict(optout=["out.org"], skip_hosts=["skip.org"], skip_folders=["logs"])
    report = rows(lake.clean(**args), "action", "host", "n")
    assert report == sorted([("opted_out", "out.org", 0), ("opted_out", "sub.out.org", 0), ("skipped", "skip.org", 0), ("skipped_dirs", None, 1), ("sensitive", "keys.org", 0), ("sensitive", "weak.org", 0), ("sensitive", "home.org", 0), ("omitted", None, 3), ("low_value", "low.org", 0)], key=str)
    assert rows(lake.table("dirs"), "url") == [("http://mine.org/",), ("http://mine.org/x/",), ("http://mine.org/y/",)]
    assert rows(lake.table("entries").where("dir_url <> 'http://mine.org/'"), "name") == [("ok.iso",)]
    assert lake.clean(**args).collect() == []
    assert [r.host for r in lake.sensitive_hosts().collect()] == ["home.org", "keys.org", "weak.org"]
    assert {r.status: r.hosts for r in lake.stats().collect()} == {"opted_out": 2, "skipped": 1, "sensitive": 3, "low_value": 1, "done": 1}


def test_subtrees_stop_at_their_neighbours(lake):
    lake.send(*[put("s.org", p, [("f", 1)]) for p in ("/a/", "/a/b/", "/a0/", "/a-b/", "/ab/")])
    lake.delete_subtree("http://s.org/a/")
    assert rows(lake.table("dirs"), "url") == [("http://s.org/a-b/",), ("http://s.org/a0/",), ("http://s.org/ab/",)]


def test_search(lake):
    lake.send(put("a.org", "/pub/linux/", [("ubuntu-24.04.iso", 5 << 30), ("Ubuntu notes.txt", 9), ("Café.pdf", None), ("Ubuntu.1080p.mkv", 4)]), put("b.org", "/ubuntu/", [("other.iso", 5)]), put("h.org", "/", [("ubuntu.iso", 1)]), done("a.org"), done("h.org"))
    names = lambda *a, **k: [r.name for r in lake.search(*a, **k).collect()]
    assert set(names("ubuntu")) == {"ubuntu-24.04.iso", "Ubuntu notes.txt", "other.iso", "ubuntu.iso"} and names("ubuntu")[-1] == "other.iso"
    assert names("cafe") == ["Café.pdf"] and names("ubun 24 is") == ["ubuntu-24.04.iso"] and names("pub ubuntu", extensions=".ISO") == ["ubuntu-24.04.iso"]
    assert "Ubuntu.1080p.mkv" in names("ubuntu", unfiltered=True) and names("ubuntu", min_bytes=1 << 30) == ["ubuntu-24.04.iso"]
    assert "other.iso" not in names("ubuntu", optout=["b.org"]) and "ubuntu.iso" not in names("ubuntu", takedown=["http://h.org"])
    with pytest.raises(ValueError):
        lake.search("--")
    before = rows(lake.search("ubuntu pub"), "url", "rank")
    lake.index()
    stored = lake.search("ubuntu pub")
    assert rows(stored, "url", "rank") == before and "StringStartsWith(token" in stored._jdf.queryExecution().executedPlan().toString()
    lake.send(put("c.org", "/pub/", [("ubuntu new", 1)]))
    assert "ubuntu new" in names("ubuntu pub")
    assert lake.sql("SELECT count(*) AS n FROM files WHERE is_useful(name, size)").first().n == 5


def nginx(rows):
    return "<title>Index of</title><pre>" + "".join(f'<a href="{n}">{n}</a> 28-Sep-2026 10:15 {s}\n' for n, s in rows) + "</pre>"


def test_crawl(spark, lake):
    web = {
        "http://m.org/": nginx([("pub/", "-"), ("loop/", "-")]), "http://m.org/pub/": nginx([("a.iso", 30 << 20), ("b.iso", 30 << 20), ("c.iso", 30 << 20), ("deep/", "-")]) + '<a href="http://ftp.x.org/pub/">x</a>', "http://m.org/pub/deep/": nginx([("d.zip", 5)]), "http://m.org/loop/": nginx([("pub/", "-"), ("loop/", "-")]),
        "http://ftp.x.org/pub/": nginx([("x.iso", 50 << 20), ("y.iso", 50 << 20), ("z.iso", 50 << 20)]), "http://k.org/": nginx([("id_rsa", 5)]), "http://r.org/robots.txt": "User-agent: *\nDisallow: /", "http://r.org/": nginx([("a", 1)]), "http://blog.org/": "<p>hello", "http://j.org/": nginx([(f"{i}.html", 5) for i in range(200)]),
    }
    pages = [(u, 200, "text/html" if "robots" not in u else "text/plain", None, b) for u, b in web.items()] + [("http://old.org/", 301, None, "http://m.org/", None), ("http://down.org/", 500, None, None, None)]
    df = spark.createDataFrame(pages, "url string, status int, content_type string, location string, body string")
    lake.add_candidates(["http://k.org/", "http://r.org/", "http://blog.org/", "http://j.org/", "http://down.org/"])
    assert crawl(lake, df, ["http://old.org/"], Options(), now=1000) == 8
    status = {r.host: (r.status, r.trusted) for r in lake.table("hosts").collect()}
    assert status == {"old.org": ("not_listing", True), "m.org": ("done", True), "ftp.x.org": ("done", False), "k.org": ("sensitive", False), "r.org": ("robots_disallowed", False), "blog.org": ("not_listing", False), "j.org": ("low_value", False), "down.org": ("unreachable", False)}
    assert lake.table("dirs").where("host = 'm.org'").count() == 4  # the loop is a copy: it is kept, and not walked on from
    assert [r.name for r in lake.search("iso", 10).collect()] == ["a.iso", "b.iso", "c.iso", "x.iso", "y.iso", "z.iso"] or lake.search("iso").count() == 6
    assert crawl(lake, df, now=1001) == 0


def test_crawl_goes_on_until_nothing_is_pending(lake, monkeypatch):
    from lakeindex.plans import crawl as module

    def one_round(lake, web, options, want, now, exclude):
        walked = {r.host for r in exclude.collect()}
        return [h for h in map("h{}.org".format, range(50)) if h not in walked][:want]

    monkeypatch.setattr(module, "crawl_round", one_round)
    assert crawl(lake, None, want=2) == 50 and crawl(lake, None, want=2, sites=7) == 7 and crawl(lake, None, sites=0) == 0


def test_budget_resumes(spark, lake):
    pages = [("http://w.org/", 200, "text/html", None, nginx([(f"d{i}/", "-") for i in range(10)]))] + [(f"http://w.org/d{i}/", 200, "text/html", None, nginx([(f"{i}.iso", 20 << 20)])) for i in range(10)]
    df = spark.createDataFrame(pages, "url string, status int, content_type string, location string, body string")
    counts = []
    for i in range(4):
        crawl(lake, df, ["http://w.org/"] if not i else [], Options(max_dirs=4), now=i)
        counts.append((lake.table("hosts").first().status, lake.table("dirs").count()))
    assert counts == [("paused", 4), ("paused", 8), ("done", 11), ("done", 11)]
    assert lake.table("hosts").first().dirs == 11


def test_index(spark, tmp_path):
    good = [("http://ftp.a.org/x/?C=N;O=D", "C=N;O=D"), ("http://ftp.a.org/x/?C=M;O=A", "?C=M;O=A"), ("http://www.b.com/pub/y/?C=N;O=D", "C=N;O=D"), ("http://www.c.com/img/?C=N;O=D", "C=N;O=D"), ("http://ftp.a.org/x/f?C=N;O=D", "C=N;O=D")]
    spark.createDataFrame(good + [(f"http://n.org/{i}", None) for i in range(500)], "url string, url_query string").write.parquet(f"{tmp_path}/subset=warc/1.parquet")
    found = index.scan(index.read_index(spark, [f"{tmp_path}/subset=warc/1.parquet"]))
    assert "StringStartsWith" in found._jdf.queryExecution().executedPlan().toString()
    assert rows(index.candidates(found), "url") == [("http://ftp.a.org/",), ("http://ftp.a.org/x/",), ("http://www.b.com/pub/y/",)]
    assert sum(r.rejected for r in index.rejected(found).collect()) == 1
    with pytest.raises(TypeError):
        index.read_index(spark, [_write(spark, tmp_path)])
    (tmp_path / "m.txt").write_text("a/subset=warc/1.parquet\na/subset=robots/2.parquet\na/subset=warc/3.parquet\n")
    m = index.manifest(spark, f"{tmp_path}/m.txt")
    assert [r.path for r in index.remaining(m, spark.createDataFrame([("a/subset=warc/1.parquet",)], "path string"), 5).collect()] == ["a/subset=warc/3.parquet"]
    (tmp_path / "c.json").write_text('[{"id": "X"}, {"id": "CC-MAIN-2"}, {"id": "CC-MAIN-1"}]')
    assert index.latest(spark, f"{tmp_path}/c.json") == "CC-MAIN-2"


def _write(spark, tmp_path):
    spark.createDataFrame([(1, "x")], "url long, url_query string").write.parquet(f"{tmp_path}/bad")
    return f"{tmp_path}/bad"


def random_messages(rng, n):
    hosts, out = ["a.org", "b.org", "c.org"], []
    for _ in range(n):
        h = rng.choice(hosts)
        kind = rng.random()
        if kind < 0.4:
            out.append(put(h, rng.choice(["/", "/x/", "/y/"]), [(f"{rng.randrange(9)}.{rng.choice(['iso', 'html'])}", rng.choice([1, None, 20 << 20]))]))
        elif kind < 0.6:
            out.append(done(h, rng.choice(["done", "paused", "unreachable", "skipped"]), purge=rng.random() < 0.2, failed=rng.random() < 0.5, judge=Thresholds()))
        elif kind < 0.85:
            out.append({"kind": "candidates", "urls": [f"http://{rng.choice(hosts)}/{rng.randrange(4)}/" for _ in range(2)], "source": rng.choice(["link", "seed", "moved", "resume"])})
        else:
            out.append({"kind": "paused", "host": h, "finished": [f"http://{h}/1/"], "frontier": [f"http://{h}/{rng.randrange(4)}/"]})
    return out


def test_random_operations_keep_the_invariants(spark, tmp_path):
    rng = random.Random(5)
    one, many = Lake(spark, f"file://{tmp_path}/one"), Lake(spark, f"file://{tmp_path}/many")
    messages = random_messages(rng, 40)
    one.send(*messages, now=7)
    for i in range(0, 40, 10):  # batches give what one batch gives
        many.send(*messages[i : i + 10], now=7)
    for t, columns in (("hosts", ["host", "status", "files", "bytes", "dirs", "trusted", "fails", "reason"]), ("dirs", ["url", "leaf"]), ("entries", ["dir_url", "name", "size"]), ("candidates", ["url", "source"])):
        assert rows(one.table(t), *columns) == rows(many.table(t), *columns)
    assert one.table("entries").join(one.table("dirs").withColumnRenamed("url", "dir_url"), "dir_url", "left_anti").count() == 0
    dropped = one.table("hosts").where("status in ('low_value', 'skipped')").select("host")
    assert one.table("candidates").join(dropped, "host").count() == 0


def test_stream_gives_what_the_batch_gives(spark, tmp_path):
    messages = [{"seq": i, "now": 5} | m for i, m in enumerate(random_messages(random.Random(8), 24))]
    messages = [{**m, "judge": {"min_big": 3, "min_useful": 20}} if isinstance(m.get("judge"), Thresholds) else m for m in messages]
    import json
    import os

    os.makedirs(f"{tmp_path}/log")
    for i in range(0, 24, 8):
        path = f"{tmp_path}/log/{i:03d}.json"
        with open(path, "w") as f:
            f.write("\n".join(json.dumps(m) for m in messages[i : i + 8]))
        os.utime(path, (1000 + i, 1000 + i))
    streamed, batch = Lake(spark, f"file://{tmp_path}/s"), Lake(spark, f"file://{tmp_path}/b")
    apply_stream(streamed, read_log(spark, f"{tmp_path}/log", 1), f"{tmp_path}/cp").awaitTermination()
    batch.apply(spark.read.schema(read_log(spark, f"{tmp_path}/log").schema).json(f"{tmp_path}/log"))
    for t, columns in (("hosts", ["host", "status", "files", "dirs"]), ("entries", ["dir_url", "name"]), ("candidates", ["url", "source"])):
        assert rows(streamed.table(t), *columns) == rows(batch.table(t), *columns)


def test_strikes_as_state(spark, tmp_path):
    src = f"{tmp_path}/runs"
    spark.createDataFrame([("a", i, i != 6) for i in range(1, 13)], "host string, seq long, failed boolean").coalesce(1).write.json(src)
    q = strike_stream(spark.readStream.schema("host string, seq long, failed boolean").json(src)).writeStream.format("memory").queryName("strikes").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.fails for r in spark.table("strikes").orderBy("seq").collect()] == [1, 2, 3, 4, 0, 0, 1, 2, 3, 4, 0, 1]

def test_robots_that_cannot_be_read(spark, lake):
    page, T = nginx([(f"{i}.iso", 30 << 20) for i in range(3)]), "text/html"
    sites = {"all": (404, None), "wait": (429, None), "busy": (503, None), "gone": (0, None), "broken": (500, None), "slow": (200, "User-agent: *\nCrawl-delay: 90")}
    pages = [x for h, (status, body) in sites.items() for x in ((f"http://{h}.org/robots.txt", status, "text/plain", None, body), (f"http://{h}.org/", 200, T, None, page))]
    df = spark.createDataFrame(pages + [("http://round.org/robots.txt", 301, None, "/robots.txt", None), ("http://round.org/", 200, T, None, page)], "url string, status int, content_type string, location string, body string")
    lake.add_candidates([f"http://{h}.org/" for h in [*sites, "round"]])
    crawl(lake, df, now=5)
    got = {r.host.split(".")[0]: (r.status, r.reason) for r in lake.table("hosts").collect()}
    assert got["all"] == ("done", None) and got["broken"] == ("robots_disallowed", "robots.txt returned 500") and got["slow"] == ("robots_disallowed", "Crawl-delay of 90s is too slow to crawl")
    assert [got[h][0] for h in ("wait", "busy", "gone")] == ["unreachable"] * 3 and got["wait"][1].startswith("robots.txt: 429") and got["round"] == ("robots_disallowed", "robots.txt redirected too many times")


def test_runs_that_end_early(spark, lake):
    T = "text/html"
    folders = [(f"d{i}/", "-") for i in range(70)]
    pages = [("http://a.org/", 200, T, None, nginx(folders[:6])), ("http://a.org/d0/", 500, None, None, None)] + [(f"http://a.org/d{i}/", 200, T, None, nginx([(f"{i}.iso", 30 << 20)])) for i in range(1, 6)]
    pages += [("http://b.org/", 200, T, None, nginx(folders))] + [("http://c.org/", 200, T, None, nginx(folders))] + [(f"http://c.org/d{i}/", 500, None, None, None) for i in range(70)]
    df = spark.createDataFrame(pages, "url string, status int, content_type string, location string, body string")
    lake.add_candidates(["http://a.org/", "http://b.org/", "http://c.org/"])
    crawl(lake, df, options=Options(max_dirs=4), now=5, sites=1)
    assert rows(lake.table("hosts"), "host", "status", "reason", "fails", "dirs") == [("a.org", "paused", "directory budget for this run reached; continues next run", 0, 3)]
    counters = {}
    assert crawl(lake, df, now=6, counters=counters) == 3 and counters == {"sites": 3, "listings": 5, "entries": 143, "failed": 3}
    got = {r.host: (r.status, r.reason, r.fails) for r in lake.table("hosts").collect()}
    assert got["a.org"] == ("paused", "some folders could not be read (500 from http://a.org/d0/); will try them again", 1)
    assert got["b.org"] == ("paused", "the server refused 50 folders in a row (last: 404 from http://b.org/d49/); continues next run", 1)
    assert got["c.org"] == ("paused", "too many errors, last: 500 from http://c.org/d4/; continues next run", 1)
    assert lake.table("candidates").groupBy("host").count().orderBy("host").collect() == [("a.org", 1), ("b.org", 70), ("c.org", 70)]


def test_the_deadline_leaves_sites_as_they_were(spark, lake):
    df = spark.createDataFrame([("http://a.org/", 200, "text/html", None, nginx([("a.iso", 5)]))], "url string, status int, content_type string, location string, body string")
    assert crawl(lake, df, ["http://a.org/"], Options(until=0.0), now=5) == 1 and lake.table("hosts").count() == 0
    assert rows(lake.table("candidates"), "url") == [("http://a.org/",)]


def test_pages_are_cut_with_a_note(spark, lake):
    df = spark.createDataFrame([("http://a.org/", 200, "text/html", None, nginx([(f"é{i}.iso", 30 << 20) for i in range(400)]))], "url string, status int, content_type string, location string, body string")
    crawl(lake, df, ["http://a.org/"], Options(page_cap=4096), now=5)
    row = lake.table("hosts").first()
    assert row.status == "done" and row.reason == "1 listing(s) were longer than 4 KiB and cut short" and 20 < row.files < 100


def test_named_sites_go_without_the_pending_ones(spark, lake):
    df = spark.createDataFrame([(f"http://{h}.org/", 200, "text/html", None, nginx([("a.iso", 5)])) for h in "ab"], "url string, status int, content_type string, location string, body string")
    lake.add_candidates(["http://b.org/"])
    assert crawl(lake, df, ["http://a.org/"], candidates=False, now=5) == 1 and rows(lake.table("hosts"), "host", "trusted") == [("a.org", True)]
    assert crawl(lake, df, ["http://a.org/"], candidates=False, now=6) == 1  # named again, read again
    assert crawl(lake, df, now=7) == 1 and lake.table("hosts").count() == 2


def test_commits_write_buckets_of_their_sites_only(spark, tmp_path):
    lake = Lake(spark, f"file://{tmp_path}/many", buckets=8)
    lake.send(*[x for i in range(40) for x in (put(f"h{i}.org", "/", [("a.iso", i)]), done(f"h{i}.org"))], now=1)
    before = lake._manifest(lake.version())["tables"]
    assert len(before["entries"]) == 8
    lake.send(put("h3.org", "/", [("b.iso", 9)]), done("h3.org"), now=2)
    after = lake._manifest(lake.version())["tables"]
    (mine,) = lake.buckets_of(["h3.org"])
    for t in ("hosts", "dirs", "entries"):
        assert {k for k in after[t] if after[t][k] != before[t][k]} == {str(mine)}
        made = tmp_path / "many" / "tables" / t / after[t][str(mine)]
        assert {p.name for p in made.iterdir() if p.name.startswith("b=")} == {f"b={mine}"}
    assert lake.table("entries").count() == 40 and lake.table("entries").where("host = 'h3.org'").first().name == "b.iso"
    lake.forget(["h3.org"])
    last = lake._manifest(lake.version())["tables"]
    assert {k for k in last["hosts"] if last["hosts"][k] != after["hosts"][k]} <= {str(mine)} and lake.table("hosts").count() == 39
    lake.vacuum(keep=1, least_share=0)
    assert lake.table("entries").count() == 39 and lake.table("hosts").count() == 39


def test_a_message_that_fails_is_left_out(lake, monkeypatch):
    lake.send(put("a.org", "/", [("a.iso", 1)]), {"kind": "host_done", "host": "a.org", "status": "done", "judge": (None, None)}, {"kind": "host_done", "host": "b.org", "status": "done", "judge": (3, None)}, {"kind": "odd"}, now=1)
    assert rows(lake.table("hosts"), "host") == [("a.org",)]
    assert rows(lake.table("dead_letters"), "kind", "host") == [("host_done", "b.org"), ("odd", None)]


def test_an_old_lake_is_migrated(spark, tmp_path):
    import json

    lake = Lake(spark, f"file://{tmp_path}/old")
    hosts = spark.createDataFrame([("a.org", "done", None, 1, 2, 3, 4, None, False, 0)], lake.table("hosts").schema)
    dirs = spark.createDataFrame([("a.org", "http://a.org/", 1, None), ("a.org", "http://a.org/d/", 1, None), ("a.org", "http://a.org/e/", 1, False)], lake.table("dirs").schema)
    entries = spark.createDataFrame([("a.org", "http://a.org/", "d", None, True, None, None), ("a.org", "http://a.org/d/", "x.iso", None, False, 5, None)], lake.table("entries").schema)
    for t, df in (("hosts", hosts), ("dirs", dirs), ("entries", entries)):
        df.write.parquet(f"file://{tmp_path}/first/tables/{t}/v1")
    (tmp_path / "first" / "manifests").mkdir()
    (tmp_path / "first" / "manifests" / "000000000007.json").write_text(json.dumps({"hosts": "v1", "dirs": "v1", "entries": "v1"}))
    old = Lake(spark, f"file://{tmp_path}/first", create=False)
    assert old.version() == 8 and rows(old.table("dirs"), "url", "leaf") == [("http://a.org/", False), ("http://a.org/d/", True), ("http://a.org/e/", False)]
    assert rows(old.table("entries"), "name") == [("d",), ("x.iso",)] and Lake(spark, f"file://{tmp_path}/first").version() == 8


def test_what_a_stream_gives_is_written(spark, tmp_path):
    """No sink holds the result on the driver; a stream of nothing gives no rows."""
    from lakeindex.plans.demo_lake import _streamed, strike_state

    got = strike_state(spark, "/root/testdata/sf0.001")
    assert got.inputFiles() and got.count() == spark.read.parquet("/root/testdata/sf0.001/events.parquet").count()
    spark.createDataFrame([], "host string, seq long, failed boolean").write.parquet(f"{tmp_path}/none")
    for mode, make in (("append", strike_stream), ("complete", lambda r: r.groupBy("host").count())):
        assert _streamed(spark, make(spark.readStream.schema("host string, seq long, failed boolean").parquet(f"{tmp_path}/none")), mode).count() == 0
