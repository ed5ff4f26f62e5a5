"""Demonstration queries of aggregates, verdicts, joins and writes; see demo for how tables play the lake's."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeindex.functions import rules as R
from lakeindex.operators import quality as Q
from lakeindex.operators import reports
from lakeindex.operators import writes
from lakeindex.plans.demo import query, table, values

T = Q.Thresholds()

# Orders as folders of customers, their lines as files.

_ENTRIES = """(SELECT o_custkey::VARCHAR AS host, o_orderkey::VARCHAR AS dir_url, 'part' || l_partkey || (['.iso', '.txt', '.php', '.html'])[(l_partkey % 4 + 1)::INT] AS name,
 (l_quantity * (CASE WHEN l_partkey % 9 = 0 THEN 1000000 ELSE 5000 END))::BIGINT AS size FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"""
_BIG = "size >= 10485760"
_USEFUL = "(ends_with(name, '.iso') OR (ends_with(name, '.txt') AND size >= 102400))"
_COUNTS = f"count(*) AS files, sum(size)::BIGINT AS bytes, count(*) FILTER ({_BIG}) AS big, count(*) FILTER ({_USEFUL}) AS useful"


def _entries(spark, sf):
    lines, orders = table(spark, sf, "lineitem"), table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    kinds = F.array(*[F.lit(x) for x in (".iso", ".txt", ".php", ".html")])
    e = lines.select("l_orderkey", F.concat(F.lit("part"), "l_partkey", F.element_at(kinds, (F.col("l_partkey") % 4 + 1).cast("int"))).alias("name"), F.round(F.col("l_quantity") * F.when(F.col("l_partkey") % 9 == 0, 1000000).otherwise(5000)).cast("long").alias("size"))
    return e.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").cast("string").alias("host"), F.col("o_orderkey").cast("string").alias("dir_url"), "name", "size", F.lit(False).alias("is_dir"))


@query(f"SELECT host, count(*) AS files, sum(size)::BIGINT AS bytes FROM {_ENTRIES} GROUP BY host")
def host_rollup(spark, sf):
    return Q.host_counts(_entries(spark, sf)).select("host", "files", "bytes")


@query(f"SELECT host, {_COUNTS} FROM {_ENTRIES} GROUP BY host")
def quality_counts(spark, sf):
    return Q.host_counts(_entries(spark, sf))


_DIRS = "(SELECT o_custkey::VARCHAR AS host, o_orderkey::VARCHAR AS id, (o_orderkey % 4)::INT AS depth, o_orderpriority <> '1-URGENT' AS leaf FROM orders)"


def _dirs(spark, sf):
    """Folders whose depth is the order's number modulo 4."""
    o = table(spark, sf, "orders")
    steps = F.array_join(F.array_repeat(F.lit("d"), (F.col("o_orderkey") % 4).cast("int")), "/")
    return o.select(F.col("o_custkey").cast("string").alias("host"), F.col("o_orderkey").cast("string").alias("id"), F.concat(F.lit("http://"), "o_orderkey", F.lit("/"), steps, F.lit("/")).alias("url"), (F.col("o_orderpriority") != "1-URGENT").alias("leaf"))


@query(f"""WITH d AS (SELECT * FROM {_DIRS} WHERE leaf), m AS (SELECT host, max(depth) AS level FROM d GROUP BY host)
SELECT d.host, m.level, count(DISTINCT d.id) AS level_folders, count(e.name) AS level_files FROM d JOIN m ON d.host = m.host AND d.depth = m.level LEFT JOIN {_ENTRIES} e ON e.dir_url = d.id GROUP BY d.host, m.level""")
def leaf_level_sample(spark, sf):
    dirs = _dirs(spark, sf)
    entries = _entries(spark, sf).withColumnRenamed("dir_url", "id").join(dirs.select("id", "url"), "id").withColumnRenamed("url", "dir_url")
    return Q.leaf_levels(dirs, entries)


@query(f"""WITH m AS (SELECT host, max(depth) AS level FROM {_DIRS} WHERE leaf GROUP BY host), w AS (SELECT user_id::VARCHAR AS host, (event_id % 5)::INT AS depth FROM events)
SELECT w.host, count(*) FILTER (depth = level) AS at_level, max(depth) AS deepest FROM w LEFT JOIN m USING (host) GROUP BY w.host""")
def waiting_at_level(spark, sf):
    dirs, e = _dirs(spark, sf), table(spark, sf, "events")
    levels = dirs.where("leaf").groupBy("host").agg(F.max(R.url_depth(F.col("url"))).alias("level"))
    steps = F.array_join(F.array_repeat(F.lit("w"), (F.col("event_id") % 5).cast("int")), "/")
    return Q.waiting(e.select(F.col("user_id").cast("string").alias("host"), F.concat(F.lit("http://h/"), steps).alias("url")), levels)


_REASON = "printf('nothing worth keeping: %d big files (need 3) and %d useful files (need 20) among %d files', big, useful, files)"
_SUPPLIED = f"""(SELECT *, (useful * 3 + files) AS level_files, files // 4 AS level_folders, (host::INT % 3)::INT AS level, (host::INT % 4)::INT AS deepest, (host::INT % 30)::BIGINT AS at_level, host::INT * 40 AS folders_read
 FROM (SELECT l_suppkey::VARCHAR AS host, count(*) AS files, count(*) FILTER (l_quantity >= 50 AND l_suppkey % 2 = 0 AND l_linenumber = 1) AS big, count(*) FILTER (l_suppkey % 3 = 0 AND l_discount > 0.08 OR l_discount > 0.095 AND l_linenumber = 7) AS useful FROM lineitem GROUP BY l_suppkey))"""


def _supplied(spark, sf):
    li = table(spark, sf, "lineitem")
    n = lambda c: F.count_if(F.expr(c))
    rows = li.groupBy(F.col("l_suppkey").cast("string").alias("host")).agg(F.count("*").alias("files"), n("l_quantity >= 50 AND l_suppkey % 2 = 0 AND l_linenumber = 1").alias("big"), n("l_suppkey % 3 = 0 AND l_discount > 0.08D OR l_discount > 0.095D AND l_linenumber = 7").alias("useful"))
    return rows.selectExpr("*", "useful * 3 + files AS level_files", "files div 4 AS level_folders", "cast(host AS int) % 3 AS level", "cast(host AS int) % 4 AS deepest", "cast(cast(host AS int) % 30 AS bigint) AS at_level", "cast(host AS int) * 40 AS folders_read")


_KEEP = "(big >= 3 OR useful >= 20)"


@query(f"SELECT host, CASE WHEN NOT {_KEEP} THEN {_REASON} END AS reason FROM {_SUPPLIED}")
def verdict_final(spark, sf):
    return _supplied(spark, sf).select("host", Q.judge_final(T).alias("reason"))


@query(f"SELECT host, CASE WHEN NOT {_KEEP} AND files >= 100 AND big = 0 AND useful * 20 < files THEN {_REASON} END AS reason FROM {_SUPPLIED}")
def verdict_ended(spark, sf):
    return _supplied(spark, sf).select("host", Q.judge_ended(T).alias("reason"))


_CRAWLING = f"""CASE WHEN NOT {_KEEP} AND big = 0 AND ((level_files >= 100 AND useful * 20 < level_files AND level_folders >= 20 AND deepest <= level AND at_level <= level_folders)
 OR (folders_read >= 2000 AND files >= 100 AND useful * 100 < files)) THEN {_REASON} END"""


@query(f"SELECT host, {_CRAWLING} AS reason FROM {_SUPPLIED}")
def verdict_crawling(spark, sf):
    return _supplied(spark, sf).select("host", Q.judge_crawling(T).alias("reason"))


@query(f"""SELECT host, status, CASE WHEN trusted OR status NOT IN ('done', 'paused', 'partial', 'unreachable', 'not_listing') THEN NULL WHEN status = 'paused' THEN {_CRAWLING}
 WHEN status = 'done' THEN CASE WHEN NOT {_KEEP} THEN {_REASON} END ELSE CASE WHEN NOT {_KEEP} AND files >= 100 AND big = 0 AND useful * 20 < files THEN {_REASON} END END AS reason
 FROM (SELECT *, (['done', 'paused', 'partial', 'skipped'])[(host::INT % 4 + 1)::INT] AS status, host::INT % 11 = 0 AS trusted FROM {_SUPPLIED})""")
def verdict_by_status(spark, sf):
    kinds = F.array(*[F.lit(x) for x in ("done", "paused", "partial", "skipped")])
    rows = _supplied(spark, sf).withColumn("status", F.element_at(kinds, F.col("host").cast("int") % 4 + 1)).withColumn("trusted", F.col("host").cast("int") % 11 == 0)
    return rows.select("host", "status", Q.verdict(T, F.col("status"), F.col("trusted")).alias("reason"))


# Customers as hosts, orders as candidates.

_STATUS = ["done", "paused", "sensitive", "low_value", "not_listing"]
_HOSTS = """(SELECT c_name AS host, (['done', 'paused', 'sensitive', 'low_value', 'not_listing'])[(c_custkey % 5 + 1)::INT] AS status, c_custkey % 7 AS dirs, c_custkey % 13 AS files, (c_acctbal * 100)::BIGINT AS bytes, c_custkey * 37 % 1009 AS crawled_at, c_custkey FROM customer)"""
_SOURCES = ["seed", "moved", "resume", "link", "index:2026"]
_CANDIDATES = """(SELECT 'http://' || replace(c_name, '#', '-') || '/' || repeat('d/', (o_orderkey % 3)::INT) || o_orderkey || '/' AS url, c_name AS host, (['seed', 'moved', 'resume', 'link', 'index:2026'])[(o_orderkey % 5 + 1)::INT] AS source, o_orderkey % 1000 AS found_at, o_orderkey AS seq FROM orders JOIN customer ON o_custkey = c_custkey)"""


def _pick(names, number):
    return F.element_at(F.array(*[F.lit(x) for x in names]), (number % len(names) + 1).cast("int"))


def _hosts(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(F.col("c_name").alias("host"), _pick(_STATUS, k).alias("status"), (k % 7).alias("dirs"), (k % 13).alias("files"), F.round(F.col("c_acctbal") * 100).cast("long").alias("bytes"), (k * 37 % 1009).alias("crawled_at"), "c_custkey")


def _candidates(spark, sf):
    k = F.col("o_orderkey")
    rows = table(spark, sf, "orders").join(table(spark, sf, "customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(F.concat(F.lit("http://"), F.replace("c_name", F.lit("#"), F.lit("-")), F.lit("/"), F.repeat(F.lit("d/"), (k % 3).cast("int")), k, F.lit("/")).alias("url"), F.col("c_name").alias("host"), _pick(_SOURCES, k).alias("source"), (k % 1000).alias("found_at"), k.alias("seq"))


@query(f"""SELECT host, min(CASE WHEN source IN ('seed', 'moved') THEN 0 WHEN source = 'resume' THEN 1 WHEN source = 'link' THEN 2 ELSE 3 END)::INT AS priority, min(found_at) AS found_at FROM {_CANDIDATES} c
WHERE NOT EXISTS (SELECT 1 FROM {_HOSTS} h WHERE h.host = c.host AND status <> 'paused') AND c.host <> 'Customer#000000001' GROUP BY host ORDER BY 2, 3, 1 LIMIT 50""")
def pending_priority(spark, sf):
    return reports.pending(_candidates(spark, sf), _hosts(spark, sf), 50, values(spark, [("Customer#000000001",)], "host"))


@query(f"SELECT host, string_agg(url, ' ' ORDER BY len(string_split(url, '/')), seq) AS urls FROM {_CANDIDATES} GROUP BY host")
def waiting_urls(spark, sf):
    return reports.waiting_urls(_candidates(spark, sf)).select("host", F.array_join("urls", " ").alias("urls"))


_TOP = f"SELECT host, status, files, bytes, crawled_at FROM {_HOSTS}"


@query(f"{_TOP} ORDER BY bytes DESC, host LIMIT 40")
def sites_by_size(spark, sf):
    return reports.sites(_hosts(spark, sf)).select("host", "status", "files", "bytes", "crawled_at")


@query(f"{_TOP} WHERE status = 'done' ORDER BY files DESC, host LIMIT 15")
def sites_by_files(spark, sf):
    return reports.sites(_hosts(spark, sf), "done", "files", 15).select("host", "status", "files", "bytes", "crawled_at")


@query(f"{_TOP} ORDER BY crawled_at DESC, host LIMIT 40")
def sites_recent(spark, sf):
    return reports.sites(_hosts(spark, sf), sort="recent").select("host", "status", "files", "bytes", "crawled_at")


@query(f"{_TOP} ORDER BY host LIMIT 40")
def sites_by_name(spark, sf):
    return reports.sites(_hosts(spark, sf), sort="name").select("host", "status", "files", "bytes", "crawled_at")


@query(f"SELECT status, count(*) AS hosts, sum(files)::BIGINT AS files, sum(bytes)::BIGINT AS bytes FROM {_HOSTS} GROUP BY status")
def stats_by_status(spark, sf):
    return reports.stats(_hosts(spark, sf))


@query(f"SELECT source, count(*) AS urls, count(DISTINCT host) AS hosts FROM {_CANDIDATES} GROUP BY source")
def candidate_stats(spark, sf):
    return reports.candidate_stats(_candidates(spark, sf))


@query("SELECT page_id FROM pages WHERE url >= 'http://th' AND url < 'http://ti'")
def range_subtree(spark, sf):
    """A subtree of URLs is a half-open range; readers of sorted files prune by it."""
    return table(spark, sf, "pages").where(writes.in_range(F.col("url"), "http://th", "http://ti")).select("page_id")


# Copies, discovery.


@query("SELECT min(doc_id) AS first_doc, count(*) AS copies FROM documents GROUP BY text HAVING count(*) > 1")
def duplicate_docs(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.sha2("text", 256).alias("h"), F.length("text").alias("n"))
    return d.groupBy("h", "n").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies")).where("copies > 1").select("first_doc", "copies")


@query("SELECT page_id, url FROM pages WHERE page_id % 4 <> 0 ORDER BY page_id LIMIT 30")
def index_incremental(spark, sf):
    """The manifest in its order without what is done."""
    from lakeindex.sources.index import remaining

    m = table(spark, sf, "pages").select(F.col("page_id").alias("pos"), F.col("url").alias("path"))
    todo = remaining(m, m.where("pos % 4 = 0").select("path"), 30)
    return todo.select(F.col("pos").alias("page_id"), F.col("path").alias("url"))
