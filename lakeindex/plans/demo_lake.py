"""Demonstration queries that run a lake's writes, cleaning, discovery and searches, walks over page snapshots, and streams.

Customers play sites, their orders folders, and lines files. A lake that several queries read is made once for each session and
data folder; what it is made of are messages, as walks and users send them.
"""

from __future__ import annotations

import contextlib
import io
import tempfile
from collections.abc import Callable
from uuid import uuid4

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeindex.lake import Lake
from lakeindex.operators import quality as Q
from lakeindex.plans.cli import run
from lakeindex.plans.crawl import Options, crawl
from lakeindex.plans.demo import query, table
from lakeindex.plans.discover import discover
from lakeindex.sources.listing import entry_rows, parse_pages
from lakeindex.sources.robots import Robots
from lakeindex.streaming.messages import apply_stream, read_log, strike_stream, windowed_counts

_LAKES: dict[tuple, Lake] = {}


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that all executors see: under the cluster's checkpoint folder; a local master may do with a temporary one."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not top and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return f"{(top or tempfile.mkdtemp(prefix='lake-')).rstrip('/')}/{name}-{uuid4().hex}"


def lake_of(make: Callable[[SparkSession, str, Lake], None], spark: SparkSession, sf: str) -> Lake:
    """The lake that `make` fills, made once."""
    key = make.__name__, spark.sparkContext.applicationId, sf
    if key not in _LAKES:
        lake = Lake(spark, shared_folder(spark, make.__name__.strip("_")))
        make(spark, sf, lake)
        _LAKES[key] = lake
    return _LAKES[key]


def _said(kind: str, rows: DataFrame, **columns: Column | str) -> DataFrame:
    """Messages of one kind; texts name expressions."""
    return rows.select(F.lit(kind).alias("kind"), *[(F.expr(v) if isinstance(v, str) else v).alias(k) for k, v in columns.items()])


def _together(*messages: DataFrame) -> DataFrame:
    out = messages[0]
    for m in messages[1:]:
        out = out.unionByName(m, allowMissingColumns=True)
    return out


# Writes: even orders are listed first; then come those that 3 divides, with their odd lines only.

_URL = "concat('http://c', o_custkey, '.example.org/o', o_orderkey, '/')"


def _listings_of(orders: DataFrame, lines: DataFrame, seq: str, size: str) -> DataFrame:
    entry = f"struct(concat(url, 'f', l_linenumber, '.iso') AS url, concat('f', l_linenumber, '.iso') AS name, false AS is_dir, cast({size} AS bigint) AS size, cast(null AS string) AS mtime)"
    rows = orders.selectExpr("o_orderkey", "o_custkey", f"{_URL} AS url").join(lines, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderkey", "o_custkey").agg(F.collect_list(F.expr(entry)).alias("entries"))
    return _said("entries", rows, seq=seq, now="1L", host="concat('c', o_custkey, '.example.org.')", entries="entries", leaf="true")


def _store(spark: SparkSession, sf: str, lake: Lake) -> None:
    o, li = table(spark, sf, "orders").select("o_orderkey", "o_custkey"), table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    even, third = o.where("o_orderkey % 2 = 0"), o.where("o_orderkey % 3 = 0")
    first = even.groupBy("o_custkey").agg(F.max("o_orderkey").alias("k"), F.count("*").alias("n"))
    then = third.groupBy("o_custkey").agg(F.min("o_orderkey").alias("k"), F.count("*").alias("n"))
    host = "concat('C', o_custkey, '.Example.org')"
    lake.apply(_together(_listings_of(even, li, "o_orderkey", "l_quantity * 1000"), _said("host_done", first, seq="1L << 40", now="2L", host=host, status="if(o_custkey % 3 = 0, 'paused', 'done')", server="concat('srv', k)", dirs="n", trusted="o_custkey % 4 = 0", failed="false")))
    lake.apply(_together(_listings_of(third, li.where("l_linenumber % 2 = 1"), "o_orderkey", "l_quantity * 2000"), _said("host_done", then, seq="1L << 40", now="3L", host=host, status="'done'", server="if(o_custkey % 5 = 0, null, concat('new', k))", dirs="n", trusted="o_custkey % 6 = 0", failed="false")))


_STORE = """n AS (SELECT o_custkey, o_orderkey, l_linenumber, (l_quantity * 2000)::BIGINT AS size FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderkey % 3 = 0 AND l_linenumber % 2 = 1),
e AS (SELECT * FROM n UNION ALL SELECT o_custkey, o_orderkey, l_linenumber, (l_quantity * 1000)::BIGINT FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderkey % 2 = 0 AND o_orderkey NOT IN (SELECT o_orderkey FROM n)),
h AS (SELECT 'c' || o_custkey || '.example.org' AS host, count(*) AS files, sum(size)::BIGINT AS bytes FROM e GROUP BY o_custkey)"""
_STORED = "(SELECT 'c' || o_custkey || '.example.org' AS host, 'srv' || max(o_orderkey) AS server, (CASE WHEN o_custkey % 3 = 0 THEN 'paused' ELSE 'done' END) AS status, count(*) AS dirs, o_custkey % 4 = 0 AS trusted, 2 AS at FROM orders WHERE o_orderkey % 2 = 0 GROUP BY o_custkey)"
_ARRIVING = "(SELECT 'c' || o_custkey || '.example.org' AS host, CASE WHEN o_custkey % 5 = 0 THEN NULL ELSE 'new' || min(o_orderkey) END AS server, 'done' AS status, count(*) AS dirs, o_custkey % 6 = 0 AS trusted, 3 AS at FROM orders WHERE o_orderkey % 3 = 0 GROUP BY o_custkey)"


@query(f"WITH {_STORE} SELECT 'http://c' || o_custkey || '.example.org/o' || o_orderkey || '/f' || l_linenumber || '.iso' AS url, size FROM e")
def lake_files(spark, sf):
    """New listings replace the folders that they have entries of: the files view afterwards."""
    return lake_of(_store, spark, sf).files().select("url", "size")


@query(f"""WITH {_STORE} SELECT host, coalesce(n.server, o.server) AS server, coalesce(n.status, o.status) AS status, CASE WHEN n.host IS NULL THEN o.dirs ELSE n.dirs + CASE WHEN o.status = 'paused' THEN o.dirs ELSE 0 END END AS dirs,
 coalesce(h.files, 0) AS files, coalesce(h.bytes, 0) AS bytes, coalesce(n.at, o.at)::BIGINT AS crawled_at, coalesce(n.trusted, false) OR coalesce(o.trusted, false) AS trusted FROM {_STORED} o FULL JOIN {_ARRIVING} n USING (host) LEFT JOIN h USING (host)""")
def lake_hosts(spark, sf):
    """Runs of sites, rolled up: folders add up over pauses, a server stays until another is known, trust never goes."""
    return lake_of(_store, spark, sf).table("hosts").select("host", "server", "status", "dirs", "files", "bytes", "crawled_at", "trusted")


@query(f"WITH {_STORE} SELECT 'http://c' || o_custkey || '.example.org/o' || o_orderkey || '/' AS url, true AS leaf, count(*) AS files, sum(size)::BIGINT AS bytes FROM e GROUP BY o_custkey, o_orderkey")
def lake_folders(spark, sf):
    """Folders joined with what they hold, in SQL over the lake's tables."""
    return lake_of(_store, spark, sf).sql("SELECT d.url, d.leaf, count(e.name) AS files, sum(e.size) AS bytes FROM dirs d JOIN entries e ON e.dir_url = d.url AND NOT e.is_dir GROUP BY d.url, d.leaf")


@query(f"""WITH {_STORE}, d AS (SELECT o_custkey, count(DISTINCT o_orderkey) AS k FROM e GROUP BY o_custkey)
SELECT host, files, bytes, (SELECT count(*) FROM e WHERE 'c' || o_custkey || '.example.org' = h.host AND size >= 10485760) AS big, files AS useful, 1 AS level, k AS level_folders, files AS level_files,
 coalesce((SELECT CASE WHEN n.host IS NULL THEN o.dirs ELSE n.dirs + CASE WHEN o.status = 'paused' THEN o.dirs ELSE 0 END END FROM {_STORED} o FULL JOIN {_ARRIVING} n USING (host) WHERE coalesce(o.host, n.host) = h.host), 0) AS folders_read
FROM h JOIN d ON h.host = 'c' || o_custkey || '.example.org'""")
def lake_progress(spark, sf):
    """How far each site was read and what it holds, as verdicts take it."""
    lake = lake_of(_store, spark, sf)
    return Q.progress(lake.table("dirs"), lake.table("entries"), lake.table("hosts")).select("host", "files", "bytes", "big", "useful", "level", "level_folders", "level_files", "folders_read")


@query(f"WITH {_STORE} SELECT 'http://c' || o_custkey || '.example.org/o' || o_orderkey || '/f' || l_linenumber || '.iso' AS url FROM e WHERE o_custkey NOT IN (1, 4) AND NOT (o_custkey = 7 AND o_orderkey = (SELECT min(o_orderkey) FROM e WHERE o_custkey = 7))")
def lake_forgotten(spark, sf):
    """Two sites are forgotten, with one folder of a third; another version of the same lake has them still."""
    return lake_of(_forgotten, spark, sf).files().select("url")


def _forgotten(spark: SparkSession, sf: str, lake: Lake) -> None:
    stored = lake_of(_store, spark, sf)
    lake.commit(**{t: stored.table(t) for t in ("hosts", "dirs", "entries")})
    lake.forget(["C1.example.org.", "c4.example.org"])
    row = lake.table("dirs").where("host = 'c7.example.org'").select(F.min(F.regexp_extract("url", "/o([0-9]+)/", 1).cast("long")).alias("k")).first()
    if row.k is not None:
        lake.delete_subtree(f"http://c7.example.org/o{row.k}/")


# Candidates, trust, pauses. Sources go by the remainder of a customer's or an order's number.

_SOURCES = "CASE {0} % 4 WHEN 0 THEN '{1}' WHEN 1 THEN '{2}' WHEN 2 THEN '{3}' ELSE '{4}' END"
_OLD_SOURCE, _NEW_SOURCE = _SOURCES.format("o_custkey", "seed", "moved", "resume", "link"), _SOURCES.format("o_orderkey", "link", "seed", "resume", "moved")
_PLACE = "concat('http://h', o_custkey % 50, '.example.org/c', o_custkey, '/')"


def _addresses(spark: SparkSession, sf: str, lake: Lake) -> None:
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    old = o.where("o_orderkey % 2 = 0").select("o_custkey").distinct()
    lake.apply(_said("candidates", old, seq="o_custkey", now="1L", urls=f"array({_PLACE})", source=_OLD_SOURCE))
    lake.apply(_said("host_done", table(spark, sf, "nation"), seq="cast(n_nationkey AS bigint)", now="2L", host="concat('h', n_nationkey, '.example.org')", status="if(n_nationkey % 2 = 0, 'paused', 'done')", dirs="1L", failed="false"))
    lake.apply(_said("candidates", o.where("o_orderkey % 3 = 0"), seq="o_orderkey", now="3L", urls=f"array({_PLACE}, 'mailto:nobody')", source=_NEW_SOURCE))


_FROM = "'http://h' || o_custkey % 50 || '.example.org/c' || o_custkey || '/'"
_ADDRESSES = f"""old AS (SELECT DISTINCT o_custkey, o_custkey % 50 AS h, {_OLD_SOURCE} AS source FROM orders WHERE o_orderkey % 2 = 0),
new AS (SELECT o_custkey, o_custkey % 50 AS h, o_orderkey AS seq, {_NEW_SOURCE} AS source FROM orders WHERE o_orderkey % 3 = 0),
known AS (SELECT o_custkey, source, 0 AS seq FROM old WHERE h >= 25 OR h % 2 = 0),
first AS (SELECT o_custkey, arg_min(source, seq) AS source, min(seq) AS seq FROM new WHERE o_custkey NOT IN (SELECT o_custkey FROM known) AND (h >= 25 OR h % 2 = 0 AND source = 'resume') GROUP BY o_custkey),
stored AS (SELECT * FROM known UNION ALL SELECT * FROM first),
marks AS (SELECT s.o_custkey, bool_or(n.source = 'seed') AS seed, bool_or(n.source = 'moved') AS moved FROM stored s JOIN new n ON n.o_custkey = s.o_custkey AND n.seq > s.seq GROUP BY s.o_custkey)"""


@query(f"""WITH {_ADDRESSES} SELECT {_FROM} AS url, CASE WHEN source IN ('seed', 'resume') THEN source WHEN seed THEN 'seed' WHEN moved THEN 'moved' ELSE source END AS source FROM stored LEFT JOIN marks USING (o_custkey)""")
def lake_candidates(spark, sf):
    """The first address of a URL counts, later ones may promote it; read sites take none but what paused ones resume with."""
    return lake_of(_addresses, spark, sf).table("candidates").select("url", "source")


@query(f"""WITH {_ADDRESSES} SELECT 'h' || n_nationkey || '.example.org' AS host, CASE WHEN n_nationkey % 2 = 0 THEN 'paused' ELSE 'done' END AS status,
 EXISTS (SELECT 1 FROM old WHERE h = n_nationkey AND source IN ('seed', 'moved')) OR EXISTS (SELECT 1 FROM new WHERE h = n_nationkey AND source IN ('seed', 'moved')) AS trusted FROM nation""")
def lake_trust(spark, sf):
    """Addresses that users typed, or that these moved to, make their site trusted, whenever they come."""
    return lake_of(_addresses, spark, sf).table("hosts").select("host", "status", "trusted")


@query(f"""WITH {_ADDRESSES}, c AS (SELECT o_custkey, CASE WHEN source IN ('seed', 'resume') THEN source WHEN seed THEN 'seed' WHEN moved THEN 'moved' ELSE source END AS source FROM stored LEFT JOIN marks USING (o_custkey))
SELECT 'h' || o_custkey % 50 || '.example.org' AS host, min(CASE WHEN source IN ('seed', 'moved') THEN 0 WHEN source = 'resume' THEN 1 ELSE 2 END)::INT AS priority, count(*) AS waiting, count(*) FILTER (source = 'seed') AS seeds FROM c GROUP BY o_custkey % 50""")
def lake_pending(spark, sf):
    """The sites to read next, with their URLs."""
    p = lake_of(_addresses, spark, sf).pending(1000)
    return p.select("host", "priority", F.size("urls").cast("long").alias("waiting"), F.size("seeds").cast("long").alias("seeds"))


_STATUSES = ("done", "paused", "partial", "unreachable", "not_listing", "low_value", "sensitive", "skipped", "opted_out")
_STATUS_SQL = "(['" + "', '".join(_STATUSES) + "'])[(c_custkey % 9 + 1)::INT]"


def _seeded(spark: SparkSession, sf: str, lake: Lake) -> None:
    c = table(spark, sf, "customer").select("c_custkey")
    names = "array('" + "', '".join(_STATUSES) + "')"
    lake.apply(_said("host_done", c, seq="c_custkey", now="1L", host="concat('c', c_custkey, '.org')", status=f"element_at({names}, cast(c_custkey % 9 + 1 AS int))", dirs="1L", failed="false"))
    typed = c.where("c_custkey % 4 <> 3").select("c_custkey", F.expr("if(c_custkey % 4 = 0, 'moved', 'seed') AS source"))
    lake.apply(_said("candidates", typed, seq="c_custkey", now="2L", urls="array(concat('http://c', c_custkey, '.org/'))", source="source"))


@query(f"""WITH h AS (SELECT c_custkey, {_STATUS_SQL} AS status, c_custkey % 4 <> 3 AS typed, c_custkey % 4 NOT IN (0, 3) AS seed FROM customer),
x AS (SELECT *, typed AND (status IN ('not_listing', 'unreachable', 'partial', 'low_value') OR status = 'sensitive' AND seed) AS opened FROM h)
SELECT 'c' || c_custkey || '.org' AS host, CASE WHEN NOT opened THEN status END AS status, NOT opened AND typed AND status <> 'sensitive' AS trusted, opened AS waits FROM x""")
def lake_seeds(spark, sf):
    """Typed addresses open sites again that had ended badly, and trust the others."""
    lake = lake_of(_seeded, spark, sf)
    waiting = lake.table("candidates").select("host").distinct().withColumn("waits", F.lit(True))
    rows = lake.table("hosts").select("host", "status", "trusted").join(waiting, "host", "full")
    return rows.select("host", "status", F.coalesce("trusted", F.lit(False)).alias("trusted"), F.coalesce("waits", F.lit(False)).alias("waits"))


def _paused(spark: SparkSession, sf: str, lake: Lake) -> None:
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    lake.apply(_said("candidates", o, seq="o_orderkey", now="1L", urls="array(concat('http://c', o_custkey, '.org/o', o_orderkey, '/'))", source="CASE o_orderkey % 3 WHEN 0 THEN 'link' WHEN 1 THEN 'resume' ELSE if(o_custkey % 2 = 0, 'seed', 'link') END"))
    pause = o.groupBy("o_custkey").agg(F.expr("collect_list(concat('http://c', o_custkey, '.org/o', o_orderkey, '/')) FILTER (WHERE o_orderkey % 2 = 0)").alias("finished"), F.expr("collect_list(concat('http://c', o_custkey, '.org/f', o_orderkey, '/')) FILTER (WHERE o_orderkey % 5 = 0)").alias("frontier"))
    lake.apply(_together(*[_said(kind, pause, seq=f"{i}L", now="2L", host="concat('c', o_custkey, '.org')", **more) for i, (kind, more) in enumerate([("paused", {"finished": "finished", "frontier": "frontier"}), ("host_done", {"status": "'paused'", "dirs": "1L", "failed": "false"})])]))


@query("""SELECT 'http://c' || o_custkey || '.org/o' || o_orderkey || '/' AS url FROM orders WHERE o_orderkey % 3 = 1 AND o_orderkey % 2 <> 0 UNION ALL SELECT 'http://c' || o_custkey || '.org/f' || o_orderkey || '/' FROM orders WHERE o_orderkey % 5 = 0""")
def lake_paused(spark, sf):
    """A paused site goes on with its old and new frontier, without what is finished."""
    return lake_of(_paused, spark, sf).table("candidates").where("source = 'resume'").select("url")


@query("SELECT 'c' || o_custkey || '.org' AS host, 'paused' AS status, bool_or(o_orderkey % 3 = 2 AND o_custkey % 2 = 0) AS trusted FROM orders GROUP BY o_custkey")
def lake_paused_trust(spark, sf):
    """A pause keeps what typed addresses said of the site."""
    return lake_of(_paused, spark, sf).table("hosts").select("host", "status", "trusted")


# The ledger of index files, and messages that make no sense.


def _ledger(spark: SparkSession, sf: str, lake: Lake) -> None:
    files = table(spark, sf, "pages").groupBy((F.col("page_id") % 10).alias("k")).agg(F.sort_array(F.collect_list("url")).alias("urls"))
    one = _said("cc_file_done", files, seq="k", now="k + 5", urls="urls", source="'index'", path="if(k = 9, null, concat('part-', k))")
    again = _said("cc_file_done", files.where("k < 3"), seq="k + 100", now="100L", urls="slice(urls, 1, 2)", source="'index'", path="concat('part-', k)")
    bad = _said("host_done", files, seq="k + 200", now="1L", host="if(k % 2 = 0, null, 'a.org')", status="if(k % 2 = 1, 'odd', 'done')")
    lake.apply(_together(one, again, bad, _said("what", files, seq="k + 300", now="1L")))


@query("SELECT 'part-' || (page_id % 10) AS path, CASE WHEN page_id % 10 < 3 THEN least(count(*), 2) ELSE count(*) END AS candidates, CASE WHEN page_id % 10 < 3 THEN 100 ELSE page_id % 10 + 5 END AS done_at FROM pages WHERE page_id % 10 <> 9 GROUP BY page_id % 10")
def lake_ledger(spark, sf):
    """Index files that are done, each once, with what they gave last."""
    return lake_of(_ledger, spark, sf).table("cc_files").select("path", "candidates", "done_at")


@query("""WITH k AS (SELECT DISTINCT page_id % 10 AS k FROM pages) SELECT 9 AS seq, 'cc_file_done' AS kind, 'no path' AS why FROM k WHERE k = 9 UNION ALL SELECT k + 300, 'what', 'unknown kind' FROM k UNION ALL SELECT k + 200, 'host_done', CASE WHEN k % 2 = 0 THEN 'no host' ELSE 'unknown status' END FROM k""")
def lake_dead_letters(spark, sf):
    return lake_of(_ledger, spark, sf).table("dead_letters").select("seq", "kind", "why")


# Failed runs, from events: a site's users' runs in their order.

_RUNS = "SELECT user_id, event_id, event_type = 'error' OR event_id % 3 <> 0 AS failed, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events"
_ISLANDS = f"""e AS ({_RUNS}), i AS (SELECT *, sum(CASE WHEN failed THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY seq) AS island FROM e),
k AS (SELECT *, sum(CASE WHEN failed THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, island ORDER BY seq) AS n FROM i)"""


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    seq = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).cast("long")
    return table(spark, sf, "events").select("user_id", seq.alias("seq"), ((F.col("event_type") == "error") | (F.col("event_id") % 3 != 0)).alias("failed"))


def _struck(spark: SparkSession, sf: str, lake: Lake) -> None:
    runs, host = _runs(spark, sf), "concat('u', user_id, '.org')"
    entry = "array(struct(concat('http://u', user_id, '.org/a.iso') AS url, 'a.iso' AS name, false AS is_dir, 5L AS size, cast(null AS string) AS mtime))"
    files = _said("entries", runs.where("seq = 1 AND user_id % 2 = 0"), seq="0L", now="1L", host=host, entries=entry, leaf="true")
    lake.apply(_together(files, _said("host_done", runs, seq="seq", now="seq", host=host, status="if(failed, 'paused', 'done')", dirs="1L", reason="if(failed, 'down', null)", failed="failed")))


@query(f"""WITH {_ISLANDS} SELECT 'u' || user_id || '.org' AS host, CASE WHEN NOT failed THEN 'done' WHEN n % 5 = 0 THEN CASE WHEN user_id % 2 = 0 THEN 'partial' ELSE 'unreachable' END ELSE 'paused' END AS status,
CASE WHEN failed THEN n % 5 ELSE 0 END::INT AS fails, CASE WHEN failed AND n % 5 = 0 THEN 'gave up after 5 runs in a row that ended in errors (down)' WHEN failed THEN 'down' END AS reason FROM k QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) = 1""")
def lake_strikes(spark, sf):
    """Five failed runs in a row end a site; what it holds says how."""
    return lake_of(_struck, spark, sf).table("hosts").select("host", "status", "fails", "reason")


@query(f"WITH {_ISLANDS} SELECT user_id::VARCHAR AS host, seq, CASE WHEN failed THEN n % 5 ELSE 0 END::INT AS fails FROM k")
def strike_state(spark, sf):
    """Strikes after each run, as a stream keeps them by site."""
    src = shared_folder(spark, "runs")
    _runs(spark, sf).select(F.col("user_id").cast("string").alias("host"), "seq", "failed").repartition("host").write.parquet(src)
    return _streamed(spark, strike_stream(spark.readStream.schema("host string, seq long, failed boolean").parquet(src)), "append")


def _streamed(spark: SparkSession, rows: DataFrame, mode: str) -> DataFrame:
    """What a stream gives from its start to its end, written where all executors see it: the driver holds none of it."""
    out = shared_folder(spark, "streamed")
    spark.createDataFrame([], rows.schema).write.parquet(f"{out}/batch=-1")  # a stream of nothing has no batch

    def put(batch: DataFrame, number: int) -> None:
        # A batch that is tried again replaces itself; in complete mode, the last one is the result.
        batch.write.mode("overwrite").parquet(f"{out}/batch={number if mode == 'append' else 0}")

    rows.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", shared_folder(spark, "stream")).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(rows.schema).parquet(out).select(*rows.columns)


@query("SELECT 'u' || user_id || '.org' AS host, 'paused' AS status, count(*) AS dirs, max(event_id) AS crawled_at FROM events GROUP BY user_id")
def stream_apply(spark, sf):
    """The message log as a stream of files, applied batch by batch: folders add up over the batches."""
    log = _said("host_done", table(spark, sf, "events"), seq="event_id", now="event_id", host="concat('u', user_id, '.org')", status="'paused'", dirs="1L", failed="false")
    at = shared_folder(spark, "log")
    for i in range(2):  # the second file is the later one
        log.where(f"event_id {'<' if not i else '>='} 500").coalesce(1).write.mode("append").json(at)
    lake = Lake(spark, shared_folder(spark, "lake"))
    apply_stream(lake, read_log(spark, at, 1), shared_folder(spark, "applied")).awaitTermination()
    return lake.table("hosts").select("host", "status", "dirs", "crawled_at")


@query("SELECT event_type, time_bucket(INTERVAL '10 minutes', ts)::VARCHAR AS start, count(*) AS n FROM events GROUP BY 1, 2")
def stream_windows(spark, sf):
    """Events in windows of their own time."""
    src = table(spark, sf, "events")
    events = spark.readStream.schema(src.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    rows = _streamed(spark, windowed_counts(events.withColumn("ts", F.col("ts").cast("timestamp"))), "complete")
    return rows.select("event_type", F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


# Cleaning: customers' sites in ten domains, one of them opted out and one skipped; some names are exposed.

_NAME = "CASE WHEN l_partkey % 97 = 7 AND l_linenumber = 1 THEN 'id_rsa' WHEN l_partkey % 89 = 3 THEN 'backup-2020.zip' ELSE concat('part', l_partkey, if(l_partkey % 2 = 0, '.iso', '.html')) END"
_CLEAN = """e AS (SELECT o_custkey AS c, o_orderkey AS o, o_orderkey % 13 = 0 AS logs, l_linenumber AS l, (l_quantity * CASE WHEN l_partkey % 9 = 0 THEN 1000000 ELSE 5000 END)::BIGINT AS size,
 CASE WHEN l_partkey % 97 = 7 AND l_linenumber = 1 THEN 2 WHEN l_partkey % 89 = 3 THEN 1 ELSE 0 END AS level, l_partkey % 2 = 0 AS iso, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
d AS (SELECT o_custkey AS c, o_orderkey AS o, o_orderkey % 13 = 0 AS logs FROM orders WHERE o_custkey % 10 NOT IN (7, 8)),
a AS (SELECT * FROM e WHERE c % 10 NOT IN (7, 8) AND NOT logs),
x AS (SELECT DISTINCT c FROM a WHERE level = 2 OR level = 1 AND c % 4 <> 0),
b AS (SELECT * FROM a WHERE c NOT IN (FROM x) AND level = 0),
q AS (SELECT h.c FROM (SELECT DISTINCT o_custkey AS c FROM orders WHERE o_custkey % 10 NOT IN (7, 8) AND o_custkey % 4 <> 0) h LEFT JOIN b ON b.c = h.c WHERE h.c NOT IN (FROM x) GROUP BY h.c
 HAVING count(b.c) FILTER (size >= 10485760) < 3 AND count(b.c) FILTER (iso) < 20)"""


def _cleaned(spark: SparkSession, sf: str, lake: Lake) -> None:
    o, li = table(spark, sf, "orders").select("o_orderkey", "o_custkey"), table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")
    host = "concat('c', o_custkey, '.g', o_custkey % 10, '.example.org')"
    dirs = o.selectExpr(f"{host} AS host", "concat('http://', " + host + ", if(o_orderkey % 13 = 0, '/Logs/o', '/o'), o_orderkey, '/') AS url", "1L AS seen_at", "true AS leaf", "o_orderkey")
    entries = dirs.join(li, F.col("o_orderkey") == F.col("l_orderkey")).selectExpr("host", "url AS dir_url", f"{_NAME} AS name", "concat('l', l_linenumber) AS href", "false AS is_dir", "cast(l_quantity * if(l_partkey % 9 = 0, 1000000, 5000) AS bigint) AS size", "cast(null AS string) AS mtime")
    hosts = o.select("o_custkey").distinct().selectExpr(f"{host} AS host", "'done' AS status", "cast(null AS string) AS server", "1L AS dirs", "0L AS files", "0L AS bytes", "1L AS crawled_at", "cast(null AS string) AS reason", "o_custkey % 4 = 0 AS trusted", "0 AS fails")
    lake.commit(hosts=hosts, dirs=dirs, entries=entries)
    lake.report = lake.clean(optout=["*.G7.example.org."], skip_hosts=["g8.example.org"], skip_folders=["logs"], now=5)


_H = "'c' || c || '.g' || c % 10 || '.example.org'"


@query(f"""WITH {_CLEAN} SELECT CASE WHEN c % 10 = 7 THEN 'opted_out' ELSE 'skipped' END AS action, {_H} AS host, 0::BIGINT AS n FROM (SELECT DISTINCT o_custkey AS c FROM orders WHERE o_custkey % 10 IN (7, 8)) UNION ALL SELECT 'skipped_dirs', NULL, n FROM (SELECT count(*) AS n FROM d WHERE logs) WHERE n > 0
UNION ALL SELECT 'sensitive', {_H}, 0 FROM x UNION ALL SELECT 'omitted', NULL, n FROM (SELECT count(*) AS n FROM a WHERE c NOT IN (FROM x) AND level = 1) WHERE n > 0 UNION ALL SELECT 'low_value', {_H}, 0 FROM q""")
def lake_clean(spark, sf):
    """The report: opt-outs, skipped sites and folders, exposure, quality, each over what the one before left."""
    return lake_of(_cleaned, spark, sf).report.select("action", "host", "n")


@query(f"WITH {_CLEAN} SELECT 'http://' || {_H} || '/o' || o || '/l' || l AS url, size FROM b WHERE c NOT IN (FROM q)")
def lake_clean_files(spark, sf):
    """The files that cleaning leaves."""
    return lake_of(_cleaned, spark, sf).files().select("url", "size")


@query(f"WITH {_CLEAN}, h AS (SELECT DISTINCT o_custkey AS c FROM orders) SELECT status, count(*) AS hosts FROM (SELECT CASE WHEN c % 10 = 7 THEN 'opted_out' WHEN c % 10 = 8 THEN 'skipped' WHEN c IN (FROM x) THEN 'sensitive' WHEN c IN (FROM q) THEN 'low_value' ELSE 'done' END AS status FROM h) GROUP BY status")
def lake_clean_stats(spark, sf):
    """Tombstones by status after cleaning."""
    return lake_of(_cleaned, spark, sf).stats().select("status", "hosts")


@query(f"WITH {_CLEAN} SELECT {_H} AS host FROM x")
def lake_sensitive(spark, sf):
    """Sites dropped for what they expose, with a reason each."""
    return lake_of(_cleaned, spark, sf).sensitive_hosts().where("reason LIKE 'exposed: http://%'").select("host")


@query("SELECT 'none' AS action WHERE false")
def lake_clean_again(spark, sf):
    """A second cleaning finds nothing."""
    return lake_of(_cleaned, spark, sf).clean(optout=["g7.example.org"], skip_hosts=["g8.example.org"], skip_folders=["logs"], now=6).select("action")


# Listings in the ways of six servers.

_SHAPES = """(SELECT s, l_partkey AS p, p_size AS n FROM (SELECT DISTINCT l_suppkey AS s, l_partkey FROM lineitem) JOIN part ON l_partkey = p_partkey)"""


def _shapes(spark: SparkSession, sf: str) -> DataFrame:
    """A page for each supplier: its parts, written by the server that the supplier's number stands for."""
    parts = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("s"), F.col("l_partkey").alias("p")).distinct().join(table(spark, sf, "part").select(F.col("p_partkey").alias("p"), F.col("p_size").alias("n")), "p")
    a = "concat('<a href=\"part', p, '.iso\">part', p, '.iso</a>')"
    rows = [
        f"concat({a}, '    28-Sep-2026 10:15    ', n * 1000)", f"concat('<tr><td><img alt=\"[ ]\"></td><td>', {a}, '</td><td align=\"right\">2026-09-28 10:15  </td><td align=\"right\">', n, 'M</td></tr>')",
        "concat('<br> 9/28/2026 10:15 AM    ', n * 7, ' <A HREF=\"/s', s, '/part', p, '.iso\">part', p, '.iso</A>')", f"concat('<tr><td class=\"n\">', {a}, '</td><td class=\"m\">2026-Sep-28 10:15:22</td><td class=\"s\">', n, '.5K</td><td class=\"t\">x</td></tr>')", f"concat('<li>', {a}, '</li>')",
        "to_json(struct(concat('part', p, '.iso') AS name, n AS size, concat('./part', p, '.iso') AS url, '2026-09-28T10:15:22.1Z' AS mod_time, false AS is_dir))",
    ]
    heads = ['<title>Index of /</title><a href="../">../</a><pre>', "<h1>Index of /x</h1><address>Apache/2.4</address><table>", "<pre>[To Parent Directory]<br>", '<h2>Index of /</h2><div class="list"><table>', "<title>Directory listing for /</title><ul>", "["]
    pick = lambda each: f"element_at(array({', '.join(each)}), cast(s % 6 + 1 AS int))"
    pages = parts.select("s", F.expr(pick(rows)).alias("row")).groupBy("s").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    body = F.expr(f"concat({pick([repr(h) for h in heads])}, if(s % 6 = 5, concat(array_join(rows, ','), ']'), array_join(rows, '\\n')))")
    return pages.select(F.expr("concat('http://ftp.example.org/s', s, '/') AS url"), F.expr("if(s % 6 = 5, 'application/json', 'text/html') AS content_type"), body.alias("body"))


@query(f"""SELECT 'http://ftp.example.org/s' || s || '/' AS dir_url, (['nginx', 'apache', 'iis', 'lighttpd', 'python-http', 'caddy'])[(s % 6 + 1)::INT] AS server, 'part' || p || '.iso' AS name,
CASE s % 6 WHEN 0 THEN n * 1000 WHEN 1 THEN n * 1048576 WHEN 2 THEN n * 7 WHEN 3 THEN n * 1024 + 512 WHEN 5 THEN n END::BIGINT AS size, CASE WHEN s % 6 IN (0, 1, 2) THEN '2026-09-28 10:15' WHEN s % 6 IN (3, 5) THEN '2026-09-28 10:15:22' END AS mtime FROM {_SHAPES}""")
def listing_rows(spark, sf):
    """Pages of six servers, parsed to typed rows."""
    return entry_rows(parse_pages(_shapes(spark, sf)), ["server"]).select("dir_url", "server", "name", "size", "mtime")


@query("""WITH p AS (SELECT p_partkey AS k FROM part) SELECT k, 'entry' AS kind, 'http://h.org/pub/p' || k || '/a%20b' || k || '.iso' AS url, 'a b' || k || '.iso' AS name, false AS is_dir FROM p UNION ALL SELECT k, 'entry', 'http://h.org/pub/p' || k || '/sub/', 'sub', true FROM p
UNION ALL SELECT k, 'entry', 'http://h.org/pub/p' || k || '/x&y.txt', 'x&y.txt', false FROM p UNION ALL SELECT k, 'entry', 'http://h.org/pub/p' || k || '/%C3%A9.bin', 'é.bin', false FROM p UNION ALL SELECT k, 'other', 'http://h.org/pub2/', NULL, NULL FROM p UNION ALL SELECT k, 'external', 'http://o' || k || '.org/z/', NULL, NULL FROM p""")
def listing_links(spark, sf):
    """Links of all kinds on a page: relative, absolute, encoded, commented out, doubled, sorted by, up, away."""
    links = ["./a%20b{k}.iso", "/pub/p{k}/sub/", "x&amp;y.txt", "é.bin", "../../pub2/", "http://O{k}.org/z/", "?C=N;O=D", "../", "mailto:a@b", "sub/#top", "http://o{k}.org/file", "https://h.org:99999/", "q.iso?x=1", "deep/er/file", "//h.org./pub/p{k}/x&#38;y.txt"]
    body = "<title>Index of /</title><!-- <a href='no.iso'>no</a> -->" + "".join(f'<a class="l" href="{u}"><b>t</b></a> 5\n' for u in links)
    text = F.replace(F.lit(body), F.lit("{k}"), F.col("p_partkey").cast("string"))
    pages = table(spark, sf, "part").select(F.concat(F.lit("http://h.org/pub/p"), "p_partkey", F.lit("/")).alias("url"), F.lit("text/html").alias("content_type"), text.alias("body"))
    found = parse_pages(pages).withColumn("k", F.regexp_extract("url", "/p([0-9]+)/", 1).cast("long"))
    entries = found.select("k", F.explode("entries").alias("e")).select("k", F.lit("entry").alias("kind"), "e.url", "e.name", "e.is_dir")
    away = [found.select("k", F.lit(kind).alias("kind"), F.explode(c).alias("url"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("boolean").alias("is_dir")) for c, kind in (("other_dirs", "other"), ("external_dirs", "external"))]
    return entries.union(away[0]).union(away[1])


@query("""SELECT DISTINCT page_id, name, is_dir FROM (SELECT page_id, ends_with(href, '/') AS is_dir, regexp_extract(href, '([^/]*)/?$', 1) AS name, href FROM
 (SELECT page_id, replace(unnest(regexp_extract_all(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<a\\s(?:[^>]*?\\s)?href\\s*=\\s*"([^"]*)"[^>]*>.*?</a\\s*>', 1)), '&amp;', '&') AS href FROM pages) WHERE regexp_matches(href, '^/[^/?#%&]+/?$'))""")
def page_links(spark, sf):
    """Links of web pages to children of the site's root."""
    pages = table(spark, sf, "pages").select(F.concat(F.regexp_extract("url", r"\A(https?://[^/?#]+)", 1), F.lit("/"), F.lit("?id="), "page_id").alias("at"), "page_id", "html")
    listings = parse_pages(pages.select(F.concat(F.lit("http://h"), "page_id", F.lit(".org/")).alias("url"), F.lit("text/html").alias("content_type"), F.concat(F.lit("<title>Index of /</title>"), "html").alias("body")))
    rows = entry_rows(listings).where(~F.col("name").rlike("[%&]"))
    return rows.select(F.regexp_extract("dir_url", "//h([0-9]+)[.]", 1).cast("long").alias("page_id"), "name", "is_dir")


# Discovery in an index of pages.


def _discovered(spark: SparkSession, sf: str, lake: Lake) -> None:
    folder = F.regexp_extract("url", r"\A(https?://[^/?#]+/(?:[^?#]*/)?)", 1)
    ftp = F.when(F.col("page_id") % 3 == 0, F.regexp_replace(folder, "://", "://ftp.")).when(F.col("page_id") % 3 == 1, F.concat(folder, F.lit("pub/"))).otherwise(folder)
    url = F.when(F.col("page_id") % 2 == 0, F.concat(ftp, F.lit("?C=N;O=D"))).otherwise(F.col("url"))
    rows = table(spark, sf, "pages").where(folder != "").select("page_id", url.alias("url"), F.regexp_extract(url, r"\A[^?#]*\?([^#]*)", 1).alias("q"))
    at = shared_folder(spark, "index")
    rows.select("url", F.nullif("q", F.lit("")).alias("url_query"), (F.col("page_id") % 4).alias("part")).repartition(4, "part").drop("part").write.parquet(f"{at}/w/subset=warc")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/w/subset=warc")
    names = sorted(s.getPath().getName() for s in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path) if s.getPath().getName().endswith(".parquet"))
    spark.createDataFrame([("\n".join(f"w/subset=warc/{x}" for x in names) + "\nw/subset=robots/x.parquet",)], "value string").coalesce(1).write.text(f"{at}/list")
    from lakeindex.sources import index

    files = index.manifest(spark, f"{at}/list")
    lake.counts = [discover(lake, files, at, max(1, len(names) - 1), now=5), discover(lake, files, at, 10, now=6), discover(lake, files, at, 10, now=7)]


_FOLDERS = r"(SELECT page_id, regexp_extract(url, '^(https?://[^/?#]+/(?:[^?#]*/)?)', 1) AS f FROM pages WHERE page_id % 2 = 0 AND regexp_matches(url, '^https?://[^/?#]+/'))"


@query(rf"""SELECT DISTINCT url FROM (SELECT CASE WHEN page_id % 3 = 0 THEN replace(f, '://', '://ftp.') ELSE f || 'pub/' END AS url FROM {_FOLDERS} WHERE page_id % 3 < 2 UNION ALL SELECT regexp_extract(replace(f, '://', '://ftp.'), '^(https?://[^/]+/)', 1) FROM {_FOLDERS} WHERE page_id % 3 = 0)""")
def discover_candidates(spark, sf):
    """Index files with sort links, scanned in two goes: roots of file servers and folders that look like archives."""
    return lake_of(_discovered, spark, sf).table("candidates").select("url")


@query(rf"SELECT (SELECT count(*) FROM {_FOLDERS} WHERE page_id % 3 = 2) AS rejected, 0 AS left_over, 0 AS scanned_last")
def discover_counts(spark, sf):
    """What discovery refused, and that nothing is left or scanned twice."""
    one, two, three = lake_of(_discovered, spark, sf).counts
    return spark.createDataFrame([(one["rejected"] + two["rejected"], two["left"], three["scanned"])], "rejected long, left_over int, scanned_last int")


# Walks.


def _page(rows: str) -> str:
    return f"concat('<title>Index of /</title><pre>', {rows}, '</pre>')"


def _listings(spark: SparkSession, sf: str) -> DataFrame:
    """A listing page for each supplier: its parts as disk images of p_size MB, or as web pages of p_size KB for odd ones."""
    parts = table(spark, sf, "lineitem").select("l_suppkey", F.col("l_partkey").alias("p_partkey")).distinct().join(table(spark, sf, "part").select("p_partkey", "p_size"), "p_partkey")
    odd = F.col("l_suppkey") % 2 == 1
    name = F.concat(F.lit("part"), "p_partkey", F.when(odd, ".html").otherwise(".iso"))
    row = F.concat(F.lit('<a href="'), name, F.lit('">'), name, F.lit("</a>  28-Sep-2026 10:15  "), "p_size", F.when(odd, "K").otherwise("M"))
    pages = parts.select("l_suppkey", row.alias("row")).groupBy("l_suppkey").agg(F.array_join(F.sort_array(F.collect_list("row")), "\n").alias("rows"))
    return pages.select(F.concat(F.lit("http://s"), "l_suppkey", F.lit(".example.org/")).alias("url"), F.lit(200).alias("status"), F.lit("text/html").alias("content_type"), F.lit(None).cast("string").alias("location"), F.concat(F.lit("<title>Index of /</title><pre>"), "rows", F.lit("</pre>")).alias("body"))


_PARTS = "(SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)"


def _walked(lake: Lake, web: DataFrame, starts: DataFrame, options: Options) -> None:
    """Walks the sites of these URLs, all in one round."""
    lake.apply(starts.select(F.lit(1).cast("long").alias("seq"), F.lit("candidates").alias("kind"), F.lit(1).cast("long").alias("now"), F.lit("link").alias("source"), F.array("url").alias("urls")))
    lake.counters = {}
    crawl(lake, web, options=options, want=1 << 20, now=2, counters=lake.counters)


def _suppliers(spark: SparkSession, sf: str, lake: Lake) -> None:
    web = _listings(spark, sf)
    _walked(lake, web, web, Options())


@query(f"""SELECT 's' || l_suppkey || '.example.org' AS host, CASE WHEN l_suppkey % 2 = 1 THEN 'low_value' ELSE 'done' END AS status, CASE WHEN l_suppkey % 2 = 1 THEN 0 ELSE count(*) END AS files,
CASE WHEN l_suppkey % 2 = 1 THEN 0 ELSE sum(p_size)::BIGINT * 1048576 END AS bytes FROM {_PARTS} JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey""")
def crawl_walk(spark, sf):
    """Every supplier's site is walked, stored and judged."""
    return lake_of(_suppliers, spark, sf).table("hosts").select("host", "status", "files", "bytes")


#: Folders of a run, and the order in which a page lists them.
_BUDGET = 8
_LISTED = "o AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS k, count(*) OVER (PARTITION BY o_custkey) AS n FROM orders), r AS (SELECT * FROM o WHERE k < 8)"


def _budget(spark: SparkSession, sf: str, lake: Lake) -> None:
    o, li = table(spark, sf, "orders").select("o_orderkey", "o_custkey"), table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber")
    roots = o.groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("keys")).select(F.expr("concat('http://c', o_custkey, '.example.org/') AS url"), F.expr(_page("array_join(transform(keys, k -> concat('<a href=\"o', k, '/\">o', k, '/</a>  28-Sep-2026 10:15  -')), '\\n')")).alias("body"))
    row = F.expr("concat('<a href=\"l', l_linenumber, '.iso\">l', l_linenumber, '.iso</a>  2026-09-28 10:15  20M', o_orderkey)")
    folders = o.join(li, F.col("o_orderkey") == F.col("l_orderkey"), "left").groupBy("o_custkey", "o_orderkey").agg(F.array_join(F.sort_array(F.collect_list(row)), "\n").alias("rows")).select(F.expr("concat('http://c', o_custkey, '.example.org/o', o_orderkey, '/') AS url"), F.expr(_page("rows")).alias("body"))
    web = roots.unionByName(folders).select("url", F.lit(200).alias("status"), F.lit("text/html").alias("content_type"), F.lit(None).cast("string").alias("location"), "body")
    _walked(lake, web, roots, Options(max_dirs=_BUDGET, thresholds=Q.Thresholds(0, 0)))


@query(f"""WITH {_LISTED}, f AS (SELECT o_custkey, count(DISTINCT (o_orderkey, l_linenumber)) FILTER (l_linenumber IS NOT NULL) AS files FROM r LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_custkey)
SELECT 'c' || o_custkey || '.example.org' AS host, CASE WHEN max(n) >= 8 THEN 'paused' ELSE 'done' END AS status, CASE WHEN max(n) >= 8 THEN 'directory budget for this run reached; continues next run' END AS reason, least(max(n) + 1, 8) AS dirs, max(files) AS files FROM r JOIN f USING (o_custkey) GROUP BY o_custkey""")
def crawl_budget(spark, sf):
    """Sites of many folders, read breadth-first until a run's budget ends."""
    return lake_of(_budget, spark, sf).table("hosts").select("host", "status", "reason", "dirs", "files")


@query(f"WITH {_LISTED} SELECT 'http://c' || o_custkey || '.example.org/o' || o_orderkey || '/' AS url, 'resume' AS source FROM o WHERE k >= 8")
def crawl_overflow(spark, sf):
    """The folders beyond the budget wait for the next run."""
    return lake_of(_budget, spark, sf).table("candidates").select("url", "source")


@query(f"WITH {_LISTED} SELECT (SELECT count(DISTINCT o_custkey) FROM orders) AS sites, (SELECT count(*) FROM r) + (SELECT count(DISTINCT o_custkey) FROM orders) AS listings, ((SELECT count(DISTINCT (o_orderkey, l_linenumber)) FROM r JOIN lineitem ON l_orderkey = o_orderkey) + (SELECT count(*) FROM orders))::BIGINT AS entries, 0 AS failed")
def crawl_counters(spark, sf):
    """What the run counted."""
    c = lake_of(_budget, spark, sf).counters
    return spark.createDataFrame([(c["sites"], c["listings"], c["entries"], c["failed"])], "sites long, listings long, entries long, failed long")


#: What a customer's site answers, by its number: how the walk ends, and why.
_ENDS = {
    0: ("done", None), 1: ("robots_disallowed", "robots.txt disallows /"), 2: ("unreachable", "robots.txt: 503 from {o}/robots.txt, giving up"), 3: ("robots_disallowed", "robots.txt returned 500"), 4: ("unreachable", "500 from {o}/"), 5: ("not_listing", None),
    6: ("not_listing", None), 7: ("done", None), 8: ("sensitive", "exposed: {o}/id_rsa"), 9: ("low_value", None), 10: ("opted_out", "on the opt-out list"), 11: ("not_listing", None), 12: ("skipped", "on the skip list"), 13: ("done", None), 14: ("paused", "some folders could not be read (500 from {o}/bad/); will try them again"),
    15: ("unreachable", "429 from {o}/, giving up"), 16: ("robots_disallowed", "Crawl-delay of 90s is too slow to crawl"), 17: ("done", None),
}


def _outcomes(spark: SparkSession, sf: str, lake: Lake) -> None:
    c = table(spark, sf, "customer").selectExpr("c_custkey AS c", "cast(c_custkey % 18 AS int) AS k", "concat('http://c', c_custkey, '.g', c_custkey % 18, '.example.org') AS o")
    iso = lambda *names: _page("concat(" + ", ".join(f"'<a href=\"{n}\">{n}</a>  28-Sep-2026 10:15  20M\\n'" for n in names) + ")")
    three, junk = iso("a.iso", "b.iso", "c.iso"), _page("array_join(transform(sequence(1, 150), i -> concat('<a href=\"p', i, '.html\">p</a>  28-Sep-2026 10:15  5K')), '\\n')")

    def pages(k: int, path: str, status: int, body: str | None = None, location: str | None = None, kind: str = "'text/html'") -> DataFrame:
        return c.where(f"k = {k}").select(F.expr(f"concat(o, '{path}') AS url"), F.lit(status).alias("status"), F.expr(kind).alias("content_type"), F.expr(location or "cast(null AS string)").alias("location"), F.expr(body or "cast(null AS string)").alias("body"))

    web = _together(
        pages(0, "/", 200, three), pages(1, "/robots.txt", 200, "'User-agent: *\\nDisallow: /'"), pages(2, "/robots.txt", 503), pages(3, "/robots.txt", 500), pages(4, "/", 500), pages(6, "/", 301, location="'http://ftp.elsewhere.net/pub/'"), pages(7, "/", 302, location="'/pub/'"), pages(7, "/pub/", 200, three),
        pages(8, "/", 200, iso("a.iso", "id_rsa")), pages(9, "/", 200, junk), pages(10, "/", 200, three), pages(11, "/", 200, "'<p>hello'"), pages(12, "/", 200, three), pages(13, "/", 200, iso("a.iso", "b.iso", "c.iso", "loop/", "pool/")), pages(13, "/loop/", 200, iso("a.iso", "b.iso", "c.iso", "loop/", "pool/")), pages(13, "/pool/", 200, three),
        pages(14, "/", 200, iso("a.iso", "b.iso", "c.iso", "bad/")), pages(14, "/bad/", 500), pages(15, "/", 429), pages(16, "/robots.txt", 200, "'User-agent: *\\nCrawl-delay: 90'"), pages(17, "/robots.txt", 301, location="'/other.txt'"), pages(17, "/other.txt", 404), pages(17, "/", 200, three),
    )
    _walked(lake, web, c.select(F.concat("o", F.lit("/")).alias("url")), Options(optout=("g10.example.org",), skip_hosts=("g12.example.org",)))


def _ends_sql() -> str:
    why = " ".join(f"WHEN {k} THEN '" + r.replace("{o}", "' || o || '") + "'" for k, (_, r) in _ENDS.items() if r)
    status = " ".join(f"WHEN {k} THEN '{s}'" for k, (s, _) in _ENDS.items())
    files = "CASE WHEN k IN (0, 7, 14, 17) THEN 3 WHEN k = 13 THEN 6 ELSE 0 END"
    junk = "'nothing worth keeping: 0 big files (need 3) and 0 useful files (need 20) among 150 files'"
    return f"SELECT host, CASE k {status} END AS status, CASE WHEN k = 9 THEN {junk} ELSE CASE k {why} END END AS reason, {files}::BIGINT AS files, CASE WHEN k IN (14) THEN 1 ELSE 0 END AS fails"


@query(f"{_ends_sql()} FROM (SELECT c_custkey % 18 AS k, 'c' || c_custkey || '.g' || c_custkey % 18 || '.example.org' AS host, 'http://c' || c_custkey || '.g' || c_custkey % 18 || '.example.org' AS o FROM customer)")
def crawl_outcomes(spark, sf):
    """How walks end: robots rules and their absence, refusals, redirects, errors, exposure, junk, lists of sites, loops."""
    return lake_of(_outcomes, spark, sf).table("hosts").where("host <> 'ftp.elsewhere.net'").select("host", "status", "reason", "files", "fails")


@query("SELECT 'ftp.elsewhere.net' AS host, 'not_listing' AS status FROM customer WHERE c_custkey % 18 = 6 LIMIT 1")
def crawl_link_found(spark, sf):
    """A redirect to another site's archive is a candidate, and walked in a later round."""
    return lake_of(_outcomes, spark, sf).table("hosts").where("host = 'ftp.elsewhere.net'").select("host", "status")


@query("""SELECT url, NOT (starts_with(p, '/de') AND NOT starts_with(p, '/de/1')) AS allowed FROM (SELECT url, '/' || regexp_extract(url, '^https?://[^/?#]+/?([^?#]*)', 1) AS p FROM pages)""")
def robots_gate(spark, sf):
    """Which pages a robots.txt lets through, by the walk's own matcher."""
    rules = Robots("User-agent: *\nDisallow: /de\nAllow: /de/1", "lakeindex")

    def gate(batches):
        for pdf in batches:
            yield pd.DataFrame({"url": pdf["url"], "allowed": pdf["path"].map(rules.allows)})

    path = F.concat(F.lit("/"), F.regexp_extract("url", r"\Ahttps?://[^/?#]+/?([^?#]*)", 1))
    return table(spark, sf, "pages").select("url", path.alias("path")).mapInPandas(gate, "url string, allowed boolean")


# Search over a lake.


def _searched(spark: SparkSession, sf: str, lake: Lake) -> None:
    entries = entry_rows(parse_pages(_listings(spark, sf))).select(F.regexp_extract("dir_url", "//([^/]+)/", 1).alias("host"), "dir_url", "name", F.lit(None).cast("string").alias("href"), "is_dir", "size", "mtime")
    gone = table(spark, sf, "supplier").where("s_suppkey % 10 = 4").select(F.expr("concat('s', s_suppkey, '.example.org') AS host"), F.lit("opted_out").alias("status"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("server", "string"), ("dirs", "long"), ("files", "long"), ("bytes", "long"), ("crawled_at", "long"), ("reason", "string"), ("trusted", "boolean"), ("fails", "int"))]
    held = lake._hold(entries)  # a commit reads its rows twice
    lake.commit(entries=held, hosts=gone.select("*", *none))
    lake.release(held)


_HITS = "SELECT count(*) AS hits, min(name) AS first_name FROM (SELECT 'part' || l_partkey || '.iso' AS name FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem) JOIN part ON l_partkey = p_partkey WHERE l_suppkey % 2 = 0 AND l_suppkey % 10 <> 4 AND p_size >= 40 AND starts_with('part' || l_partkey, 'part1'))"


def _hits(lake: Lake) -> DataFrame:
    return lake.search("part1", None, extensions="iso", min_bytes=40 << 20).agg(F.count("*").alias("hits"), F.min("name").alias("first_name"))


@query(_HITS)
def search_lake(spark, sf):
    """A filtered search over a lake's file names, without an index; hits of dropped sites do not show."""
    return _hits(lake_of(_searched, spark, sf))


def _indexed(spark: SparkSession, sf: str, lake: Lake) -> None:
    first = lake_of(_searched, spark, sf)
    lake.commit(entries=first.table("entries"), hosts=first.table("hosts"))
    lake.index()


@query(_HITS)
def search_indexed(spark, sf):
    """The same with the stored index."""
    return _hits(lake_of(_indexed, spark, sf))


# Commands.


def _printed(spark: SparkSession, lake: Lake, *argv: str) -> DataFrame:
    """The lines that a command prints."""
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        run(spark, ["--lake", lake.path, *argv])
    return spark.createDataFrame([(x,) for x in out.getvalue().splitlines()], "line string")


_HUMAN = "CASE WHEN bytes < 1024 THEN bytes || ' B' WHEN bytes < 1048576 THEN printf('%.1f KiB', bytes / 1024.0) WHEN bytes < 1073741824 THEN printf('%.1f MiB', bytes / 1048576.0) WHEN bytes < 1099511627776 THEN printf('%.1f GiB', bytes / 1073741824.0) ELSE printf('%.1f TiB', bytes / 1099511627776.0) END"
_SITES = f"""s AS (SELECT l_suppkey AS s, count(*) AS n, CASE WHEN l_suppkey % 2 = 1 THEN 0 ELSE count(*) END AS files, CASE WHEN l_suppkey % 2 = 1 THEN 0 ELSE sum(p_size)::BIGINT * 1048576 END AS bytes, CASE WHEN l_suppkey % 2 = 1 THEN 'low_value' ELSE 'done' END AS status,
 CASE WHEN l_suppkey % 2 = 1 THEN 'nothing worth keeping: 0 big files (need 3) and 0 useful files (need 20) among ' || count(*) || ' files' END AS reason FROM {_PARTS} JOIN part ON l_partkey = p_partkey GROUP BY l_suppkey)"""


@query(f"WITH {_SITES}, t AS (SELECT status, count(*) AS hosts, sum(files)::BIGINT AS files, sum(bytes)::BIGINT AS bytes FROM s GROUP BY status) SELECT concat_ws(chr(9), status, hosts, files, {_HUMAN}) AS line FROM t")
def command_stats(spark, sf):
    return _printed(spark, lake_of(_suppliers, spark, sf), "stats")


@query(f"WITH {_SITES} SELECT concat_ws(chr(9), 's' || s || '.example.org', status, files, {_HUMAN}, '1970-01-01 00:00 UTC', coalesce(CASE WHEN length(reason) > 80 THEN reason[1:79] || '…' ELSE reason END, '-')) AS line FROM s ORDER BY 's' || s || '.example.org' LIMIT 25")
def command_sites(spark, sf):
    return _printed(spark, lake_of(_suppliers, spark, sf), "sites", "--sort", "name", "--limit", "25")


def _auto(spark: SparkSession, sf: str, lake: Lake) -> None:
    at, sites = shared_folder(spark, "auto"), table(spark, sf, "supplier").select("s_suppkey")
    sites.selectExpr("concat('http://ftp.s', s_suppkey, '.example.org/?C=N;O=D') AS url", "'C=N;O=D' AS url_query").coalesce(1).write.parquet(f"{at}/w/subset=warc")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/w/subset=warc")
    names = [s.getPath().getName() for s in path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path) if s.getPath().getName().endswith(".parquet")]
    spark.createDataFrame([('[{"id": "FIRST-9"}, {"id": "CC-MAIN-2"}, {"id": "CC-MAIN-1"}]',)], "value string").coalesce(1).write.text(f"{at}/crawls")
    spark.createDataFrame([("\n".join(f"w/subset=warc/{x}" for x in names),)], "value string").coalesce(1).write.text(f"{at}/CC-MAIN-2")
    row = "concat('<a href=\"f', i, '.iso\">f', i, '.iso</a>  28-Sep-2026 10:15  20M')"
    body = _page(f"array_join(transform(sequence(1, cast(s_suppkey % 5 + 3 AS int)), i -> {row}), '\\n')")
    sites.selectExpr("concat('http://ftp.s', s_suppkey, '.example.org/') AS url", "200 AS status", "'text/html' AS content_type", "cast(null AS string) AS location", f"{body} AS body").write.parquet(f"{at}/web")
    _printed(spark, lake, "auto", "--manifest", f"{at}/{{crawl}}", "--collections", f"{at}/crawls", "--base", at, "--web", f"{at}/web", "--hours", "1", "--concurrency", "1000000")


@query("SELECT 'ftp.s' || s_suppkey || '.example.org' AS host, 'done' AS status, s_suppkey % 5 + 3 AS files, (s_suppkey % 5 + 3) * 20971520 AS bytes FROM supplier")
def command_auto(spark, sf):
    """Discovery in the latest crawl's index, then walks of what it found."""
    return lake_of(_auto, spark, sf).table("hosts").select("host", "status", "files", "bytes")


@query("SELECT path FROM (SELECT 1) AS t(x), (SELECT 'w/subset=warc' AS path)")
def command_discover(spark, sf):
    """The ledger after the command: the file that was read."""
    return lake_of(_auto, spark, sf).table("cc_files").select(F.regexp_extract("path", "^(.*)/", 1).alias("path"))
