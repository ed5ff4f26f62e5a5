"""The lake: versioned Parquet tables, one manifest that names the version of each part, and the writes of the message log.

Tables of sites are cut into buckets by the hash of the host. A commit writes new folders for the buckets that it changes and then
a manifest of the next number, which must not exist yet; readers take the highest. So all tables change at once, buckets of other
sites are not written, readers never see half a commit, and of two writers one fails and can retry. Everything goes through
Hadoop's file systems, so the lake may lie wherever Spark can write.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from itertools import groupby
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from lakeindex.functions import rules as R
from lakeindex.functions.urls import normal_domain, normal_prefix, parse
from lakeindex.operators import quality as Q
from lakeindex.operators import reports, search, writes
from lakeindex.operators.host_state import Candidate, Folder, HostState
from lakeindex.ship import ship

SCHEMAS = {
    "hosts": "host string, status string, server string, dirs long, files long, bytes long, crawled_at long, reason string, trusted boolean, fails int",
    "dirs": "host string, url string, seen_at long, leaf boolean",
    "entries": "host string, dir_url string, name string, href string, is_dir boolean, size long, mtime string",
    "candidates": "url string, host string, source string, found_at long, seq long",
    "cc_files": "path string, candidates long, done_at long",
    "dead_letters": "seq long, kind string, host string, why string",
    "postings": "token string, doc string, tf_name long, tf_path long, length long, host string, name string, is_dir boolean, size long, mtime string",
}
BUCKETED = {"entries": ["dir_url", "name"], "dirs": ["url"], "candidates": ["host", "url"], "hosts": ["host"]}  # and how their rows are sorted
BUCKETS = 32  # of a new lake; one of many TB takes more
FORMAT = 2
DETAILS = ["host", "name", "is_dir", "size", "mtime"]
ENTRY = "struct<url:string,name:string,is_dir:boolean,size:bigint,mtime:string>"
MESSAGES = (
    f"seq bigint, kind string, host string, now bigint, entries array<{ENTRY}>, leaf boolean, status string, server string, dirs bigint, reason string, purge boolean, trusted boolean, judge struct<min_big:bigint,min_useful:bigint>, failed boolean, "
    "urls array<string>, source string, finished array<string>, frontier array<string>, path string"
)
KINDS = ("entries", "host_done", "candidates", "paused", "cc_file_done", "flush")
STATUSES = ("done", "paused", "skipped", "low_value", "partial", "robots_disallowed", "not_listing", "sensitive", "opted_out", "unreachable")
HIDDEN = ("opted_out", "sensitive", "skipped", "low_value")
KEEP_VERSIONS = 2


class Conflict(RuntimeError):
    """Another writer committed first."""


class Lake:
    def __init__(self, spark: SparkSession, path: str, create: bool = True, buckets: int = BUCKETS):
        self.spark, self.path = spark, path.rstrip("/")
        self._read: dict[int, dict] = {}
        ship(spark)
        jvm = spark._jvm
        self._root = jvm.org.apache.hadoop.fs.Path(self.path)
        self._fs = self._root.getFileSystem(spark._jsc.hadoopConfiguration())
        if not self._numbers():
            if not create:
                raise FileNotFoundError(f"there is no lake at {path}")
            self._commit_manifest(1, {"format": FORMAT, "buckets": buckets, "tables": {}, "notes": {}})
        m = self._manifest(self.version())
        self.buckets = m["buckets"]
        if m["format"] < FORMAT:
            self._migrate()

    # Versions.

    def _hadoop(self, *parts: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.path, *parts]))

    def _numbers(self) -> list[int]:
        folder = self._hadoop("manifests")
        if not self._fs.exists(folder):
            return []
        return sorted(int(s.getPath().getName().split(".")[0]) for s in self._fs.listStatus(folder) if s.getPath().getName().endswith(".json") and s.getPath().getName()[0] != ".")

    def version(self) -> int:
        return self._numbers()[-1]

    def _manifest(self, number: int) -> dict:
        if number not in self._read:  # a manifest never changes
            self._read = {n: m for n, m in self._read.items() if n > number - 2 * KEEP_VERSIONS} | {number: self._parsed(number)}
        return self._read[number]

    def _parsed(self, number: int) -> dict:
        rows = self.spark.read.text(f"{self.path}/manifests/{number:012d}.json", wholetext=True).collect()
        m = json.loads(rows[0].value)
        # The first format named one version of each table.
        return m if "format" in m else {"format": 1, "buckets": BUCKETS, "tables": {t: {"": v} for t, v in m.items() if t in SCHEMAS and t != "postings"}, "notes": {}}

    def _commit_manifest(self, number: int, manifest: dict) -> None:
        at = self._hadoop("manifests", f"{number:012d}.json")
        try:
            out = self._fs.create(at, False)
        except Exception as e:
            raise Conflict(f"version {number} is there already") from e
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()

    def _migrate(self) -> None:
        """Brings a lake of the first format to this one: buckets, and leaves found out where none are noted."""
        tables = {t: self.table(t) for t in self._manifest(self.version())["tables"]}
        if "dirs" in tables:
            tables["dirs"] = backfilled(tables["dirs"], self.table("entries"))
        self.commit(**tables)

    def bucket(self, host: Column) -> Column:
        return F.pmod(F.xxhash64(host), F.lit(self.buckets)).cast("int")

    def buckets_of(self, hosts: list[str]) -> list[int]:
        rows = self.spark.createDataFrame([(h,) for h in hosts], "host string").select(self.bucket(F.col("host")).alias("b"))
        return sorted({r.b for r in rows.collect()})

    def table(self, name: str, version: int | None = None, buckets: list[int] | None = None) -> DataFrame:
        """A table's rows, of some buckets or all."""
        made = self._manifest(version or self.version())["tables"].get(name, {})
        paths = [f"{self.path}/tables/{name}/{v}" + (f"/b={k}" if k else "") for k, v in made.items() if buckets is None or not k or int(k) in buckets]
        return self.spark.read.schema(SCHEMAS[name]).parquet(*paths) if paths else self.spark.createDataFrame([], SCHEMAS[name])

    def commit(self, notes: dict | None = None, buckets: list[int] | None = None, **tables: DataFrame) -> int:
        """Writes new versions of these tables and makes them all visible at once. Frames may read the current ones.

        buckets: those that are written, all by default; frames of tables of sites hold only rows of these. notes are kept in
        the manifest beside the tables' versions.
        """
        number, made = self.version(), uuid4().hex[:12]
        m = self._manifest(number)
        parts = {t: dict(v) for t, v in m["tables"].items()}

        def write(name: str) -> dict[str, str]:
            rows = tables[name].select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in SCHEMAS[name].split(", ")])
            at = f"{self.path}/tables/{name}/{made}"
            if name not in BUCKETED:
                if name == "postings":
                    rows = rows.repartitionByRange("token", "doc").sortWithinPartitions("token", "doc")
                rows.write.parquet(at)
                return {"": made}
            # Sorted in each bucket: filters on a host, folder or subtree read few row groups.
            keys = ["b", *BUCKETED[name]]
            rows.withColumn("b", self.bucket(F.col("host"))).repartitionByRange(*keys).sortWithinPartitions(*keys).write.partitionBy("b").parquet(at)
            kept = {} if buckets is None else {k: v for k, v in parts.get(name, {}).items() if k and int(k) not in buckets}
            there = (s.getPath().getName() for s in self._fs.listStatus(self._hadoop("tables", name, made)))
            return kept | {x.partition("=")[2]: made for x in there if x.startswith("b=")}

        with ThreadPoolExecutor(max(1, len(tables))) as pool:  # tables are written side by side
            parts |= dict(zip(tables, pool.map(write, tables)))
        self._commit_manifest(number + 1, {"format": FORMAT, "buckets": self.buckets, "tables": parts, "notes": m["notes"] | (notes or {})})
        return number + 1

    def vacuum(self, keep: int = KEEP_VERSIONS, least_share: float = 0.25) -> int:
        """Deletes what only old manifests name, once that is a quarter of all bytes, and what writes left behind; returns the bytes freed.

        Not to be run beside a write.
        """
        self._fs.delete(self._hadoop("work"), True)
        numbers = self._numbers()
        live = {(t, v, k) for n in numbers[-keep:] for t, made in self._manifest(n)["tables"].items() for k, v in made.items()}
        dead, total = [], 0
        for name in SCHEMAS:
            folder = self._hadoop("tables", name)
            for s in self._fs.listStatus(folder) if self._fs.exists(folder) else []:
                v = s.getPath().getName()
                parts = [x for x in self._fs.listStatus(s.getPath()) if x.getPath().getName().startswith("b=")]
                named = [(x, x.getPath().getName()[2:]) for x in parts] if parts and (name, v, "") not in live else [(s, "")]
                sizes = {k: self._fs.getContentSummary(x.getPath()).getLength() for x, k in named}
                total += sum(sizes.values())
                gone = [(x, sizes[k]) for x, k in named if (name, v, k) not in live]
                dead += [(s, sum(sizes.values()))] if len(gone) == len(named) else gone
        freed = sum(size for _, size in dead)
        if not dead or freed < least_share * total:
            return 0
        for s, _ in dead:
            self._fs.delete(s.getPath(), True)
        for n in numbers[:-keep]:
            self._fs.delete(self._hadoop("manifests", f"{n:012d}.json"), False)
        return freed

    # Views.

    def files(self) -> DataFrame:
        e = self.table("entries")
        return e.select("host", R.entry_url(F.col("dir_url"), F.col("href"), F.col("name"), F.col("is_dir")).alias("url"), "name", "is_dir", "size", "mtime")

    def sql(self, text: str) -> DataFrame:
        """SQL over the tables and the files view, with the scalar functions of the rules."""
        for name in SCHEMAS:
            self.table(name).createOrReplaceTempView(name)
        self.files().createOrReplaceTempView("files")
        R.create_sql_functions(self.spark)
        return self.spark.sql(text)

    # The message log.

    def apply(self, messages: DataFrame) -> int:
        """Applies messages in the order of seq, all in one commit; ones that make no sense go to dead_letters.

        Messages of one site apply in order, sites side by side: each site's stored rows and messages meet in one task, its
        folders as counts. Only buckets with sites that messages name are read and written. A message that fails is left out
        as if it had not come, and goes to dead_letters.
        """
        m = messages.select(*[F.col(c) if c in messages.columns else F.lit(None).alias(c) for c in _names(MESSAGES)])
        m = self.spark.createDataFrame([], MESSAGES).unionByName(m)
        bad = F.when(~F.col("kind").isin(*KINDS) | F.col("kind").isNull(), "unknown kind").when(F.col("kind").isin("entries", "host_done", "paused") & F.col("host").isNull(), "no host").when((F.col("kind") == "host_done") & ~F.coalesce(F.col("status").isin(*STATUSES), F.lit(False)), "unknown status").when((F.col("kind") == "cc_file_done") & F.col("path").isNull(), "no path")
        m = self._hold(m.withColumn("why", bad))  # read several times below, and made by walks
        good = m.where("why is null")
        host = R.canonical_host(F.col("host"))
        rows = good.where("kind = 'entries'").select(host.alias("host"), "seq", "now", "leaf", F.explode("entries").alias("e")).select("host", "seq", "now", "leaf", "e.*")
        rows = rows.withColumn("url", R.canonical_url(F.col("url"))).withColumn("dir_url", R.folder_of(F.col("url"))).withColumn("raw", R.leaf_of(F.col("url")))
        arriving = rows.select("host", "seq", "now", "leaf", "dir_url", "name", F.when(F.col("raw") != F.col("name"), F.col("raw")).alias("href"), F.coalesce("is_dir", F.lit(False)).alias("is_dir"), "size", "mtime")
        listed = arriving.groupBy("host", "seq", "now", "leaf", "dir_url").agg(*_counts())
        own = good.where("kind in ('host_done', 'paused')").withColumn("host", host)
        spread = good.where("kind in ('candidates', 'cc_file_done')").select("seq", "now", F.coalesce("source", F.lit("link")).alias("source"), F.posexplode("urls").alias("pos", "url")).withColumn("url", R.canonical_url(F.col("url"))).withColumn("host", R.url_host(F.col("url"))).where("host is not null")
        log = self._hold(_log(listed.select("host", "seq", "now", F.lit("entries").alias("kind"), "leaf", "dir_url", "files", "bytes", "big", "useful"), own, spread))

        touched = log.select("host").distinct()
        row = log.agg(F.sort_array(F.collect_set(self.bucket(F.col("host")))).alias("only")).first()
        some = m.agg(F.count_if(F.col("why").isNotNull()).alias("bad"), F.count_if(F.col("why").isNull() & (F.col("kind") == "cc_file_done")).alias("files")).first()
        only = row.only  # at most as many as buckets
        hosts, dirs, entries, candidates = (self.table(t, buckets=only) for t in ("hosts", "dirs", "entries", "candidates"))
        mine = {t: df.join(touched, "host", "left_semi") for t, df in (("hosts", hosts), ("dirs", dirs), ("entries", entries), ("candidates", candidates))}
        state = _state(mine)
        folded = self._hold(by_site(state.unionByName(log, allowMissingColumns=True), ["what", "seq", "kind", "pos"], _fold, FOLDED))
        failed = folded.where("kind = 'letter'").select("seq", F.col("status").alias("kind"), "host", F.col("reason").alias("why"))

        kept = folded.where("kind = 'dir'").select("host", F.col("url").alias("dir_url"), "src")
        old_entries = entries.join(touched, "host", "left_anti").unionByName(mine["entries"].join(kept.where("src is null").drop("src"), ["host", "dir_url"], "left_semi"))
        new_entries = arriving.join(kept.where("src is not null").withColumnRenamed("src", "seq"), ["host", "dir_url", "seq"], "left_semi").select(*entries.columns)
        out = {} if not only else {
            "hosts": hosts.join(touched, "host", "left_anti").unionByName(folded.where("kind = 'host'").select(*hosts.columns)),
            "dirs": dirs.join(touched, "host", "left_anti").unionByName(folded.where("kind = 'dir'").select("host", "url", "seen_at", "leaf")),
            "entries": old_entries.unionByName(new_entries),
            "candidates": candidates.join(touched, "host", "left_anti").unionByName(folded.where("kind = 'candidate'").select(*candidates.columns)),
        }
        done = good.where("kind = 'cc_file_done'").select("path", F.coalesce(F.size("urls"), F.lit(0)).cast("long").alias("candidates"), F.col("now").alias("done_at"), "seq")
        if some.files:
            last = done.withColumn("k", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("seq")))).where("k = 1").drop("k", "seq")
            out["cc_files"] = self.table("cc_files").join(last.select("path"), "path", "left_anti").unionByName(last)
        if some.bad or not failed.isEmpty():
            out["dead_letters"] = self.table("dead_letters").unionByName(m.where("why is not null").select("seq", "kind", "host", "why")).unionByName(failed)
        try:
            return self.commit(buckets=only, **out)
        finally:
            self.release(folded, log, m)

    def send(self, *messages: dict, now: int | None = None) -> int:
        """Applies messages given as dicts, numbered in order."""
        now = int(time.time()) if now is None else now
        rows = [{"seq": i + 1, "now": now} | x for i, x in enumerate(messages)]
        names = _names(MESSAGES)
        return self.apply(self.spark.createDataFrame([tuple(_plain(r.get(c)) for c in names) for r in rows], MESSAGES))

    # Addresses.

    def add_candidates(self, urls: list[str], source: str = "link", now: int | None = None) -> int:
        return self.send({"kind": "candidates", "urls": urls, "source": source}, now=now)

    def add_seeds(self, urls: list[str], now: int | None = None) -> int:
        return self.send({"kind": "candidates", "urls": urls, "source": "seed"}, now=now)

    def pending(self, want: int, exclude: DataFrame | None = None) -> DataFrame:
        """The next sites to read, with their URLs, seeds, trust and whether they are known."""
        candidates, hosts = self.table("candidates"), self.table("hosts")
        first = reports.pending(candidates, hosts, want, exclude)
        mine = candidates.join(F.broadcast(first.select("host")), "host", "left_semi")  # at most `want` names
        urls = reports.waiting_urls(mine)
        marks = mine.groupBy("host").agg(F.sort_array(F.collect_set(F.when(F.col("source") == "seed", F.col("url")))).alias("seeds"), F.max(F.col("source").isin("seed", "moved")).alias("marked"))
        known = hosts.select("host", F.col("trusted").alias("t"), "dirs")
        return first.join(urls, "host").join(marks, "host").join(known, "host", "left").select("host", "urls", "seeds", (F.col("marked") | F.coalesce("t", F.lit(False))).alias("trusted"), F.col("dirs").isNotNull().alias("known"), "priority", "found_at").orderBy("priority", "found_at", "host")

    def named_sites(self, urls: list[str]) -> DataFrame:
        """Of typed addresses, a row a site: typed URLs in their order, then waiting ones, each once."""
        typed = [(str(u), u.host.rstrip("."), i) for i, x in enumerate(urls) if (u := parse(x))]
        t = self.spark.createDataFrame(typed, "url string, host string, i long")
        c = self.table("candidates").join(t.select("host").distinct(), "host", "left_semi").select("url", "host", (F.col("seq") + (1 << 40)).alias("i"), "source")
        both = t.withColumn("source", F.lit("seed")).unionByName(c)
        once = both.withColumn("k", F.row_number().over(Window.partitionBy("url").orderBy("i"))).where("k = 1")
        key = lambda c: F.transform(F.sort_array(F.collect_list(F.when(c, F.struct("i", "url")))), lambda x: x["url"])
        return once.groupBy("host").agg(key(F.lit(True)).alias("urls"), key(F.col("source") == "seed").alias("seeds"), F.min("i").alias("i")).orderBy("i").drop("i")

    def named_jobs(self, urls: list[str]) -> DataFrame:
        """The named sites as work for a walk; sites that users name are trusted."""
        known = self.table("hosts").select("host", F.lit(True).alias("known"))
        return self.named_sites(urls).join(known, "host", "left").select("host", "urls", "seeds", F.lit(True).alias("trusted"), F.coalesce("known", F.lit(False)).alias("known"))

    # Maintenance.

    def forget(self, hosts: list[str]) -> bool:
        """Takes all traces of the sites away; whether there were any."""
        names = [normal_domain(h) for h in hosts]
        only = self.buckets_of(names)
        tables = {t: self.table(t, buckets=only) for t in ("hosts", "dirs", "entries", "candidates")}
        known = any(tables[t].where(F.col("host").isin(*names)).limit(1).count() for t in ("hosts", "dirs", "candidates"))
        self.commit(buckets=only, **{t: df.where(~F.col("host").isin(*names)) for t, df in tables.items()})
        return known

    def delete_subtree(self, folder: str) -> int:
        """Takes everything under a folder's URL away, and the folder itself."""
        base = folder.rstrip("/") + "/"
        only = self.buckets_of([u.host.rstrip(".")] if (u := parse(base)) else [])
        gone = {"dirs": "url", "entries": "dir_url", "candidates": "url"}
        return self.commit(buckets=only, **{t: self.table(t, buckets=only).where(~writes.in_subtree(F.col(c), base)) for t, c in gone.items()})

    def clean(self, optout: list[str] = (), skip_hosts: list[str] = (), skip_folders: list[str] = (), thresholds: Q.Thresholds = Q.Thresholds(), now: int | None = None) -> DataFrame:
        """Opt-outs, skipped hosts, skipped folders, exposure, quality, in this order, each on what is left; the report's rows.

        A second run finds nothing.
        """
        now = int(time.time()) if now is None else now
        t = {n: self.table(n) for n in ("hosts", "dirs", "entries", "candidates")}
        reports_: list[DataFrame] = []
        for status, domains in (("opted_out", optout), ("skipped", skip_hosts)):
            known = t["hosts"].where(F.col("status") != status).select("host").union(t["dirs"].select("host")).union(t["candidates"].select("host")).distinct()
            listed = self.spark.createDataFrame([(normal_domain(d),) for d in domains], "domain string")
            hit = self._hold(R.hosts_in(known, listed).withColumn("reason", F.lit(f"on the {'opt-out' if status == 'opted_out' else 'skip'} list")))
            reports_.append(hit.select(F.lit(status).alias("action"), "host", "reason", F.lit(0).cast("long").alias("n")))
            t = self._tombstones(t, hit, status, now)
        if skip_folders:
            from lakeindex.functions.urls import decoded_path

            inside = R.skip_folder(decoded_path(R.url_path(F.col("url"))), skip_folders)
            gone = self._hold(t["dirs"].where(inside).select("url"))
            t["dirs"] = t["dirs"].join(gone, "url", "left_anti")
            t["entries"] = t["entries"].join(gone.withColumnRenamed("url", "dir_url"), "dir_url", "left_anti")
            reports_.append(gone.agg(F.count("*").alias("n")).select(F.lit("skipped_dirs").alias("action"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("reason"), "n"))
        t = self._exposure(t, reports_, now)
        low = self._hold(Q.judged(t["hosts"], t["dirs"], t["entries"], t["candidates"], thresholds).withColumnRenamed("drop_reason", "reason")) if thresholds.enabled else None
        if low is not None:
            reports_.append(low.select(F.lit("low_value").alias("action"), "host", "reason", F.lit(0).cast("long").alias("n")))
            t = self._tombstones(t, low, "low_value", now)
        report = self._hold(_union(reports_).where("host is not null or n > 0").orderBy("action", "host"))
        self.commit(**t)
        return report

    def _hold(self, df: DataFrame) -> DataFrame:
        """The same rows, written under the lake and read again: a lost executor does not make them anew."""
        at = f"{self.path}/work/{uuid4().hex}"
        df.write.parquet(at)
        held = self.spark.read.schema(df.schema).parquet(at)
        held._held_at = at
        return held

    def release(self, *held: DataFrame) -> None:
        """Deletes what was held; what nobody releases goes with the next vacuum."""
        for df in held:
            self._fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(df._held_at), True)

    def _tombstones(self, t: dict[str, DataFrame], hit: DataFrame, status: str, now: int) -> dict[str, DataFrame]:
        old = t["hosts"].join(hit.select("host"), "host", "left_semi").select("host", F.col("server").alias("s"), F.col("trusted").alias("tr"), F.when(F.col("status") == "paused", F.col("dirs")).otherwise(0).alias("d"))
        rows = hit.join(old, "host", "left").select("host", F.lit(status).alias("status"), F.col("s").alias("server"), F.coalesce("d", F.lit(0)).cast("long").alias("dirs"), F.lit(0).cast("long").alias("files"), F.lit(0).cast("long").alias("bytes"), F.lit(now).cast("long").alias("crawled_at"), "reason", F.coalesce("tr", F.lit(False)).alias("trusted"), F.lit(0).alias("fails"))
        return {n: writes.purge(df, hit).unionByName(rows) if n == "hosts" else writes.purge(df, hit) for n, df in t.items()}

    def _exposure(self, t: dict[str, DataFrame], reports_: list[DataFrame], now: int) -> dict[str, DataFrame]:
        """Strong names drop a site, weak ones an untrusted site; on a trusted one the entry goes, a folder with its subtree."""
        marked = t["candidates"].where(F.col("source").isin("seed", "moved")).select("host").distinct().withColumn("m", F.lit(True))
        trust = t["hosts"].select("host", "trusted").join(marked, "host", "full").select("host", (F.coalesce("trusted", F.lit(False)) | F.coalesce("m", F.lit(False))).alias("trusted"))
        level = R.sensitivity(F.col("name"))
        named = t["entries"].withColumn("level", level).where("level > 0").join(trust, "host", "left").withColumn("trusted", F.coalesce("trusted", F.lit(False)))
        fatal = (F.col("level") == 2) | ~F.col("trusted")
        by_name = named.where(fatal).groupBy("host").agg(F.min(F.struct("dir_url", "name")).alias("x")).select("host", F.concat(F.lit("exposed: "), "x.dir_url", "x.name").alias("reason"), F.lit(0).alias("k"))
        by_path = t["dirs"].where(R.sensitive_path(R.url_path(F.col("url")))).groupBy("host").agg(F.min("url").alias("u")).select("host", F.concat(F.lit("exposed path: "), "u").alias("reason"), F.lit(1).alias("k"))
        hit = self._hold(by_name.union(by_path).groupBy("host").agg(F.min_by("reason", "k").alias("reason")))
        omit = self._hold(named.where(~fatal).join(hit, "host", "left_anti").select("host", "dir_url", "name", "is_dir", R.folder_url(F.col("dir_url"), F.col("href"), F.col("name"), F.col("is_dir")).alias("folder")))
        reports_.append(hit.select(F.lit("sensitive").alias("action"), "host", "reason", F.lit(0).cast("long").alias("n")))
        reports_.append(omit.agg(F.count("*").alias("n")).select(F.lit("omitted").alias("action"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("reason"), "n"))
        t = self._tombstones(t, hit, "sensitive", now)
        t["entries"] = t["entries"].join(omit.select("dir_url", "name", "is_dir"), ["dir_url", "name", "is_dir"], "left_anti")
        folders = omit.where("is_dir").select("host", "folder").distinct()
        for name, column in (("dirs", "url"), ("entries", "dir_url"), ("candidates", "url")):
            # An equi join on the host keeps the prefix test within a site.
            under = (F.col("a.host") == F.col("b.host")) & F.col(f"a.{column}").startswith(F.col("b.folder"))
            t[name] = t[name].alias("a").join(folders.alias("b"), under, "left_anti")
        return t

    # Reading.

    def _searchable(self) -> DataFrame:
        from lakeindex.functions.urls import decoded_path

        f = self.table("entries").withColumn("url", R.entry_url(F.col("dir_url"), F.col("href"), F.col("name"), F.col("is_dir")))
        return f.withColumn("path", decoded_path(R.url_path(F.col("dir_url"))))

    def index(self) -> int:
        """Stores the search index of the current entries, sorted by token: a search then reads only the tokens it asks for."""
        f = self._searchable()
        postings = search.build_index(f, "url", "name", "path", DETAILS)
        number = self.commit(postings=postings)
        n, mean = search.statistics(self.table("entries", number), self.table("postings", number))
        return self.commit({"indexed": self._manifest(number)["tables"].get("entries", {}), "documents": n, "mean_length": mean})

    def hidden(self, url: Column, host: Column, name: Column, unfiltered: bool = False, takedown: list[str] = (), optout: list[str] = ()) -> Column:
        """Whether a hit is left out: under a takedown prefix, of an opted-out domain, or likely infringing."""
        found = R.taken_down(url, [normal_prefix(p) for p in takedown]) | R.domain_match(host, [normal_domain(d) for d in optout])
        return found if unfiltered else found | R.likely_infringing(name)

    def search(self, query: str, limit: int | None = 20, extensions: str | None = None, min_bytes: int | None = None, unfiltered: bool = False, takedown: list[str] = (), optout: list[str] = ()) -> DataFrame:
        """The best hits (url, name, is_dir, size, mtime, rank) among names and folder paths; all of them without a limit.

        Uses the stored index if it is of the current entries, else passes over them.
        """
        m = self._manifest(self.version())
        if "entries" in m["tables"] and m["notes"].get("indexed") == m["tables"]["entries"]:
            ranks = search.ranked(self.table("postings"), m["notes"]["documents"], m["notes"]["mean_length"], query, DETAILS)
        else:
            ranks = search.scan_ranked(self._searchable(), "url", "name", "path", query, DETAILS)
        hidden = self.hidden(F.col("doc"), F.col("host"), F.col("name"), unfiltered, takedown, optout)
        keep = ~hidden & R.ext_in(F.col("name"), F.col("is_dir"), R.parse_extensions(extensions)) & R.min_size(F.col("size"), min_bytes)
        dropped = self.table("hosts").where(F.col("status").isin(*HIDDEN)).select("host")
        return search.top(ranks.join(dropped, "host", "left_anti"), limit, keep).select(F.col("doc").alias("url"), "name", "is_dir", "size", "mtime", "rank")

    def sites(self, status: str | None = None, sort: str = "size", limit: int = 40) -> DataFrame:
        return reports.sites(self.table("hosts"), status, sort, limit)

    def stats(self) -> DataFrame:
        return reports.stats(self.table("hosts"))

    def candidate_stats(self) -> DataFrame:
        return reports.candidate_stats(self.table("candidates"))

    def sensitive_hosts(self) -> DataFrame:
        return self.table("hosts").where("status = 'sensitive'").select("host", F.coalesce("reason", F.lit("sensitive")).alias("reason")).orderBy("host")


def _names(schema: str) -> list[str]:
    depth, out, part = 0, [], ""
    for c in schema + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(part.split()[0])
            part = ""
        else:
            part += c
    return out


def _plain(v):
    """Entries may come as dicts or in the order of the struct."""
    if isinstance(v, Q.Thresholds):
        return (v.min_big, v.min_useful)
    if isinstance(v, list) and v and isinstance(v[0], dict):
        return [tuple(x.get(k) for k in ("url", "name", "is_dir", "size", "mtime")) for x in v]
    return v


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _counts() -> list[Column]:
    return Q.count_columns(F.col("name"), F.col("size"), F.col("is_dir"))


LOG = "host string, what int, seq long, now long, kind string, leaf boolean, dir_url string, files long, bytes long, big long, useful long, status string, server string, dirs long, reason string, purge boolean, trusted boolean, min_big long, min_useful long, failed boolean, url string, pos int, source string, finished array<string>, frontier array<string>"
STATE = "host string, what int, kind string, url string, leaf boolean, seen_at long, files long, bytes long, big long, useful long, status string, server string, dirs long, crawled_at long, reason string, trusted boolean, fails int, source string, found_at long, seq long, pos int"
FOLDED = "kind string, host string, url string, leaf boolean, seen_at long, src long, status string, server string, dirs long, files long, bytes long, crawled_at long, reason string, trusted boolean, fails int, source string, found_at long, seq long"
FLUSH = 20_000  # rows that a worker makes before it hands them on


def by_site(rows: DataFrame, order: list[str], run: Callable[[str, list[dict]], list[dict]], schema: str) -> DataFrame:
    """What `run` makes of each site's rows, in the given order: sites side by side, one at a time in a worker.

    Rows are dealt by host and sorted, so that a worker holds one site's rows and no group costs more than its rows do.
    """
    spark = rows.sparkSession
    made = to_arrow_schema(spark.createDataFrame([], schema).schema)
    dealt = rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "host").sortWithinPartitions("host", *order)

    def sites(batches):
        held, out, host = [], [], None
        for batch in batches:
            for row in batch.to_pylist():
                if row["host"] != host:
                    if held:
                        out += run(host, held)
                    held, host = [], row["host"]
                    if len(out) >= FLUSH:
                        yield pa.RecordBatch.from_pylist(out, made)
                        out = []
                held.append(row)
        if held:
            out += run(host, held)
        yield pa.RecordBatch.from_pylist(out, made)

    return dealt.mapInArrow(sites, schema)


def _shaped(df: DataFrame, schema: str) -> DataFrame:
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(" ".join(part.split()[1:])).alias(c) for part in schema.split(", ") for c in [part.split()[0]]])


def _log(listed: DataFrame, own: DataFrame, spread: DataFrame) -> DataFrame:
    own = own.withColumn("min_big", F.col("judge.min_big")).withColumn("min_useful", F.col("judge.min_useful"))
    return _union([_shaped(x.withColumn("what", F.lit(1)), LOG) for x in (listed, own, spread.withColumn("kind", F.lit("candidates")))])


def _state(mine: dict[str, DataFrame]) -> DataFrame:
    counts = mine["entries"].groupBy("dir_url").agg(*_counts()).withColumnRenamed("dir_url", "url")
    dirs = mine["dirs"].join(counts, "url", "left").withColumn("kind", F.lit("dir"))
    return _union([_shaped(x.withColumn("what", F.lit(0)), STATE) for x in (mine["hosts"].withColumn("kind", F.lit("host")), dirs, mine["candidates"].withColumn("kind", F.lit("candidate")))])


def _stored(host: str, rows: list[dict]) -> HostState:
    s = HostState(host)
    for r in rows:
        if r["kind"] == "host":
            s.row = {"host": host, **{k: r[k] for k in ("status", "server", "reason")}, **{k: r[k] or 0 for k in ("dirs", "files", "bytes", "crawled_at", "fails")}, "trusted": bool(r["trusted"])}
        elif r["kind"] == "dir":
            s.folders[r["url"]] = Folder(bool(r["leaf"]), *(r[k] or 0 for k in ("files", "bytes", "big", "useful", "seen_at")))
        else:
            s.candidates[r["url"]] = Candidate(r["source"], r["found_at"] or 0, r["seq"] or 0)
    return s


def _applied(s: HostState, kind: str, rows: list[dict]) -> None:
    r = rows[0]
    now = r["now"] or 0
    if kind == "entries":
        s.entries({x["dir_url"]: Folder(bool(x["leaf"]), *(x[k] or 0 for k in ("files", "bytes", "big", "useful")), now, x["seq"]) for x in rows})
    elif kind == "candidates":
        (s.trust if r["source"] in ("seed", "moved") else s.insert)([x["url"] for x in rows], r["source"], now)
    elif kind == "paused":
        s.paused(r["finished"] or [], r["frontier"] or [], now)
    else:
        judge = Q.Thresholds(r["min_big"], int(r["min_useful"])) if r["min_big"] is not None else None
        s.done(r["status"], r["server"], r["dirs"] or 0, r["reason"], bool(r["purge"]), bool(r["trusted"]), judge, bool(r["failed"]), now)


def _fold(host: str, rows: list[dict]) -> list[dict]:
    """Applies a site's messages to its state. One that fails is left out: the others apply again without it."""
    state, log = [r for r in rows if r["what"] == 0], [r for r in rows if r["what"] == 1]
    failed: dict[int, tuple[str, str]] = {}
    while True:
        s = _stored(host, state)
        for (seq, kind), part in groupby(log, key=lambda r: (r["seq"], r["kind"])):
            if seq in failed:
                continue
            try:
                _applied(s, kind, list(part))
            except Exception as e:  # whatever a message holds, the site's other messages count
                failed[seq] = kind, f"{type(e).__name__}: {e}"
                break
        else:
            break
    out = [{"kind": "letter", "host": host, "seq": seq, "status": kind, "reason": why} for seq, (kind, why) in failed.items()]
    out += [{"kind": "host"} | s.row] if s.row else []
    out += [{"kind": "dir", "host": host, "url": u, "leaf": f.leaf, "seen_at": f.seen_at, "src": f.src} for u, f in s.folders.items()]
    return out + [{"kind": "candidate", "host": host, "url": u, "source": c.source, "found_at": c.found_at, "seq": c.seq} for u, c in s.candidates.items()]


def backfilled(dirs: DataFrame, entries: DataFrame) -> DataFrame:
    """Folders of which it is not noted whether they are leaves are so if they list no sub-folder."""
    subs = entries.where("is_dir").select(F.col("dir_url").alias("url")).distinct()
    found = dirs.where("leaf is null").join(subs, "url", "left_anti").select("url").distinct().withColumn("found", F.lit(True))
    return dirs.join(found, "url", "left").withColumn("leaf", F.coalesce("leaf", "found", F.lit(False))).select(*dirs.columns)
