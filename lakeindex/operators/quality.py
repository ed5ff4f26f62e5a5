"""What a site holds, how far it was read, and verdicts on it: one grouped plan for all sites."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeindex.functions.rules import is_big, is_useful, url_depth

# Fixed values of the verdicts.
MIN_EVIDENCE, MIN_SAMPLE_FOLDERS, HARD_FOLDERS = 100, 20, 2000
PROBE_FOLDERS, PROBE_EVERY = 100, 8
JUDGED = ("done", "paused", "partial", "unreachable", "not_listing")
STRIKES = 5


@dataclass(frozen=True)
class Thresholds:
    min_big: int = 3
    min_useful: int = 20

    @property
    def enabled(self) -> bool:
        return (self.min_big, self.min_useful) != (0, 0)


def count_columns(name: Column, size: Column, is_dir: Column) -> list[Column]:
    """Aggregates files, bytes, big and useful over entries; folders and unknown sizes add nothing."""
    file = ~is_dir
    n = lambda c: F.coalesce(F.count_if(c), F.lit(0))
    return [n(file).alias("files"), F.coalesce(F.sum(F.when(file, size)), F.lit(0)).alias("bytes"), n(file & is_big(size)).alias("big"), n(file & is_useful(name, size)).alias("useful")]


def host_counts(entries: DataFrame) -> DataFrame:
    """Rows (host, files, bytes, big, useful) of entries (host, name, size, is_dir)."""
    return entries.groupBy("host").agg(*count_columns(F.col("name"), F.col("size"), F.col("is_dir")))


def leaf_levels(dirs: DataFrame, entries: DataFrame) -> DataFrame:
    """Rows (host, level, level_folders, level_files): the deepest level with leaf folders, how many it has, and their files."""
    leaves = dirs.where("leaf").select("host", F.col("url").alias("dir_url"), url_depth(F.col("url")).alias("depth"))
    deepest = leaves.groupBy("host").agg(F.max("depth").alias("level"))
    at = leaves.join(deepest, "host").where("depth = level")
    files = entries.where(~F.col("is_dir")).groupBy("dir_url").agg(F.count("*").alias("n"))
    return at.join(files, "dir_url", "left").groupBy("host", "level").agg(F.count("*").alias("level_folders"), F.coalesce(F.sum("n"), F.lit(0)).alias("level_files"))


def progress(dirs: DataFrame, entries: DataFrame, hosts: DataFrame) -> DataFrame:
    """Counts, leaf level and folders read for every host that has any."""
    known = dirs.select("host").union(entries.select("host")).distinct()
    out = known.join(host_counts(entries), "host", "left").join(leaf_levels(dirs, entries), "host", "left").join(hosts.select("host", F.col("dirs").alias("folders_read")), "host", "left")
    return out.fillna(0, ["files", "bytes", "big", "useful", "level_folders", "level_files", "folders_read"])


def waiting(candidates: DataFrame, levels: DataFrame) -> DataFrame:
    """Rows (host, at_level, deepest) of what still waits."""
    w = candidates.select("host", url_depth(F.col("url")).alias("depth"))
    return w.join(levels.select("host", "level"), "host", "left").groupBy("host").agg(F.count_if(F.col("depth") == F.col("level")).alias("at_level"), F.max("depth").alias("deepest"))


def reason(t: Thresholds, files: Column, big: Column, useful: Column) -> Column:
    return F.format_string(f"nothing worth keeping: %d big files (need {t.min_big}) and %d useful files (need {t.min_useful}) among %d files", big, useful, files)


def _kept(t: Thresholds) -> Column:
    return (F.col("big") >= t.min_big) | (F.col("useful") >= t.min_useful)


def judge_final(t: Thresholds) -> Column:
    """The reason to drop a finished site, null to keep it. Reads files, big, useful."""
    return F.when(~_kept(t), reason(t, F.col("files"), F.col("big"), F.col("useful")))


def judge_ended(t: Thresholds) -> Column:
    """The same for a site that ended early: only when it is plainly junk."""
    junk = (F.col("files") >= MIN_EVIDENCE) & (F.col("big") == 0) & (F.col("useful") * 20 < F.col("files"))
    return F.when(~_kept(t) & junk, reason(t, F.col("files"), F.col("big"), F.col("useful")))


def is_fair() -> Column:
    """The leaves read speak for the rest. Reads level, level_folders, at_level, deepest."""
    return F.col("level").isNotNull() & (F.col("level_folders") >= MIN_SAMPLE_FOLDERS) & (F.col("deepest").isNull() | (F.col("deepest") <= F.col("level"))) & (F.coalesce("at_level", F.lit(0)) <= F.col("level_folders"))


def judge_crawling(t: Thresholds) -> Column:
    """The same for a site that is still read: junk beyond doubt, or endless."""
    fair = (F.col("level_files") >= MIN_EVIDENCE) & (F.col("useful") * 20 < F.col("level_files")) & is_fair()
    endless = (F.col("folders_read") >= HARD_FOLDERS) & (F.col("files") >= MIN_EVIDENCE) & (F.col("useful") * 100 < F.col("files"))
    return F.when(~_kept(t) & (F.col("big") == 0) & (fair | endless), reason(t, F.col("files"), F.col("big"), F.col("useful")))


def verdict(t: Thresholds, status: Column, trusted: Column) -> Column:
    """By status; trusted sites and other states are not judged, and thresholds of 0 and 0 keep all."""
    if not t.enabled:
        return F.lit(None).cast("string")
    made = F.when(status == "paused", judge_crawling(t)).when(status == "done", judge_final(t)).otherwise(judge_ended(t))
    return F.when(~trusted & status.isin(*JUDGED), made)


def judged(hosts: DataFrame, dirs: DataFrame, entries: DataFrame, candidates: DataFrame, t: Thresholds = Thresholds()) -> DataFrame:
    """Rows (host, drop_reason) of the hosts to drop."""
    p = progress(dirs, entries, hosts)
    rows = hosts.select("host", "status", "trusted").join(p, "host", "left").fillna(0, ["files", "big", "useful", "level_folders", "level_files", "folders_read"]).join(waiting(candidates, p), "host", "left")
    return rows.select("host", verdict(t, F.col("status"), F.col("trusted")).alias("drop_reason")).where("drop_reason is not null")
