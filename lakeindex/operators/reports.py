"""Summaries and ordered lists of the lake."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeindex.functions.rules import url_depth

ORDERS = {"size": ("bytes", True), "files": ("files", True), "recent": ("crawled_at", True), "name": (None, False)}


def sites(hosts: DataFrame, status: str | None = None, sort: str = "size", limit: int = 40) -> DataFrame:
    """The first hosts in one of four orders; ties by name."""
    column, falling = ORDERS[sort]
    rows = hosts if status is None else hosts.where(F.col("status") == status)
    keys = ([F.desc(column)] if falling else []) + [F.asc("host")]
    return rows.orderBy(*keys).limit(limit)


def stats(hosts: DataFrame) -> DataFrame:
    """Hosts, files and bytes for each status, the most hosts first."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return hosts.groupBy("status").agg(F.count("*").alias("hosts"), total("files"), total("bytes")).orderBy(F.desc("hosts"), "status")


def candidate_stats(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("source").agg(F.count("*").alias("urls"), F.count_distinct("host").alias("hosts")).orderBy("source")


def source_order(source: Column) -> Column:
    return F.when(source.isin("seed", "moved"), 0).when(source == "resume", 1).when(source == "link", 2).otherwise(3)


def pending(candidates: DataFrame, hosts: DataFrame, want: int, exclude: DataFrame | None = None) -> DataFrame:
    """The next hosts to read: best source first, then the longest known, then by name; finished hosts never."""
    closed = hosts.where("status <> 'paused'").select("host")
    rows = candidates.join(closed, "host", "left_anti")
    if exclude is not None:
        rows = rows.join(exclude, "host", "left_anti")
    return rows.groupBy("host").agg(F.min(source_order(F.col("source"))).alias("priority"), F.min("found_at").alias("found_at")).orderBy("priority", "found_at", "host").limit(want)


def waiting_urls(candidates: DataFrame) -> DataFrame:
    """Each host's waiting URLs as an array, shallow ones first, then in the order of insertion."""
    key = F.struct(url_depth(F.col("url")).alias("depth"), F.col("seq"), F.col("url"))
    return candidates.groupBy("host").agg(F.transform(F.sort_array(F.collect_list(key)), lambda k: k["url"]).alias("urls"))
