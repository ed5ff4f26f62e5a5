"""Writes as set operations: what a table holds afterwards, from what it held."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def in_range(url: Column, low: str, high: str) -> Column:
    return (url >= low) & (url < high)


def in_subtree(url: Column, folder: str) -> Column:
    """Everything under a folder's URL: from its slash to the character after it."""
    base = folder.rstrip("/")
    return in_range(url, base + "/", base + "0")


def purge(rows: DataFrame, hosts: DataFrame) -> DataFrame:
    """Rows of all other hosts."""
    return rows.join(hosts.select("host").distinct(), "host", "left_anti")
