"""Helpers that the operators of this package share."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeindex.ship import ship

#: What splits words everywhere in this package: space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One table of the data folder; only Spark opens the path."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors see: the cluster's spark.checkpoint.dir. A local master may do with a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="checkpoints-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that no frame reads any more, wherever Spark can write."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def materialize(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a reliable checkpoint in the shared folder, so that a lost executor costs no recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(True)


def sweep(spark: SparkSession) -> None:
    """Collects the driver's garbage after a phase of many queries, and with it their broadcasts and shuffle files everywhere."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
    _trim()


def _trim() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def prepare(spark: SparkSession, rows: int = 1000) -> None:
    """For operators with Python workers: ships the package, and bounds how many texts a worker holds at once."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def remainder(column: str, by: int) -> Column:
    """crc32 of the id as text, modulo `by`; of a null id 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % by, F.lit(0))


def bounded_sample(df: DataFrame, key: str, rows: int) -> DataFrame:
    """At most `rows` rows, the same ones on each run: the smallest hashes of the key."""
    return df.orderBy(F.xxhash64(F.col(key)), F.col(key)).limit(rows)


HOT = 4096  # keys that a join takes from a broadcast, at most
EVEN = 200  # rows of a key that are never too many


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], rows: str) -> DataFrame:
    """left.join(right, keys), where right has one row for each of the keys, and in its column `rows` how many left has of them.

    Keys of more than a HOT-th of left's rows, of which there can be HOT at most, come by broadcast, and their rows of left stay
    where they are; so no task of the shuffled join gathers a hot one. Keys must not be null; `right` should be materialized, as
    it is read several times.
    """
    out = [*left.columns, *[c for c in right.columns if c not in keys]]
    row = right.agg(F.max(rows).alias("most"), F.sum(rows).alias("all")).first()
    many = max(EVEN, (row["all"] or 0) // HOT)
    if (row.most or 0) <= many:
        return left.join(right, keys).select(*out)
    hot = F.broadcast(right.where(F.col(rows) > many))
    cold = left.join(hot, keys, "left_anti").join(right.where(F.col(rows) <= many), keys).select(*out)
    return left.join(hot, keys).select(*out).unionByName(cold)


LEAST_FILTER, MOST_FILTER = 1 << 16, 1 << 28  # bits of a filter of ids, 32 MB at most


def filter_width(count: int) -> int:
    """Sixteen bits or more an id as long as the bound allows; beyond it a filter lets more pass, and never less than it must."""
    return min(MOST_FILTER, max(LEAST_FILTER, 1 << (16 * max(1, count) - 1).bit_length()))


def filter_at(column: str, width: int) -> Column:
    """The bit of an id; null has one too."""
    return F.pmod(F.xxhash64(column), F.lit(width))


def filter_of(ids: DataFrame) -> tuple[bytes, int]:
    """A filter of the column id, and its number of bits: built by aggregation, so at most 32 MB reach the driver whatever the input."""
    width, held = filter_width(ids.agg(F.approx_count_distinct("id")).first()[0]), 32768  # bits that bitmap_construct_agg holds
    positions = ids.select(filter_at("id", width).alias("p"))
    rows = positions.groupBy((F.col("p") / held).cast("int").alias("k")).agg(F.bitmap_construct_agg(F.col("p") % held).alias("bits")).collect()
    out = np.zeros(width // 8, np.uint8)
    for r in rows:
        out[r.k * held // 8 : (r.k + 1) * held // 8] = np.frombuffer(r.bits, np.uint8)
    return out.tobytes(), width


def passes(bits: bytes):
    """A function of positions: false means that the id is certainly not in the filter."""
    table = np.frombuffer(bits, np.uint8)

    @F.arrow_udf("boolean")
    def test(p: pa.Array) -> pa.Array:
        at = p.to_numpy(zero_copy_only=False)
        return pa.array((table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1)

    return test


def tidy(run: Callable) -> Callable:
    """A worker's function that gives memory back to the system when its partition ends; idle workers then hold little."""

    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            _trim()

    return wrapped


def texts(column: pa.Array) -> list[str]:
    """The column's texts, null as empty."""
    return [x or "" for x in column.to_pylist()]


def byte_runs(column: pa.Array, most: int = 1 << 20) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Runs of consecutive rows of about `most` bytes: the first row's number, the bytes, and offsets into them. Null counts as empty."""
    flat = column.cast(pa.binary()).cast(pa.large_binary()).fill_null(b"") if not pa.types.is_large_binary(column.type) else column.fill_null(b"")
    if not len(flat):
        return
    offsets = np.frombuffer(flat.buffers()[1], np.int64, len(flat) + 1, flat.offset * 8)
    data = np.frombuffer(flat.buffers()[2], np.uint8) if flat.buffers()[2] is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(flat):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + most, side="right")) - 1)
        last = min(last, len(flat))
        yield first, data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last
