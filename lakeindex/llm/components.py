"""Connected components of an edge table, entirely distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeindex.llm.common import materialize, sweep


def components(edges: DataFrame) -> DataFrame:
    """Rows (u, component) for every node of edges (u, v): component is the smallest node that links reach.

    Alternates the large-star and small-star steps until the edges no longer change, which takes about as many rounds as the
    logarithm of the number of nodes; each round is checkpointed. A node with many neighbours costs one aggregated row a task,
    and as both sides of each join are read from checkpoints, adaptive execution splits the edges of such nodes among tasks.
    Null ends and loops are ignored; without edges the result is empty.
    """
    e = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct()
    e, mark = _settled(e)
    while mark[0]:
        both = e.union(e.select("v", "u"))
        least = materialize(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        # Large star: every larger neighbour of u moves to the least of u's neighbourhood.
        e = materialize(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        # Small star: u and its smaller neighbours move to the least one.
        least = materialize(e.groupBy("u").agg(F.min("v").alias("m")))
        e = e.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").where("u <> v").distinct()
        e, now = _settled(e)
        sweep(e.sparkSession)
        if now == mark:
            break
        mark = now
    roots = e.select(F.col("v").alias("u")).distinct()
    return e.groupBy("u").agg(F.min("v").alias("component")).union(roots.join(e, "u", "left_anti").select("u", F.col("u").alias("component")))


def _settled(e: DataFrame) -> tuple[DataFrame, tuple]:
    e = materialize(e)
    row = e.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0)).alias("h"), F.coalesce(F.sum(F.xxhash64("u", "v") % 1000003), F.lit(0)).alias("s")).first()
    return e, tuple(row)
