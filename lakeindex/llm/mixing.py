"""Mixing sources to target weights by entropy balancing.

Each document gets the rate (copies before rounding) that is nearest to its prior rate in relative entropy, tokens counted, while
every source's tokens meet the source's target. The dual of that problem has one multiplier a source; rates are the prior tilted
by its exponential, up to the cap. Newton's iterations solve the dual on sums by source and prior, so an iteration moves a few
rows for each source. Rounding is systematic within strata of similar sizes, so a source's error is a few documents.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeindex.llm.common import WORD, materialize

STRATUM = 200  # rows of a stratum, about
TICKS = 1_000_000_000  # steps of a rate, so that rounding is done with integers
ROUNDS = 200  # of Newton's steps; a few suffice


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def _ranked(sources: DataFrame) -> DataFrame:
    """Adds k, the place from 0 in the order of code points, null last: sorted by ranges, and counted by partition."""
    s = materialize(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    counts = sorted((r.p, r.n) for r in s.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect())  # as many as partitions
    before, offsets = 0, []
    for p, n in counts:
        offsets += [F.lit(p), F.lit(before)]
        before += n
    offset = F.create_map(*offsets)[part] if offsets else F.lit(0)
    return s.withColumn("k", offset + F.col("at").bitwiseAND((1 << 33) - 1)).drop("at")


def targets(sources: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: float = 3.0) -> DataFrame:
    """Of rows (source, size) with distinct sources: adds weight and target.

    Targets share the sum of sizes by weight. One above cap times its source's size stops there, and the excess is shared
    again by weight among the others until none is above. The shares' common level is the root of a piecewise linear
    function that rises, so Newton's steps end on it; each is one aggregation.
    """
    each = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("k") % len(weights) + 1).cast("int"))
    s = materialize(_ranked(sources).withColumn("weight", each))
    total = s.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    level, started = 0.0, False
    while True:  # each step puts one more source at its cap, or is the last
        # Sources at their cap for this level; the first step has none.
        full = (F.col("weight") * level >= F.col("size") * cap) if started else F.lit(False)
        row = s.agg(F.sum(F.when(full, F.col("size") * cap)).alias("held"), F.sum(F.when(~full, F.col("weight"))).alias("w")).first()
        new = (total - (row.held or 0)) / row.w if row.w else level
        if started and not new > level:
            break
        level, started = new, True
    return s.withColumn("target", F.least(F.col("weight") * level, F.col("size") * float(cap)))


def tilts(mass: DataFrame, cap: float = 3.0, tolerance: float = 1e-10) -> DataFrame:
    """Of rows (source, prior, mass, target): rows (source, tilt), the dual's solution by Newton's iterations.

    A source's gradient is target - sum of mass * min(cap, prior * exp(tilt)); its curvature is the part of that sum which is
    not at the cap. A step is held to 2 either way, which keeps exp in range, and to ever less, so that steps over the cap and back end. A source without mass or target gets null. Rates
    that are not settled after ROUNDS steps are an error: no mix is made from them.
    """
    rows = materialize(mass.where("mass > 0 and target > 0 and prior > 0").withColumn("tilt", F.lit(0.0)))
    w = ["source", "target", "tilt"]
    for turn in range(ROUNDS):
        most = 2.0 / (1 + turn // 10)
        rate = F.col("prior") * F.exp("tilt")
        sums = rows.groupBy(*w).agg(F.sum(F.col("mass") * F.least(rate, F.lit(float(cap)))).alias("got"), F.sum(F.when(rate < cap, F.col("mass") * rate).otherwise(0.0)).alias("bend"))
        gap = F.col("target") - F.col("got")
        step = F.when(F.abs(gap) <= F.col("target") * tolerance, 0.0).when(F.col("bend") > 0, F.greatest(F.lit(-most), F.least(F.lit(most), gap / F.col("bend")))).otherwise(F.when(gap < 0, -most / 4).otherwise(0.0))
        moved = sums.select("source", "target", F.col("tilt").alias("old"), (F.col("tilt") + step).alias("tilt"))
        rows = materialize(rows.drop("tilt", "target").alias("r").join(moved.alias("m"), F.col("r.source").eqNullSafe(F.col("m.source"))).select("r.*", "m.target", "m.tilt", "m.old"))
        if not rows.where(F.abs(F.col("tilt") - F.col("old")) > 1e-13).limit(1).count():
            break
        rows = rows.drop("old")
    else:
        raise RuntimeError(f"the dual is not solved after {ROUNDS} of Newton's steps")
    return rows.groupBy("source").agg(F.min("tilt").alias("tilt"))


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), cap: int = 3, size: Column | None = None, prior: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """Rows (doc, size, source_size, target, copies, taken), one for each row of docs, which is in the struct `doc`.

    size: the row's tokens, by default its text's words (null text: 0). prior: its positive rate before balancing, 1 by
    default. keep: the columns that `doc` holds, all by default; as they are in a struct, no name can clash. Sources stand in
    order of code points, null last, and take the weights in turn. taken is size * copies, and copies is at most cap, so no
    row exceeds cap times its size. Rows of size 0 get copies by their source's rate and take nothing; where a source's
    target is 0 its rate is 0. An empty table gives an empty result. Reruns agree, as do repeated rows up to their order.
    """
    doc = F.struct(*[F.col(c) for c in (keep or docs.columns)])
    held = docs.select(
        doc.alias("doc"), F.col("source").cast("string").alias("source"), (word_count(F.col("text")) if size is None else size.cast("long")).alias("size"), F.coalesce(F.lit(1.0) if prior is None else prior.cast("double"), F.lit(1.0)).alias("prior"),
        F.xxhash64(F.col("doc_id").cast("string"), F.lit(7)).alias("h"), F.crc32(F.col("doc_id").cast("string")).alias("c"),
    )
    held = held.withColumn("kind", F.floor(F.log2(F.col("size") + 1) * 4).cast("int"))
    slim = materialize(held if keep else held.drop("doc"))
    by_kind = materialize(slim.groupBy("source", "prior", "kind").agg(F.sum("size").alias("mass"), F.count("*").alias("rows")))
    source = targets(by_kind.groupBy("source").agg(F.sum("mass").alias("size")), weights, float(cap)).select("source", F.col("size").alias("source_size"), "target")
    mass = _by_source(by_kind.groupBy("source", "prior").agg(F.sum("mass").cast("double").alias("mass")), source.select("source", "target"))
    level = _by_source(source, tilts(mass, float(cap)), "left")
    rate = F.least(F.lit(float(cap)), F.col("prior") * F.coalesce(F.exp("tilt"), F.lit(0.0)))
    strata = materialize(_by_source(by_kind, level).select("source", "prior", "kind", "mass", "source_size", "target", rate.alias("rate"), F.ceil(F.col("rows") / STRATUM).alias("salts")))
    first = _rounded(slim.drop("doc"), strata.withColumn("ticks", F.round(F.col("rate") * TICKS).cast("long")))
    # What rounding left over is made up for by the smallest documents that suffice, which are rounded again.
    gap = first.groupBy("source", "target").agg((F.col("target") - F.sum("taken")).alias("gap")).drop("target")
    kinds = _by_source(strata, gap).groupBy("source", "kind", "gap").agg(F.sum("mass").alias("mass"), F.sum(F.col("mass") * F.least(F.col("rate"), cap - F.col("rate"))).alias("room"))
    up = Window.partitionBy("source").orderBy("kind")
    kinds = kinds.withColumn("before", F.coalesce(F.sum("room").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))).where(F.col("before") < 2 * F.abs("gap"))
    change = kinds.groupBy("source").agg((F.first("gap") / F.greatest(F.sum("mass"), F.lit(1))).alias("change"), F.max("kind").alias("upto"))
    moved = F.when(F.col("kind") <= F.col("upto"), F.greatest(F.lit(0.0), F.least(F.lit(float(cap)), F.col("rate") + F.col("change")))).otherwise(F.col("rate"))
    final = _by_source(strata, change, "left").withColumn("ticks", F.round(moved * TICKS).cast("long"))
    return _rounded(slim if keep else held, materialize(final)).select("doc", "size", "source_size", "target", "copies", "taken")


def _by_source(left: DataFrame, right: DataFrame, how: str = "inner") -> DataFrame:
    """Joins on source, null equal to null."""
    return left.alias("a").join(right.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")), how).select("a.*", *[f"b.{c}" for c in right.columns if c != "source"])


def _rounded(rows: DataFrame, strata: DataFrame) -> DataFrame:
    """Adds copies and taken: within each stratum, in order of size, the i-th row gets what the running sum of rates gains.

    A stratum holds about STRATUM rows of one source, prior and kind (quarter octave of size), dealt by the hash of their id.
    """
    same = reduce(lambda x, y: x & y, [F.col("d.source").eqNullSafe(F.col("s.source")), F.col("d.kind") == F.col("s.kind"), F.col("d.prior") == F.col("s.prior")])
    rows = rows.alias("d").join(strata.select("source", "prior", "kind", "source_size", "target", "ticks", "salts").alias("s"), same).select("d.*", "s.source_size", "s.target", "s.ticks", F.pmod("d.h", "s.salts").alias("salt"))
    stratum = ["source", "prior", "kind", "salt"]
    rows = rows.withColumn("i", F.row_number().over(Window.partitionBy(*stratum).orderBy("size", "h", "c")).cast("long"))
    rows = rows.withColumn("u", F.pmod(F.xxhash64(*stratum, F.lit(11)), F.lit(TICKS)))
    copies = F.expr(f"(ticks * i + u) div {TICKS} - (ticks * (i - 1) + u) div {TICKS}").cast("int")
    return rows.withColumn("copies", copies).withColumn("taken", F.col("size") * F.col("copies")).drop("i", "u", "ticks", "salt")


def repeat_documents(mixed: DataFrame) -> DataFrame:
    """The rows that the mix takes, each as often as it has copies, with the columns they came with."""
    return mixed.where("copies > 0").select("doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("doc.*")
