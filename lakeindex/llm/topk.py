"""Exact top-k inner products with an impact-ordered index, score at a time.

A block of vectors becomes an index: for each dimension a posting list in order of the component, cut into segments of equal
quantised value. A query sorts the segments by impact (|query component| times the segment's largest value) and takes them in
falling order, a share of all postings at a time; a segment adds its quantised score to its vectors, and one to the number of
their components seen. What a vector has not shown yet counts for at most the next segment's impact a component. The best vectors
so far are scored exactly, which gives a score that the k-th best reaches; so do blocks searched before. Vectors whose bound lies
below it are out by proof. Once few are left, or all segments are done, these are scored exactly. Nothing is stopped without proof.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeindex.llm.common import materialize, prepare

LEVEL = 4  # components of one segment lie within this many units
SHARES = (0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.85, 1.0)  # of the postings, after which the proof is tried
TRIED = 64  # vectors scored exactly after each share, for the score to beat
FEW = 8  # one in so many vectors left is few enough to score them all
ROWS, QUERIES = 8192, 512  # of a block, about
PAIRS, MANY = 256, 32  # pairs of blocks that are tasks enough, beyond which a pair takes more queries; blocks of them, at most


class Index:
    """The impact-ordered index of a block of distinct integer vectors; copies says how many rows each stands for."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, copies: np.ndarray | None = None):
        self.ids, self.vectors, self.copies = ids, vectors, np.ones(len(ids), np.int64) if copies is None else copies
        n, dims = vectors.shape
        level = vectors // LEVEL
        order = np.argsort(level, axis=0, kind="stable").T
        sorted_levels = np.take_along_axis(level.T, order, axis=1)
        cuts = np.diff(sorted_levels, axis=1, prepend=sorted_levels[:, :1] - 1) != 0
        self.postings, starts = order.ravel(), np.flatnonzero(cuts)
        self.starts, self.lengths = starts, np.diff(starts, append=n * dims)
        self.dims, levels = starts // max(1, n), sorted_levels.ravel()[starts]
        # Scores are doubled, so that the middle of a segment is an integer.
        self.middles, self.largest = 2 * LEVEL * levels + LEVEL - 1, LEVEL * np.maximum(np.abs(levels), np.abs(levels + 1))
        self.seen = 1 << dims.bit_length()  # a vector's sum holds its score times this, plus the components seen
        self.greatest = int(np.abs(vectors).max(initial=0))
        # Sums of such products are exact in doubles as well, which are multiplied much faster, if they stay below 2^53.
        self.doubles = vectors.astype(np.float64)
        self.first = 0  # of SHARES, where the proof is tried first: one before that which proved the last query

    def search(self, q: np.ndarray, k: int, query_id: int, bound: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Ids, rows and exact scores of the k best vectors, ties to smaller ids, but for one row of the query's own id and vector.

        Vectors that surely score below `bound` may be missing. The last value is the share of postings that were read.
        """
        n, dims = self.vectors.shape
        rows, own = self.copies, np.flatnonzero(self.ids == query_id)
        if len(own):
            rows = rows.copy()
            rows[own] -= (self.vectors[own] == q).all(axis=1)
        members, read = np.flatnonzero(rows > 0), 0.0
        value = np.abs(q)[self.dims]
        impacts = value * self.largest
        small = float(np.abs(q).sum()) * self.greatest < 1 << 53
        vectors, asked = (self.doubles, q.astype(np.float64)) if small else (self.vectors, q)
        if len(members) > max(k, TRIED) and 2 * self.seen * float(np.abs(q).sum()) * float(self.largest.max(initial=0) + LEVEL) < 1 << 53:
            order = np.argsort(-impacts, kind="stable")
            upto = np.cumsum(self.lengths[order])
            sums, at, others = np.zeros(n), 0, members
            around = int(np.abs(q).sum()) * (LEVEL - 1)  # between segments' middles and their members, doubled
            for step in range(min(self.first, len(SHARES) - 1), len(SHARES)):
                to = min(len(order), int(np.searchsorted(upto, SHARES[step] * upto[-1])) + 1)
                # The segments of a component that are taken lie side by side, mostly in two runs: the largest and the smallest.
                if to == at:
                    continue
                taken, at = np.sort(order[at:to]), to
                sizes = self.lengths[taken]
                breaks = np.flatnonzero(np.diff(taken) != 1) + 1
                begins, ends = self.starts[taken[np.r_[0, breaks]]], (self.starts + self.lengths)[taken[np.r_[breaks - 1, len(taken) - 1]]]
                postings = np.concatenate([self.postings[i:j] for i, j in zip(begins.tolist(), ends.tolist())])
                sums += np.bincount(postings, np.repeat(q[self.dims[taken]] * self.middles[taken] * float(self.seen) + 1, sizes), minlength=n)
                whole = sums if len(others) == n else sums[others]
                scores = np.floor(whole / self.seen)  # `seen` is a power of two, so all of this is exact
                unseen = dims - (whole - scores * self.seen)
                read = float(upto[at - 1] / upto[-1])
                tried = others[np.argpartition(scores, len(scores) - TRIED)[len(scores) - TRIED :]]
                least = int(np.partition(vectors[tried] @ asked, TRIED - k)[TRIED - k])
                bound = least if bound is None else max(bound, least)
                left = 2 * int(impacts[order[at]]) if at < len(order) else 0
                members = others[scores + around + unseen * left >= 2 * bound]
                if len(members) <= n // FEW:
                    break
            self.first = max(0, step - 1)
        exact = (vectors[members] @ asked).astype(np.int64)
        if len(exact) > k:  # ties of the k-th best stay
            near = exact >= np.partition(exact, len(exact) - k)[len(exact) - k]
            members, exact = members[near], exact[near]
        best = np.lexsort((self.ids[members], -exact))[:k]
        return self.ids[members[best]], rows[members[best]], exact[best], read


def _vectors(table: pa.Table) -> np.ndarray:
    return table.column("v").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1).astype(np.int64)


FOUND = "query_id long, q long, times long, vec_id long, copies long, score long, reached long"


def _search(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out, reached = [np.zeros((0, 6), np.int64)], []
        if left.num_rows and right.num_rows:
            index = Index(left.column("vec_id").to_numpy(), _vectors(left), left.column("copies").to_numpy())
            for query_id, q, times, v, bound in zip(*(right.column(c).to_pylist() for c in ("vec_id", "q", "copies")), _vectors(right), right.column("bound").to_pylist()):
                ids, rows, scores, _ = index.search(v, k, query_id, bound)
                each = np.repeat(scores, np.minimum(rows, k))
                out.append(np.stack([np.full(len(ids), query_id), np.full(len(ids), q), np.full(len(ids), times), ids, rows, scores], axis=1))
                reached += [int(each[k - 1]) if len(each) >= k else None] * len(ids)
        flat = np.concatenate(out)
        return pa.table([*map(pa.array, flat.T), pa.array(reached, pa.int64())], [c.split()[0] for c in FOUND.split(", ")])

    return run


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, scale: float = 256.0, id_column: str = "vec_id", vector_column: str = "embedding", rows: int = ROWS, block: int = QUERIES) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): each query's k highest inner products with all rows but its own.

    Components become floor(scale * x). Ties go to the smaller vec_id; ranks start at 1; a query with fewer others gets them
    all. Vectors (and queries) that are null, empty, of null id, or hold null or non-finite components take no part. Vectors
    of different lengths are not compared; scores must fit 64 bits. Rows that repeat an id are rows of their own, as queries and as candidates: a query
    leaves out one row of its id and vector. Other columns are ignored.

    Candidates and queries are dealt to blocks; a pair of blocks is one task's work and leaves k rows a query. The first block
    of candidates goes before the others and gives each query the score to beat in them.
    """
    if not 0 < k <= TRIED:
        raise ValueError(f"k must be from 1 to {TRIED}")
    prepare(vectors.sparkSession)
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))

    def clean(df: DataFrame) -> DataFrame:
        v = F.col(vector_column).cast("array<double>")
        df = df.select(F.col(id_column).cast("long").alias("vec_id"), v.alias("v")).where(F.col("vec_id").isNotNull() & (F.size("v") > 0) & ~F.exists("v", bad))
        return df.select("vec_id", F.transform("v", lambda x: F.floor(x * F.lit(scale)).cast("long")).alias("v")).groupBy("vec_id", "v").agg(F.count("*").alias("copies")).withColumn("d", F.size("v")).withColumn("q", F.xxhash64("v"))

    left, right = materialize(clean(vectors)), materialize(clean(queries))
    blocks = [max(1, -(-df.count() // n)) for df, n in ((left, rows), (right, block))]
    dealt = [F.pmod(F.xxhash64("vec_id", "q", F.lit(s)), F.lit(n)).cast("int") for s, n in enumerate(blocks)]
    left, right = left.withColumn("i", dealt[0]), right.withColumn("j", dealt[1])
    # Candidates go to each block of queries: where their own blocks give tasks enough, a few large ones of queries do.
    wide = max(-(-blocks[1] // MANY), min(blocks[1], -(-PAIRS // blocks[0])))

    def pairs(some: DataFrame, asked: DataFrame, n: int) -> DataFrame:
        some = some.withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
        return some.groupBy("d", "i", "j").cogroup(asked.groupBy("d", "i", "j")).applyInArrow(_search(k), FOUND)

    found = materialize(pairs(left.where("i = 0"), right.withColumn("bound", F.lit(None).cast("long")).withColumn("i", F.lit(0)), blocks[1]))
    if blocks[0] > 1:
        reached = found.groupBy(F.col("query_id").alias("vec_id"), "q").agg(F.max("reached").alias("bound"))
        asked = right.join(reached, ["vec_id", "q"], "left").withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(blocks[0] - 1)))).withColumn("j", F.col("j") % wide)
        found = found.unionByName(pairs(left.where("i > 0"), asked, wide))
    each = found.select("query_id", "q", "times", "vec_id", "score", F.explode(F.sequence(F.lit(1).cast("long"), F.least("copies", F.lit(k).cast("long")))))
    best = F.row_number().over(Window.partitionBy("query_id", "q").orderBy(F.desc("score"), "vec_id"))
    top = each.withColumn("rank", best).where(F.col("rank") <= k)
    return top.select("query_id", "rank", "vec_id", "score", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("query_id", "rank", "vec_id", "score")
