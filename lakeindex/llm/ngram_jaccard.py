"""N-gram Jaccard self-join of documents: size-banded tiles, hashed bitmap signatures, exact sorted-array intersection.

A document's set holds the 64-bit hashes of its distinct word n-grams; two n-grams share one by chance only, once in 2 ** 64. The
join is exact on these sets:

1. One pass finds n-grams that are frequent within runs of documents; at most HEAVY of them, the most frequent, go last in the
   order of tokens. Any fixed order gives the same links; this one keeps shared passages from gathering documents.
2. A second pass gives each document its set's size, a cryptographic digest of the whole set and its prefix: of n tokens, the
   first n - ceil(t * n) + 1. Two sets that reach the similarity t share a token of their prefixes. Equal digests are one class.
3. A rare token's classes stand in order of size; only those with a neighbour whose size and place of the token allow the
   similarity go on. A frequent token's classes, of which there may be many, are only counted. They go on with hashed bitmaps, in
   blocks of about GROUP: bits that differ bound the overlap from above, and pairs within the bound make candidate families.
4. Each family is cut into size bands and blocks of about BLOCK classes; every tile (a pair of blocks of equal or
   neighbouring bands) tests its pairs by the bitmaps' bound and then by intersecting the sorted arrays. A tile emits, for
   each class, its number of linked documents, and the few links that span its groups, never all pairs.
5. Components of these links give the result; copies are counted by class and never expanded.
"""

from __future__ import annotations

import math
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeindex.llm.common import filter_at, filter_of, hot_join, materialize, passes, prepare, sweep, tidy
from lakeindex.llm.components import components
from lakeindex.llm.hashing import shingle_sets

HEAVY = 1 << 16  # n-grams kept as frequent; bounds what is sent to executors
RUN = 1 << 21  # n-grams counted at once in a task
OFTEN = 4  # times in such a run that make an n-gram frequent
BLOCK, TOKENS = 64, 1 << 21  # classes in a block of a tile, and their tokens
GROUP = 512  # classes in a block of those that share a token
LEAST_BITS, MOST_BITS = 64, 8192  # of a signature


def _heavy_rows(n: int):
    def run(batches):
        held, many = [], 0
        for batch in batches:
            for s in shingle_sets(batch.column(0), n):
                held.append(s)
                many += len(s)
                if many >= RUN:
                    yield _often(held)
                    held, many = [], 0
        if held:
            yield _often(held)

    return run


def _often(held: list[np.ndarray]) -> pa.RecordBatch:
    tokens, times = np.unique(np.concatenate(held), return_counts=True)
    keep = times >= OFTEN
    return pa.RecordBatch.from_arrays([pa.array(tokens[keep].view(np.int64)), pa.array(times[keep].astype(np.int64))], ["token", "times"])


def _prefix(s: np.ndarray, heavy: np.ndarray, rank: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """The first tokens of s in the order: those not heavy by hash, then the heavy ones by rank."""
    p = len(s) + (-num * len(s)) // den + 1
    if not len(s) or not len(heavy):
        return s[:p], s[:0]
    at = np.minimum(np.searchsorted(heavy, s), len(heavy) - 1)
    hot = heavy[at] == s
    light = s[~hot][:p]
    last = s[hot]
    return light, last[np.argsort(rank[at[hot]])[: p - len(light)]]


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint64), *parts]).view(np.int64)))


def _sets(n: int, num: int, den: int, heavy: np.ndarray, rank: np.ndarray):
    def run(batches):
        for batch in batches:
            sizes, digests, rare, frequent = [], [], [], []
            for s in shingle_sets(batch.column(1), n):
                sizes.append(len(s))
                digests.append(blake2b(s.tobytes(), digest_size=16).digest())
                light, last = _prefix(s, heavy, rank, num, den)
                rare.append(light)
                frequent.append(last)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), _lists(rare), _lists(frequent)], ["doc_id", "n", "digest", "rare", "frequent"])

    return run


def bits_of(size: int) -> int:
    """The width of a set's signature: the power of 2 from its size, within bounds."""
    return min(MOST_BITS, max(LEAST_BITS, 1 << (size - 1).bit_length()))


def bitmap(s: np.ndarray, width: int) -> np.ndarray:
    """The set's signature: one bit for each token's hash modulo the width, as 64-bit words."""
    bits = np.zeros(width, np.uint8)
    bits[(s & np.uint64(width - 1)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view(np.uint64)


def fold(words: np.ndarray, width: int) -> np.ndarray:
    """The signature that the same set has at a smaller width."""
    while len(words) * 64 > width:
        half = len(words) // 2
        words = words[:half] | words[half:]
    return words


def may_link(size: int, bits: np.ndarray, sizes: np.ndarray, others: np.ndarray, num: int, den: int) -> np.ndarray:
    """Which of the other sets can reach the similarity: tokens in one set only are at least as many as bits that differ."""
    apart = np.bitwise_count(others ^ bits).sum(axis=1, dtype=np.int64)
    most = (size + sizes - apart) // 2
    return (num + den) * most >= num * (size + sizes)


class _Signatures:
    """Signatures of sets in order of size, folded to each width that a comparison needs."""

    def __init__(self, sizes: np.ndarray, words: list[np.ndarray]):
        self.sizes, self.words, self.at = sizes, words, {}

    def window(self, i: int, num: int, den: int) -> tuple[int, int]:
        n = int(self.sizes[i])
        return int(np.searchsorted(self.sizes, -(-num * n // den))), int(np.searchsorted(self.sizes, n * den // num, side="right"))

    def matrix(self, width: int) -> np.ndarray:
        """All signatures of at least this width, folded to it; rows of narrower ones hold zeros."""
        if width not in self.at:
            m = np.zeros((len(self.words), width // 64), np.uint64)
            for i, w in enumerate(self.words):
                if len(w) * 64 >= width:
                    m[i] = fold(w, width)
            self.at[width] = m
        return self.at[width]

    def near(self, i: int, js: np.ndarray, num: int, den: int) -> np.ndarray:
        """Those of js that may link with i."""
        width = len(self.words[i]) * 64
        out, widths = [], self._widths(js, width)
        for small in np.unique(widths).tolist():
            part, m = js[widths == small], self.matrix(small)
            out.append(part[may_link(int(self.sizes[i]), m[i], self.sizes[part], m[part], num, den)])
        return np.sort(np.concatenate(out)) if out else js[:0]

    def _widths(self, js: np.ndarray, most: int) -> np.ndarray:
        if not hasattr(self, "all_widths"):
            self.all_widths = np.array([len(w) * 64 for w in self.words])
        return np.minimum(self.all_widths[js], most)


def _families(num: int, den: int):
    """Of rows (token, tile, n, id, bits) sorted so: edges that span each group of classes whose bitmaps may link."""

    def spans(sizes, ids, words):
        if len(ids) == 2:
            width = 64 * min(map(len, words))
            if may_link(int(sizes[0]), fold(words[0], width), sizes[1:], fold(words[1], width)[None], num, den)[0]:
                yield int(ids[0]), int(ids[1])
            return
        sig, left = _Signatures(sizes, words), np.ones(len(ids), bool)
        for seed in range(len(ids)):
            if not left[seed]:
                continue
            left[seed], queue = False, [seed]
            while queue:
                i = queue.pop()
                a, b = sig.window(i, num, den)
                for j in sig.near(i, a + np.flatnonzero(left[a:b]), num, den).tolist():
                    left[j] = False
                    queue.append(j)
                    yield int(ids[i]), int(ids[j])

    def run(batches):
        held, token, seen = [], None, set()

        def close():
            if len(held) > 1:
                sizes, ids = np.array([h[0] for h in held], np.int64), [h[1] for h in held]
                for edge in spans(sizes, ids, [np.frombuffer(h[2], np.uint64) for h in held]):
                    seen.add(edge)

        for batch in batches:
            for t, tile, *row in zip(*(c.to_pylist() for c in batch.columns)):
                if (t := (t, tile)) != token:
                    close()
                    held, token = [], t
                held.append(row)
            if len(seen) > 200_000:
                yield _edges(seen)
                seen.clear()
        close()
        yield _edges(seen)

    return run


def _edges(seen: set) -> pa.RecordBatch:
    flat = np.array(sorted(seen), np.int64).reshape(-1, 2)
    return pa.RecordBatch.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["u", "v"])


def _members(n: int, filtered: bytes, signatures: bool):
    """Of the documents whose id passes the filter: id, set size, and the signature or else the sorted array."""
    bits = np.frombuffer(filtered, np.uint8)

    def run(batches):
        for batch in batches:
            at = batch.column(2).to_numpy()
            keep = pa.array((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1)
            sets = list(shingle_sets(batch.column(1).filter(keep), n))
            data = [(bitmap(s, bits_of(len(s))) if signatures else s).tobytes() for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), pa.array([len(s) for s in sets], pa.int64()), pa.array(data, pa.binary())], ["id", "n", "data"])

    return run


def overlap(s: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """The sizes of the intersections of a sorted array with each of the other sorted arrays."""
    flat, cuts = np.concatenate(others), np.cumsum([0, *map(len, others)])[:-1]
    at = np.minimum(np.searchsorted(s, flat), len(s) - 1)
    return np.add.reduceat((s[at] == flat).astype(np.int64), cuts)


def _tile(num: int, den: int):
    """Exact links of a tile's pairs: rows (u, v) that span the groups, and (u, null, number of linked documents)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("n", "ascending"), ("id", "ascending")])
        ids, sizes, side, copies = (table.column(c).to_numpy() for c in ("id", "n", "side", "copies"))
        sets = [np.frombuffer(x, np.uint64) for x in table.column("tokens").to_pylist()]
        sig = _Signatures(sizes, [bitmap(s, bits_of(len(s))) for s in sets])
        parent, linked, edges = list(range(len(ids))), np.zeros(len(ids), np.int64), []

        def root(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        whole = (side == 2).all()
        for i in range(len(ids)):
            js = np.arange(i + 1, sig.window(i, num, den)[1])
            js = sig.near(i, js if whole else js[side[js] != side[i]], num, den)
            if not len(js):
                continue
            both = overlap(sets[i], [sets[j] for j in js])
            js = js[(num + den) * both >= num * (sizes[i] + sizes[js])]
            linked[i] += copies[js].sum()
            linked[js] += copies[i]
            for j in js.tolist():
                a, b = root(i), root(j)
                if a != b:
                    parent[b] = a
                    edges.append((ids[i], ids[j]))
        some = np.flatnonzero(linked)
        u = np.concatenate([np.array([e[0] for e in edges], np.int64), ids[some]])
        v = pa.array([int(e[1]) for e in edges] + [None] * len(some), pa.int64())
        w = np.concatenate([np.zeros(len(edges), np.int64), linked[some]])
        return pa.table({"u": pa.array(u, pa.int64()), "v": v, "links": pa.array(w, pa.int64())})

    return run


def _tiles(members: DataFrame, num: int, den: int) -> DataFrame:
    """Rows of the classes (family, id, n, copies) dealt to tiles: a column for the tile, and on which side of it."""
    # A hair over the exact base, so that rounding never sets linked sizes two bands apart.
    base = math.log(den / num) * 1.0001 if num < den else 1e-9
    m = materialize(members.withColumn("band", F.floor(F.log("n") / F.lit(base)).cast("long")))
    blocks = materialize(m.groupBy("family", "band").agg(F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / TOKENS)).cast("int").alias("blocks"), F.count("*").alias("rows")))
    up, down = (blocks.select("family", (F.col("band") + by).alias("band"), F.col("blocks").alias(name)) for by, name in ((-1, "above"), (1, "below")))
    sizes = materialize(blocks.join(up, ["family", "band"], "left").join(down, ["family", "band"], "left"))
    m = hot_join(m, sizes, ["family", "band"], "rows").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    none = F.array().cast("array<struct<band:long,a:int,b:int,side:int>>")
    tile = lambda band, a, b, side: F.struct(band.alias("band"), a.cast("int").alias("a"), b.cast("int").alias("b"), side.cast("int").alias("side"))
    own = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: tile(F.col("band") * 2, F.least(k, F.col("block")), F.greatest(k, F.col("block")), F.when(k == F.col("block"), F.lit(2)).when(F.col("block") < k, F.lit(0)).otherwise(F.lit(1))))
    # In a tile of two different blocks, rows of the diagonal do not occur; on the diagonal all pairs count.
    over = F.when(F.col("above") > 0, F.transform(F.sequence(F.lit(0), F.col("above") - 1), lambda k: tile(F.col("band") * 2 + 1, F.col("block"), k, F.lit(0)))).otherwise(none)
    under = F.when(F.col("below") > 0, F.transform(F.sequence(F.lit(0), F.col("below") - 1), lambda k: tile(F.col("band") * 2 - 1, k, F.col("block"), F.lit(1)))).otherwise(none)
    return m.select("family", "id", "n", "copies", F.explode(F.concat(own, over, under)).alias("t")).select("family", "t.*", "id", "n", "copies")


def jaccard_groups(docs: DataFrame, words: int = 5, similarity: tuple[int, int] = (80, 100), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Rows (doc_id, n_shingles, component_id, n_links), one for each document.

    Words are lower-cased (A-Z) runs of anything but space and controls 9-13; a document's set holds its distinct windows of
    `words` words, of a shorter text the whole sequence. Documents link when intersection / union is at least
    similarity[0] / similarity[1]. component_id is the smallest id that links reach, n_links the number of other rows that
    link directly. Null and empty texts have no shingles, their own id and no links. Rows that repeat an id count as copies
    when their texts agree. A null id stays null and never becomes a component's name while another row has one; a group
    of null ids only has component null. Other columns are ignored.
    """
    num, den = similarity
    if not 0 < num <= den:
        raise ValueError("similarity must be above 0 and at most 1")
    prepare(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    heavy = rows.select("text").mapInArrow(tidy(_heavy_rows(words)), "token long, times long").groupBy("token").agg(F.sum("times").alias("times")).orderBy(F.desc("times"), "token").limit(HEAVY).toArrow()
    tokens = heavy.column("token").to_numpy().astype(np.int64).view(np.uint64)
    order, rank = np.argsort(tokens), np.arange(len(tokens), 0, -1)  # the rarest first

    sets = materialize(rows.mapInArrow(tidy(_sets(words, num, den, tokens[order], rank[order])), "doc_id long, n long, digest binary, rare array<long>, frequent array<long>"))
    classes = materialize(sets.where("n > 0").groupBy("n", "digest").agg(F.min("doc_id").alias("id"), F.count("*").alias("copies"), F.first("rare").alias("rare"), F.first("frequent").alias("frequent")))
    named = classes.where("id is not null")

    # Of two linked classes the smaller has a shared token among its first n - ceil(2t / (1 + t) * n) + 1.
    w = Window.partitionBy("token")
    run = w.orderBy("n", "id")
    early = F.expr(f"pos <= n - (2 * {num} * n + {num + den} - 1) div {num + den}")
    smaller, larger = F.max(F.when(F.col("early"), F.col("n"))).over(run.rowsBetween(Window.unboundedPreceding, -1)), F.lead("n").over(run)
    rare = (
        named.select("id", "n", F.posexplode("rare").alias("pos", "token")).select("token", "n", "id", early.alias("early"))
        .select("token", "n", "id", F.ceil(F.count("*").over(w) / GROUP).cast("int").alias("blocks"), ((smaller * den >= F.col("n") * num) | (F.col("early") & (larger * num <= F.col("n") * den))).alias("near"))
        .where("near").drop("near")
    )
    # Frequent tokens are HEAVY at most, so their counts may be broadcast, and their classes need not meet.
    frequent = named.select(F.explode("frequent").alias("token"), "n", "id")
    many = frequent.groupBy("token").agg(F.count("*").alias("rows")).where("rows > 1")
    shared = materialize(rare.unionByName(frequent.join(F.broadcast(many), "token").select("token", "n", "id", F.ceil(F.col("rows") / GROUP).cast("int").alias("blocks"))))

    sweep(docs.sparkSession)

    def of(ids: DataFrame, signatures: bool) -> DataFrame:
        """Rows (id, n, data), each once; they lie by id and n, as the joins with them need."""
        filtered, width = filter_of(ids)
        read = rows.where("doc_id is not null").select(F.col("doc_id").alias("id"), "text").select("id", "text", filter_at("id", width).alias("p"))
        return read.mapInArrow(tidy(_members(words, filtered, signatures)), "id long, n long, data binary").repartition("id", "n").dropDuplicates()

    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.least(k, block) * F.col("blocks") + F.greatest(k, block))
    dealt = shared.select("token", "n", "id", F.explode(pairs).alias("tile"))
    grouped = dealt.join(of(shared, True), ["id", "n"]).select("token", "tile", "n", "id", F.col("data").alias("bits")).repartition("token", "tile").sortWithinPartitions("token", "tile", "n", "id")
    families = materialize(components(grouped.mapInArrow(tidy(_families(num, den)), "u long, v long")).select(F.col("u").alias("id"), F.col("component").alias("family")))
    dealt = _tiles(families.join(classes.select("id", "n", "copies"), "id"), num, den).join(of(families, False), ["id", "n"]).withColumnRenamed("data", "tokens")
    found = materialize(dealt.groupBy("family", "band", "a", "b").applyInArrow(_tile(num, den), "u long, v long, links long"))
    sweep(docs.sparkSession)
    links = found.where("v is null").groupBy(F.col("u").alias("id")).agg(F.sum("links").alias("linked"))
    named = links.join(components(found.where("v is not null").select("u", "v")).withColumnRenamed("u", "id"), "id", "left")
    classes = materialize(classes.select("n", "digest", "id", "copies").join(named, "id", "left"))
    out = sets.select("doc_id", "n", "digest").join(classes, ["n", "digest"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "id", "doc_id").alias("component_id"), F.when(F.col("copies").isNull(), F.lit(0)).otherwise(F.col("copies") - 1 + F.coalesce("linked", F.lit(0))).cast("long").alias("n_links"))


def keep_first(docs: DataFrame, words: int = 5, similarity: tuple[int, int] = (80, 100), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Of each group of linked documents the row of the smallest id; rows without links, shingles or id all stay.

    Rows that repeat the smallest id of a group count as one: one of them stays. All columns stay as they are.
    """
    groups = jaccard_groups(docs, words, similarity, id_column, text_column)
    # An id is dropped when it is linked and not its component's; a kept id that is linked may stand on repeated rows.
    linked = groups.where("n_links > 0 and doc_id is not null").groupBy("doc_id").agg(F.min(F.col("component_id") == F.col("doc_id")).alias("stays"), F.count("*").alias("times"))
    marked = materialize(linked.where("not stays or times > 1").select(F.col("doc_id").alias("id"), "stays", "times"))
    filtered, width = filter_of(marked)

    # Only rows whose id passes the filter of marked ids are shuffled to be sure; the others stay as they are.
    rows = docs.select(F.struct("*").alias("d"), F.col(id_column).cast("long").alias("id"))
    rows = rows.withColumn("perhaps", F.col("id").isNotNull() & passes(filtered)(filter_at("id", width)))
    out = rows.where("not perhaps").select("d.*")
    joined = rows.where("perhaps").join(marked, "id", "left").where("stays is null or stays")
    out = out.unionByName(joined.where("times is null or times = 1").select("d.*"))
    if marked.where("stays and times > 1").limit(1).count():
        k = F.row_number().over(Window.partitionBy("id").orderBy(F.xxhash64("d")))
        out = out.unionByName(joined.where("times > 1").withColumn("k", k).where("k = 1").select("d.*"))
    return out
