"""Language identification by error-correcting output codes.

Each language has a codeword; a linear n-gram classifier predicts each bit. Decoding weighs every bit's loss by how well its
classifier did on rows kept from its training, takes the nearest codeword and flags texts whose two nearest are close.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeindex.llm.common import bounded_sample, byte_runs, prepare, remainder, tidy

BITS = 13  # of a hashed n-gram
SAMPLE = 6000  # documents that classifiers train on, at most
EACH = 100  # of them for each language before the rest are taken
BLOCK = 256  # training rows that are dense at once
AMBIGUOUS = 0.2  # share of the loss between the two nearest codewords below which a text is flagged
ORDERS = (1, 2, 3)  # bytes of an n-gram
UNKNOWN = "und"

_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[:] = [c if 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256)]


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """n rows of bits -1 and 1: every split of the languages for up to 5, beyond that random columns, the farthest apart of many draws."""
    if n < 2:
        return np.ones((n, 1), np.int8)
    if n <= 5:
        codes = [[1 if k >> i & 1 else -1 for i in range(n)] for k in range(1 << (n - 1), (1 << n) - 1)]
        return np.array(codes, np.int8).T
    rng, length, best, found = np.random.default_rng(seed), int(4 * np.ceil(np.log2(n))) + 7, -1, None
    for _ in range(200):
        c = np.where(rng.random((n, length)) < 0.5, -1, 1).astype(np.int8)
        apart = (c[:, None] != c[None]).sum(2) + np.eye(n, dtype=int) * length
        if (abs(c.sum(0)) < n).all() and apart.min() > best:
            best, found = apart.min(), c
    return found


def _grams(data: np.ndarray, offsets: np.ndarray):
    """For each order the hashed n-grams of the folded bytes, and the first byte of each; none runs over a text's border."""
    x = _FOLD[data]
    # All that is not a letter is one space, and its runs are one gap to n-grams that hold a letter.
    letter = x != 32
    bound = np.zeros(len(x) + 1, bool)
    bound[offsets] = True
    for n in ORDERS:
        if len(x) < n:
            continue
        m = len(x) - n + 1
        h = np.full(m, n, np.uint32)
        ok = letter[:m].copy()
        for i in range(n):
            h = h * np.uint32(0x9E3779B1) + x[i : i + m] + np.uint32(1)
            if i:
                ok |= letter[i : i + m]
                ok &= ~bound[i : i + m]
        if n == 3:
            ok &= letter[1 : 1 + m]
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        at = np.flatnonzero(ok)
        yield (h[at] >> np.uint32(32 - BITS)).astype(np.int64), at


def _has_letter(text: str) -> bool:
    return any(c.isalpha() for c in text[:200]) or any(c.isalpha() for c in text[200:])


def _vector(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of n-gram counts, as roots of their shares, for each text of a run."""
    rows = len(offsets) - 1
    out = np.zeros((rows, len(ORDERS), 1 << BITS), np.float32)
    for k, (h, at) in enumerate(_grams(data, offsets)):
        doc = np.searchsorted(offsets, at, side="right") - 1
        out[:, k] = np.bincount(doc * (1 << BITS) + h, minlength=rows << BITS).reshape(rows, 1 << BITS)
    return out.reshape(rows, -1)


def _sparse(batches):
    for batch in batches:
        keys, counts = [], []
        for _, data, offsets in byte_runs(batch.column(1), 1 << 14):
            for v in _vector(data, offsets):
                k = np.flatnonzero(v)
                keys.append(k.astype(np.int32))
                counts.append(v[k])
        ends = pa.array(np.cumsum([0, *map(len, keys)]).astype(np.int32))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int32), *keys]))), pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.float32), *counts])))], ["doc_id", "lang", "k", "n"])


class Codes:
    """Codewords, one linear classifier a bit, and the weights of the bits."""

    def __init__(self, languages: list[str], codes: np.ndarray, weights: np.ndarray, bias: np.ndarray, trust: np.ndarray):
        self.languages, self.codes, self.weights, self.bias, self.trust = languages, codes, weights, bias, trust

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The nearest codeword, its share of the closeness (0 to 1), and whether the second is close."""
        losses = np.log1p(np.exp(-np.clip(margins[:, None, :] * self.codes[None], -30, 30))) @ self.trust
        best = losses.argmin(1)
        near = np.exp(-(losses - losses.min(1, keepdims=True)))
        share = near[np.arange(len(best)), best] / near.sum(1)
        order = np.sort(losses, axis=1)
        close = (order[:, 1] - order[:, 0]) < AMBIGUOUS * np.maximum(order[:, 1], 1e-9) if losses.shape[1] > 1 else np.zeros(len(best), bool)
        return best, share, close


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], epochs: int = 60) -> Codes:
    """Of rows (language, n-gram numbers, counts): logistic classifiers by gradient steps on rooted shares; the last tenth weighs the bits."""
    languages = sorted({r[0] for r in rows})
    codes = codewords(len(languages))
    width = len(ORDERS) << BITS
    if not rows:
        return Codes([], codes, np.zeros((width, 1), np.float32), np.zeros(1), np.ones(1))
    shares = []
    for _, k, n in rows:
        order = k >> BITS
        shares.append((30 * n / np.maximum(np.bincount(order, n, len(ORDERS)), 1)[order]).astype(np.float32))
    x = np.zeros((min(BLOCK, len(rows)), width), np.float32)

    def blocks(first: int, last: int):
        """Rows first to last, some at a time: their slice and their dense values, which the next block overwrites."""
        for at in range(first, last, BLOCK):
            to = min(at + BLOCK, last)
            x[:] = 0
            for i in range(at, to):
                x[i - at, rows[i][1]] = shares[i]
            yield slice(at, to), x[: to - at]

    number = {name: i for i, name in enumerate(languages)}
    y = codes[[number[r[0]] for r in rows]].astype(np.float32)
    kept = max(1, len(rows) - len(rows) // 10)
    w, b = np.zeros((width, y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    scale = np.zeros_like(w)
    for _ in range(epochs):
        step, total = 1e-5 * w, np.zeros_like(b)
        for at, a in blocks(0, kept):
            t = y[at]
            g = -t / (1 + np.exp(np.clip(t * (a @ w + b), -30, 30))) / kept
            step += a.T @ g
            total += g.sum(0)
        scale += step * step
        w -= 0.5 * step / np.sqrt(scale + 1e-12)
        b -= 2 * total
    first = kept if kept < len(rows) else 0
    right = sum((np.sign(a @ w + b) == y[at]).sum(0) for at, a in blocks(first, len(rows))) / (len(rows) - first)
    trust = np.clip(np.log(np.clip(right, 0.51, 0.999) / np.clip(1 - right, 0.001, 0.49)), 0.05, None)
    return Codes(languages, codes, w * 30, b, trust / trust.sum() * len(trust))


def sample_ids(known: DataFrame, sample: int) -> DataFrame:
    """At most `sample` different (doc_id, lang): the smallest hashed ids of each language in turn up to EACH, then the smallest of all."""
    keys = known.select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    turn = F.row_number().over(Window.partitionBy("lang").orderBy("h", "doc_id"))
    few = keys.withColumn("turn", turn).where(F.col("turn") <= EACH)
    rest = bounded_sample(keys, "doc_id", sample).withColumn("turn", F.lit(EACH + 1))
    both = few.unionByName(rest).groupBy("doc_id", "lang", "h").agg(F.min("turn").alias("turn"))
    return both.orderBy("turn", "h", "doc_id", "lang").limit(sample).select("doc_id", "lang")


def fit(docs: DataFrame, sample: int = SAMPLE) -> Codes:
    """Learns from at most `sample` documents (columns doc_id, text, lang; lang not null), those of the smallest hashed ids.

    Each language has documents among them, if there are no more languages than `sample`. Of rows that repeat an id and its
    language one counts. What the driver holds is bounded by sample times the number of hashed n-grams, whatever the texts' length.
    """
    known = docs.where("lang is not null and text is not null and doc_id is not null")
    # At most `sample` ids, so their broadcast is bounded by a parameter.
    ids = F.broadcast(sample_ids(known, sample))
    rows = known.select("doc_id", "text", "lang").join(ids, ["doc_id", "lang"], "left_semi").select("doc_id", "text", "lang").mapInArrow(tidy(_sparse), "doc_id long, lang string, k array<int>, n array<float>")
    got: dict[tuple[int, str], tuple[np.ndarray, np.ndarray]] = {}
    for r in rows.toLocalIterator():
        new, old = (np.array(r.k, np.int32), np.array(r.n, np.float32)), got.get((r.doc_id, r.lang))
        if old is None or [a.tobytes() for a in new] < [a.tobytes() for a in old]:
            got[r.doc_id, r.lang] = new
    order = sorted(got, key=lambda x: (crc32(str(x[0]).encode()), x))
    # The first row of each language comes before all others, so that it is none of those that only weigh the bits.
    firsts = {lang: (i, lang) for i, lang in reversed(order)}
    order.sort(key=lambda x: firsts[x[1]] != x)
    return train([(x[1], *got[x]) for x in order])


def _predict(model: Codes):
    width = 1 << BITS
    tables = np.ascontiguousarray(model.weights.reshape(len(ORDERS), width, -1)) if model.languages else None

    def run(batches):
        for batch in batches:
            langs, scores, flags = [], [], []
            texts = batch.column(1).to_pylist()
            for first, data, offsets in byte_runs(batch.column(1), 1 << 18):
                rows = len(offsets) - 1
                if tables is None:
                    langs += [UNKNOWN] * rows
                    scores += [0.0] * rows
                    flags += [True] * rows
                    continue
                margins = np.tile(model.bias.astype(np.float64), (rows, 1))
                for k, (h, at) in enumerate(_grams(data, offsets)):
                    cuts = np.searchsorted(at, offsets)
                    n = np.maximum(np.diff(cuts), 1)
                    for j in range(tables.shape[2]):
                        total = np.zeros(len(h) + 1)
                        np.cumsum(tables[k, :, j][h], dtype=np.float64, out=total[1:])
                        margins[:, j] += (total[cuts[1:]] - total[cuts[:-1]]) / n
                best, share, close = model.decode(margins)
                for i in range(rows):
                    known = _has_letter(texts[first + i] or "")
                    langs.append(model.languages[best[i]] if known else UNKNOWN)
                    scores.append(round(float(share[i]), 6) if known else 0.0)
                    flags.append(bool(close[i]) if known else True)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(flags, pa.bool_())], ["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    return run


def identify(docs: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Rows (doc_id, held_out, lang_pred, score, ambiguous), one for each document, by its whole text alone.

    Learns from documents whose crc32(doc_id) mod 4 is not 2 and whose lang is known; held_out marks the others. A null text, or
    one without letters, is `und` with score 0; so is every text when there is nothing to learn from. Other columns are ignored.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), (remainder("doc_id", 4) == 2).alias("held_out"))
    model = fit(rows.where("not held_out").drop("held_out"), sample)
    return rows.select("doc_id", "text", "held_out").mapInArrow(tidy(_predict(model)), "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")
