"""Quality rules: statistics of texts, and an isolation forest on them.

The forest isolates rows by random splits of random statistics; the shorter a row's mean path, the stranger the row. Its trees
grow on a bounded sample of labelled rows that the base rule keeps, whatever their label; then all documents are scored. The
threshold comes from the scores of all labelled rows: the one of the least cost that nearly all rows of good quality stay below.
What the base rule rejects stays rejected.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeindex.llm.common import WORD, bounded_sample, materialize, prepare, tidy

TREES, LEAF_SAMPLE = 120, 256  # trees, and rows that each grows on
SAMPLE = 6000  # labelled documents that trees draw from, at most
BINS = 10_000  # steps of a score, so that the threshold comes from counts by step
GOOD_KEPT = 0.99  # least share of good rows that stay below the threshold
COST = 10.0  # of a good row dropped, in bad rows kept
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RATIOS = ["mean_word", "symbol_ratio", "repeat_ratio", "upper_ratio"]
#: What the forest splits: the logarithms of the five counts, and the ratios.
WIDTH = len(STATS) + len(RATIOS)
_WORDS, _SYMBOL, _HAS_WORD = re.compile(WORD), str.maketrans("", "", "#*$%&|<>"), re.compile(WORD)
_LETTER, _UPPER = re.compile(r"[^A-Za-z]+"), re.compile(r"[^A-Z]+")


def statistics(text: str) -> tuple[list[int], list[float]]:
    """The five counts, and ratios that do not grow with the text."""
    words = _WORDS.findall(text)
    n = len(words)
    if not n:
        return [0, 0, len(text) - len(text.translate(_SYMBOL)), 0, 0], [0.0] * len(RATIOS)
    chars = sum(map(len, words))
    symbols = len(text) - len(text.translate(_SYMBOL))
    lines = [x for x in text.split("\n") if _HAS_WORD.search(x)]
    dup = len(lines) - len(set(lines))
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    repeated = 0
    if n >= 4:
        v = len(number)
        windows = (ids[:-2] * v + ids[1:-1]) * v + ids[2:] if v < 2_000_000 else np.unique(np.stack([ids[:-2], ids[1:-1], ids[2:]]), axis=1, return_inverse=True)[1].ravel()
        _, at, times = np.unique(windows, return_inverse=True, return_counts=True)
        twice = np.flatnonzero(times[at] > 1)
        covered = np.zeros(n, bool)
        covered[twice] = covered[twice + 1] = covered[twice + 2] = True
        repeated = int(covered.sum())
    cased = len(_LETTER.sub("", text))
    ratios = [chars / n, symbols / n, repeated / n, len(_UPPER.sub("", text)) / max(1, cased)]
    return [n, chars, symbols, dup, repeated], [float(x) for x in ratios]


def base_failed(n_words: int, n_repeat_words: int) -> bool:
    return n_words < 50 or 100 * n_repeat_words > 50 * n_words


class IsolationForest:
    """Random trees as arrays: feature, threshold, children, and the path length of a leaf."""

    def __init__(self, rows: np.ndarray, trees: int = TREES, sample: int = LEAF_SAMPLE, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.sample = min(sample, len(rows))
        self.trees = [self._grow(rows[rng.choice(len(rows), self.sample, replace=False)], rng) for _ in range(trees)] if len(rows) else []

    @staticmethod
    def usual(n: int) -> float:
        """The mean path of an unsuccessful search among n rows."""
        return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n

    def _grow(self, rows: np.ndarray, rng) -> tuple[np.ndarray, ...]:
        feature, cut, left, right, length = [], [], [], [], []

        def node(part: np.ndarray, depth: int) -> int:
            k = len(feature)
            for a, v in ((feature, -1), (cut, 0.0), (left, k), (right, k), (length, depth + self.usual(len(part)))):
                a.append(v)
            low, high = (part.min(0), part.max(0)) if len(part) else (np.zeros(0), np.zeros(0))
            spread = np.flatnonzero(high > low)
            if len(part) > 1 and depth < np.ceil(np.log2(self.sample)) + 2 and len(spread):
                f = int(rng.choice(spread))
                at = rng.uniform(low[f], high[f])
                below = part[:, f] <= at
                feature[k], cut[k] = f, at
                left[k], right[k] = node(part[below], depth + 1), node(part[~below], depth + 1)
            return k

        node(rows, 0)
        return np.array(feature), np.array(cut), np.array(left), np.array(right), np.array(length)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        """2 ** (- mean path / usual path): near 1 for anomalies, below 0.5 for common rows."""
        if not self.trees or not len(rows):
            return np.zeros(len(rows))
        total = np.zeros(len(rows))
        index = np.arange(len(rows))
        for feature, cut, left, right, length in self.trees:
            at = np.zeros(len(rows), np.int64)
            while True:
                f = feature[at]
                inner = f >= 0
                if not inner.any():
                    break
                at = np.where(inner & (rows[index, np.maximum(f, 0)] <= cut[at]), left[at], np.where(inner, right[at], at))
            total += length[at]
        return 2.0 ** (-total / len(self.trees) / max(self.usual(self.sample), 1e-9))


def features(measured: list[tuple[list[int], list[float]]]) -> np.ndarray:
    """The forest's rows, of what `statistics` says of texts."""
    counts, ratios = (np.array([m[i] for m in measured], float).reshape(len(measured), -1) for i in (0, 1))
    return np.concatenate([np.log1p(counts), ratios], axis=1) if len(measured) else np.zeros((0, WIDTH))


def _measure(batches):
    for batch in batches:
        both = [statistics(t or "") for t in batch.column(1).to_pylist()]
        passed = pa.array([not base_failed(s[0], s[4]) for s, _ in both], pa.bool_())
        yield pa.RecordBatch.from_arrays([batch.column(0), passed, pa.array(features(both).tolist(), pa.list_(pa.float64()))], ["doc_id", "passed", "row"])


def _judge(forest: IsolationForest):
    def run(batches):
        for batch in batches:
            both = [statistics(t or "") for t in batch.column(1).to_pylist()]
            scores = forest.scores(features(both))
            counts = [pa.array([s[k] for s, _ in both], pa.int64()) for k in range(len(STATS))]
            failed = pa.array([base_failed(s[0], s[4]) for s, _ in both], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, failed, pa.array(scores, pa.float64())], ["doc_id", *STATS, "base_failed", "anomaly"])

    return run


def fit(docs: DataFrame, known: DataFrame, sample: int = SAMPLE) -> IsolationForest:
    """A forest grown on at most `sample` of the labelled rows (doc_id, quality), those of the smallest hashed ids."""
    # At most `sample` ids, so their broadcast is bounded by a parameter.
    chosen = F.broadcast(bounded_sample(known, "doc_id", sample).select("doc_id"))
    rows = docs.join(chosen, "doc_id").select("doc_id", "text").mapInArrow(tidy(_measure), "doc_id long, passed boolean, row array<double>")
    got = rows.where("passed").dropDuplicates(["doc_id"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()
    return IsolationForest(np.array([r.row for r in got], float).reshape(-1, WIDTH))


def step_of(score: Column) -> Column:
    return F.floor(score * BINS).cast("int")


def calibrated(counts: dict[tuple[int, int], int]) -> int:
    """The last step of scores that stay, of counts by (step, quality): of the steps that GOOD_KEPT of the good rows stay within, the one of the least cost.

    Ties go to the lower step. Without good rows all stay.
    """
    good, bad = (np.array([counts.get((b, q), 0) for b in range(BINS + 1)], float) for q in (1, 0))
    if not good.sum():
        return BINS
    share = np.cumsum(good) / good.sum()
    kept_bad = np.cumsum(bad) / bad.sum() if bad.sum() else np.zeros(BINS + 1)
    first = int(np.searchsorted(share, GOOD_KEPT))
    if not bad.sum():
        return int(np.flatnonzero(good)[-1])
    return first + int(np.argmin((COST * (1 - share) + kept_bad)[first:]))


def quality_rules(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Rows (doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, anomaly).

    Null texts count as empty and fail the base rule, as all texts under 50 words do. labels has (doc_id, quality); of labels
    that repeat an id the least counts, and an empty table keeps all that the base rule keeps. Rows that repeat an id are judged
    each by its own text. Other columns are ignored. Texts are read for the sample and once more for all; labels then meet rows
    of numbers only.
    """
    prepare(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = labels.where("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("int").alias("quality"))
    out = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, anomaly double"
    scored = materialize(rows.mapInArrow(tidy(_judge(fit(rows, known, sample))), out))
    steps = scored.where("not base_failed").join(known, "doc_id").groupBy(step_of(F.col("anomaly")).alias("step"), "quality").agg(F.count("*").alias("n"))
    most = calibrated({(r.step, r.quality): r.n for r in steps.collect()})  # at most two rows for each of BINS steps
    return scored.select("doc_id", *STATS, "base_failed", (~F.col("base_failed") & (step_of(F.col("anomaly")) <= most)).alias("kept"), "anomaly")
