"""Toxicity by weak supervision.

Voters are words and word beginnings that training rows single out, and a few patterns of writing. A generative label model
estimates how often each voter fires on toxic and on clean rows and how voters depend on each other; the given labels are one
more voter, which may err. Its posterior labels train a linear classifier on the voters, and that scores every text.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeindex.llm.common import bounded_sample, prepare, remainder, sweep, tidy

SAMPLE = 12_000  # labelled rows to learn from, at most
VOTERS = 3000  # words and beginnings that vote, at most
BEGINNINGS = (4, 6, 8)  # letters
THRESHOLD = 0.7
ONE_STEM = 12  # features of one word and its beginnings, at most
SURE = 0.95  # share of a sure voter's rows that the label model holds for toxic
TIED = 0.3  # correlation given the truth from which voters share their evidence
_WORD = re.compile(r"[^\W\d_]+")
PATTERNS = ("upper", "exclaiming", "elongated", "symbols")
_LONG = re.compile(r"(.)\1{3,}")


def features(text: str) -> set[str]:
    """The text's distinct lower-case words and their beginnings (marked by a star)."""
    words = set(_WORD.findall(text.lower()))
    for n in BEGINNINGS:
        words |= {w[:n] + "*" for w in words if len(w) > n and w[-1] != "*"}
    return words


def patterns(text: str) -> list[bool]:
    """What each pattern voter says of the text."""
    n = max(1, len(text))
    return [text.isupper(), text.count("!") * 40 > n, bool(_LONG.search(text)), sum(text.count(c) for c in "#*$%&|<>") * 20 > n]


def _count(batches):
    for batch in batches:
        yes, no = Counter(), Counter()
        for text, toxic in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            (yes if toxic else no).update(features(text or ""))
        keys = list(yes.keys() | no.keys())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([yes[k] for k in keys], pa.int64()), pa.array([no[k] for k in keys], pa.int64())], ["feature", "yes", "no"])


def _fire(voters: dict[str, int]):
    def run(batches):
        names = voters.keys()
        for batch in batches:
            rows = batch.column(1).to_pylist()
            fired = [sorted(voters[f] for f in names & features(t or "")) for t in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(fired, pa.list_(pa.int32())), pa.array([patterns(t or "") for t in rows], pa.list_(pa.bool_()))], ["doc_id", "toxic", "fired", "patterns"])

    return run


def merge_voters(fired: np.ndarray, alike: float = 0.8) -> np.ndarray:
    """Voters that fire on nearly the same rows are one: the group's number for each column."""
    n = fired.shape[1]
    both = fired.T @ fired
    each = np.diag(both)
    near = both >= alike * np.maximum(1, each[:, None] + each[None] - both)
    group = np.full(n, -1)
    for i in np.argsort(-each, kind="stable"):
        if group[i] < 0:
            group[near[i] & (group < 0)] = i
            group[i] = i
    return np.unique(group, return_inverse=True)[1]


def label_model(votes: np.ndarray, labels: np.ndarray, rounds: int = 30) -> np.ndarray:
    """Posterior of toxicity for each row, by expectation and maximisation over the voters' rates of firing given the truth.

    labels is the given vote, of unknown accuracy. A voter's evidence is shared among those it still agrees with more often
    than the truth explains.
    """
    n, m = votes.shape
    p = np.clip(labels, 0.05, 0.95).astype(votes.dtype)
    for turn in range(rounds):
        one, zero = p.sum() + 1, (1 - p).sum() + 1
        hit1, hit0 = (p @ votes + 0.5) / (one + 1), ((1 - p) @ votes + 0.05) / (zero + 1)
        right1, right0 = np.clip((p @ labels + 1) / (one + 1), 0.55, 0.999), np.clip(((1 - p) @ (1 - labels) + 1) / (zero + 1), 0.55, 0.999)
        if turn % 10 == 0:
            rest = votes - (np.outer(p, hit1 - hit0) + hit0).astype(votes.dtype)
            spread = np.sqrt((rest**2).mean(0)) + 1e-6
            tied = (rest.T @ rest) / n / np.outer(spread, spread)
            np.fill_diagonal(tied, 0)
            share = 1 / (1 + np.where(tied > TIED, tied, 0).sum(1))
        llr1, llr0 = ((np.log(a) * share).astype(votes.dtype) for a in (hit1 / hit0, (1 - hit1) / (1 - hit0)))
        z = np.log(one / zero) + votes @ (llr1 - llr0) + llr0.sum() + np.where(labels > 0, np.log(right1 / (1 - right0)), np.log((1 - right1) / right0))
        p = (1 / (1 + np.exp(-np.clip(z, -30, 30)))).astype(votes.dtype)
    return p


def logistic(x: np.ndarray, p: np.ndarray, ridge: float = 0.001, rounds: int = 500) -> tuple[np.ndarray, float]:
    """Weights and bias that fit the posterior labels: Adagrad on the ridge-penalised log loss."""
    w, b, p = np.zeros(x.shape[1]), 0.0, p.astype(x.dtype)
    scale, scale_b = np.full(x.shape[1], 1e-8), 1e-8
    for _ in range(rounds):
        g = (1 / (1 + np.exp(-np.clip(x @ w.astype(x.dtype) + b, -30, 30))) - p).astype(x.dtype)
        step, step_b = x.T @ g + ridge * w, g.sum()
        scale += step * step
        scale_b += step_b * step_b
        w -= 0.7 * step / np.sqrt(scale)
        b -= 0.7 * step_b / np.sqrt(scale_b)
    return w, float(b)


class Scorer:
    """A linear score over voters, over whether a sure one fires, and over patterns. Merged voters count once."""

    def __init__(self, voters: dict[str, int], weights: np.ndarray, bias: float, sure: frozenset | set = frozenset()):
        self.voters, self.weights, self.bias, self.sure = voters, weights, bias, sure

    def score(self, text: str) -> float:
        m = len(self.weights) - len(PATTERNS) - 1
        fired = {self.voters[f] for f in self.voters.keys() & features(text)} if text else set()
        z = self.bias + sum(self.weights[i] for i in fired) + (self.weights[m] if fired & self.sure else 0.0)
        if text:
            z += sum(w for w, f in zip(self.weights[m + 1 :], patterns(text)) if f)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Scorer:
    """Learns from at most `sample` labelled documents, those of the smallest hashed ids; a null label is no label.

    Without labels of both kinds nothing votes and all texts score the share of toxic labels (0 without any).
    """
    named = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg((F.max("toxic") > 0).alias("toxic"))
    # At most `sample` ids and labels, so their broadcast is bounded by a parameter.
    chosen = F.broadcast(bounded_sample(named, "doc_id", sample))
    rows = docs.select("doc_id", "text").join(chosen, "doc_id")
    # Copies of one text are one piece of evidence.
    rows = rows.groupBy(F.sha2("text", 256).alias("h"), "toxic").agg(F.min("doc_id").alias("doc_id"), F.first("text").alias("text"))
    counts = rows.select("text", "toxic").mapInArrow(tidy(_count), "feature string, yes long, no long").groupBy("feature").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"))
    size = rows.agg(F.coalesce(F.sum(F.col("toxic").cast("int")), F.lit(0)).alias("yes"), F.count("*").alias("n")).first()
    base = min(0.5, max(1e-6, size.yes / max(1, size.n)))
    if not size.yes or size.yes == size.n:
        return Scorer({}, np.zeros(len(PATTERNS) + 1), float(np.log(max(base, 1e-6))) if size.n else -30.0)
    # Evidence that a feature's share of toxic rows is above the base rate: rows times the divergence of the two shares.
    n, q = F.col("yes") + F.col("no"), F.col("yes") / (F.col("yes") + F.col("no"))
    gain = n * (q * F.log(q / base) + F.when(q < 1, (1 - q) * F.log((1 - q) / (1 - base))).otherwise(0.0))
    tests = counts.count()
    best = counts.where((F.col("yes") >= 4) & (q > max(0.5, 3 * base))).withColumn("gain", gain).where(F.col("gain") > float(np.log(max(2, tests)) + 2)).orderBy(F.desc("gain"), "feature").limit(VOTERS).collect()
    number = {r.feature: i for i, r in enumerate(best)}
    got = rows.select("doc_id", "text", "toxic").mapInArrow(tidy(_fire(number)), "doc_id long, toxic boolean, fired array<int>, patterns array<boolean>").orderBy("doc_id", "fired").limit(sample).collect()
    fired = np.zeros((len(got), len(number)), np.float32)
    for i, r in enumerate(got):
        fired[i, r.fired] = 1
    group = merge_voters(fired) if number else np.zeros(0, int)
    # Many features that fire on the same rows are the words of near copies of one text; they say nothing of other texts.
    number = {f: i for f, i in number.items() if (group == group[i]).sum() <= ONE_STEM}
    fired = fired[:, list(number.values())]
    group = np.unique(group[list(number.values())], return_inverse=True)[1]
    m = int(group.max()) + 1 if len(group) else 0
    votes = np.zeros((len(got), m), np.float32)
    for j, g in enumerate(group):
        votes[:, g] = np.maximum(votes[:, g], fired[:, j])
    more = np.array([r.patterns for r in got], np.float32).reshape(len(got), len(PATTERNS))
    p = label_model(np.concatenate([votes, more], axis=1), np.array([r.toxic for r in got], np.float32))
    sure = (p @ votes + 0.05) / (votes.sum(0) + 0.1) >= SURE
    one = votes[:, sure].max(1, keepdims=True) if sure.any() else np.zeros((len(got), 1))
    del got, fired
    sweep(docs.sparkSession)
    weights, bias = logistic(np.concatenate([votes, one, more], axis=1, dtype=np.float32), p)
    return Scorer({f: int(g) for f, g in zip(number, group)}, weights, bias, set(np.flatnonzero(sure).tolist()))


def _score(scorer: Scorer):
    def run(batches):
        for batch in batches:
            scores = [scorer.score(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(scores, pa.float64()), pa.array([int(s >= THRESHOLD) for s in scores], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return run


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Scorer:
    """Fits on rows whose crc32(doc_id) mod 3 is not 1."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return fit(rows.where(remainder("doc_id", 3) != 1), labels.where(remainder("doc_id", 3) != 1), sample)


def score_documents(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one for each document, by its whole text alone.

    predicted is 1 from a score of 0.7. held_out marks rows whose crc32(doc_id) mod 3 is 1; nothing is learnt from them. Null
    texts count as empty; no voter fires on them. Repeated rows score alike. Other columns are ignored.
    """
    prepare(docs.sparkSession)
    scorer = learn(docs, labels, sample)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), (remainder("doc_id", 3) == 1).alias("held_out"))
    return rows.mapInArrow(tidy(_score(scorer)), "doc_id long, held_out boolean, score double, predicted int")


def keep_clean(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The documents that score below the threshold, with all their columns, in one pass over them.

    Null texts count as empty: no voter fires on them, so they stay unless most labelled rows are toxic.
    """
    prepare(docs.sparkSession)
    scorer, at = learn(docs, labels, sample), docs.columns.index("text")

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array([scorer.score(t or "") < THRESHOLD for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(tidy(run), docs.schema)
