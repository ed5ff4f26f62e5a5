"""Ranked full-text search: names and paths, prefix terms, BM25 over weighted columns.

The stored index is one table of postings (token, doc, tf_name, tf_path, length) that also holds what filters and hit lists ask of
a document, so a query reads only the tokens with its terms' prefixes and joins nothing. Without an index two passes over the
documents do: one for the statistics, one for the scores, neither with a shuffle. Statistics are over all documents, so filters
never change a rank.
"""

from __future__ import annotations

import re
import unicodedata
from functools import reduce
from operator import and_, or_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values of the ranking.
K1, B = 1.2, 0.75
NAME_WEIGHT, PATH_WEIGHT = 10.0, 1.0
LEAST_IDF = 1e-6
WORD = r"[\p{L}\p{N}]+"


@F.pandas_udf(StringType())
def _plain(text: pd.Series) -> pd.Series:
    return text.map(lambda t: "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn") if isinstance(t, str) else t)


def folded(text: Column) -> Column:
    """Lower case without diacritics. Only texts beyond ASCII go to Python (a condition around the call would not keep others away)."""
    return F.lower(F.coalesce(_plain(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text))


def tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_extract_all(folded(text), F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def query_terms(query: str) -> list[str]:
    """A query's distinct words, each the prefix of a token; a query without words is an error."""
    plain = "".join(c for c in unicodedata.normalize("NFD", query) if unicodedata.category(c) != "Mn").lower()
    words = ["".join(w) for w in re.findall(r"[^\W_]+", plain)]
    if not words:
        raise ValueError("the search needs a word")
    return list(dict.fromkeys(words))


def _tokenised(docs: DataFrame, key: str, name: str, path: str | None, keep: list[str]) -> DataFrame:
    none = F.array().cast("array<string>")
    return docs.select(F.col(key).alias("doc"), *keep, tokens(F.col(name)).alias("in_name"), (tokens(F.col(path)) if path else none).alias("in_path"))


def build_index(docs: DataFrame, key: str, name: str, path: str | None = None, keep: list[str] = ()) -> DataFrame:
    """Postings (token, doc, tf_name, tf_path, length, and the columns `keep` of the document)."""
    each = _tokenised(docs, key, name, path, list(keep)).withColumn("length", (F.size("in_name") + F.size("in_path")).cast("long"))
    one = lambda a, b: lambda t: F.struct(t.alias("token"), F.lit(a).alias("a"), F.lit(b).alias("b"))
    rows = each.select("doc", "length", *keep, F.explode(F.concat(F.transform("in_name", one(1, 0)), F.transform("in_path", one(0, 1)))).alias("t"))
    # A document's tokens lie in one task, so little but their sums is shuffled.
    return rows.groupBy("t.token", "doc", "length", *keep).agg(F.sum("t.a").alias("tf_name"), F.sum("t.b").alias("tf_path")).select("token", "doc", "tf_name", "tf_path", "length", *keep)


def statistics(docs: DataFrame, postings: DataFrame) -> tuple[int, float]:
    """How many documents there are, and their mean length, as an index keeps them."""
    n, total = docs.count(), postings.agg(F.coalesce(F.sum(F.col("tf_name") + F.col("tf_path")), F.lit(0))).first()[0]
    return n, total / n if n else 0.0


def _score(f: Column, n: int | Column, found: int | Column, length: Column, mean: float | Column) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    idf = F.greatest(F.log((lit(n) - lit(found) + 0.5) / (lit(found) + 0.5)), F.lit(LEAST_IDF))
    return idf * f * (K1 + 1) / (f + K1 * (1 - B + B * length / lit(mean)))


def ranked(postings: DataFrame, n: int, mean: float, query: str, keep: list[str] = ()) -> DataFrame:
    """Rows (doc, rank, and the columns `keep`) of the documents with all terms; lower ranks are better."""
    terms = query_terms(query)
    # The token filter is a disjunction of prefixes, which a reader of sorted postings can prune by.
    near = postings.where(reduce(or_, [F.col("token").startswith(t) for t in terms]))
    weight = NAME_WEIGHT * F.col("tf_name") + PATH_WEIGHT * F.col("tf_path")
    sums = [F.sum(F.when(F.col("token").startswith(t), weight).otherwise(0.0)).alias(f"f{i}") for i, t in enumerate(terms)]
    hits = near.groupBy("doc", "length", *keep).agg(*sums)
    # A row with how many documents have each term, whether they have the others or not.
    found = hits.agg(*[F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in range(len(terms))])
    all_terms = reduce(and_, [F.col(f"f{i}") > 0 for i in range(len(terms))])
    both = hits.where(all_terms).crossJoin(F.broadcast(found))  # one row on one side
    total = reduce(lambda a, b: a + b, [_score(F.col(f"f{i}"), n, F.col(f"n{i}"), F.col("length"), mean) for i in range(len(terms))])
    return both.select("doc", (-total).alias("rank"), *keep)


def scan_ranked(docs: DataFrame, key: str, name: str, path: str | None, query: str, keep: list[str] = ()) -> DataFrame:
    """The same without an index: a pass over the documents for the statistics and one for the scores."""
    terms = query_terms(query)
    each = _tokenised(docs, key, name, path, list(keep))
    times = lambda where, t: F.size(F.filter(where, lambda x: x.startswith(t)))
    f = [(NAME_WEIGHT * times(F.col("in_name"), t) + PATH_WEIGHT * times(F.col("in_path"), t)).alias(f"f{i}") for i, t in enumerate(terms)]
    rows = each.select("doc", *keep, (F.size("in_name") + F.size("in_path")).cast("long").alias("length"), *f)
    stats = rows.agg(F.count("*").alias("n"), F.avg("length").alias("mean"), *[F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in range(len(terms))]).first()
    total = reduce(lambda a, b: a + b, [_score(F.col(f"f{i}"), stats.n, stats[f"n{i}"], F.col("length"), stats["mean"] or 0.0) for i in range(len(terms))])
    return rows.where(reduce(and_, [F.col(f"f{i}") > 0 for i in range(len(terms))])).select("doc", (-total).alias("rank"), *keep)


def top(ranks: DataFrame, limit: int | None, keep: Column | None = None, tie: str = "doc") -> DataFrame:
    """The best of the ranked documents that `keep` holds for; ties go to the smaller key."""
    rows = (ranks if keep is None else ranks.where(keep)).orderBy("rank", tie)
    return rows if limit is None else rows.limit(limit)
