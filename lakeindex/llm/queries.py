"""The queries of this package's operators, with production parameters, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeindex.llm.common import LOWER, UPPER, load, shared_dir


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeindex.llm.ngram_jaccard import jaccard_groups

    return jaccard_groups(load(spark, sf_dir, "documents"), words=4, similarity=(85, 100))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeindex.llm.langid import identify

    return identify(load(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeindex.llm.pii import digest_spans, find_spans

    return digest_spans(find_spans(load(spark, sf_dir, "documents").select("doc_id", "text")))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeindex.llm.bpe import digest_documents

    return digest_documents(load(spark, sf_dir, "documents"))


def op5_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeindex.llm.topk import top_k

    vectors = load(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where("vec_id % 50 = 0"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeindex.llm.quality import quality_rules

    return quality_rules(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeindex.llm.mixing import mix_sources, word_count

    docs = load(spark, sf_dir, "documents").select("doc_id", "source", word_count(F.col("text")).alias("size"))
    return mix_sources(docs, size=F.col("size"), keep=["doc_id"]).select("doc.doc_id", "size", "source_size", "target", "taken", "copies")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeindex.llm.toxicity import score_documents

    return score_documents(load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeindex.llm.token_counts import section_tokens

    return section_tokens(load(spark, sf_dir, "documents"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lakeindex.llm.warc import archived_pages, read_warc, write_pages

    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_pages(load(spark, sf_dir, "pages"), path)
    archive = read_warc(spark, path, payload=False, verify=True)
    return archived_pages(archive.where(F.col("record_type").isin("response", "revisit")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op1_ngram_jaccard_join": OP1}


OP1 = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i+3], ' '))) END AS s FROM words),
members AS MATERIALIZED (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
links AS MATERIALIZED (
  SELECT a.doc_id AS u, b.doc_id AS v FROM members a JOIN members b ON a.g = b.g AND a.doc_id <> b.doc_id
    AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id AS u, doc_id AS v FROM sets UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u)
SELECT s.doc_id, len(s.s)::BIGINT AS n_shingles, r.c AS component_id, coalesce(l.k, 0)::BIGINT AS n_links
FROM sets s JOIN (SELECT u, min(v) AS c FROM reach GROUP BY u) r ON r.u = s.doc_id
LEFT JOIN (SELECT u, count(*) AS k FROM links GROUP BY u) l ON l.u = s.doc_id
"""
