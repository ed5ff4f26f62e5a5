"""A training corpus from documents: toxic ones go, near copies go, personal data is masked, sources are mixed, texts are encoded."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeindex.llm.bpe import encode_documents
from lakeindex.llm.common import load, remove, shared_dir
from lakeindex.llm.mixing import mix_sources, repeat_documents
from lakeindex.llm.ngram_jaccard import keep_first
from lakeindex.llm.pii import redact
from lakeindex.llm.toxicity import keep_clean


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold. Null and empty texts score by the bias alone, and stay; copies score alike."""
    return keep_clean(docs, load(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, a similarity of 0.8. Texts without words and rows without an id stay."""
    return keep_first(docs, words=5, similarity=(80, 100))


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data replaced by marks; n_chars follows. Null texts stay null."""
    return redact(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it. Rows without words go by their source's rate; a null source is one."""
    return repeat_documents(mix_sources(docs))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document; null and empty texts have none."""
    return encode_documents(docs, lean=True)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("pii", pii), ("mixing", mixing), ("encoding", encoding)]

#: Scores of the toxicity stage come from a trained model, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; each one's rows are written as Parquet and read again, and go once the next one's are there.

    An empty table gives an empty result; rows that repeat an id and further columns are kept as the stages say.
    """
    folder, docs = f"{shared_dir(spark)}/pipeline-{uuid4().hex}", load(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                remove(spark, f"{folder}/{k - 1}")
    return docs
