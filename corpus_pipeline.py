"""The corpus pipeline: documents in, packed token sequences out.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again for the next one. All but the last return the columns of documents.

1. quality: importance weights of hashed n-grams; documents whose weight, or whose n-grams that
   good text avoids, are too low go.
2. language: prediction by partial matching; documents without a letter or whose language is
   uncertain go, a missing lang is filled in.
3. near_duplicates: SimHash candidates and an exact prefix filter, checked on five-word shingles
   at a similarity of 0.8; one document of each group stays.
4. mixing: documents are drawn by probabilities raked to source, language and topic weights.
5. packing: token ids end to end, cut every 2048.

SQL can't express the models, so there is no ORACLE_SQL; tests hold the stages against brute
force on small tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimark.llm import language, mixing, near, packing, quality
from sedimark.llm.common import table, written


def docs_where(docs: DataFrame, f) -> DataFrame:
    """f of docs with their columns named apart from those that f adds, whatever these are called;
    then the columns of docs again."""
    used = ("doc_id", "text", "lang", "source")
    apart = {c: c if c in used else f"_{i}_{c}" for i, c in enumerate(docs.columns)}
    found = f(docs.select(*(F.col(f"`{c}`").alias(n) for c, n in apart.items())))
    return found.select(*(F.col(f"`{n}`").alias(c) for c, n in apart.items()))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null and empty texts go. Repeated rows are judged alike. Without labels all others stay."""
    ratios, thresholds = quality.fit(docs, table(spark, sf_dir, "labels"))
    return docs_where(docs, lambda d: quality.weighed(d, ratios).filter(quality.accepted(thresholds)))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null texts and texts without a letter go; a null lang is filled in, others stay as they are."""
    trees = language.fit(docs)

    def sure(d: DataFrame) -> DataFrame:
        found = language.identify(d, trees).filter("lang_pred <> 'und' and score >= 0.5")
        return found.withColumn("lang", F.coalesce("lang", "lang_pred"))

    return docs_where(docs, sure)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that with the smallest doc_id. Documents
    without an id are not compared and stay; of two different texts under one id both are compared;
    repeated rows are one document."""
    return near.first_of_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null sources and languages are values of their own. Equal ids are drawn alike."""
    return docs_where(docs, lambda d: mixing.mix(d, share=0.8).filter("mix_sampled"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Null texts count as empty. A row per piece of a document."""
    return packing.pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = written(docs)
    return docs
