"""Inference hooks: a model is a function that is loaded once a Python worker and called with
batches. What the engine has no model for, the caller brings; the plan around it is the same.

A loader is a picklable function without arguments that returns a callable: texts -> vectors for
encoders, (queries, documents) -> scores for scorers. Batches are bounded in rows, and texts in
the model's own length, which is the model's matter.

Edge cases. Null texts are given as empty ones. Empty input: the loader isn't called. Repeated
rows are scored each; `score_missing` leaves out what a cache has. Ties by doc_id.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimark.functions import text as tx
from sedimark.functions import vectors as vx

Encoder = Callable[[list[str]], np.ndarray]
Scorer = Callable[[list[str], list[str]], list[float]]


def _batches(n: int, size: int) -> Iterator[slice]:
    return (slice(i, i + size) for i in range(0, n, size))


def encode(text: Column, load: Callable[[], Encoder], template: str | None = None, name: str = "document", batch: int = 64) -> Column:
    """A column array<float>: the model's vector of each text, put into a template if one is given."""

    @F.pandas_udf("array<float>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = None
        for s in parts:
            model = model or load()
            texts = s.fillna("").tolist()
            rows = [np.asarray(model(texts[b]), np.float32) for b in _batches(len(texts), batch)]
            yield pd.Series([v for r in rows for v in r])

    filled = tx.filled(F.lit(template), name, F.coalesce(text, F.lit(""))) if template else F.coalesce(text, F.lit(""))
    return run(filled)


def score(query: Column, document: Column, load: Callable[[], Scorer], batch: int = 64) -> Column:
    """A column double: the model's score of each pair."""

    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = None
        for q, d in parts:
            model = model or load()
            qs, ds = q.fillna("").tolist(), d.fillna("").tolist()
            yield pd.Series([float(x) for b in _batches(len(qs), batch) for x in model(qs[b], ds[b])], dtype="float64")

    return run(F.coalesce(query, F.lit("")), F.coalesce(document, F.lit("")))


def embedding_scores(pairs: DataFrame, load: Callable[[], Encoder], query_template: str | None = None, document_template: str | None = None) -> DataFrame:
    """pairs (query, document, ...) with embedding_score: the cosine of both vectors."""
    rows = pairs.withColumns({"_q": encode(F.col("query"), load, query_template, "query"), "_d": encode(F.col("document"), load, document_template)})
    return rows.withColumn("embedding_score", F.round(vx.cosine(F.col("_q"), F.col("_d")), 6)).drop("_q", "_d")


def reranker_scores(pairs: DataFrame, load: Callable[[], Scorer]) -> DataFrame:
    return pairs.withColumn("reranker_score", score(F.col("query"), F.col("document"), load))


def score_missing(candidates: DataFrame, cache: DataFrame, load: Callable[[], Scorer]) -> DataFrame:
    """Candidates that the cache doesn't have yet, scored: what a resumed run appends."""
    done = cache.select("query_id", "doc_id").distinct()
    return reranker_scores(candidates.join(done, ["query_id", "doc_id"], "left_anti"), load)


def score_lists(lists: DataFrame, load: Callable[[], Scorer]) -> DataFrame:
    """lists (query_id, query, candidates: array of structs with document) with teacher_score in each
    candidate, in the same order. Lists that are scored throughout already are left as they are."""
    c = lists.schema["candidates"].dataType.elementType
    old = F.forall("candidates", lambda x: x["teacher_score"].isNotNull()) if "teacher_score" in c.names else F.lit(False)
    rows = lists.withColumn("_done", old).select("*", F.posexplode_outer("candidates").alias("_p", "_c"))
    new = score(F.col("query"), F.col("_c")["document"], load)
    kept = F.col("_c")["teacher_score"].cast("double") if "teacher_score" in c.names else F.lit(None).cast("double")
    rows = rows.withColumn("_s", new).withColumn("_c", F.col("_c").withField("teacher_score", F.when(F.col("_done"), kept).otherwise(F.col("_s"))))
    others = [x for x in lists.columns if x not in ("candidates", "query_id")]
    grouped = rows.groupBy("query_id").agg(
        *(F.first(x).alias(x) for x in others), F.array_sort(F.collect_list(F.when(F.col("_p").isNotNull(), F.struct("_p", "_c")))).alias("x")
    )
    return grouped.withColumn("candidates", F.transform("x", lambda x: x["_c"])).drop("x").select(*lists.columns)


def rerank(pairs: DataFrame, load: Callable[[], Scorer]) -> DataFrame:
    """query_id, doc_id, score, rank of pairs (query_id, query, doc_id, document)."""
    rows = pairs.select("query_id", "doc_id", score(F.col("query"), F.col("document"), load).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return rows.withColumn("rank", F.row_number().over(order))
