"""BM25 in two variants and the hashing encoder.

The corpus is tokenised once. Only the terms that some query asks for leave a row, so what moves
grows with the hits, not with the corpus; statistics are a single row. Queries with more terms
than can be sent along go through postings and a join.

Edge cases. Null and empty texts have no term and count as documents of length 0. Repeated rows
are documents each; ties go by doc_id. Empty corpus or queries: empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedimark.functions import text as tx
from sedimark.functions.vectors import unit
from sedimark.sources.scratch import written

K1, B = 1.5, 0.75
MOST_ASKED = 20_000  # terms of all queries, up to which they are sent along with the scan


def postings(corpus: DataFrame, tokenize=tx.tokens_de) -> tuple[DataFrame, DataFrame]:
    """(postings (term, doc_id, tf), docs (doc_id, len)) of the whole corpus."""
    docs = written(corpus.select("doc_id", tokenize(F.coalesce("text", F.lit(""))).alias("toks")))
    each = docs.select("doc_id", F.explode("toks").alias("term"))
    return each.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf")), docs.select("doc_id", F.size("toks").alias("len"))


def _asked(queries: DataFrame, tokenize, distinct_terms: bool) -> DataFrame:
    asked = queries.select("query_id", F.explode(tokenize(F.coalesce("query", F.lit("")))).alias("term"))
    return asked.groupBy("query_id", "term").agg((F.lit(1) if distinct_terms else F.count(F.lit(1))).alias("weight"))


def _scored(asked: DataFrame, found: DataFrame, stats: DataFrame) -> DataFrame:
    """found: (term, doc_id, tf, len) of the asked terms; stats: one row (n, avgdl)."""
    df = found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("avgdl")))
    return (
        asked.join(df, "term")
        .join(found, "term")
        .crossJoin(F.broadcast(stats))  # one row
        .groupBy("query_id", "doc_id")
        .agg(F.round(F.sum(part * F.col("weight")), 6).alias("score"))
    )


def _stats(docs: DataFrame) -> DataFrame:
    mean = F.coalesce(F.sum("len") / F.sum("docs"), F.lit(0.0))
    return docs.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("n"), F.when(mean == 0, 1.0).otherwise(mean).alias("avgdl"))


def scores(corpus: DataFrame, queries: DataFrame, tokenize=tx.tokens_de, distinct_terms=True) -> DataFrame:
    """query_id, doc_id, score of every document with a term of the query (query_id, query). The
    corpus is tokenised once: one table has, of each document that is hit, the counts of the asked
    terms and its length, and of each task the sums for the statistics."""
    asked = written(_asked(queries, tokenize, distinct_terms))
    terms = asked.select("term").distinct().toArrow().column("term").to_pylist() if asked.count() <= MOST_ASKED else None
    toks = tokenize(F.coalesce("text", F.lit("")))
    if terms is None:
        found, docs = postings(corpus, tokenize)
        hits = found.join(asked.select("term").distinct(), "term", "left_semi").join(docs, "doc_id")
        return _scored(asked, written(hits), _stats(docs.select("len", F.lit(1).alias("docs"))))
    # The asked terms are few: a document's row keeps these only.
    rows = corpus.select("doc_id", toks.alias("toks"))
    own = F.filter("toks", lambda t: t.isin(*terms)) if terms else F.array().cast("array<string>")
    every = written(rows.select("doc_id", F.size("toks").alias("len"), F.lit(1).alias("docs"), own.alias("hits")))
    hits = every.select("doc_id", "len", F.explode("hits").alias("term")).groupBy("term", "doc_id", "len").agg(F.count(F.lit(1)).alias("tf"))
    return _scored(asked, hits, _stats(every))


def save_index(corpus: DataFrame, path: str, tokenize=tx.tokens_de) -> None:
    """postings, docs and stats as tables; search_index needs no text again."""
    found, docs = postings(corpus, tokenize)
    found.repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{path}/postings")
    docs.write.mode("overwrite").parquet(f"{path}/docs")
    _stats(docs.select("len", F.lit(1).alias("docs"))).write.mode("overwrite").parquet(f"{path}/stats")


def search_index(path: str, queries: DataFrame, k: int = 10, tokenize=tx.tokens_de) -> DataFrame:
    """search with a saved index: postings are sorted by term, so a scan reads the asked ones."""
    found, docs, stats = (queries.sparkSession.read.parquet(f"{path}/{t}") for t in ("postings", "docs", "stats"))
    asked = _asked(queries, tokenize, True)
    hits = found.join(asked.select("term").distinct(), "term", "left_semi").join(docs, "doc_id")
    return best(_scored(asked, hits, stats), k)


def best(scored: DataFrame, k: int, tie: str = "doc_id") -> DataFrame:
    """The k rows of each query by score, then the smaller tie column; rank from 1."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(tie))
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search(corpus: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Index variant: distinct query terms, matching documents only, ties by doc_id."""
    return best(scores(corpus, queries), k)


def harness_rank(corpus: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """Harness variant: repeated query terms count again, documents without a hit rank behind,
    ties in input order (doc_id). Fillers come from the 2k first documents: a query with fewer
    than k hits leaves k of them at least."""
    scored = scores(corpus, queries, tx.tokens, distinct_terms=False)
    first = corpus.select("doc_id").orderBy("doc_id").limit(2 * k)
    fill = (
        queries.select("query_id")
        .crossJoin(F.broadcast(first))  # 2k rows
        .join(scored, ["query_id", "doc_id"], "left_anti")
        .withColumn("score", F.lit(0.0))
    )
    return best(best(scored, k).drop("rank").unionByName(fill), k)


def hashing_vectors(texts: DataFrame, dims: int = 256) -> DataFrame:
    """doc_id, vector: signed hashed character trigrams of the folded text, unit length. dims is
    a power of two up to 2 ** 16."""
    x = tx.fold(F.coalesce("text", F.lit("")))
    n = F.greatest(F.length(x) - 2, F.lit(1))
    grams = F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(x, i, F.lit(3)))
    h = F.conv(F.substring(F.md5("gram"), 25, 8), 16, 10).cast("bigint")
    dim = h.bitwiseAND(F.lit(dims - 1))
    sign = F.when(F.pmod((h / dims).cast("bigint"), F.lit(2)) == 0, 1).otherwise(-1)
    cells = (
        texts.select("doc_id", F.explode(grams).alias("gram"))
        .groupBy("doc_id", dim.alias("dim"))
        .agg(F.sum(sign).cast("double").alias("v"))
    )
    sparse = cells.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("dim", "v"))).alias("m"))
    dense = F.transform(
        F.sequence(F.lit(0).cast("bigint"), F.lit(dims - 1).cast("bigint")),
        lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0.0)),
    )
    return sparse.select("doc_id", unit(dense).alias("vector"))
