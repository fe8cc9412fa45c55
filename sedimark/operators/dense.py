"""Exact dense search of a stated query set against all rows, in blocks.

A block of queries is a matrix of at most `block` rows that every task multiplies with its
batches; a task hands on the k best of a batch for each query, and a window takes the k best of
these. More queries mean more passes, never a larger broadcast.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _matrix(column, dim: int | None) -> np.ndarray:
    rows = [np.asarray(v if v is not None else [], np.float64) for v in column.to_pylist()]
    width = dim or max((len(r) for r in rows), default=0)
    if any(len(r) < width for r in rows if len(r)):
        raise ValueError(f"vector shorter than {width}")
    m = np.stack([r[:width] if len(r) else np.zeros(width) for r in rows]) if rows else np.zeros((0, width))
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n >= 1e-12)


def top_k(
    queries: DataFrame, corpus: DataFrame, k: int = 10, dim: int | None = None, skip_self: bool = True, block: int = 16_384
) -> DataFrame:
    """query_id, doc_id, score (cosine of the first dim components, 6 decimals), rank, for
    queries (query_id, vector) and corpus (doc_id, vector); ties by doc_id."""
    spark = corpus.sparkSession
    passes = max(1, -(-queries.count() // block))
    parts = []
    for p in range(passes):
        own = queries.select("query_id", "vector")
        if passes > 1:
            own = own.filter(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == p)
        table = own.toArrow()  # about `block` rows
        shared = spark.sparkContext.broadcast(
            (table.column("query_id").to_numpy(), _matrix(table.column("vector"), dim))
        )

        def run(batches, shared=shared):
            ids, q = shared.value
            for batch in batches:
                if not batch.num_rows or not len(ids):
                    continue
                docs = batch.column(0).to_numpy()
                d = _matrix(batch.column(1), dim or q.shape[1])
                out = []
                for i in range(0, len(ids), 1024):
                    s = np.round(q[i : i + 1024] @ d.T, 6)
                    if skip_self:
                        s[ids[i : i + 1024, None] == docs[None, :]] = -np.inf
                    order = np.lexsort((np.broadcast_to(docs, s.shape), -s), axis=1)[:, :k]
                    rows = np.repeat(np.arange(len(s)), order.shape[1])
                    at = order.ravel()
                    keep = np.isfinite(s[rows, at])
                    out.append((ids[i + rows[keep]], docs[at[keep]], s[rows[keep], at[keep]]))
                columns = [pa.array(np.concatenate(c)) for c in zip(*out)]
                yield pa.RecordBatch.from_arrays(columns, ["query_id", "doc_id", "score"])

        parts.append(
            corpus.select("doc_id", "vector").mapInArrow(
                run, "query_id bigint, doc_id bigint, score double"
            )
        )
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def storage(dims: DataFrame) -> DataFrame:
    """dim, bytes of a vector at 32 and at 16 bits."""
    return dims.select("dim", (F.col("dim") * 4).alias("fp32"), (F.col("dim") * 2).alias("fp16"))
