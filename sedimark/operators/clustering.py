"""Centroids and k-means with a fixed start. Centroids are k vectors, whatever the data."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _sums(points: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """Sum and count of the points nearest to each centroid, added up on the way."""
    shared = points.sparkSession.sparkContext.broadcast(centroids)

    def run(batches):
        c = shared.value
        total = np.zeros((len(c), c.shape[1] + 1))
        for batch in batches:
            x = np.array(batch.column(0).to_pylist(), np.float64)
            if not len(x):
                continue
            at = ((x[:, None, :] - c[None]) ** 2).sum(2).argmin(1)
            np.add.at(total, at, np.hstack([x, np.ones((len(x), 1))]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.arange(len(c))), pa.array(list(total), pa.list_(pa.float64()))], ["c", "s"]
        )

    parts = points.select("vector").mapInArrow(run, "c bigint, s array<double>")
    width = centroids.shape[1] + 1
    sums = parts.groupBy("c").agg(*(F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(width)))
    out = np.zeros((len(centroids), width))
    for r in sums.collect():  # k rows
        out[r[0]] = r[1:]
    return out


def kmeans(points: DataFrame, k: int, rounds: int = 15) -> DataFrame:
    """id, cluster: Lloyd's rounds from the first k points by id; the lowest cluster wins ties."""
    start = points.orderBy("id").limit(k).select("vector").collect()
    c = np.array([r[0] for r in start], np.float64)
    for _ in range(rounds):
        s = _sums(points, c)
        n = s[:, -1:]
        new = np.where(n > 0, s[:, :-1] / np.maximum(n, 1), c)
        if np.allclose(new, c):
            break
        c = new
    far = [F.aggregate(F.zip_with("vector", F.array(*map(F.lit, row.tolist())), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x) for row in c]
    return points.select("id", (F.array_position(F.array(*far), F.array_min(F.array(*far))) - 1).cast("int").alias("cluster"))


def nearest_centroid(train: DataFrame, test: DataFrame) -> DataFrame:
    """id, label, predicted: the label whose mean vector has the largest cosine, the first label in
    a tie. A row per label and test point; there are few labels."""
    from sedimark.functions.vectors import cosine

    cells = train.select("label", F.posexplode("vector").alias("pos", "v")).groupBy("label", "pos").agg(F.avg("v").alias("v"))
    cents = cells.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("c"))
    scored = test.crossJoin(F.broadcast(cents.withColumnRenamed("label", "predicted")))
    order = Window.partitionBy("id").orderBy(F.desc(F.round(cosine(F.col("vector"), F.col("c")), 9)), "predicted")
    return scored.withColumn("nth", F.row_number().over(order)).filter("nth = 1").select("id", "label", "predicted")
