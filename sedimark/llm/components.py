"""Connected components of a link table by alternating large-star and small-star rounds.

Each round is two groupings and two joins over the links; minima are pre-aggregated before the
shuffle, and the joins are plain equi-joins that Spark splits where a centre has many links. The
links of each round are written to the shared folder, which cuts the lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedimark.llm.common import written


def _state(links: DataFrame):
    return links.agg(
        F.count(F.lit(1)), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))
    ).first()


def components(links: DataFrame) -> DataFrame:
    """node, root: for each node of links (a, b) the smallest node that can be reached. Nodes
    without a link, and links of a node to itself, don't appear. Nulls are not links."""
    links = written(
        links.filter("a is not null and b is not null and a <> b")
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        .distinct()
    )
    before = None
    while (now := tuple(_state(links))) != before:
        before = now
        if not now[0]:
            break
        # Large star: every larger neighbour of a node is tied to the smallest one it can see.
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(
            "a", F.least("a", "m").alias("m")
        )
        large = (
            links.select(F.col("a").alias("v"), F.col("b").alias("u"))
            .join(least.withColumnRenamed("a", "u"), "u")
            .select(F.col("v").alias("a"), F.col("m").alias("b"))
            .filter("a <> b")
            .distinct()
        )
        # Small star: the smaller neighbours of a node, and the node, are tied to the smallest.
        smallest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(smallest, "a")
            .filter("b <> m")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(smallest.select("a", F.col("m").alias("b")))
            .distinct()
        )
        links = written(small)
    return links.select(F.col("a").alias("node"), F.col("b").alias("root"))
