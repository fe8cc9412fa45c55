"""Merging of vectors of the same key from several parents (key, parent, vector).

Edge cases. Null entries count as nothing in means. Keys that not all parents have are merged from
those that do. Parents of one length each; base has every key. Empty input: empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedimark.functions import vectors as vx


def _long(parents: DataFrame) -> DataFrame:
    return parents.select("key", "parent", F.posexplode("vector").alias("pos", "v")).withColumn("v", F.col("v").cast("double"))


def _nested(cells: DataFrame) -> DataFrame:
    return cells.groupBy("key").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda x: x["v"]).alias("vector")
    )


def mean(parents: DataFrame, weights: dict | None = None) -> DataFrame:
    """key, vector: the mean, weighted by parent if weights are given (normalized)."""
    cells = _long(parents)
    if weights is None:
        return _nested(cells.groupBy("key", "pos").agg(F.avg("v").alias("v")))
    total = sum(weights.values())
    w = F.create_map(*(F.lit(x) for k, v in weights.items() for x in (k, v / total)))
    return _nested(cells.groupBy("key", "pos").agg(F.sum(F.col("v") * w[F.col("parent")]).alias("v")))


def task_vectors(parents: DataFrame, base: DataFrame, scale: float = 1.0) -> DataFrame:
    """base plus the scaled sum of the parents' differences from it."""
    b = base.select("key", F.posexplode("vector").alias("pos", "b"))
    cells = _long(parents).join(b, ["key", "pos"]).groupBy("key", "pos").agg(
        (F.first("b") + scale * F.sum(F.col("v") - F.col("b"))).alias("v")
    )
    return _nested(cells)


def ties(parents: DataFrame, base: DataFrame, density: float = 0.5) -> DataFrame:
    """Differences trimmed to the largest share of each parent's entries, a sign elected for each
    place, and the mean of what agrees with it added to base."""
    b = base.select("key", F.posexplode("vector").alias("pos", "b"))
    d = _long(parents).join(b, ["key", "pos"]).withColumn("d", F.col("v") - F.col("b"))
    order = Window.partitionBy("key", "parent").orderBy(F.desc(F.abs("d")), "pos")
    n = F.count(F.lit(1)).over(Window.partitionBy("key", "parent"))
    d = d.withColumns({"nth": F.row_number().over(order), "most": F.greatest(F.lit(1), F.bround(n * density, 0))})
    d = d.withColumn("d", F.when(F.col("nth") <= F.col("most"), F.col("d")).otherwise(0.0))
    d = d.withColumn("sign", F.signum(F.sum("d").over(Window.partitionBy("key", "pos"))))
    agrees = (F.signum("d") == F.col("sign")) & (F.col("sign") != 0)
    cells = d.groupBy("key", "pos").agg(
        (F.first("b") + F.coalesce(F.avg(F.when(agrees, F.col("d"))), F.lit(0.0))).alias("v")
    )
    return _nested(cells)


_GOLDEN, _MIX1, _MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def _wide(n: int):
    return F.lit(Decimal(n)).cast("decimal(38,0)")


def _let(x, f):
    """f of a value that is computed once, however often f names it."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _low64(x, by: int):
    """x * by modulo 2 ** 64 of bigints, by 16-bit parts of x, whose products with 32-bit halves of
    `by` don't overflow a bigint."""
    low, high = by & 0xFFFFFFFF, by >> 32
    mask = F.lit(0xFFFF).cast("bigint")
    keep = lambda v, bits: v.bitwiseAND(F.lit((1 << bits) - 1).cast("bigint"))

    def parts(v):
        out = F.lit(0).cast("bigint")
        for i in range(4):
            part = F.shiftrightunsigned(v, 16 * i).bitwiseAND(mask)
            # part * low has 48 bits; of each product only what stays below 2 ** 64 is shifted.
            a = F.shiftleft(keep(part * F.lit(low).cast("bigint"), 64 - 16 * i) if 64 - 16 * i < 63 else part * F.lit(low).cast("bigint"), 16 * i)
            out = _added(out, a)
            if 16 * i + 32 < 64:
                out = _added(out, F.shiftleft(keep(part * F.lit(high).cast("bigint"), 32 - 16 * i), 16 * i + 32))
        return out

    return _let(x, parts)


def _added(a, b):
    """a + b modulo 2 ** 64: halves are added apart, as a sum that overflows is an error."""

    def halves(v):
        low = v["a"].bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint")) + v["b"].bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))
        high = F.shiftrightunsigned(v["a"], 32) + F.shiftrightunsigned(v["b"], 32) + F.shiftrightunsigned(low, 32)
        return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint")))

    return _let(F.struct(a.alias("a"), b.alias("b")), halves)


def seeded(seed, key, pos):
    """A number in [0, 1) for each place: the mixed 64-bit sum of seed times a constant, the place
    from 1 and the first 32 bits of the key's SHA-256. seed, key and pos are Columns."""
    key_hash = F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("bigint")
    h = _added(_low64(seed.cast("bigint"), _GOLDEN), (pos + 1).cast("bigint") + key_hash)
    for shift, by in ((30, _MIX1), (27, _MIX2)):
        h = _low64(_folded(h, shift), by)
    return F.shiftrightunsigned(_folded(h, 31), 11) / float(1 << 53)


def _folded(h, by: int):
    return _let(h, lambda v: v.bitwiseXOR(F.shiftrightunsigned(v, by)))


def dare(parents: DataFrame, base: DataFrame, density: float, weights: dict, seed: int = 0, rescale: bool = True) -> DataFrame:
    """Differences kept where the seeded number of parent, key and place is below density, then
    rescaled, weighted (normalized) and added to base. Parents are numbered in order."""
    if not 0 < density <= 1:
        raise ValueError("density must be above 0 and at most 1")
    total = float(sum(weights.values()))
    table = [(p, i, float(w) / total) for i, (p, w) in enumerate(weights.items())]
    nth = F.create_map(*(F.lit(x) for p, i, _ in table for x in (p, seed + i * 0x1000193)))
    w = F.create_map(*(F.lit(x) for p, _, v in table for x in (p, v)))
    b = base.select("key", F.posexplode("vector").alias("pos", "b"))
    delta = (F.col("v") - F.col("b")) * (1.0 / density if rescale else 1.0)
    kept = F.when(seeded(nth[F.col("parent")], F.col("key"), F.col("pos")) < density, delta).otherwise(0.0)
    cells = _long(parents).join(b, ["key", "pos"]).groupBy("key", "pos").agg((F.first("b") + F.sum(kept * w[F.col("parent")])).alias("v"))
    return _nested(cells)


def layerwise(parents: DataFrame, weights: DataFrame) -> DataFrame:
    """The mean with weights of each key's own (key, parent, weight; normalized by key); keys
    without any have equal ones."""
    total = Window.partitionBy("key")
    w = weights.select("key", "parent", (F.col("weight") / F.sum("weight").over(total)).alias("w"))
    has = w.select("key").distinct().withColumn("_has", F.lit(True))
    cells = _long(parents).join(w, ["key", "parent"], "left").join(has, "key", "left")
    n = F.count(F.lit(1)).over(Window.partitionBy("key", "pos"))
    own = F.when(F.col("_has"), F.coalesce("w", F.lit(0.0))).otherwise(1.0 / n)
    return _nested(cells.withColumn("_w", own).groupBy("key", "pos").agg(F.sum(F.col("v") * F.col("_w")).alias("v")))


def pairwise(parents: DataFrame, t: float, method: str = "slerp") -> DataFrame:
    """key, vector between exactly two parents of each key, the smaller one first, along the arc
    (slerp) or straight (lerp)."""
    two = parents.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("parent", "vector"))).alias("p"))
    wrong = F.raise_error(F.lit("two parents are needed")).cast("array<double>")
    a, b = (F.transform(F.get("p", F.lit(i))["vector"], lambda x: x.cast("double")) for i in (0, 1))
    between = {"slerp": vx.slerp, "lerp": vx.lerp}
    if method not in between:
        raise ValueError(f"unknown method: {method}")
    return two.select("key", F.when(F.size("p") != 2, wrong).otherwise(between[method](a, b, t)).alias("vector"))


def merge(method: str, parents: DataFrame, base: DataFrame | None = None, **params) -> DataFrame:
    """By name: mean, weighted_mean, slerp, lerp, task_vectors, ties, dare, layerwise."""
    match method:
        case "mean" | "weighted_mean":
            return mean(parents, **params)
        case "slerp" | "lerp":
            return pairwise(parents, method=method, **params)
        case "task_vectors":
            return task_vectors(parents, base, **params)
        case "ties":
            return ties(parents, base, **params)
        case "dare":
            return dare(parents, base, **params)
        case "layerwise":
            return layerwise(parents, **params)
    raise ValueError(f"unknown method: {method}")
