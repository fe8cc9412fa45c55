"""Reports over teacher caches and sources: a single pass with GROUPING SETS wherever several
groupings are asked for.

Edge cases. Null and empty keys are 'unknown'. Null scores aren't counted but as missing. Empty
input: empty reports, or a row of zeros where a report is one row. Repeated rows count each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimark.functions.text import unknown

# Fixed values.
THRESHOLDS = (-2.0, 0.0, 1.0, 2.0, 3.0, 4.0, 5.0)


def counts_by(df: DataFrame, *keys: str) -> DataFrame:
    """key, value, n for each key column alone; null and empty are 'unknown'."""
    named = [F.struct(F.lit(k).alias("key"), unknown(F.col(k).cast("string")).alias("value")) for k in keys]
    return df.select(F.inline(F.array(*named))).groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"))


def distribution(df: DataFrame, score: str, *by: str) -> DataFrame:
    """n, missing, min, median (interpolated), mean, max of a score, 4 decimals."""
    r = lambda c: F.round(c, 4)
    return df.groupBy(*by).agg(
        F.count(score).alias("n"),
        F.count_if(F.col(score).isNull()).alias("missing"),
        r(F.min(score)).alias("min"),
        r(F.median(score)).alias("median"),
        r(F.avg(score)).alias("mean"),
        r(F.max(score)).alias("max"),
    )


def threshold_sweep(df: DataFrame, score: str, keys: tuple[str, ...], thresholds=THRESHOLDS) -> DataFrame:
    """key, value, threshold, accepted, rate: over all rows and by each key, in one pass."""
    counted = [F.count_if(F.col(score) >= t).alias(f"t{i}") for i, t in enumerate(thresholds)]
    sets = [[], *([F.col(k)] for k in keys)]
    grouped = df.groupingSets(sets, *map(F.col, keys)).agg(
        *(F.grouping(k).alias(f"g_{k}") for k in keys), F.count(score).alias("n"), *counted
    )
    key, value = F.lit("all"), F.lit("all")
    for k in keys:
        key = F.when(F.col(f"g_{k}") == 0, k).otherwise(key)
        value = F.when(F.col(f"g_{k}") == 0, unknown(F.col(k).cast("string"))).otherwise(value)
    each = F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"t{i}").alias("accepted")) for i, t in enumerate(thresholds)))
    rows = grouped.select(key.alias("key"), value.alias("value"), "n", F.inline(each))
    return rows.select("key", "value", "threshold", "accepted", F.round(F.col("accepted") / F.greatest("n", F.lit(1)), 6).alias("rate"))


def quota(df: DataFrame, group: str, real: Column, targets: dict[str, int]) -> DataFrame:
    """group, total, real, synthetic, target, met: only real rows count towards a target."""
    goal = F.create_map(*(F.lit(x) for kv in targets.items() for x in kv))
    rows = df.groupBy(unknown(F.col(group)).alias(group)).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(real).alias("real")
    )
    return rows.select(
        group, "total", "real", (F.col("total") - F.col("real")).alias("synthetic"),
        F.try_element_at(goal, F.col(group)).alias("target"),
        (F.col("real") >= F.coalesce(F.try_element_at(goal, F.col(group)), F.lit(0))).alias("met"),
    )


def domain_quality(candidates: DataFrame, cache: DataFrame, domain: str, accepted: Column, synthetic: Column) -> DataFrame:
    """Per domain of either input: raw, cached, accepted, acceptance_rate (of candidates, or of
    cached rows where there are no candidates), synthetic_share."""
    d = unknown(F.col(domain)).alias("domain")
    raw = candidates.groupBy(d).agg(F.count(F.lit(1)).alias("raw"))
    own = cache.groupBy(d).agg(
        F.count(F.lit(1)).alias("cached"), F.count_if(accepted).alias("accepted"), F.count_if(accepted & synthetic).alias("synth")
    )
    j = raw.join(own, "domain", "full_outer").na.fill(0)
    base = F.when(F.col("raw") > 0, F.col("raw")).otherwise(F.col("cached"))
    return j.select(
        "domain", "raw", "cached", "accepted",
        F.round(F.when(base > 0, F.col("accepted") / base).otherwise(0.0), 6).alias("acceptance_rate"),
        F.round(F.when(F.col("accepted") > 0, F.col("synth") / F.col("accepted")).otherwise(0.0), 6).alias("synthetic_share"),
    )


def histogram(df: DataFrame, value: str, edges: list[float]) -> DataFrame:
    """bucket, n over [edge, next edge), the last one open; values below the first are left out."""
    label = None
    for lo, hi in zip(edges, [*edges[1:], None]):
        inside = (F.col(value) >= lo) & ((F.col(value) < hi) if hi is not None else F.lit(True))
        name = f"[{lo:g},{hi:g})" if hi is not None else f">={lo:g}"
        label = F.when(inside, name) if label is None else label.when(inside, name)
    return df.select(label.alias("bucket")).filter("bucket is not null").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))


def upper_median(df: DataFrame, value: str, *by: str) -> DataFrame:
    """The element at n // 2 of the sorted values of each group (an interpolating median would
    differ), from counts by value: no group is gathered."""
    from sedimark.operators.training import upper_medians

    return upper_medians(df, value, list(by))


def missing_report(df: DataFrame, fields: list[str]) -> DataFrame:
    """field, missing (null or blank), with a last row 'any' for rows that miss one."""
    blank = {f: F.trim(F.coalesce(F.col(f).cast("string"), F.lit(""))) == "" for f in fields}
    some = F.lit(False)
    for b in blank.values():
        some = some | b
    one = df.agg(*(F.count_if(b).alias(f"m{i}") for i, b in enumerate([*blank.values(), some])))
    each = [F.struct(F.lit(f).alias("field"), F.col(f"m{i}").alias("missing")) for i, f in enumerate([*fields, "any"])]
    return one.select(F.inline(F.array(*each)))


def mix_report(df: DataFrame, domain: str, faq: str, order: str) -> DataFrame:
    """domain, n, share, faq_share (of all rows), examples: three of each domain in order."""
    w = Window.partitionBy(domain).orderBy(order)
    first = df.withColumn("_nth", F.row_number().over(w)).filter("_nth <= 3").groupBy(domain).agg(F.array_sort(F.collect_list(F.struct("_nth", order))).alias("x"))
    n = df.groupBy(domain).agg(F.count(F.lit(1)).alias("n"))
    total = Window.partitionBy()
    out = n.join(first, domain).withColumn("all", F.sum("n").over(total))
    faqs = F.sum(F.when(F.col(domain) == faq, F.col("n")).otherwise(0)).over(total)
    return out.select(
        domain, "n", F.round(F.col("n") / F.col("all"), 4).alias("share"), F.round(faqs / F.col("all"), 4).alias("faq_share"), F.transform("x", lambda e: e[order]).alias("examples")
    )
