"""Teacher caches: rows, acceptance, filters, calibration and reports.

A cache row is (query_id, doc_id, query, document, positive, embedding_score, reranker_score,
source, domain, license, ...); a field that is null may be in the map `metadata`.

Edge cases. A null flag counts as positive for acceptance, but filter_cache asks for a flag that
is true. A missing score is never accepted. Repeated rows each count, but for `latest`. Empty
input: empty reports. Other columns are kept by filters and ignored by reports.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimark.functions import nested as ns
from sedimark.functions import text as tx
from sedimark.operators import aggregates, gates

# Fixed values.
REAL_DOMAINS = ["faq_real", "admin_real", "legal_adjacency_real_no_eval_overlap"]
THRESHOLDS = {"embedder": 2.0, "reranker": 4.0, "suspicious": 0.5}
PROVENANCE = ["source_id", "license", "license_origin", "license_url", "allowed_for_training", "inherited_from_source_id", "pair_hash", "synthetic"]


def cache_rows(candidates: DataFrame, embedding_model: str | None = None, reranker_model: str | None = None, created_at: Column | None = None) -> DataFrame:
    """Candidates as cache rows; scores stay as they are or are null; what is known of their origin
    is carried along."""
    has = lambda c, kind: (F.col(c) if c in candidates.columns else F.lit(None)).cast(kind).alias(c)
    text = [has(c, "string") for c in ("query_id", "doc_id", "query", "document")]
    return candidates.select(
        *text, has("label", "double"), has("positive", "boolean"), F.lit(embedding_model).cast("string").alias("embedding_teacher_model"), has("embedding_score", "double"),
        F.lit(reranker_model).cast("string").alias("reranker_teacher_model"), has("reranker_score", "double"),
        (created_at if created_at is not None else F.current_timestamp().cast("string")).alias("created_at"), has("source", "string"), has("domain", "string"),
        *(F.col(c) for c in PROVENANCE if c in candidates.columns),
    )


def preview(candidates: DataFrame, n: int = 3, **models) -> DataFrame:
    """The first n rows by key with null scores: a dry run."""
    first = candidates.orderBy("query_id", "doc_id").limit(n)
    return cache_rows(first.drop("embedding_score", "reranker_score"), **models, created_at=F.lit("<dry-run>"))


def latest(cache: DataFrame, order: str) -> DataFrame:
    """One row per (query_id, doc_id), the last by order: scores that were written again replace
    the ones before."""
    cols = [c for c in cache.columns if c not in ("query_id", "doc_id")]
    return cache.groupBy("query_id", "doc_id").agg(F.max_by(F.struct(*cols), F.col(order)).alias("_x")).select("query_id", "doc_id", "_x.*")


def score() -> Column:
    return F.coalesce("reranker_score", "embedding_score")


def is_positive() -> Column:
    return F.coalesce("positive", F.lit(True))


def threshold(domain: Column, base: float, per_domain: dict[str, float] | None = None) -> Column:
    if not per_domain:
        return F.lit(base)
    table = F.create_map(*(F.lit(x) for kv in per_domain.items() for x in kv))
    return F.coalesce(F.try_element_at(table, domain), F.lit(base))


def accepted(df: DataFrame, base: float, per_domain: dict[str, float] | None = None) -> Column:
    domain = tx.unknown(ns.field(df, "domain"))
    return is_positive() & F.coalesce(score() >= threshold(domain, base, per_domain), F.lit(False))


def filter_positives(df: DataFrame, base: float, per_domain: dict[str, float] | None = None) -> DataFrame:
    return df.filter(accepted(df, base, per_domain))


def filter_cache(df: DataFrame, least: float) -> DataFrame:
    """df with filtering_reason and review: positives scored below `least` are for review."""
    flagged, s = F.coalesce("positive", F.lit(False)), F.col("reranker_score")
    low = flagged & s.isNotNull() & (s < least)
    reason = F.when(flagged & s.isNull(), "kept_positive_no_reranker_score").when(low, f"positive_below_reranker_threshold_{least}")
    return df.withColumns({"filtering_reason": reason, "review": low})


def doubtful_positives(df: DataFrame, below: float, n: int = 10) -> DataFrame:
    """The n positives with the lowest scores below a threshold."""
    return df.filter(is_positive() & (score() < below)).withColumn("score", score()).orderBy("score", "query_id", "doc_id").limit(n)


def rejected_high(df: DataFrame, least: float, n: int = 10) -> DataFrame:
    """The n others with the highest scores from a threshold on: likely mislabelled."""
    return df.filter(~is_positive() & (score() >= least)).withColumn("score", score()).orderBy(F.desc("score"), "query_id", "doc_id").limit(n)


def calibration(df: DataFrame, embedder: float = 2.0, reranker: float = 4.0, per_domain: dict[str, float] | None = None) -> DataFrame:
    """domain (null: all), positives, embedder_accepted, reranker_accepted, suspicious, its rate,
    medians of the reranker's score among both, rows of unknown licence. One pass."""
    domain = tx.unknown(ns.field(df, "domain"))
    rows = df.select(
        domain.alias("domain"), is_positive().alias("p"), score().alias("s"), "reranker_score", accepted(df, embedder, per_domain).alias("e"),
        accepted(df, reranker).alias("r"), tx.is_unknown_license(ns.field(df, "license")).alias("u"),
        threshold(domain, embedder, per_domain).alias("t"),
    )
    low = F.col("p") & F.coalesce(F.col("s") < F.col("t"), F.lit(False))
    median = lambda flag: F.round(F.median(F.when(F.col(flag), F.col("reranker_score"))), 4)
    return rows.rollup("domain").agg(
        F.count_if("p").alias("positives"), F.count_if("e").alias("embedder_accepted"), F.count_if("r").alias("reranker_accepted"),
        F.count_if(low).alias("suspicious"), F.round(F.coalesce(F.try_divide(F.count_if(low), F.count_if("p")), F.lit(0.0)), 4).alias("suspicious_rate"),
        median("e").alias("embedder_median"), median("r").alias("reranker_median"), F.count_if("u").alias("unknown_license"),
    )


def calibration_gate(report: DataFrame, floors: dict[str, int] | None = None, most_suspicious: float = 0.5) -> DataFrame:
    """check, passed over calibration."""
    floors = floors or {}
    every = F.col("domain").isNull()
    value = lambda c, at=every: F.max(F.when(at, F.col(c)))
    checks = {"license_unknown_rows_zero": F.col("u") == 0, "suspicious_positive_rate": F.col("s") <= most_suspicious}
    aggs = [value("unknown_license").alias("u"), value("suspicious_rate").alias("s")]
    for i, d in enumerate(REAL_DOMAINS):
        aggs.append(F.coalesce(value("embedder_accepted", F.col("domain") == d), F.lit(0)).alias(f"a{i}"))
        checks[f"real_domain_min_accepted:{d}"] = F.col(f"a{i}") >= floors.get(d, 0)
    return gates.checks(report.agg(*aggs), checks)


def summary(df: DataFrame) -> DataFrame:
    """One row: rows, positives, unknown_license, disallowed, inherited, missing scores, repeated
    pairs."""
    pair = F.nullif(ns.field(df, "pair_hash"), F.lit(""))
    return df.agg(
        F.count(F.lit(1)).alias("rows"), F.count_if(F.coalesce("positive", F.lit(False))).alias("positives"),
        F.count_if(tx.is_unknown_license(ns.field(df, "license"))).alias("unknown_license"),
        F.count_if(ns.field(df, "allowed_for_training", "boolean") == F.lit(False)).alias("disallowed"),
        F.count_if(ns.field(df, "license_origin") == "inherited").alias("inherited"),
        F.count_if(F.col("embedding_score").isNull()).alias("missing_embedding_score"), F.count_if(F.col("reranker_score").isNull()).alias("missing_reranker_score"),
        (F.count(pair) - F.count_distinct(pair)).alias("repeated_pairs"),
    )


def counts(df: DataFrame, *keys: str) -> DataFrame:
    """key, value, n by each key alone, a null from metadata."""
    return aggregates.counts_by(df.select(*(ns.field(df, k).alias(k) for k in keys)), *keys)


def effective_margin(positive: Column, method: str, margin: float, ratio: float | None = None) -> Column:
    """The margin of a veto: fixed, or at least what the ratio asks for."""
    if method == "margin" or ratio is None:
        return F.lit(margin)
    return F.greatest(F.lit(margin), F.coalesce(positive * (1 - ratio), F.lit(margin)))


def domain_gate(quality: DataFrame, floors: dict[str, int], synthetic: float = 0.25, web: float = 0.65, acceptance: float = 0.35) -> DataFrame:
    """check, passed over aggregates.domain_quality: floors of real domains, their synthetic share
    and acceptance, and the share of web and wiki among all accepted."""
    total = F.sum("accepted")
    aggs, checks = [F.coalesce(F.try_divide(F.sum(F.when(F.col("domain").isin("web", "wiki_non_eval"), F.col("accepted"))), total), F.lit(0.0)).alias("web")], {}
    for i, d in enumerate(REAL_DOMAINS):
        own = lambda c: F.coalesce(F.max(F.when(F.col("domain") == d, F.col(c))), F.lit(0))  # noqa: B023, E731
        aggs += [own("raw").alias(f"raw{i}"), own("accepted").alias(f"acc{i}"), own("synthetic_share").alias(f"syn{i}"), own("acceptance_rate").alias(f"rate{i}")]
        floor = floors.get(d, 0)
        checks |= {
            f"real_domain_min_raw:{d}": F.col(f"raw{i}") >= floor,
            f"real_domain_min_accepted:{d}": F.col(f"acc{i}") >= floor,
            f"real_domain_synthetic_share:{d}": F.col(f"syn{i}") <= synthetic,
            f"real_domain_acceptance_rate:{d}": F.col(f"rate{i}") >= acceptance,
        }
    return gates.checks(quality.agg(*aggs), checks | {"effective_web_wiki_share": F.col("web") <= web})


def by_hardness(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n highest-scored others of each key: hard negatives of a cache."""
    w = Window.partitionBy(key).orderBy(F.desc_nulls_last(score()), "doc_id")
    return df.filter(~F.coalesce("positive", F.lit(False))).withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= n)
