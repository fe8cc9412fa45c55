"""Admission of sources: manifests, catalogues, acquisition, and mixtures of sources.

A manifest or a catalogue is a small JSON file; it is read with Spark and checked before anything
else is read, and whatever is wrong with it stops the job. Rows of sources are DataFrames.

Edge cases. A file that isn't there, an empty manifest, a broken rule or a source that occurs twice
raise ValueError. Null flags are false. Rows without a source are counted as missing, rows of an
unknown source as unknown. A budget of 0 keeps nothing. Ties of order go by the row's hash.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedimark.functions import text as tx
from sedimark.operators import contracts, records, training
from sedimark.sources import records as files

# Fixed values.
TRAIN_GROUPS = ["train_pairs_processed_unions", "train_pairs_raw_sources"]
EVAL_GROUP = "eval_only_NEVER_TRAIN"
CLEAN = ["scanned_clean", "clean"]
REQUIRED_DOMAINS = ["faq_real", "admin_real", "legal_adjacency_real_no_eval_overlap"]
SOURCE = (
    "source_id string, display_name string, domain string, source_type string, license string, license_url string, license_verified boolean, "
    "allowed_for_training boolean, eval_only boolean, public_benchmark boolean, contains_eval_overlap_risk boolean, supplemental boolean, "
    "loader struct<kind:string,path_or_id:string,path:string>"
)
CATALOGUE_ENTRY = "id string, path string, domain string, leakage string, training_usable boolean"


# ------------------------------------------------------------------ manifests
def _whole(spark: SparkSession, path: str, schema: str) -> DataFrame:
    if not files._exists(spark, path):
        raise ValueError(f"not found: {path}")
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def load_manifest(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """The sources of a manifest, or ValueError naming what is wrong. strict: the rules for
    acquired sources."""
    rows = _whole(spark, path, f"sources array<struct<{_typed(SOURCE)}>>").select(F.inline("sources"))
    rules = contracts.acquired_source_rules() if strict else contracts.source_rules()
    wrong = [f"{r.source_id}: {e}" for r in records.checked(rows, rules).filter(F.size("errors") > 0).collect() for e in r.errors]
    wrong += [f"duplicate source_id: {r.source_id}" for r in contracts.repeated(rows, "source_id").collect()]
    if rows.isEmpty():
        wrong.append("no sources")
    if wrong:
        raise ValueError("invalid manifest: " + "; ".join(sorted(wrong)))
    return rows


def _typed(schema: str) -> str:
    """Fields of a DDL text as those of a struct."""
    return ",".join(f"{n}:{t}" for n, t in (p.strip().split(" ", 1) for p in schema.split(", ")))


def training_sources(sources: DataFrame) -> DataFrame:
    return sources.filter(F.coalesce("allowed_for_training", F.lit(False)))


def block_reason(mode: str) -> Column:
    """Why a source isn't read in a mode (dry-run, materialize-local, download-hf); null: it is."""
    flag = lambda c: F.coalesce(c, F.lit(False))
    local = F.col("source_type").isin("local_jsonl", "local_corpus_jsonl")
    blocked = ~flag("allowed_for_training")
    return (
        F.when(blocked & ~flag("license_verified"), "blocked: license not verified (allowed_for_training=false)")
        .when(blocked & flag("public_benchmark"), "blocked: public_benchmark (eval-only, never train)")
        .when(blocked & flag("eval_only"), "blocked: eval_only")
        .when(blocked, "blocked: allowed_for_training=false")
        .when(local, F.lit(None if mode in ("materialize-local", "dry-run") else f"skipped in mode={mode}").cast("string"))
        .when(F.col("source_type") == "hf_dataset", F.lit(None if mode == "download-hf" else f"hf_dataset not downloaded in mode={mode}").cast("string"))
        .when(F.col("source_type") == "url_manifest", "url_manifest: metadata only (no scraping)")
        .otherwise(F.concat(F.lit("unhandled source_type "), F.coalesce("source_type", F.lit("null"))))
    )


def acquire(sources: DataFrame, tables: dict[str, DataFrame], mode: str = "materialize-local") -> tuple[DataFrame, DataFrame]:
    """Rows of all sources that may be read, with source_id and license filled in from the
    manifest; and a row per source: source_id, domain, reason (null: read), rows, invalid,
    supplemental. tables: source_id -> rows; a source without a table isn't there."""
    plan = sources.withColumn("reason", block_reason(mode))
    there = F.col("source_id").isin(*tables) if tables else F.lit(False)
    plan = plan.withColumn("reason", F.coalesce("reason", F.when(~there, F.lit("local data not present"))))
    parts = []
    for s in plan.filter("reason is null").select("source_id", "license", "domain").collect():  # a row per source
        t = tables[s.source_id]
        fill = lambda c, v, t=t: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit(v)) if c in t.columns else F.lit(v)
        own = records.checked(t, contracts.local_row_rules(t)).withColumn("valid", F.size("errors") == 0).drop("errors")
        parts.append(own.withColumns({"source_id": fill("source_id", s.source_id), "license": fill("license", s.license), "_of": F.lit(s.source_id), "_domain": F.lit(s.domain)}))
    if not parts or mode == "dry-run":
        counts = plan.sparkSession.createDataFrame([], "source_id string, rows bigint, invalid bigint")
        rows = plan.select("source_id", "license").limit(0)
    else:
        every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        counts = every.groupBy(F.col("_of").alias("source_id")).agg(F.count_if("valid").alias("rows"), F.count_if(~F.col("valid")).alias("invalid"))
        rows = every.filter("valid").drop("valid", "_of").withColumnRenamed("_domain", "source_domain")
    report = plan.join(counts, "source_id", "left").select(
        "source_id", "domain", "reason", F.when(F.col("reason").isNull(), F.coalesce("rows", F.lit(0))).alias("rows"),
        F.coalesce("invalid", F.lit(0)).alias("invalid"), F.coalesce("supplemental", F.lit(False)).alias("supplemental"),
    )
    return rows, report


def coverage(report: DataFrame) -> DataFrame:
    """domain, sources: how many sources, supplemental ones aside, each required domain has."""
    need = report.sparkSession.createDataFrame([(d,) for d in REQUIRED_DOMAINS], "domain string")
    have = report.filter("reason is null and not supplemental").groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
    return need.join(have, "domain", "left").select("domain", F.coalesce("n", F.lit(0)).alias("sources"))


def with_provenance(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows with license, license_origin, allowed_for_training, license_url and
    inherited_from_source_id of the manifest, which is broadcast as it has a row per source. An
    inherited licence is replaced by the row's own if that is concrete."""
    s = sources.select(
        F.col("source_id").alias("_s"), F.col("license").alias("_license"), F.coalesce("allowed_for_training", F.lit(False)).alias("allowed_for_training"), F.col("license_url").alias("_url")
    )
    has = lambda c: F.nullif(F.trim(F.col(c)), F.lit("")) if c in rows.columns else F.lit(None).cast("string")
    own = has("license")
    concrete = F.when(~F.lower(own).contains("inherit"), own)
    origin = tx.license_origin(F.col("_license"))
    inherited = origin == "inherited"
    keep = [c for c in rows.columns if c not in ("license", "license_url", "inherited_from_source_id", "license_origin", "allowed_for_training")]
    return rows.join(F.broadcast(s), F.col("source_id") == F.col("_s")).select(
        *keep, F.when(inherited, F.coalesce(concrete, "_license")).otherwise(F.col("_license")).alias("license"), origin.alias("license_origin"), "allowed_for_training",
        F.coalesce(has("license_url"), "_url").alias("license_url"), F.when(inherited, has("inherited_from_source_id")).alias("inherited_from_source_id"),
    )


def backfilled(cache: DataFrame, candidates: DataFrame, columns: list[str]) -> DataFrame:
    """cache with nulls of the columns filled from the candidate of the same pair_hash (its least
    value where several differ)."""
    known = candidates.groupBy("pair_hash").agg(*(F.min(c).alias(f"_{c}") for c in columns))
    j = cache.join(known, "pair_hash", "left")
    return j.select(*(F.coalesce(c, f"_{c}").alias(c) if c in columns else F.col(c) for c in cache.columns))


def admitted(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """rows with reason: missing_source_id, unknown_source, disallowed_source, empty_text; null:
    admitted."""
    s = sources.select(F.col("source_id").alias("_s"), F.coalesce("allowed_for_training", F.lit(False)).alias("_ok"))
    blank = records.blank
    reason = (
        F.when(blank("source_id"), "missing_source_id").when(F.col("_s").isNull(), "unknown_source")
        .when(~F.col("_ok"), "disallowed_source").when(blank("query") | blank("document"), "empty_text")
    )
    return rows.join(F.broadcast(s), F.col("source_id") == F.col("_s"), "left").withColumn("reason", reason).drop("_s", "_ok")


def build_candidates(rows: DataFrame, sources: DataFrame, evals: DataFrame, targets: dict[str, int], pii: bool = True) -> DataFrame:
    """The whole way: admitted, canonical, without repeats, without personal data, without evaluation
    texts, sampled to targets by domain."""
    ok = admitted(rows, sources).filter("reason is null").drop("reason")
    c = with_provenance(ok, sources)
    q, d = tx.nfc_collapsed(F.col("query")), tx.nfc_collapsed(F.col("document"))
    c = c.withColumns({"query": q, "document": d}).withColumn("pair_hash", tx.raw_pair(F.col("query"), F.col("document")))
    c = records.first_by(c, [F.col("pair_hash")], ["source_id", "document"])
    if pii:
        c = c.filter((F.size(tx.pii(F.col("query"))) == 0) & (F.size(tx.pii(F.col("document"))) == 0))
    from sedimark.operators import leakage

    c = leakage.without(c, evals, "query", "document")
    return records.sample_to_targets(c, "domain", targets, "pair_hash")


# ------------------------------------------------------------------ catalogue and mixtures
def load_catalogue(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Trainable sources (id, path, domain, leakage, training_usable; of two with one id the later
    group's counts) and ids that are for evaluation only."""
    groups = ", ".join(f"{g} array<struct<{_typed(CATALOGUE_ENTRY)}>>" for g in (*TRAIN_GROUPS, EVAL_GROUP))
    c = _whole(spark, path, groups)
    parts = [c.select(F.lit(i).alias("_g"), F.inline(F.coalesce(g, F.array().cast(c.schema[g].dataType)))) for i, g in enumerate(TRAIN_GROUPS)]
    every = reduce(DataFrame.unionByName, parts).filter("coalesce(id, '') <> ''")
    columns = [n for n in every.columns if n not in ("_g", "id")]
    trainable = every.groupBy("id").agg(F.max_by(F.struct(*columns), "_g").alias("x")).select("id", "x.*")
    return trainable, c.select(F.inline(EVAL_GROUP)).filter("coalesce(id, '') <> ''").select("id").distinct()


def check_mixture(weights: dict[str, float], total: int, trainable: DataFrame, eval_only: DataFrame) -> DataFrame:
    """source, ord, weight (of one), budget, path, domain, leakage; or ValueError naming a source: a
    weight that isn't positive, an evaluation source, an unknown or unusable one, or one that
    wasn't scanned clean."""
    if not isinstance(total, int) or isinstance(total, bool) or total <= 0:
        raise ValueError(f"total rows must be a positive integer, not {total!r}")
    if not weights:
        raise ValueError("a mixture has sources")
    for s, w in weights.items():
        if isinstance(w, bool) or not isinstance(w, (int, float)) or w <= 0:
            raise ValueError(f"source {s!r}: weight must be a number above 0, not {w!r}")
    spark = trainable.sparkSession
    whole = float(sum(weights.values()))
    asked = spark.createDataFrame([(s, i, w / whole) for i, (s, w) in enumerate(weights.items())], "source string, ord int, weight double")
    rows = asked.join(trainable, F.col("source") == F.col("id"), "left").join(eval_only.select(F.col("id").alias("_e")), F.col("source") == F.col("_e"), "left")
    wrong = (
        F.when(F.col("_e").isNotNull(), "is for evaluation only").when(F.col("id").isNull(), "is unknown")
        .when(~F.coalesce("training_usable", F.lit(False)), "is not usable for training").when(~F.coalesce(F.col("leakage").isin(*CLEAN), F.lit(False)), "was not scanned clean")
    )
    bad = rows.withColumn("wrong", wrong).filter("wrong is not null").orderBy("ord").first()
    if bad:
        raise ValueError(f"source {bad.source!r} {bad.wrong}")
    budgets = records.largest_remainder(asked, "source", "weight", total)
    return rows.join(budgets, "source").select("source", "ord", "weight", "budget", "path", "domain", "leakage")


def pairs_of(rows: DataFrame) -> DataFrame:
    """query, document, domain of a pairs file: the document may be under `positive`; a query that
    is empty or a document under five characters goes."""
    has = lambda c: F.col(c) if c in rows.columns else F.lit(None).cast("string")
    out = rows.select(F.trim(has("query")).alias("query"), F.trim(F.coalesce(has("positive"), has("document"))).alias("document"), F.nullif(has("domain"), F.lit("")).alias("domain"))
    return out.filter((F.col("query") != "") & (F.length("document") >= 5))


def mixture(rows: DataFrame, plan: DataFrame, order: str, faq_cap: float | None = 0.30) -> DataFrame:
    """Rows (source, query, document, domain, and an order within the source) of a mixture: every
    n-th of a source up to its budget, then equal and then normalised repeats dropped, the first
    source in the mixture winning, then FAQ rows capped and domains in turn (None: not, as in a
    dry run). Rows that are dropped aren't made up for."""
    n = rows.groupBy("source").agg(F.count(F.lit(1)).alias("_n"))
    p = plan.select("source", "ord", "budget", F.col("domain").alias("_domain")).join(n, "source")
    ranged = files.with_shards(rows, ["source", order], 1).withColumnRenamed("shard", "_at")
    first = Window.orderBy("source").rowsBetween(Window.unboundedPreceding, -1)
    starts = n.withColumn("_start", F.coalesce(F.sum("_n").over(first), F.lit(0))).select("source", "_start")  # a row per source
    x = ranged.join(F.broadcast(starts), "source").join(F.broadcast(p), "source")
    at, stride = F.col("_at") - F.col("_start"), F.greatest(F.lit(1), F.floor(F.col("_n") / F.greatest("budget", F.lit(1))))
    x = x.withColumn("_i", at).filter((F.pmod("_i", stride) == 0) & (F.col("_i") / stride < F.col("budget")))
    for key in ([F.col("query"), F.col("document")], [tx.collapsed(F.col("query")), tx.collapsed(F.col("document"))]):
        x = records.first_by(x, key, ["ord", "_i"])
    x = x.withColumn("domain", F.coalesce("domain", "_domain", "source")).withColumn("length_bucket", tx.length_bucket(F.col("document")))
    x = x.select("source", "query", "document", "domain", "length_bucket", F.concat_ws("|", F.lpad(F.col("ord").cast("string"), 6, "0"), F.lpad(F.col("_i").cast("string"), 15, "0")).alias("place"))
    return x if faq_cap is None else training.interleaved(x, "place", faq_cap)


def mixture_report(mixed: DataFrame) -> DataFrame:
    """key (source, domain, length_bucket), value, n, share."""
    n = mixed.select(F.inline(F.array(*(F.struct(F.lit(k).alias("key"), F.col(k).alias("value")) for k in ("source", "domain", "length_bucket"))))).groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("key")), 4))
