"""Gates: checks over reported metrics, fail-closed, and the score of a run.

A gate reads reports of evaluation sets as rows and returns check, passed, needed, value: a check
whose value is missing fails, unless it is only asked `if_there`. `verdict` sums checks up. Reports
are a row per evaluation set, so everything here works on a handful of rows.

Edge cases. No reports: the checks that must be there fail. Null metrics fail. Repeated sets: the
lower of two values counts where a floor is asked for, the higher where a ceiling is.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimark.functions import nested as ns

SLACK = 1e-9


@dataclass(frozen=True)
class Rule:
    """A metric of an evaluation set against a bound. sense: >=, <= or >. against: another metric
    of the set in place of a number. if_there: no check where the set, or (optional) the metric,
    isn't there."""

    name: str
    set: str
    metric: str
    sense: str
    bound: float | None = None
    against: str | None = None
    if_there: bool = False
    optional: bool = False


# The gates' bounds.
DENSE_RECALL = [
    Rule("webfaq_recall_at_100", "webfaq", "recall_at_100", ">=", 0.95),
    Rule("webfaq_positive_in_top_50", "webfaq", "positive_in_top_50", ">=", 0.90),
    Rule("webfaq_oracle_ndcg_at_10", "webfaq", "oracle_ndcg_at_10", ">=", 0.95),
    Rule("candidate_union_size", "webfaq", "candidate_union_size", ">=", 20, optional=True),
    Rule("missing_positive_rate", "webfaq", "missing_positive_rate", "<=", 0.10, optional=True),
    Rule("local_rag_recall_at_100", "local_rag", "recall_at_100", ">=", 0.90, if_there=True, optional=True),
]
ABSENT_POSITIVES = ["webfaq_recall_at_100", "missing_positive_rate", "webfaq_oracle_ndcg_at_10", "local_rag_recall_at_100"]
DENSE = [
    Rule("webfaq_recall_at_50", "webfaq", "recall@50", ">=", 0.90),
    Rule("webfaq_recall_at_100", "webfaq", "recall@100", ">=", 0.96),
    Rule("webfaq_missing_positive_rate", "webfaq", "missing_positive_rate", "<=", 0.04),
    Rule("webfaq_ndcg_at_10", "webfaq", "ndcg@10", ">=", 0.67),
    Rule("germanquad_ndcg_at_10", "germanquad", "ndcg@10", ">=", 0.88),
    Rule("dt_test_ndcg_at_10", "dt_test", "ndcg@10", ">=", 0.94),
    Rule("matryoshka_256_retention", "webfaq", "matryoshka_256_retention", ">=", 0.95),
]
RAW_RERANKER = [
    Rule("webfaq_delta", "webfaq", "delta", ">=", 0.03),
    Rule("webfaq_positive_present", "webfaq", "positive_present_rate", ">=", 0.8),
    Rule("local_rag_delta", "local_rag", "delta", ">=", 0.03, if_there=True),
    Rule("local_rag_positive_present", "local_rag", "positive_present_rate", ">=", 0.8, if_there=True),
    Rule("germanquad_delta", "germanquad", "delta", ">=", -0.005, if_there=True),
    Rule("germanquad_catastrophic", "germanquad", "catastrophic_rate", "<=", 0.03, if_there=True),
    Rule("dt_test_delta", "dt_test", "delta", ">=", -0.005, if_there=True),
    Rule("dt_test_catastrophic", "dt_test", "catastrophic_rate", "<=", 0.02, if_there=True),
]
BOUNDED_POLICY = [
    Rule("webfaq_overall", "webfaq", "delta", ">=", 0.05, if_there=True),
    Rule("webfaq_medium_hard_positive", "webfaq", "medium_hard_delta", ">", 0.0, if_there=True),
    Rule("germanquad_overall", "germanquad", "delta", ">=", -0.005, if_there=True),
    Rule("germanquad_catastrophic", "germanquad", "catastrophic_rate", "<=", 0.03, if_there=True),
    Rule("germanquad_beats_raw_always_rerank", "germanquad", "delta", ">=", against="raw_delta", if_there=True),
    Rule("dt_test_overall", "dt_test", "delta", ">=", -0.005, if_there=True),
    Rule("dt_test_catastrophic", "dt_test", "catastrophic_rate", "<=", 0.02, if_there=True),
]
ABSTAIN_POLICY = [
    *(r for r in BOUNDED_POLICY if r.name != "webfaq_medium_hard_positive"),
    Rule("webfaq_medium_hard", "webfaq", "medium_hard_delta", ">=", 0.20, if_there=True),
    Rule("dt_test_beats_always_rerank", "dt_test", "delta", ">=", against="raw_delta", if_there=True),
]
SERVED_POLICY = [
    Rule("webfaq_policy_delta", "webfaq", "delta", ">=", 0.05, if_there=True),
    Rule("near_ceiling_catastrophic", "near_ceiling", "catastrophic_rate", "<=", 0.03, if_there=True),
    Rule("near_ceiling_policy_delta", "near_ceiling", "delta", ">=", -0.005, if_there=True),
    Rule("near_ceiling_beats_raw_rerank", "near_ceiling", "delta", ">=", against="raw_delta", if_there=True),
    Rule("germanquad_catastrophic", "germanquad", "catastrophic_rate", "<=", 0.03, if_there=True),
    Rule("germanquad_policy_delta", "germanquad", "delta", ">=", -0.005, if_there=True),
    Rule("germanquad_beats_raw_rerank", "germanquad", "delta", ">=", against="raw_delta", if_there=True),
    Rule("dt_test_catastrophic", "dt_test", "catastrophic_rate", "<=", 0.02, if_there=True),
    Rule("dt_test_policy_delta", "dt_test", "delta", ">=", -0.005, if_there=True),
]
PROMOTION = [
    Rule("webfaq_delta", "webfaq", "delta", ">=", 0.03),
    Rule("webfaq_first_stage_recall", "webfaq", "first_stage_recall", ">=", 0.5),
    Rule("local_rag_delta", "local_rag", "delta", ">=", 0.03, if_there=True),
    Rule("local_rag_first_stage_recall", "local_rag", "first_stage_recall", ">=", 0.5, if_there=True),
    Rule("germanquad_neutral_or_better", "germanquad", "delta", ">=", 0.0, if_there=True),
    Rule("dt_test_neutral_or_better", "dt_test", "delta", ">=", 0.0, if_there=True),
]
NO_DEGRADATION = [
    Rule("dt_test_delta_nonneg", "dt_test", "delta", ">=", 0.0),
    Rule("germanquad_delta_nonneg", "germanquad", "delta", ">=", 0.0),
    Rule("dt_test_not_catastrophic", "dt_test", "delta", ">=", -0.02),
    Rule("germanquad_not_catastrophic", "germanquad", "delta", ">=", -0.02),
]
DIAGNOSTIC_SETS = ["gerdalir", "legal"]
HARDNESS = {"lift": 0.0, "no_room": -0.005, "guardrail": 0.0, "catastrophic": 0.05}
SCORE_WEIGHTS = {"webfaq_recall@100": 2.0, "webfaq_ndcg@10": 1.5, "local_rag_recall@100": 1.0, "webfaq_mrr@10": 0.5}
SCORE_BOUNDS = {"germanquad_ndcg@10": -0.005, "dt_test_ndcg@10": -0.005, "retention": 0.95, "leakage_hits": 0}
BAD_LEAKAGE = ["not_checked", "unparseable", "unreadable", "missing_report", "leak_detected", "unknown"]


def checks(metrics: DataFrame, named: dict[str, Column]) -> DataFrame:
    """check, passed over a one-row table; a null fails."""
    each = F.array(*(F.struct(F.lit(n).alias("check"), F.coalesce(c, F.lit(False)).alias("passed")) for n, c in named.items()))
    return metrics.select(F.inline(each))


def _passed(value: Column, sense: str, bound: Column) -> Column:
    return {">=": value >= bound - SLACK, "<=": value <= bound + SLACK, ">": value > bound}[sense]


def judge(reports: DataFrame, rules: list[Rule]) -> DataFrame:
    """check, passed, value, needed of rules over reports (eval_set, metrics: map<string,double>)."""
    aggs = []
    for i, r in enumerate(rules):
        own, pick = F.col("eval_set") == r.set, (F.max if r.sense == "<=" else F.min)
        aggs += [F.count_if(own).alias(f"n{i}"), pick(F.when(own, F.try_element_at("metrics", F.lit(r.metric)))).alias(f"v{i}")]
        other = F.max(F.when(own, F.try_element_at("metrics", F.lit(r.against)))) if r.against else F.max(F.lit(r.bound).cast("double"))
        aggs.append(other.alias(f"b{i}"))
    each = []
    for i, r in enumerate(rules):
        value, bound = F.col(f"v{i}"), F.col(f"b{i}")
        asked = F.lit(True)
        if r.if_there:
            asked = asked & (F.col(f"n{i}") > 0)
        if r.optional:
            asked = asked & value.isNotNull()
        ok = F.coalesce(_passed(value, r.sense, bound), F.lit(False))
        each.append(F.when(asked, F.struct(F.lit(r.name).alias("check"), ok.alias("passed"), value.alias("value"), F.concat(F.lit(f"{r.sense} "), F.coalesce(bound.cast("string"), F.lit("?"))).alias("needed"))))
    return reports.agg(*aggs).select(F.inline(F.array_compact(F.array(*each))))


def flags(spark, named: dict[str, bool | None]) -> DataFrame:
    """Checks that the caller has decided; None fails. To be united with others."""
    return spark.createDataFrame([(n, bool(v), None, "true") for n, v in named.items()], "check string, passed boolean, value double, needed string")


def verdict(judged: DataFrame) -> DataFrame:
    """One row: status, checks, failing (sorted). No check at all fails."""
    return judged.agg(
        F.when((F.count(F.lit(1)) > 0) & F.bool_and("passed"), "pass").otherwise("fail").alias("status"),
        F.count(F.lit(1)).alias("checks"), F.array_sort(F.collect_set(F.when(~F.col("passed"), F.col("check")))).alias("failing"),
    )


def dense_recall(reports: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Checks, and one row: status, positives_absent, stop: whether a reranker can't help."""
    judged = judge(reports, DENSE_RECALL)
    return judged, verdict(judged).select(
        "status", F.arrays_overlap("failing", F.array(*map(F.lit, ABSENT_POSITIVES))).alias("positives_absent"), (F.col("status") == "fail").alias("stop")
    )


def raw_reranker(reports: DataFrame, leakage: bool = False) -> DataFrame:
    """Checks; reports (with ranking_mode) of anything but the raw order are rejected."""
    other = F.lower(F.coalesce("ranking_mode", F.lit(""))) != "raw"
    policy = reports.filter(other & ~F.col("eval_set").isin(*DIAGNOSTIC_SETS)).select(
        F.concat(F.lit("raw_only:"), "eval_set").alias("check"), F.lit(False).alias("passed"), F.lit(None).cast("double").alias("value"), F.lit("raw").alias("needed")
    )
    return judge(reports, RAW_RERANKER).unionByName(policy).unionByName(flags(reports.sparkSession, {"no_public_eval_leakage": not leakage}))


def promotion(reports: DataFrame) -> DataFrame:
    """Checks of a reranker's lift; sets that aren't diagnostic must not drop and must have fixed
    candidates."""
    own = reports.filter(~F.col("eval_set").isin(*DIAGNOSTIC_SETS))
    delta = F.try_element_at("metrics", F.lit("delta"))
    row = lambda name, ok: F.struct(F.concat("eval_set", F.lit(name)).alias("check"), F.coalesce(ok, F.lit(False)).alias("passed"), delta.alias("value"), F.lit(name).alias("needed"))
    every = own.select(F.inline(F.array(row("_not_catastrophic", delta >= -0.02), row("_fixed_candidates", F.col("fixed_candidates")))))
    return judge(reports, PROMOTION).unionByName(every)


def hardness(sets: DataFrame, b: dict = HARDNESS) -> DataFrame:
    """Checks over sets (eval_set, role, primary_n, micro, macro, delta, mostly_no_room,
    catastrophic_rate): primary sets must gain on medium and hard lists, others must not lose."""
    primary = F.col("role") == "primary"
    floor = F.when(F.col("mostly_no_room"), b["no_room"]).otherwise(b["guardrail"])
    gains = (F.col("primary_n") > 0) & (F.col("micro") > b["lift"]) & (F.col("macro") > b["lift"])
    holds = F.when(primary, gains).otherwise(F.col("delta") >= floor - SLACK)
    name = F.concat("eval_set", F.when(primary, "_primary_lift").otherwise("_guardrail_do_not_regress"))
    row = lambda n, ok, v: F.struct(n.alias("check"), F.coalesce(ok, F.lit(False)).alias("passed"), v.cast("double").alias("value"), F.lit("").alias("needed"))
    rows = sets.select(
        F.inline(
            F.array(
                row(F.concat("eval_set", F.lit("_catastrophic_rate")), F.col("catastrophic_rate") <= b["catastrophic"] + SLACK, F.col("catastrophic_rate")),
                row(name, holds, F.when(primary, F.col("micro")).otherwise(F.col("delta"))),
            )
        )
    )
    some = sets.agg(F.coalesce(F.bool_or(primary), F.lit(False)).alias("p")).filter("not p")
    return rows.unionByName(some.select(F.lit("has_primary_eval_set").alias("check"), F.lit(False).alias("passed"), F.lit(None).cast("double").alias("value"), F.lit("").alias("needed")))


def set_report(per_query: DataFrame) -> DataFrame:
    """What `hardness` reads, of lists.hardness rows with eval_set and role."""
    medium = F.col("bucket").isin("medium", "hard")
    by_bucket = per_query.filter(medium).groupBy("eval_set", "bucket").agg(F.avg("delta").alias("d"))
    macro = by_bucket.groupBy("eval_set").agg(F.round(F.avg("d"), 6).alias("macro"))
    share = lambda c: F.avg(c.cast("int"))
    rows = per_query.groupBy("eval_set", "role").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(medium).alias("primary_n"), F.round(F.avg(F.when(medium, F.col("delta"))), 6).alias("micro"),
        F.round(F.avg("delta"), 6).alias("delta"), (share(F.col("bucket") == "no_room") >= 0.5).alias("mostly_no_room"),
        F.round(share(F.col("bucket") == "no_room"), 6).alias("no_room_share"), F.round(share(F.col("delta") <= -0.2), 6).alias("catastrophic_rate"),
    )
    return rows.join(macro, "eval_set", "left")


def filter_basis(rows: DataFrame, slack: float = 0.005) -> DataFrame:
    """Checks over a sweep (eval_set, method, dim, role, ndcg10, recall100, full_ndcg10, ...) as made
    by `sweep_deltas`: half size within slack of the full, quarter size at least the prefix, no
    guardrail set below."""
    own = (F.col("method") == "embedfilter") & (F.col("role") == "active")
    mean = lambda c, dim: F.round(F.avg(F.when(own & (F.col("dim") == dim), F.col(c))), 4)
    guard = own & F.col("eval_set").isin("germanquad", "dt_test") & F.col("dim").isin(256, 512)
    one = rows.agg(
        mean("ndcg_vs_full", 512).alias("n512"), mean("recall_vs_full", 512).alias("r512"), mean("ndcg_vs_prefix", 256).alias("n256"),
        mean("recall_vs_prefix", 256).alias("r256"), F.coalesce(F.min(F.when(guard, F.col("ndcg_vs_full"))), F.lit(0.0)).alias("worst"),
    )
    return checks(
        one,
        {
            "tau2_512_within_tol_of_full": (F.col("n512") >= -slack) & (F.col("r512") >= -slack),
            "tau4_256_matches_or_beats_prefix256": (F.col("n256") >= -SLACK) & (F.col("r256") >= -SLACK),
            "germanquad_dttest_guardrail": F.col("worst") >= -slack,
        },
    )


def sweep_deltas(rows: DataFrame) -> DataFrame:
    """rows (eval_set, method, dim, ndcg10, recall100) with differences to the full vectors, and to
    the prefix of the same size."""
    full = rows.filter("method = 'full'").select("eval_set", F.col("ndcg10").alias("_n"), F.col("recall100").alias("_r"))
    prefix = rows.filter("method = 'prefix'").select("eval_set", "dim", F.col("ndcg10").alias("_pn"), F.col("recall100").alias("_pr"))
    less = lambda a, b: F.round(F.col(a) - F.col(b), 4)
    filtered = F.col("method") == "embedfilter"
    return rows.join(full, "eval_set", "left").join(prefix, ["eval_set", "dim"], "left").select(
        *rows.columns, less("ndcg10", "_n").alias("ndcg_vs_full"), less("recall100", "_r").alias("recall_vs_full"),
        F.when(filtered, less("ndcg10", "_pn")).alias("ndcg_vs_prefix"), F.when(filtered, less("recall100", "_pr")).alias("recall_vs_prefix"),
    )


def per_task(candidate: DataFrame, baseline: DataFrame, slack: float = 0.005) -> DataFrame:
    """check, passed, value: no task (task, score) of the candidate below the baseline; a task that
    the baseline lacks can't be verified and fails."""
    b = baseline.select("task", F.col("score").alias("base"))
    rows = candidate.filter("score is not null").join(b, "task", "left")
    return rows.select(F.concat(F.lit("no_regress_"), "task").alias("check"), F.coalesce(F.col("score") >= F.col("base") - slack, F.lit(False)).alias("passed"), F.col("score").alias("value"))


def headroom(candidate: DataFrame, baseline: DataFrame, task: str, target: float, bidirectional: bool | None = None) -> DataFrame:
    """per_task, with a task that must reach a target, and whether the patch was applied if asked."""
    reached = candidate.agg(F.max(F.when(F.col("task") == task, F.col("score"))).alias("s"))
    out = per_task(candidate, baseline).unionByName(
        reached.select(F.lit(f"{task}_headroom").alias("check"), F.coalesce(F.col("s") >= target, F.lit(False)).alias("passed"), F.col("s").alias("value"))
    )
    if bidirectional is not None:
        out = out.unionByName(flags(candidate.sparkSession, {"bidirectional_patch_applied": bidirectional}).select("check", "passed", "value"))
    return out


def frontier(candidate: DataFrame, peers: DataFrame, baseline: DataFrame, slack: float = 0.005, leakage: str | None = None) -> DataFrame:
    """Checks: the mean over tasks at least that of the best peer per task, a baseline is there, no
    task below it, and, if known, leakage is scanned and clean. Scores: (task, score), peers with
    peer."""
    best = peers.groupBy("task").agg(F.max("score").alias("score"))
    mean = lambda df, n: df.agg(F.avg("score").alias(n))
    one = mean(candidate, "c").crossJoin(mean(best, "p")).crossJoin(baseline.agg(F.count("score").alias("b")))  # one row each
    out = checks(one, {"beats_peer_frontier_aggregate": F.col("c") >= F.col("p"), "baseline_present": F.col("b") > 0})
    out = out.withColumn("value", F.lit(None).cast("double"))
    some = per_task(candidate, baseline, slack)
    if not baseline.filter("score is not null").isEmpty():
        out = out.unionByName(some)
    if leakage is not None:
        out = out.unionByName(flags(candidate.sparkSession, {"leakage_clean": leakage in ("clean", "scanned_clean")}).select("check", "passed", "value"))
    return out


def run_score(run: DataFrame, baseline: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row (score, deltas and penalties) and the checks of a run against a baseline. Both are
    one row: metrics (map of 'set_metric' -> double), vram_gb, throughput, status, mode,
    leakage_hits, leakage_status, retention. A missing delta counts 0 in the score; missing ones
    of the guard sets, of recall and nDCG, unverified leakage and an empty baseline fail."""
    a = run.select(*(F.col(c).alias(f"a_{c}") for c in run.columns))
    b = baseline.select(*(F.col(c).alias(f"b_{c}") for c in baseline.columns))
    one = a.crossJoin(b)  # one row
    value = lambda side, set_, name: F.coalesce(*(F.try_element_at(F.col(f"{side}_metrics"), F.lit(f"{set_}_{n}")) for n in ns.METRIC_NAMES[name]))
    names = [*SCORE_WEIGHTS, "germanquad_ndcg@10", "dt_test_ndcg@10"]
    split = {n: (n.rsplit("_", 1)[0], n.rsplit("_", 1)[1]) for n in names}
    one = one.withColumns({f"d_{n}": value("a", *split[n]) - value("b", *split[n]) for n in names})
    one = one.withColumns({"recall": value("a", "webfaq", "recall@100"), "ndcg": value("a", "webfaq", "ndcg@10"), "base_recall": value("b", "webfaq", "recall@100"), "base_ndcg": value("b", "webfaq", "ndcg@10")})
    d = lambda n: F.col(f"`d_{n}`")
    over = lambda x: F.coalesce(F.greatest(x, F.lit(0.0)), F.lit(0.0))
    penalties = {
        "germanquad": over(SCORE_BOUNDS["germanquad_ndcg@10"] - d("germanquad_ndcg@10")), "dt_test": over(SCORE_BOUNDS["dt_test_ndcg@10"] - d("dt_test_ndcg@10")),
        "retention": over(SCORE_BOUNDS["retention"] - F.col("a_retention")),
        "vram": over(F.col("a_vram_gb") - F.col("b_vram_gb")) / F.coalesce(F.greatest("b_vram_gb", F.lit(1.0)), F.lit(1.0)),
        "throughput": over(F.col("b_throughput") - F.col("a_throughput")) / F.coalesce(F.greatest("b_throughput", F.lit(1.0)), F.lit(1.0)),
    }
    one = one.withColumns({f"p_{n}": c for n, c in penalties.items()})
    score = sum(w * F.coalesce(d(n), F.lit(0.0)) for n, w in SCORE_WEIGHTS.items())
    for n, w in {"germanquad": 3.0, "dt_test": 3.0, "retention": 2.0, "vram": 0.2, "throughput": 0.2}.items():
        score = score - w * F.col(f"p_{n}")
    scored = one.select(F.round(score, 6).alias("score"), *(F.round(d(n), 6).alias(n) for n in names), *(F.round(f"p_{n}", 6).alias(f"penalty_{n}") for n in penalties))
    clean = (F.col("a_leakage_hits") <= SCORE_BOUNDS["leakage_hits"]) & ~F.coalesce(F.lower("a_leakage_status").isin(*BAD_LEAKAGE), F.lit(False))
    fine = 1e-12
    return scored, checks(
        one,
        {
            "run_status": F.lower(F.coalesce("a_status", F.lit("ok"))).isin("ok", "pass"),
            "not_a_real_run": F.lower(F.coalesce("a_mode", F.lit("real"))).isin("", "real"),
            "baseline_incomplete": (F.col("base_recall") > 0) & F.col("base_ndcg").isNotNull(),
            "leakage": clean,
            "germanquad_ndcg@10_delta": d("germanquad_ndcg@10") >= SCORE_BOUNDS["germanquad_ndcg@10"] - fine,
            "dt_test_ndcg@10_delta": d("dt_test_ndcg@10") >= SCORE_BOUNDS["dt_test_ndcg@10"] - fine,
            "matryoshka_256_retention": F.col("a_retention") >= SCORE_BOUNDS["retention"] - fine,
            "webfaq_recall@100_present": F.col("recall").isNotNull(),
            "webfaq_ndcg@10_present": F.col("ndcg").isNotNull(),
        },
    )


def objectives(runs: DataFrame, costs: list[str], extra: list[str] | None = None) -> list[str]:
    """Names of the metrics (map column `metrics`) of any run, without costs but those asked for."""
    names = runs.select(F.explode(F.map_keys("metrics")).alias("m")).distinct()
    left_out = [c for c in costs if c not in (extra or [])]
    return sorted(r.m for r in names.filter(~F.col("m").isin(*left_out)).collect())  # a handful of names


def tie_break(runs: DataFrame, key: str, costs: dict[str, str]) -> DataFrame:
    """Runs in order with nth: by each cost ('lower' or 'higher' is better), known before missing,
    then by key."""
    order = [F.asc_nulls_last(c) if way == "lower" else F.desc_nulls_last(c) for c, way in costs.items()]
    from pyspark.sql import Window

    return runs.withColumn("nth", F.row_number().over(Window.orderBy(*order, F.col(key).cast("string"))))


def choose(results: DataFrame, max_latency: float, quality_slack: float, min_retention: float | None = None) -> DataFrame:
    """One row: status and the chosen name of results (name, quality, latency_ms, harness,
    retention): the fastest within quality_slack of the best among those in the budget. Fewer than
    two results, or of several harnesses, are no comparison."""
    fits = F.col("latency_ms") <= max_latency
    if min_retention is not None:
        fits = fits & (F.coalesce("retention", F.lit(1.0)) >= min_retention)
    best = results.filter(fits).agg(F.max("quality").alias("_best"))
    rows = results.crossJoin(F.broadcast(best))  # one row
    near = fits & (F.col("_best") - F.col("quality") <= quality_slack + SLACK)
    one = rows.agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct(F.coalesce("harness", F.lit(""))).alias("h"), F.count_if(F.coalesce(F.col("harness"), F.lit("")) == "").alias("none"),
        F.min(F.when(near, F.struct("latency_ms", (-F.col("quality")).alias("q"), "name"))).alias("pick"), F.max("_best").alias("best"),
    )
    status = (
        F.when(F.col("n") < 2, "insufficient_comparison").when((F.col("h") != 1) | (F.col("none") > 0), "inconsistent_harness")
        .when(F.col("pick").isNull(), "no_eligible_candidate").otherwise("selected")
    )
    return one.select(status.alias("status"), F.when(status == "selected", F.col("pick.name")).alias("name"), F.round("best", 6).alias("best_quality"))
