"""Rerank policies over candidate lists, features that they may look at, and their evaluation.

A list is one row: query_id and `c`, its candidates in first-stage order as an array of structs
(f: place in the first stage from 0, r: place by reranker score, doc_id, fs and rr: scores, rel,
source, text). A policy is a Column over `c`: the f of the candidates in their final order. So
any number of policies is applied and judged in one pass, without a shuffle but the one that
makes the lists; lists are as long as a candidate list is.

Bounded policies place one candidate after the other. With a bound on falls, every candidate has
a last place it may take; with a bound on rises, a first one. At each place the candidate whose
last place has come goes there; as candidates' last places come in first-stage order, that is the
first one left. Otherwise it is the best by score of those whose first place has come.

Edge cases. Null scores count as 0. Ties: reranker order by score, then doc_id; all else by
first-stage order. A list without positives scores 0. Empty input: empty result. One candidate:
it keeps its place under every policy. Repeated candidates of a list keep places of their own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimark.functions import vectors as vx

# Fixed values.
NAMES = [
    "identity", "always_rerank", "top1_lock", "topk_lock", "bounded_downshift", "bounded_upshift", "margin_override",
    "blend", "confidence_conditional", "combined_safe_policy", "never_rerank", "first_stage_confidence_abstain",
    "reranker_confidence_gate", "displacement_guard", "conservative_blend", "combined_policy",
]
K, DROP = 10, 0.2
SERVING = {"lock": 3, "down": 2, "up": 5, "margin": 3.0, "alpha_high": 0.85, "alpha": 0.65}
FIXES = {
    "top1_lock": ("top1_lock", {}),
    "top3_lock": ("topk_lock", {"k": 3}),
    "bounded_downshift_D1": ("bounded_downshift", {"down": 1}),
    "blend_alpha0.85": ("blend", {"alpha": 0.85}),
    "margin_override_M3": ("margin_override", {"margin": 3.0}),
}
_FAR = 1_000_000


def first_stage(candidates: DataFrame, scored_first: bool = False) -> DataFrame:
    """Candidates (query_id, doc_id, first_stage_rank, first_stage_score, reranker_score, ord) as
    lists in long form: fs_rank by rank if all of a list have one, else by score if all have one
    (scored_first: the other way round), else as given; rr_rank by score, then doc_id."""
    own = Window.partitionBy("query_id")
    all_have = lambda c: F.bool_and(F.col(c).isNotNull()).over(own)
    ranked, scored = (all_have("first_stage_rank"), F.col("first_stage_rank")), (all_have("first_stage_score"), -F.col("first_stage_score"))
    first, second = (scored, ranked) if scored_first else (ranked, scored)
    key = F.when(first[0], first[1]).when(second[0], second[1]).otherwise(F.col("ord"))
    rr = F.coalesce("reranker_score", F.lit(0.0))
    rows = candidates.withColumn("_key", key.cast("double"))
    return rows.withColumns(
        {
            "fs": F.coalesce("first_stage_score", F.lit(0.0)),
            "rr": rr,
            "fs_rank": F.row_number().over(own.orderBy("_key", "ord", F.col("doc_id"))),
            "rr_rank": F.row_number().over(own.orderBy(F.desc(rr), "doc_id")),
        }
    ).drop("_key")


def with_missing_ranks(candidates: DataFrame) -> DataFrame:
    """Candidates without rank and score, as injected ones are, come after the last rank in list
    order, each with a score one lower than the one before; unranked marks them."""
    own = Window.partitionBy("query_id")
    bare = F.col("first_stage_rank").isNull() & F.col("first_stage_score").isNull()
    nth = F.sum(bare.cast("int")).over(own.orderBy("ord").rowsBetween(Window.unboundedPreceding, 0))
    last = F.coalesce(F.max("first_stage_rank").over(own), F.lit(-1))
    low = F.coalesce(F.min("first_stage_score").over(own), F.lit(0.0))
    return candidates.withColumns(
        {
            "unranked": bare,
            "first_stage_rank": F.when(bare, last + nth).otherwise(F.col("first_stage_rank")),
            "first_stage_score": F.when(bare, low - nth).otherwise(F.col("first_stage_score")),
        }
    )


def nested(lists: DataFrame) -> DataFrame:
    """query_id and c of lists in long form (query_id, doc_id, fs, rr, rel, fs_rank, rr_rank; source
    and text if there)."""
    has = lambda c: (F.col(c) if c in lists.columns else F.lit(None)).cast("string").alias(c)
    one = F.struct(
        (F.col("fs_rank") - 1).cast("int").alias("f"), (F.col("rr_rank") - 1).cast("int").alias("r"), "doc_id",
        F.coalesce(F.col("fs").cast("double"), F.lit(0.0)).alias("fs"), F.coalesce(F.col("rr").cast("double"), F.lit(0.0)).alias("rr"),
        F.coalesce("rel", F.lit(False)).alias("rel"), has("source"), has("text"),
    )
    return lists.groupBy("query_id").agg(F.array_sort(F.collect_list(one)).alias("c"))


# ------------------------------------------------------------------ observable features
def _scores(c: Column, of: str) -> Column:
    """Scores in first-stage order, or the reranker's in its own order."""
    return F.transform(c, lambda x: x["fs"]) if of == "fs" else F.transform(by_reranker(c), lambda f: F.get(c, f)["rr"])


def _at(a: Column, i: int) -> Column:
    return F.coalesce(F.get(a, F.lit(i)), F.try_element_at(a, F.lit(-1)), F.lit(0.0))


def gap(c: Column, of: str = "fs", to: int = 1) -> Column:
    s = _scores(c, of)
    return F.round(_at(s, 0) - _at(s, to), 6)


def features(c: Column) -> Column:
    """A struct of fifteen features; none looks at a judgement."""
    fs, rr = _scores(c, "fs"), _scores(c, "rr")
    sources = F.filter(F.transform(c, lambda x: x["source"]), lambda s: F.coalesce(s, F.lit("")) != "")
    names = F.array_distinct(sources)
    most = F.array_max(F.transform(names, lambda n: F.size(F.filter(sources, lambda s: s == n))))
    first = lambda kinds: F.slice(F.transform(F.filter(c, lambda x: F.coalesce(x["source"].isin(*kinds), F.lit(False))), lambda x: x["doc_id"]), 1, K)
    bm25, dense = first(["bm25"]), first(["v3_dense", "dense", "e5_dense"])
    r6 = lambda x: F.round(x, 6)
    return F.struct(
        r6(_at(fs, 0)).alias("first_stage_top1_score"), r6(_at(fs, 1)).alias("first_stage_top2_score"),
        gap(c).alias("first_stage_top1_top2_gap"), gap(c, "fs", 4).alias("first_stage_top1_top5_gap"),
        r6(vx.entropy(fs)).alias("first_stage_score_entropy"),
        r6(F.when(F.size(sources) > 0, most / F.size(sources)).otherwise(1.0)).alias("candidate_source_agreement"),
        F.when((F.size(bm25) > 0) & (F.size(dense) > 0), F.size(F.array_intersect(bm25, dense)) / K).alias("bm25_dense_agreement"),
        r6(_at(rr, 0)).alias("reranker_top1_score"), r6(_at(rr, 1)).alias("reranker_top2_score"),
        gap(c, "rr").alias("reranker_top1_top2_gap"), r6(vx.entropy(rr)).alias("reranker_score_entropy"),
        F.array_max(F.transform(c, lambda x: F.abs(x["r"] - x["f"]))).alias("max_rank_displacement"),
        F.get(c, F.lit(0))["r"].alias("reranker_rank_of_first_stage_top1"),
        F.size(c).alias("num_candidates"), F.size(names).alias("num_candidate_sources"),
    )


# ------------------------------------------------------------------ orders
def by_first_stage(c: Column) -> Column:
    return F.transform(c, lambda x: x["f"])


def by_reranker(c: Column) -> Column:
    return F.transform(F.array_sort(F.transform(c, lambda x: F.struct(x["r"].alias("r"), x["f"].alias("f")))), lambda x: x["f"])


def locked(c: Column, k: int) -> Column:
    """The first k keep their places; the reranker orders the others."""
    return F.concat(F.slice(by_first_stage(c), 1, k), F.filter(by_reranker(c), lambda f: f >= k))


def mixed(c: Column, alpha: Column | float) -> Column:
    """For each candidate alpha of its scaled first-stage score and the rest of its reranker's."""
    a = alpha if isinstance(alpha, Column) else F.lit(float(alpha))
    both = vx.minmax(F.transform(c, lambda x: x["fs"])), vx.minmax(F.transform(c, lambda x: x["rr"]))
    return F.zip_with(*both, lambda x, y: F.round(a * x + (1 - a) * y, 9))


def blended(c: Column, alpha: Column | float) -> Column:
    """By the mixed score, ties in first-stage order. c may be a part of a list."""
    keyed = F.zip_with(c, mixed(c, alpha), lambda x, m: F.struct((-m).alias("m"), x["f"].alias("f")))
    return F.transform(F.array_sort(keyed), lambda x: x["f"])


def bounded(c: Column, score: Column, down: int | None = None, up: int | None = None, free: Column | None = None, head: Column | None = None) -> Column:
    """head (f of candidates already placed; none by default), then the others by score (an array
    in first-stage order), none more than `down` places below its first-stage place, none more
    than `up` above it unless it is free (an array of booleans)."""
    free = free if free is not None else F.transform(c, lambda x: F.lit(False))
    head = head if head is not None else F.array().cast("array<int>")
    items = F.zip_with(F.zip_with(by_first_stage(c), score, lambda f, s: F.struct(f.alias("f"), s.alias("s"))), free, lambda i, e: F.struct(i["f"].alias("f"), i["s"].alias("s"), e.alias("free")))
    best = lambda xs: -F.array_max(F.transform(xs, lambda i: F.struct(i["s"].alias("s"), (-i["f"]).alias("f"))))["f"]

    def place(done: Column, p: Column) -> Column:
        left = F.filter(items, lambda i: ~F.array_contains(done, i["f"]))
        risen = F.filter(left, lambda i: i["free"] | (i["f"] - (F.lit(_FAR) if up is None else F.lit(up)) <= p))
        pick = F.coalesce(best(risen), best(left))
        if down is not None:
            first = F.array_min(F.transform(left, lambda i: i["f"]))
            pick = F.when(first + down <= p, first).otherwise(pick)
        return F.concat(done, F.array(pick.cast("int")))

    places = F.filter(by_first_stage(c), lambda p: p >= F.size(head))
    return F.aggregate(places, head.cast("array<int>"), place)


def _rr(c: Column) -> Column:
    return F.transform(c, lambda x: x["rr"])


def _lead(c: Column) -> Column:
    """By how much the reranker's best beats the first stage's first."""
    return F.array_max(_rr(c)) - F.get(c, F.lit(0))["rr"]


def _free(c: Column, margin: float) -> Column:
    return F.transform(c, lambda x: x["rr"] - F.get(c, F.lit(0))["rr"] >= margin)


def apply(c: Column, name: str, **p) -> tuple[Column, Column]:
    """The order (array of f) and the action of a policy. Parameters: k, down, up, alpha, margin,
    gap_high, gap_low (of the first stage), rr_gap, most_moved."""
    k, down, up = p.get("k", 3), p.get("down", 3), p.get("up", 3)
    alpha, margin = p.get("alpha", 1.0), p.get("margin", 2.0)
    high, low, rr_gap = p.get("gap_high", 1e9), p.get("gap_low", 0.0), p.get("rr_gap", 0.0)
    moved = F.get(c, F.lit(0))["r"] > p.get("most_moved", K)
    fs, rr = by_first_stage(c), by_reranker(c)
    keep, rerank = F.lit("keep_first_stage"), F.lit("rerank_top_k")
    over = _lead(c) >= margin
    either = lambda test, a, b: (F.when(test, a[0]).otherwise(b[0]), F.when(test, a[1]).otherwise(b[1]))
    match name:
        case "identity":
            return fs, F.lit("identity")
        case "never_rerank":
            return fs, keep
        case "always_rerank":
            return rr, F.lit("rerank")
        case "top1_lock":
            return locked(c, 1), F.lit("top1_lock")
        case "topk_lock":
            return locked(c, k), F.lit("topk_lock")
        case "bounded_downshift":
            return bounded(c, _rr(c), down=down), F.lit("bounded_downshift")
        case "bounded_upshift":
            return bounded(c, _rr(c), up=up, free=_free(c, margin)), F.lit("bounded_upshift")
        case "margin_override":
            return either(over, (rr, F.lit("override_rerank")), (locked(c, 1), F.lit("top1_lock")))
        case "blend":
            return blended(c, alpha), F.lit("blend")
        case "conservative_blend":
            return blended(c, alpha), F.lit("conservative_blend")
        case "confidence_conditional":
            return either(gap(c) >= high, (locked(c, k), F.lit("topk_lock")), (rr, F.lit("rerank")))
        case "combined_safe_policy":
            sure = F.concat(F.slice(fs, 1, k), blended(F.filter(c, lambda x: x["f"] >= k), alpha)), F.lit("high_topk_lock_blend")
            medium = bounded(c, _rr(c), down=down), F.when(over, "med_downshift_override").otherwise("med_downshift")
            unsure = bounded(c, _rr(c), up=up, free=_free(c, margin)), F.lit("low_bounded_upshift")
            return either(gap(c) >= high, sure, either(gap(c) >= low, medium, unsure))
        case "first_stage_confidence_abstain":
            return either(gap(c) >= p.get("gap_high", 0.0), (fs, keep), (rr, rerank))
        case "reranker_confidence_gate":
            return either(gap(c, "rr") >= rr_gap, (rr, rerank), (fs, keep))
        case "displacement_guard":
            return either(moved, (fs, keep), (rr, rerank))
        case "combined_policy":
            wants = (gap(c) < p.get("gap_high", 0.0)) & (gap(c, "rr") >= rr_gap)
            careful = (blended(c, alpha), F.lit("conservative_blend")) if alpha < 1.0 else (fs, keep)
            return either(wants & ~moved, (rr, rerank), either(wants, careful, (fs, keep)))
    raise ValueError(f"unknown policy: {name}")


def ranked(lists: DataFrame, name: str, **params) -> DataFrame:
    """query_id, doc_id, final_rank (from 1), action."""
    order, action = apply(F.col("c"), name, **params)
    rows = nested(lists).select("query_id", "c", order.alias("o"), action.alias("action"))
    return rows.select("query_id", "c", "action", F.posexplode("o").alias("p", "f")).select(
        "query_id", F.get("c", F.col("f"))["doc_id"].alias("doc_id"), (F.col("p") + 1).alias("final_rank"), "action"
    )


# ------------------------------------------------------------------ evaluation
def ndcg(c: Column, order: Column, k: int = K) -> Column:
    """Binary nDCG@k of an order; the ideal has all positives of the list."""
    gain = lambda i: F.log(F.lit(2.0)) / F.log(i + 2.0)
    top = F.transform(F.slice(order, 1, k), lambda f, i: F.when(F.get(c, f)["rel"], gain(i)).otherwise(0.0))
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    n = F.least(F.size(F.filter(c, lambda x: x["rel"])), F.lit(k))
    ideal = total(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), gain))
    return F.when(n == 0, 0.0).otherwise(total(top) / ideal)


def oracle_order(c: Column) -> Column:
    is_ = lambda want: by_first_stage(F.filter(c, lambda x: x["rel"] == want))
    return F.concat(is_(True), is_(False))


def bucket_of(f: Column, o: Column) -> Column:
    return (
        F.when(o < 0.80, "impossible").when((o >= 0.98) & (f >= 0.95), "no_room").when(f >= 0.85, "easy").when(f >= 0.50, "medium").otherwise("hard")
    )


def judged(lists: DataFrame, policies: dict[str, tuple[str, dict]]) -> DataFrame:
    """A row per query and policy: query_id, policy, first, raw, reached (nDCG@10 of the first
    stage, the reranker and the policy), bucket, gap, action, kept (the same order), top1 (the
    same first document), moved (the largest displacement)."""
    c = F.col("c")
    rows = nested(lists).select(
        "query_id", "c", F.round(ndcg(c, by_first_stage(c)), 9).alias("first"), F.round(ndcg(c, by_reranker(c)), 9).alias("raw"),
        F.round(ndcg(c, oracle_order(c)), 9).alias("oracle"), gap(c).alias("gap"),
    )
    each = []
    for label, (name, params) in policies.items():
        order, action = apply(c, name, **params)
        each.append(F.struct(F.lit(label).alias("policy"), order.alias("o"), action.alias("action")))
    rows = rows.select("*", F.inline(F.array(*each)))
    return rows.select(
        "query_id", "policy", "first", "raw", F.round(ndcg(c, F.col("o")), 9).alias("reached"),
        bucket_of(F.col("first"), F.col("oracle")).alias("bucket"), "gap", "action",
        (F.col("o") == by_first_stage(c)).alias("kept"), (F.get("o", F.lit(0)) == 0).alias("top1"),
        F.array_max(F.transform("o", lambda f, i: F.abs(f - i))).alias("moved"),
    )


def evaluation(rows: DataFrame, by_bucket: bool = False) -> DataFrame:
    """Of judged: policy (and bucket), queries, mean nDCG@10s, deltas, rates of abstaining, of
    keeping the first document and of catastrophic drops, mean displacement, delta over medium
    and hard lists."""
    delta = F.col("reached") - F.col("first")
    r = lambda x: F.round(x, 6)
    share = lambda x: r(F.avg(x.cast("int")))
    return rows.groupBy("policy", *(["bucket"] if by_bucket else [])).agg(
        F.count(F.lit(1)).alias("queries"), r(F.avg("first")).alias("first"), r(F.avg("raw")).alias("raw"), r(F.avg("reached")).alias("reached"),
        r(F.avg(delta)).alias("delta"), r(F.avg(F.col("reached") - F.col("raw"))).alias("delta_raw"),
        share(F.col("kept")).alias("abstain_rate"), share(F.col("top1")).alias("lock_rate"),
        share(delta <= -DROP + 1e-9).alias("catastrophic_rate"), r(F.avg("moved")).alias("displacement"),
        r(F.avg(F.when(F.col("bucket").isin("medium", "hard"), delta))).alias("medium_hard_delta"),
    )


def worst(rows: DataFrame, n: int = 10) -> DataFrame:
    """The catastrophic drops of judged lists, the worst n of each policy."""
    drop = rows.withColumn("delta", F.round(F.col("reached") - F.col("first"), 6)).filter(F.col("delta") <= -DROP)
    w = Window.partitionBy("policy").orderBy("delta", "query_id")
    return drop.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= n).select("policy", "nth", "query_id", "first", "reached", "delta")


def nearest_rank(values: DataFrame, value: str, qs: list[float]) -> dict[float, float]:
    """Nearest-rank quantiles, the index rounded half to even, from counts by value: the values of
    a list feature, a row per query of a development set. 0 for an empty set."""
    upto = Window.orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    counts = values.groupBy(value).agg(F.count(F.lit(1)).alias("_n")).withColumn("_upto", F.sum("_n").over(upto))
    n = values.count()
    if not n:
        return {q: 0.0 for q in qs}
    at = {q: min(n - 1, max(0, int(round(q * (n - 1))))) for q in qs}
    first = counts.agg(*(F.min(F.when(F.col("_upto") > i, F.col(value))).alias(f"q{j}") for j, i in enumerate(at.values()))).first()
    return dict(zip(at, first))


def grid(gaps: dict[float, float]) -> dict[str, tuple[str, dict]]:
    """The policies that are tried, some with thresholds from quantiles of the gap. Parameters
    are fixed values."""
    tried: list[tuple[str, dict]] = [("identity", {}), ("always_rerank", {}), ("top1_lock", {})]
    tried += [("topk_lock", {"k": k}) for k in (1, 2, 3, 5, 10)]
    tried += [("bounded_downshift", {"down": d}) for d in (1, 2, 3, 5, 10)]
    tried += [("bounded_upshift", {"up": u, "margin": m}) for u in (1, 2, 3, 5) for m in (1.0, 2.0, 5.0)]
    tried += [("margin_override", {"margin": m}) for m in (1.0, 2.0, 3.0, 5.0)]
    tried += [("blend", {"alpha": a}) for a in (0.1, 0.3, 0.5, 0.7, 0.9)]
    tried += [("confidence_conditional", {"gap_high": gaps[q], "k": k}) for q in (0.5, 0.75) for k in (1, 3)]
    safe = {"gap_high": gaps[0.75], "gap_low": gaps[0.4], "margin": 2.0, "up": 3, "alpha": 0.5}
    tried += [("combined_safe_policy", safe | {"k": k, "down": d}) for k in (1, 3) for d in (2, 3)]
    return {f"{name} {params}": (name, params) for name, params in tried}


def search(lists: DataFrame, policies: dict[str, tuple[str, dict]] | None = None, sure_gap: float = 0.6, keep: float = 0.9, abstain: bool = False) -> DataFrame:
    """A row per policy: reached, delta, catastrophic_rate, abstain_rate, top1_keep (share of the
    lists with a large gap, from the `sure_gap` quantile on, whose first document stays), safe,
    nth: the safe ones first, by reached, then top1_keep (abstain: then abstain_rate), then fewer
    drops."""
    gaps = nearest_rank(nested(lists).select(gap(F.col("c")).alias("gap")), "gap", [0.4, 0.5, sure_gap, 0.75])
    rows = judged(lists, policies or grid(gaps))
    sure = F.col("gap") >= gaps[sure_gap]
    kept = rows.groupBy("policy").agg(F.coalesce(F.round(F.avg(F.when(sure, F.col("top1").cast("int"))), 4), F.lit(1.0)).alias("top1_keep"))
    e = evaluation(rows).join(kept, "policy").withColumn("safe", F.col("top1_keep") >= keep - 1e-9)
    second = "abstain_rate" if abstain else "top1_keep"
    order = Window.orderBy(F.desc("safe"), F.desc("reached"), F.desc(second), "catastrophic_rate", "policy")
    return e.withColumn("nth", F.row_number().over(order)).select(
        "policy", "reached", "delta", "catastrophic_rate", "abstain_rate", "medium_hard_delta", "top1_keep", "safe", "nth"
    )


# ------------------------------------------------------------------ serving
def serve(lists: DataFrame, mode: str = "policy_gated", allow_raw: bool = False, **bounds) -> DataFrame:
    """query_id, doc_id, final_rank (from 0), first_stage_rank, reranker_rank, final_score, action,
    margin_override. Modes: first_stage_only; raw_rerank, which must be allowed; policy_gated: the
    first `lock` places are kept, or taken by the document that beats the first one's reranker
    score by the margin, the others are ordered by mixed scores within bounds."""
    if mode not in ("first_stage_only", "raw_rerank", "policy_gated"):
        raise ValueError(f"unknown mode: {mode}")
    if mode == "raw_rerank" and not allow_raw:
        raise ValueError("raw_rerank is unsafe and must be allowed")
    b = SERVING | bounds
    c = F.col("c")
    rows = nested(lists)
    best = -F.array_max(F.transform(c, lambda x: F.struct(x["rr"].alias("s"), (-x["f"]).alias("f"))))["f"]
    rows = rows.withColumns({"best": best, "over": (_lead(c) >= b["margin"]) & (best != 0)})
    over = F.col("over")
    alpha = F.when(over, b["alpha"]).otherwise(b["alpha_high"])
    plain = F.slice(by_first_stage(c), 1, b["lock"])
    promoted = F.slice(F.concat(F.array("best"), F.filter(plain, lambda f: f != F.col("best"))), 1, b["lock"])
    rows = rows.withColumns({"m": mixed(c, alpha), "head": F.when(over, promoted).otherwise(plain)})
    if mode == "policy_gated":
        order = bounded(c, F.col("m"), b["down"], b["up"], _free(c, b["margin"]), F.col("head"))
    else:
        order = by_first_stage(c) if mode == "first_stage_only" else by_reranker(c)
    x = rows.select("*", order.alias("o")).select("*", F.posexplode("o").alias("final_rank", "f"))
    own = F.get("c", F.col("f"))
    if mode == "policy_gated":
        action = (
            F.when(over & (F.col("f") == F.col("best")) & (F.col("final_rank") == 0), "margin_override")
            .when(F.array_contains("head", F.col("f")), "locked")
            .when(F.col("f") == F.col("final_rank"), "kept_first_stage")
            .otherwise("blended")
        )
    else:
        action = F.lit("kept_first_stage" if mode == "first_stage_only" else "reranked")
    return x.select(
        "query_id", own["doc_id"].alias("doc_id"), "final_rank", F.col("f").alias("first_stage_rank"), own["r"].alias("reranker_rank"),
        F.round(F.get("m", F.col("f")), 6).alias("final_score"), action.alias("action"),
        (over if mode == "policy_gated" else F.lit(False)).alias("margin_override"),
    )


def serving_diagnostics(served: DataFrame) -> DataFrame:
    """query_id, max_downshift, max_upshift, locked, margin_override, candidates."""
    fall = F.col("final_rank") - F.col("first_stage_rank")
    return served.groupBy("query_id").agg(
        F.greatest(F.max(fall), F.lit(0)).alias("max_downshift"), F.greatest(F.max(-fall), F.lit(0)).alias("max_upshift"),
        F.count_if(F.col("action") == "locked").alias("locked"), F.bool_or("margin_override").alias("margin_override"),
        F.count(F.lit(1)).alias("candidates"),
    )


# ------------------------------------------------------------------ error classes
def _words(x: Column) -> Column:
    return F.array_distinct(F.filter(F.split(F.lower(F.coalesce(x, F.lit(""))), r"\s+"), lambda w: w != ""))


def _alike(a: Column, b: Column) -> Column:
    shared = F.size(F.array_intersect(a, b))
    return F.when(shared == 0, 0.0).otherwise(shared / F.size(F.array_union(a, b)))


def error_type(c: Column, query: Column) -> Column:
    """What went wrong where the reranker made a list worse; the first class that fits."""
    positive = F.filter(c, lambda x: x["rel"])
    best = F.get(positive, F.lit(0))
    top = F.get(c, F.get(by_reranker(c), F.lit(0)))
    best_rank = F.array_min(F.transform(positive, lambda x: x["r"]))
    n = lambda x: F.length(F.coalesce(x, F.lit("")))
    own = _words(best["text"])
    double = F.exists(c, lambda x: ~x["rel"] & (_alike(own, _words(x["text"])) >= 0.8))
    count = lambda x: F.size(F.filter(F.split(F.coalesce(x, F.lit("")), r"\s+"), lambda w: w != ""))
    sources = F.size(F.array_distinct(F.filter(F.transform(c, lambda x: x["source"]), lambda s: F.coalesce(s, F.lit("")) != "")))
    demoted = (best["f"] <= 2) & (best_rank >= K)
    return (
        F.when((F.size(positive) == 0) | (F.size(c) == 0), "unknown")
        .when(demoted & (best["f"] == 0), "lexical_exact_positive_demoted")
        .when(demoted, "positive_demoted_from_top1_or_top3")
        .when(~top["rel"] & (n(top["text"]) > 1.3 * F.greatest(n(best["text"]), F.lit(1))), "reranker_promotes_longer_but_wrong_doc")
        .when(double, "duplicate_or_near_duplicate_confusion")
        .when((sources >= 2) & ~top["rel"] & ~F.coalesce(top["source"], F.lit("")).eqNullSafe(F.coalesce(best["source"], F.lit(""))), "candidate_source_artifact")
        .when(gap(c) < 0.5, "insufficient_first_stage_features")
        .when((count(query) > 0) & (count(best["text"]) > 8 * count(query)), "query_style_mismatch")
        .otherwise("unknown")
    )


def fixable(c: Column, first: Column) -> Column:
    """label -> whether that policy turns a catastrophic drop into none."""
    parts = []
    for label, (name, params) in FIXES.items():
        order, _ = apply(c, name, **params)
        parts += [F.lit(label), ndcg(c, order) - first > -DROP + 1e-9]
    return F.create_map(*parts)


def catastrophes(lists: DataFrame, queries: DataFrame) -> DataFrame:
    """Lists of two or more candidates that the reranker makes worse by 0.2 or more: query_id,
    first, raw, delta, first and last rank of the best positive, error_type, fixable_by (sorted
    labels). queries: (query_id, query)."""
    c = F.col("c")
    rows = nested(lists).filter(F.size(c) >= 2).select("query_id", "c", ndcg(c, by_first_stage(c)).alias("first"), ndcg(c, by_reranker(c)).alias("raw"))
    rows = rows.filter(F.col("raw") - F.col("first") <= -DROP).join(queries, "query_id", "left")
    positive = F.filter(c, lambda x: x["rel"])
    fixes = F.array_sort(F.map_keys(F.map_filter(fixable(c, F.col("first")), lambda k, v: v)))
    return rows.select(
        "query_id", F.round("first", 4).alias("first"), F.round("raw", 4).alias("raw"), F.round(F.col("raw") - F.col("first"), 4).alias("delta"),
        F.array_min(by_first_stage(positive)).alias("initial_rank"), F.array_min(F.transform(positive, lambda x: x["r"])).alias("final_rank"),
        error_type(c, F.col("query")).alias("error_type"), fixes.alias("fixable_by"),
    )


# Fixed values.
REMEDIES = {
    "positive_locked_too_low": "tune_policy_threshold",
    "top_k_lock_too_strict": "tune_policy_threshold",
    "margin_override_too_permissive": "tune_policy_threshold",
    "margin_override_too_strict": "tune_policy_threshold",
    "blend_alpha_too_low": "tune_policy_threshold",
    "blend_alpha_too_high": "tune_policy_threshold",
    "no_useful_first_stage_score": "add_calibration_features",
    "candidate_source_artifact": "add_more_data",
    "duplicate_near_duplicate_confusion": "add_more_data",
    "unknown": "train_new_checkpoint",
}


def failures(lists: DataFrame, missed: float = 0.02, **bounds) -> DataFrame:
    """Where serving (policy_gated) fails: query_id, kind (catastrophic, regression or missed_lift),
    category, fixable (by the policy's bounds), remedy. The first category that fits."""
    b = SERVING | bounds
    served = serve(lists, **bounds)
    mine = served.groupBy("query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("final_rank", "first_stage_rank", "action"))), lambda x: F.struct(x["first_stage_rank"].alias("f"), x["action"].alias("a"))).alias("o"),
        F.bool_or("margin_override").alias("over"),
    )
    c, o = F.col("c"), F.col("o")
    rows = nested(lists).join(mine, "query_id")
    rows = rows.select(
        "*", ndcg(c, by_first_stage(c)).alias("first"), ndcg(c, by_reranker(c)).alias("raw"), ndcg(c, F.transform(o, lambda x: x["f"])).alias("reached"),
        F.filter(c, lambda x: x["rel"]).alias("positive"),
    )
    best = F.get("positive", F.lit(0))
    place = F.array_position(F.transform(o, lambda x: x["f"]), best["f"]) - 1
    top = F.get(c, F.get(o, F.lit(0))["f"])
    rows = rows.select(
        "*", F.array_min(F.transform("positive", lambda x: x["r"])).alias("rr"), best["f"].alias("fs"), place.cast("int").alias("at"),
        F.get(o, place.cast("int"))["a"].alias("did"), (best["rr"] - F.get(c, F.lit(0))["rr"]).alias("ahead"),
        top["rel"].alias("top_rel"), F.exists("positive", lambda x: _alike(_words(x["text"]), _words(top["text"])) >= 0.9).alias("double"),
        (F.size(F.array_distinct(F.transform(c, lambda x: F.round(x["fs"], 6)))) <= 1).alias("flat"),
    )
    above = F.filter(F.transform(F.slice(o, F.lit(1), F.greatest(F.col("at"), F.lit(0))), lambda x: F.get(c, x["f"])), lambda x: ~x["rel"])
    regression = F.col("reached") < F.col("first") - 1e-9
    lift = (F.col("raw") - F.col("reached") > missed) & (F.col("raw") > F.col("first") + 1e-9)
    kind = F.when(F.col("reached") - F.col("first") <= -DROP, "catastrophic").when(regression, "regression").otherwise("missed_lift")
    fs, rr, at, over = F.col("fs"), F.col("rr"), F.col("at"), F.col("over")
    preferred = rr < fs
    tail = F.col("did").isin("blended", "kept_first_stage")
    category = (
        F.when(F.col("flat"), "no_useful_first_stage_score")
        .when(~F.col("top_rel") & F.col("double"), "duplicate_near_duplicate_confusion")
        .when(over & ~F.col("top_rel") & regression, "margin_override_too_permissive")
        .when(fs.isNull(), "unknown")
        .when(lift & ~over & (F.col("ahead") > 0) & (F.col("ahead") < b["margin"]) & preferred, "margin_override_too_strict")
        .when(lift & (fs >= b["lock"]) & preferred & (at >= b["lock"]), "top_k_lock_too_strict")
        .when((fs < b["lock"]) & (fs > 0) & preferred & (at == fs) & (F.col("did") == "locked"), "positive_locked_too_low")
        .when(tail & regression & (rr > fs), "blend_alpha_too_low")
        .when(tail & lift & (rr < at), "blend_alpha_too_high")
        .when(F.coalesce(F.get(above, F.lit(0))["source"], F.lit("")) != "", "candidate_source_artifact")
        .otherwise("unknown")
    )
    remedy = reduce(lambda m, kv: m.when(F.col("category") == kv[0], kv[1]), REMEDIES.items(), F)
    return (
        rows.filter(regression | lift)
        .select("query_id", kind.alias("kind"), category.alias("category"))
        .withColumn("remedy", remedy)
        .withColumn("fixable", F.col("remedy") == "tune_policy_threshold")
    )
