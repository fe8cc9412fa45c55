"""Training sets from candidate lists, teacher caches and mined negatives.

Lists are rows with `candidates`, an array of structs (doc_id, document, label, teacher_score, and
where used teacher_softmax_target, high_precision_positive, candidate_source, domain, synthetic,
uncertain). Everything within a list is a Column over that array, so nothing is shuffled but where
rows of a query have to meet.

Edge cases. Null candidates count as none. Null labels are uncertain and never become examples of
a class. A list without a positive gives no pairs, as its negatives might be the positive. Ties
keep list order. Repeated rows each count. Empty input: empty result. Other columns are dropped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimark.functions import text as tx
from sedimark.functions import vectors as vx
from sedimark.operators import contracts

# Fixed values.
FAQ_DOMAINS = ["faq_real", "faq"]
DEFAULT_FAQ = 0.5


def _cs(df: DataFrame) -> Column:
    return F.coalesce("candidates", F.array().cast(df.schema["candidates"].dataType))


def _fields(df: DataFrame) -> list[str]:
    return df.schema["candidates"].dataType.elementType.names


def _get(df: DataFrame, c: Column, name: str, kind: str) -> Column:
    return c[name].cast(kind) if name in _fields(df) else F.lit(None).cast(kind)


def _doc(df: DataFrame, c: Column) -> Column:
    names = [n for n in ("document", "text") if n in _fields(df)]
    return F.coalesce(*(F.nullif(c[n], F.lit("")) for n in names), F.lit(""))


# ------------------------------------------------------------------ presence of a positive
def has_positive(df: DataFrame) -> Column:
    """A candidate is named in positive_doc_ids, labelled 1, or a high-precision positive."""
    ids = F.coalesce("positive_doc_ids", F.array().cast("array<string>")) if "positive_doc_ids" in df.columns else F.array().cast("array<string>")
    return F.exists(
        _cs(df),
        lambda c: F.array_contains(ids, F.coalesce(_get(df, c, "doc_id", "string"), F.lit("")))
        | (F.coalesce(_get(df, c, "label", "int"), F.lit(0)) == 1)
        | F.coalesce(_get(df, c, "high_precision_positive", "boolean"), F.lit(False)),
    )


def by_presence(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Lists with a positive, and without."""
    return df.filter(has_positive(df)), df.filter(~has_positive(df))


# ------------------------------------------------------------------ examples of single documents
def pointwise(df: DataFrame, confident: bool = False) -> DataFrame:
    """query, document, label: labelled candidates; confident: 1 only for high-precision
    positives."""
    label = lambda c: _get(df, c, "label", "double")
    sure = lambda c: (label(c) == 0) | ((label(c) == 1) & F.coalesce(_get(df, c, "high_precision_positive", "boolean"), F.lit(False)))
    kept = F.filter(_cs(df), lambda c: F.coalesce(sure(c), F.lit(False)) if confident else label(c).isNotNull())
    return df.select("query", F.inline(F.transform(kept, lambda c: F.struct(_doc(df, c).alias("document"), label(c).alias("label")))))


def regression(df: DataFrame) -> DataFrame:
    """query, document, label: the teacher's scores as targets."""
    score = lambda c: _get(df, c, "teacher_score", "double")
    kept = F.filter(_cs(df), lambda c: score(c).isNotNull())
    return df.select("query", F.inline(F.transform(kept, lambda c: F.struct(_doc(df, c).alias("document"), score(c).alias("label")))))


def from_cache(cache: DataFrame, soft: bool = False) -> DataFrame:
    """query, document, label of cache rows: 1 or 0 by the flag; soft: the logistic of the score
    where there is one."""
    hard = F.coalesce("positive", F.lit(False)).cast("double")
    s = F.coalesce("reranker_score", "embedding_score")
    return cache.select("query", "document", (F.coalesce(1 / (1 + F.exp(-s)), hard) if soft else hard).alias("label"))


# ------------------------------------------------------------------ pairs
def pairs(df: DataFrame, most: int = 8, margin: float | None = None, present_only: bool = False) -> DataFrame:
    """query, positive, negative, nth: candidates labelled 1 by candidates labelled 0 in list order,
    at most `most` a list; margin: both scored and so far apart."""
    rows = by_presence(df)[0] if present_only else df
    side = lambda want: F.filter(_cs(df), lambda c: F.coalesce(_get(df, c, "label", "int") == want, F.lit(False)))
    score = lambda c: _get(df, c, "teacher_score", "double")

    def with_negatives(p: Column) -> Column:
        ns = side(0)
        if margin is not None:
            ns = F.filter(ns, lambda n: F.coalesce(score(p) - score(n) >= margin, F.lit(False)))
        # No more than `most` negatives of one positive can count.
        return F.transform(F.slice(ns, 1, most), lambda n: F.struct(_doc(df, p).alias("positive"), _doc(df, n).alias("negative")))

    made = F.slice(F.flatten(F.transform(F.slice(side(1), 1, 10_000), with_negatives)), 1, most)
    return rows.select("query", F.posexplode(made).alias("nth", "x")).select("query", "x.positive", "x.negative", (F.col("nth") + 1).alias("nth"))


def pairs_from_cache(cache: DataFrame, most: int = 8) -> DataFrame:
    """query_id, positive, negative: documents flagged positive by all others of a query, by
    doc_id, at most `most`. Only the first `most` of either side can count, so no query's rows
    are multiplied in full."""
    flag = F.coalesce("positive", F.lit(False))
    own = Window.partitionBy("query_id", flag).orderBy("doc_id")
    rows = cache.withColumn("_nth", F.row_number().over(own)).filter(F.col("_nth") <= most)
    p = rows.filter(flag).select("query_id", F.col("document").alias("positive"), F.col("_nth").alias("i"))
    n = rows.filter(~flag).select("query_id", F.col("document").alias("negative"), F.col("_nth").alias("j"))
    w = Window.partitionBy("query_id").orderBy("i", "j")
    return p.join(n, "query_id").withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= most).select("query_id", "positive", "negative", "nth")


# ------------------------------------------------------------------ lists
def _target(df: DataFrame, temperature: float, missing: float) -> Column:
    """The stored softmax if it is whole and sums to one, else that of the scores."""
    stored = F.transform(_cs(df), lambda c: _get(df, c, "teacher_softmax_target", "double"))
    total = F.aggregate(stored, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
    scores = F.transform(_cs(df), lambda c: F.coalesce(_get(df, c, "teacher_score", "double"), F.lit(missing)))
    whole = F.forall(stored, lambda t: t.isNotNull()) & (F.abs(total - 1) < 1e-3)
    return F.when(whole, stored).otherwise(vx.softmax(scores, temperature))


def _column(df: DataFrame, name: str, kind: str) -> Column:
    return F.transform(_cs(df), lambda c: _get(df, c, name, kind))


def listwise(df: DataFrame, temperature: float = 1.0, enriched: bool = False, present_only: bool = False) -> DataFrame:
    """query, documents, target (and, enriched, labels, high_precision, teacher_scores) of lists of
    two or more candidates; a missing score counts as -1e9."""
    rows = (by_presence(df)[0] if present_only else df).filter(F.size(_cs(df)) >= 2)
    more = [
        _column(df, "label", "int").alias("labels"),
        F.transform(_column(df, "high_precision_positive", "boolean"), lambda x: F.coalesce(x, F.lit(False))).alias("high_precision"),
        _column(df, "teacher_score", "double").alias("teacher_scores"),
    ]
    return rows.select("query", F.transform(_cs(df), lambda c: _doc(df, c)).alias("documents"), _target(df, temperature, -1e9).alias("target"), *(more if enriched else []))


def labelled_lists(df: DataFrame, temperature: float = 1.0) -> DataFrame:
    """query, documents, target, labels: softmax of the scores if all candidates have one, else the
    labels over their sum."""
    scores = _column(df, "teacher_score", "double")
    labels = F.transform(_column(df, "label", "double"), lambda x: F.coalesce(x, F.lit(0.0)))
    total = F.aggregate(labels, F.lit(0.0), lambda s, x: s + x)
    shares = F.transform(labels, lambda x: x / F.when(total == 0, 1.0).otherwise(total))
    target = F.when(F.forall(scores, lambda s: s.isNotNull()), vx.softmax(scores, temperature)).otherwise(shares)
    return df.filter(F.size(_cs(df)) >= 2).select("query", F.transform(_cs(df), lambda c: _doc(df, c)).alias("documents"), target.alias("target"), labels.alias("labels"))


def lists_from_cache(cache: DataFrame, temperature: float = 1.0) -> DataFrame:
    """query_id, documents, teacher_scores, target, labels by doc_id; queries with an unscored row
    are left out."""
    s = F.coalesce("reranker_score", "embedding_score")
    one = F.struct("doc_id", "document", s.alias("s"), F.coalesce("positive", F.lit(False)).cast("double").alias("l"))
    rows = cache.groupBy("query_id").agg(F.array_sort(F.collect_list(one)).alias("x")).filter(F.forall("x", lambda x: x["s"].isNotNull()))
    col = lambda n: F.transform("x", lambda x: x[n])
    return rows.select("query_id", col("document").alias("documents"), col("s").alias("teacher_scores"), vx.softmax(col("s"), temperature).alias("target"), col("l").alias("labels"))


def conservative_lists(df: DataFrame, features: DataFrame, gap_min: float, entropy_max: float | None = None) -> DataFrame:
    """query_id, documents, target, teacher_scores, first_stage_ranks, high_confidence: lists with
    what a rank-preserving loss needs. features: (query_id, features), as policies.features;
    confident lists have a first-stage gap of gap_min, one source and not too much entropy."""
    f = F.col("features")
    sure = (f["first_stage_top1_top2_gap"] >= gap_min) & (f["candidate_source_agreement"] >= 1.0)
    if entropy_max is not None:
        sure = sure & (f["first_stage_score_entropy"] <= entropy_max)
    ranks = F.transform(_cs(df), lambda c, i: F.coalesce(_get(df, c, "first_stage_rank", "int"), i))
    scores = F.transform(_column(df, "teacher_score", "double"), lambda s: F.coalesce(s, F.lit(-10.0)))
    rows = df.join(features, "query_id").filter(F.size(_cs(df)) >= 2)
    return rows.select(
        "query_id", F.transform(_cs(df), lambda c: _doc(df, c)).alias("documents"), _target(df, 1.0, -10.0).alias("target"),
        scores.alias("teacher_scores"), ranks.alias("first_stage_ranks"), sure.alias("high_confidence"),
    )


# ------------------------------------------------------------------ sets for an embedder
def best_positive_examples(cache: DataFrame) -> DataFrame:
    """query_id, positive, pos_score, negatives, neg_scores: the best positive of a query (by
    reranker, else embedding score) and its other documents, hardest first. Where no row of a
    query is flagged, a label above 0 makes a positive. Queries without one are left out."""
    s = F.coalesce("reranker_score", "embedding_score")
    flagged = F.coalesce("positive", F.lit(False))
    labelled = (F.coalesce(F.col("label").cast("double"), F.lit(0.0)) > 0) if "label" in cache.columns else F.lit(False)
    one = lambda low: F.struct(F.coalesce(s, F.lit(low)).alias("k"), F.col("doc_id").alias("d"), F.col("document").alias("t"), s.alias("s"))
    best_first = lambda test, low: F.array_sort(F.collect_list(F.when(test, one(low))), _better)
    rows = cache.withColumns({"_p": flagged, "_l": labelled}).groupBy("query_id").agg(
        best_first(F.col("_p"), 0.0).alias("p"), best_first(F.col("_l"), 0.0).alias("l"), best_first(~F.col("_p"), float("-inf")).alias("n")
    )
    best = F.coalesce(F.get("p", F.lit(0)), F.get("l", F.lit(0)))
    rows = rows.withColumn("b", best).filter("b is not null")
    n = F.filter("n", lambda x: x["d"] != F.col("b")["d"])
    return rows.select(
        "query_id", F.col("b")["t"].alias("positive"), F.col("b")["s"].alias("pos_score"),
        F.transform(n, lambda x: x["t"]).alias("negatives"), F.transform(n, lambda x: x["s"]).alias("neg_scores"),
    )


def _better(a: Column, b: Column) -> Column:
    return F.when(a["k"] > b["k"], -1).when(a["k"] < b["k"], 1).when(a["d"] < b["d"], -1).when(a["d"] > b["d"], 1).otherwise(0)


def from_mined(mined: DataFrame) -> DataFrame:
    """query, positive, negatives, neg_scores of mined rows (negatives: array of document, score)."""
    return mined.select(
        "query", "positive", F.transform("negatives", lambda n: n["document"]).alias("negatives"), F.transform("negatives", lambda n: n["score"].cast("double")).alias("neg_scores")
    )


def embedder_set(pairs: DataFrame, mined: DataFrame, scores: DataFrame, threshold: float = 4.0) -> DataFrame:
    """query, positive, negatives, pos_score, neg_scores, domain. Pairs (query, document, domain,
    must_teacher_validate, teacher_score): provisional ones only with a score of the threshold.
    mined: triplets (query, positive, negative, positive_score, negative_score, domain), gathered
    by query and positive. scores: (query, document, teacher_score). Leaking rows are left out;
    `leaks` reports them."""
    text = lambda c: F.trim(F.coalesce(c, F.lit(""))) != ""
    clean = pairs.filter(contracts.leakage_reason(pairs).isNull() & text(F.col("query")) & text(F.col("document")))
    kept = clean.filter(contracts.training_ready(clean, threshold))
    known = scores.groupBy("query", "document").agg(F.max("teacher_score").alias("pos_score"))
    none = F.array().cast
    own = kept.join(known, ["query", "document"], "left").select(
        "query", F.col("document").alias("positive"), none("array<string>").alias("negatives"), "pos_score", none("array<double>").alias("neg_scores"),
        F.coalesce("domain", F.lit("unknown")).alias("domain"),
    )
    x = F.array_sort(F.collect_list(F.struct("negative", "negative_score")))
    grouped = mined.filter(contracts.leakage_reason(mined).isNull()).groupBy("query", "positive").agg(
        x.alias("x"), F.max("positive_score").alias("pos_score"), F.min("domain").alias("domain")
    )
    more = grouped.select(
        "query", "positive", F.transform("x", lambda n: n["negative"]).alias("negatives"), "pos_score",
        F.transform("x", lambda n: n["negative_score"]).alias("neg_scores"), F.coalesce("domain", F.lit("webfaq2")).alias("domain"),
    )
    return own.unionByName(more)


def leaks(**named: DataFrame) -> DataFrame:
    """name, reason, n of rows that must not train."""
    parts = [df.select(F.lit(name).alias("name"), contracts.leakage_reason(df).alias("reason")).filter("reason is not null") for name, df in named.items()]
    return reduce(DataFrame.unionByName, parts).groupBy("name", "reason").agg(F.count(F.lit(1)).alias("n"))


def is_faq(domain: Column) -> Column:
    return F.lower(F.coalesce(domain, F.lit(""))).contains("faq")


def interleaved(examples: DataFrame, key: str, cap: float = DEFAULT_FAQ) -> DataFrame:
    """Examples with place: at most `cap` of them from FAQ domains, taken at an even stride in the
    order of key, then domains in turn. Places within a domain come from ranges, not one task."""
    from sedimark.sources.records import with_shards

    marked = examples.withColumn("_faq", is_faq(F.col("domain")))
    n_faq, n_other = marked.agg(F.count_if("_faq"), F.count_if(~F.col("_faq"))).first()
    most = int(cap / (1 - cap) * n_other) if 0 < cap < 1 else n_faq
    if n_faq > most:
        stride = n_faq / most if most else 1.0
        faq = with_shards(marked.filter("_faq"), [key], 1).withColumnRenamed("shard", "_at")
        # Row i is taken if it is floor(j * stride) for some j below most.
        j = F.ceil(F.col("_at") / stride)
        taken = (F.floor(j * stride) == F.col("_at")) & (j < most)
        marked = faq.filter(taken).drop("_at").unionByName(marked.filter("not _faq"))
    w = Window.partitionBy("domain").orderBy(key)
    return marked.drop("_faq").withColumn("turn", F.row_number().over(w) - 1)


def rank_promotion(mined: DataFrame, top: int = 50, window: int = 200, most: int | None = None) -> DataFrame:
    """query, positive, negative, domain, positive_rank, negative_rank, teacher_score, margin: a row
    per negative (array of text, rank, teacher_score, margin) of the queries whose positive ranks
    in (top, window]."""
    rows = mined.filter((F.col("positive_rank") > top) & (F.col("positive_rank") <= window) & contracts.leakage_reason(mined).isNull())
    n = F.filter("negatives", lambda x: F.coalesce(x["text"], F.lit("")) != "")
    n = F.slice(n, 1, most) if most is not None else n
    return rows.select("query", "positive", F.coalesce("domain", F.lit("unknown")).alias("domain"), "positive_rank", F.explode(n).alias("n")).select(
        "query", "positive", F.col("n.text").alias("negative"), "domain", "positive_rank", F.col("n.rank").alias("negative_rank"), "n.teacher_score", "n.margin"
    )


# ------------------------------------------------------------------ imported hard negatives
def margins(df: DataFrame, least: float = 2.0, most: int = 32, false_negative: float = 0.5) -> DataFrame:
    """df (rows of contracts.import_rows) with kept (hardest first, at most `most`), kept_total,
    false_negatives, insufficient, margins. A negative is kept if the positive's score is higher
    by `least`; one within `false_negative` of it is likely no negative."""
    ns = F.filter("negatives", lambda n: (F.trim(F.coalesce(n["document"], F.lit(""))) != "") & n["score"].isNotNull())
    key = lambda d: F.concat(F.lit("d"), F.substring(F.sha2(d, 256), 1, 20))
    each = F.transform(ns, lambda n: F.struct((F.col("positive_score") - n["score"]).alias("margin"), key(n["document"]).alias("doc_id"), n["document"].alias("document"), n["score"].alias("score")))
    df = df.withColumn("_m", F.array_sort(each))
    part = lambda test: F.filter("_m", lambda n: test(n["margin"]))
    kept = part(lambda m: m >= least)
    return df.withColumns(
        {
            "kept": F.slice(kept, 1, most), "kept_total": F.size(kept),
            "false_negatives": part(lambda m: (m < least) & (m <= false_negative)),
            "insufficient": part(lambda m: (m < least) & (m > false_negative)),
            "margins": F.transform("_m", lambda n: n["margin"]),
        }
    ).drop("_m")


def triplets(df: DataFrame) -> DataFrame:
    """query, positive, negative, teacher_margin, positive_score, negative_score, license: a row per
    kept negative of margins."""
    return df.select("query", "positive", "positive_score", "license", F.explode("kept").alias("n")).select(
        "query", "positive", F.col("n.document").alias("negative"), F.round("n.margin", 6).alias("teacher_margin"), "positive_score",
        F.col("n.score").alias("negative_score"), "license",
    )


def reranker_lists(df: DataFrame) -> DataFrame:
    """query_id, query, license, candidates (doc_id, document, teacher_score, is_positive, target):
    the positive and the kept negatives of margins."""
    key = lambda d: F.concat(F.lit("d"), F.substring(F.sha2(d, 256), 1, 20))
    one = lambda i, d, s, p: F.struct(i.alias("doc_id"), d.alias("document"), s.alias("teacher_score"), F.lit(p).alias("is_positive"))
    both = F.concat(
        F.array(one(key(F.col("positive")), F.col("positive"), F.col("positive_score"), True)),
        F.transform("kept", lambda n: one(n["doc_id"], n["document"], n["score"], False)),
    )
    soft = vx.softmax(F.transform(both, lambda c: c["teacher_score"]))
    return df.select("query_id", "query", "license", F.zip_with(both, soft, lambda c, t: c.withField("target", F.round(t, 6))).alias("candidates"))


def import_report(df: DataFrame) -> DataFrame:
    """One row over margins: records, kept, false_negatives, insufficient, negatives a record (avg,
    min, max)."""
    n = F.size("kept")
    return df.agg(
        F.count(F.lit(1)).alias("records"), F.sum(n).alias("kept"), F.sum(F.size("false_negatives")).alias("false_negatives"),
        F.sum(F.size("insufficient")).alias("insufficient"), F.round(F.avg(n), 4).alias("avg"), F.min(n).alias("min"), F.max(n).alias("max"),
    )


def margin_histogram(df: DataFrame, cap: int = 5) -> DataFrame:
    rows = df.select(F.explode("margins").alias("m"))
    return rows.groupBy(tx.margin_bucket(F.col("m"), cap).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ reports
def summary(df: DataFrame, threshold: float = 4.0) -> DataFrame:
    """domain (null: all), positives, negatives, uncertain, synthetic share, medians of both sides'
    scores and their distance, the lowest positive score, high_precision."""
    list_domain = F.col("domain") if "domain" in df.columns else F.lit(None).cast("string")
    c = df.select(list_domain.alias("_d"), F.explode(_cs(df)).alias("c"))
    field = lambda n, k: _get(df, F.col("c"), n, k)
    rows = c.select(
        tx.unknown(F.coalesce(F.nullif(field("domain", "string"), F.lit("")), "_d")).alias("domain"), field("label", "int").alias("l"),
        field("teacher_score", "double").alias("s"), F.coalesce(field("synthetic", "boolean"), F.lit(False)).alias("syn"),
    )
    side = lambda want: F.when(F.col("l") == want, F.col("s"))
    pos, neg = F.round(F.median(side(1)), 4), F.round(F.median(side(0)), 4)
    low = F.round(F.min(side(1)), 4)
    return rows.rollup("domain").agg(
        F.count_if(F.col("l") == 1).alias("positives"), F.count_if(F.col("l") == 0).alias("negatives"), F.count_if(F.col("l").isNull()).alias("uncertain"),
        F.round(F.avg(F.col("syn").cast("int")), 4).alias("synthetic_share"), pos.alias("pos_median"), neg.alias("neg_median"),
        F.round(pos - neg, 4).alias("separation"), low.alias("min_positive"), (low.isNull() | (low >= threshold)).alias("high_precision"),
    )


def candidate_sources(df: DataFrame) -> DataFrame:
    """source, n over candidates; 'a+b' counts for both."""
    s = df.select(F.explode(_cs(df)).alias("c")).select(F.explode(F.split(tx.unknown(_get(df, F.col("c"), "candidate_source", "string")), r"\+")).alias("source"))
    return s.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def separation(df: DataFrame, threshold: float = 4.0) -> DataFrame:
    """domain (null: all), lists, faq_share, gold, hard_negatives, uncertain, teacher_only (unlabelled
    but scored like a positive), upper medians of both sides, counted by value so that no group
    is gathered."""
    c = df.select(tx.unknown(F.col("domain")).alias("domain"), F.explode(_cs(df)).alias("c"))
    field = lambda n, k: _get(df, F.col("c"), n, k)
    c = c.select("domain", field("label", "int").alias("l"), field("teacher_score", "double").alias("s"), F.coalesce(field("uncertain", "boolean"), F.lit(False)).alias("u"))
    counts = c.rollup("domain").agg(
        F.count_if(F.col("l") == 1).alias("gold"), F.count_if(F.col("l") == 0).alias("hard_negatives"), F.count_if("u").alias("uncertain"),
        F.count_if(F.col("u") & F.col("l").isNull() & (F.col("s") >= threshold)).alias("teacher_only"),
    )
    per_list = df.select(tx.unknown(F.col("domain")).alias("domain")).rollup("domain").agg(
        F.count(F.lit(1)).alias("lists"), F.round(F.avg(F.col("domain").isin(*FAQ_DOMAINS).cast("int")), 4).alias("faq_share")
    )
    sides = c.filter("l is not null and s is not null").select(F.explode(F.array("domain", F.lit(None).cast("string"))).alias("domain"), "l", "s")
    m = upper_medians(sides, "s", ["domain", "l"])
    m = m.groupBy("domain").agg(F.max(F.when(F.col("l") == 1, F.col("upper_median"))).alias("pos_median"), F.max(F.when(F.col("l") == 0, F.col("upper_median"))).alias("neg_median"))
    out = per_list.alias("a").join(counts.alias("b"), F.col("a.domain").eqNullSafe(F.col("b.domain")), "left")
    out = out.join(m.alias("m"), F.col("a.domain").eqNullSafe(F.col("m.domain")), "left")
    return out.select(
        "a.domain", "lists", "faq_share", "gold", "hard_negatives", "uncertain", "teacher_only", F.round("pos_median", 4).alias("pos_median"),
        F.round("neg_median", 4).alias("neg_median"), F.round(F.col("pos_median") - F.col("neg_median"), 4).alias("separation"),
    )


def upper_medians(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """The element at n // 2 of the sorted values of each group, from counts by value: a group may
    be of any size, a window sorts its distinct values."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_n"))
    own = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    upto = F.sum("_n").over(own.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    middle = F.floor(F.sum("_n").over(own) / 2)
    rows = counts.withColumns({"_upto": upto, "_at": middle}).filter((F.col("_upto") > F.col("_at")) & (F.col("_upto") - F.col("_n") <= F.col("_at")))
    return rows.select(*by, F.col(value).alias("upper_median"))


def set_metadata(examples: DataFrame) -> DataFrame:
    """One row: examples, with_negatives, negatives, avg_negatives, with_scores."""
    n = F.greatest(F.coalesce(F.size("negatives"), F.lit(0)), F.lit(0))
    return examples.agg(
        F.count(F.lit(1)).alias("examples"), F.count_if(n > 0).alias("with_negatives"), F.sum(n).alias("negatives"),
        F.round(F.avg(n), 4).alias("avg_negatives"), F.count_if(F.col("pos_score").isNotNull()).alias("with_scores"),
    )
