"""Canonical rows and contracts.

A contract is a dict of rule name -> Column that is true where a row breaks it; `checked` (records)
turns it into an `errors` column and `report` counts over several contracts in one pass each.
Rules never raise: a null counts as the value missing. Lists of candidates are arrays of structs.

Edge cases. Null and blank strings are missing; a null flag is not a flag. Empty tables give an
empty report. Repeated rows count each. Columns a contract doesn't name are left alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimark.functions import text as tx
from sedimark.operators.records import blank, checked, negative_rules, required, training_rules

# Fixed values.
ANSWER_TYPES = ["fact", "definition", "procedure", "faq", "multi_hop", "other"]
CANDIDATE_SOURCES = ["bm25", "dense", "e5", "qwen", "manual", "webfaq_hardneg"]
SOURCE_TYPES = ["local_jsonl", "hf_dataset", "synthetic", "derived"]
LOADER_KINDS = ["jsonl", "hf"]
MIXER_LICENSES = [*tx.ALLOWED_LICENSES, "synthetic-inherits-source"]
MIXER_DOMAINS = ["faq_real", "qa_passage_non_eval", "web_nonfaq", "long_doc_chunks", "local_rag", "german_stress"]
BENCHMARK_TOKENS = [
    "germanquad", "dt_test", "gerdalir", "webfaq_heldout", "germandpr", "miracl", "mldr", "sts22", "mmteb", "mteb",
]
GUARDRAIL_TOKENS = [t for t in BENCHMARK_TOKENS if t != "webfaq_heldout"]
SOURCE_DOMAINS = ["web", "faq", "admin", "legal_adjacency_no_eval_overlap", "wiki_non_eval", "german_stress", "cross_lingual_de_en"]
EVAL_DOMAINS = ["qa_wiki", "legal", "sts", "clustering"]
ACQUIRED_TYPES = ["local_jsonl", "local_corpus_jsonl", "hf_dataset", "url_manifest"]
ACQUIRED_DOMAINS = [
    "faq_real", "admin_real", "legal_adjacency_real_no_eval_overlap", "web", "wiki_non_eval", "german_stress", "cross_lingual_de_en",
]


def _has(df: DataFrame, c: str, kind: str = "string") -> Column:
    return F.col(c) if c in df.columns else F.lit(None).cast(kind)


def _or(first: Column, *rest: Column) -> Column:
    """The first value that isn't null or empty."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in (first, *rest)))


# ------------------------------------------------------------------ canonical rows
def canonical_pairs(
    df: DataFrame, default_source: str = "unknown", default_domain: str = "unknown", default_license: str = "unknown"
) -> DataFrame:
    """query_id, doc_id, query, document, positive, source, domain, license, metadata: texts in
    NFC with single spaces, ids from their hashes where missing or empty, defaults where a field
    is missing or empty. Columns that df doesn't have count as null."""
    query, document = (tx.nfc_collapsed(F.coalesce(_has(df, c), F.lit(""))) for c in ("query", "document"))
    rows = df.withColumns({"_query": query, "_document": document})
    field = lambda c, default: _or(_has(df, c).cast("string"), F.lit(default)).alias(c)
    empty = F.create_map().cast("map<string,string>")
    return rows.select(
        _or(_has(df, "query_id").cast("string"), F.concat(F.lit("q"), tx.raw_hash(F.col("_query")))).alias("query_id"),
        _or(_has(df, "doc_id").cast("string"), F.concat(F.lit("d"), tx.raw_hash(F.col("_document")))).alias("doc_id"),
        F.col("_query").alias("query"),
        F.col("_document").alias("document"),
        F.coalesce(_has(df, "positive", "boolean"), F.lit(True)).alias("positive"),
        field("source", default_source),
        field("domain", default_domain),
        field("license", default_license),
        F.coalesce(_has(df, "metadata", "map<string,string>"), empty).alias("metadata"),
    )


def provenance_rows(
    df: DataFrame, source_id: Column, domain: Column, license: Column, license_origin: Column, allowed: Column,
    synthetic: Column, source_url: Column | None = None, passages: bool = False,
) -> DataFrame:
    """Rows with full provenance: pairs of df's query and document, or (passages) documents alone,
    for which no query is made up."""
    rows = df.withColumn("_d", tx.nfc_collapsed(F.coalesce("document", F.lit(""))))
    url = source_url if source_url is not None else F.lit(None).cast("string")
    common = [
        F.col("_d").alias("document"), source_id.alias("source_id"), source_id.alias("source"), domain.alias("domain"),
        license.alias("license"), license_origin.alias("license_origin"), allowed.cast("boolean").alias("allowed_for_training"),
        synthetic.cast("boolean").alias("synthetic"), tx.raw_hash(F.col("_d")).alias("text_hash"), F.nullif(url, F.lit("")).alias("source_url"),
    ]
    doc_id = F.concat(F.lit("d"), tx.raw_hash(F.col("_d"))).alias("doc_id")
    if passages:
        return rows.select(F.lit("passage").alias("record_type"), doc_id, *common)
    rows = rows.withColumn("_q", tx.nfc_collapsed(F.coalesce("query", F.lit(""))))
    return rows.select(
        F.lit("pair").alias("record_type"), F.concat(F.lit("q"), tx.raw_hash(F.col("_q"))).alias("query_id"), doc_id,
        F.col("_q").alias("query"), F.lit(True).alias("positive"), tx.raw_pair(F.col("_q"), F.col("_d")).alias("pair_hash"), *common,
    )


def import_rows(df: DataFrame) -> DataFrame:
    """Rows of several shapes as query_id, query, positive, positive_score, negatives (array of
    document, score, title, url), language, license, title, source_url. Of several names for a
    field the first that isn't null or empty counts, and a score of 0 counts as missing. Negatives
    are structs, or strings with negative_scores beside them."""
    text = lambda *names: _or(*(_has(df, n) for n in names))
    scores = ("positive_score", "positive_cross_encoder_score", "positive_ce_score")
    score = F.coalesce(*(F.nullif(_has(df, n, "double"), F.lit(0.0)) for n in scores))
    name = next((n for n in ("negatives", "hard_negatives") if n in df.columns), None)
    kind = "array<struct<document:string,score:double,title:string,url:string>>"
    if name is None:
        negatives = F.array().cast(kind)
    else:
        fields = getattr(df.schema[name].dataType.elementType, "names", None)
        if fields is None:
            beside = next((n for n in ("negative_scores", "negative_cross_encoder_scores") if n in df.columns), None)
            at = (lambda i: F.get(F.col(beside), i).cast("double")) if beside else (lambda i: F.lit(None).cast("double"))
            one = lambda n, i: F.struct(n.alias("document"), at(i).alias("score"), F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("url"))
        else:
            pick = lambda n, names, k: F.coalesce(*(n[x].cast(k) for x in names if x in fields), F.lit(None).cast(k))
            one = lambda n, i: F.struct(
                pick(n, ("document", "text", "passage"), "string").alias("document"),
                pick(n, ("cross_encoder_score", "score", "ce_score"), "double").alias("score"),
                pick(n, ("title",), "string").alias("title"),
                pick(n, ("url", "source_url"), "string").alias("url"),
            )
        negatives = F.transform(F.coalesce(F.col(name), F.array().cast(df.schema[name].dataType)), one)
    query = text("query", "question")
    return df.select(
        _or(_has(df, "query_id").cast("string"), F.concat(F.lit("d"), F.substring(F.sha2(query, 256), 1, 20))).alias("query_id"),
        query.alias("query"),
        text("positive", "positive_document", "answer", "document").alias("positive"),
        score.alias("positive_score"),
        negatives.alias("negatives"),
        text("language", "lang").alias("language"),
        _has(df, "license").alias("license"),
        _has(df, "title").alias("title"),
        text("source_url", "url").alias("source_url"),
    )


# ------------------------------------------------------------------ predicates
def names_benchmark(x: Column, tokens: list[str] = BENCHMARK_TOKENS) -> Column:
    """A public benchmark's name occurs."""
    return F.lower(F.coalesce(x, F.lit(""))).rlike("|".join(tokens))


def leakage_reason(df: DataFrame) -> Column:
    """Why a row must not train, the first reason; null if clean."""
    reason = F.when(F.coalesce(_has(df, "public_benchmark", "boolean"), F.lit(False)), "public_benchmark=true").when(
        F.coalesce(_has(df, "eval_only", "boolean"), F.lit(False)), "eval_only=true"
    )
    for c in ("source_id", "source_url", "domain"):
        if c in df.columns:
            reason = reason.when(names_benchmark(F.col(c)), f"{c} references a public benchmark")
    return reason


def is_synthetic(df: DataFrame, supplemental: list[str]) -> Column:
    """Flagged, of inherited licence, from a supplemental source, or named so."""
    flag = F.coalesce(_has(df, "synthetic", "boolean"), F.lit(False))
    source = F.lower(F.coalesce(_has(df, "source"), F.lit("")))
    inherited = F.coalesce(_has(df, "license_origin") == "inherited", F.lit(False)) | tx.license_of(_has(df, "license")).contains("inherit")
    return flag | inherited | source.isin(*[s.lower() for s in supplemental]) | source.contains("synthetic")


def is_excluded(df: DataFrame, tokens: list[str], candidates: str | None = "candidates") -> Column:
    """A token or a public benchmark is named in domain, source, query_id or a candidate's source."""
    own = F.concat_ws(" ", *(_has(df, c).cast("string") for c in ("domain", "source", "query_id")))
    if candidates and candidates in df.columns:
        own = F.concat_ws(" ", own, F.array_join(F.transform(F.col(candidates), lambda c: F.coalesce(c["candidate_source"], F.lit(""))), " "))
    named = F.lit(False)
    for t in tokens:
        named = named | F.lower(own).contains(t.lower())
    return named | names_benchmark(own, GUARDRAIL_TOKENS)


def training_ready(df: DataFrame, threshold: float) -> Column:
    """A row that a teacher must validate needs a score of at least threshold."""
    passed = F.coalesce(F.col("teacher_score") >= threshold, F.lit(False))
    return ~F.coalesce(_has(df, "must_teacher_validate", "boolean"), F.lit(False)) | passed


# ------------------------------------------------------------------ contracts
def candidate_rules(strict: bool = True) -> dict[str, Column]:
    """Candidate pairs: strict for those that train (positive is a flag), else for those to be
    scored (positive may be null, source and licence missing)."""
    names = ("query_id", "doc_id", "query", "document", "source", "domain", "license") if strict else ("query_id", "doc_id", "query", "document")
    return required(*names) | ({"positive_not_bool": F.col("positive").isNull()} if strict else {})


def eval_query_rules() -> dict[str, Column]:
    """Queries: texts, positives, and a known answer type in metadata."""
    ids = F.coalesce(F.col("positive_doc_ids"), F.array().cast("array<string>"))
    kind = F.col("metadata")["answer_type"]
    return required("query_id", "query", "domain", "source") | {
        "positive_doc_ids": (F.size(ids) == 0) | F.exists(ids, lambda p: F.coalesce(p, F.lit("")) == ""),
        "answer_type": kind.isNotNull() & ~kind.isin(*ANSWER_TYPES),
    }


def corpus_rules() -> dict[str, Column]:
    return required("doc_id", "text", "source", "domain", "license")


def candidate_list_rules(require_positive: bool = False) -> dict[str, Column]:
    """Lists: candidates (doc_id, text, candidate_source, label) and positive_doc_ids."""
    cs = F.col("candidates")
    any_of = lambda f: F.coalesce(F.exists(cs, f), F.lit(False))
    empty = F.coalesce(F.size(cs), F.lit(0)) <= 0
    rules = required("query_id", "query") | {
        "candidates_empty": empty,
        "candidate_without_id": any_of(lambda c: F.coalesce(c["doc_id"], F.lit("")) == ""),
        "candidate_without_text": any_of(lambda c: c["text"].isNull()),
        "candidate_source_unknown": any_of(lambda c: c["candidate_source"].isNotNull() & ~c["candidate_source"].isin(*CANDIDATE_SOURCES)),
        "candidate_label": any_of(lambda c: c["label"].isNotNull() & ~c["label"].isin(0, 1)),
    }
    if require_positive:
        present = any_of(lambda c: F.coalesce(F.array_contains("positive_doc_ids", c["doc_id"]), F.lit(False)) | (F.coalesce(c["label"], F.lit(0)) == 1))
        rules["no_positive"] = ~empty & ~present
    return rules


def mixer_rules() -> dict[str, Column]:
    return required("source_id", "domain", "query", "document", "license") | {
        "domain_unknown": ~blank("domain") & ~F.col("domain").isin(*MIXER_DOMAINS),
        "synthetic_query_not_bool": F.col("synthetic_query").isNull(),
    }


def import_rules() -> dict[str, Column]:
    """Rows of import_rows, fail-closed on the licence."""
    return required("query", "positive") | {
        "positive_score": F.col("positive_score").isNull(),
        "license": tx.is_unknown_license(F.col("license"), MIXER_LICENSES),
        "negatives_empty": F.coalesce(F.size("negatives"), F.lit(0)) <= 0,
    }


def passage_rules(df: DataFrame) -> dict[str, Column]:
    return required("source_passage_id", "document", "domain", "license") | {
        "license_unknown": tx.is_unknown_license(F.col("license"), MIXER_LICENSES),
        "leakage": leakage_reason(df).isNotNull(),
    }


def generated_rules(styles: list[str]) -> dict[str, Column]:
    """Generated questions: provisional until a teacher has scored them."""
    names = ("source_passage_id", "query", "document", "query_style", "generation_method", "license", "source_id", "domain")
    return required(*names) | {
        "synthetic_query": ~F.coalesce("synthetic_query", F.lit(False)),
        "must_teacher_validate": ~F.coalesce("must_teacher_validate", F.lit(False)),
        "query_style_unknown": ~F.coalesce(F.col("query_style").isin(*styles), F.lit(False)),
        "license_unknown": tx.is_unknown_license(F.col("license"), MIXER_LICENSES),
    }


def _allowed() -> Column:
    return F.coalesce("allowed_for_training", F.lit(False))


def _flag(c: str) -> Column:
    return F.coalesce(c, F.lit(False))


def source_rules() -> dict[str, Column]:
    """A manifest's sources (loader: struct of kind, path_or_id). Training fails closed: no
    benchmark, no evaluation source, no uncertain licence, only a training domain."""
    return required("source_id", "license") | {
        "source_type_unknown": ~F.coalesce(F.col("source_type").isin(*SOURCE_TYPES), F.lit(False)),
        "domain_unknown": ~F.coalesce(F.col("domain").isin(*SOURCE_DOMAINS, *EVAL_DOMAINS), F.lit(False)),
        "flag_missing": F.col("allowed_for_training").isNull() | F.col("public_benchmark").isNull() | F.col("eval_only").isNull(),
        "loader": ~F.coalesce(F.col("loader")["kind"].isin(*LOADER_KINDS), F.lit(False))
        | F.trim(F.coalesce(F.col("loader")["path_or_id"], F.lit(""))).isin(""),
        "trains_on_benchmark": _allowed() & _flag("public_benchmark"),
        "trains_on_eval": _allowed() & _flag("eval_only"),
        "trains_on_uncertain_license": _allowed() & ~blank("license") & tx.license_is_uncertain(F.col("license")),
        "trains_outside_domains": _allowed() & F.col("domain").isNotNull() & ~F.col("domain").isin(*SOURCE_DOMAINS),
    }


def acquired_source_rules() -> dict[str, Column]:
    """The stricter manifest: a training source has a verified, concrete licence and no overlap
    with evaluation data."""
    uncertain = tx.license_is_uncertain(F.col("license"))
    return required("source_id", "display_name", "domain", "source_type", "license") | {
        "source_type_unknown": ~F.coalesce(F.col("source_type").isin(*ACQUIRED_TYPES), F.lit(False)),
        "domain_unknown": ~F.coalesce(F.col("domain").isin(*ACQUIRED_DOMAINS), F.lit(False)),
        "loader": F.col("loader").isNull(),
        "trains_unverified": _allowed() & ~_flag("license_verified"),
        "trains_on_uncertain_license": _allowed() & uncertain,
        "trains_on_benchmark": _allowed() & _flag("public_benchmark"),
        "trains_on_eval": _allowed() & _flag("eval_only"),
        "trains_with_overlap": _allowed() & _flag("contains_eval_overlap_risk"),
        "verified_but_uncertain": _flag("license_verified") & uncertain,
    }


def local_row_rules(df: DataFrame) -> dict[str, Column]:
    """An id of any kind, a text or a pair, a source and a licence."""
    there = lambda c: (F.trim(F.coalesce(_has(df, c).cast("string"), F.lit(""))) != "") if c in df.columns else F.lit(False)
    return {
        "id": ~(there("id") | there("doc_id") | there("query_id")),
        "text": ~(there("text") | (there("query") & there("document"))),
        "source_id": ~there("source_id"),
        "license": ~there("license"),
    }


def task_rules() -> dict[str, Column]:
    """Benchmark tasks are for evaluation only and name a metric."""
    return {
        "not_eval_only": ~_flag("eval_only"),
        "trainable": _allowed(),
        "metric": blank("metric"),
    }


def ranked_list_rules() -> dict[str, Column]:
    """What serving asks of a list: a query id, and candidates with an id and a first-stage rank
    or score."""
    cs = F.col("candidates")
    return required("query_id") | {
        "candidates_empty": F.coalesce(F.size(cs), F.lit(0)) <= 0,
        "candidate_without_id": F.coalesce(F.exists(cs, lambda c: F.coalesce(c["doc_id"].cast("string"), F.lit("")) == ""), F.lit(False)),
        "candidate_without_order": F.coalesce(
            F.exists(cs, lambda c: c["first_stage_rank"].isNull() & c["first_stage_score"].isNull()), F.lit(False)
        ),
    }


def listwise_rules() -> dict[str, Column]:
    """Training lists: two candidates, a positive, and a teacher's signal on some candidate."""
    cs = F.col("candidates")
    has = lambda f: F.coalesce(F.exists(cs, f), F.lit(False))
    return {
        "too_few_candidates": F.coalesce(F.size(cs), F.lit(0)) < 2,
        "no_positive": ~has(lambda c: F.coalesce(c["label"], F.lit(0)) == 1),
        "no_teacher_signal": ~has(lambda c: c["teacher_score"].isNotNull()),
    }


# ------------------------------------------------------------------ reports
def report(named: dict[str, tuple[DataFrame, dict[str, Column]]]) -> DataFrame:
    """contract, error, n over several (rows, rules); one pass over the rows of each."""
    parts = [
        checked(rows, rules).select(F.lit(name).alias("contract"), F.explode("errors").alias("error"))
        for name, (rows, rules) in named.items()
    ]
    return reduce(DataFrame.unionByName, parts).groupBy("contract", "error").agg(F.count(F.lit(1)).alias("n"))


def dataset_report(df: DataFrame) -> DataFrame:
    """One row: rows, invalid rows, rows with negatives, negatives, distinct licences (sorted),
    disallowed ones (sorted), and counts of negative types (a map)."""
    rows = checked(df, training_rules() | negative_rules())
    lic = tx.license_of(F.col("license"))
    types = (
        df.select(F.explode("neg_types").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
        .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("t", "n")))).alias("neg_types"))
    )
    n = F.coalesce(F.size("negatives"), F.lit(0))
    one = rows.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.size("errors") > 0).alias("invalid"),
        F.count_if(n > 0).alias("with_negatives"),
        F.sum(F.greatest(n, F.lit(0))).alias("negatives"),
        F.array_sort(F.collect_set(lic)).alias("licenses"),
        F.array_sort(F.collect_set(F.when(~lic.isin(*tx.ALLOWED_LICENSES), lic))).alias("disallowed"),
    )
    return one.crossJoin(F.broadcast(types))  # both one row


def disallowed_licenses(df: DataFrame) -> DataFrame:
    lic = tx.license_of(F.col("license")).alias("license")
    return df.select(lic).filter(~F.col("license").isin(*tx.ALLOWED_LICENSES)).distinct().orderBy("license")


def repeated(df: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once: duplicate ids of a manifest."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def eval_in_training(train: DataFrame, eval_queries: DataFrame, eval_docs: DataFrame) -> DataFrame:
    """query_id, doc_id (null: the query itself) of training rows (query_id, doc_id, candidates)
    that touch an evaluation query or document."""
    ids = F.array_distinct(F.array_append(F.transform(F.coalesce("candidates", F.array().cast("array<struct<doc_id:string>>")), lambda c: c["doc_id"]), F.col("doc_id")))
    queries = train.select("query_id").join(eval_queries.select("query_id").distinct(), "query_id", "left_semi")
    docs = train.select("query_id", F.explode(ids).alias("doc_id")).join(eval_docs.select("doc_id").distinct(), "doc_id", "left_semi")
    return queries.select("query_id", F.lit(None).cast("string").alias("doc_id")).unionByName(docs.select("query_id", "doc_id"))


def trainable_benchmarks(tasks: DataFrame, manifest: DataFrame) -> DataFrame:
    """Tasks whose dataset the manifest allows for training."""
    trained = manifest.filter("allowed_for_training").select(F.lower("source_id").alias("_s"))
    return tasks.join(trained, F.lower("dataset") == F.col("_s"), "left_semi")


def faq_eval(rows: DataFrame, split: str = "test", dev: float = 0.1, test: float = 0.1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Corpus, queries and judgements of the pairs (query, document) whose query falls into the
    split; the corpus has each document once."""
    q, d = (F.trim(F.coalesce(c, F.lit(""))) for c in ("query", "document"))
    kept = rows.select(q.alias("query"), d.alias("text")).filter((F.col("query") != "") & (F.col("text") != ""))
    kept = kept.filter(tx.split_of(F.col("query"), dev, test) == split).select(
        F.concat(F.lit("q"), F.substring(F.md5("query"), 1, 16)).alias("query_id"),
        F.concat(F.lit("d"), F.substring(F.md5("text"), 1, 16)).alias("doc_id"),
        "query",
        "text",
    )
    corpus = kept.select("doc_id", "text").distinct()
    queries = kept.groupBy("query_id", "query").agg(F.array_sort(F.collect_set("doc_id")).alias("positive_doc_ids"))
    return corpus, queries, kept.select("query_id", "doc_id").distinct().withColumn("relevance", F.lit(1))


def near_ceiling(lists: DataFrame, ndcg: float = 0.95, oracle: float = 0.98, candidates: int = 20, sources: int = 1) -> Column:
    """Over per-list metrics (fs_ndcg, oracle_ndcg, hit10, candidates, sources): the five
    thresholds of a guardrail."""
    return (
        (F.col("fs_ndcg") >= ndcg) & (F.col("oracle_ndcg") >= oracle) & F.col("hit10") & (F.col("candidates") >= candidates) & (F.col("sources") >= sources)
    )


def guardrail(lists: DataFrame, size: int = 1000, train_queries: DataFrame | None = None) -> DataFrame:
    """The first `size` near-ceiling lists in hash order, with overlap: also a training query.
    The order is a top-k by hash, so no task sorts all lists."""
    chosen = lists.filter(near_ceiling(lists)).orderBy(F.md5(F.col("query_id").cast("string")), "query_id").limit(size)
    if train_queries is None:
        return chosen.withColumn("overlap", F.lit(False))
    known = train_queries.select("query_id").distinct().withColumn("_t", F.lit(True))
    return chosen.join(known, "query_id", "left").withColumn("overlap", F.coalesce("_t", F.lit(False))).drop("_t")


def first_of_each(df: DataFrame, key: list[str], order: list) -> DataFrame:
    w = Window.partitionBy(*key).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth")
