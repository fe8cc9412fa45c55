"""Further queries over the reference's own operators: contracts, canonical rows, training sets,
teacher caches, policies, gates, hybrid retrieval, generated questions, admission, indexes. They
register with the catalogue; roles of the tables are as described there."""

from __future__ import annotations

import functools
import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedimark.functions import inference, nested, questions
from sedimark.functions import text as tx
from sedimark.functions import vectors as vx
from sedimark.operators import admission, aggregates, contracts, fusion, gates, leakage, lexical, lists, merging, metrics, policies, records, retrieval, teacher, training
from sedimark.plans.catalogue import (
    HARD,
    HASH60,
    LISTS,
    NFC,
    PAIRS,
    TOKENS_DE,
    COLLAPSED,
    _asked,
    _bm25,
    _bounded_sql,
    _cells,
    _all_parents,
    _corpus,
    _lists,
    _ndcg,
    _pairs,
    _passages,
    _r,
    _relevant,
    _t,
    _two,
    _vectors,
    _with_sources,
    query,
)
from sedimark.sources import scratch

def _n():
    return F.count(F.lit(1)).alias("n")


def _pick(key, *values):
    """One of the values by a number, null for None."""
    each = [F.lit(v).cast("string") for v in values]
    return F.element_at(F.array(*each), (F.col(key) % len(values)).cast("int") + 1)


def _sql_pick(key, *values):
    each = ",".join("NULL" if v is None else f"'{v}'" for v in values)
    return f"([{each}]::VARCHAR[])[({key})%{len(values)}+1]"


# ---------------------------------------------------------------- contracts and canonical rows
_LICENSES = ("cc-by-4.0", None, "unknown", "MIT", "proprietary", "synthetic-inherits-source", " ")
_DOMAINS = ("faq_real", "web_nonfaq", "other", None)
_SOURCES = ("web", "", None, "germanquad-train", "webfaq_heldout")


def _records(spark, sf) -> DataFrame:
    """Pairs with the faults that contracts look for, by their number."""
    p = _pairs(spark, sf)
    k = F.col("pair_id")
    return p.select(
        "pair_id", F.when(k % 7 != 0, k.cast("string")).alias("query_id"), F.when(k % 11 != 0, F.concat(F.lit("d"), k.cast("string"))).alias("doc_id"),
        F.when(k % 13 != 0, F.col("query")).otherwise(F.lit("  ")).alias("query"), F.when(k % 17 != 0, F.col("document")).alias("document"),
        _pick("pair_id", *_SOURCES).alias("source"), _pick("pair_id", *_SOURCES).alias("source_id"), _pick("pair_id", *_DOMAINS).alias("domain"), _pick("pair_id", *_LICENSES).alias("license"),
        F.when(k % 3 == 0, True).when(k % 3 == 1, False).alias("positive"), F.when(k % 5 != 0, k % 2 == 0).alias("synthetic_query"),
        F.when(k % 4 == 0, k % 8 == 0).alias("eval_only"), (k % 19 == 0).alias("public_benchmark"),
    )


_REC = f"""{PAIRS}, rec as (select pair_id, case when pair_id%7<>0 then pair_id::VARCHAR end query_id, case when pair_id%11<>0 then 'd'||pair_id end doc_id,
 case when pair_id%13<>0 then query else '  ' end query, case when pair_id%17<>0 then document end as document, {_sql_pick('pair_id', *_SOURCES)} source, {_sql_pick('pair_id', *_SOURCES)} source_id,
 {_sql_pick('pair_id', *_DOMAINS)} as domain, {_sql_pick('pair_id', *_LICENSES)} license, case when pair_id%3=0 then true when pair_id%3=1 then false end positive,
 case when pair_id%5<>0 then pair_id%2=0 end synthetic_query, case when pair_id%4=0 then pair_id%8=0 end eval_only, pair_id%19=0 as public_benchmark from pairs)"""
_BENCH = "|".join(contracts.BENCHMARK_TOKENS)


def _counted(contract, rules: dict[str, str], table="rec"):
    return " union all ".join(f"select '{contract}' as contract, '{e}' as error, count(*) as n from {table} where {w} having count(*)>0" for e, w in rules.items())


def _sql_missing(*columns):
    return {f"missing_{c}": f"trim(coalesce({c},''))=''" for c in columns}


def _sql_in(column, values):
    return f"coalesce({column} in ({','.join(repr(v) for v in values)}),false)"


_SEVEN = ("query_id", "doc_id", "query", "document", "source", "domain", "license")
_LEAK = f"(coalesce(public_benchmark,false) or coalesce(eval_only,false) or regexp_matches(lower(coalesce(source_id,'')),'{_BENCH}') or regexp_matches(lower(coalesce(domain,'')),'{_BENCH}'))"
_NOLIC = f"not {_sql_in('''lower(trim(coalesce(license,'')))''', contracts.MIXER_LICENSES)}"


@query(
    f"with {_REC} "
    + " union all ".join(
        (
            _counted("candidate", _sql_missing(*_SEVEN) | {"positive_not_bool": "positive is null"}),
            _counted("to_score", _sql_missing("query_id", "doc_id", "query", "document")),
            _counted("corpus", {("missing_" + c): f"trim(coalesce({d},''))=''" for c, d in (("doc_id", "doc_id"), ("text", "document"), ("source", "source"), ("domain", "domain"), ("license", "license"))}),
            _counted(
                "mixer",
                _sql_missing("source_id", "domain", "query", "document", "license")
                | {"domain_unknown": f"trim(coalesce(domain,''))<>'' and not {_sql_in('domain', contracts.MIXER_DOMAINS)}", "synthetic_query_not_bool": "synthetic_query is null"},
            ),
            _counted(
                "passage",
                {"missing_source_passage_id": "trim(coalesce(doc_id,''))=''"} | _sql_missing("document", "domain", "license") | {"license_unknown": _NOLIC, "leakage": _LEAK},
            ),
            _counted(
                "local",
                {
                    "id": "trim(coalesce(doc_id,''))='' and trim(coalesce(query_id,''))=''", "text": "trim(coalesce(query,''))='' or trim(coalesce(document,''))=''",
                    "source_id": "trim(coalesce(source_id,''))=''", "license": "trim(coalesce(license,''))=''",
                },
            ),
        )
    )
)
def contract_errors(spark, sf):
    r = _records(spark, sf)
    passages = r.withColumnRenamed("doc_id", "source_passage_id")
    return contracts.report(
        {
            "candidate": (r, contracts.candidate_rules()),
            "to_score": (r, contracts.candidate_rules(strict=False)),
            "corpus": (r.withColumn("text", F.col("document")), contracts.corpus_rules()),
            "mixer": (r, contracts.mixer_rules()),
            "passage": (passages, contracts.passage_rules(passages)),
            "local": (r, contracts.local_row_rules(r)),
        }
    )


@query(f"""with {_REC}, c as (select *, {NFC.format(x="coalesce(query,'')")} q, {NFC.format(x="coalesce(document,'')")} d from rec)
select pair_id, coalesce(nullif(query_id,''), 'q'||substr(sha256(q),1,16)) as query_id, coalesce(nullif(doc_id,''),'d'||substr(sha256(d),1,16)) as doc_id, md5(q) as query, md5(d) as document, coalesce(positive,true) as positive,
 coalesce(nullif(source,''),'unknown') as source, coalesce(nullif(domain,''),'unknown') as domain, coalesce(nullif(license,''),'cc0-1.0') as license from c""")
def canonical_rows(spark, sf):
    r = _records(spark, sf).withColumn("metadata", F.create_map(F.lit("pair_id"), F.col("pair_id").cast("string")))
    c = contracts.canonical_pairs(r, default_license="cc0-1.0")
    return c.select(F.col("metadata")["pair_id"].cast("long").alias("pair_id"), "query_id", "doc_id", F.md5("query").alias("query"), F.md5("document").alias("document"), "positive", "source", "domain", "license")


@query(f"""with {_REC}, c as (select *, {NFC.format(x="coalesce(query,'')")} q, {NFC.format(x="coalesce(document,'')")} d from rec)
select 'q'||substr(sha256(q),1,16) as query_id, 'd'||substr(sha256(d),1,16) as doc_id, substr(sha256(d),1,16) as text_hash, 'p'||substr(sha256(substr(sha256(q),1,16)||'::'||substr(sha256(d),1,16)),1,16) as pair_hash,
 source_id, domain, case when contains(lower(trim(coalesce(license,''))),'inherit') then 'inherited' else 'manifest' end as license_origin, coalesce(synthetic_query,false) as synthetic from c""")
def provenance_rows(spark, sf):
    r = _records(spark, sf)
    lic = F.col("license")
    out = contracts.provenance_rows(r, F.col("source_id"), F.col("domain"), lic, tx.license_origin(lic), F.lit(True), F.coalesce("synthetic_query", F.lit(False)))
    return out.select("query_id", "doc_id", "text_hash", "pair_hash", "source_id", "domain", "license_origin", "synthetic")


@query(f"""with {_REC} select coalesce(case when public_benchmark then 'public_benchmark=true' when eval_only then 'eval_only=true' when regexp_matches(lower(source_id),'{_BENCH}') then 'source_id references a public benchmark' end, 'clean') as reason, count(*) as n from rec group by 1""")
def leakage_reasons(spark, sf):
    r = _records(spark, sf).drop("domain")
    return r.groupBy(F.coalesce(contracts.leakage_reason(r), F.lit("clean")).alias("reason")).agg(_n())


@query(f"""with {PAIRS}, q as (select trim(query) q, trim(document) d from pairs), k as (select *, ({HASH60.format(x='q')}%10000)/10000 b from q where q<>'' and d<>''), t as (select distinct 'q'||substr(md5(q),1,16) as query_id, 'd'||substr(md5(d),1,16) as doc_id from k where b<0.1)
select query_id, doc_id, 1 as relevance from t""")
def faq_eval_judgements(spark, sf):
    return contracts.faq_eval(_pairs(spark, sf))[2]


@query(f"""with {LISTS}, train as (select query_id, doc_id from lists where fs_rank<=5), hit as (select query_id, doc_id from train where doc_id%50=0 union all select query_id, null from (select query_id from train where query_id%40=0))
select query_id, doc_id, count(*) as n from hit group by 1,2""")
def eval_overlap(spark, sf):
    x = _lists(spark, sf).filter("fs_rank <= 5").select("query_id", F.col("doc_id").cast("string").alias("doc_id"), F.lit(None).cast("array<struct<doc_id:string>>").alias("candidates"))
    queries = x.select("query_id").filter("query_id % 40 = 0")
    docs = x.select("doc_id").filter("cast(doc_id as bigint) % 50 = 0")
    return contracts.eval_in_training(x, queries, docs).groupBy("query_id", F.col("doc_id").cast("long").alias("doc_id")).agg(_n())


# ---------------------------------------------------------------- training sets
def _nested_lists(spark, sf) -> DataFrame:
    x = _with_sources(_lists(spark, sf))
    sure = F.col("rel") & (F.col("rr") >= 0.4)
    one = F.struct(
        "fs_rank", F.col("doc_id").cast("string").alias("doc_id"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("document"),
        F.when(sure, 1).when(~F.col("rel") & (F.col("rr") <= 0.2), 0).alias("label"), F.when(F.col("doc_id") % 11 != 0, F.round(F.col("rr") * 10, 2)).alias("teacher_score"),
        sure.alias("high_precision_positive"), F.col("source").alias("candidate_source"), (F.col("doc_id") % 5 == 0).alias("synthetic"), (F.col("rr") > 0.2).alias("uncertain"),
    )
    domain = F.when(F.col("query_id") % 40 == 0, "faq_real").when(F.col("query_id") % 60 == 0, "").otherwise("web")
    return x.groupBy("query_id").agg(F.array_sort(F.collect_list(one)).alias("candidates")).withColumns({"query": F.concat(F.lit("q"), F.col("query_id").cast("string")), "domain": domain})


_TRAIN = f"""{LISTS}, c as (select query_id, 'q'||query_id query, fs_rank, 'd'||doc_id as document, doc_id, case when rel and rr>=0.4 then 1 when not rel and rr<=0.2 then 0 end label, case when doc_id%11<>0 then round(rr*10,2) end teacher_score,
 rel and rr>=0.4 as hp, ['bm25','dense','other'][doc_id%3+1] src, doc_id%5=0 syn, rr>0.2 unc, case when query_id%40=0 then 'faq_real' when query_id%60=0 then 'unknown' else 'web' end as domain from lists),
p as (select *, bool_or(coalesce(label=1,false)) over (partition by query_id) present from c)"""


@query(f"with {_TRAIN} select query, document, label::DOUBLE as label from p where label is not null")
def training_pointwise(spark, sf):
    return training.pointwise(_nested_lists(spark, sf))


@query(f"with {_TRAIN} select query, document, label::DOUBLE as label from p where present and label is not null")
def training_pointwise_present(spark, sf):
    return training.pointwise(training.by_presence(_nested_lists(spark, sf))[0], confident=True)


@query(f"with {_TRAIN} select query, document, teacher_score as label from p where teacher_score is not null")
def training_regression(spark, sf):
    return training.regression(_nested_lists(spark, sf))


@query(f"""with {_TRAIN}, x as (select a.query, a.document as positive, b.document as negative, row_number() over (partition by a.query_id order by a.fs_rank, b.fs_rank) as nth from p a join p b on a.query_id=b.query_id and a.label=1 and b.label=0 and a.teacher_score-b.teacher_score>=2)
select * from x where nth<=8""")
def training_pairs(spark, sf):
    return training.pairs(_nested_lists(spark, sf), 8, 2.0, present_only=True)


@query(f"""with {_TRAIN}, s as (select query_id, query, fs_rank, document, coalesce(teacher_score,-1e9) t from p where present), m as (select *, max(t) over (partition by query_id) mx from s)
select query, document, round(exp(t-mx)/sum(exp(t-mx)) over (partition by query_id),6) as target from m""")
def training_listwise(spark, sf):
    x = training.listwise(_nested_lists(spark, sf), present_only=True)
    each = F.arrays_zip("documents", "target")
    return x.select("query", F.explode(each).alias("x")).select("query", F.col("x.documents").alias("document"), _r(F.col("x.target")).alias("target"))


@query(f"""with {_TRAIN}, w as (select *, bool_and(teacher_score is not null) over (partition by query_id) whole, max(teacher_score) over (partition by query_id) mx, sum(coalesce(label,0)) over (partition by query_id) z from p)
select query, document, round(case when whole then exp(teacher_score-mx)/sum(exp(teacher_score-mx)) over (partition by query_id) else coalesce(label,0)/case when z=0 then 1 else z end end,6) as target from w""")
def training_labelled_lists(spark, sf):
    x = training.labelled_lists(_nested_lists(spark, sf))
    return x.select("query", F.explode(F.arrays_zip("documents", "target")).alias("x")).select("query", F.col("x.documents").alias("document"), _r(F.col("x.target")).alias("target"))


@query(f"""with {_TRAIN} select domain, count(*) filter (where label=1) as positives, count(*) filter (where label=0) as negatives, count(*) filter (where label is null) as uncertain, round(avg(syn::INT),4) as synthetic_share,
 round(median(case when label=1 then teacher_score end),4) as pos_median, round(median(case when label=0 then teacher_score end),4) as neg_median,
 round(round(median(case when label=1 then teacher_score end),4)-round(median(case when label=0 then teacher_score end),4),4) as separation, round(min(case when label=1 then teacher_score end),4) as min_positive,
 coalesce(round(min(case when label=1 then teacher_score end),4)>=4,true) as high_precision from p group by rollup(domain)""")
def training_summary(spark, sf):
    return training.summary(_nested_lists(spark, sf))


@query(f"with {_TRAIN} select src as source, count(*) as n from p group by 1")
def training_sources_count(spark, sf):
    return training.candidate_sources(_nested_lists(spark, sf))


@query(f"""with {_TRAIN}, l as (select distinct query_id, domain from p), s as (select domain, count(*) as lists, round(avg((domain='faq_real')::INT),4) as faq_share from l group by rollup(domain)),
k as (select domain, count(*) filter (where label=1) as gold, count(*) filter (where label=0) as hard_negatives, count(*) filter (where unc) as uncertain, count(*) filter (where unc and label is null and teacher_score>=4) as teacher_only,
 list_sort(list(teacher_score) filter (where label=1 and teacher_score is not null)) a, list_sort(list(teacher_score) filter (where label=0 and teacher_score is not null)) b from p group by rollup(domain))
select s.domain, lists, faq_share, gold, hard_negatives, uncertain, teacher_only, round(a[len(a)//2+1],4) as pos_median, round(b[len(b)//2+1],4) as neg_median, round(a[len(a)//2+1]-b[len(b)//2+1],4) as separation from s join k on s.domain is not distinct from k.domain""")
def training_separation(spark, sf):
    return training.separation(_nested_lists(spark, sf))


def _cache(spark, sf) -> DataFrame:
    """Teacher cache: lists with scores, some missing, and fields that only metadata has."""
    x = _lists(spark, sf)
    d = F.col("doc_id")
    domain = F.element_at(F.array(*map(F.lit, ("faq_real", "web", "admin_real", "wiki_non_eval"))), (d % 4).cast("int") + 1)
    return x.select(
        "query_id", "doc_id", F.concat(F.lit("q"), F.col("query_id").cast("string")).alias("query"), F.concat(F.lit("d"), d.cast("string")).alias("document"),
        F.when(d % 6 != 0, F.col("rel")).alias("positive"), F.when(d % 5 != 0, F.round(F.col("rr") * 10, 2)).alias("reranker_score"), F.when(d % 10 != 0, F.round(F.col("fs") * 10, 2)).alias("embedding_score"),
        F.when(d % 7 != 0, domain).alias("domain"), _pick("doc_id", *_LICENSES).alias("license"), F.create_map(F.lit("domain"), domain).alias("metadata"), F.col("fs_rank").alias("ord"),
    )


_CACHE = f"""{LISTS}, c as (select query_id, doc_id, fs_rank, 'd'||doc_id as document, case when doc_id%6<>0 then rel end positive, case when doc_id%5<>0 then round(rr*10,2) end rs, case when doc_id%10<>0 then round(fs*10,2) end es,
 ['faq_real','web','admin_real','wiki_non_eval'][doc_id%4+1] as domain, {_sql_pick('doc_id', *_LICENSES)} license, from lists), k as (select *, coalesce(positive,true) pos, coalesce(rs,es) s from c)"""


@query(f"""with {_CACHE}, t as (select *, case when domain='web' then 3.0 else 2.0 end th, lower(trim(coalesce(license,''))) in ('','unknown') u from k)
select domain, count(*) filter (where pos) as positives, count(*) filter (where pos and s>=th) as embedder_accepted, count(*) filter (where pos and s>=4) as reranker_accepted, count(*) filter (where pos and s<th) as suspicious,
 round(coalesce(count(*) filter (where pos and s<th)/nullif(count(*) filter (where pos),0),0),4) as suspicious_rate, round(median(case when pos and s>=th then rs end),4) as embedder_median,
 round(median(case when pos and s>=4 then rs end),4) as reranker_median, count(*) filter (where u) as unknown_license from t group by rollup(domain)""")
def teacher_calibration(spark, sf):
    return teacher.calibration(_cache(spark, sf), per_domain={"web": 3.0})


@query(f"""with {_CACHE}, r as (select case when coalesce(positive,false) and rs is null then 'kept_positive_no_reranker_score' when coalesce(positive,false) and rs<3 then 'positive_below_reranker_threshold_3.0' else 'none' end as reason, coalesce(positive and rs<3,false) as review from c)
select reason, review, count(*) as n from r group by 1,2""")
def teacher_filter(spark, sf):
    return teacher.filter_cache(_cache(spark, sf), 3.0).groupBy(F.coalesce("filtering_reason", F.lit("none")).alias("reason"), F.coalesce("review", F.lit(False)).alias("review")).agg(_n())


@query(f"""with {_CACHE} select * from (select 'doubtful' as kind, query_id, doc_id, s as score from k where pos and s<2 order by s, query_id, doc_id limit 10) union all select * from (select 'rejected', query_id, doc_id, s from k where not pos and s>=4 order by s desc, query_id, doc_id limit 10)""")
def teacher_suspects(spark, sf):
    c = _cache(spark, sf)
    low, high = teacher.doubtful_positives(c, 2.0), teacher.rejected_high(c, 4.0)
    one = lambda df, k: df.select(F.lit(k).alias("kind"), "query_id", "doc_id", "score")
    return one(low, "doubtful").unionByName(one(high, "rejected"))


@query(f"""with {_CACHE}, x as (select query_id, document, doc_id, coalesce(s,0) s0, s, coalesce(positive,false) p, coalesce(s,-1e300) n0 from k), b as (select query_id, min_by(doc_id, struct_pack(a:=-s0,b:=doc_id)) pid from x where p group by 1)
select x.query_id, b.pid as pos_id, count(*) filter (where not p and x.doc_id<>b.pid) as negatives, string_agg(x.document, ',' order by n0 desc, doc_id) filter (where not p and x.doc_id<>b.pid) as list from x join b using(query_id) group by 1,2""")
def cache_examples(spark, sf):
    x = training.best_positive_examples(_cache(spark, sf))
    n = F.size("negatives").cast("long")
    return x.select("query_id", F.substring("positive", 2, 20).cast("long").alias("pos_id"), n.alias("negatives"), F.nullif(F.array_join("negatives", ","), F.lit("")).alias("list"))


@query(f"""with {_CACHE}, f as (select query_id, document, coalesce(positive,false) p, row_number() over (partition by query_id, coalesce(positive,false) order by doc_id) r from k), j as (select a.query_id, a.document as positive, b.document as negative, row_number() over (partition by a.query_id order by a.r, b.r) as nth from f a join f b on a.query_id=b.query_id and a.p and not b.p and a.r<=8 and b.r<=8)
select * from j where nth<=8""")
def cache_pairs(spark, sf):
    return training.pairs_from_cache(_cache(spark, sf))


@query(f"""with {_CACHE} select count(*) as rows, count(*) filter (where positive) as positives, count(*) filter (where lower(trim(coalesce(license,''))) in ('','unknown')) as unknown_license, 0 as disallowed, 0 as inherited,
 count(*) filter (where es is null) as missing_embedding_score, count(*) filter (where rs is null) as missing_reranker_score, 0 as repeated_pairs from k""")
def cache_summary(spark, sf):
    return teacher.summary(_cache(spark, sf))


@query(f"with {LISTS} select query_id%40 as query_id, doc_id, max_by(rr, query_id) as score from lists group by 1,2")
def cache_latest(spark, sf):
    """Scores written again: the last one of each key."""
    x = _lists(spark, sf).select((F.col("query_id") % 40).alias("query_id"), "doc_id", F.col("rr").alias("score"), F.col("query_id").alias("ord"))
    return teacher.latest(x, "ord").select("query_id", "doc_id", "score")


@query(f"""with {LISTS}, pos as (select query_id, max(rr) ps, min_by(doc_id, struct_pack(a:=-rr,b:=doc_id)) pid from lists where rel group by 1), n as (select l.query_id, doc_id, round(ps*10,4)-round(rr*10,4) m from lists l join pos using(query_id) where not rel),
r as (select query_id, count(*) filter (where m>=2) as kept_total, count(*) filter (where m<2 and m<=0.5) as false_negatives, count(*) filter (where m<2 and m>0.5) as insufficient from n group by 1) select * from r""")
def import_margins(spark, sf):
    return _margins(spark, sf).select("query_id", F.col("kept_total").cast("long").alias("kept_total"), F.size("false_negatives").cast("long").alias("false_negatives"), F.size("insufficient").cast("long").alias("insufficient"))


def _margins(spark, sf):
    x = _lists(spark, sf)
    score = F.round(F.col("rr") * 10, 4)
    one = F.struct(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("text"), score.alias("score"))
    raw = x.groupBy("query_id").agg(F.max(F.when(F.col("rel"), score)).alias("positive_ce_score"), F.collect_list(F.when(~F.col("rel"), one)).alias("hard_negatives"))
    raw = raw.filter("positive_ce_score is not null and size(hard_negatives) > 0").withColumns({"question": F.lit("q"), "answer": F.lit("a"), "license": F.lit("mit")})
    rows = contracts.import_rows(raw.withColumn("query_id", F.col("query_id").cast("string")))
    return training.margins(rows).withColumn("query_id", F.col("query_id").cast("long"))


@query(f"""with {LISTS}, pos as (select query_id, max(rr) ps from lists where rel group by 1), n as (select round(ps*10,4)-round(rr*10,4) m from lists l join pos using(query_id) where not rel)
select case when m<0 then '<0' when m>=5 then '>=5' else floor(m)::INT||'-'||(floor(m)::INT+1) end as bucket, count(*) as n from n group by 1""")
def margin_histogram(spark, sf):
    return training.margin_histogram(_margins(spark, sf))


# ---------------------------------------------------------------- policies
def _ranked(spark, sf, name, **kw):
    return policies.ranked(_lists(spark, sf), name, **kw).select("query_id", "doc_id", "final_rank")


_GAPS = f"{LISTS}, g as (select query_id, list(fs order by fs_rank) f, list(rr order by rr_rank) r, max(case when fs_rank=1 then rr_rank-1 end) moved from lists group by 1), gg as (select query_id, round(f[1]-f[2],6) fg, round(r[1]-r[2],6) rg, moved from g)"


@query(f"with {_GAPS} select l.query_id, doc_id, row_number() over (partition by l.query_id order by case when fg<0.03 and rg>=0.01 and moved<=10 then rr_rank else fs_rank end) as final_rank from lists l join gg using(query_id)")
def policy_combined(spark, sf):
    return _ranked(spark, sf, "combined_policy", gap_high=0.03, rr_gap=0.01)


@query(f"with {_GAPS} select l.query_id, doc_id, row_number() over (partition by l.query_id order by case when fg>=0.02 then fs_rank else rr_rank end) as final_rank from lists l join gg using(query_id)")
def policy_abstain(spark, sf):
    return _ranked(spark, sf, "first_stage_confidence_abstain", gap_high=0.02)


@query(f"with {_GAPS} select l.query_id, doc_id, row_number() over (partition by l.query_id order by case when moved>4 then fs_rank else rr_rank end) as final_rank from lists l join gg using(query_id)")
def policy_displacement_guard(spark, sf):
    return _ranked(spark, sf, "displacement_guard", most_moved=4)


@query(f"with {_GAPS} select l.query_id, doc_id, row_number() over (partition by l.query_id order by case when rg>=0.02 then rr_rank else fs_rank end) as final_rank from lists l join gg using(query_id)")
def policy_reranker_gate(spark, sf):
    return _ranked(spark, sf, "reranker_confidence_gate", rr_gap=0.02)


@query()
def policy_search(spark, sf):
    """The grid of policies on development lists; tests hold it against brute force."""
    return policies.search(_lists(spark, sf))


@query()
def policy_serving(spark, sf):
    return policies.serve(_with_sources(_lists(spark, sf)), margin=0.1)


@query()
def policy_failures(spark, sf):
    x = _with_sources(_lists(spark, sf))
    return policies.failures(x, margin=0.1).groupBy("kind", "category", "remedy", "fixable").agg(_n())


@query(f"""with {HARD} select query_id, round(fs_ndcg,4) as first, round(rr_ndcg,4) as raw from hard where rr_ndcg-fs_ndcg<=-0.2""")
def policy_catastrophes(spark, sf):
    queries = _asked(spark, sf).select("query_id", F.lit("zwei Worte").alias("query"))
    return policies.catastrophes(_with_sources(_lists(spark, sf)), queries).select("query_id", "first", "raw")


# ---------------------------------------------------------------- gates
_SET = "['webfaq','germanquad','dt_test','local_rag'][query_id//20%4+1]"
_REPORTS = f"rep as (select {_SET} eval_set, avg(delta) delta, avg((delta<=-0.2)::INT) catastrophic_rate, avg((oracle_ndcg>0)::INT) positive_present_rate, avg(fs_ndcg) fsr from hard group by 1)"


def _sets(spark, sf) -> DataFrame:
    h = lists.hardness(_lists(spark, sf))
    name = F.element_at(F.array(*map(F.lit, ("webfaq", "germanquad", "dt_test", "local_rag"))), (F.floor(F.col("query_id") / 20) % 4).cast("int") + 1)
    return h.withColumns({"eval_set": name, "role": F.when(name.isin("webfaq", "local_rag"), "primary").otherwise("guardrail")})


def _reports(spark, sf) -> DataFrame:
    m = {"delta": F.avg("delta"), "catastrophic_rate": F.avg((F.col("delta") <= -0.2).cast("int")), "positive_present_rate": F.avg((F.col("oracle_ndcg") > 0).cast("int")), "first_stage_recall": F.avg("fs_ndcg")}
    return _sets(spark, sf).groupBy("eval_set").agg(F.create_map(*(x for k, v in m.items() for x in (F.lit(k), v))).alias("metrics"))


def _sql_gate(rules, columns):
    def one(r):
        own = f"(select min({columns[r.metric]}) from rep where eval_set='{r.set}')"
        ok = f"coalesce({own} {r.sense} {r.bound}{' - 1e-9' if r.sense == '>=' else ' + 1e-9' if r.sense == '<=' else ''}, false)"
        asked = f" where exists (select 1 from rep where eval_set='{r.set}')" if r.if_there else ""
        return f"select '{r.name}' as \"check\", {ok} as passed, round({own},6) as value{asked}"

    return " union all ".join(map(one, rules))


_COLS = {"delta": "delta", "catastrophic_rate": "catastrophic_rate", "positive_present_rate": "positive_present_rate", "first_stage_recall": "fsr"}


@query(f"with {HARD}, {_REPORTS} {_sql_gate(gates.RAW_RERANKER, _COLS)}")
def gate_raw_reranker(spark, sf):
    return gates.judge(_reports(spark, sf), gates.RAW_RERANKER).select("check", "passed", _r(F.col("value")).alias("value"))


@query(f"with {HARD}, {_REPORTS}, c as ({_sql_gate(gates.NO_DEGRADATION, _COLS)}) select case when bool_and(passed) then 'pass' else 'fail' end as status, count(*) as checks, count(*) filter (where not passed) as failing from c")
def gate_no_degradation(spark, sf):
    v = gates.verdict(gates.judge(_reports(spark, sf), gates.NO_DEGRADATION))
    return v.select("status", "checks", F.size("failing").cast("long").alias("failing"))


@query(f"with {HARD}, {_REPORTS} {_sql_gate(gates.PROMOTION, _COLS)} union all select eval_set||'_not_catastrophic', delta>=-0.02, round(delta,6) from rep union all select eval_set||'_fixed_candidates', true, round(delta,6) from rep")
def gate_promotion(spark, sf):
    return gates.promotion(_reports(spark, sf).withColumn("fixed_candidates", F.lit(True))).select("check", "passed", _r(F.col("value")).alias("value"))


@query(f"""with {HARD}, s as (select *, {_SET} eval_set from hard), m as (select eval_set, round(avg(d),6) macro from (select eval_set, bucket, avg(delta) d from s where bucket in ('medium','hard') group by 1,2) group by 1),
r as (select eval_set, case when eval_set in ('webfaq','local_rag') then 'primary' else 'guardrail' end as role, count(*) filter (where bucket in ('medium','hard')) pn, round(avg(case when bucket in ('medium','hard') then delta end),6) micro, round(avg(delta),6) delta,
 avg((bucket='no_room')::INT)>=0.5 nr, round(avg((delta<=-0.2)::INT),6) cat from s group by 1)
select eval_set||'_catastrophic_rate' as "check", cat<=0.05+1e-9 as passed, cat as value from r union all
select eval_set||'_primary_lift', coalesce(pn>0 and micro>0 and macro>0,false), micro from r left join m using(eval_set) where role='primary' union all
select eval_set||'_guardrail_do_not_regress', coalesce(delta>=case when nr then -0.005 else 0.0 end-1e-9,false), delta from r where role<>'primary'""")
def gate_hardness(spark, sf):
    return gates.hardness(gates.set_report(_sets(spark, sf))).select("check", "passed", "value")


# ---------------------------------------------------------------- retrieval

def _rankings(spark, sf):
    x = _two(spark, sf)
    return x["half"], x["full"]


@query(f"""with {LISTS}, b as (select query_id, doc_id, rr_rank r from lists where rr_rank<=10), d as (select query_id, doc_id, fs_rank r from lists where fs_rank<=10),
f as (select query_id, doc_id, row_number() over (partition by query_id order by score desc, seen, doc_id) r from (select query_id, doc_id, round(sum(1.0::DOUBLE/(60+r)),9) score, min(o*1000+r) seen from (select *, 0 o from b union all select *, 1 from d) group by 1,2)),
z as (select f.query_id, f.doc_id, row_number() over (partition by f.query_id order by case when r<=50 then rr end desc nulls last, r) r from f join lists using(query_id, doc_id)),
m as (select 'bm25_only' as mode, * from b union all select 'dense_only', * from d union all select 'hybrid_rrf', * from f union all select 'hybrid_rrf_plus_reranker', * from z),
rel as (select q.vec_id query_id, d.vec_id doc_id from v q join v d on q.label=d.label and q.vec_id<>d.vec_id and q.vec_id%20=0), n as (select query_id, count(*) n from rel group by 1),
h as (select mode, query_id, count(*) k, min(r) first, sum(1/log2(r+1)) dcg from m join rel using(query_id, doc_id) where r<=10 group by 1,2)
select mode, count(*) as queries, round(avg(coalesce(dcg,0)/list_sum(list_transform(range(1,least(n,10)+1), lambda i: 1/log2(i+1)))),6) as ndcg_10, round(avg(coalesce(1/first,0)),6) as mrr_10, round(avg(coalesce(k,0)/n),6) as recall_10
from (select mode, query_id, n from n cross join (select distinct mode from m)) left join h using(mode, query_id) group by 1""")
def hybrid_modes(spark, sf):
    bm, de = _rankings(spark, sf)
    scores = _lists(spark, sf).select("query_id", "doc_id", F.col("rr").alias("score"))
    out = retrieval.evaluate_modes(bm, de, _relevant(spark, sf), (10,), scores)
    return out.select("mode", "queries", "ndcg_10", "mrr_10", "recall_10")


@query(f"""with {LISTS}, rel as (select q.vec_id query_id, d.vec_id doc_id from v q join v d on q.label=d.label and q.vec_id<>d.vec_id and q.vec_id%20=0), j as (select query_id, fs_rank r from rel left join lists using(query_id, doc_id))
select k, count(*) as queries, round(avg(f/n),6) as recall, round(1-sum(f)/sum(n),6) as missing from (select query_id, k, count(*) n, count(*) filter (where r<=k) f from j, (select unnest([10,20,50,100,200])::INT k) group by 1,2) group by 1""")
def recall_by_depth(spark, sf):
    ranking = _lists(spark, sf).select("query_id", "doc_id", F.col("fs_rank").alias("rank"))
    return retrieval.depth_report(ranking, _relevant(spark, sf))


@query(f"""with {LISTS}, q as (select query_id, {_ndcg('fs_rank')} f, {_ndcg('rr_rank')} r, min(case when rel then rr_rank end) hr, min(case when rel then fs_rank end) hf from lists group by 1)
select count(*) as queries, round(avg(f),6) as first, round(avg(r),6) as raw, round(avg(r-f),6) as delta, round(avg(case when hr<=10 then 1.0/hr else 0 end),6) as mrr, round(avg((r-f<=-0.2+1e-9)::INT),6) as catastrophic_rate,
 round(avg((hr is not null)::INT),6) as positive_present_rate, round(avg(coalesce(hf<=10,false)::INT),6) as recall_first, round(avg(coalesce(hr<=10,false)::INT),6) as recall_raw from q""")
def raw_lift(spark, sf):
    return retrieval.raw_lift(_lists(spark, sf))


@query(f"""with {LISTS}, s as (select *, ['bm25','dense','manual'][doc_id%3+1] src from lists), pos as (select query_id, doc_id from ranked where rel and fs_rank<=30),
d as (select *, src<>'manual' ret from s), p as (select pos.*, d.ret, d.src from pos left join d using(query_id, doc_id))
select count(*) as positives, count(*) filter (where src='bm25') as bm25, count(*) filter (where src='dense') as dense, 0 as both, count(*) filter (where src in ('bm25','dense')) as "any", count(*) filter (where not ret) as injected_only, count(*) filter (where ret is null) as absent,
 round((count(*) filter (where not ret)+count(*) filter (where ret is null))/count(*),6) as missing_rate from p""")
def source_audit(spark, sf):
    x = _lists(spark, sf, 30)
    pos = x.filter("rel").select("query_id", "doc_id")
    src = F.element_at(F.array(*map(F.lit, ("bm25", "dense", "manual"))), (F.col("doc_id") % 3).cast("int") + 1)
    c = x.filter("fs_rank <= 20").withColumn("source", src)
    one = retrieval.source_audit(c, pos)[1]
    return one.select("positives", "bm25", "dense", "both", "any", "injected_only", "absent", "missing_rate")


@query(f"""with {LISTS}, f as (select query_id, doc_id, 'bm25' source, 0 o, rr_rank-1 r from lists where rr_rank<=10 union all select query_id, doc_id, 'v3_dense', 1, fs_rank-1 from lists where fs_rank<=10),
t as (select *, md5('text '||(doc_id//2)::VARCHAR) h from f), a as (select *, row_number() over (partition by query_id, doc_id order by o, r, doc_id) x from t), b as (select *, row_number() over (partition by query_id, h order by o, r, doc_id) y from a where x=1),
g as (select b.*, l.rel, case when l.doc_id%11<>0 then round(l.rr*10,4) end s from b join lists l using(query_id, doc_id) where y=1), k as (select *, bool_or(rel) over (partition by query_id) has from g)
select query_id, doc_id, source, r as first_stage_rank, s as teacher_score, case when rel then 1 when s>=4 then 1 when s<=2 then 0 end as label, row_number() over (partition by query_id order by o, r, doc_id) as nth from k where has""")
def candidate_lists(spark, sf):
    x = _lists(spark, sf)
    bm, de = _rankings(spark, sf)
    corpus = _vectors(spark, sf).select("doc_id", F.concat(F.lit("text "), F.floor(F.col("doc_id") / 2).cast("string")).alias("text"))
    scores = x.filter("doc_id % 11 <> 0").select("query_id", "doc_id", F.round(F.col("rr") * 10, 4).alias("score"))
    return retrieval.candidate_lists({"bm25": bm, "v3_dense": de}, corpus, x.filter("rel").select("query_id", "doc_id"), scores)


@query(f"""with {LISTS}, q as (select query_id, {_ndcg('fs_rank')} f, max(case when rel and fs_rank<=10 then 1 else 0 end) h from lists group by 1)
select round(avg(h),4) as positive_in_top_10, round(avg(case when query_id%40=0 then h end),4) as answer_support_10, count(*) filter (where query_id%40=0) as answer_support_queries from q where query_id in (select q.vec_id from v q join v d on q.label=d.label and q.vec_id<>d.vec_id)""")
def rag_report(spark, sf):
    ranking = _lists(spark, sf).select("query_id", "doc_id", F.col("fs_rank").alias("rank"))
    support = _asked(spark, sf).select("query_id", (F.col("query_id") % 40 == 0).alias("requires_answer_support"))
    r = retrieval.rag_report(retrieval.rag_metrics(ranking, _relevant(spark, sf), support))
    return r.select("positive_in_top_10", "answer_support_10", "answer_support_queries")


@query(f"with {_bm25(TOKENS_DE, '1', True)} select * from (select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id) as rank from sc) where rank<=10")
def bm25_saved_index(spark, sf):
    """The search through an index that was saved and loaded again."""
    path = f"{scratch.folder(spark)}/bm25-{uuid.uuid4().hex}"
    lexical.save_index(_corpus(spark, sf), path)
    return lexical.search_index(path, _passages(spark, sf), 10).select("query_id", "doc_id", "score", "rank")


@query()
def leakage_saved_index(spark, sf):
    """Near duplicates of odd documents among all, through a saved index."""
    path = f"{scratch.folder(spark)}/leakage-{uuid.uuid4().hex}"
    d = _corpus(spark, sf)
    leakage.save_index(d.select(F.col("doc_id").alias("eval_id"), "text"), path)
    return leakage.best_hits(leakage.search_index(d.select(F.col("doc_id").alias("cand_id"), "text"), path).filter("cand_id <> eval_id"))


# ---------------------------------------------------------------- generated questions, admission
_NOUNS = "list_filter(regexp_extract_all(d, '(?:^|[^\\p{L}\\p{N}_])([A-ZÄÖÜ][\\p{L}\\p{N}_]{3,})', 1), lambda w: not list_contains([" + ",".join(f"'{w}'" for w in questions.STOPWORDS) + "], w))"


@query(f"""with p as (select item_id, {NFC.format(x='text')} d from benchmark), n as (select item_id, d, {_NOUNS} w from p),
s as (select item_id, d, case when len(w)>0 then list_reduce(w, lambda a,b: case when length(b)>length(a) then b else a end) end topic, w from n),
k as (select *, list_filter(w, lambda x: x<>topic)[1] kw, nullif(regexp_extract(d,'\\b\\d+\\b'),'') nr, nullif(regexp_extract(d,'\\b(?:1[89]\\d{{2}}|20\\d{{2}})\\b'),'') yr, nullif(regexp_extract(d,'§\\s*\\d+'),'') lr from s)
select item_id, count(topic) as topic, count(kw) as keyword, count(nr) as number, count(yr) as year, count(lr) as legal_ref, max(md5(coalesce(topic,''))) as topic_md5, max(md5(coalesce(kw,''))) as keyword_md5 from k group by 1""")
def question_slots(spark, sf):
    x = _t(spark, sf, "benchmark").select("item_id", tx.nfc_collapsed(F.col("text")).alias("d"))
    made = questions.slots(F.col("d"))
    there = lambda n: F.count(n).alias(n)
    s = x.select("item_id", *(made[n].alias(n) for n in ("topic", "keyword", "number", "year", "legal_ref")))
    blank = lambda n: F.max(F.md5(F.coalesce(n, F.lit("")))).alias(f"{n}_md5")
    return s.groupBy("item_id").agg(*map(there, ("topic", "keyword", "number", "year", "legal_ref")), blank("topic"), blank("keyword"))


@query()
def question_rows(spark, sf):
    """Questions of the templates over whole passages; tests hold them against brute force."""
    p = _t(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), F.col("text").alias("document"))
    return questions.generated(p, most=6).select("doc_id", "template", "family", "query", "positive", "query_id", "pair_hash")


_STYLE_SQL = " union all ".join(f"select '{s}' as query_style, '{q}' as t" for s, (_, q) in questions.STYLES.items())


@query(f"""with w as (select item_id::VARCHAR id, list_filter(regexp_split_to_array(text,'\\s+'), lambda x: x<>'') l from benchmark), f as (select id, array_to_string(l[1:4],' ') w4 from w)
select id as source_passage_id, query_style, replace(replace(t,'{{title}}',coalesce(nullif(w4,''),'dieses Thema')),'{{words}}',w4) as query from f, ({_STYLE_SQL})""")
def question_dry_run(spark, sf):
    return questions.dry_run(_passage_rows(spark, sf)).select("source_passage_id", "query_style", "query")


def _passage_rows(spark, sf):
    b = _t(spark, sf, "benchmark")
    return b.select(F.col("item_id").cast("string").alias("source_passage_id"), F.col("text").alias("document"), F.lit("mit").alias("license"), F.lit("web").alias("domain"))


@query("select item_id::VARCHAR as source_passage_id, count(*) as n, min(length(text)) as chars from benchmark, (select unnest(range(0,10))) group by 1")
def question_prompts(spark, sf):
    x = questions.prompts(_passage_rows(spark, sf)).join(_passage_rows(spark, sf).select("source_passage_id", "document"), "source_passage_id")
    whole = x.filter(F.contains("prompt", "document") & F.contains("prompt", "query_style"))
    return whole.groupBy("source_passage_id").agg(_n(), F.min(F.length("document")).alias("chars"))


@query("""with a as (select item_id::VARCHAR pid, item_id from benchmark where item_id%2=0 union all select 'none', 1), s as (select case when pid='none' then 'unknown_passage' when item_id%3=0 then 'empty_query' when item_id%5=0 then 'unknown_style' when item_id%4=0 then 'rejected' else 'kept' end as status from a) select status, count(*) as n from s group by 1""")
def question_answers(spark, sf):
    b = _t(spark, sf, "benchmark").filter("item_id % 2 = 0")
    k = F.col("item_id")
    one = spark.sql("select bigint(1) item_id, 'none' pid")
    a = b.select("item_id", k.cast("string").alias("pid")).unionByName(one).select(
        F.col("pid").alias("source_passage_id"), F.when(k % 3 == 0, " ").otherwise("Was?").alias("query"), F.when(k % 5 == 0, "song").otherwise("how_to").alias("query_style"), (k % 4 == 0).alias("answerable_without_passage"),
        F.lit(None).cast("string").alias("model"),
    )
    return questions.from_answers(a, _passage_rows(spark, sf)).groupBy("status").agg(_n())


def _mixture_rows(spark, sf):
    names = F.element_at(F.array(*map(F.lit, ("a", "b", "c"))), (F.col("conv_id") % 3).cast("int") + 1)
    p = _pairs(spark, sf).filter(F.length("document") >= 5)
    return p.select(names.alias("source"), "query", "document", F.lit(None).cast("string").alias("domain"), "pair_id")


@query(f"""with {PAIRS}, r as (select ['a','b','c'][conv_id%3+1] source, query, document as d, pair_id from pairs where length(document)>=5), pl as (select * from (values ('a',0,15),('b',1,9),('c',2,6)) t(source, ord, budget)),
n as (select *, row_number() over (partition by source order by pair_id)-1 i, count(*) over (partition by source) c from r), s as (select n.*, ord, budget, greatest(1, c//budget) st from n join pl using(source)), k as (select * from s where i%st=0 and i/st<budget),
e as (select * from (select *, row_number() over (partition by query, d order by ord, i) x from k) where x=1), f as (select * from (select *, row_number() over (partition by {COLLAPSED.format(x='query')}, {COLLAPSED.format(x='d')} order by ord, i) y from e) where y=1)
select source, md5(query) as query, md5(d) as document, source as domain, case when length(d)<256 then 'short' when length(d)<1024 then 'medium' else 'long' end as length_bucket from f""")
def mixture_rows(spark, sf):
    return _mixture(spark, sf, None).select("source", F.md5("query").alias("query"), F.md5("document").alias("document"), "domain", "length_bucket")


def _mixture(spark, sf, cap):
    c = spark.sql("select * from values ('a','x','scanned_clean',true), ('b','y','clean',true), ('c','z','clean',true) t(id, path, leakage, training_usable)").withColumn("domain", F.lit(None).cast("string"))
    plan = admission.check_mixture({"a": 0.5, "b": 0.3, "c": 0.2}, 30, c, spark.sql("select 'e' id"))
    return admission.mixture(_mixture_rows(spark, sf), plan, "pair_id", cap)


@query(f"""with {_REC}, m as (select * from (values ('web',true),('germanquad-train',false)) t(s,ok)) select coalesce(case when trim(coalesce(source_id,''))='' then 'missing_source_id' when ok is null then 'unknown_source' when not ok then 'disallowed_source' when trim(coalesce(query,''))='' or trim(coalesce(document,''))='' then 'empty_text' end,'admitted') as reason, count(*) as n from rec left join m on s=source_id group by 1""")
def admission_reasons(spark, sf):
    m = spark.sql("select * from values ('web', true), ('germanquad-train', false) t(source_id, allowed_for_training)")
    return admission.admitted(_records(spark, sf), m).groupBy(F.coalesce("reason", F.lit("admitted")).alias("reason")).agg(_n())


@query(f"""with {_REC}, s as (select * from (values ('web','web','local_jsonl',true,true,false),('germanquad-train','faq_real','local_jsonl',false,true,true),('hub','web','hf_dataset',true,true,false),('gone','web','local_jsonl',true,true,false)) t(source_id, domain, ty, ok, ver, pb)),
c as (select count(*) filter (where (trim(coalesce(doc_id,''))<>'' or trim(coalesce(query_id,''))<>'') and trim(coalesce(query,''))<>'' and trim(coalesce(document,''))<>'' and trim(coalesce(license,''))<>'') ok, count(*) n from rec where source_id='web')
select source_id, domain, case when source_id='germanquad-train' then 'blocked: public_benchmark (eval-only, never train)' when source_id='hub' then 'hf_dataset not downloaded in mode=materialize-local' when source_id='gone' then 'local data not present' end as reason,
 case when source_id='web' then c.ok end as rows, case when source_id='web' then c.n-c.ok else 0 end as invalid, false as supplemental from s, c""")
def acquisition(spark, sf):
    s = spark.sql(
        "select * from values ('web','web','local_jsonl','mit',true,true,false,false), ('germanquad-train','faq_real','local_jsonl','mit',false,true,true,false), ('hub','web','hf_dataset','mit',true,true,false,false), ('gone','web','local_jsonl','mit',true,true,false,false) "
        "t(source_id, domain, source_type, license, allowed_for_training, license_verified, public_benchmark, eval_only)"
    ).withColumn("supplemental", F.lit(False))
    return admission.acquire(s, {"web": _records(spark, sf).filter("source_id = 'web'")})[1]


# ---------------------------------------------------------------- vectors, merging, inference
@query("""with e as (select vec_id, embedding::DOUBLE[] e from embeddings), m as (select vec_id, [(e[i]+e[16+i]+e[48+i])/3 for i in range(1,17)] p, e[49:64] l, e[1:16] c from e)
select vec_id, round(list_sum(p),6) as mean_pool, round(list_sum(l),6) as last_pool, round(list_sum(c),6) as cls_pool from m""")
def pooled_vectors(spark, sf):
    x = _vectors(spark, sf).select("doc_id", F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.transform(F.slice("vector", i * 16 + 1, F.lit(16)), lambda v: v.cast("double"))).alias("h"))
    mask = F.array(*map(F.lit, (1, 1, 0, 1)))
    total = lambda a: _r(F.aggregate(a, F.lit(0.0), lambda s, v: s + v))
    return x.select(F.col("doc_id").alias("vec_id"), *(total(vx.pool(s, F.col("h"), mask)).alias(n) for s, n in (("mean", "mean_pool"), ("eos", "last_pool"), ("cls", "cls_pool"))))


@query("""with e as (select vec_id i, embedding::DOUBLE[] e from embeddings where vec_id%20=0), c as (select q.i, list_cosine_similarity(q.e[1:32], p.e[33:64])/0.05 s, q.i=p.i own from e q, e p), l as (select i, max(s) m, max(case when own then s end) o from c group by 1)
select round(avg(m+ln(z)-o),4) as loss from (select l.i, m, o, sum(exp(s-m)) z from c join l using(i) group by 1,2,3)""")
def info_nce_batch(spark, sf):
    x = _asked(spark, sf).select(F.col("query_id").alias("i"), F.slice("vector", 1, 32).cast("array<double>").alias("query"), F.slice("vector", 33, 32).cast("array<double>").alias("positive"), F.lit(None).cast("array<array<double>>").alias("negatives"))
    return metrics.info_nce(x).select(F.round("loss", 4).alias("loss"))


@query("""with p as (select vec_id%10 as key, vec_id//10 pa, unnest(embedding::DOUBLE[]) x, unnest(range(0,64)) pos from embeddings), w as (select *, case when key<5 then (pa%3+1)::DOUBLE else 1.0 end w from p)
select key, pos, round(sum(x*w)/sum(w),6) as v from w group by 1,2""")
def merge_layerwise(spark, sf):
    p = _all_parents(spark, sf)
    w = p.filter("key < 5").select("key", "parent", (F.col("parent") % 3 + 1).cast("double").alias("weight"))
    return _cells(merging.layerwise(p, w))


@query("""with e as (select vec_id%10 as key, vec_id//10 pa, embedding::DOUBLE[] e from embeddings where vec_id//10 in (1,2)), j as (select a.key, a.e x, b.e y, acos(greatest(-1.0,least(1.0,list_cosine_similarity(a.e,b.e)))) o from e a join e b on a.key=b.key and a.pa=1 and b.pa=2)
select key, pos, round(sin(0.75*o)/sin(o)*x[pos+1]+sin(0.25*o)/sin(o)*y[pos+1],6) as v from (select *, unnest(range(0,64)) pos from j)""")
def merge_slerp(spark, sf):
    return _cells(merging.pairwise(_all_parents(spark, sf).filter("parent in (1, 2)"), 0.25))


@query()
def merge_dare(spark, sf):
    p = _all_parents(spark, sf).filter("parent < 4")
    return _cells(merging.merge("dare", p.filter("parent > 0"), p.filter("parent = 0").drop("parent"), density=0.5, weights={1: 1.0, 2: 1.0, 3: 2.0}))


def _length_scorer():
    return lambda qs, ds: [len(q) / (len(q) + len(d) + 1) for q, d in zip(qs, ds)]


def _letter_encoder():
    import numpy as np

    return lambda texts: np.array([[t.count(c) for c in "aeinrst"] for t in texts], np.float32)


@query(f"""with {PAIRS}, s as (select pair_id, round(length(query)/(length(query)+length(document)+1),6) as reranker_score, [{','.join(f"(length(query)-length(replace(query,'{c}','')))::DOUBLE" for c in 'aeinrst')}] a, [{','.join(f"(length(document)-length(replace(document,'{c}','')))::DOUBLE" for c in 'aeinrst')}] b from pairs)
select pair_id, reranker_score, round(case when list_sum(a)=0 or list_sum(b)=0 then 0 else list_cosine_similarity(a,b) end,6) as embedding_score from s""")
def inference_scores(spark, sf):
    """Stand-ins for a teacher: shares of lengths, and cosines of counts of letters."""
    p = _pairs(spark, sf).select("pair_id", "query", "document")
    s = inference.embedding_scores(inference.reranker_scores(p, _length_scorer), _letter_encoder)
    return s.select("pair_id", _r(F.col("reranker_score")).alias("reranker_score"), "embedding_score")


@query(f"with {LISTS}, p as (select query_id, doc_id, rel, fs_rank, row_number() over (partition by query_id order by doc_id) x from lists where rel) select query_id, list(doc_id::VARCHAR order by doc_id::VARCHAR) as positives from (select query_id, doc_id from lists where rel union select query_id, query_id from lists) group by 1")
def nested_positives(spark, sf):
    one = F.struct(F.col("doc_id").cast("string").alias("doc_id"), F.col("rel").alias("is_positive"), F.when(F.col("rel"), 1).alias("label"))
    x = _lists(spark, sf).groupBy("query_id").agg(F.collect_list(one).alias("candidates")).withColumn("positive_doc_id", F.col("query_id").cast("string"))
    return x.select("query_id", nested.positives(x).alias("positives"))


@query("select event_type, count(*) as n, count(props->>'$.k') as k from events group by 1")
def nested_paths(spark, sf):
    e = _t(spark, sf, "events")
    return e.groupBy("event_type").agg(_n(), F.count(nested.path(F.col("props"), "k")).alias("k"))


@query("select field, missing from (select 'text' as field, count(*) filter (where trim(coalesce(text,''))='') as missing from documents union all select 'lang', count(*) filter (where trim(coalesce(lang,''))='') from documents union all select 'any', count(*) filter (where trim(coalesce(text,''))='' or trim(coalesce(lang,''))='') from documents)")
def missing_fields(spark, sf):
    return aggregates.missing_report(_corpus(spark, sf), ["text", "lang"])
