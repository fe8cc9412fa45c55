"""The queries over the reference's own operators and the DuckDB statements that check them.

Roles of the tables: documents is the corpus (domain: lang), benchmark the evaluation texts,
embeddings the vectors (relevant: same label), consecutive user and assistant turns of
conversations the pairs, labels.quality the teacher, events the stream. Candidate lists are the
20 nearest vectors of every vec_id divisible by 20; the reranker's score is the cosine of the
second half of the vectors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedimark.functions import text as tx
from sedimark.functions import variants as vr
from sedimark.functions import vectors as vx
from sedimark.operators import aggregates, clustering, contracts, dense, fusion, gates, leakage, lexical, lists, merging, metrics, policies, records
from sedimark.streaming import events as ev

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _r(c, n=6):
    return F.round(c, n)


# ---------------------------------------------------------------- shared inputs
FOLD = "replace(replace(replace(replace(lower({x}),'ä','ae'),'ö','oe'),'ü','ue'),'ß','ss')"
TOKENS = "regexp_extract_all(" + FOLD + r", '[\p{{L}}\p{{N}}_§]+')"
TOKENS_DE = "regexp_extract_all(replace(lower({x}),'ß','ss'), '[0-9a-zäöü]+')"
COLLAPSED = r"trim(regexp_replace(lower({x}), '\s+', ' ', 'g'))"
NFC = r"trim(regexp_replace(nfc_normalize({x}), '[\t\n\x{{0b}}\f\r\x{{1c}}-\x{{1f}} \x{{85}}\p{{Z}}]+', ' ', 'g'))"
HASH60 = "('0x' || substr(md5({x}),1,15))::BIGINT"


def _corpus(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", "text", "lang", "source")


def _passages(spark, sf):
    return _t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def _pairs(spark, sf):
    c = _t(spark, sf, "conversations")
    q = c.filter("role = 'user'").select("conv_id", F.col("turn").alias("turn"), F.col("text").alias("query"))
    a = c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("document"))
    return q.join(a, ["conv_id", "turn"]).withColumn("pair_id", F.col("conv_id") * 1000 + F.col("turn"))


PAIRS = """pairs as (select q.conv_id, q.turn, q.text as query, a.text as document, q.conv_id*1000+q.turn as pair_id
from conversations q join conversations a on a.conv_id=q.conv_id and a.turn=q.turn+1
where q.role='user' and a.role='assistant')"""


def _vectors(spark, sf):
    return _t(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"), "label")


def _asked(spark, sf):
    return _vectors(spark, sf).filter("doc_id % 20 = 0").withColumnRenamed("doc_id", "query_id")


def _lists(spark, sf, k=20):
    v = _vectors(spark, sf)
    top = dense.top_k(_asked(spark, sf), v, k)
    q = v.select(F.col("doc_id").alias("query_id"), F.slice("vector", 33, 32).alias("qv"), F.col("label").alias("ql"))
    d = v.select("doc_id", F.slice("vector", 33, 32).alias("dv"), F.col("label").alias("dl"))
    rows = top.join(q, "query_id").join(d, "doc_id").select(
        "query_id", "doc_id", F.col("score").alias("fs"), _r(vx.cosine(F.col("qv"), F.col("dv"))).alias("rr"),
        (F.col("ql") == F.col("dl")).alias("rel"), F.col("rank").alias("fs_rank"),
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("rr"), "doc_id")
    return rows.withColumn("rr_rank", F.row_number().over(order))


LISTS = """v as (select vec_id, embedding::DOUBLE[] e, label from embeddings),
ranked as (select q.vec_id query_id, d.vec_id doc_id, round(list_cosine_similarity(q.e,d.e),6) fs,
 round(list_cosine_similarity(q.e[33:64],d.e[33:64]),6) rr, q.label=d.label rel, q.label ql,
 row_number() over (partition by q.vec_id order by round(list_cosine_similarity(q.e,d.e),6) desc, d.vec_id) fs_rank
 from v q, v d where q.vec_id%20=0 and q.vec_id<>d.vec_id),
lists as (select *, row_number() over (partition by query_id order by rr desc, doc_id) rr_rank from ranked where fs_rank<=20)"""
_GAIN = "case when rel and {r}<=10 then 1/log2({r}+1) else 0 end"
_IDEAL = "list_sum(list_transform(range(1, least(10,count(*) filter (where rel))+1), lambda i: 1/log2(i+1)))"


def _ndcg(r):
    return f"case when count(*) filter (where rel)=0 then 0 else sum({_GAIN.format(r=r)})/{_IDEAL} end"


HARD = f"""{LISTS}, orc as (select *, row_number() over (partition by query_id order by rel desc, fs_rank) o_rank from lists),
hard0 as (select query_id, round({_ndcg('fs_rank')},6) fs_ndcg, round({_ndcg('rr_rank')},6) rr_ndcg, round({_ndcg('o_rank')},6) oracle_ndcg from orc group by query_id),
hard as (select *, round(rr_ndcg-fs_ndcg,6) delta, case when oracle_ndcg<0.80 then 'impossible' when oracle_ndcg>=0.98 and fs_ndcg>=0.95 then 'no_room'
 when fs_ndcg>=0.85 then 'easy' when fs_ndcg>=0.5 then 'medium' else 'hard' end bucket from hard0)"""


# ---------------------------------------------------------------- lexical
def _bm25(tok, weight, distinct):
    return f"""qt as (select item_id query_id, unnest({tok.format(x='text')}) term from benchmark),
qw as (select query_id, term, {weight} w from qt group by 1,2),
d as (select doc_id, {tok.format(x='text')} toks from documents),
st as (select count(*) n, avg(len(toks)) avgdl from d),
p as (select doc_id, term, count(*) tf from (select doc_id, unnest(toks) term from d) group by 1,2),
df as (select term, count(*) df from p group by 1),
sc as (select query_id, p.doc_id, round(sum(w*ln(1+(n-df+0.5)/(df+0.5))*tf*2.5/(tf+1.5*(0.25+0.75*len(toks)/avgdl))),6) score
 from qw join p using(term) join df using(term) join d on d.doc_id=p.doc_id, st group by 1,2)"""


@query(f"with {_bm25(TOKENS_DE, '1', True)} select * from (select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id) as rank from sc) where rank<=10")
def bm25_top10(spark, sf):
    return lexical.search(_corpus(spark, sf), _passages(spark, sf), 10).select("query_id", "doc_id", "score", "rank")


@query(f"with {_bm25(TOKENS, 'count(*)', False)}, al as (select b.item_id query_id, d.doc_id, coalesce(sc.score,0) score from benchmark b cross join d left join sc on sc.query_id=b.item_id and sc.doc_id=d.doc_id) select * from (select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, doc_id) as rank from al) where rank<=10")
def bm25_harness_variant(spark, sf):
    return lexical.harness_rank(_corpus(spark, sf), _passages(spark, sf), 10).select("query_id", "doc_id", "score", "rank")


_HV = f"""g as (select item_id doc_id, {FOLD.format(x='text')} t from benchmark),
gr as (select doc_id, substr(t, i, 3) gram from (select doc_id, t, unnest(range(1, greatest(length(t)-2,1)+1)) i from g)),
h as (select doc_id, ('0x'||substr(md5(gram),25,8))::BIGINT x from gr),
c as (select doc_id, x%256 as dim, sum(case when (x//256)%2=0 then 1 else -1 end)::DOUBLE vv from h group by 1,2),
nn as (select doc_id, sqrt(sum(vv*vv)) nrm from c group by 1)"""


@query(f"with {_HV} select doc_id, dim, round(vv/nrm,6) as v from c join nn using(doc_id) where vv<>0")
def hashing_encoder_vectors(spark, sf):
    texts = _t(spark, sf, "benchmark").select(F.col("item_id").alias("doc_id"), "text")
    v = lexical.hashing_vectors(texts).select("doc_id", F.posexplode("vector").alias("dim", "v"))
    return v.filter("v <> 0").select("doc_id", F.col("dim").cast("long").alias("dim"), _r(F.col("v")).alias("v"))


# ---------------------------------------------------------------- dense
def _dense_sql(expr_q, expr_d):
    return f"""with v as (select vec_id, embedding::DOUBLE[] e from embeddings)
select query_id, doc_id, score, rank from (select q.vec_id query_id, d.vec_id doc_id, round(list_cosine_similarity({expr_q},{expr_d}),6) score,
row_number() over (partition by q.vec_id order by round(list_cosine_similarity({expr_q},{expr_d}),6) desc, d.vec_id) as rank from v q, v d where q.vec_id%20=0 and q.vec_id<>d.vec_id) where rank<=10"""


def _dense(spark, sf, dim=None):
    return dense.top_k(_asked(spark, sf), _vectors(spark, sf), 10, dim).select("query_id", "doc_id", "score", "rank")


@query(_dense_sql("q.e", "d.e"))
def dense_top10(spark, sf):
    return _dense(spark, sf)


@query(_dense_sql("q.e[1:16]", "d.e[1:16]"))
def dense_truncated_16(spark, sf):
    return _dense(spark, sf, 16)


@query(_dense_sql("q.e[1:32]", "d.e[1:32]"))
def dense_truncated_32(spark, sf):
    return _dense(spark, sf, 32)


def _relevant(spark, sf):
    v = _vectors(spark, sf)
    q = _asked(spark, sf).select("query_id", F.col("label").alias("ql"))
    return q.join(v, F.col("ql") == F.col("label")).filter("query_id <> doc_id").select("query_id", "doc_id")


_KS = (1, 3, 5, 10)
_METRIC_CTES = """v as (select vec_id, embedding::DOUBLE[] e, label from embeddings),
{name} as (select q.vec_id query_id, d.vec_id doc_id, q.label=d.label rel, row_number() over (partition by q.vec_id order by round(list_cosine_similarity({q},{d}),6) desc, d.vec_id) rk from v q, v d where q.vec_id%20=0 and q.vec_id<>d.vec_id),
n as (select query_id, count(*) filter (where rel) n from {name} group by 1),
hit as (select query_id, rk, row_number() over (partition by query_id order by rk) nth from {name} where rel and rk<=10)"""


def _metric_select(k):
    return f"""select {k} as k, count(*) as queries,
round(avg(coalesce(dcg/list_sum(list_transform(range(1,least(n,{k})+1), lambda i: 1/log2(i+1))),0)),6) as ndcg, round(avg(coalesce(1.0/first,0)),6) as mrr,
round(avg(coalesce(found,0)/n),6) as recall, round(avg(coalesce(found,0)/{k}),6) as precision_, round(avg(coalesce(ap/least(n,{k}),0)),6) as map_, round(avg(case when coalesce(found,0)>0 then 1 else 0 end),6) as hit
from (select * from n where n>0) n left join (select query_id, sum(1/log2(rk+1)) dcg, min(rk) first, count(*) found, sum(nth/rk) ap from hit where rk<={k} group by 1) h using(query_id)"""


@query("with " + _METRIC_CTES.format(name="r", q="q.e", d="d.e") + " " + " union all ".join(map(_metric_select, _KS)))
def retrieval_metrics(spark, sf):
    return _metric_rows(_dense(spark, sf), _relevant(spark, sf))


def _metric_rows(ranking, relevant):
    m = metrics.averaged(metrics.per_query(ranking, relevant))
    one = lambda k: F.struct(
        F.lit(k).alias("k"), F.col("queries"), F.col(f"ndcg_{k}").alias("ndcg"), F.col(f"mrr_{k}").alias("mrr"), F.col(f"recall_{k}").alias("recall"),
        F.col(f"precision_{k}").alias("precision_"), F.col(f"map_{k}").alias("map_"), F.col(f"hit_{k}").alias("hit"),
    )
    return m.select(F.inline(F.array(*map(one, _KS))))


def _sweep_sql(d):
    e = f"e[1:{d}]"
    return f"select {d} as dim, {4*d} as fp32, * from (with " + _METRIC_CTES.format(name="r", q="q." + e, d="d." + e) + " " + _metric_select(10) + ")"


@query(" union all ".join(map(_sweep_sql, (64, 32, 16, 8))))
def truncation_sweep(spark, sf):
    rel, out = _relevant(spark, sf), None
    for d in (64, 32, 16, 8):
        own = _metric_rows(_dense(spark, sf, d), rel).filter("k = 10").select(F.lit(d).alias("dim"), F.lit(4 * d).alias("fp32"), "*")
        out = own if out is None else out.unionByName(own)
    return out


# ---------------------------------------------------------------- fusion, pools, mining
_RANKS = f"""with {LISTS}, a as (select query_id, doc_id, fs_rank r from lists where fs_rank<=10), b as (select query_id, doc_id, rr_rank r from lists where rr_rank<=10),
u as (select *, 0 as o from a union all select *, 1 from b)"""


def _two(spark, sf):
    x = _lists(spark, sf)
    return {
        "full": x.filter("fs_rank <= 10").select("query_id", "doc_id", F.col("fs_rank").alias("rank")),
        "half": x.filter("rr_rank <= 10").select("query_id", "doc_id", F.col("rr_rank").alias("rank")),
    }


_FUSE = _RANKS + " select * from (select query_id, doc_id, score, row_number() over (partition by query_id order by score desc, {tie}) as rank from (select query_id, doc_id, round(sum(1.0::DOUBLE/(60+r)),9) score, min(o*1000+r) seen from u group by 1,2)) where rank<=10"


@query(_FUSE.format(tie="seen, doc_id"))
def rrf_first_seen(spark, sf):
    return fusion.rrf(_two(spark, sf), top=10).select("query_id", "doc_id", "score", "rank")


@query(_FUSE.format(tie="doc_id"))
def rrf_tie_by_id(spark, sf):
    return fusion.rrf(_two(spark, sf), top=10, by_id=True).select("query_id", "doc_id", "score", "rank")


@query(_RANKS + " select query_id, doc_id, case when min(o)=0 then 'full' else 'half' end as source, (min(o*1000+r)%1000)::int as rank from u group by 1,2")
def candidate_pool_union(spark, sf):
    return fusion.pool(_two(spark, sf))


_NEG = f"""with {LISTS}, pos as (select query_id, min_by(doc_id, struct_pack(a:=-rr, b:=doc_id)) pos_id, max(rr) pos_score from lists where rel group by 1),
x as (select query_id, doc_id, rr as score, fs_rank, pos_id, case when rr>=pos_score then 'neg_score_ge_positive' when rr>=pos_score-0.1 then 'within_margin_of_positive' end reason from lists join pos using(query_id) where not rel)"""


def _mined(spark, sf):
    x = _lists(spark, sf)
    pos = x.filter("rel").groupBy("query_id").agg(F.max(F.struct("rr", (-F.col("doc_id")).alias("m"))).alias("p"))
    pos = pos.select("query_id", (-F.col("p.m")).alias("pos_id"), F.col("p.rr").alias("pos_score"))
    pooled = x.filter("not rel").select("query_id", "doc_id")
    scores = x.select("query_id", "doc_id", F.col("rr").alias("score"), F.lit("all").alias("domain"))
    return fusion.triplets(pooled, scores, pos, 0.1, 8)


@query(_NEG + " select query_id, pos_id, doc_id, score, rank from (select *, row_number() over (partition by query_id order by score desc, doc_id) as rank from x where reason is null) where rank<=8")
def hard_negatives(spark, sf):
    return _mined(spark, sf).filter("reason is null").select("query_id", "pos_id", "doc_id", "score", "rank")


@query(_NEG + " select coalesce(reason,'kept') as reason, count(*) as n from x group by 1")
def fn_veto_reasons(spark, sf):
    x = _lists(spark, sf)
    best = x.filter("rel").groupBy("query_id").agg(F.max("rr").alias("pos_score"))
    why = fusion.false_negative("rr", "pos_score", 0.1)
    return x.filter("not rel").join(best, "query_id").groupBy(F.coalesce(why, F.lit("kept")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""with {LISTS.replace('fs_rank<=20)', 'fs_rank<=200)')}, pos as (select query_id, doc_id pos_id, fs_rank pr, rr ps from lists where rel and fs_rank>50 and fs_rank<=200)
select query_id, pos_id, doc_id, fs_rank as rank from (select pos.query_id, pos_id, l.doc_id, l.fs_rank, row_number() over (partition by pos.query_id, pos_id order by l.fs_rank, l.doc_id) nth
from pos join lists l on l.query_id=pos.query_id and l.fs_rank<pr and l.doc_id<>pos_id where not l.rel and l.rr<ps-0.05) where nth<=20""")
def top50_miner_200(spark, sf):
    """Positives at ranks 51 to 200 of lists 200 deep."""
    x = _lists(spark, sf, 200)
    ranking = x.filter("not rel").select("query_id", "doc_id", F.col("fs_rank").alias("rank"))
    pos = x.filter("rel").select("query_id", F.col("doc_id").alias("pos_id"), F.col("rr").alias("pos_score"))
    both = x.select("query_id", "doc_id", F.col("fs_rank").alias("rank"))
    scores = x.select("query_id", "doc_id", F.col("rr").alias("score"))
    mined = lists.rank_window_negatives(both, pos, scores, 50, 200, 0.05, 10**6).join(ranking, ["query_id", "doc_id", "rank"], "left_semi")
    return records.per_group(mined, ["query_id", "pos_id"], ["rank", "doc_id"], 20).select("query_id", "pos_id", "doc_id", "rank")


# ---------------------------------------------------------------- training sets
@query(f"with {LISTS} select query_id, doc_id, row_number() over (partition by query_id order by rr desc, doc_id) as teacher_rank, round(exp(rr)/sum(exp(rr)) over (partition by query_id),6) as target, case when rr>=0.4 then 1 when rr<=0.2 then 0 end as label from lists")
def listwise_softmax(spark, sf):
    x = lists.teacher_targets(_lists(spark, sf), "rr", positive=0.4, gap=0.2)
    return x.select("query_id", "doc_id", "teacher_rank", _r(F.col("target")).alias("target"), "label")


@query(f"with {LISTS} select case when rr>=0.4 then 'positive' when rr<=0.2 then 'negative' else 'uncertain' end as label, count(*) as n, round(avg(1/(1+exp(-rr))),6) as soft from lists group by 1")
def teacher_rank_labels(spark, sf):
    x = lists.teacher_targets(_lists(spark, sf), "rr", positive=0.4, gap=0.2)
    name = F.when(F.col("label") == 1, "positive").when(F.col("label") == 0, "negative").otherwise("uncertain")
    return x.groupBy(name.alias("label")).agg(F.count(F.lit(1)).alias("n"), _r(F.avg(1 / (1 + F.exp(-F.col("rr"))))).alias("soft"))


@query(f"with {LISTS}, p as (select p.query_id, p.doc_id pos_id, n.doc_id neg_id, row_number() over (partition by p.query_id order by p.doc_id, n.rr desc, n.doc_id) as nth from lists p join lists n on n.query_id=p.query_id and p.rel and not n.rel and p.rr-n.rr>=0.05) select * from p where nth<=8")
def pairwise_examples(spark, sf):
    return lists.pairwise(_lists(spark, sf), "rr", 8, 0.05)


# ---------------------------------------------------------------- hardness, audits, policies
@query(f"with {HARD} select query_id, fs_ndcg, rr_ndcg, oracle_ndcg, delta, bucket from hard")
def hardness_buckets(spark, sf):
    return lists.hardness(_lists(spark, sf))


@query(f"with {HARD} select coalesce(bucket,'all') as bucket, count(*) as n, round(avg(fs_ndcg),6) as first, round(avg(rr_ndcg),6) as reranked, round(avg(oracle_ndcg),6) as oracle, round(avg(delta),6) as lift, count(*) filter (where delta<=-0.2) as catastrophic from hard group by rollup(bucket)")
def lift_report(spark, sf):
    return lists.lift_report(lists.hardness(_lists(spark, sf))).withColumn("bucket", F.coalesce("bucket", F.lit("all")))


def _audit_sql(k):
    return f"select {k} as k, round(avg(case when n>0 then f{k}/n else 0 end),6) as recall, round(avg(case when f{k}=0 then 1 else 0 end),6) as missing from q"


@query(f"with {LISTS}, q as (select query_id, count(*) filter (where rel) n, " + ", ".join(f"count(*) filter (where rel and fs_rank<={k}) f{k}" for k in (5, 10, 20)) + " from lists group by 1) " + " union all ".join(map(_audit_sql, (5, 10, 20))))
def first_stage_audit(spark, sf):
    return lists.audit(_lists(spark, sf))


@query(f"""with {HARD}, l as (select query_id, count(*) n, count(distinct doc_id%3) s, bool_or(rel and fs_rank<=10) h from lists group by 1)
select query_id, fs_ndcg, oracle_ndcg, n as candidates, s as sources from hard join l using(query_id) where fs_ndcg>=0.95 and oracle_ndcg>=0.98 and n>=20 and s>=1 and h""")
def near_ceiling_set(spark, sf):
    x = _lists(spark, sf)
    per = x.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("candidates"), F.count_distinct(F.col("doc_id") % 3).alias("sources"), F.bool_or(F.col("rel") & (F.col("fs_rank") <= 10)).alias("hit10")
    )
    m = lists.hardness(x).join(per, "query_id")
    return m.filter(contracts.near_ceiling(m)).select("query_id", "fs_ndcg", "oracle_ndcg", "candidates", "sources")


_SOFT = "list_transform({a}, lambda x: exp(x-list_max({a}))/list_sum(list_transform({a}, lambda y: exp(y-list_max({a})))))"
_ENTROPY = "round(-list_sum(list_transform(" + _SOFT + ", lambda p: p*ln(p+1e-12))),6)"


@query(f"""with {LISTS}, f as (select query_id, list(fs order by fs_rank) fa, list(rr order by rr_rank) ra, max(abs(fs_rank-rr_rank)) d, max(case when fs_rank=1 then rr_rank-1 end) t, count(*) n, count(distinct doc_id%3) s,
 greatest(count(*) filter (where doc_id%3=0), count(*) filter (where doc_id%3=1), count(*) filter (where doc_id%3=2))/count(*) agree, count(*) filter (where doc_id%3=0) b, count(*) filter (where doc_id%3=1) v from lists group by 1)
select query_id, round(fa[1],6) as first_stage_top1_score, round(fa[2],6) as first_stage_top2_score, round(fa[1]-fa[2],6) as first_stage_top1_top2_gap, round(fa[1]-fa[5],6) as first_stage_top1_top5_gap,
 {_ENTROPY.format(a='fa')} as first_stage_score_entropy, round(agree,6) as candidate_source_agreement, case when b>0 and v>0 then 0.0 end as bm25_dense_agreement, round(ra[1],6) as reranker_top1_score, round(ra[2],6) as reranker_top2_score,
 round(ra[1]-ra[2],6) as reranker_top1_top2_gap, {_ENTROPY.format(a='ra')} as reranker_score_entropy, d as max_rank_displacement, t as reranker_rank_of_first_stage_top1, n as num_candidates, s as num_candidate_sources from f""")
def list_features(spark, sf):
    return policies.nested(_with_sources(_lists(spark, sf))).select("query_id", policies.features(F.col("c")).alias("f")).select("query_id", "f.*")


def _with_sources(x):
    return x.withColumn("source", F.element_at(F.array(*map(F.lit, ("bm25", "dense", "other"))), (F.col("doc_id") % 3).cast("int") + 1))


def _policy_sql(order, extra=""):
    return f"with {LISTS}{extra} select query_id, doc_id, row_number() over (partition by query_id order by {order}) as final_rank from {'m' if extra else 'lists'}"


def _ranked(spark, sf, name, **kw):
    return policies.ranked(_lists(spark, sf), name, **kw).select("query_id", "doc_id", "final_rank")


@query(_policy_sql("case when fs_rank<=3 then fs_rank else 1000 end, rr_rank"))
def policy_topk_lock(spark, sf):
    return _ranked(spark, sf, "topk_lock")


@query(_policy_sql("mix desc, fs_rank", ", m as (select *, round(0.85*(case when mf-nf<1e-12 then 1 else (fs-nf)/(mf-nf) end)+(1-0.85::DOUBLE)*(case when mr-nr<1e-12 then 1 else (rr-nr)/(mr-nr) end),9) mix from (select *, max(fs) over w mf, min(fs) over w nf, max(rr) over w mr, min(rr) over w nr from lists window w as (partition by query_id)))"))
def policy_blend(spark, sf):
    return _ranked(spark, sf, "blend", alpha=0.85)


@query(_policy_sql("case when lead<0.05 and fs_rank=1 then 0 else 1 end, rr_rank", ", m as (select *, max(rr) over (partition by query_id) - max(case when fs_rank=1 then rr end) over (partition by query_id) lead from lists)"))
def policy_margin_override(spark, sf):
    return _ranked(spark, sf, "margin_override", margin=0.05)


@query(_policy_sql("case when sure and fs_rank<=3 then fs_rank else 1000 end, rr_rank", ", m as (select *, max(case when fs_rank=1 then fs end) over (partition by query_id) - max(case when fs_rank=2 then fs end) over (partition by query_id) >= 0.02 sure from lists)"))
def policy_confidence_conditional(spark, sf):
    return _ranked(spark, sf, "confidence_conditional", gap_high=0.02)


def _bounded_sql(down, up, free="false", score="rr"):
    """Placing one document after the other, as a recursion over the places."""
    left = "list_filter(items, lambda e: not list_contains(o, e.f))"
    best = "list_sort(list_transform({l}, lambda e: struct_pack(a:=-e.s, b:=e.f)))[1].b"
    risen = f"list_filter(l, lambda e: e.x or e.f-{up}<=p)"
    return f"""with recursive {LISTS}, own as (select *, max(case when fs_rank=1 then rr end) over (partition by query_id) top from lists),
items as (select query_id, list(struct_pack(f:=(fs_rank-1)::INT, s:={score}, x:={free}, d:=doc_id) order by fs_rank) items, count(*) n from own group by 1),
st as (select query_id, items, n, 0::INT p, []::INT[] o from items union all
 select query_id, items, n, p+1, list_append(o, case when list_min(list_transform(l, lambda e: e.f))+{down}<=p then list_min(list_transform(l, lambda e: e.f))
  else coalesce({best.format(l=risen)}, {best.format(l='l')}) end) from (select *, {left} l from st where p<n))
select query_id, items[f+1].d as doc_id, row_number() over (partition by query_id order by k) as final_rank from (select query_id, items, unnest(o) f, unnest(range(1, n+1)) k from st where p=n)"""


@query(_bounded_sql(3, 1000000))
def policy_bounded_downshift(spark, sf):
    return _ranked(spark, sf, "bounded_downshift", down=3)


@query(_bounded_sql(1000000, 3, "rr-top>=0.2"))
def policy_bounded_upshift(spark, sf):
    return _ranked(spark, sf, "bounded_upshift", up=3, margin=0.2)


_TRIED = {"identity": "fs_rank", "always_rerank": "rr_rank", "top1_lock": "case when fs_rank=1 then 0 else 1 end, rr_rank", "topk_lock": "case when fs_rank<=3 then fs_rank else 1000 end, rr_rank"}
_EVAL = " union all ".join(f"select '{n}' pol, *, row_number() over (partition by query_id order by {o}) p_rank from lists" for n, o in _TRIED.items())


@query(f"""with {HARD}, o as ({_EVAL}), q as (select pol, query_id, {_ndcg('fs_rank')} f, {_ndcg('rr_rank')} a, {_ndcg('p_rank')} p, max(abs(p_rank-fs_rank)) moved,
 bool_and(p_rank=fs_rank) kept, bool_or(p_rank=1 and fs_rank=1) top1 from o group by 1,2)
select pol as policy, count(*) as queries, round(avg(f),6) as first, round(avg(a),6) as raw, round(avg(p),6) as reached, round(avg(p-f),6) as delta, round(avg(p-a),6) as delta_raw,
 round(avg(kept::INT),6) as abstain_rate, round(avg(top1::INT),6) as lock_rate, round(avg((p-f<=-0.2+1e-9)::INT),6) as catastrophic_rate, round(avg(moved),6) as displacement,
 round(avg(case when bucket in ('medium','hard') then p-f end),6) as medium_hard_delta from q join hard using(query_id) group by 1""")
def policy_evaluation(spark, sf):
    return policies.evaluation(policies.judged(_lists(spark, sf), {n: (n, {}) for n in _TRIED}))


def _runs(spark, sf):
    return _t(spark, sf, "labels").groupBy((F.col("doc_id") % 12).alias("run")).agg(
        F.round(F.avg("quality"), 3).alias("quality"), F.round(1 - F.avg("toxic"), 3).alias("clean"),
        F.when(F.col("run") != 3, F.count(F.lit(1)).cast("double")).alias("rows_"),
    )


@query("""with r as (select doc_id%12 as run, round(avg(quality),3) quality, round(1-avg(toxic),3) clean, case when run<>3 then count(*)::DOUBLE end rows_ from labels group by 1)
select * from r a where not exists (select 1 from r b where a.run<>b.run and coalesce(b.quality>=a.quality,true) and coalesce(b.clean>=a.clean,true) and coalesce(b.rows_>=a.rows_,true)
and (coalesce(b.quality>a.quality,false) or coalesce(b.clean>a.clean,false) or coalesce(b.rows_>a.rows_,false)))""")
def pareto_frontier(spark, sf):
    return lists.not_dominated(_runs(spark, sf), "run", ["quality", "clean", "rows_"])


@query(f"with {HARD}, m as (select avg(delta) lift, count(*) filter (where delta<=-0.2)/count(*) cat, avg(oracle_ndcg) o from hard) select 'lift' as \"check\", coalesce(lift>=0,false) as passed from m union all select 'catastrophic', coalesce(cat<=0.05,false) from m union all select 'oracle', coalesce(o>=0.95,false) from m")
def promotion_gate(spark, sf):
    h = lists.hardness(_lists(spark, sf))
    m = h.agg(F.avg("delta").alias("lift"), (F.count_if(F.col("delta") <= -0.2) / F.count(F.lit(1))).alias("cat"), F.avg("oracle_ndcg").alias("o"))
    return gates.checks(m, {"lift": F.col("lift") >= 0, "catastrophic": F.col("cat") <= 0.05, "oracle": F.col("o") >= 0.95})


# ---------------------------------------------------------------- text functions
@query(f"select doc_id, md5({FOLD.format(x='text')}) as folded, md5({COLLAPSED.format(x='text')}) as collapsed, substr(sha256({NFC.format(x='text')}),1,16) as hash16 from documents")
def normalize_forms(spark, sf):
    x = F.col("text")
    return _corpus(spark, sf).select("doc_id", F.md5(tx.fold(x)).alias("folded"), F.md5(tx.collapsed(x)).alias("collapsed"), tx.text_hash(x).alias("hash16"))


@query(f"select lang, sum(len({TOKENS.format(x='text')}))::BIGINT as tokens, sum(len({TOKENS_DE.format(x='text')}))::BIGINT as tokens_de, max(len({TOKENS.format(x='text')})) as longest from documents group by 1")
def tokenize_stats(spark, sf):
    a, b = F.size(tx.tokens(F.col("text"))), F.size(tx.tokens_de(F.col("text")))
    return _corpus(spark, sf).groupBy("lang").agg(F.sum(a).alias("tokens"), F.sum(b).alias("tokens_de"), F.max(a).alias("longest"))


@query(f"select doc_id, case when b<0.1 then 'test' when b<0.1+0.1 then 'dev' else 'train' end as split from (select doc_id, ({HASH60.format(x='doc_id::varchar')}%10000)/10000 b from documents)")
def split_assignment(spark, sf):
    return _corpus(spark, sf).select("doc_id", tx.split_of(F.col("doc_id").cast("string")).alias("split"))


@query(f"with {PAIRS} select 'p'||substr(sha256(substr(sha256({NFC.format(x='query')}),1,16)||'::'||substr(sha256({NFC.format(x='document')}),1,16)),1,16) as id, pair_id from pairs")
def pair_ids(spark, sf):
    return _pairs(spark, sf).select(tx.pair_id(F.col("query"), F.col("document")).alias("id"), "pair_id")


@query(r"""with s as (select text, trim(text) t from conversations where role='user'), w as (select t, len(list_filter(regexp_split_to_array(t,'\s+'), lambda x: x<>'')) n, len(list_filter(regexp_split_to_array(t,'[.!?]+'), lambda x: trim(x)<>'')) s from s)
select case when t='' then 'empty' when s>=2 and n>=12 then 'multi_sentence' when t like '%?' then 'question' when n<=3 then 'keyword' else 'statement' end as style, count(*) as n from w group by 1""")
def query_style_counts(spark, sf):
    u = _t(spark, sf, "conversations").filter("role = 'user'")
    return u.groupBy(tx.query_style(F.col("text")).alias("style")).agg(F.count(F.lit(1)).alias("n"))


@query("select source, case when length(text)<256 then 'short' when length(text)<1024 then 'medium' else 'long' end as bucket, count(*) as n from documents group by 1,2")
def length_bucket_mix(spark, sf):
    return _corpus(spark, sf).groupBy("source", tx.length_bucket(F.col("text")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


_MARK = "[" + ",".join(f"'{m}'" for m in tx.MARKERS_DE) + "]"


@query(f"select lang, case when regexp_matches(lower(text),'[äöüß]') or len(list_intersect(list_distinct(regexp_split_to_array(translate(lower(text),',.','  '),'\\s+')),{_MARK}))>=2 then 'de' else 'unknown' end as hint, count(*) as n from documents group by 1,2")
def language_hint(spark, sf):
    return _corpus(spark, sf).groupBy("lang", tx.language_hint(F.col("text")).alias("hint")).agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- deduplication, leakage, PII
def _dedup_sql(key):
    return f"select doc_id, md5(text) as h from (select *, row_number() over (partition by {key} order by doc_id) rn from documents) where rn=1"


def _dedup(spark, sf, key):
    return records.first_by(_corpus(spark, sf), [key], ["doc_id"]).select("doc_id", F.md5("text").alias("h"))


@query(_dedup_sql("md5(text)"))
def exact_dedup(spark, sf):
    return _dedup(spark, sf, F.md5("text"))


@query(_dedup_sql(f"md5({COLLAPSED.format(x='text')})"))
def normalized_dedup(spark, sf):
    return _dedup(spark, sf, F.md5(tx.collapsed(F.col("text"))))


@query(_dedup_sql("substr(text,1,200)"))
def prefix200_dedup(spark, sf):
    return _dedup(spark, sf, F.substring("text", 1, 200))


def _sides(spark, sf):
    return (
        _corpus(spark, sf).select(F.col("doc_id").alias("cand_id"), "text"),
        _t(spark, sf, "benchmark").select(F.col("item_id").alias("eval_id"), "text"),
    )


def _all_pairs(spark, sf):
    d = _corpus(spark, sf)
    return d.select(F.col("doc_id").alias("cand_id"), "text"), d.select(F.col("doc_id").alias("eval_id"), "text")


@query("select doc_id, item_id from documents d join benchmark b on contains(d.text, b.text)")
def leakage_containment(spark, sf):
    return leakage.contained(_corpus(spark, sf), _t(spark, sf, "benchmark"))


@query()
def leakage_lsh(spark, sf):
    """The best hit of each document among all others."""
    return leakage.best_others(_sides(spark, sf)[0], 0.9)


@query(f"select a.doc_id cand_id, b.doc_id eval_id from documents a join documents b on {COLLAPSED.format(x='a.text')}={COLLAPSED.format(x='b.text')} where a.doc_id<b.doc_id")
def leakage_exact_whole(spark, sf):
    """All pairs of equal documents."""
    return leakage.exact(*_all_pairs(spark, sf)).filter("cand_id < eval_id")


@query(f"""with s as (select doc_id, list_distinct({TOKENS.format(x='text')}) t from documents), e as (select doc_id, unnest(t) tok from s),
p as (select a.doc_id x, b.doc_id y, count(*) c from e a join e b on a.tok=b.tok and a.doc_id<b.doc_id group by 1,2)
select x as cand_id, y as eval_id, round(c/(len(a.t)+len(b.t)-c),4) as score from p join s a on a.doc_id=x join s b on b.doc_id=y where c/(len(a.t)+len(b.t)-c)>=0.6""")
def leakage_jaccard_whole(spark, sf):
    """Token Jaccard of at least 0.6 between all documents, whole texts."""
    return leakage.jaccard_pairs(_sides(spark, sf)[0], None, 0.6)


@query()
def leakage_jaccard_benchmark(spark, sf):
    return leakage.jaccard_pairs(*_sides(spark, sf), 0.6)


@query()
def leakage_lsh_benchmark(spark, sf):
    return leakage.best_hits(leakage.near_duplicates(*_sides(spark, sf), 0.9))


@query()
def leakage_blocking(spark, sf):
    """How many pairs are verified of all there are."""
    return leakage.blocking_report(_sides(spark, sf)[0])


_PII = {"email": r"[\w.+-]+@[\w-]+\.[A-Za-z]{2,}", "iban_de": r"\bDE\d{2}[ ]?(?:\d{4}[ ]?){4}\d{2}\b", "ipv4": r"\b(?:\d{1,3}\.){3}\d{1,3}\b"}


@query("select kind, \"match\", count(*) as n from (" + " union all ".join(f"select '{k}' as kind, unnest(regexp_extract_all(text,'{p}')) as \"match\" from documents" for k, p in _PII.items()) + ") group by 1,2")
def pii_scan(spark, sf):
    found = _corpus(spark, sf).select(F.inline(tx.pii(F.col("text"), ("email", "iban_de", "ipv4"))))
    return found.groupBy("kind", "match").agg(F.count(F.lit(1)).alias("n"))


_PHONES = "(select doc_id, case when doc_id%9=0 then text || ' Tel. 0' || (30000000+doc_id*7919)::varchar || ', mobil: +49 171 ' || (2000000+doc_id)::varchar || '.' else text end t from documents)"


@query(rf"select doc_id, len(regexp_extract_all(t, '(^|[^\w.])((?:\+49|0049|0)\d[\d /()-]{{6,}}\d)', 2)) as n from {_PHONES} where len(regexp_extract_all(t, '(^|[^\w.])((?:\+49|0049|0)\d[\d /()-]{{6,}}\d)', 2))>0")
def pii_phone(spark, sf):
    """Phone numbers are rare in the documents, so every ninth gets two more."""
    more = F.concat(F.col("text"), F.lit(" Tel. 0"), (30000000 + F.col("doc_id") * 7919).cast("string"), F.lit(", mobil: +49 171 "), (2000000 + F.col("doc_id")).cast("string"), F.lit("."))
    x = _corpus(spark, sf).select("doc_id", F.when(F.col("doc_id") % 9 == 0, more).otherwise(F.col("text")).alias("t"))
    return x.select("doc_id", F.size(tx.pii(F.col("t"), ("phone",))).cast("long").alias("n")).filter("n > 0")


# ---------------------------------------------------------------- contracts and variants
_MARKF = "[" + ",".join(f"'{m}'" for m in tx.MARKERS_DE_FOLDED) + "]"


@query(f"""with {PAIRS}, e as (select query q, document p from pairs)
select 'query_length' as error, count(*) as n from e where not length(q) between 8 and 2000 having count(*)>0
union all select 'positive_length', count(*) from e where not length(p) between 8 and 2000 having count(*)>0
union all select 'query_equals_positive', count(*) from e where {FOLD.format(x='q')}={FOLD.format(x='p')} having count(*)>0
union all select 'not_german', count(*) from e where not (regexp_matches(q||' '||p,'[äöüßÄÖÜ]') or len(list_intersect({TOKENS.format(x="(q||' '||p)")},{_MARKF}))>0) having count(*)>0""")
def pair_contract_errors(spark, sf):
    return records.contract_report(records.checked(_pairs(spark, sf), records.pair_rules()))


@query(f"""with {PAIRS} select pair_id, 'number_shift' as variant, md5(regexp_extract(document,'(?s)^(.*?)\\d+(.*)$',1)||(regexp_extract(document,'(\\d+)',1)::BIGINT+1)::varchar||regexp_extract(document,'(?s)^(.*?)\\d+(.*)$',2)) as h from pairs where regexp_matches(document,'\\d+') and length(regexp_extract(document,'(\\d+)',1))<=18
union all select pair_id, 'umlaut_ascii', md5(replace(replace(replace(replace(replace(replace(query,'ä','ae'),'ö','oe'),'ü','ue'),'Ä','Ae'),'Ö','Oe'),'Ü','Ue')) from pairs where regexp_matches(query,'[äöüÄÖÜ]')
union all select pair_id, 'ss_eszett', md5(case when contains(query,'ß') then replace(query,'ß','ss') else regexp_replace(query,'ss','ß') end) from pairs where contains(query,'ß') or contains(query,'ss')""")
def adversarial_variants(spark, sf):
    p = _pairs(spark, sf)
    side = {"query": F.col("query"), "document": F.col("document")}
    chosen = {n: f(side[s]) for n, (s, _, f) in vr.ADVERSARIAL.items() if n in ("number_shift", "umlaut_ascii", "ss_eszett")}
    return p.select("pair_id", vr.expanded(chosen)).select("pair_id", "variant", F.md5("text").alias("h"))


@query()
def all_variants(spark, sf):
    p = _pairs(spark, sf)
    side = {"query": F.col("query"), "document": F.col("document")}
    adv = {n: f(side[s]) for n, (s, _, f) in vr.ADVERSARIAL.items()}
    hard = {f"hard_{n}": f(F.col("document")) for n, f in vr.HARD_NEGATIVES.items()}
    return p.select("pair_id", vr.expanded({**adv, **hard}))


# ---------------------------------------------------------------- sampling
@query("select lang, doc_id from (select lang, doc_id, row_number() over (partition by lang order by doc_id) n from documents) where n<=25")
def domain_cap(spark, sf):
    return records.per_group(_corpus(spark, sf), ["lang"], ["doc_id"], 25).select("lang", "doc_id")


@query("select lang, doc_id from (select lang, doc_id, row_number() over (partition by lang order by md5('0|'||doc_id::varchar), doc_id) n from documents) where (lang='de' and n<=30) or (lang='en' and n<=50) or lang not in ('de','en')")
def domain_targets_sample(spark, sf):
    return records.sample_to_targets(_corpus(spark, sf), "lang", {"de": 30, "en": 50}, "doc_id").select("lang", "doc_id")


@query("select lang, doc_id, n as turn from (select lang, doc_id, row_number() over (partition by lang order by md5(doc_id::varchar), doc_id) n from documents) order by n, lang limit 90")
def round_robin_mix(spark, sf):
    return records.round_robin(_corpus(spark, sf), "lang", [F.md5(F.col("doc_id").cast("string")), "doc_id"], 90).select("lang", "doc_id", "turn")


@query("select source, doc_id from (select source, doc_id, row_number() over (partition by source order by doc_id)-1 pos, greatest(1, count(*) over (partition by source)//10) st from documents) where pos%st=0 and pos/st<10")
def stride_sample(spark, sf):
    return records.stride_sample(_corpus(spark, sf), "source", ["doc_id"], 10).select("source", "doc_id")


@query("with c as (select count(*) filter (where lang<>'en') p from documents) select doc_id, lang from (select doc_id, lang, row_number() over (partition by lang='en' order by md5(doc_id::varchar), doc_id) n from documents), c where lang<>'en' or n<=floor(p*0.35/(1-0.35::DOUBLE))")
def capped_share(spark, sf):
    return records.capped_share(_corpus(spark, sf), F.col("lang") == "en", 0.35, "doc_id").select("doc_id", "lang")


@query("with w as (select source, count(*)::DOUBLE w from documents group by 1), r as (select source, w/sum(w) over ()*997 raw from w), f as (select *, floor(raw) fl, 997-sum(floor(raw)) over () rest, row_number() over (order by round(raw-floor(raw),9) desc, source desc) nth from r) select source, (fl+case when nth<=rest then 1 else 0 end)::BIGINT as budget from f")
def largest_remainder_budget(spark, sf):
    w = _corpus(spark, sf).groupBy("source").agg(F.count(F.lit(1)).cast("double").alias("w"))
    return records.largest_remainder(w, "source", "w", 997)


# ---------------------------------------------------------------- reports
def _cache(spark, sf):
    d = _t(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    return d.join(_t(spark, sf, "labels"), "doc_id", "left").withColumn("score", F.round(F.log10(F.col("n_chars") + 1), 4))


_CACHE = "cache as (select d.doc_id, lang, source, n_chars, quality, toxic, round(log10(n_chars+1),4) score from documents d left join labels using(doc_id))"


@query(f"with {_CACHE} select 'lang' as key, lang as value, count(*) as n from cache group by 2 union all select 'source', source, count(*) from cache group by 2 union all select 'quality', coalesce(quality::varchar,'unknown'), count(*) from cache group by 2")
def cache_counts(spark, sf):
    return aggregates.counts_by(_cache(spark, sf), "lang", "source", "quality")


@query(f"with {_CACHE} select lang, count(score) as n, count(*) filter (where score is null) as missing, round(min(score),4) as min, round(median(score),4) as median, round(avg(score),4) as mean, round(max(score),4) as max from cache group by 1")
def score_distribution(spark, sf):
    return aggregates.distribution(_cache(spark, sf), "score", "lang")


_SWEEP = " union all ".join(f"select key, value, {t}::DOUBLE as threshold, count(*) filter (where score>={t}) as accepted, round(count(*) filter (where score>={t})/greatest(count(score),1),6) as rate from s group by 1,2" for t in (2.0, 3.0, 4.0))


@query(f"with {_CACHE}, s as (select 'all' as key, 'all' as value, score from cache union all select 'lang', lang, score from cache union all select 'source', source, score from cache) {_SWEEP}")
def threshold_sweep(spark, sf):
    return aggregates.threshold_sweep(_cache(spark, sf), "score", ("lang", "source"), (2.0, 3.0, 4.0))


@query(f"with {_CACHE} select lang, count(*) as total, count(*) filter (where source<>'src0') as real, count(*) filter (where source='src0') as synthetic, case lang when 'de' then 100 when 'en' then 700 end as target, count(*) filter (where source<>'src0')>=coalesce(case lang when 'de' then 100 when 'en' then 700 end,0) as met from cache group by 1")
def quota_report(spark, sf):
    return aggregates.quota(_cache(spark, sf), "lang", F.col("source") != "src0", {"de": 100, "en": 700})


@query(f"with {_CACHE}, r as (select lang, count(*) raw_ from cache group by 1), k as (select lang, count(*) cached, count(*) filter (where quality=1) accepted, count(*) filter (where quality=1 and source='src0') s from cache where quality is not null group by 1) select coalesce(r.lang,k.lang) as domain, coalesce(raw_,0) as raw, coalesce(cached,0) as cached, coalesce(accepted,0) as accepted, round(coalesce(accepted,0)/case when raw_>0 then raw_ else cached end,6) as acceptance_rate, round(case when accepted>0 then s/accepted else 0 end,6) as synthetic_share from r full join k on r.lang=k.lang")
def domain_quality(spark, sf):
    c = _cache(spark, sf)
    return aggregates.domain_quality(c, c.filter("quality is not null"), "lang", F.col("quality") == 1, F.col("source") == "src0")


@query(f"with {_CACHE} select lang, (list(score order by score))[count(*)//2+1] as upper_median from cache group by 1")
def upper_median(spark, sf):
    return aggregates.upper_median(_cache(spark, sf), "score", "lang")


@query("select case when n_chars<500 then '[0,500)' when n_chars<1000 then '[500,1000)' when n_chars<5000 then '[1000,5000)' else '>=5000' end as bucket, count(*) as n from documents group by 1")
def length_histogram(spark, sf):
    return aggregates.histogram(_t(spark, sf, "documents"), "n_chars", [0, 500, 1000, 5000])


# ---------------------------------------------------------------- vectors, clusters, merging
@query("""with v as (select vec_id, embedding::DOUBLE[] e, label from embeddings), c as (select label, pos, avg(x) a from (select label, unnest(e) x, unnest(range(1,65)) pos from v where vec_id%2=0) group by 1,2),
ce as (select label, list(a order by pos) c from c group by 1), s as (select vec_id, v.label, ce.label p, row_number() over (partition by vec_id order by round(list_cosine_similarity(e,c),9) desc, ce.label) n from v, ce where vec_id%2=1)
select round(avg(case when label=p then 1 else 0 end),6) as accuracy from s where n=1""")
def nearest_centroid_accuracy(spark, sf):
    v = _vectors(spark, sf).withColumn("vector", F.col("vector").cast("array<double>")).withColumnRenamed("doc_id", "id")
    p = clustering.nearest_centroid(v.filter("id % 2 = 0"), v.filter("id % 2 = 1"))
    return metrics.accuracy(p, "label", "predicted")


@query(f"with {LISTS}, r as (select *, (rank() over (order by fs)+ (count(*) over (partition by fs)-1)/2) a, (rank() over (order by rr)+(count(*) over (partition by rr)-1)/2) b from lists) select round(corr(a,b),6) as spearman from r")
def sts_spearman(spark, sf):
    return metrics.spearman(_lists(spark, sf).select("fs", "rr"), "fs", "rr")


@query("""with x as (select lang t, source c from documents), n as (select count(*)::DOUBLE n from x), j as (select t,c,count(*)::DOUBLE k from x group by 1,2), a as (select *, sum(k) over (partition by t) kt, sum(k) over (partition by c) kc from j),
e as (select sum(-k/n*ln(k/kc)) htc, sum(-k/n*ln(k/kt)) hct, sum(-k/n*ln(kt/n)) ht, sum(-k/n*ln(kc/n)) hc from a, n), m as (select 1-htc/ht h, 1-hct/hc c from e) select round(h,6) as homogeneity, round(c,6) as completeness, round(2*h*c/(h+c),6) as v_measure from m""")
def v_measure(spark, sf):
    return metrics.v_measure(_corpus(spark, sf), "lang", "source")


@query()
def kmeans_fixed_init(spark, sf):
    v = _vectors(spark, sf).select(F.col("doc_id").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    return clustering.kmeans(v, 8)


def _all_parents(spark, sf):
    return _t(spark, sf, "embeddings").select((F.col("vec_id") % 10).alias("key"), (F.col("vec_id") / 10).cast("int").alias("parent"), F.col("embedding").alias("vector"))


@query("select key, pos, round(avg(x),6) as v from (select vec_id%10 as key, unnest(embedding::DOUBLE[]) x, unnest(range(0,64)) pos from embeddings) group by 1,2")
def merge_mean_all(spark, sf):
    return _cells(merging.mean(_all_parents(spark, sf)))


def _cells(df):
    return df.select("key", F.posexplode("vector").alias("pos", "v")).select("key", F.col("pos").cast("long").alias("pos"), _r(F.col("v")).alias("v"))


@query()
def merge_ties(spark, sf):
    p = _all_parents(spark, sf)
    return _cells(merging.ties(p.filter("parent > 0"), p.filter("parent = 0").drop("parent"), 0.4))


# ---------------------------------------------------------------- events
@query("select date_trunc('hour', ts) as window_start, event_type, count(*) as n, round(sum(value),4) as value from events group by 1,2")
def tumbling_counts(spark, sf):
    return ev.tumbling(_t(spark, sf, "events")).withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


@query("with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end s from events), i as (select *, sum(s) over (partition by user_id order by ts rows unbounded preceding) sid from g) select user_id, min(ts) as session_start, count(*) as n from i group by user_id, sid")
def session_windows(spark, sf):
    return ev.sessions(_t(spark, sf, "events")).withColumn("session_start", F.col("session_start").cast("timestamp_ntz"))


@query("select event_type, count(*) as n from (select distinct user_id, event_type, date_trunc('minute', ts) m from events) group by 1")
def dedup_events(spark, sf):
    e = _t(spark, sf, "events").withColumn("m", F.date_trunc("minute", "ts"))
    return ev.distinct_events(e, "user_id", "event_type", "m").groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- relational checks
@query("select n_name, count(*) as orders, round(sum(o_totalprice),2) as total from orders join customer on o_custkey=c_custkey join nation on c_nationkey=n_nationkey group by 1")
def star_join_agg(spark, sf):
    o, c, n = (_t(spark, sf, t) for t in ("orders", "customer", "nation"))
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"))
    return j.groupBy("n_name").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


@query("select coalesce(l_returnflag,'all') as flag, coalesce(l_linestatus,'all') as status, count(*) as n, round(sum(l_quantity),2) as qty from lineitem group by rollup(l_returnflag, l_linestatus)")
def rollup_revenue(spark, sf):
    r = _t(spark, sf, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))
    return r.select(F.coalesce("l_returnflag", F.lit("all")).alias("flag"), F.coalesce("l_linestatus", F.lit("all")).alias("status"), "n", "qty")


@query("select o_custkey, o_orderkey, n as rank from (select *, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) n from orders) where n<=2")
def window_rank(spark, sf):
    r = records.per_group(_t(spark, sf, "orders"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 2)
    return r.select("o_custkey", "o_orderkey", F.col("nth").alias("rank"))


@query("select count(*) filter (where x) as with_orders, count(*) filter (where not x) as without from (select c_custkey in (select o_custkey from orders) x from customer)")
def semi_anti_orders(spark, sf):
    c, o = _t(spark, sf, "customer"), _t(spark, sf, "orders").select("o_custkey")
    on = F.col("c_custkey") == F.col("o_custkey")
    a = c.join(o, on, "left_semi").agg(F.count(F.lit(1)).alias("with_orders"))
    b = records.missing_references(c, "c_custkey", o, "o_custkey").agg(F.count(F.lit(1)).alias("without"))
    return a.crossJoin(b)  # two single rows
