"""Contracts, training sets, caches, policies, gates, admission, questions and hooks, against small
brute force and edge cases."""

import hashlib
import itertools
import math
import time
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from sedimark.functions import inference, nested, questions
from sedimark.functions import text as tx
from sedimark.functions import vectors as vx
from sedimark.operators import admission, contracts, gates, leakage, lexical, merging, metrics, policies, records, retrieval, teacher, training

LONG = "query_id long, doc_id long, fs double, rr double, rel boolean, fs_rank int, rr_rank int, source string, text string"


def some_lists(spark, n=12, size=9, seed=0):
    rng = np.random.default_rng(seed)
    rows = []
    for q in range(n):
        m = size if q else 1
        fs = np.sort(rng.normal(size=m).round(1))[::-1]
        rr = rng.normal(size=m).round(1)
        place = {int(i): k + 1 for k, i in enumerate(sorted(range(m), key=lambda i: (-rr[i], i)))}
        rows += [(q, i, float(fs[i]), float(rr[i]), bool(rng.random() < 0.3), i + 1, place[i], ["bm25", "dense", "e5"][i % 3], f"text {i % 4} w") for i in range(m)]
    return rows, spark.createDataFrame(rows, LONG)


def ndcg(rel, order, k=10):
    n = sum(rel)
    top = sum(1 / math.log2(p + 2) for p, i in enumerate(order[:k]) if rel[i])
    return top / sum(1 / math.log2(p + 2) for p in range(min(n, k))) if n else 0.0


def valid_best(m, score, down, up, free, head=()):
    """The lexicographically best order by (score, place) at each place among those that let every
    document keep its bounds, by trying what fits place by place."""
    order = list(head)
    for p in range(len(head), m):
        left = [i for i in range(m) if i not in order]
        if down is not None and min(left) + down <= p:
            order.append(min(left))
            continue
        fits = [i for i in left if up is None or free[i] or i - up <= p] or left
        order.append(sorted(fits, key=lambda i: (-score[i], i))[0])
    return order


def test_bounded_policies(spark):
    rows, x = some_lists(spark)
    by = {q: [r for r in rows if r[0] == q] for q in {r[0] for r in rows}}
    for name, params in (("bounded_downshift", {"down": 1}), ("bounded_downshift", {"down": 4}), ("bounded_upshift", {"up": 1, "margin": 99.0}), ("bounded_upshift", {"up": 2, "margin": 0.5})):
        got = {}
        for r in policies.ranked(x, name, **params).orderBy("query_id", "final_rank").collect():
            got.setdefault(r.query_id, []).append(r.doc_id)
        for q, c in by.items():
            rr = [r[3] for r in c]
            free = [v - rr[0] >= params.get("margin", 0) for v in rr]
            assert got[q] == valid_best(len(c), rr, params.get("down"), params.get("up"), free)
            for p, d in enumerate(got[q]):
                assert "down" not in params or p <= d + params["down"]
    with pytest.raises(ValueError):
        policies.ranked(x, "none")


def test_all_policies_are_orders(spark):
    """Every policy keeps every candidate once; a list of one stays; nDCG by brute force."""
    rows, x = some_lists(spark)
    by = {q: [r for r in rows if r[0] == q] for q in {r[0] for r in rows}}
    params = {"gap_high": 0.3, "gap_low": 0.1, "alpha": 0.5, "k": 2, "rr_gap": 0.1, "most_moved": 3}
    judged = {(r.query_id, r.policy): r for r in policies.judged(x, {n: (n, params) for n in policies.NAMES}).collect()}
    for name in policies.NAMES:
        order = {}
        for r in policies.ranked(x, name, **params).orderBy("query_id", "final_rank").collect():
            order.setdefault(r.query_id, []).append(r.doc_id)
        for q, c in by.items():
            assert sorted(order[q]) == list(range(len(c)))
            assert judged[q, name].reached == pytest.approx(ndcg([r[4] for r in c], order[q]), abs=1e-6)
            assert judged[q, name].kept == (order[q] == list(range(len(c))))
            assert judged[q, name].moved == max(abs(p - d) for p, d in enumerate(order[q]))


def test_search_and_quantiles(spark):
    rows, x = some_lists(spark)
    tried = {n: (n, {"k": 2}) for n in ("identity", "always_rerank", "topk_lock")}
    found = policies.search(x, tried, sure_gap=0.0, keep=0.9).orderBy("nth").collect()
    assert [r.safe for r in found] == sorted([r.safe for r in found], reverse=True)
    assert {r.policy: r.top1_keep for r in found}["identity"] == 1.0 and found[0].safe
    safe = [r.reached for r in found if r.safe]
    assert safe == sorted(safe, reverse=True)
    v = spark.createDataFrame([(float(i),) for i in (5, 1, 1, 2, 9)], "v double")
    s = sorted((5, 1, 1, 2, 9))
    assert policies.nearest_rank(v, "v", [0.0, 0.4, 0.5, 1.0]) == {q: s[int(round(q * 4))] for q in (0.0, 0.4, 0.5, 1.0)}
    assert policies.nearest_rank(v.limit(0), "v", [0.5]) == {0.5: 0.0}


def test_serving(spark):
    rows, x = some_lists(spark)
    by = {q: [r for r in rows if r[0] == q] for q in {r[0] for r in rows}}
    served = {}
    for r in policies.serve(x, margin=1.0).orderBy("query_id", "final_rank").collect():
        served.setdefault(r.query_id, []).append(r)
    for q, c in by.items():
        rr, fs = [r[3] for r in c], [r[2] for r in c]
        best = max(range(len(c)), key=lambda i: (rr[i], -i))
        over = rr[best] - rr[0] >= 1.0 and best != 0
        head = ([best, *(i for i in range(min(3, len(c))) if i != best)][:3]) if over else list(range(min(3, len(c))))
        scale = lambda a: [1.0 if max(a) - min(a) < 1e-12 else (v - min(a)) / (max(a) - min(a)) for v in a]
        alpha = 0.65 if over else 0.85
        mix = [round(alpha * a + (1 - alpha) * b, 9) for a, b in zip(scale(fs), scale(rr))]
        free = [v - rr[0] >= 1.0 for v in rr]
        want = valid_best(len(c), mix, 2, 5, free, head)
        assert [r.doc_id for r in served[q]] == want
        assert served[q][0].margin_override == over
        assert [r.action for r in served[q]][: len(head)] == (["margin_override"] if over else []) + ["locked"] * (len(head) - over)
    d = {r.query_id: r for r in policies.serving_diagnostics(policies.serve(x, margin=1.0)).collect()}
    assert d[0].candidates == 1 and d[0].max_downshift == 0
    assert all(r.action == "kept_first_stage" for r in policies.serve(x, "first_stage_only").collect())
    with pytest.raises(ValueError):
        policies.serve(x, "raw_rerank")
    with pytest.raises(ValueError):
        policies.serve(x, "other")
    assert policies.serve(x, "raw_rerank", allow_raw=True).filter("final_rank <> reranker_rank").count() == 0


def test_error_classes(spark):
    near, far = "a b c d e f g h", "x y"
    cases = {
        1: [(0, 3.0, 0.0, True, "s", near), *((i, 2.0 - i / 9, 5.0 + i, False, "s", far) for i in range(1, 12))],
        2: [(0, 3.0, 1.0, False, "s", far), (1, 2.5, 0.0, True, "s", near), *((i, 2.0 - i / 9, 5.0 + i, False, "s", far) for i in range(2, 12))],
        3: [(0, 3.0, 0.0, True, "s", "kurz"), (1, 2.0, 1.0, False, "s", "lang " * 9)],
        4: [(0, 3.0, 0.0, True, "s", near), (1, 2.0, 1.0, False, "s", near[:-2])],
        5: [(0, 3.0, 0.0, True, "s", near), (1, 2.0, 1.0, False, "t", "anders ganz")],
        6: [(0, 3.0, 0.0, True, "s", near), (1, 2.9, 1.0, False, "s", "anders ganz")],
        7: [(0, 3.0, 0.0, True, "s", "w " * 40), (1, 2.0, 1.0, False, "s", "anders ganz")],
        8: [(0, 3.0, 0.0, False, "s", near), (1, 2.0, 1.0, False, "s", "anders ganz")],
    }
    rows = []
    for q, cs in cases.items():
        place = {c[0]: k + 1 for k, c in enumerate(sorted(cs, key=lambda c: (-c[2], c[0])))}
        rows += [(q, d, fs, rr, rel, d + 1, place[d], s, t) for d, fs, rr, rel, s, t in cs]
    x = spark.createDataFrame(rows, LONG)
    got = {r.query_id: r.e for r in policies.nested(x).select("query_id", policies.error_type(F.col("c"), F.lit("zwei Worte")).alias("e")).collect()}
    assert got == {
        1: "lexical_exact_positive_demoted", 2: "positive_demoted_from_top1_or_top3", 3: "reranker_promotes_longer_but_wrong_doc",
        4: "duplicate_or_near_duplicate_confusion", 5: "candidate_source_artifact", 6: "insufficient_first_stage_features", 7: "query_style_mismatch", 8: "unknown",
    }
    drops = {r.query_id: r.fixable_by for r in policies.catastrophes(x, x.select("query_id", F.lit("zwei Worte").alias("query")).distinct()).collect()}
    assert "top1_lock" in drops[1] and set(drops) >= {1, 2, 3}
    kinds = {r.category for r in policies.failures(x, margin=0.5).collect()}
    assert kinds <= set(policies.REMEDIES)
    flat = spark.createDataFrame([(1, 0, 1.0, 0.0, False, 1, 2, "s", "a"), (1, 1, 1.0, 9.0, True, 2, 1, "s", "b")], LONG)
    assert [r.category for r in policies.failures(flat, margin=99.0).collect()] in ([], ["no_useful_first_stage_score"])


def test_first_stage_orders(spark):
    kind = "query_id long, doc_id long, first_stage_rank int, first_stage_score double, reranker_score double, ord int"
    rows = [(1, 10, 2, 0.9, 0.1, 0), (1, 11, 1, 0.1, 0.2, 1), (2, 10, None, 0.1, None, 0), (2, 11, 1, 0.9, None, 1), (3, 10, None, None, 1.0, 0), (3, 11, 1, None, 1.0, 1)]
    c = spark.createDataFrame(rows, kind)
    order = lambda df: {q: [r.doc_id for r in df.filter(f"query_id = {q}").orderBy("fs_rank").collect()] for q in (1, 2, 3)}
    assert order(policies.first_stage(c)) == {1: [11, 10], 2: [11, 10], 3: [10, 11]}
    assert order(policies.first_stage(c, scored_first=True)) == {1: [10, 11], 2: [11, 10], 3: [10, 11]}
    m = {(r.query_id, r.doc_id): r for r in policies.with_missing_ranks(c).collect()}
    assert m[3, 10].unranked and m[3, 10].first_stage_rank == 2 and not m[2, 10].unranked


# ------------------------------------------------------------------ contracts and training sets
def test_ids_ignore_the_spelling_of_bytes(spark):
    a = spark.createDataFrame([("Wie  geht das?", "Übung"), ("Wie geht das?", unicodedata.normalize("NFD", "Übung"))], "query string, document string")
    assert a.select(tx.pair_id(F.col("query"), F.col("document"))).distinct().count() == 1
    h = lambda x: hashlib.sha256(x.encode()).hexdigest()[:16]
    assert a.select(tx.pair_id(F.col("query"), F.col("document")).alias("p")).first().p == "p" + h(h("Wie geht das?") + "::" + h("Übung"))
    c = contracts.canonical_pairs(a.withColumn("domain", F.lit(""))).first()
    assert c.query_id == "q" + h("Wie geht das?") and c.domain == "unknown" and c.positive is True and c.metadata == {}


def test_list_contracts(spark):
    kind = "query_id string, query string, positive_doc_ids array<string>, candidates array<struct<doc_id:string,text:string,candidate_source:string,label:int,teacher_score:double,first_stage_rank:int,first_stage_score:double>>"
    ok = ("q", "x", ["a"], [("a", "t", "bm25", 1, 1.0, 1, None), ("b", "t", None, 0, None, 2, None)])
    rows = [ok, ("q", " ", None, []), ("q", "x", [], [("", None, "other", 7, None, None, None), ("c", "t", None, 0, None, None, 0.1)]), (None, None, None, None)]
    df = spark.createDataFrame(rows, kind)
    errs = [r.errors for r in records.checked(df, contracts.candidate_list_rules(True)).collect()]
    assert errs[0] == [] and errs[1] == ["missing_query", "candidates_empty"]
    assert errs[2] == ["candidate_without_id", "candidate_without_text", "candidate_source_unknown", "candidate_label", "no_positive"]
    assert errs[3] == ["missing_query_id", "missing_query", "candidates_empty"]
    served = [r.errors for r in records.checked(df, contracts.ranked_list_rules()).collect()]
    assert served[0] == [] and served[2] == ["candidate_without_id", "candidate_without_order"]
    assert [r.errors for r in records.checked(df, contracts.listwise_rules()).collect()][0] == []
    q = spark.createDataFrame([("q", "x", "d", "s", ["a"], {"answer_type": "faq"}), ("q", "x", "d", "s", [""], {"answer_type": "song"})], "query_id string, query string, domain string, source string, positive_doc_ids array<string>, metadata map<string,string>")
    assert [r.errors for r in records.checked(q, contracts.eval_query_rules()).collect()] == [[], ["positive_doc_ids", "answer_type"]]
    assert contracts.report({"a": (df.limit(0), contracts.ranked_list_rules())}).count() == 0


def test_training_lists(spark):
    kind = "query string, positive_doc_ids array<string>, candidates array<struct<doc_id:string,document:string,label:int,teacher_score:double,teacher_softmax_target:double,high_precision_positive:boolean>>"
    whole = [("a", "A", 1, 5.0, 0.75, True), ("b", "B", 0, 1.0, 0.25, False)]
    rows = [("q1", None, whole), ("q2", ["x"], [("x", "X", None, 1.0, None, None), ("y", "Y", 0, None, None, None)]), ("q3", [], [("z", "Z", 0, 1.0, None, None)]), ("q4", None, None)]
    df = spark.createDataFrame(rows, kind)
    present, absent = training.by_presence(df)
    assert {r.query for r in present.collect()} == {"q1", "q2"} and {r.query for r in absent.collect()} == {"q3", "q4"}
    t = {r.query: r for r in training.listwise(df, enriched=True).collect()}
    assert set(t) == {"q1", "q2"} and t["q1"].target == [0.75, 0.25] and t["q2"].target[0] == pytest.approx(1) and t["q2"].high_precision == [False, False]
    assert [tuple(r) for r in training.pointwise(df, confident=True).collect()] == [("q1", "A", 1.0), ("q1", "B", 0.0), ("q2", "Y", 0.0), ("q3", "Z", 0.0)]
    assert [tuple(r) for r in training.pairs(df, 8, 2.0).collect()] == [("q1", "A", "B", 1)]
    assert training.regression(df).count() == 4
    many = spark.createDataFrame([("q", None, [(str(i), str(i), int(i < 4), float(i < 4) * 9, None, None) for i in range(12)])], kind)
    assert [(r.positive, r.negative) for r in training.pairs(many, 10).collect()] == [("0", str(i)) for i in range(4, 12)] + [("1", "4"), ("1", "5")]


def test_embedder_sets(spark):
    pairs = spark.createDataFrame(
        [("q1", "d1", "web", None, None, None), ("q2", "d2", "faq_real", True, 3.0, None), ("q3", "d3", "faq_real", True, 5.0, None), ("q4", "d4", "mteb", None, None, None), (" ", "d5", "web", None, None, None), ("q6", "d6", None, None, None, True)],
        "query string, document string, domain string, must_teacher_validate boolean, teacher_score double, eval_only boolean",
    )
    mined = spark.createDataFrame([("q1", "d1", "n1", 5.0, 1.0, None), ("q1", "d1", "n2", 5.0, 2.0, None)], "query string, positive string, negative string, positive_score double, negative_score double, domain string")
    scores = spark.createDataFrame([("q1", "d1", 4.5)], "query string, document string, teacher_score double")
    got = {(r.query, tuple(r.negatives)): (r.pos_score, r.domain) for r in training.embedder_set(pairs, mined, scores).collect()}
    assert got == {("q1", ()): (4.5, "web"), ("q3", ()): (None, "faq_real"), ("q1", ("n1", "n2")): (5.0, "webfaq2")}
    assert {(r.name, r.reason): r.n for r in training.leaks(pairs=pairs, mined=mined).collect()} == {("pairs", "eval_only=true"): 1, ("pairs", "domain references a public benchmark"): 1}
    ex = spark.createDataFrame([(i, "faq" if i < 30 else f"d{i % 2}") for i in range(40)], "id long, domain string")
    kept = training.interleaved(ex, "id", 0.5).collect()
    stride = 30 / 10
    assert sorted(r.id for r in kept if r.domain == "faq") == sorted({int(j * stride) for j in range(10)})
    assert sum(r.domain != "faq" for r in kept) == 10 and {r.turn for r in kept if r.domain == "d0"} == set(range(5))
    r = training.set_metadata(training.embedder_set(pairs, mined, scores)).first()
    assert (r.examples, r.with_negatives, r.negatives, r.with_scores) == (3, 1, 2, 2)
    promo = spark.createDataFrame([("q", "p", None, pr, [("n", 3, 1.0, 2.0), ("", 4, 1.0, 2.0)]) for pr in (50, 51, 200, 201)], "query string, positive string, domain string, positive_rank int, negatives array<struct<text:string,rank:int,teacher_score:double,margin:double>>")
    assert {r.positive_rank for r in training.rank_promotion(promo).collect()} == {51, 200}


def test_import_shapes(spark):
    a = spark.createDataFrame([("q", "p", 0.0, ["x", "y"], [1.0, 2.0])], "question string, answer string, positive_score double, hard_negatives array<string>, negative_scores array<double>")
    r = contracts.import_rows(a).first()
    assert r.positive_score is None and [n.score for n in r.negatives] == [1.0, 2.0] and r.query_id.startswith("d")
    assert records.checked(contracts.import_rows(a), contracts.import_rules()).first().errors == ["positive_score", "license"]
    b = spark.createDataFrame([("q", "p", 9.0, [("x", 1.0), ("y", 8.9), ("z", 7.5), (" ", 1.0), ("w", None)], "mit")], "query string, document string, positive_ce_score double, negatives array<struct<text:string,ce_score:double>>, license string")
    m = training.margins(contracts.import_rows(b))
    r = m.first()
    assert [n.document for n in r.kept] == ["x"] and [n.document for n in r.false_negatives] == ["y"] and [n.document for n in r.insufficient] == ["z"]
    assert training.triplets(m).first().teacher_margin == 8.0
    c = training.reranker_lists(m).first().candidates
    assert [x.is_positive for x in c] == [True, False] and sum(x.target for x in c) == pytest.approx(1, abs=1e-5)
    assert training.import_report(m).first().kept == 1


def test_teacher_cache(spark):
    kind = "query_id long, doc_id long, query string, document string, positive boolean, reranker_score double, embedding_score double, domain string, license string, metadata map<string,string>"
    rows = [(1, 1, "q", "d", True, 5.0, None, None, "mit", {"domain": "web"}), (1, 2, "q", "e", None, None, 2.5, "web", None, None), (1, 3, "q", "f", False, 9.0, None, None, "unknown", None), (1, 4, "q", "g", True, None, None, "", "mit", None)]
    df = spark.createDataFrame(rows, kind)
    assert {r.doc_id for r in teacher.filter_positives(df, 2.0).collect()} == {1, 2}
    assert {r.doc_id for r in teacher.filter_positives(df, 2.0, {"web": 3.0}).collect()} == {1}
    report = teacher.calibration(df)
    every = report.filter("domain is null").first()
    assert (every.positives, every.embedder_accepted, every.reranker_accepted, every.unknown_license) == (3, 2, 1, 2)
    assert {r.domain for r in report.collect()} == {None, "web", "unknown"}
    assert not teacher.calibration_gate(report).filter("check = 'license_unknown_rows_zero'").first().passed
    assert teacher.calibration(df.limit(0)).count() <= 1
    assert [r.doc_id for r in teacher.rejected_high(df, 4.0).collect()] == [3]
    p = teacher.preview(df, 2, reranker_model="r").collect()
    assert len(p) == 2 and p[0].reranker_score is None and p[0].created_at == "<dry-run>" and p[0].license == "mit"
    assert df.select(teacher.effective_margin(F.lit(5.0), "margin_or_ratio", 0.1, 0.95).alias("m")).first().m == pytest.approx(0.25)
    assert {(r.key, r.value): r.n for r in teacher.counts(df, "domain").collect()} == {("domain", "web"): 2, ("domain", "unknown"): 2}


# ------------------------------------------------------------------ gates, admission, nested
def test_gates_fail_closed(spark):
    none = spark.createDataFrame([], "eval_set string, metrics map<string,double>")
    assert gates.verdict(gates.judge(none, gates.DENSE)).first().status == "fail"
    assert gates.verdict(gates.judge(none, gates.SERVED_POLICY)).first().status == "fail"
    good = spark.createDataFrame([("webfaq", {"recall_at_100": 0.95, "positive_in_top_50": 0.9, "oracle_ndcg_at_10": 0.95}), ("local_rag", {})], none.schema)
    judged, stop = gates.dense_recall(good)
    assert judged.count() == 3 and stop.first().status == "pass" and not stop.first().stop
    bad = spark.createDataFrame([("webfaq", {"recall_at_100": 0.5, "positive_in_top_50": None, "oracle_ndcg_at_10": 0.95})], none.schema)
    assert gates.dense_recall(bad)[1].first().positives_absent
    policy = good.withColumn("ranking_mode", F.lit("policy_gated"))
    assert {r.check for r in gates.raw_reranker(policy).filter("not passed").collect()} >= {"raw_only:webfaq", "raw_only:local_rag"}
    tasks = lambda rows: spark.createDataFrame(rows, "task string, score double")
    peers = spark.createDataFrame([("p", "a", 0.5), ("q", "a", 0.6), ("q", "b", 0.2)], "peer string, task string, score double")
    out = {r.check: r.passed for r in gates.frontier(tasks([("a", 0.7), ("b", 0.3)]), peers, tasks([("a", 0.7)]), leakage="unknown").collect()}
    assert out == {"beats_peer_frontier_aggregate": True, "baseline_present": True, "no_regress_a": True, "no_regress_b": False, "leakage_clean": False}
    assert not {r.check: r.passed for r in gates.frontier(tasks([("a", 0.7)]), peers, tasks([])).collect()}["baseline_present"]
    assert {r.check: r.passed for r in gates.headroom(tasks([("m", 0.4)]), tasks([("m", 0.3)]), "m", 0.39, bidirectional=False).collect()} == {"no_regress_m": True, "m_headroom": True, "bidirectional_patch_applied": False}


def test_run_score(spark):
    kind = "metrics map<string,double>, vram_gb double, throughput double, status string, mode string, leakage_hits int, leakage_status string, retention double"
    m = {"webfaq_recall_at_100": 0.9, "webfaq_ndcg10": 0.7, "webfaq_mrr@10": 0.6, "germanquad_ndcg@10": 0.8, "dt_test_ndcg@10": 0.9}
    base = spark.createDataFrame([(m, 10.0, 100.0, "ok", "real", 0, "clean", 0.97)], kind)
    up = {**m, "webfaq_recall_at_100": 0.95, "germanquad_ndcg@10": 0.78}
    run = spark.createDataFrame([(up, 12.0, 50.0, "ok", None, 0, "clean", 0.94)], kind)
    scored, checks = gates.run_score(run, base)
    r = scored.first()
    assert r.score == pytest.approx(2 * 0.05 - 3 * 0.015 - 2 * 0.01 - 0.2 * 0.2 - 0.2 * 0.5)
    assert {c.check for c in checks.collect() if not c.passed} == {"germanquad_ndcg@10_delta", "matryoshka_256_retention"}
    empty = spark.createDataFrame([({}, None, None, None, "dry-run", None, None, None)], kind)
    failed = {c.check for c in gates.run_score(empty, empty)[1].collect() if not c.passed}
    assert failed == {"not_a_real_run", "baseline_incomplete", "leakage", "germanquad_ndcg@10_delta", "dt_test_ndcg@10_delta", "matryoshka_256_retention", "webfaq_recall@100_present", "webfaq_ndcg@10_present"}
    runs = spark.createDataFrame([("a", {"q": 1.0, "cost": 2.0}, 3.0), ("b", {"r": 1.0}, None)], "label string, metrics map<string,double>, vram double")
    assert gates.objectives(runs, ["cost"]) == ["q", "r"] and gates.objectives(runs, ["cost"], ["cost"]) == ["cost", "q", "r"]
    assert [r.label for r in gates.tie_break(runs, "label", {"vram": "lower"}).orderBy("nth").collect()] == ["a", "b"]


def test_choice_of_default(spark):
    kind = "name string, quality double, latency_ms double, harness string, retention double"
    pick = lambda rows, **k: tuple(gates.choose(spark.createDataFrame(rows, kind), 100.0, 0.01, **k).first())[:2]
    assert pick([("a", 0.9, 50.0, "h", None)]) == ("insufficient_comparison", None)
    assert pick([("a", 0.9, 50.0, "h", None), ("b", 0.8, 5.0, "g", None)]) == ("inconsistent_harness", None)
    assert pick([("a", 0.9, 50.0, "h", None), ("b", 0.895, 5.0, "h", None), ("c", 0.99, 500.0, "h", None)]) == ("selected", "b")
    assert pick([("a", 0.9, 500.0, "h", None), ("b", 0.8, 500.0, "h", None)]) == ("no_eligible_candidate", None)
    assert pick([("a", 0.9, 50.0, "h", 0.9), ("b", 0.8, 5.0, "h", 0.99)], min_retention=0.95) == ("selected", "b")


def test_manifests(spark, tmp_path):
    ok = '{"source_id": "s", "display_name": "S", "domain": "web", "source_type": "local_jsonl", "license": "mit", "license_verified": true, "allowed_for_training": true, "eval_only": false, "public_benchmark": false, "loader": {"kind": "jsonl", "path_or_id": "x"}}'
    write = lambda name, *sources: (tmp_path / name).write_text('{"sources": [' + ",".join(sources) + "]}") and str(tmp_path / name)
    assert admission.load_manifest(spark, write("a.json", ok)).count() == 1
    assert admission.load_manifest(spark, write("a.json", ok), strict=True).count() == 1
    for broken, name in ((ok.replace('"mit"', '"unknown"'), "trains_on_uncertain_license"), (ok.replace('"eval_only": false', '"eval_only": true'), "trains_on_eval"), (ok.replace('"kind": "jsonl"', '"kind": "ftp"'), "loader")):
        with pytest.raises(ValueError, match=name):
            admission.load_manifest(spark, write("b.json", broken))
    with pytest.raises(ValueError, match="duplicate"):
        admission.load_manifest(spark, write("c.json", ok, ok))
    with pytest.raises(ValueError, match="not found"):
        admission.load_manifest(spark, str(tmp_path / "none.json"))
    (tmp_path / "cat.json").write_text('{"train_pairs_raw_sources": [{"id": "a", "path": "p", "leakage": "clean", "training_usable": true}, {"id": "b", "leakage": "dirty", "training_usable": true}], "train_pairs_processed_unions": [{"id": "a", "path": "old"}], "eval_only_NEVER_TRAIN": [{"id": "e"}]}')
    trainable, never = admission.load_catalogue(spark, str(tmp_path / "cat.json"))
    assert {r.id: r.path for r in trainable.collect()} == {"a": "p", "b": None}
    assert [r.budget for r in admission.check_mixture({"a": 2}, 7, trainable, never).collect()] == [7]
    for weights, total, why in (({"e": 1}, 5, "evaluation"), ({"b": 1}, 5, "clean"), ({"x": 1}, 5, "unknown"), ({"a": 0}, 5, "above 0"), ({"a": 1}, 0, "positive"), ({}, 5, "sources")):
        with pytest.raises(ValueError, match=why):
            admission.check_mixture(weights, total, trainable, never)


def test_provenance_and_candidates(spark):
    sources = spark.createDataFrame([("s", "web", "mit", "http://l", True), ("g", "web", "synthetic-inherits-source", None, True), ("n", "web", "mit", None, False)], "source_id string, domain string, license string, license_url string, allowed_for_training boolean")
    rows = spark.createDataFrame([("s", "Wie geht das hier?", "So geht das gut.", None), ("s", "Wie  geht das hier?", "So geht das gut.", None), ("g", "Was ist das da?", "Das ist ein Ding.", "cc-by-4.0"), ("n", "q", "d", None), ("s", "Mail an a@b.de", "x", None), (None, "q", "d", None), ("s", "Leck?", "Ein Prüftext.", None)], "source_id string, query string, document string, license string").withColumn("domain", F.lit("web"))
    evals = spark.createDataFrame([("ein  prüftext.",)], "text string")
    got = admission.build_candidates(rows, sources, evals, {"web": 10}).collect()
    assert {(r.source_id, r.license, r.license_origin) for r in got} == {("s", "mit", "manifest"), ("g", "cc-by-4.0", "inherited")} and len(got) == 2
    cache = spark.createDataFrame([("p", None, "x")], "pair_hash string, license string, text string")
    known = spark.createDataFrame([("p", "mit"), ("p", "zz")], "pair_hash string, license string")
    assert admission.backfilled(cache, known, ["license"]).first().license == "mit"


def test_nested_access():
    base = {"a": {"b": 1, "c": [1]}, "d": 2}
    assert nested.merged(base, {"a": {"b": 3}, "e": 4}) == {"a": {"b": 3, "c": [1]}, "d": 2, "e": 4} and base["a"]["b"] == 1
    assert nested.merged(base, None) == base


def test_paths_metrics_and_results(spark):
    df = spark.createDataFrame([('{"a": {"b.c": [1, {"d": 2}]}}', {"NDCG_at_10": 0.5}), ("broken", None)], "j string, m map<string,double>")
    got = df.select(nested.path(F.col("j"), "a", "b.c", 1, "d").alias("p"), nested.metric(F.col("m"), "ndcg@10").alias("v"), nested.metric(F.col("m"), "mrr@10").alias("w")).collect()
    assert [tuple(r) for r in got] == [("2", 0.5, None), (None, None, None)]
    r = spark.createDataFrame([(1, [("a", 0.5), ("b", 0.4)], 0), (1, [("c", 0.9)], 1)], "query_id long, results array<struct<doc_id:string,score:double>>, ord int")
    assert [tuple(x) for x in nested.results(r).collect()] == [(1, "c", 1, 0.9)]


# ------------------------------------------------------------------ questions, hooks, retrieval, merging
def test_questions(spark):
    text = "Die Kündigungsfrist in München beträgt nach § 573 BGB seit 1999 drei Monate. Das Mietrecht gilt."
    p = spark.createDataFrame([(1, text), (2, None), (3, ""), (4, "nichts hier.")], "doc_id long, document string")
    rows = {r.template: r for r in questions.generated(p).filter("doc_id = 1").collect()}
    assert rows["factual"].query == "Was versteht man unter Kündigungsfrist?" and rows["keyword"].query == "Kündigungsfrist München"
    assert rows["date_number"].query == "Was geschah im Jahr 1999 im Zusammenhang mit Kündigungsfrist?"
    assert rows["legal_admin"].query == "Was regelt § 573?" and rows["entity_disambig"].query.startswith("Bezieht sich München")
    assert rows["web_typo"].query == "Kuendigungsfrist info" and "negated" not in rows
    assert questions.generated(p).filter("doc_id <> 1").count() == 0
    few = questions.generated(p, most=4).filter("doc_id = 1").collect()
    assert [r.family for r in few] == ["germanquad", "web", "faq", "admin"]
    neg = questions.generated(p, families=["negation"]).filter("doc_id = 1").collect()
    assert len(neg) == 2 and not any(r.positive for r in neg)
    assert questions.generated(p, least_chars=1000).count() == 0
    q = spark.createDataFrame([("s", "Ein Text.", None)], "source_passage_id string, document string, title string")
    prompt = questions.prompts(q, ["how_to"]).first().prompt
    assert '{"query": "<deine Frage auf Deutsch>", "query_style": "how_to"' in prompt and "(kein Titel)" in prompt and "Ein Text." in prompt
    with pytest.raises(ValueError):
        questions.prompts(q, ["song"])
    report = {r.query_style: r.n for r in questions.style_report(questions.dry_run(q.withColumns({"license": F.lit("mit"), "domain": F.lit("web")}))).collect()}
    assert set(report.values()) == {1} and len(report) == 10


def test_inference_hooks(spark):
    def _scorer():
        return lambda qs, ds: [float(len(d)) for d in ds]

    lists = spark.createDataFrame([(1, "q", [("a", "xx"), ("b", None), ("c", "xxxx")]), (2, "r", [])], "query_id long, query string, candidates array<struct<doc_id:string,document:string>>")
    got = {r.query_id: r.candidates for r in inference.score_lists(lists, _scorer).collect()}
    assert [(c.doc_id, c.teacher_score) for c in got[1]] == [("a", 2.0), ("b", 0.0), ("c", 4.0)] and not got[2]
    pairs = spark.createDataFrame([(1, "q", 1, "x"), (1, "q", 2, "xx"), (1, "q", 3, None)], "query_id long, query string, doc_id long, document string")
    assert [r.doc_id for r in inference.rerank(pairs, _scorer).orderBy("rank").collect()] == [2, 1, 3]
    done = pairs.filter("doc_id = 1").select("query_id", "doc_id")
    assert {r.doc_id: r.reranker_score for r in inference.score_missing(pairs, done, _scorer).collect()} == {2: 2.0, 3: 0.0}
    assert inference.rerank(pairs.limit(0), _scorer).count() == 0


def test_hybrid_and_lists(spark):
    kind = "query_id long, doc_id long, rank int"
    a = spark.createDataFrame([(1, 1, 1), (1, 2, 2), (1, 3, 3)], kind)
    b = spark.createDataFrame([(1, 3, 1), (1, 4, 2)], kind)
    s = spark.createDataFrame([(1, 4, 9.0), (1, 1, 1.0)], "query_id long, doc_id long, score double")
    order = lambda m, **k: [r.doc_id for r in retrieval.fused(a, b, m, **k).orderBy("rank").collect()]
    assert order("bm25_only") == [1, 2, 3] and order("hybrid_rrf") == [3, 1, 2, 4]
    assert order("hybrid_rrf_plus_reranker", scores=s) == [4, 1, 3, 2] and order("hybrid_rrf_plus_reranker") == [3, 1, 2, 4]
    assert order("hybrid_rrf_plus_reranker", scores=s, head=2) == [1, 3, 2, 4]
    with pytest.raises(ValueError):
        retrieval.fused(a, b, "other")
    corpus = spark.createDataFrame([(i, t) for i, t in enumerate(["", "eins", "zwei", "Eins", "vier", "fünf"])], "doc_id long, text string")
    gold = spark.createDataFrame([(1, 5)], "query_id long, doc_id long")
    none = spark.createDataFrame([], "query_id long, doc_id long, score double")
    assert retrieval.candidate_lists({"bm25": a, "x_dense": b}, corpus, gold, none).count() == 0
    ev = retrieval.candidate_lists({"bm25": a, "x_dense": b}, corpus, gold, none, for_eval=True).orderBy("nth").collect()
    assert [(r.doc_id, r.source) for r in ev] == [(1, "bm25"), (2, "bm25"), (4, "x_dense"), (5, "manual")]
    joined = retrieval.sources_joined(a.select("query_id", "doc_id"), {"d": b, "b": a}, 2).collect()
    assert {r.doc_id: (r.candidate_source, r.agreed) for r in joined} == {1: ("b", False), 2: ("b", False), 3: ("b+d", True)}


def test_saved_lexical_index(spark, tmp_path):
    corpus = spark.createDataFrame([(1, "Hund Katze"), (2, "Hund"), (3, "Vogel"), (4, None)], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "Hund Hund"), (2, "nichts")], "query_id long, query string")
    lexical.save_index(corpus, str(tmp_path / "i"))
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(lexical.search_index(str(tmp_path / "i"), queries)) == key(lexical.search(corpus, queries))
    lexical.MOST_ASKED, before = 0, lexical.MOST_ASKED
    try:
        assert key(lexical.search(corpus, queries)) == key(lexical.search_index(str(tmp_path / "i"), queries))
    finally:
        lexical.MOST_ASKED = before


def test_merging(spark):
    p = spark.createDataFrame([("k", 1, [1.0, 0.0]), ("k", 2, [0.0, 1.0])], "key string, parent int, vector array<double>")
    assert merging.merge("slerp", p, t=0.5).first().vector == pytest.approx([math.sqrt(0.5)] * 2)
    assert merging.merge("lerp", p, t=0.25).first().vector == [0.75, 0.25]
    w = spark.createDataFrame([("k", 1, 3.0), ("k", 2, 1.0)], "key string, parent int, weight double")
    assert merging.layerwise(p, w).first().vector == [0.75, 0.25] and merging.layerwise(p, w.limit(0)).first().vector == [0.5, 0.5]
    m = (1 << 64) - 1

    def number(seed, key, i):
        h = (seed * 0x9E3779B97F4A7C15 + i + 1 + int(hashlib.sha256(key.encode()).hexdigest()[:8], 16)) & m
        h = ((h ^ h >> 30) * 0xBF58476D1CE4E5B9) & m
        h = ((h ^ h >> 27) * 0x94D049BB133111EB) & m
        return (h ^ h >> 31) / 2.0**64

    asked = list(itertools.product((0, 3, 3 + 0x1000193, 1 << 40), ("k", "layer.1"), (0, 1, 63)))
    got = spark.createDataFrame(asked, "s long, k string, i int").select("*", merging.seeded(F.col("s"), F.col("k"), F.col("i")).alias("v")).collect()
    assert all(r.v == pytest.approx(number(r.s, r.k, r.i), abs=1e-12) for r in got)
    big = spark.createDataFrame([("k", q, [float(q + i) for i in range(40)]) for q in (1, 2)], p.schema)
    base = spark.createDataFrame([("k", [0.0] * 40)], "key string, vector array<double>")
    want = [sum(0.5 * 2 * (q + i) * (number(3 + n * 0x1000193, "k", i) < 0.5) for n, q in enumerate((1, 2))) for i in range(40)]
    assert merging.dare(big, base, 0.5, {1: 1.0, 2: 1.0}, seed=3).first().vector == pytest.approx(want)
    for bad in (lambda: merging.dare(p, base, 0.0, {1: 1.0}), lambda: merging.merge("none", p), lambda: vx.centred_slice(F.col("v"), 3), lambda: vx.strict_softmax(F.col("v"), 0.0), lambda: vx.pool("none", F.col("v"), F.col("v"))):
        with pytest.raises(ValueError):
            bad()
    v = spark.createDataFrame([([float(i) for i in range(8)],)], "v array<double>")
    assert v.select(vx.centred_slice(F.col("v"), 4).alias("s")).first().s == [3.0, 4.0]
    assert set(v.select(vx.views(F.col("v"), [2, 4]).alias("m")).first().m) == {2, 4}


def test_samplers_without_a_sort_of_all(spark):
    df = spark.createDataFrame([(i, "a" if i % 3 else "b") for i in range(3000)], "id long, g string")
    mark = lambda i: hashlib.md5(f"7|{i}".encode()).hexdigest()
    got = {r.id for r in records.sample_to_targets(df, "g", {"a": 70}, "id", "7").collect()}
    want = set(sorted((i for i in range(3000) if i % 3), key=lambda i: (mark(i), i))[:70]) | {i for i in range(3000) if not i % 3}
    assert got == want
    assert records.capped_share(df, F.col("g") == "a", 0.25, "id").count() == 1000 + 333
    assert records.sample_to_targets(df, "g", {"a": 0}, "id").count() == 1000
    x = df.withColumns({"domain": F.col("g"), "source": F.lit("s")})
    assert records.capped_lists(x, "id", per_domain=5, per_source=7).groupBy("g").count().orderBy("g").collect()[0]["count"] == 5
    assert training.upper_medians(df, "id", ["g"]).filter("g = 'b'").first().upper_median == sorted(i for i in range(3000) if not i % 3)[500]


def test_row_numbers_of_wide_tables(spark):
    """Rows beside the order make the ranges larger than those of the order alone."""
    from sedimark.sources import records as src

    df = spark.range(0, 40_000, 1, 8).select(((F.col("id") * 7919) % 40_000).alias("id"), F.concat_ws(" ", *(F.md5(F.concat_ws("|", F.lit(i), F.col("id"))) for i in range(20))).alias("text"))
    got = src.with_shards(df, ["id"], 1)
    assert got.columns == ["id", "text", "shard"]
    # The text is asked for: otherwise it is left out of both plans, which are then the same.
    assert tuple(got.agg(F.count_if(F.col("shard") == F.col("id")), F.count(F.lit(1)), F.max(F.length("text"))).first()) == (40_000, 40_000, 659)


def test_contrastive_loss(spark):
    """Null vectors are left out; a batch of 400 costs its square, not its cube."""
    rng = np.random.default_rng(3)
    q, p = rng.normal(size=(2, 400, 8))
    rows = [(i, q[i].tolist(), p[i].tolist(), [p[i - 1].tolist(), None] if i % 3 == 0 else None) for i in range(400)]
    rows += [(400, None, p[0].tolist(), None), (401, q[0].tolist(), None, None), (402, q[0].tolist(), [None] * 8, None), (403, q[0].tolist(), [1.0], None)]
    unit = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
    qs, ps = unit(q), unit(np.vstack([p, p[:1]]))
    s = np.exp(qs @ ps.T / 0.05)
    extra = np.array([np.exp(qs[i] @ ps[i - 1 if i else 399] / 0.05) if i % 3 == 0 else 0.0 for i in range(400)])
    want = np.mean(np.log(s.sum(1) + extra) - (qs * ps[:400]).sum(1) / 0.05)
    df = spark.createDataFrame(rows, "i long, query array<double>, positive array<double>, negatives array<array<double>>")
    start = time.monotonic()
    assert metrics.info_nce(df).first().loss == pytest.approx(want, abs=1e-5)
    assert time.monotonic() - start < 60
    assert metrics.info_nce(df.limit(0)).first().loss is None


def test_jaccard_pairs_by_classes_and_sketches(spark):
    """All pairs of brute force, copies included; sketches leave hardly any other pair to compare."""
    rng = np.random.default_rng(4)
    texts = [[f"w{x}" for x in rng.choice(400, size, replace=False)] for size in rng.integers(1, 250, 120)]
    for i in range(60):
        texts.append([t for t in texts[i] if rng.random() > 0.15] + [f"v{i}"])
    texts += texts[:20]
    df = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)] + [(900, None), (901, "")], "cand_id long, text string")
    alike = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    want = {(i, j): alike(a, b) for (i, a), (j, b) in itertools.combinations(enumerate(texts), 2) if alike(a, b) >= 0.6}
    got = leakage.jaccard_pairs(df, None, 0.6).collect()
    assert len(got) == len(want) and all(r.score == pytest.approx(want[r.cand_id, r.eval_id], abs=6e-5) for r in got)
    right = df.filter("cand_id % 3 = 0").withColumnRenamed("cand_id", "eval_id")
    both = {(r.cand_id, r.eval_id) for r in leakage.jaccard_pairs(df, right, 0.6).collect()}
    every = set(want) | {(j, i) for i, j in want} | {(i, i) for i in range(len(texts))}
    assert both == {p for p in every if p[1] % 3 == 0}
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    sets = leakage._set_classes(df, "cand_id")[1]
    met = leakage._candidates(leakage._prefixes(sets, none, 0.6, 3, True), 0.6, False).count()
    assert sets.count() == 180 and met <= 2 * len(want)
