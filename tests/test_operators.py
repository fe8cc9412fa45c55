"""Operators against small brute force and edge cases."""

import math

import pytest
from pyspark.sql import functions as F

from sedimark.functions import text as tx
from sedimark.functions import variants as vr
from sedimark.functions import vectors as vx
from sedimark.operators import aggregates, clustering, dense, fusion, leakage, lexical, lists, merging, metrics, records
from sedimark.sources import records as src
from sedimark.streaming import events as ev


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x")).alias("y")).first().y


def test_text_forms(spark):
    assert one(spark, "Größe Äpfel", tx.fold) == "groesse aepfel"
    assert one(spark, "§ 5 Größe_1, x", tx.tokens) == ["§", "5", "groesse_1", "x"]
    assert one(spark, "Maße für 3 Öfen", tx.tokens_de) == ["masse", "für", "3", "öfen"]
    assert one(spark, "  A\t\nb ", tx.collapsed) == "a b"
    assert one(spark, "ﬁne Ｔext, x!", tx.leakage_form) == "fine text x"
    assert one(spark, "é  x", tx.nfc_collapsed) == "é x"
    assert one(spark, None, tx.leakage_form) is None
    assert one(spark, "", tx.tokens) == []


def test_classes(spark):
    style = {"": "empty", "Was ist das?": "question", "zwei Worte": "keyword", "das hier sind vier Worte": "statement"}
    for text, want in style.items():
        assert one(spark, text, tx.query_style) == want
    assert one(spark, "a b c d e f. g h i j k l.", tx.query_style) == "multi_sentence"
    assert one(spark, "der Hund und die Katze", tx.language_hint) == "de"
    assert one(spark, "the dog", tx.language_hint) == "unknown"
    assert one(spark, "mail a.b@c.de, 10.0.0.1", lambda x: F.size(tx.pii(x))) == 2
    assert one(spark, "Tel 030 1234567", lambda x: tx.pii(x)[0]["kind"]) == "phone"
    assert one(spark, None, lambda x: F.size(tx.pii(x))) == 0
    assert one(spark, "2.4", lambda x: tx.margin_bucket(x.cast("double"), 5)) == "2-3"
    assert one(spark, " MIT ", lambda x: tx.is_unknown_license(x, tx.ALLOWED_LICENSES)) is False


def test_shingles_and_jaccard(spark):
    df = spark.createDataFrame([(["a", "b"], ["b", "c"]), ([], []), (list("abcdef"), list("abcdef"))], "a array<string>, b array<string>")
    rows = df.select(F.size(tx.shingles(F.col("a"))).alias("n"), tx.jaccard(F.col("a"), F.col("b")).alias("j")).collect()
    assert [r.n for r in rows] == [1, 0, 2]
    assert [round(r.j, 6) for r in rows] == [round(1 / 3, 6), 0.0, 1.0]


def test_vectors(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], [1.0, 1.0])], "a array<double>, z array<double>, c array<double>")
    r = df.select(
        vx.cosine(F.col("a"), F.col("a")).alias("same"), vx.cosine(F.col("a"), F.col("z")).alias("zero"), vx.unit(F.col("z")).alias("u"),
        vx.minmax(F.col("c")).alias("m"), vx.softmax(F.col("c")).alias("s"), vx.slerp(F.col("a"), F.col("a"), 0.5).alias("sl"),
    ).first()
    assert math.isclose(r.same, 1) and r.zero == 0 and r.u == [0, 0] and r.m == [1, 1] and r.s == [0.5, 0.5] and r.sl == [3, 4]
    with pytest.raises(Exception, match="shorter"):
        df.select(vx.truncated(F.col("a"), 3)).collect()


def test_bm25_variants(spark):
    corpus = spark.createDataFrame([(1, "Hund Katze"), (2, "Hund"), (3, "Vogel"), (4, None)], "doc_id long, text string")
    queries = spark.createDataFrame([(1, "Hund Hund"), (2, "nichts")], "query_id long, query string")
    found = lexical.search(corpus, queries).collect()
    assert [(r.query_id, r.doc_id) for r in found] == [(1, 2), (1, 1)]
    all_ = lexical.harness_rank(corpus, queries, 3).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.doc_id) for r in all_] == [(1, 2), (1, 1), (1, 3), (2, 1), (2, 2), (2, 3)]
    assert all_[0].score == pytest.approx(2 * found[0].score, abs=1e-5)
    assert lexical.search(corpus.limit(0), queries).count() == 0


def test_dense_and_blocks(spark):
    rows = [(i, [math.cos(i), math.sin(i), 1.0]) for i in range(30)] + [(99, [0.0, 0.0, 0.0])]
    v = spark.createDataFrame(rows, "doc_id long, vector array<double>")
    q = v.withColumnRenamed("doc_id", "query_id").filter("query_id < 5")
    a = dense.top_k(q, v, 4).select("query_id", "doc_id", "rank").orderBy("query_id", "rank").collect()
    b = dense.top_k(q, v, 4, block=2).select("query_id", "doc_id", "rank").orderBy("query_id", "rank").collect()
    assert a == b and len(a) == 20 and all(r.query_id != r.doc_id for r in a)


def test_fusion_and_metrics(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id long, doc_id long, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 10, 2), (1, 9, 3)], "query_id long, doc_id long, rank int")
    assert [r.doc_id for r in fusion.rrf({"a": a, "b": b}).orderBy("rank").collect()] == [10, 11, 9]
    assert {(r.doc_id, r.source) for r in fusion.pool({"a": a, "b": b}).collect()} == {(10, "a"), (11, "a"), (9, "b")}
    rel = spark.createDataFrame([(1, 11), (1, 8), (2, 5)], "query_id long, doc_id long")
    m = {r.query_id: r for r in metrics.per_query(a, rel, (1, 2)).collect()}
    assert m[1].mrr_2 == 0.5 and m[1].recall_2 == 0.5 and m[1].ndcg_1 == 0 and m[1].map_2 == 0.25 and m[2].ndcg_2 == 0
    assert m[1].ndcg_2 == pytest.approx((1 / math.log2(3)) / (1 + 1 / math.log2(3)))
    pairs = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (2.0, 6.0)], "a double, b double")
    assert metrics.spearman(pairs, "a", "b").first().spearman == pytest.approx(0.866025, abs=1e-5)
    same = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert metrics.spearman(same, "a", "b").first().spearman == 0
    assert metrics.v_measure(spark.createDataFrame([("x", 0), ("x", 0)], "t string, c int"), "t", "c").first().v_measure == 1


def test_leakage(spark):
    cands = spark.createDataFrame([(1, "Der  Hund läuft"), (2, "!!"), (3, "eins zwei drei vier fünf sechs sieben"), (4, None)], "cand_id long, text string")
    evals = spark.createDataFrame([(7, "der hund läuft"), (8, "???"), (9, "eins zwei drei vier fünf sechs sieben acht")], "eval_id long, text string")
    assert [(r.cand_id, r.eval_id) for r in leakage.exact(cands, evals).collect()] == [(1, 7)]
    got = {(r.cand_id, r.eval_id): r.score for r in leakage.jaccard_pairs(cands, evals, 0.8).collect()}
    assert got == {(1, 7): 1.0, (3, 9): 0.875}
    assert {(r.cand_id, r.eval_id) for r in leakage.near_duplicates(cands, evals).collect()} == {(1, 7)}
    assert leakage.without(cands, evals, "text").count() == 3
    big = [(i, " ".join(f"w{(i * 7 + j) % 50}" for j in range(20))) for i in range(40)]
    a = spark.createDataFrame(big, "cand_id long, text string")
    b = a.select(F.col("cand_id").alias("eval_id"), "text")
    sets = {i: set(t.split()) for i, t in big}
    want = {(i, j) for i in sets for j in sets if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.5}
    assert {(r.cand_id, r.eval_id) for r in leakage.jaccard_pairs(a, b, 0.5).collect()} == want
    docs = spark.createDataFrame([(1, "x a b c d e f g h i j y"), (2, "a b c")], "doc_id long, text string")
    items = spark.createDataFrame([(5, "a b c d e f g h i j")], "item_id long, text string")
    assert [tuple(r) for r in leakage.contained(docs, items).collect()] == [(1, 5)]
    docs = spark.createDataFrame([(1, "x a b c d e y"), (2, "za b c dz"), (3, None), (4, "ab"), (5, "")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d"), (2, "b c"), (3, "a"), (4, "b"), (5, ""), (6, None), (7, "d e")], "item_id long, text string")
    want = {(d.doc_id, i.item_id) for d in docs.collect() for i in items.collect() if d.text and i.text and i.text in d.text}
    assert {tuple(r) for r in leakage.contained(docs, items).collect()} == want and len(want) == 11


def test_leakage_classes_and_index(spark, tmp_path):
    """Copies, near copies and others: all pairs by brute force, the best other one, a saved index."""
    words = lambda seed, n: [f"w{(i * seed) % 997}" for i in range(n)]
    texts = {i: " ".join(words(7 + i, 60)) for i in range(8)}
    texts |= {20 + i: texts[0] for i in range(5)}
    texts |= {30: texts[1] + " mehr", 31: "mehr " + texts[1], 40: "", 41: None, 42: "?!"}
    rows = spark.createDataFrame(list(texts.items()), "cand_id long, text string")
    evals = rows.withColumnRenamed("cand_id", "eval_id")
    gram = lambda t: {tuple(t.split()[i : i + 5]) for i in range(max(1, len(t.split()) - 4))} if t and t.strip("?!") else set()
    sets = {i: gram(t) for i, t in texts.items()}
    want = {(i, j) for i in sets for j in sets if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.9 * len(sets[i] | sets[j])}
    assert {(r.cand_id, r.eval_id) for r in leakage.near_duplicates(rows, evals, 0.9, 0).collect()} == want
    best = {r.cand_id: r.eval_id for r in leakage.best_others(rows, 0.9, 0).collect()}
    assert best == {i: min((j for x, j in want if x == i and j != i), key=lambda j: (-len(sets[i] & sets[j]) / len(sets[i] | sets[j]), j)) for i in {x for x, y in want if x != y}}
    leakage.save_index(evals, str(tmp_path / "index"))
    assert {(r.cand_id, r.eval_id) for r in leakage.search_index(rows, str(tmp_path / "index"), 0.9, 0).collect()} == want
    r = leakage.blocking_report(rows).first()
    assert r.texts == 15 and r.classes == 10 and r.verified <= r.naive
    with pytest.raises(ValueError):
        leakage.require_clean(leakage.near_duplicates(rows, evals))
    same = leakage.jaccard_pairs(rows, None, 0.9)
    assert {(r.cand_id, r.eval_id) for r in same.collect()} >= {(i, j) for i, j in want if i < j}


def test_records(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, "b", "z"), (4, "b", "x"), (5, "b", "x")], "id long, g string, t string")
    assert [r.id for r in records.first_by(df, [F.col("t")], ["id"]).orderBy("id").collect()] == [1, 2, 3]
    assert [r.id for r in records.round_robin(df, "g", ["id"], 4).collect()] == [1, 3, 2, 4]
    assert records.sample_to_targets(df, "g", {"b": 1}, "id").count() == 3
    assert records.stride_sample(df, "g", ["id"], 1).count() == 2
    assert records.capped_share(df, F.col("g") == "b", 0.5, "id").count() == 4
    w = spark.createDataFrame([("a", 1.0), ("b", 1.0), ("c", 1.0)], "s string, w double")
    assert {r.s: r.budget for r in records.largest_remainder(w, "s", "w", 10).collect()} == {"a": 3, "b": 3, "c": 4}
    pair = spark.createDataFrame([("kurz", "kurz"), ("Wie lang ist die Frist hier?", "Die Frist ist drei Monate lang.")], "query string, document string")
    errs = [r.errors for r in records.checked(pair, records.pair_rules()).collect()]
    assert "query_length" in errs[0] and "query_equals_positive" in errs[0] and errs[1] == []
    row = spark.createDataFrame([("q", "p", "s", "gpl", None, ["P"], ["odd"])], "query string, positive string, source string, license string, lang string, negatives array<string>, neg_types array<string>")
    assert records.checked(row, records.training_rules()).first().errors == ["license_not_allowed", "negative_equals_positive", "neg_type_unknown"]


def _lists(spark):
    rows = [(1, i, 1.0 - i / 10, s, i in (2, 3), i + 1) for i, s in enumerate([0.1, 0.9, 0.8, 0.2, 0.85])]
    df = spark.createDataFrame(rows, "query_id long, doc_id long, fs double, rr double, rel boolean, fs_rank int")
    return df.withColumn("rr_rank", F.expr("row_number() over (partition by query_id order by rr desc, doc_id)"))


def test_lists(spark):
    x = _lists(spark)
    h = lists.hardness(x).first()
    assert h.oracle_ndcg == 1 and 0 < h.fs_ndcg < 1
    t = lists.teacher_targets(x, "rr").agg(F.sum("target")).first()[0]
    assert t == pytest.approx(1)
    kinds = {"Gold": "injected", "my-bm25": "bm25", "own-model": "dense", "e5": "dense", "": "other", None: "other", "x": "other"}
    for source, want in kinds.items():
        assert one(spark, source, lambda c: lists.source_class(c, ["own"])) == want


def test_variants(spark):
    assert one(spark, "Die Frist beträgt 30 Tage.", vr.number_and_unit) == "Die Frist beträgt 46 Monate."
    assert one(spark, "nach § 551 BGB", vr.statute_shift) == "nach § 581 BGB"
    assert one(spark, "nach § 551 BGB", vr.section_shift) == "nach § 552 BGB"
    assert one(spark, "Straße", vr.eszett) == "Strasse" and one(spark, "Wasser", vr.eszett) == "Waßer"
    assert one(spark, "Das ist gut", vr.negated) == "Das ist nicht gut"
    assert one(spark, "Haben Sie Zeit?", vr.register) == "Haben du Zeit?"
    assert one(spark, "Das ist unzulässig.", vr.outcome) == "Das ist zulässig."
    assert one(spark, "im Januar", vr.regional) == "im März"
    assert one(spark, "Die Mietkaution", vr.other_compound) == "Die Maklerprovision"
    assert one(spark, "Donaudampfschiff fährt", vr.compound) == "Donaudam pfschiff fährt"
    assert one(spark, "in Berlin", vr.entity) == "in Köln"
    for f in (*vr.HARD_NEGATIVES.values(), *(f for _, _, f in vr.ADVERSARIAL.values())):
        assert one(spark, None, f) is None
        assert one(spark, "", f) is None


def test_reports(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None), (None, 5.0)], "g string, s double")
    d = {r.g: r for r in aggregates.distribution(df, "s", "g").collect()}
    assert d["a"].median == 2 and d["b"].missing == 1
    sweep = {(r.key, r.value, r.threshold): r.accepted for r in aggregates.threshold_sweep(df, "s", ("g",), (2.0,)).collect()}
    assert sweep == {("all", "all", 2.0): 2, ("g", "a", 2.0): 1, ("g", "b", 2.0): 0, ("g", "unknown", 2.0): 1}
    assert {r.value: r.n for r in aggregates.counts_by(df, "g").collect()} == {"a": 2, "b": 1, "unknown": 1}
    assert {r.bucket: r.n for r in aggregates.histogram(df, "s", [0, 2]).collect()} == {"[0,2)": 1, ">=2": 2}
    assert {r.g: r.upper_median for r in aggregates.upper_median(df, "s", "g").collect()}["a"] == 3.0


def test_merging_and_clusters(spark):
    p = spark.createDataFrame([("k", 1, [1.0, -2.0]), ("k", 2, [3.0, 4.0])], "key string, parent int, vector array<double>")
    base = spark.createDataFrame([("k", [0.0, 0.0])], "key string, vector array<double>")
    assert merging.mean(p).first().vector == [2, 1]
    assert merging.mean(p, {1: 1, 2: 3}).first().vector == [2.5, 2.5]
    assert merging.task_vectors(p, base).first().vector == [4, 2]
    assert merging.ties(p, base, 1.0).first().vector == [2, 4]
    assert merging.dare(p, base, 1.0, {1: 0.5, 2: 0.5}).first().vector == [2, 1]
    v = spark.createDataFrame([(i, [float(i // 5 * 10 + i % 5), 0.0]) for i in range(10)], "id long, vector array<double>")
    got = [r.cluster for r in clustering.kmeans(v, 2).orderBy("id").collect()]
    assert len(set(got[:5])) == 1 and len(set(got[5:])) == 1 and got[0] != got[9]


def test_sources_and_streams(spark, tmp_path):
    df = spark.createDataFrame([(i, f"t {i}") for i in range(10)], "id long, text string")
    src.write_jsonl(df, str(tmp_path / "a"))
    back = src.read_jsonl(spark, str(tmp_path / "a"), "id long, text string")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    assert src.read_jsonl_or_empty(spark, str(tmp_path / "none"), "id long").count() == 0
    shards = src.with_shards(df, ["id"], 4).groupBy("shard").count().orderBy("shard").collect()
    assert [tuple(r) for r in shards] == [(0, 4), (1, 4), (2, 2)]
    (tmp_path / "bad.json").write_text('{"id": 1}\nbroken\n')
    assert src.read_jsonl(spark, str(tmp_path / "bad.json"), "id long", strict=False).count() == 1
    with pytest.raises(Exception):
        src.read_jsonl(spark, str(tmp_path / "bad.json"), "id long").collect()
    e = spark.sql("select timestamp'2024-01-01 00:10' + make_interval(0,0,0,0,0,i*20) ts, i % 2 user_id, 'x' event_type, 1.0d value from (select explode(sequence(0,9)) i)")
    e.write.parquet(str(tmp_path / "events"))
    stream = spark.readStream.schema(e.schema).parquet(str(tmp_path / "events"))
    got = ev.run_once(ev.tumbling(stream), "tumble", str(tmp_path / "cp"))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, ev.tumbling(e).collect()))
    cache = spark.createDataFrame([(1, 1)], "query_id long, doc_id long")
    assert src.unscored(cache.union(spark.createDataFrame([(1, 2)], cache.schema)), cache).count() == 1
