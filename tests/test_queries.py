"""A sample of the catalogue against its DuckDB statements on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SOME = "bm25_top10 retrieval_metrics rrf_tie_by_id hardness_buckets exact_dedup pii_scan threshold_sweep tumbling_counts largest_remainder_budget pair_contract_errors".split()


@pytest.mark.parametrize("name", SOME)
def test_query_equals_statement(spark, sf, name):
    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{sf}/{f}'")
    got = entry.queries()[name](spark, sf).toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    key = lambda df: sorted(tuple(round(float(v), 6) if isinstance(v, float) else str(v) for v in r) for r in df[columns].astype(object).itertuples(index=False))
    assert key(got) == key(want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_leakage_is_over_whole_tables(spark, sf):
    """Against brute force over all documents, and documents against the benchmark."""
    from pyspark.sql import functions as F

    from sedimark.functions import text as tx

    found = entry.queries()
    read = lambda name, key: {r[0]: (r[1], set(r[2])) for r in spark.read.parquet(f"{sf}/{name}.parquet").select(
        key, tx.collapsed(F.col("text")), tx.tokens(F.coalesce("text", F.lit("")))
    ).collect()}
    docs, items = read("documents", "doc_id"), read("benchmark", "item_id")
    pairs = [(a, b) for a in docs for b in docs if a < b]
    ids = lambda name: {(r.cand_id, r.eval_id) for r in found[name](spark, sf).collect()}
    same = {(a, b) for a, b in pairs if docs[a][0] is not None and docs[a][0] == docs[b][0]}
    assert ids("leakage_exact_whole") == same and any((a - b) % 2 == 0 for a, b in same)

    def alike(right, pairs):
        shared = {(a, b): len(docs[a][1] & right[b][1]) for a, b in pairs}
        return {(a, b) for (a, b), n in shared.items() if n and n >= 0.6 * (len(docs[a][1]) + len(right[b][1]) - n)}

    assert ids("leakage_jaccard_whole") == alike(docs, pairs)
    assert ids("leakage_jaccard_benchmark") == alike(items, [(a, b) for a in docs for b in items])
    # Equal texts always block together, whatever their parity.
    assert {a for a, _ in ids("leakage_lsh")} >= {a for a, _ in same if docs[a][1]}
    assert found["leakage_lsh_benchmark"](spark, sf).columns == ["cand_id", "eval_id", "jaccard", "hamming"]


@pytest.mark.parametrize("name", ["top50_miner_200", "merge_mean_all"])
def test_whole_job_equals_statement(spark, sf, name):
    test_query_equals_statement(spark, sf, name)
    if name == "top50_miner_200":
        assert entry.queries()[name](spark, sf).count() > 0


def test_merge_ties_reads_all_embeddings(spark, sf, monkeypatch):
    from sedimark.plans import catalogue

    seen = []
    whole = catalogue.merging.ties
    monkeypatch.setattr(catalogue.merging, "ties", lambda p, b, d: seen.append(p.count() + b.count()) or whole(p, b, d))
    catalogue.merge_ties(spark, sf)
    assert seen == [spark.read.parquet(f"{sf}/embeddings.parquet").count()]
