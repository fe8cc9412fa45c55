import corpus_pipeline


def test_stages_on_the_smallest_tables(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if i < 4:
            assert docs.columns == columns and 0 < docs.count() <= n
            n = docs.count()
            if name == "near_duplicates":
                assert docs.select("text").distinct().count() == n
    assert docs.agg({"length": "sum"}).first()[0] > 0


def test_empty_and_odd_documents(spark, documents, odd_texts, sf):
    for rows in ([], odd_texts):
        docs = documents(rows).select("doc_id", "text", "lang", "source", "n_chars")
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs, sf).count()
    near = corpus_pipeline.near_duplicate_stage(spark, documents(odd_texts), sf)
    assert sorted((r.doc_id for r in near.collect()), key=str) == [1, 4, 5, 7, 8, None]
