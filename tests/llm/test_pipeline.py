import corpus_pipeline
from tallyloom.llm.decontaminate import without_contaminated
from tallyloom.llm.queries import QUERIES
from tallyloom.llm.secrets import redacted
from tallyloom.llm.simhash import without_near_duplicates
from tallyloom.llm.toxicity import without_toxic


def test_queries_are_registered():
    import __spark_entry__ as entry

    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and "op1_decontaminate" in entry.oracle_sql()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "secrets", "packing"]


def test_stages_on_awkward_documents(spark, tmp_path):
    doc_schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    words = " ".join(f"w{i * 7919 % 1000}" for i in range(200))
    rows = [(1, words), (2, words), (3, None), (None, "null id"), (4, ""), (5, "token = 'abcdefgh12345678'"), (6, "leak one two three four five six seven eight nine ten"), (1, words)]
    spark.createDataFrame([(i, t, None, None, None) for i, t in rows], doc_schema).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None, 1), (2, 1, None)], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "One two three four five six seven eight nine ten"), (2, None)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        assert name == "packing" or out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = docs.collect()
    assert len(kept["toxicity"]) == 8
    assert sorted(r.doc_id or 0 for r in kept["near_duplicates"]) == [0, 1, 3, 5, 6]
    assert sorted(r.doc_id or 0 for r in kept["decontamination"]) == [0, 1, 3, 5]
    masked = next(r for r in kept["secrets"] if r.doc_id == 5)
    assert masked.text == "[secret]'" and masked.n_chars == 9
    assert len(kept["packing"]) == 4
    assert len(corpus_pipeline.run(spark, str(tmp_path)).collect()) == 4


def test_empty_tables(spark, tmp_path):
    for name, schema in {"documents": "doc_id bigint, text string, lang string, source string, n_chars bigint", "labels": "doc_id bigint, quality int, toxic int", "benchmark": "item_id bigint, text string"}.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_columns_of_any_name_stay(spark):
    text = " ".join(f"w{i * 7919 % 1000}" for i in range(60))
    docs = spark.createDataFrame([(1, text, 1, "x"), (2, text, 2, "y"), (3, None, 3, None)], "doc_id bigint, text string, `a.b` int, `c d` string")
    labels = spark.createDataFrame([(1, 0)], "doc_id bigint, toxic int")
    benchmark = spark.createDataFrame([(1, "none of it")], "item_id bigint, text string")
    for stage in (lambda d: without_toxic(d, labels), without_near_duplicates, lambda d: without_contaminated(d, benchmark), redacted):
        docs = stage(docs)
        assert docs.columns == ["doc_id", "text", "a.b", "c d"]
    assert sorted((r[0], r[2], r[3]) for r in docs.collect()) == [(1, 1, "x"), (3, 3, None)]
