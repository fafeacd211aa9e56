"""The corpus pipeline stage by stage on the smallest tables."""

import corpus_pipeline
from pyspark.sql import functions as F


def test_stages(spark, data, tmp_path):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, data)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns, name
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        now = docs.count()
        assert 0 < now <= before
        before = now
    assert docs.where("not round_trip or n_tokens <> size(ids)").count() == 0
    whole = corpus_pipeline.run(spark, data)
    assert whole.select("doc_id", "n_tokens").exceptAll(docs.select("doc_id", "n_tokens")).count() == 0 and whole.count() == before


def test_odd_rows_pass_every_stage(spark, data, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "x" * 50_000, "en", "s", 50_000), (3, "x" * 50_000, "en", "s", 50_000), (None, "a b c", None, None, 5), (4, "mail a@b.com", "en", "s", 12)]
    docs = spark.createDataFrame([(*r, "y") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score string")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, data)
        assert docs.columns[-1] == "score"
    kept = {(r.doc_id, r.text) for r in docs.collect()}
    assert (4, "mail <email>") in kept and (None, "a b c") in kept and len(kept) == 4
    last = corpus_pipeline.STAGES[-1][1](spark, docs, data)
    assert last.where("not round_trip").count() == 0
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, data).agg(F.count("*")).first()[0] == 0
