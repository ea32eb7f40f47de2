import os

import pytest

pipeline = pytest.importorskip("corpus_pipeline")
DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, n = docs.columns, docs.count()
    assert len(pipeline.STAGES) == 5
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, DATA).cache()
        assert out.columns == columns, name
        assert 0.5 * n <= out.count() <= docs.count(), name
        assert out.exceptAll(docs).count() == 0, name
        docs = out
    packed = pipeline.STAGES[-1][1](spark, docs, DATA)
    assert packed.select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_awkward_documents(spark, tmp_path):
    """Nulls in every column, repeated rows, a clashing column, and an empty table go through all stages."""
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{DATA}/{name}.parquet").write.parquet(str(tmp_path / f"{name}.parquet"))
    rows = [(None, None, None, None, None, None), (1, "some words of a text", "en", "s", 20, "t"), (1, "some words of a text", "en", "s", 20, "t"), (2, "", None, None, 0, None), (3, "other words in a text", "en", None, None, "u")]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, toxicity string"
    for df in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for _, stage in pipeline.STAGES[:-1]:
            assert stage(spark, df, str(tmp_path)).columns == df.columns
        docs = df
        for _, stage in pipeline.STAGES:
            docs = stage(spark, docs, str(tmp_path))
        assert docs.count() == (2 if df.count() else 0)
