"""The pipeline's last stage decodes what it encodes."""

import pytest
from pyspark.sql import functions as F


def test_ids_that_lose_the_text_fail_the_stage(spark, monkeypatch):
    import corpus_pipeline

    docs = spark.createDataFrame([(1, "some text, é 日本"), (2, None), (None, ""), (3, " \n")], "doc_id bigint, text string")
    stage = dict(corpus_pipeline.STAGES)["tokens"]
    assert [r.n_tokens > 0 for r in stage(spark, docs, "").orderBy("doc_id").collect()] == [False, True, False, True]

    whole = corpus_pipeline.round_trip
    monkeypatch.setattr(corpus_pipeline, "round_trip", lambda *a: whole(*a).withColumn("decoded", F.concat("decoded", F.lit("."))))
    with pytest.raises(Exception, match="don't give the text back"):
        stage(spark, docs, "").collect()
