"""Every stage of the pipeline on odd rows, very long texts and columns of clashing names."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from memoria.llm import bpe, jaccard, langid, toxicity
from test_contracts import CLASH
from test_corpus import prose

STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("tables")
    rng = random.Random(3)
    spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id bigint, toxic int").write.parquet(str(path / "labels.parquet"))
    spark.createDataFrame([(1, prose(rng, 40))], "item_id bigint, text string").write.parquet(str(path / "benchmark.parquet"))
    return str(path)


def docs(spark):
    rng = random.Random(4)
    long = prose(rng, 60_000)
    rows = [(i, ("vile " if i % 2 else "kind ") * 3 + prose(rng, 30)) for i in range(40)]
    rows += [(50, long), (51, long + " one more"), (52, long), (None, None), (None, ""), (53, "write to a@b.org " + long[:50_000]), (53, "write to a@b.org " + long[:50_000]), (54, "x" * 300_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return df.withColumn("n_chars", F.length("text").cast("bigint")).select("*", *[F.lit(f"own {c}").alias(c) for c in CLASH])


@pytest.mark.parametrize("name", ["toxicity", "near_duplicates", "decontamination", "personal_data", "tokens"])
def test_stage_on_odd_rows(spark, folder, name):
    df = docs(spark)
    out = STAGES[name](spark, df, folder)
    got = out.collect()
    n = df.count()
    if name == "tokens":
        assert len(got) == n and all((r.n_tokens or 0) * 4 == len(r.token_ids) for r in got)
        return
    assert out.columns == df.columns and all(r[c] == f"own {c}" for r in got for c in CLASH)
    ids = [r.doc_id for r in got]
    if name == "near_duplicates":
        assert len(got) < n and 50 in ids and 51 not in ids and 52 not in ids and ids.count(53) == 1 and ids.count(None) == 1
    elif name == "personal_data":
        assert len(got) == n and all("a@b.org" not in (r.text or "") and (r.text is None or r.n_chars == len(r.text)) for r in got)
    else:
        assert {50, 54} <= set(ids)
    assert STAGES[name](spark, df.limit(0), folder).count() == 0


def test_a_very_long_text_among_many_short_ones(spark):
    rng = random.Random(5)
    long = prose(rng, 80_000)
    rows = [(i, prose(rng, rng.randint(1, 20))) for i in range(300)]
    df = spark.createDataFrame([*rows[:150], (1000, long), *rows[150:]], "doc_id bigint, text string").coalesce(1)
    alone = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    net = langid.ByteCnn(["a", "b"])
    net.tables = [net.kernels(i) for i in range(len(langid.WIDTHS))]
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)], "doc_id bigint, toxic int")
    path = bpe.vocabulary()
    for run in (lambda d: langid.predict(d, net).select("doc_id", "lang_pred", F.round("score", 4)), lambda d: bpe.encode_documents(d, *path).select("doc_id", F.md5("token_ids"))):
        both, few = ({tuple(r) for r in run(d).collect()} for d in (df, alone))
        assert few == {r for r in both if r[0] != 1000} and len(both) == 301
    assert toxicity.score_toxicity(df, labels).filter("doc_id = 1000 and toxicity between 0 and 1").count() == 1
    assert jaccard.near_duplicates(df).filter("doc_id = 1000").first().component_id == 1000
