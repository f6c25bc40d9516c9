"""Every chunk of a document has a contextual key."""

from memoria.plans import catalog


def test_a_change_behind_the_first_chunk_changes_a_key(spark, tmp_path):
    words = [f"w{i}" for i in range(500)]
    rows = [(1, " ".join(words), "s", "en"), (2, " ".join([*words[:450], "other", *words[451:]]), "s", "en")]
    spark.createDataFrame(rows, "doc_id bigint, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    run = lambda name: catalog.queries()[name](spark, str(tmp_path)).collect()

    keys = {(r.doc_id, r.chunk): r.contextual_sha for r in run("contextual_chunk_keys_all")}
    assert set(keys) == {(r.doc_id, r.chunk) for r in run("document_chunks")} == {(d, c) for d in (1, 2) for c in range(3)}
    assert [keys[1, c] == keys[2, c] for c in range(3)] == [True, True, False]
