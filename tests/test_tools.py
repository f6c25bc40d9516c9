"""What a session calls, over small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from memoria import tools
from memoria.functions import text as tx
from memoria.functions.vectors import nearest


@pytest.fixture(scope="module")
def items(spark):
    rows = [(1, "the plan of the garden", "public"), (2, "garden and diagnosis", "clinical"), (3, "a private garden", "private"), (4, "something else", "public"), (5, None, "public"), (6, "garden", None)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, scope string")


def test_search_holds_the_ceiling(items):
    found = lambda profile: {r.doc_id for r in tools.search_memory(items, "Garden!", profile).collect()}
    assert found("public") == {1} and found("full") == {1, 3} and found("nobody") == set()
    assert tools.search_memory(items, "", "full").count() == 0


def test_gate_injects_or_stays_silent(items):
    assert tools.gate_prompt(items, "garden", 0.01, "full").first().inject
    silent = tools.gate_prompt(items, "unheard", 0.01, "full").first()
    assert not silent.inject and silent.hits == []


def test_vectors_of_any_shape(spark):
    rows = [(1, [1.0, 0.0], "public"), (2, [0.9, 0.1], "private"), (3, None, "public"), (4, [1.0], "public"), (5, [0.0, 0.0], "public"), (6, [1.0, None], "public"), (7, [1.0, 0.0], "public")]
    vectors = spark.createDataFrame(rows, "id bigint, vector array<double>, scope string")
    assert [(r.id, r.place) for r in tools.search_vectors(vectors, [2.0, 0.0], "public").orderBy("place").collect()] == [(1, 1), (7, 2)]
    queries = spark.createDataFrame([(1, [1.0, 0.0], "a"), (1, [1.0, 0.0], "b"), (2, None, "a"), (3, [1.0], "a")], "query_id bigint, vector array<double>, tag string")
    got = sorted((r.tag, r.query_id, r.id) for r in nearest(vectors.select("id", "vector"), queries, 2).collect())
    assert got == [("a", 1, 1), ("a", 1, 7), ("a", 3, 4), ("b", 1, 1), ("b", 1, 7)]


def test_nearest_equals_brute_force(spark):
    r = np.random.default_rng(3)
    data = np.round(r.normal(size=(200, 5)), 1)
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(data)], "id bigint, vector array<double>").repartition(3)
    queries = vectors.filter("id % 50 = 0").withColumnRenamed("id", "query_id")
    unit = data / np.linalg.norm(data, axis=1, keepdims=True)
    for q in (0, 50, 100, 150):
        score = np.round(unit @ unit[q], 6)
        want = sorted(range(200), key=lambda i: (-score[i], i))[:7]
        assert [x.id for x in nearest(vectors, queries, 7).filter(F.col("query_id") == q).orderBy("place").collect()] == want


def test_notes_near_each_other(spark):
    links = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (5, 1), (6, 7)], "page_id bigint, dst bigint")
    assert {r.page_id for r in tools.related(links, 1).collect()} == {2, 5}
    got = {(r.start, r.page_id, r.hops) for r in tools.explore(links, spark.createDataFrame([(1,)], "start bigint"), 3).collect()}
    assert got == {(1, 2, 1), (1, 5, 1), (1, 3, 2), (1, 4, 3)}


def test_persona_keeps_clinical_statements_back(spark):
    rows = [(1, "biography", "lived in the town", 3), (2, "health_wellbeing", "sleeps well in town", 9), (3, "voice_style", "therapy in town", 5), (4, "voice_style", "short words", 5), (5, None, "town", 1)]
    facets = spark.createDataFrame(rows, "facet_id bigint, bucket string, statement string, weight bigint")
    assert {r.facet_id for r in tools.recall_persona(facets, "town").collect()} == {1}
    assert {r.facet_id for r in tools.recall_persona(facets, "town", direct=True, k=9).collect()} == {1, 2, 3, 5}
    assert {r.bucket: r.statements for r in tools.user_profile(facets).collect()} == {"biography": ["lived in the town"], "voice_style": ["short words"]}


def test_timeline_and_project_state(spark):
    events = spark.sql("SELECT * FROM VALUES (1, 1, TIMESTAMP_NTZ'2024-01-01 10:00:00'), (1, 2, TIMESTAMP_NTZ'2024-01-01 11:30:00'), (1, 3, TIMESTAMP_NTZ'2024-01-02 00:00:00') AS t(user_id, event_id, ts)")
    assert [(r.event_id, r.gap_minutes) for r in tools.timeline(events, "2024-01-01", "2024-01-02").orderBy("event_id").collect()] == [(1, None), (2, 90)]
    docs = spark.createDataFrame([(i, "p" if i < 7 else "q", 10) for i in range(10)], "doc_id bigint, source string, n_chars bigint")
    state = tools.project_state(docs, "p").first()
    assert (state.items, state.chars, state.latest) == (7, 70, [6, 5, 4, 3])
    assert {r.project for r in tools.project_state(docs).collect()} == {"p", "q"}
    assert {(r.table, r.n, r.ok) for r in tools.health({"d": docs, "e": events.limit(0)}).collect()} == {("d", 10, True), ("e", 0, False)}


def test_fields(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(tx.loose_date(F.lit("born 2087"))) is None and one(tx.loose_date(F.lit("2099-01-01"))) is None and one(tx.loose_date(F.lit("120255"))) is None
    assert str(one(tx.loose_date(F.lit("in 1990")))) == "1990-01-01"
    assert one(tx.trimmed(F.lit("\t  a b﻿\n"))) == "a b"
    assert one(tx.padded(F.lit("abc"), 2)) == "abc" and one(tx.padded(F.lit("a"), 3)) == "a  "
    assert one(tx.leading_integer(F.lit(" v22.3.1"))) == 22 and one(tx.leading_integer(F.lit("x"))) is None
    assert one(tx.filled(F.lit("{{a}}-{{b}}"), {"a": F.lit(1), "b": F.lit(None)})) == "1-"
    assert one(tx.is_placeholder(F.lit("[TBD]"))) and one(tx.is_placeholder(F.lit(None).cast("string"))) and not one(tx.is_placeholder(F.lit("x")))
    assert one(tx.without_preamble(F.lit("Sure!\n---\na: b\n---\nbody"))) == "---\na: b\n---\nbody" and one(tx.without_preamble(F.lit("a --- b"))) == "a --- b"
