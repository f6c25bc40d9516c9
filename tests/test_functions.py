import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from memoria.functions.text import chunks, first_given, loose_date, scrubbed, slug
from memoria.functions.voice import corrections
from memoria.operators.intervals import closed_intervals, reconciled


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text(alphabet="aB9 -_.é", max_size=12), min_size=1, max_size=20))
def test_slug(spark, words):
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", slug(F.col("w")).alias("s")).collect()
    for w, s in rows:
        assert s == re.sub("^-|-$", "", re.sub("[^a-z0-9]+", "-", w.lower()))


@settings(max_examples=10, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 50)), min_size=1, max_size=30, unique=True))
def test_intervals_have_no_gap_or_overlap(spark, rows):
    df = spark.createDataFrame([(k, t, i) for i, (k, t) in enumerate(rows)], "k int, t int, i int")
    got = closed_intervals(df, ["k"], "t", "i").collect()
    for key in {r.k for r in got}:
        own = sorted((r.valid_from, r.i, r.valid_to) for r in got if r.k == key)
        assert [x[2] for x in own[:-1]] == [x[0] for x in own[1:]]
        assert own[-1][2] is None


def test_dates_scrub_and_defaults(spark):
    df = spark.createDataFrame([("in 1987",), ("2019",), ("2019-13-40",), ("on 2020-02-30",), (None,), ("2021-05-06 x",)], "s string")
    got = [str(r[0]) for r in df.select(loose_date(F.col("s"))).collect()]
    assert got == ["None", "2019-01-01", "2019-01-01", "None", "None", "2021-05-06"]
    row = spark.createDataFrame([("a@b.org or +1 (555) 123-4567", "", None)], "a string, b string, c string")
    assert row.select(scrubbed(F.col("a"))).first()[0] == "[email] or [phone]"
    assert row.select(first_given(F.col("b"), F.col("c"), F.lit("z"))).first()[0] == "z"


def test_chunks_cover_all_words(spark):
    row = spark.createDataFrame([([str(i) for i in range(25)],)], "w array<string>").select(chunks(F.col("w"), 10, 8).alias("c")).first()
    assert {w for c in row.c for w in c} == {str(i) for i in range(25)}


def test_reconcile(spark):
    a = spark.createDataFrame([(1, 5), (2, 6), (3, 7)], "k int, v int")
    b = spark.createDataFrame([(2, 6), (3, 8), (4, 9)], "k int, v int")
    assert {r.k: r.status for r in reconciled(a, b, ["k"], "v").collect()} == {1: "kept", 2: "same", 3: "conflict", 4: "new"}


def test_scrub_of_long_runs_takes_no_time_or_stack(spark):
    texts = ["x@b" + ".c" * 3000, "a" * 1_000_000, "a@" * 200_000, "1 " * 300_000, "x@b.c_d@e.f x.y@z", "+1 (555) 123-4567 or a.b@c-d.e."]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    df.select(scrubbed(F.col("t"))).limit(1).collect()
    began = time.time()
    got = [r[0] for r in df.orderBy("i").select(scrubbed(F.col("t"))).collect()]
    assert time.time() - began < 10
    assert got[0] == "[email]" and got[1:3] == texts[1:3] and got[4:] == ["[email][email] x.y@z", "[phone] or [email]."]


def test_style_remarks_are_told_from_facts(spark):
    said = [
        (1, 0, "user", "Make it shorter"), (1, 1, "assistant", "draft"), (1, 2, "user", "Too wordy and a bit stiff; no bullets please"), (1, 3, "assistant", "draft"),
        (1, 4, "user", "Shorter, and the date is wrong: it was 1990"), (1, 5, "assistant", "d"), (1, 6, "user", "More formal. Actually she lives elsewhere"), (1, 7, "user", "more casual"),
        (2, 0, "assistant", "d"), (2, 1, "user", "warmer, my therapy went well"), (2, 2, "assistant", "d"), (2, 3, "user", None), (2, 4, "assistant", "d"), (2, 5, "user", "Less JARGON."),
    ]
    turns = spark.createDataFrame(said, "conv_id int, turn int, role string, text string")
    got = sorted((r.conv_id, r.turn, r.kind) for r in corrections(turns).collect())
    assert got == [(1, 2, "format"), (1, 2, "length"), (1, 2, "tone"), (2, 5, "wording")]
