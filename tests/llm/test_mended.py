"""What earlier rounds got wrong or left out: repeated rows, runs of one token's beginning, short items, hot lines, windows in bytes."""

import random
import time

import numpy as np
from pyspark.sql import functions as F

from memoria.llm import decontaminate, langid, quality, secrets, suffixes
from test_corpus import brute_repeats, frame, prose


def test_op1_repeated_rows_cost_no_square(spark):
    rng = random.Random(1)
    text = "".join(rng.choices("abcdefgh ", k=2000)) + "0123456789" * 15 + "x" + "0123456789" * 15
    docs = spark.range(100_000).select(F.lit(5).cast("bigint").alias("doc_id"), F.lit(text).alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(6, text), (None, text), (None, text)], "doc_id bigint, text string"))
    began = time.time()
    got = suffixes.without_repeats(docs).groupBy("doc_id", "n_removed", "n_spans", F.octet_length("kept").alias("n")).count().collect()
    assert time.time() - began < 120
    rows = {r.doc_id: (r.n_removed, r.n_spans, r.n, r["count"]) for r in got}
    # The null id is the smallest: its text stays but for what repeats in it; the copies go whole.
    assert len(got) == 3 and rows[5] == (len(text), 1, 0, 100_000) and rows[6] == (len(text), 1, 0, 1)
    assert rows[None][0] + rows[None][2] == len(text) and 0 < rows[None][0] < 400 and rows[None][3] == 2


def test_op4_runs_of_token_heads_cost_no_square(spark):
    token = "eyJ" + "a" * 8 + ".eyJ" + "b" * 9 + "." + "c" * 10
    texts = ["eyJ" * 350_000, "xeyJ" + token[3:] + " " + token, "eyJshort.eyJ" + "d" * 8 + "." + token, "eyJ eyJ.eyJ"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    began = time.time()
    found = {r.doc_id: [(s.kind, s.start, s.value) for s in r.findings] for r in secrets.scan(docs)[0].collect()}
    assert time.time() - began < 60
    assert found[0] == found[3] == []
    assert found[1] == [("web_token", 1, token), ("web_token", len(texts[1]) - len(token), token)]
    assert [k for k, _, _ in found[2]] == ["web_token"]


def test_op6_short_items_as_whole_words(spark):
    docs = spark.createDataFrame([(1, "The cat, sat."), (2, "concat sat"), (3, "cat"), (4, None), (5, "a cat satin")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "cat sat"), (2, "Cat"), (3, ""), (4, "dog")], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, items, min_bytes=0).collect()}
    assert got == {(1, 1), (1, 2), (3, 2), (5, 2)}
    assert decontaminate.matches(docs, items).count() == 0
    assert {r.doc_id for r in decontaminate.decontaminated(docs, items, min_bytes=4).collect()} == {2, 3, 4, 5}


def test_op5_hot_lines_are_dealt_evenly(spark, monkeypatch):
    rows = [(i, "same line here\n" + f"own words of {'abcdefgh'[i % 8] * (i + 1)} " * 30, "one" if i % 3 else None) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    columns = ("doc_id", "words_removed", "kept")
    plain = sorted(tuple(r[c] for c in columns) for r in quality.judge(docs).collect())
    assert {w for _, w, _ in plain} == {3}
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(tuple(r[c] for c in columns) for r in quality.judge(docs).collect()) == plain
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_op7_windows_are_drawn_from_all_bytes(spark):
    text = "日本語の文" * 1000
    docs = spark.createDataFrame([(0, text, "ja"), (3, "abc" * 100, "en")], "doc_id bigint, text string, lang string").filter(langid.fold_of(F.col("doc_id")) != 1)
    drawn = {}
    for r in langid.sampled_windows(docs, "text", "lang").collect():
        drawn.setdefault(r.lang, []).append(bytes(r.piece))
    raw = text.encode()
    offsets = np.array([0, len(raw)])
    whole, _ = langid.windows_of(np.frombuffer(raw, np.uint8), offsets)
    assert sorted(drawn["ja"]) == sorted(bytes(w).rstrip(b"\0") for w in whole)
    assert sum(map(len, drawn["ja"])) == len(raw)


def loop_probabilities(net, window):
    """The network's definition, place by place."""
    hidden = []
    for i, w in enumerate(langid.WIDTHS):
        for f in range(langid.FILTERS):
            values = [sum(float(net.p[0][window[at + o]] @ net.p[1 + i][o][:, f]) for o in range(w)) for at in range(len(window) - w + 1)]
            hidden.append(max(max(values) + float(net.p[1 + len(langid.WIDTHS) + i][f]), 0.0))
    z = np.array(hidden) @ net.p[-2] + net.p[-1]
    e = np.exp(z - z.max())
    return e / e.sum()


def test_op7_network_and_mean_over_windows_against_loops(spark):
    r = np.random.default_rng(4)
    net = langid.ByteCnn(["a", "b", "c"], seed=3)
    net.p = [p + 0.3 * r.normal(size=p.shape).astype(np.float32) for p in net.p]
    net.tables = [net.kernels(i) for i in range(len(langid.WIDTHS))]
    texts = ["short", "ü" * 300 + " and more words " * 20, "x" * langid.WINDOW, "9 9", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    rows = {x.doc_id: x for x in langid.predict(df, net).collect()}
    for i, text in enumerate(texts):
        if text is None or not any(c.isalpha() for c in text):
            assert (rows[i].lang_pred, rows[i].score) == ("und", 0.0)
            continue
        raw = text.encode()
        parts = [raw[a : a + langid.WINDOW].ljust(langid.WINDOW, b"\0") for a in range(0, len(raw), langid.WINDOW)]
        mean = np.mean([loop_probabilities(net, p) for p in parts], axis=0)
        assert rows[i].lang_pred == net.langs[int(mean.argmax())] and abs(rows[i].score - mean.max()) < 1e-4


def test_op1_runs_of_many_blocks(spark, monkeypatch):
    rng = random.Random(6)
    shared = prose(rng, 60)
    rows = [(i, prose(rng, 20) + shared[rng.randint(0, 40) :] + prose(rng, 20)) for i in range(25)]
    monkeypatch.setattr(suffixes, "RUN_BLOCK", 3)
    want = brute_repeats(rows)
    got = suffixes.without_repeats(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans) for r in got} == {d: v[:3] for (d, _), v in want.items()}


def test_op1_text_of_several_segments(spark):
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=8)) for _ in range(20_000)]
    text = " ".join(rng.choices(words, k=150_000))
    edge = suffixes.SEGMENT
    assert len(text) > edge
    long = text[: edge - 150] + text[500:900] + text[edge - 150 :]
    other = text[edge - 60 : edge + 200] + " end of the other one, which has words of its own"
    seen, want = set(), {}
    for doc_id, t in ((1, long), (2, other)):
        gone = np.zeros(len(t) + 1, int)
        for i in range(len(t) - 99):
            if (w := t[i : i + 100]) in seen:
                gone[i] += 1
                gone[i + 100] -= 1
            seen.add(w)
        mask = np.cumsum(gone[:-1]) > 0
        want[doc_id] = (int(mask.sum()), "".join(c for c, m in zip(t, mask, strict=True) if not m).encode())
    got = suffixes.without_repeats(frame(spark, [(1, long), (2, other)])).collect()
    assert {r.doc_id: (r.n_removed, bytes(r.kept)) for r in got} == want and want[1][0] >= 400 and want[2][0] >= 200
