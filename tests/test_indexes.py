"""Saved indexes and what is searched by parts, against brute force."""

import math
import os
import random
from collections import Counter
from pathlib import Path

import numpy as np
from pyspark.sql import functions as F

from memoria.functions.vectors import nearest
from memoria.model import scope_rank
from memoria.operators import cells, postings
from memoria.operators.lexical import Terms, bm25
from memoria.operators.pins import pinned
from memoria.operators.shares import best_shares
from memoria.sources.shared import shared_folder
from memoria.streaming import changes, live
from memoria.tools import search_memory, search_vectors


def vectors_around(rng, groups, each, size=16):
    middles = rng.normal(size=(groups, size))
    return [(g * each + i, [float(x) for x in middles[g] + 0.6 * rng.normal(size=size)], g % 5 + 1) for g in range(groups) for i in range(each)]


def test_cells_find_what_all_vectors_give(spark, tmp_path):
    rows = vectors_around(np.random.default_rng(1), 12, 60)
    odd = [(9001, None, 1), (9002, [1.0, 2.0], 1), (9003, [0.0] * 16, 1), (9004, [float("nan")] * 16, 1), (None, rows[0][1], 1)] + [(8000 + i, rows[7][1], 5) for i in range(150)]
    df = spark.createDataFrame(rows + odd, "id bigint, vector array<double>, rank bigint")
    index = cells.build(df, str(tmp_path / "index"), cells=16)
    asked = df.filter("id % 9 = 0 or id = 9002").select(F.col("id").alias("query_id"), "vector", (F.col("id") % 5).alias("least_rank"))
    whole = {(r.query_id, r.place): (r.id, r.score) for r in nearest(df, asked, 4).collect() if r.query_id != 9002}
    every = {(r.query_id, r.place): (r.id, r.score) for r in index.search(asked, 4, probes=16).collect()}
    assert every == whole
    some = {(r.query_id, r.id) for r in index.search(asked, 4).collect()}
    assert len(some & {(q, i) for (q, _), (i, _) in whole.items()}) >= 0.9 * len(whole) and index.probes < 16
    again = cells.opened(spark, str(tmp_path / "index"))
    assert np.array_equal(again.centres, index.centres) and again.probes == index.probes
    one = index.search(asked.limit(1), 4, probes=1)
    assert "PartitionFilters: [" in one._jdf.queryExecution().toString() and "cell" in one._jdf.queryExecution().toString().split("PartitionFilters: [")[1][:60]
    again.add(spark.createDataFrame([(7000, rows[0][1], 5)], "id bigint, vector array<double>, rank bigint"))
    mine = spark.createDataFrame([(1, rows[0][1])], "query_id bigint, vector array<double>")
    assert {r.id for r in again.search(mine, 2, probes=1).collect()} == {rows[0][0], 7000}


def test_cells_follow_edits(spark, tmp_path):
    rng = np.random.default_rng(8)
    now = {r[0]: r for r in vectors_around(rng, 8, 30)}
    schema = "id bigint, vector array<double>, rank bigint"
    df = lambda rows: spark.createDataFrame(rows, schema)
    index = cells.build(df(list(now.values())), str(tmp_path / "index"), cells=8)
    for step in range(2):
        new = [(int(i), v, k) for i, (_, v, k) in zip(rng.permutation(300)[:40], vectors_around(rng, 8, 5), strict=True)]
        gone = [int(i) for i in rng.permutation(240)[:25]] + [9999]
        # A row twice, null ids, an id whose vector can't be held and one that has such a row beside a good one.
        odd = [new[3], (None, new[0][1], 5), (new[0][0], [1.0], 5), (new[1][0], None, 5)]
        index.replace(df([*new, *odd]), spark.createDataFrame([(i,) for i in [*gone, None]], "id bigint"), batch=f"b{step}")
        index.replace(df([(7, new[0][1], 5)]), batch=f"b{step}")
        now = {i: v for i, v in now.items() if i not in set(gone)} | {r[0]: r for r in new}
    bad = next(iter(now))
    index.replace(df([(bad, [1.0, 2.0], 5)]))
    index.remove(df([]), spark.createDataFrame([(sorted(now)[-1],)], "id bigint"))
    now = {i: v for i, v in now.items() if i not in (bad, sorted(now)[-1])}
    assert sorted((r.id, r.vector, r["rank"]) for r in index.stored(spark).collect()) == sorted(now.values())
    asked = df(list(now.values())).filter("id % 7 = 0").select(F.col("id").alias("query_id"), "vector", (F.col("id") % 5).alias("least_rank"))
    ranked = lambda found: sorted((r.query_id, r.place, r.id, r.score) for r in found.collect())
    want = ranked(nearest(df(list(now.values())), asked, 4))
    assert ranked(index.search(asked, 4, probes=8)) == want
    # Built anew of what it has.
    again = cells.build(index.stored(spark).drop("cell"), str(tmp_path / "again"), cells=8)
    assert ranked(again.search(asked, 4, probes=8)) == want
    # What isn't finished doesn't count.
    os.rename(tmp_path / "again" / "writes", tmp_path / "again" / "kept")
    again.replace(df([(1, [0.5] * 16, 5)]))
    os.rename(tmp_path / "again" / "writes", tmp_path / "again" / "lost")
    os.rename(tmp_path / "again" / "kept", tmp_path / "again" / "writes")
    assert ranked(again.search(asked, 4, probes=8)) == want


def test_a_vector_is_searched_in_a_saved_index(spark, tmp_path):
    rows = vectors_around(np.random.default_rng(2), 5, 20)
    scopes = ["clinical", "private", "personal", "professional", "public"]
    df = spark.createDataFrame([(i, v, scopes[k - 1]) for i, v, k in rows], "id bigint, vector array<double>, scope string")
    index = cells.build(df.select("id", "vector", scope_rank(F.col("scope")).cast("bigint").alias("rank")), str(tmp_path / "index"), cells=5)
    index.probes = 5
    for profile in ("work", "nobody"):
        got = [tuple(r) for r in search_vectors(index, rows[3][1], profile, 6, -1.0).orderBy("place").collect()]
        assert got == [tuple(r) for r in search_vectors(df, rows[3][1], profile, 6, -1.0).orderBy("place").collect()]


def test_an_index_of_nothing(spark, tmp_path):
    df = spark.createDataFrame([], "id bigint, vector array<double>")
    index = cells.build(df, str(tmp_path / "none"))
    assert index.search(spark.createDataFrame([(1, [1.0])], "query_id bigint, vector array<double>"), 3).count() == 0


def world(rng, n):
    words = [f"w{int(rng.paretovariate(0.7)) % 300}" for _ in range(5000)]
    return [(i, " ".join(rng.choices(words, k=rng.randint(0, 60))), rng.randint(1, 5)) for i in range(n)]


def test_postings_in_segments_rank_as_terms_made_at_once(spark, tmp_path):
    rng = random.Random(3)
    docs = spark.createDataFrame(world(rng, 900), "doc_id bigint, text string, rank int")
    index = postings.Postings(spark, str(tmp_path / "p"))
    index.add(docs.filter("doc_id < 700"), per_range=32)
    index.add(docs.filter("doc_id >= 700"), per_range=32)
    index.add(docs.limit(0))
    asked = spark.createDataFrame([(q, f"w{rng.randint(0, 40)}", q % 6) for q in range(12) for _ in range(6)] + [(50, "nowhere", 0)], "query_id bigint, term string, least_rank bigint")
    rows = lambda df: sorted((r.query_id, r.place, r.doc_id, r.score) for r in df.collect())
    assert rows(index.search(asked, 4)) == rows(bm25(Terms(docs), asked, 4))
    assert rows(index.search(asked.drop("least_rank"), 7)) == rows(bm25(Terms(docs), asked.drop("least_rank"), 7))


def test_postings_follow_edits(spark, tmp_path):
    rng = random.Random(5)
    now: dict[int, tuple] = {}
    index = postings.Postings(spark, str(tmp_path / "p"))
    schema = "doc_id bigint, text string, rank int"
    df = lambda rows: spark.createDataFrame(rows, schema)
    asked = spark.createDataFrame([(q, f"w{rng.randint(0, 30)}", q % 6) for q in range(8) for _ in range(5)], "query_id bigint, term string, least_rank bigint")
    rows = lambda found: sorted((r.query_id, r.place, r.doc_id, r.score) for r in found.collect())

    def holds():
        assert rows(index.search(asked, 5)) == rows(bm25(Terms(df(list(now.values()))), asked, 5))
        assert sorted((r.doc_id, r.length) for r in index.documents().collect()) == sorted((i, len((t or "").split())) for i, t, _ in now.values())

    assert index.search(asked, 5).count() == 0
    index.add(df([]))
    first = world(rng, 300)
    now |= {r[0]: r for r in first}
    index.add(df(first), per_range=16)
    holds()
    for step in range(4):
        new = [(i, t, r) for (_, t, r), i in zip(world(rng, 60), rng.sample(range(360), 60), strict=True)]
        new[0] = (new[0][0], None, 3)
        gone = rng.sample(sorted(now), 20) + [9999]
        lost = set(gone) - {i for i, *_ in new}
        # A row twice, a null id, and ids that are both put in and taken out.
        index.replace(df([*new, new[5], (None, "w1", 5)]), spark.createDataFrame([(i,) for i in [*gone, None]], "doc_id bigint"), per_range=16, batch=f"b{step}")
        index.replace(df([(1, "w1 w2", 5)]), batch=f"b{step}")  # the same batch again
        now = {i: v for i, v in now.items() if i not in lost} | {r[0]: r for r in new}
        if step in (1, 3):
            holds()
    index.remove(spark.createDataFrame([(i,) for i in list(now)[:30]], "doc_id bigint"))
    for i in list(now)[:30]:
        del now[i]
    held = len(index.state().live)
    assert index.compact(per_range=16) > 1 and len(index.state().live) < held
    holds()
    before = sum(len(p) for _, _, p in os.walk(tmp_path / "p"))
    (tmp_path / "p" / "blocks" / "segment=sleft" / "part=3").mkdir(parents=True)
    index.vacuum()
    assert sum(len(p) for _, _, p in os.walk(tmp_path / "p")) < before and not (tmp_path / "p" / "blocks" / "segment=sleft").exists()
    holds()
    # What isn't finished doesn't count.
    index._write("sunfinished", df([(5000, "w1 w2 w3", 5)]), "doc_id", "text", 16)
    index.documents().withColumn("by", F.lit("sunfinished")).write.partitionBy("by").mode("append").parquet(f"{index.path}/dead")
    holds()


def test_replacing_copies_no_texts_and_dead_segments_are_not_read(spark, tmp_path):
    docs = spark.createDataFrame(world(random.Random(6), 300), "doc_id bigint, text string, rank int")
    asked = spark.createDataFrame([(1, "w1"), (1, "w7"), (2, "w3"), (2, "")], "query_id bigint, term string")
    rows = lambda found: sorted((r.query_id, r.place, r.doc_id, r.score) for r in found.collect())
    shared = Path(shared_folder(spark))
    index = postings.Postings(spark, str(tmp_path / "p"))
    index.add(docs.withColumn("text", F.lit("w1 w2 w3")))
    first, before = index.state().names, {p.name for p in shared.iterdir()}
    index.replace(docs)
    made = [p for p in shared.iterdir() if p.name not in before and any(p.glob("*.parquet"))]
    assert not [p for p in made if "text" in spark.read.parquet(str(p)).columns]
    for file in (tmp_path / "p" / "blocks" / f"segment={first[0]}").rglob("part-*.parquet"):
        (file.parent / f".{file.name}.crc").unlink(missing_ok=True)
        file.write_bytes(b"no longer a table")
    assert index.compact() == 1 and not set(first) & set(index.state().names)
    assert rows(index.search(asked, 5)) == rows(bm25(Terms(docs), asked, 5))


def test_a_search_sees_files_as_they_are(spark, tmp_path):
    folder, index = tmp_path / "in", postings.Postings(spark, str(tmp_path / "index"))
    folder.mkdir()
    (folder / "a.md").write_text("apples and pears")
    (folder / "b.md").write_text("pears alone")
    stream = lambda: changes.changed_files(spark, str(folder), str(tmp_path / "listings"))
    run = lambda: live.kept_indexed(stream(), index, str(tmp_path / "point"))
    find = lambda *words: {r.doc_id.rsplit("/", 1)[1] for r in index.search(spark.createDataFrame([(1, w) for w in words], "query_id bigint, term string"), 9).collect()}
    run()
    assert find("pears") == {"a.md", "b.md"}
    (folder / "a.md").write_text("quinces, changed")
    (folder / "b.md").unlink()
    (folder / "c.md").write_text("plums")
    run()
    run()
    assert (find("pears", "apples"), find("quinces", "plums")) == (set(), {"a.md", "c.md"})
    assert index.documents().count() == 2


def test_a_prompt_reads_only_the_folders_of_its_words(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"word{i % 90} common other{i}", ["clinical", "public", "professional"][i % 3]) for i in range(600)], "doc_id bigint, text string, scope string")
    ranked = docs.withColumn("rank", F.when(F.col("scope") == "clinical", 1).when(F.col("scope") == "public", 5).otherwise(4))
    index = postings.Postings(spark, str(tmp_path / "p"))
    index.add(ranked)
    found = search_memory(index, "word7 other7 !", "work")
    assert sorted(tuple(r) for r in found.collect()) == sorted(tuple(r) for r in search_memory(docs, "word7 other7 !", "work").collect())
    own = index.own_blocks(spark.createDataFrame([("word7",), ("other7",)], "term string"))
    plan = own._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "part" in plan.split("PartitionFilters: [")[1][:80]
    assert len(own.inputFiles()) > 0 and own.select("part").distinct().count() <= 2 < index.blocks().select("part").distinct().count()


def test_bounds_leave_ranges_unread(spark, tmp_path):
    rows = [(i, "common " * 3 + f"filler{i}") for i in range(2000)] + [(5000 + i, "rare common") for i in range(6)]
    index = postings.Postings(spark, str(tmp_path / "p"))
    index.add(spark.createDataFrame(rows, "doc_id bigint, text string"), per_range=16)
    asked = spark.createDataFrame([(1, "rare"), (1, "common")], "query_id bigint, term string")
    assert {r.doc_id for r in index.search(asked, 2).collect()} == {5000, 5001}
    assert math.isclose(index.search(asked, 1).first().score, bm25(Terms(spark.createDataFrame(rows, "doc_id bigint, text string")), asked, 1).first().score)


def test_pins_hold_at_folders(spark):
    pins = spark.createDataFrame([("/", "full"), ("/en/1/", "public"), ("/en", "work"), ("/en", "full"), ("/x", "nobody"), ("/x", "full"), (None, "work")], "pin string, profile string")
    paths = ["/en/1", "/en/10", "/en/1/deep", "/english", "/en/", "/", "//en//1", "/x/y", None]
    df = spark.createDataFrame([(p, 1) for p in paths], "path string, profile int")
    got = [(r.path, r.profile) for r in pinned(df, pins).collect()]
    want = ["public", "work", "public", "full", "work", "full", "public", "nobody", None]
    assert Counter(got) == Counter(zip(paths, want, strict=True))
    assert [r.profile for r in pinned(df.limit(2), pins.limit(0)).collect()] == [None, None]


def test_shares_in_blocks(spark, monkeypatch):
    from memoria.operators import shares

    rng = random.Random(4)
    docs = [[f"w{rng.randint(0, 60)}" for _ in range(rng.randint(0, 20))] for _ in range(200)] + [None]
    asked = [(i, [f"w{rng.randint(0, 60)}" for _ in range(rng.randint(0, 9))]) for i in range(30)]
    asked = [(i, sorted(set(w))) for i, w in asked]
    monkeypatch.setattr(shares, "BLOCK_BYTES", 400)
    d = spark.createDataFrame([(sorted(set(x)) if x is not None else None,) for x in docs], "words array<string>")
    got = {r.k: r.best for r in best_shares(d, spark.createDataFrame(asked, "k bigint, words array<string>"), "k").collect()}
    want = {i: round(max(len(set(w) & set(x or [])) / len(w) for x in docs), 6) for i, w in asked if w}
    assert got == {i: s for i, s in want.items() if s}


def test_rows_of_asked_words_alone_rank_as_all_rows(spark, monkeypatch):
    from memoria.operators import lexical

    rng = random.Random(9)
    rows = [*world(rng, 200), (900, None, 3), (901, "", 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, rank int")
    asked = spark.createDataFrame([(q, f"w{rng.randint(0, 60)}") for q in range(5) for _ in range(5)], "query_id bigint, term string")
    every, own = Terms(docs), Terms(docs, asked=asked)
    ranked = lambda terms: sorted(tuple(r) for r in bm25(terms, asked, 6).collect())
    assert (every.n, every.mean_length) == (own.n, own.mean_length) and ranked(every) == ranked(own)
    assert own.rows.select("term").distinct().count() <= 25 < every.rows.select("term").distinct().count()
    monkeypatch.setattr(lexical, "MOST_ASKED", 3)
    assert ranked(Terms(docs, asked=asked)) == ranked(every)


def test_many_words_asked_for_make_their_rows_alone(spark, monkeypatch):
    from memoria.operators import lexical

    rng = random.Random(10)
    docs = spark.createDataFrame([*world(rng, 200), (900, None, 3), (901, "", 3)], "doc_id bigint, text string, rank int")
    asked = spark.createDataFrame([(q, f"w{rng.randint(0, 60)}") for q in range(5) for _ in range(5)], "query_id bigint, term string")
    every = Terms(docs)
    monkeypatch.setattr(lexical, "MOST_ASKED", 3)
    monkeypatch.setattr(lexical, "ASKED_BYTES", 100)
    own = Terms(docs, asked=asked)
    ranked = lambda terms: sorted(tuple(r) for r in bm25(terms, asked, 6).collect())
    assert own.rows.select("term").distinct().count() <= 25
    assert (every.n, every.mean_length) == (own.n, own.mean_length) and ranked(every) == ranked(own)
    rare = sorted(tuple(r) for r in every.rarest(asked, "query_id", 2, at_least=2).collect())
    counts = lexical.document_counts(docs)
    assert rare == sorted(tuple(r) for r in lexical.rarest(counts, asked, "query_id", 2, at_least=2).drop("df").collect())
    # Scored where documents lie, in blocks of queries and of pairs.
    monkeypatch.setattr(lexical, "PAIRS", 7)
    lying = lexical.bm25_where_lying(docs.select("doc_id", "text"), asked.join(counts, "term"), 6)
    assert sorted((r.query_id, r.doc_id, r.score, r.place) for r in lying.collect()) == sorted((r.query_id, r.doc_id, r.score, r.place) for r in bm25(every, asked, 6).collect())
