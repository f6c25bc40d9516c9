import math
import random
import re
from collections import Counter

import numpy as np

from memoria.llm import ranked, registry

SMALL = "/root/testdata/sf0.001"


def brute(docs, items, top=10):
    lower = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
    terms = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower(t))
    counted = [(d, Counter(terms(t))) for d, t in docs]
    n_docs, n_terms = sum(bool(c) for _, c in counted), sum(sum(c.values()) for _, c in counted)
    held = Counter(t for _, c in counted for t in c)
    out = []
    for item_id, text in set(items):
        scores = []
        for doc_id, c in counted:
            m = 10 + (90 * sum(c.values()) * n_docs) // max(n_terms, 1)
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(terms(text)) if t in c)
            if score > 0:
                scores.append((-score, doc_id is None, doc_id))
        key = lambda s: (s[0], s[1], s[2] or 0)
        out += [(item_id, k, d, -s) for k, (s, _, d) in enumerate(sorted(scores, key=key)[:top], 1)]
    return Counter(out)


def found(df):
    return Counter(tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect())


def world(rng, n):
    words = [f"w{int(rng.paretovariate(0.6)) % 400}" for _ in range(20_000)]
    docs = [(i, " ".join(rng.choices(words, k=rng.choice([0, 3, 20, 60, 300])))) for i in range(n)]
    docs += [(n + i, docs[3][1] + "") for i in range(30)] + [(None, docs[4][1] + " x"), (7, None), (7, "Ähre_ähre!WORD"), (8, "word " * 5000)]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 25)))) for i in range(25)]
    items += [(1, "word ähre"), (50, docs[3][1]), (51, docs[3][1]), (51, docs[3][1]), (52, None), (53, " . "), (54, "nowhere"), (None, "w1 w2 word")]
    return docs, items


def test_ranks_are_those_of_all_scores(spark, monkeypatch):
    for seed, seeds in ((1, 50), (2, 0), (3, ranked.SEEDS)):
        monkeypatch.setattr(ranked, "SEEDS", seeds)
        docs, items = world(random.Random(seed), 400)
        df = spark.createDataFrame(docs, "doc_id bigint, text string").repartition(3)
        assert found(ranked.ranked(df, spark.createDataFrame(items, "item_id bigint, text string"))) == brute(docs, items)


def test_small_buckets_in_any_order(spark, monkeypatch):
    docs, items = world(random.Random(6), 300)
    wanted = [(i, ranked_terms(t)) for i, t in sorted(set(items), key=str) if ranked_terms(t)]
    vocabulary = sorted({t for _, terms in wanted for t in terms})
    vectors = ranked.term_vectors(spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1), vocabulary, "text").toArrow()
    held = Counter(vectors["terms"].combine_chunks().flatten().to_pylist())
    n_docs, n_terms = sum(n > 0 for n in vectors["n"].to_pylist()), sum(vectors["n"].to_pylist())
    outs = []
    for bucket in (7, 64, 5000):
        monkeypatch.setattr(ranked, "BUCKET", bucket)
        scoring = ranked.Scoring(vocabulary, held, n_docs, n_terms, wanted, 10)
        outs.append({tuple(r.values()) for b in ranked.best_of(iter(vectors.combine_chunks().to_batches()), scoring) for r in b.to_pylist()})
    assert outs[0] == outs[1] == outs[2]
    got = Counter((i, s) for _, i, _, s in outs[0])
    distinct = {(i, t) for i, t in items}
    assert got == Counter({(i, s): n for (i, s), n in sum((Counter((i, s) for i, _, _, s in brute(docs, [x]).elements()) for x in distinct), Counter()).items()})


def ranked_terms(text):
    return sorted(set(re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))))


def test_items_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(ranked, "BLOCK_BYTES", 600)
    docs, items = world(random.Random(4), 60)
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    asked = spark.createDataFrame(items, "item_id bigint, text string")
    assert len(list(ranked.item_blocks(asked, "text"))) > 2
    assert found(ranked.ranked(df, asked, 3)) == brute(docs, items, 3)


def test_bounds_leave_out_what_cannot_score(spark):
    rng = random.Random(5)
    docs = [(i, " ".join(f"w{rng.randint(0, 50)}" for _ in range(40))) for i in range(3000)] + [(5000 + i, " ".join(f"rare{j}" for j in range(20))) for i in range(10)]
    vectors = ranked.term_vectors(spark.createDataFrame(docs, "doc_id bigint, text string"), sorted({t for _, d in docs for t in d.split()}), "text").toArrow()
    held = Counter(vectors["terms"].combine_chunks().flatten().to_pylist())
    scoring = ranked.Scoring(sorted({t for _, d in docs for t in d.split()}), held, len(docs), 3000 * 40 + 200, [(1, [f"rare{j}" for j in range(20)] + ["w1", "w2"])], 10)
    columns = (vectors[c].combine_chunks() for c in ("n", "terms", "times"))
    bucket = ranked.Bucket(*ranked.entries(*columns, scoring), scoring)
    assert len(bucket.survivors(scoring.terms[0], scoring, 0)) > 1000
    least = bucket.exact(bucket.survivors(scoring.terms[0], scoring, 0), scoring.weights * np.isin(np.arange(len(scoring.weights)), scoring.terms[0])).max()
    assert len(bucket.survivors(scoring.terms[0], scoring, int(least))) == 10
    assert len(bucket.survivors(scoring.terms[0], scoring, int(least) * 2)) == 0


def test_empty_tables_and_clashing_columns(spark):
    docs = spark.createDataFrame([(1, "a b", 3, 4)], "doc_id bigint, text string, score int, _vector int")
    items = spark.createDataFrame([(1, "b c", 9)], "item_id bigint, text string, rank int")
    assert found(ranked.ranked(docs, items)) == brute([(1, "a b")], [(1, "b c")])
    assert ranked.ranked(docs.limit(0), items).count() == 0
    assert ranked.ranked(docs, items.limit(0)).count() == 0
    assert ranked.ranked(docs, items).dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]


def test_registered_query_against_brute_force(spark):
    read = lambda t, c: [tuple(r) for r in spark.read.parquet(f"{SMALL}/{t}.parquet").select(c, "text").collect()]
    assert found(registry.queries()["op12_ranked_search"](spark, SMALL)) == brute(read("documents", "doc_id"), read("benchmark", "item_id"))
