"""The pipeline's near-duplicate stage against brute-force Jaccard similarity."""

import random

import numpy as np
import pyarrow as pa
import pytest

from memoria.llm import common, jaccard


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else frozenset()


def brute_components(rows):
    """Row to the smallest id of its component."""
    sets, part = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if part[i] != part[j] and (a == b or 10 * len(a & b) >= 8 * len(a | b)):
                part = [part[j] if p == part[i] else p for p in part]
    return [min(rows[k][0] for k, q in enumerate(part) if q == p) for p in part]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = []
    for _ in range(25):
        base = [word() for _ in range(rng.randint(20, 200))]
        texts.append(" ".join(base))
        for edits in range(1, 7):
            copy = list(base)
            for at in rng.sample(range(len(copy)), edits):
                copy[at] = word()
            texts.append(" ".join(copy))
    texts += [None, "", " \n", "Two Words", "two words", "other words", texts[0]]
    order = rng.sample(range(len(texts)), len(texts))
    return [(i, texts[k]) for i, k in enumerate(order)]


@pytest.mark.parametrize("block", [jaccard.BLOCK_HASHES, 200])
def test_components_are_those_of_brute_force(spark, rows, block):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in jaccard.near_duplicates(docs, block=block).collect()}
    assert got == dict(zip((i for i, _ in rows), brute_components(rows), strict=True))


def test_stage_keeps_one_of_each_component(spark, rows):
    import corpus_pipeline

    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    stage = dict(corpus_pipeline.STAGES)["near_duplicates"]
    assert {r.doc_id for r in stage(spark, docs, "").collect()} == set(brute_components(rows))


def alike_sets(rng, least):
    """Two sets of `least` shared hashes that are as unlike as a similarity of 0.8 allows."""
    apart = least // 4
    mine = rng.integers(0, apart + 1)
    hashes = rng.integers(0, 2**64, least + apart, np.uint64)
    return np.sort(hashes[: least + mine]), np.sort(np.r_[hashes[:least], hashes[least + mine :]])


def test_fingerprint_bits_are_majorities_of_hashes():
    hashes = np.random.default_rng(1).integers(0, 2**64, 700, np.uint64)
    counts = [0] * 128
    for h in hashes.tolist():
        for w in range(2):
            x = (h ^ int(jaccard._SALT[w])) * int(jaccard._ODD[w]) % 2**64
            x = (x ^ x >> 32) * int(jaccard._ODD2[w]) % 2**64
            x ^= x >> 29
            for i, byte in enumerate(x.to_bytes(8, "little")):
                for k in range(8):
                    counts[64 * w + 8 * i + k] += 1 if byte >> (7 - k) & 1 else -1
    assert jaccard.majorities(hashes, 2).tolist() == counts


def entries(sets, bits):
    """(key, class, words) of every set, classes being places."""
    rows = []
    for i, s in enumerate(sets):
        tables = jaccard.TABLES[bits][len(s) <= jaccard.SMALL]
        sketch = np.frombuffer(jaccard.sketch(s, bits), np.uint8)[None]
        words = sketch[0, : 8 * jaccard.FILTER_WORDS].copy().view(np.uint64)
        rows += [(k, i, words) for k in jaccard.segment_keys(sketch, np.array([len(s)]), bits, tables)[0].tolist()]
    return rows


def grouped(rows):
    buckets = {}
    for row in sorted(rows, key=lambda r: r[:2]):
        buckets.setdefault(row[0] >> jaccard.TAIL, []).append(row)
    for rows in buckets.values():
        yield from (g.tolist() for g in jaccard.close_groups(*(np.array(c) for c in list(zip(*rows, strict=True))[:2]), np.array([r[2] for r in rows]).T))


@pytest.mark.parametrize("bits", [8, 12, 16])
def test_pairs_at_the_limit_share_a_bucket_and_are_close(bits):
    rng = np.random.default_rng(bits)
    pairs = [alike_sets(rng, int(least)) for least in [4] * 40 + [8] * 40 + rng.integers(5, 400, 120).tolist()]
    found = {tuple(g) for g in grouped(entries([s for p in pairs for s in p], bits)) if len(g) == 2}
    assert {(2 * i, 2 * i + 1) for i in range(len(pairs))} <= found


@pytest.mark.parametrize("at_once", [1024, 4])
def test_groups_are_those_of_the_balls(monkeypatch, at_once):
    monkeypatch.setattr(jaccard, "AT_ONCE", at_once)
    rng = np.random.default_rng(2)
    sets = [s for least in rng.integers(4, 100, 60).tolist() for s in alike_sets(rng, least)]
    rows = entries(sets, 8)
    balls = [{k >> jaccard.TAIL for k, i, _ in rows if i == x} for x in range(len(sets))]
    words = {i: [int(w) for w in ws] for _, i, ws in rows}

    def close(x, y):
        least, most = sorted((len(sets[x]), len(sets[y])))
        limit = jaccard.FILTER_BITS[0 if least > jaccard.SMALL else 1]
        return 5 * least >= 4 * most and sum((a ^ b).bit_count() for a, b in zip(words[x], words[y], strict=True)) <= limit

    want = {(x, y) for y in range(len(sets)) for x in range(y) if balls[x] & balls[y] and close(x, y)}
    assert len(want) > 50 and {tuple(g) for g in grouped(rows)} == want


def test_many_close_classes_are_one_group():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, 300, np.uint64)
    sets = [np.sort(np.r_[base, rng.integers(0, 2**64, 5, np.uint64)]) for _ in range(40)]
    groups = list(grouped(entries(sets, 8)))
    assert any(len(g) > jaccard.PAIRED for g in groups) and {i for g in groups for i in g} == set(range(40))


def test_sets_of_alike_texts_are_sent_once(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = []
    for _ in range(10):
        base = [word() for _ in range(200)]
        for _ in range(12):
            base[rng.randrange(200)] = word()
            texts.append(" ".join(base))

    def sent(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("print"), batch.column("key")], names=["a", "b"])

    monkeypatch.setattr(jaccard, "_linked", sent)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").selectExpr("doc_id", "xxhash64(text) AS tag", "text")
    marks = docs.mapInArrow(jaccard._marks(8), jaccard.MARKS).collect()
    rows = jaccard.links(spark.createDataFrame(marks, jaccard.MARKS), docs, 8).collect()
    assert len(rows) == len({r.a for r in rows}) > 100


def groups_of(spark, groups, size, **limits):
    members = spark.createDataFrame([(k, p) for k, g in enumerate(groups) for p in g], "key bigint, print bigint")
    classes = spark.createDataFrame([(p, size) for p in {p for g in groups for p in g}], "print bigint, size bigint")
    found = {}
    for r in jaccard.joined_groups(members, classes, **limits).collect():
        found.setdefault(r.key, []).append(r.print)
    return sorted(sorted(g) for g in found.values())


def test_groups_with_classes_in_common_are_one(spark):
    assert groups_of(spark, [[10, 11], [11, 12], [12, 13], [20, 21], [30, 31, 32], [30, 32]], 9) == [[10, 11, 12, 13], [20, 21], [30, 31, 32]]


def test_large_groups_are_joined_where_that_saves_work(spark):
    chain = [[i, i + 1] for i in range(10, 20)]
    assert groups_of(spark, chain, 9, limit=50) == chain
    again = [[p for p in range(10, 20) if p != i] for i in range(10, 20)]
    assert groups_of(spark, again, 9, limit=50) == [list(range(10, 20))]
    assert groups_of(spark, again, 9, limit=50, block=10) == [list(range(10, 20))]
    assert groups_of(spark, chain, 9, block=50) == chain


def test_rows_that_may_have_a_key_are_all_that_have(spark):
    rows = spark.range(200_000).selectExpr("id - 100000 AS a", "CASE WHEN id % 2 = 0 THEN 'x' ELSE 'y' END AS b", "id")
    keys = common.written(rows.filter("id % 10 = 0").select("a", "b"), "keys")
    got = {r.id for r in common.perhaps_in(rows, keys).select("id").collect()}
    assert set(range(0, 200_000, 10)) <= got and len(got) < 200_000 * (0.1 + 1.2 * 0.9 / common.KEY_BITS)
    assert common.perhaps_in(rows, common.written(keys.limit(0), "keys")).isEmpty()
    one = common.written(keys.filter("a = 0"), "keys")
    assert 100_000 in {r.id for r in common.perhaps_in(rows, one).select("id").collect()}
