"""The registered queries as they are registered, odd rows and columns, and what the operators promise at sizes that no table here has."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from memoria.llm import bpe, common, decontaminate, langid, pii, quality, registry, secrets, simhash, suffixes, toxicity, urls
from test_corpus import brute_distance, brute_repeats, frame, prose

SMALL = "/root/testdata/sf0.001"


def sha(b):
    return hashlib.sha256(b).hexdigest()


@pytest.fixture(scope="module")
def texts():
    rows = duckdb.sql(f"select doc_id, text from read_parquet('{SMALL}/documents.parquet') order by doc_id").fetchall()
    return rows


def found(spark, name):
    return {r.doc_id: r for r in registry.queries()[name](spark, SMALL).collect()}


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_registered_query_gives_its_sql_rows(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.sql(f"create view {t} as select * from read_parquet('{SMALL}/{t}.parquet')")
    want = con.sql(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, SMALL)
    assert sorted(got.columns) == sorted(want.columns)
    pick = lambda rows, columns: sorted(tuple(str(dict(zip(columns, r, strict=True))[c]) for c in sorted(columns)) for r in rows)
    assert pick([tuple(r) for r in got.collect()], got.columns) == pick(want.fetchall(), want.columns)


def test_op1(spark, texts):
    want, rows = brute_repeats(texts), found(spark, "op1_suffixes")
    for (doc_id, _), (n, gone, spans, kept) in want.items():
        r = rows[doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (n, gone, spans, kept)


def luhn(digits):
    total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(int(c) for c in reversed(digits)))
    return total % 10 == 0


BASE = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    "ip": (r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    "card": (r"[0-9]([\x20-]?[0-9])+", lambda m: 16 <= len(re.sub("[^0-9]", "", m)) <= 19 and luhn(re.sub("[^0-9]", "", m))),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 8 <= len(re.sub("[^0-9]", "", m)) <= 15),
}


def brute_pii(text):
    return [(k, m.start(), m.end()) for k, (p, ok) in BASE.items() for m in re.finditer(p, text or "") if ok(m[0])]


def test_op2(spark, texts):
    rows = found(spark, "op2_pii")
    for doc_id, text in texts:
        spans, r = brute_pii(text), rows[doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[0] == k for s in spans) for k in BASE]
        assert r.base_sha256 == sha(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode())


def test_pii_of_random_texts(spark):
    rng = random.Random(6)
    bits = ["a", "b.c", "@", "x.y", ".", "1", "12", "255", "256", "4111111111111111", "4111 1111 1111 1111", " ", "-", "+", "(", ")", "é", "日", "\n", "+1 555 123 4567"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randint(0, 40)))) for i in range(1500)]
    got = pii.find_pii(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    for r in got:
        assert [(s.kind, s.start, s.end) for s in r.pii_spans if s.kind in BASE] == brute_pii(r.text), r.text
        assert all(r.text[s.start : s.end] == s.value for s in r.pii_spans)


def test_many_matches_in_one_text(spark):
    n = 60_000
    text = " ".join(f"a{i}@b.org token=abcdefg{i}" for i in range(n))
    df = spark.createDataFrame([(1, text)], "doc_id int, text string")
    r = pii.find_pii(df).first()
    assert len(r.pii_spans) == n and all(text[s.start : s.end] == s.value for s in r.pii_spans[:: n // 100])
    assert pii.mask_pii(df).first().text == re.sub(r"a\d+@b\.org", "[EMAIL]", text)
    assert len(secrets.scan(df)[0].first().findings) == n


def test_apart_from_is_what_it_says(spark):
    rng = random.Random(2)
    span = lambda kind: (kind, a := rng.randint(0, 30), a + rng.randint(1, 6), "v", 1.0)
    rows = [([span("x") for _ in range(rng.randint(0, 5))], [span("y") for _ in range(rng.randint(0, 5))]) for _ in range(300)]
    df = spark.createDataFrame(rows, f"a {common.NO_SPANS}, b {common.NO_SPANS}")
    for r in df.select("a", "b", common.apart_from(F.col("a"), F.col("b")).alias("c")).collect():
        want = [x for x in r.a if not any(y.start < x.end and x.start < y.end for y in r.b)]
        assert sorted(r.c) == sorted(want)


def test_superseded_rules_leave_their_findings_behind(spark):
    df = spark.createDataFrame([(1, "token = 'abcdef12' " + "0f" * 12), (2, "nothing")], "doc_id int, text string")
    first, ledger = secrets.scan(df)
    old = ledger.withColumn("rules", F.transform("rules", lambda x: F.regexp_replace(x, "assign@1", "assign@0")))
    old = old.withColumn("findings", F.transform("findings", lambda f: F.struct(F.regexp_replace(f["rule"], "assign@1", "assign@0").alias("rule"), f["span"].alias("span"))))
    again, fresh = secrets.scan(df, old)
    assert {r.doc_id: r.findings for r in again.collect()} == {r.doc_id: r.findings for r in first.collect()}
    assert {tuple(r.rules) for r in fresh.collect()} == {("assign@1",)}
    assert secrets.scan(df, old.unionByName(fresh))[1].count() == 0


def test_op6(spark, texts):
    items = duckdb.sql(f"select item_id, text from read_parquet('{SMALL}/benchmark.parquet')").fetchall()
    got = {(r.doc_id, r.item_id) for r in registry.queries()["op6_decontaminate"](spark, SMALL).collect()}
    plain = {i: decontaminate.plain(t) for i, t in items}
    for doc_id, text in texts:
        p = decontaminate.plain(text)
        assert {i for d, i in got if d == doc_id} >= {i for i, q in plain.items() if q in p}
    assert got


def test_items_of_any_size(spark):
    rng = random.Random(11)
    long, short = prose(rng, 8000), "日本語の短い項目です"
    rows = [(1, "x " + long[:-40] + " y"), (2, "前" + short + "後"), (3, prose(rng, 50)), (4, None)]
    items = spark.createDataFrame([(1, long), (2, short), (2, short), (3, short), (4, "a b"), (5, None)], "item_id bigint, text string")
    docs = frame(spark, rows)
    got = {(r.doc_id, r.item_id) for r in decontaminate.matches(docs, items).collect()}
    assert got == {(1, 1), (2, 2), (2, 3)}
    assert {r.doc_id for r in decontaminate.decontaminated(docs, items).collect()} == {3, 4}
    assert decontaminate.decontaminated(docs, items).columns == docs.columns
    item = decontaminate.Item(1, decontaminate.plain(prose(rng, 30)))
    changed = item.text[:20] + "q" + item.text[22:]
    assert item.distance("zz " + changed) == brute_distance(item.text, "zz " + changed)


def test_a_large_item_comes_alone(spark):
    big = "".join(random.Random(1).choices("abcdefghij ", k=decontaminate.BLOCK_BYTES // 4 + 100))
    items = spark.createDataFrame([(1, big), (2, "an ordinary item of a few words")], "item_id bigint, text string")
    assert sorted(len(b) for b in decontaminate.blocks(items, "text")) == [1, 1]


def test_op7_and_op8_contracts(spark, texts):
    for name, parts, held in (("op7_langid", 3, 1), ("op8_toxicity", 4, 2)):
        rows = found(spark, name)
        assert set(rows) == {d for d, _ in texts}
        for d, r in rows.items():
            assert r.held_out == (zlib.crc32(str(d).encode()) % parts == held) and 0 <= r.score <= 1
            assert name == "op7_langid" or r.predicted == int(r.score >= 0.3)


def test_network_gradients_are_those_of_the_loss():
    net = langid.ByteCnn(["a", "b", "c"])
    net.p = [p.astype(np.float64) for p in net.p]
    r = np.random.default_rng(1)
    x, y = r.integers(0, 256, (5, 40)).astype(np.uint8), np.array([0, 1, 2, 1, 0])
    loss = lambda: -np.log(net.probabilities(x)[np.arange(5), y]).mean()
    for k, g in enumerate(net.gradients(x, y)):
        for at in zip(*(r.integers(0, n, 4) for n in g.shape), strict=True):
            keep, step = net.p[k][at], 1e-5
            net.p[k][at] = keep + step
            up = loss()
            net.p[k][at] = keep - step
            down = loss()
            net.p[k][at] = keep
            assert abs((up - down) / (2 * step) - g[at]) < 1e-4


def test_risk_gradient_is_that_of_the_risk():
    r = np.random.default_rng(2)
    z, is_p, prior = r.normal(size=12), np.arange(12) < 5, 0.2

    def risks(z):
        p = toxicity.logistic(z)
        return prior * -np.log(p[is_p]).mean(), -np.log(1 - p[~is_p]).mean() - prior * -np.log(1 - p[is_p]).mean()

    for shift in (0.0, -6.0):
        at = z + np.where(is_p, -shift, shift)
        g = toxicity.risk_gradient(toxicity.logistic(at), is_p, prior)
        negative = risks(at)[1]
        value = (lambda v: sum(risks(v))) if negative >= 0 else (lambda v: -risks(v)[1])
        for i in range(12):
            step = np.eye(12)[i] * 1e-5
            assert abs((value(at + step) - value(at - step)) / 2e-5 - g[i]) < 1e-5


def test_sums_of_pairs():
    r = np.random.default_rng(3)
    dense = r.random((30, 17)) < 0.2
    dense[4] = dense[:, 5] = False
    pairs = toxicity.Pairs(dense.sum(1), np.nonzero(dense)[1].astype(np.int32), 17)
    a, b = r.normal(size=17), r.normal(size=30)
    assert np.allclose(pairs.by_row(a), dense @ a) and np.allclose(pairs.by_column(b), dense.T @ b)


def test_word_features_score_as_a_direct_loop(spark):
    rows = [(1, "Ab cdefgh ab"), (2, ""), (3, None), (4, "ünder 12 x")]
    weights = np.random.default_rng(4).normal(size=1 << toxicity.BITS).astype(np.float32)
    got = {r.doc_id: r.s for r in frame(spark, rows).select("doc_id", toxicity.score_column(spark, (weights, -1.0), F.col("text")).alias("s")).collect()}
    for d, t in rows:
        words = re.findall(rb"[A-Za-z\x80-\xff]+", (t or "").lower().encode())
        known = set()
        for w in set(words):
            for piece, kind in [(w, 0)] + [(w[:n], n) for n in toxicity.BEGINNINGS if len(w) > n]:
                value = sum(int(toxicity.BYTE_VALUE[b]) * int(toxicity.PLACE_FACTOR[min(i, 63)]) for i, b in enumerate(piece)) % 2**64
                known.add(int(toxicity._pairs(np.zeros(1, np.int64), np.array([value], np.uint64), kind)[0]))
        assert abs(got[d] - toxicity.logistic(sum(float(weights[f]) for f in known) - 1.0)) < 1e-6


def test_shares_hold_at_any_count(spark):
    hashes = spark.range(200_000).select(F.xxhash64("id").alias("h"))
    for n in (10**3, 10**9, 10**12):
        # Of n rows these hashes stand for, those that fall into the share of n / 1000 are looked for.
        assert abs(hashes.filter(common.below_share(F.col("h"), 1000 / n)).count() - 200_000 * min(1, 1000 / n)) <= 5 * (200_000 * 1000 / n) ** 0.5 + 1
    least = spark.createDataFrame([(-(2**63),), (2**63 - 1,)], "h bigint")
    assert [r[0] for r in least.select(common.below_share(F.col("h"), 600 / 10**13)).collect()] == [True, False]


def test_op9_and_hot_classes(spark, texts):
    rows = found(spark, "op9_simhash")
    prints = {d: simhash.fingerprint(t) for d, t in texts}
    part = {d: d for d in prints}
    for a in prints:
        for b in prints:
            if a < b and part[a] != part[b] and (prints[a] ^ prints[b]).bit_count() <= 3:
                part = {k: part[a] if v == part[b] else v for k, v in part.items()}
    for d, r in rows.items():
        assert r.fingerprint == f"{prints[d]:016x}" and r.component_id == min(k for k, v in part.items() if v == part[d])


def test_rows_of_hot_keys_meet_their_values(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(3000)] + [(-1, None), (-2, "unknown")], "id int, key string").repartition(4)
    values = rows.filter("key is not null and key <> 'unknown'").groupBy("key").agg(F.count(F.lit(1)).alias("times"), F.min("id").alias("first"))
    values = common.written(values, "test-values")
    got = {r.id: r.first for r in common.joined_by_key(rows, values, "key").collect()}
    assert got == {i: (1 if i % 3 else i) for i in range(3000)} | {-1: None, -2: None}


def test_links_dealt_again_to_the_last_level(spark):
    rng = random.Random(5)
    base = rng.getrandbits(32) << 32
    prints = {base | rng.getrandbits(12) for _ in range(150)} | {base | (0xFFFFF << 12) | rng.getrandbits(8) for _ in range(40)}
    rows = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p,) for p in sorted(prints)], "print bigint")
    roots = lambda limit: {r.node: r.root for r in simhash.components(simhash.links(rows, limit)).collect()}
    assert roots(4) == roots(simhash.BUCKET_ROWS)


def test_op10(spark, texts):
    import tiktoken

    path, pattern = bpe.vocabulary()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.parse_ranks(bpe.read_ranks(path)), special_tokens={})
    rows = found(spark, "op10_bpe")
    for d, t in texts:
        ids = library.encode_ordinary(t or "")
        assert (rows[d].n_tokens, rows[d].ids_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()))
        assert rows[d].decoded_sha256 == sha((t or "").encode())


def test_transducer_settles_long_pieces():
    ranks = bpe.parse_ranks(bpe.read_ranks(bpe.vocabulary()[0]))
    machine, rng = bpe.Transducer(ranks), random.Random(8)
    steps = bpe.LockStep(machine)
    for n in (1, 63, 64, 65, 200, 1500):
        piece = "".join(rng.choice("abcdeinrst éñ日") for _ in range(n)).encode()
        want = [ranks[x] for x in bpe.merge(piece, ranks)]
        assert machine.encode(piece) == want
        assert np.frombuffer(steps.encode([piece])[0], "<u4").tolist() == want
    assert all(bpe.merge(token, ranks) == [token] for token in rng.sample(sorted(ranks), 300))


def test_windows_of_large_grams(spark):
    rng = random.Random(12)
    line = "".join(rng.choices("abcdefghijklmnop", k=70))
    rows = [(i, prose(rng, 12) + line + prose(rng, 12)) for i in range(30)] + [(40, rows) for rows in [prose(rng, 30)]]
    rows += [(50 + i, rows[i][1][20:] + "tail") for i in range(8)]
    want = brute_repeats(rows)
    for most in (3, 4096):
        got = suffixes.without_repeats(frame(spark, rows).withColumn("orig", F.col("text")), most=most).collect()
        assert {(r.doc_id, r.orig): (r.n_bytes, r.n_removed, r.n_spans, sha(bytes(r.kept))) for r in got} == want


CLASH = ["_id", "_tag", "_places", "_packed", "_part", "_whole", "_spans", "_base", "_added", "_parts", "_best", "_both", "_hot", "_key", "_cold", "_ruled", "_url", "rank", "times", "print", "root", "gram", "blob_", "kind"]


def test_columns_of_any_name_stay(spark):
    rng = random.Random(13)
    rows = [(1, prose(rng, 60)), (2, prose(rng, 60)), (2, None), (None, "token=abcdefg a@b.org"), (None, "token=abcdefg a@b.org")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").select("*", *[F.lit(f"own {c}").alias(c) for c in CLASH])
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id bigint, toxic int")
    items = spark.createDataFrame([(1, rows[0][1])], "item_id bigint, text string")
    path = bpe.vocabulary()
    outs = {
        "op1": suffixes.without_repeats(df), "op2": pii.find_pii(df), "mask": pii.mask_pii(df), "op4": secrets.scan(df)[0], "op7": langid.predict(df, None),
        "op8": toxicity.score_toxicity(df, labels), "op9": simhash.keep_one(df), "op10": bpe.round_trip(df, *path), "encode": bpe.encode_documents(df, *path),
    }
    for name, out in outs.items():
        got = out.collect()
        assert len(got) == (4 if name == "op9" else 5), name
        assert all(r[c] == f"own {c}" for r in got for c in CLASH), name
    assert decontaminate.decontaminated(df, items).count() == 4
    pages = df.select(F.col("doc_id").alias("page_id"), F.lit("http://a.org/x").alias("url"), *CLASH)
    got = urls.judge(pages).collect()
    assert len(got) == 5 and all(r[c] == f"own {c}" for r in got for c in CLASH)


def test_empty_tables_and_repeated_rows_of_the_models(spark):
    none = frame(spark, [])
    labels = spark.createDataFrame([(1, 1)], "doc_id bigint, toxic int")
    assert toxicity.score_toxicity(none, labels).count() == 0 and langid.predict(none, langid.train(none)).count() == 0
    assert decontaminate.matches(none, frame(spark, []).withColumn("item_id", F.lit(1))).count() == 0
    same = spark.createDataFrame([(5, "some words of text", "en")] * 40 + [(6, "mots de texte", "fr")] * 40, "doc_id bigint, text string, lang string")
    out = langid.predict(same, langid.train(same)).select("doc_id", "lang_pred", "score").distinct().collect()
    assert len(out) == 2
    scores = toxicity.score_toxicity(same, spark.createDataFrame([(5, 1), (6, 0), (None, 1)], "doc_id bigint, toxic int")).groupBy("doc_id").agg(F.count_distinct("toxicity").alias("n")).collect()
    assert all(r.n == 1 for r in scores)


def test_a_very_long_text(spark):
    rng = random.Random(14)
    text = prose(rng, 30_000)
    df = frame(spark, [(1, text), (2, text), (3, text[:-30])])
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    assert {r.n_words for r in quality.judge(df).filter("doc_id < 3").collect()} == {len(words)}
    assert {r.component_id for r in simhash.near_duplicates(df).collect()} == {1}
    items = spark.createDataFrame([(1, text[9_000:9_400])], "item_id bigint, text string")
    assert decontaminate.decontaminated(df, items).count() == 0


def test_no_shared_folder_on_a_cluster():
    class Conf:
        def get(self, _):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):  # noqa: N802
            return Conf()

        def getCheckpointDir(self):  # noqa: N802
            return None

    class Session:
        sparkContext = Context()  # noqa: N815

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_folder(Session())
