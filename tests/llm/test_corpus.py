"""The corpus operators against brute force on small fixtures with all the odd rows."""

import hashlib
import random
import re

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from test_jaccard import brute_components

from memoria.llm import bpe, decontaminate, langid, pii, quality, secrets, simhash, suffixes, toxicity, urls

EXTRA = ", host string, words int, blob string, tag string, part string, score string"


def frame(spark, rows):
    """documents-like rows with extra columns whose names clash with internal ones."""
    return spark.createDataFrame([(i, t, "src", "en", "h", 1, "b", "t", "p", "s") for i, t in rows], "doc_id bigint, text string, source string, lang string" + EXTRA)


def prose(rng, n):
    return " ".join("".join(rng.choice(["an", "er", "ti", "ou", "le", "wh"]) for _ in range(rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    base = prose(rng, 120)
    out = [(i, prose(rng, rng.randint(1, 90))) for i in range(12)]
    out += [(20, base), (21, base), (22, base + " more"), (23, "x" + base[:300]), (24, base[50:260] + " é " + base[50:260]), (25, None), (26, ""), (27, "a" * 500), (28, "b" * 450 + "a" * 120)]
    out += [(30, "dup"), (30, "dup"), (None, base), (None, None), (31, "   \n\t "), (32, prose(rng, 30000))]
    return out


def sha(b):
    return hashlib.sha256(b).hexdigest()


def brute_repeats(rows):
    seen, out = {}, []
    order = sorted({((r[0] if r[0] is not None else -(2**63)), r[1] or "") for r in rows})
    for doc_id, text in order:
        b = text.encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 99):
            w = b[p : p + 100]
            if seen.setdefault(w, (doc_id, p)) != (doc_id, p):
                gone[p : p + 100] = b"\1" * 100
        out.append(((doc_id, text), (len(b), sum(gone), sum(1 for i in range(len(b)) if gone[i] and not (i and gone[i - 1])), sha(bytes(x for x, g in zip(b, gone, strict=True) if not g)))))
    return dict(out)


def test_suffixes(spark, texts):
    df = suffixes.without_repeats(frame(spark, texts).withColumn("orig", F.col("text")))
    assert {"host", "tag", "part"} <= set(df.columns)
    want = brute_repeats(texts)
    got = df.collect()
    assert len(got) == len(texts)
    for r in got:
        key = (r.doc_id if r.doc_id is not None else -(2**63), r.orig or "")
        assert (r.n_bytes, r.n_removed, r.n_spans, sha(bytes(r.kept))) == want[key], key


def test_suffix_merge_orders_runs():
    rng = random.Random(1)
    rows = sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(24, 60))) for _ in range(300))
    runs = [sorted(rows[i::7]) for i in range(7)]

    def told(run):
        last = b""
        for s in run:
            n = 0
            while n < min(len(s), len(last)) and s[n] == last[n]:
                n += 1
            yield n, s, ()
            last = s

    merged = list(suffixes.merged([told(r) for r in runs]))
    assert [m[1] for m in merged] == rows
    for (_, a, _), (n, b, _) in zip(merged[:-1], merged[1:], strict=True):
        assert a[:n] == b[:n] and (n == min(len(a), len(b)) or a[n] != b[n])


def test_pii_spans_and_mask(spark):
    text = "mail a.b@c.org or +1 (555) 123-4567, card 4111 1111 1111 1111; ip 10.0.0.255 not 10.0.0.256. IBAN DE89370400440532013000, ssn 123-45-6789, call 555-123-9876 é x@y.z"
    rows = [(1, text), (2, None), (3, ""), (4, "4111 1111 1111 1112 +1 12 1.2.3"), (4, "4111 1111 1111 1112 +1 12 1.2.3"), (5, "a" * 50000 + "@" + "1" * 3000)]
    df = pii.find_pii(frame(spark, rows))
    by = {r.doc_id: [(s.kind, r.text[s.start : s.end]) for s in r.pii_spans] for r in df.collect()}
    assert by[1] == [("email", "a.b@c.org"), ("email", "x@y.z"), ("ip", "10.0.0.255"), ("card", "4111 1111 1111 1111"), ("phone", "+1 (555) 123-4567"), ("iban", "DE89370400440532013000"), ("local_phone", "555-123-9876"), ("ssn", "123-45-6789")]
    assert by[2] == by[3] == by[4] == by[5] == []
    masked = {r.doc_id: r.text for r in pii.mask_pii(frame(spark, rows)).collect()}
    assert masked[1].startswith("mail [EMAIL] or [PHONE], card [CARD]; ip [IP] not 10.0.0.256. IBAN [IBAN], ssn [SSN], call [LOCAL_PHONE]")
    assert masked[2] is None and masked[3] == ""


def test_secrets_ledger(spark):
    key = "AKIA" + "Z" * 16
    rows = [(1, f"token = 'abcdef12' {key} " + "0f" * 12), (2, f"token = 'abcdef12' {key} " + "0f" * 12), (3, "Password: abc secret=abcdefg"), (4, None), (5, ""), (6, "eyJhbGciOiJI.eyJzdWIiOiIx.SflKxwRJSM")]
    df = frame(spark, rows)
    out, fresh = secrets.scan(df)
    by = {r.doc_id: [(s.kind, s.start, s.end) for s in r.findings] for r in out.collect()}
    assert by[1] == by[2] == [("assign", 0, 17), ("access", 19, 39), ("hex", 40, 64)]
    assert by[3] == [("assign", 14, 28)] and by[4] == by[5] == [] and by[6] == [("web_token", 0, 36)]
    assert fresh.count() == 4  # the empty blob, and one for the two copies
    again, new = secrets.scan(df, fresh)
    assert new.count() == 0
    assert {r.doc_id: len(r.findings) for r in again.collect()} == {k: len(v) for k, v in by.items()}


def brute_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + d for i, g in enumerate(grams) if grams.count(g) > 1 for d in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)


def test_quality(spark, texts):
    rows = [r for r in texts if r[0] != 32] + [(40, "a b c a b c\nx\nx\n #$"), (41, " lead\x0btail\r\n")]
    out = quality.judge(frame(spark, rows))
    got = sorted(((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in out.collect()))
    assert got == sorted(brute_quality(t) for _, t in rows)


def test_common_lines_deplete(spark):
    rng = random.Random(5)
    line = prose(rng, 60)
    rows = [(i, line + "\n" + prose(rng, 55 if i % 2 else 80)) for i in range(30)]
    rows += [(100 + i, prose(rng, 70)) for i in range(5)]
    out = {r.doc_id: (r.words_removed, r.kept) for r in quality.judge(frame(spark, rows)).collect()}
    for i in range(30):
        assert out[i] == (60, i % 2 == 0)
    assert all(out[100 + i] == (0, True) for i in range(5))


def brute_distance(item, text):
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        last, row[0] = row[0], i
        for j, d in enumerate(text, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != d))
    return min(row)


def test_decontaminate(spark):
    rng = random.Random(7)
    item = prose(rng, 40)
    plain = decontaminate.plain(item)
    changed = list(plain)
    for i in rng.sample(range(len(plain)), decontaminate.budget(plain) - 2):
        changed[i] = "z"
    rows = [(1, prose(rng, 50) + " " + item.upper() + ". " + prose(rng, 20)), (2, "".join(changed)), (3, prose(rng, 300)), (4, None), (5, ""), (2, "".join(changed)), (6, item[: len(item) // 2])]
    items = spark.createDataFrame([(10, item, "x"), (11, None, "x"), (12, "a b", "x"), (None, item, "x")], "item_id bigint, text string, doc_id string")
    got = {(r.doc_id, r.item_id, r.distance) for r in decontaminate.matches(frame(spark, rows), items).collect()}
    want = set()
    for d, t in rows:
        for k in (10, None):
            n = brute_distance(plain, decontaminate.plain(t))
            if n <= decontaminate.budget(plain):
                want.add((d, k, n))
    assert got == want and {g[0] for g in got} == {1, 2}
    kept = decontaminate.decontaminated(frame(spark, rows), items)
    assert sorted(r.doc_id for r in kept.collect()) == [3, 4, 5, 6]
    assert decontaminate.matches(frame(spark, rows), items.limit(0)).count() == 0


def test_myers_is_edit_distance():
    rng = random.Random(2)
    for _ in range(60):
        a, b = ("".join(rng.choice("abc ") for _ in range(rng.randint(3, 70))) for _ in range(2))
        masks = {c: sum(1 << i for i, x in enumerate(a) if x == c) for c in set(a)}
        assert decontaminate.reaches(masks, len(a), b, 0) == brute_distance(a, b)
        assert decontaminate.Item(0, a * 12).distance(b * 3) == brute_distance(a * 12, b * 3)


def test_langid_on_held_out(spark, small):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = langid.op7_langid(spark, "/root/testdata/sf0.01").join(docs.select("doc_id", "lang"), "doc_id")
    held = out.filter("held_out")
    assert held.filter("lang = lang_pred").count() > 0.97 * held.count()
    assert out.filter("score < 0 or score > 1").count() == 0
    model = langid.train(docs)
    odd = langid.predict(frame(spark, [(1, None), (2, ""), (3, "12 !"), (4, "the and of " * 9000)]), model)
    assert [r.lang_pred for r in odd.orderBy("doc_id").collect()] == ["und", "und", "und", "en"]
    assert langid.train(docs.limit(0)) is None
    assert langid.predict(frame(spark, [(1, "x")]), None).first().lang_pred == "und"


def test_toxicity(spark):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    out = toxicity.op8_toxicity(spark, folder)
    held = out.filter("held_out").join(labels, "doc_id").toPandas()
    caught = ((held.predicted == 1) & (held.toxic == 1)).sum() / (held.toxic == 1).sum()
    wrong = ((held.predicted == 1) & (held.toxic == 0)).sum() / (held.toxic == 0).sum()
    assert caught > 0.7 and wrong < 0.05
    docs = frame(spark, [(1, None), (2, ""), (3, "x")])
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert [r.toxicity for r in toxicity.score_toxicity(docs, none).collect()] == [0.0] * 3


def test_simhash(spark, texts):
    def slow(text):
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        import xxhash

        shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] * bool(words)
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))

    rows = [r for r in texts if r[0] != 32]
    long = rows[13][1]
    rows += [(50 + i, long[: -1 - i]) for i in range(25)]
    prints = [slow(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    ids = [r[0] if r[0] is not None else -(2**63) for r in rows]
    least = {}
    for i in range(len(rows)):
        least[root(i)] = min(least.get(root(i), ids[i]), ids[i])
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    assert sorted((r.doc_id, r.print % 2**64, r.component_id) for r in got) == sorted((ids[i], prints[i], least[root(i)]) for i in range(len(rows)))
    kept = simhash.keep_one(frame(spark, rows)).collect()
    assert len(kept) == len(least) and {r.doc_id if r.doc_id is not None else -(2**63) for r in kept} == set(least.values())
    assert simhash.keep_one(frame(spark, [])).count() == 0


def test_simhash_large_buckets_are_dealt_again(spark):
    rng = random.Random(9)
    base = rng.getrandbits(64)
    prints = {base}
    while len(prints) < 300:
        x = rng.choice(sorted(prints)) ^ (1 << rng.randrange(32)) ^ (1 << rng.randrange(32))
        prints.add(x)
    rows = spark.createDataFrame([(p - 2**64 if p >= 2**63 else p,) for p in sorted(prints)], "print bigint")
    found = {r.node: r.root for r in simhash.components(simhash.links(rows, limit=16)).collect()}
    whole = {r.node: r.root for r in simhash.components(simhash.links(rows)).collect()}
    assert found == whole and len(set(found.values())) == 1


def test_bpe_matches_library(spark, texts):
    import tiktoken

    path, pattern = bpe.vocabulary()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=bpe.parse_ranks(bpe.read_ranks(path)), special_tokens={})
    rng = random.Random(4)
    alphabet = ["a", "the", "  ", "\n", "é", "日本", "😀", "'ll", "12", "\x00", "\u0301", "<|endoftext|>", "_", "!!"]
    rows = texts + [(100 + i, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60)))) for i in range(60)] + [(999, "z" * 9000)]
    df = bpe.decode_documents(bpe.encode_documents(frame(spark, rows), path, pattern), path)
    for r in df.collect():
        assert list(memoryview(bytes(r.token_ids)).cast("I")) == library.encode_ordinary(r.text or "")
        assert r.decoded == (r.text or "")


def test_utf8_machine_takes_any_cut():
    text = "aé日😀\x00ñ"
    raw = text.encode()
    for size in range(1, 6):
        machine = bpe.Utf8Machine()
        parts = [machine.feed(raw[i : i + size]) for i in range(0, len(raw), size)]
        assert "".join(parts) + machine.feed(b"", last=True) == text
    machine = bpe.Utf8Machine()
    assert machine.feed(b"\xe6\x97") + machine.feed(b"", last=True) == "\ufffd"


def test_urls(spark):
    rows = [(i, f"https://{'good' if i % 2 else 'bad'}{i}.example.{'org' if i % 2 else 'com'}/{'fr' if i % 2 else 'de'}/p{i}?q") for i in range(60)]
    rows += [(100, None), (101, ""), (102, "nothing"), (103, "HTTP://A.ORG"), (104, "http://x.example.ORG/en/12"), (105, "http://goodorg/de/"), (106, "http://bad8.example.net/de/p#x://y"), (107, "http://good9.example.net/fr/p"), (100, None)]
    out = urls.judge(spark.createDataFrame([(i, u, "h", "s", 1, "x", "y") for i, u in rows], "page_id bigint, url string, html string, score string, times int, gram string, verdict string"))
    by = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out.collect()}
    assert len(by) == 68 and out.count() == 69
    assert by[100][:3] == by[101][:3] == by[102][:3] == ("", "", None)
    assert by[103][:3] == ("a.org", "", None)
    assert by[104] == ("x.example.org", "/en/12", "example.org/en/1", "block")
    assert by[105][2] is None
    assert by[106][3] == "block" and by[107][3] == "allow"
    empty = urls.judge(spark.createDataFrame([], "page_id bigint, url string"))
    assert empty.count() == 0


def test_empty_tables(spark):
    none = frame(spark, [])
    assert suffixes.without_repeats(none).count() == 0
    assert pii.find_pii(none).count() == 0
    assert secrets.scan(none)[0].count() == 0
    assert quality.judge(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert bpe.encode_documents(none, *bpe.vocabulary()).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    step = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        after = stage(spark, step, folder)
        assert after.columns == docs.columns
        after = spark.createDataFrame(after.toPandas(), after.schema)
        a, b = ({r.doc_id: r.text for r in x.collect()} for x in (step, after))
        assert set(b) <= set(a)
        if name == "toxicity":
            gone = toxicity.score_toxicity(step, labels).filter(F.col("toxicity") >= toxicity.THRESHOLD)
            assert set(a) - set(b) == {r.doc_id for r in gone.collect()}
        elif name == "near_duplicates":
            assert sorted(b) == sorted(set(brute_components([(r.doc_id, r.text) for r in step.collect()])))
        elif name == "decontamination":
            items = [decontaminate.plain(r.text) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
            for d, t in a.items():
                if any(i in decontaminate.plain(t) for i in items):
                    assert d not in b
        else:
            assert set(a) == set(b)
            changed = {d for d in a if a[d] != b[d]}
            assert changed == {r.doc_id for r in pii.find_pii(step).filter(F.size("pii_spans") > 0).collect()}
        step = after
    last = corpus_pipeline.STAGES[4][1](spark, step, folder)
    assert last.columns == ["doc_id", "n_tokens", "token_ids"] and last.count() == step.count()
    odd = docs.limit(3).unionByName(docs.limit(1)).unionByName(spark.createDataFrame([Row(doc_id=None, text=None, lang=None, source=None, n_chars=None)], docs.schema))
    for _, stage in corpus_pipeline.STAGES:
        stage(spark, odd, folder).count()
        stage(spark, odd.limit(0), folder).count()


def test_items_part_the_windows_of_long_rows(monkeypatch):
    import numpy as np

    monkeypatch.setattr(suffixes, "SEGMENT", 700)
    for n in (99, 100, 101, 699, 700, 799, 800, 5000):
        raw = np.frombuffer(prose(random.Random(n), 5000).encode()[:n], np.uint8)
        starts, whole = [], {}
        for data, base, (_, first, last, anchor, _) in suffixes.items(raw, np.array([0, n])):
            for a, b, c in zip(first.tolist(), last.tolist(), anchor.tolist(), strict=True):
                starts += range(base + a, base + b + 1)
                assert b <= c <= a + suffixes.GRAMS - 1
                for p in range(a, b + 1):
                    text = data[p : p + suffixes.LENGTH].tobytes()
                    assert whole.setdefault(text, c - p) == c - p
        assert starts == list(range(max(0, n - 99)))
