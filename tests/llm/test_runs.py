import hashlib
import random
import re
import zlib

import numpy as np

from memoria.llm import registry, runs

SMALL = "/root/testdata/sf0.001"


def brute_runs(words, min_length=6, min_times=4):
    found = {}
    for q in range(1, len(words) // min_times + 1):
        i = q
        while i < len(words):
            j = i
            while j < len(words) and words[j] == words[j - q]:
                j += 1
            if j > i and j - i + q >= max(min_length, min_times * q):
                found.setdefault((i - q, j - i + q), q)
            i = j + 1 if j == i else j
    return sorted((s, n, q) for (s, n), q in found.items())


def brute_collapsed(words, found):
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def loops(rng):
    words = []
    for _ in range(rng.randint(0, 7)):
        words += [rng.choice("abc"[: rng.randint(1, 3)]) for _ in range(rng.randint(1, 7))] * rng.randint(1, 7)
        if rng.random() < 0.5:
            words = words[: len(words) - rng.randint(0, 2)]
    return words


def test_runs_against_brute_force():
    rng = random.Random(1)
    for _ in range(400):
        texts = [loops(rng) for _ in range(rng.randint(0, 5))]
        raw = [(" " * rng.randint(0, 1) + rng.choice([" ", "\t\n"]).join(t) + " " * rng.randint(0, 1)).encode() for t in texts]
        offsets = np.cumsum([0, *map(len, raw)])
        for times in (4, 5):
            found, counts, data, borders = runs.searched(np.frombuffer(b"".join(raw), np.uint8), offsets, 6, times)
            at = 0
            for k, words in enumerate(texts):
                expected = brute_runs(words, 6, times)
                assert [tuple(map(int, r)) for r in found[at : at + counts[k]]] == expected
                assert data[borders[k] : borders[k + 1]].tobytes().decode() == brute_collapsed(words, expected)
                at += counts[k]


def test_frequent_words_cost_no_square():
    same = np.zeros(300_000, np.int64)
    assert runs.runs_of(same, same).tolist() == [[0, 300_000, 1]]
    mixed = np.where(np.arange(300_000) % 1000 == 999, 1, 0)
    assert [0, 300_000, 1000] in runs.runs_of(mixed, same).tolist()


def test_odd_rows_and_columns(spark):
    loop = "a b " * 5
    rows = [(1, None, 7), (2, "", 7), (3, " \n ", 7), (4, loop, 7), (4, loop, 7), (None, "ü x " * 8, 7), (5, "y" * 100_000, 7), (6, "ab cd " * 20_000 + "end", 7)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, RUNS int")
    out = runs.with_runs(df)
    assert out.columns == ["doc_id", "text", "runs", "collapsed"]
    got = {(r.doc_id, r.text): ([tuple(x) for x in r.runs], r.collapsed) for r in out.collect()}
    assert got[1, None] == got[2, ""] == got[3, " \n "] == ([], "")
    assert got[4, loop] == ([(0, 10, 2)], "a b")
    assert got[None, rows[5][1]] == ([(0, 8, 1)], "ü x")
    assert got[5, rows[6][1]] == ([], "y" * 100_000)
    assert got[6, rows[7][1]] == ([(0, 40_000, 2)], "ab cd end")
    assert runs.with_runs(df.limit(0)).count() == 0


def test_registered_query_against_brute_force(spark):
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows = {r.doc_id: r for r in registry.queries()["op11_runs"](spark, SMALL).collect()}
    texts = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(texts)
    for doc_id, text in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h = zlib.crc32(str(doc_id).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]
        if n > 4000:
            continue
        found, r = brute_runs(words), rows[doc_id]
        assert r.n_runs == len(found)
        best = min(found, key=lambda x: (-x[1], x[0], x[2]), default=None)
        assert (r.start, r.length, r.period) == (best or (None,) * 3)
        assert r.exponent_milli == (best and 1000 * best[1] // best[2])
        assert r.runs_sha256 == sha("".join(f"{s},{m},{q}\n" for s, m, q in found))
        assert r.collapsed_sha256 == sha(brute_collapsed(words, found))
    assert any(r.n_runs for r in rows.values())
