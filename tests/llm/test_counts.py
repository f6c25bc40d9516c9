import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from memoria.llm import counts, registry

SMALL = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")
POOL = ["'s", "'T", "'re", "''", "'", "ll", "'ll", "<|endoftext|>", "<|startoftext|>", "<|endof", "İ", "Σ", "ΑΣ", "é", "é", "한", "하", "日本", "1", "23", "½", " ", "\n", "\x1c", "\x85", "!!", "—", "🙂", "aaaa", "hello", "World", "the", "ing", "ͅ", "ﬁ", "ß", "\x00", "Ᲊ", "Ɤ", "\U000323b0"]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda texts: [len(e.ids) for e in tokenizer.encode_batch(texts, add_special_tokens=False)]


@pytest.fixture(scope="module")
def vocabulary():
    with open(PATH, "rb") as f:
        return counts.Vocabulary(f.read())


def test_every_code_point_is_cut_as_by_the_library(library, vocabulary):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    points = [c for i, c in enumerate(points) if i < 0x3400 or i % 17 == 0]
    for begin in range(0, len(points), 20_000):
        texts = [f"a{c}1!{c}é'S{c}" for c in points[begin : begin + 20_000]]
        assert library(texts) == vocabulary.token_counts(list(texts)).tolist()


def test_texts_of_odd_parts(library, vocabulary):
    rng = random.Random(5)
    for _ in range(1500):
        texts = ["".join(rng.choices(POOL, k=rng.randint(0, 30))) for _ in range(5)]
        assert library(texts) == vocabulary.token_counts(list(texts)).tolist()


def test_long_rows_singly_and_in_step(library, vocabulary, monkeypatch):
    rng = random.Random(6)
    texts = ["".join(rng.choices("abcdefghij", k=5000)), "a" * 3000, "=" * 5000, "ab" * 300, "a" * 256, "a" * 257]
    expected = library(texts)
    for long in (1, counts.LONG, 10**9):
        monkeypatch.setattr(counts, "LONG", long)
        assert vocabulary.token_counts(list(texts)).tolist() == expected


def test_another_build_is_refused():
    with open(PATH, encoding="utf-8") as f:
        data = f.read()
    with pytest.raises(ValueError, match="build"):
        counts.Vocabulary(data.replace('"Lowercase"', '"NFKC"').encode())


def test_odd_rows_and_columns(spark, library, monkeypatch):
    long = "Some words, 12 of them; it's fine. " * 60_000
    rows = [(1, None, 5), (2, "", 5), (3, " \n", 5), (4, "Hello", 5), (4, "Hello", 5), (None, "x<|endoftext|>y", 5), (6, long, 5), (7, "z" * 200_000, 5)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int")
    out = counts.with_token_counts(df, PATH)
    assert out.columns == df.columns
    assert sorted((r.text or "", r.n_tokens) for r in out.collect()) == sorted((t or "", n) for (_, t, _), n in zip(rows, library([t or "" for _, t, _ in rows]), strict=True))
    assert counts.with_token_counts(df.limit(0), PATH).count() == 0


def test_registered_query_against_the_library(spark, library):
    rows = {r.doc_id: r for r in registry.queries()["op13_token_counts"](spark, SMALL).collect()}
    texts = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    assert len(rows) == len(texts)
    for (doc_id, text), n in zip(texts, library([t or "" for _, t in texts]), strict=True):
        r = rows[doc_id]
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((text or "").encode()), n, n > 2048)
