"""Quality rules by cross-document line frequency.

Lines are normalised (lower case, digits as 0, blanks collapsed) and hashed. For each host the number of
distinct documents that hold a line is counted; lines above the limit are boilerplate and are taken out;
a document that loses too much is depleted and rejected. Documents carry no url, so `source` is the host.

Native: DataFrame functions only. Texts never cross the network: what is shuffled is one small row for
each distinct line of a document, added up before the shuffle, so a hot host or a hot line stays small. The lines above the limit are written; where
they are few they are broadcast to the documents' lines, else the rows of the most frequent ones are dealt evenly (`joined_by_key`).

Defined cases: a null text has no words and fails the base rules; a null source is a host of its own;
a null doc_id is an ordinary value; repeated rows count as so many documents and each get a row; extra
columns are never read; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memoria.llm.common import NULL_ID, joined_by_key, table, written

BLANK = r"\x20\x09-\x0D"
WORD_GAP = f"[{BLANK}]+"
SYMBOL = r"[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A line that more documents of one host hold is boilerplate.
MAX_DOCS_PER_LINE = 20
#: A document is depleted if less than this part of its words is left.
MIN_WORDS_LEFT = 0.5


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_GAP), lambda w: w != "")


def repeated_words(grams: str) -> Column:
    """Words that lie in a three-word window found twice or more; `grams` holds the windows' 64-bit hashes."""
    by_hash = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))

    def count(run: Column) -> Column:
        last = F.size(run) - 1
        at = F.sequence(F.lit(0), last)
        g = lambda j: F.get(run, j)["g"]
        twice = F.filter(at, lambda j: ((j > 0) & F.coalesce(g(j) == g(j - 1), F.lit(False))) | ((j < last) & F.coalesce(g(j) == g(j + 1), F.lit(False))))
        starts = F.transform(twice, lambda j: F.get(run, j)["i"])
        return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda i: F.array(i, i + 1, i + 2)))))

    counted = F.get(F.transform(F.array(by_hash), count), F.lit(0))
    return F.when(F.size(F.array_distinct(grams)) < F.size(grams), counted).otherwise(0).cast("bigint")


def base_metrics(docs: DataFrame) -> DataFrame:
    """`docs(doc_id, text, ...)` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(f"[^{BLANK}]"))
    w = F.col("_words")
    grams = F.when(F.size(w) >= 3, F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))
    df = docs.withColumns({"_words": words_of(F.col("text")), "_lines": lines})
    df = df.withColumn("_grams", F.coalesce(grams, F.array().cast("array<bigint>")))
    df = df.withColumns(
        {
            "n_words": F.size("_words").cast("bigint"),
            "word_chars": F.length(F.array_join("_words", "")).cast("bigint"),
            "n_symbols": F.regexp_count(text, F.lit(SYMBOL)).cast("bigint"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint"),
            "n_repeat_words": repeated_words("_grams"),
        }
    ).drop("_words", "_lines", "_grams")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return df.withColumn("base_failed", failed)


def normalised(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(line), "[0-9]", "0"), WORD_GAP, " "))


def document_lines(docs: DataFrame) -> DataFrame:
    """One row for each line with a word: _k1, _k2 (the document), host, line hash, its place, words, first of its kind."""
    lines = F.filter(F.transform(F.split("text", "\n"), normalised), lambda x: x != "")
    items = F.array_sort(F.transform(lines, lambda x, i: F.struct(F.xxhash64(x).alias("line"), i.alias("at"), (F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1).alias("words"))))
    df = docs.select("_k1", "_k2", "host", items.alias("_items"))
    first = F.transform("_items", lambda x, j: F.when((j > 0) & (F.get(F.col("_items"), j - 1)["line"] == x["line"]), 0).otherwise(1))
    pairs = F.zip_with("_items", first, lambda x, f: F.struct(x["line"].alias("line"), x["at"].alias("at"), x["words"].alias("words"), f.alias("first")))
    return df.select("_k1", "_k2", "host", F.inline(pairs))


def line_key() -> Column:
    return F.concat_ws(":", F.col("line").cast("string"), "host").alias("_line")


def judge(docs: DataFrame, max_docs_per_line: int = MAX_DOCS_PER_LINE, min_words_left: float = MIN_WORDS_LEFT) -> DataFrame:
    """`docs(doc_id, text, source)` with base metrics, words_removed, words_left and kept."""
    keyed = docs.select("doc_id", "text", F.coalesce("source", F.lit("\0none")).alias("host"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NULL_ID)).alias("_k1"), F.xxhash64("text").alias("_k2"))
    lines = document_lines(keyed)
    counted = lines.groupBy("host", "line").agg(F.sum("first").alias("n_docs"), F.count(F.lit(1)).alias("times")).filter(F.col("n_docs") > max_docs_per_line)
    common = written(counted.select(line_key(), "times", F.lit(True).alias("common")), "common-lines")
    hits = joined_by_key(lines.withColumn("_line", line_key()), common, "_line").filter("common")
    # Repeated rows share a key; dividing by their number gives what one of them loses.
    lost = hits.groupBy("_k1", "_k2", "host").agg((F.sum("words") / (F.count(F.lit(1)) / F.count_distinct("at"))).cast("bigint").alias("words_removed"))
    metrics = base_metrics(keyed).drop("text")
    df = metrics.join(lost, ["_k1", "_k2", "host"], "left").withColumn("words_removed", F.coalesce("words_removed", F.lit(0).cast("bigint")))
    left = F.col("n_words") - F.col("words_removed")
    df = df.withColumns({"words_left": left, "kept": ~F.col("base_failed") & (left >= min_words_left * F.col("n_words"))})
    return df.drop("_k1", "_k2", "host")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: base metrics, the base rules' verdict, and the final one."""
    return judge(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


ORACLE = r"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(source, 'none') AS host, row_number() OVER () AS rid FROM documents
), w AS (
  SELECT rid, list_filter(regexp_split_to_array(text, '[ \t\n\x0B\x0C\r]+'), lambda x: x <> '') AS words FROM docs
), grams AS (
  SELECT rid, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS g
  FROM w, unnest(range(1, len(words) - 1)) AS r(i)
), twice AS (
  SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM grams) WHERE n > 1
), repeats AS (
  SELECT rid, count(DISTINCT i + d) AS n FROM twice, (VALUES (0), (1), (2)) AS o(d) GROUP BY rid
), raw AS (
  SELECT rid, host, unnest(string_split(text, chr(10))) AS line FROM docs
), full_lines AS (
  SELECT rid, host, line FROM raw WHERE regexp_matches(line, '[^ \t\n\x0B\x0C\r]')
), dup AS (
  SELECT rid, count(*) - count(DISTINCT line) AS n FROM full_lines GROUP BY rid
), norm AS (
  SELECT rid, host, trim(regexp_replace(regexp_replace(lower(line), '[0-9]', '0', 'g'), '[ \t\n\x0B\x0C\r]+', ' ', 'g')) AS line FROM full_lines
), common AS (
  SELECT host, line FROM norm GROUP BY host, line HAVING count(DISTINCT rid) > 20
), lost AS (
  SELECT rid, sum(len(string_split(line, ' '))) AS n FROM norm JOIN common USING (host, line) GROUP BY rid
), m AS (
  SELECT doc_id, len(words)::BIGINT AS n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
    coalesce(repeats.n, 0)::BIGINT AS n_repeat_words, coalesce(lost.n, 0)::BIGINT AS words_removed
  FROM docs JOIN w USING (rid) LEFT JOIN repeats USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN lost USING (rid)
), f AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_words - words_removed AS words_left FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, words_removed, words_left,
  NOT base_failed AND words_left >= 0.5e0 * n_words AS kept
FROM f
"""
