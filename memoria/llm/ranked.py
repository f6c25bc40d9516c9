"""Ranked lexical search: the documents of highest score for each item, by vectors in order of their length.

A document's score for an item is the inner product of two vectors over terms: the item's, of the roots of its terms' weights, and the
document's, of these roots times its impacts (how often it has a term, held against its length). Vectors are kept over the terms of
items only. An item's k best so far give its threshold, and three bounds keep documents below it from being scored:

* By Cauchy and Schwarz a score is no more than the product of both lengths. Documents too short for every item are filtered before they are
  sorted; each task then has its vectors in descending length, in buckets, and passes over a bucket for items that its longest vector can't reach.
* In a bucket an item's terms are taken in descending order of what they can add at most there, until the others together can't reach the threshold: a
  document with none of these focus terms is out without being looked at.
* What a document has of the focus terms, with the product of what is left of both lengths (or the most that the other terms can add), must reach the threshold.

What survives is scored exactly, in 64-bit integers. The first thresholds come from about SEEDS documents drawn by a hash; they change how much is
scored, never the result. Each task gives k rows an item at most, from which a window takes the best. Items come to the tasks in blocks of BLOCK_BYTES of terms.

Defined cases: a null text or one without terms is never found; an item without terms, or whose terms no document holds, has no rows; equal items (id and text)
count once, items that share an id but not the text rank apart; repeated documents rank one by one; equal scores come by ascending doc_id, null last;
terms and texts are whole however long; extra columns don't matter; empty tables give an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memoria.llm.arrays import numbered, slices_of, text_slices, words_of
from memoria.llm.common import below_share, table, unused, written

#: Terms are runs of ASCII letters and digits and of everything beyond ASCII.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TOP = 10
#: Bytes of items' terms that are broadcast at once; about so many documents give the first thresholds; vectors of a bucket.
BLOCK_BYTES, SEEDS, BUCKET = 8 << 20, 20_000, 2048
SLICE = 1 << 21
#: Bounds are made in doubles: a score this much above one is still taken to be below it.
SLACK = 1 + 1e-9

_INSIDE = np.ones(256, bool)
_INSIDE[[b for b in range(128) if not chr(b).isalnum()]] = False
_LOWERED = np.arange(256, dtype=np.uint8)
_LOWERED[65:91] += 32


def terms_of(text: Column) -> Column:
    return F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TERM), F.lit(0))


def item_blocks(items: DataFrame, text_col: str) -> Iterator[list[tuple[int | None, list[str]]]]:
    """(item_id, different terms) of the items, in lists of about BLOCK_BYTES of terms; a larger item comes alone."""
    rows = items.select(F.col("item_id").cast("bigint"), F.col(text_col).alias("text")).distinct().select("item_id", F.array_distinct(terms_of(F.col("text"))).alias("terms"))
    block, size = [], 0
    for row in rows.filter(F.size("terms") > 0).toLocalIterator():
        more = sum(len(t.encode()) + 8 for t in row["terms"])
        if block and size + more > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((row["item_id"], row["terms"]))
        size += more
    if block:
        yield block


def term_vectors(docs: DataFrame, vocabulary: list[str], text_col: str) -> DataFrame:
    """(doc_id, n, terms, times): the number of all terms of each document, and which of the vocabulary's it has how often."""
    sent = docs.sparkSession.sparkContext.broadcast([t.encode() for t in vocabulary])
    cache: list = []

    @F.arrow_udf("struct<n:bigint,terms:array<int>,times:array<int>>")
    def vectors(texts: pa.Array) -> pa.Array:
        if not cache:
            cache.append(pa.array(sent.value, pa.large_binary()))
        totals, rows, terms, times = [], [], [], []
        for first, raw, offsets in text_slices(texts, SLICE):
            raw = _LOWERED[raw]
            starts, ends, row = words_of(raw, offsets, _INSIDE)
            totals.append(np.bincount(row, minlength=len(offsets) - 1))
            number, distinct = numbered(*slices_of(raw, starts, ends))
            term = pc.index_in(distinct, cache[0]).fill_null(-1).to_numpy(zero_copy_only=False)[number].astype(np.int64)
            own = term >= 0
            pairs, count = np.unique((row[own] + first) * len(cache[0]) + term[own], return_counts=True)
            rows.append(pairs // len(cache[0]))
            terms.append(pairs % len(cache[0]))
            times.append(count)
        flat = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts]).astype(kind)
        ends = pa.array(np.append(0, np.cumsum(np.bincount(flat(rows, np.int64), minlength=len(texts)))).astype(np.int32))
        lists = [pa.ListArray.from_arrays(ends, pa.array(flat(x, np.int32))) for x in (terms, times)]
        return pa.StructArray.from_arrays([pa.array(flat(totals, np.int64)), *lists], names=["n", "terms", "times"])

    (name,) = unused(docs, "_vector")
    df = docs.select(F.col("doc_id").cast("bigint"), vectors(F.col(text_col)).alias(name))
    return df.select("doc_id", *[F.col(name)[c].alias(c) for c in ("n", "terms", "times")])


class Scoring:
    """Weights of the vocabulary, the counts that impacts depend on, items with their thresholds."""

    def __init__(self, vocabulary: list[str], held: dict[int, int], n_docs: int, n_terms: int, items: list[tuple[int | None, list[str]]], top: int):
        number = {t: i for i, t in enumerate(vocabulary)}
        self.weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * held.get(i, 0) + 1))) for i in range(len(vocabulary))], np.int64)
        self.roots = np.sqrt(self.weights.astype(float))
        self.n_docs, self.n_terms, self.top = n_docs, n_terms, top
        self.ids = [i for i, _ in items]
        self.terms = [np.array(sorted(t for x in terms if held.get(t := number[x])), np.int64) for _, terms in items]
        self.lengths = [float(np.sqrt(self.weights[t].sum())) for t in self.terms]
        self.least = np.zeros(len(items), np.int64)

    def impacts(self, n: np.ndarray, times: np.ndarray) -> np.ndarray:
        """By entry, n being that of its document."""
        return 1_000_000_000 * times // (1000 * times + 8 * (10 + 90 * n * self.n_docs // self.n_terms))

    def shortest(self) -> float:
        """Documents whose vectors are shorter can't be among the best of any item."""
        return min((least / (length * SLACK) if length else math.inf for least, length in zip(self.least.tolist(), self.lengths, strict=True)), default=math.inf)


def entries(n: pa.Array, terms: pa.Array, times: pa.Array, scoring: Scoring) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, terms, impacts) of the vectors."""
    offsets = np.append(0, np.cumsum(pc.list_value_length(terms).to_numpy(zero_copy_only=False))).astype(np.int64)
    of_document = np.repeat(n.to_numpy(zero_copy_only=False), np.diff(offsets))
    term, time = (x.flatten().to_numpy(zero_copy_only=False).astype(np.int64) for x in (terms, times))
    return offsets, term, scoring.impacts(of_document, time)


class Bucket:
    """Vectors of about the same length; by term, the documents that have it."""

    def __init__(self, offsets: np.ndarray, terms: np.ndarray, impacts: np.ndarray, scoring: Scoring):
        self.offsets, self.terms, self.impacts = offsets, terms, impacts
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        values = scoring.roots[terms] * impacts
        self.square = np.bincount(row, values * values, len(offsets) - 1)
        self.length = math.sqrt(self.square.max(initial=0.0)) * SLACK
        order = np.argsort(terms, kind="stable")
        self.rows, self.values = row[order], values[order]
        self.held, self.first = np.unique(terms[order], return_index=True)
        self.most = np.maximum.reduceat(self.values, self.first) if len(order) else self.values
        self.first = np.append(self.first, len(order))

    def survivors(self, terms: np.ndarray, scoring: Scoring, least: int) -> np.ndarray:
        """Rows that may score `least` or more for an item of those terms."""
        at = np.searchsorted(self.held, terms)
        own = at < len(self.held)
        own[own] = self.held[at[own]] == terms[own]
        at, roots = at[own], scoring.roots[terms[own]]
        adds = roots * self.most[at] * SLACK
        order = np.argsort(-adds)
        at, roots, adds = at[order], roots[order], adds[order]
        behind = np.append(np.cumsum(adds[::-1])[::-1], 0.0)
        focus = int(np.searchsorted(-behind, -float(least), "right")) if least else len(at)
        if not focus:
            return at[:0]
        places = np.concatenate([np.arange(self.first[k], self.first[k + 1]) for k in at[:focus]])
        root = np.repeat(roots[:focus], self.first[at[:focus] + 1] - self.first[at[:focus]])
        rows, values = self.rows[places], self.values[places]
        sums = np.bincount(rows, root * values, len(self.square))
        seen = np.flatnonzero(sums)
        if focus == len(at):
            return seen[sums[seen] * SLACK >= least]
        left = np.maximum(self.square - np.bincount(rows, values * values, len(self.square)), 0)[seen]
        rest = np.minimum(behind[focus], np.sqrt(left * (roots[focus:] ** 2).sum()))
        return seen[(sums[seen] + rest) * SLACK >= least]

    def exact(self, rows: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Scores of the rows, `weights` being those of an item's terms and 0 elsewhere."""
        size = self.offsets[rows + 1] - self.offsets[rows]
        at = np.repeat(self.offsets[rows] - np.cumsum(size) + size, size) + np.arange(size.sum())
        sums = np.append(0, np.cumsum(weights[self.terms[at]] * self.impacts[at]))
        ends = np.cumsum(size)
        return sums[ends] - sums[ends - size]


def best_of(batches: Iterator[pa.RecordBatch], scoring: Scoring) -> Iterator[pa.RecordBatch]:
    """(item, item_id, doc_id, score): of each item the best documents of those in the batches, which are in descending length."""
    least = scoring.least.copy()
    none = np.zeros(0, np.int64)
    best = [(none, none, none) for _ in scoring.terms]
    weights = np.zeros(len(scoring.weights), np.int64)
    for batch in batches:
        for begin in range(0, batch.num_rows, BUCKET):
            part = batch.slice(begin, BUCKET)
            ids = part.column("doc_id")
            missing, ids = ids.is_null().to_numpy(zero_copy_only=False).astype(np.int64), ids.fill_null(0).to_numpy(zero_copy_only=False)
            bucket = Bucket(*entries(*(part.column(c) for c in ("n", "terms", "times")), scoring), scoring)
            for item, of_item in enumerate(scoring.terms):
                if bucket.length * scoring.lengths[item] < least[item]:
                    continue
                rows = bucket.survivors(of_item, scoring, int(least[item]))
                if not len(rows):
                    continue
                weights[of_item] = scoring.weights[of_item]
                scores = bucket.exact(rows, weights)
                weights[of_item] = 0
                rows, scores = (x[scores >= max(least[item], 1)] for x in (rows, scores))
                if len(rows):
                    both = [np.concatenate(x) for x in zip(best[item], (scores, missing[rows], ids[rows]), strict=True)]
                    order = np.lexsort((both[2], both[1], -both[0]))[: scoring.top]
                    best[item] = tuple(x[order] for x in both)
                    if len(order) == scoring.top:
                        least[item] = max(least[item], best[item][0][-1])
    for item, (scores, missing, ids) in enumerate(best):
        if len(scores):
            yield pa.RecordBatch.from_arrays(
                [pa.array([item] * len(scores), pa.int32()), pa.array([scoring.ids[item]] * len(scores), pa.int64()), pa.array(ids, mask=missing.astype(bool)), pa.array(scores)],
                names=["item", "item_id", "doc_id", "score"],
            )


def ranked_parts(vectors: DataFrame, scoring: Scoring) -> DataFrame:
    """(item, item_id, doc_id, score): the best documents for each item, of each task."""
    sent = vectors.sparkSession.sparkContext.broadcast(scoring)

    @F.arrow_udf("double")
    def length(n: pa.Array, terms: pa.Array, times: pa.Array) -> pa.Array:
        out = [np.zeros(0)]
        for begin in range(0, len(n), BUCKET):
            offsets, term, impacts = entries(*(x.slice(begin, BUCKET) for x in (n, terms, times)), sent.value)
            values = sent.value.roots[term] * impacts
            out.append(np.sqrt(np.bincount(np.repeat(np.arange(len(offsets) - 1), np.diff(offsets)), values * values, len(offsets) - 1)))
        return pa.array(np.concatenate(out))

    df = vectors.withColumn("length", length("n", "terms", "times")).filter(F.col("length") >= scoring.shortest())
    df = df.sortWithinPartitions(F.desc("length")).drop("length")
    return df.mapInArrow(lambda batches: best_of(batches, sent.value), "item int, item_id bigint, doc_id bigint, score bigint")


def best_rows(parts: DataFrame, top: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return parts.withColumn("rank", rank).filter(F.col("rank") <= top)


def ranked_block(docs: DataFrame, items: list[tuple[int | None, list[str]]], top: int, text_col: str) -> DataFrame:
    vocabulary = sorted({t for _, terms in items for t in terms})
    vectors = written(term_vectors(docs, vocabulary, text_col), "term-vectors")
    totals = vectors.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    # As many rows as the vocabulary has terms at most, which BLOCK_BYTES bounds.
    held = {r["term"]: r["held"] for r in vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("held")).toLocalIterator()}
    scoring = Scoring(vocabulary, held, totals["docs"], totals["terms"], items, top)
    if not held:
        return vectors.limit(0).select(F.lit(0).alias("item"), F.lit(0).cast("bigint").alias("item_id"), "doc_id", F.lit(0).cast("bigint").alias("score"), F.lit(1).alias("rank"))
    vectors = vectors.filter(F.size("terms") > 0)
    seeds = vectors.filter(below_share(F.xxhash64("doc_id"), SEEDS / totals["docs"]))
    for row in best_rows(ranked_parts(seeds, scoring), top).filter(F.col("rank") == top).toLocalIterator():
        scoring.least[row["item"]] = row["score"]
    return best_rows(ranked_parts(vectors, scoring), top)


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP, text_col: str = "text", item_col: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` documents of highest score above 0 for each item."""
    found = [ranked_block(docs, block, top, text_col) for block in item_blocks(items, item_col)]
    if not found:
        return docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    return reduce(DataFrame.unionByName, found).select("item_id", "rank", "doc_id", "score")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each item the ten documents of highest score."""
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}') AS terms FROM documents),
total AS (SELECT CAST(count(*) FILTER (len(terms) > 0) AS BIGINT) AS docs, CAST(sum(len(terms)) AS BIGINT) AS terms FROM d),
times AS (SELECT r, doc_id, n, term, count(*) AS tf FROM (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM d) GROUP BY ALL),
weights AS (
    SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
    FROM times, total GROUP BY term),
asked AS (
    SELECT item_id, unnest(list_distinct(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}'))) AS term
    FROM (SELECT DISTINCT item_id, text FROM benchmark)),
scored AS (
    SELECT item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * total.docs) // total.terms)))) AS BIGINT) AS score
    FROM asked JOIN weights USING (term) JOIN times USING (term), total GROUP BY item_id, r, doc_id),
placed AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM placed WHERE rank <= {TOP}
"""
