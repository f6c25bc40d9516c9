"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier in numpy over hashed words and word beginnings is trained from confirmed toxic documents and unlabelled text.
The risk of the unseen negatives is the unlabelled risk less the positives' share of it (class prior times the
positives' risk as negatives); where that difference falls below zero, which only overfitting can cause,
its gradient is turned round. With the logistic loss the score estimates the probability of label 1.

The fit uses bounded samples of rows (about MAX_POSITIVE and MAX_UNLABELLED, and MAX_PAIRS of row and feature together), chosen by a hash of
the row; each with all features of its whole text. The class prior is counted over all labelled rows of the fold. Scores cover every whole text.

Defined cases: a null text counts as empty and gets the model's bias; a null doc_id is in the learning fold; a
document with several labels is toxic if one says so; null labels are ignored; without positives every score is 0;
extra columns are kept; repeated rows get the same score; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memoria.llm.arrays import text_slices
from memoria.llm.common import below_share, table, written

FOLDS, HELD_FOLD = 4, 2
THRESHOLD = 0.3
#: Bounds of the samples that the classifier is fitted on.
MAX_POSITIVE, MAX_UNLABELLED, MAX_PAIRS = 4_000, 12_000, 8_000_000
BITS = 20
#: Pairs whose values are added up at once.
PART = 1 << 18
#: Besides whole words, their beginnings of so many bytes: inflected forms share them.
BEGINNINGS = (3, 4, 5, 6, 7)
#: A feature of one sampled document alone gets no weight.
MIN_DOCS = 2
STEPS, RATE = 250, 0.08
#: A weight stays zero unless its word's pull on the risk exceeds chance: so many standard errors of a word's
#: share (at WORD_SHARE) among the positives, and LEAST_PULL in any case.
ERRORS, WORD_SHARE, LEAST_PULL = 3.0, 0.1, 0.002

LETTER = np.array([65 <= b <= 90 or 97 <= b <= 122 or b >= 128 for b in range(256)])
_random = np.random.default_rng(20240101)
#: A random 64-bit value for each (lower-cased) byte and an odd factor for each place in a word.
BYTE_VALUE = _random.integers(1, 2**63, 256, dtype=np.uint64)
BYTE_VALUE[65:91] = BYTE_VALUE[97:123]
PLACE_FACTOR = _random.integers(1, 2**62, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
MIX = np.uint64(0x9E3779B97F4A7C15)


def word_features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of the distinct words (letters only, ASCII case folded) and word beginnings of each row, sorted."""
    letter = LETTER[raw]
    at = np.flatnonzero(letter)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    row = np.searchsorted(offsets, at, "right") - 1
    first = np.r_[True, (at[1:] != at[:-1] + 1) | (row[1:] != row[:-1])]
    starts = np.flatnonzero(first)
    lengths = np.diff(np.r_[starts, len(at)])
    place = np.arange(len(at)) - np.repeat(starts, lengths)
    sums = np.cumsum(BYTE_VALUE[raw[at]] * PLACE_FACTOR[np.minimum(place, 63)], dtype=np.uint64)
    before = np.where(starts > 0, sums[starts - 1], np.uint64(0))
    found = [_pairs(row[starts], sums[starts + lengths - 1] - before, 0)]
    for n in BEGINNINGS:
        long = lengths > n
        found.append(_pairs(row[starts][long], sums[starts[long] + n - 1] - before[long], n))
    pairs = np.unique(np.concatenate(found))
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def _pairs(row: np.ndarray, value: np.ndarray, kind: int) -> np.ndarray:
    """Row and hashed feature in one integer, each once for each row."""
    value = (value + np.uint64(kind)) * MIX
    feature = ((value ^ (value >> np.uint64(29))) * MIX) >> np.uint64(64 - BITS)
    return (row << BITS) | feature.astype(np.int64)


def _features(texts: pa.Array) -> pa.Array:
    features, cuts, total = [np.zeros(0, np.int32)], [np.zeros(1, np.int64)], 0
    for _, raw, offsets in text_slices(texts):
        row, feature = word_features(raw, offsets)
        features.append(feature.astype(np.int32))
        cuts.append(total + np.searchsorted(row, np.arange(1, len(offsets)), "left"))
        total += len(feature)
    return pa.ListArray.from_arrays(pa.array(np.concatenate(cuts).astype(np.int32)), pa.array(np.concatenate(features)))


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def least_pull(prior: float, n_positive: int) -> float:
    return max(LEAST_PULL, ERRORS * prior * np.sqrt(WORD_SHARE / max(n_positive, 1)))


class Pairs:
    """Pairs of row and column, sorted either way, so that sums by row and by column are sums of runs; made in parts to hold little."""

    def __init__(self, sizes: np.ndarray, column: np.ndarray, n_columns: int):
        """`column` has the columns of the rows one after the other, `sizes` how many each row has."""
        self.column = column
        self.by_row = self._sums(column, sizes)
        row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)
        self.by_column = self._sums(row[np.argsort(column, kind="stable").astype(np.int32)], np.bincount(column, minlength=n_columns))

    @staticmethod
    def _sums(index: np.ndarray, sizes: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
        runs, ends = np.flatnonzero(sizes), np.cumsum(sizes)
        starts = (ends - sizes)[runs]
        cuts = np.unique(np.searchsorted(starts, np.arange(0, len(index), PART)))
        parts = list(zip(cuts, [*cuts[1:], len(runs)], strict=True))

        def sums(values: np.ndarray) -> np.ndarray:
            out = np.zeros(len(sizes))
            for a, b in parts:
                first = starts[a]
                out[runs[a:b]] = np.add.reduceat(values[index[first : ends[runs[b - 1]]]], starts[a:b] - first)
            return out

        return sums


def risk_gradient(p: np.ndarray, is_p: np.ndarray, prior: float) -> np.ndarray:
    """Gradient of the non-negative risk (logistic loss) in each row's score, at probabilities p; turned round where the negatives' risk is below zero."""
    n_p, n_u = int(is_p.sum()), int((~is_p).sum())
    as_negative = -np.log1p(-np.minimum(p, 1 - 1e-12))
    negative_risk = as_negative[~is_p].mean() - prior * as_negative[is_p].mean()
    # Positives as positive, then all as negative.
    plus = np.where(is_p, prior / n_p * (p - 1), 0)
    minus = np.where(is_p, -prior / n_p * p, p / n_u)
    return plus + minus if negative_risk >= 0 else -minus


def fit_nnpu(features: np.ndarray, sizes: np.ndarray, is_p: np.ndarray, prior: float) -> tuple[np.ndarray, float]:
    """(weights by feature, bias) of the classifier with the least non-negative risk, few weights being non-zero; Adam over the whole sample.

    `features` has those of the rows one after the other, `sizes` how many each row has, `is_p` which rows are positive.
    """
    n_p = int(is_p.sum())
    names = np.flatnonzero(np.bincount(features, minlength=1 << BITS) >= MIN_DOCS)
    number = np.full(1 << BITS, -1, np.int32)
    number[names] = np.arange(len(names), dtype=np.int32)
    column = number[features]
    row = np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)[column >= 0]
    pairs = Pairs(np.bincount(row, minlength=len(sizes)), column[column >= 0], len(names))
    del column, row

    w, b = np.zeros(len(names)), np.log(prior / (1 - prior))
    pull = least_pull(prior, n_p)
    m, v = np.zeros(len(names) + 1), np.zeros(len(names) + 1)
    for step in range(1, STEPS + 1):
        g = risk_gradient(logistic(pairs.by_row(w) + b), is_p, prior)
        gradient = np.r_[pairs.by_column(g), g.sum()]
        m = 0.9 * m + 0.1 * gradient
        v = 0.999 * v + 0.001 * gradient**2
        pace = RATE / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        move = pace * m / (1 - 0.9**step)
        w, b = w - move[:-1], b - move[-1]
        w = np.sign(w) * np.maximum(np.abs(w) - pull * pace[:-1], 0)
    weights = np.zeros(1 << BITS, np.float32)
    weights[names] = w
    return weights, float(b)


def fold_of(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS


def _sampled(df: DataFrame, n: int, most: int, *by: str) -> DataFrame:
    """About `most` of `n` rows, chosen by hash; all if there are no more."""
    return df.filter(below_share(F.xxhash64(*by, F.lit("sample")), min(1.0, most / max(n, 1))))


def train(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> tuple[np.ndarray, float] | None:
    """The model from the learning fold, or None without positives."""
    fold = fold_of(F.col("doc_id")) != HELD_FOLD
    marked = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull()).filter(fold).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    n_marked, n_toxic = marked.agg(F.count(F.lit(1)), F.count_if(F.col("toxic") == 1)).first()
    if not n_toxic:
        return None
    own = docs.filter(fold).select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    toxic = _sampled(marked.filter("toxic = 1").select("doc_id"), n_toxic, MAX_POSITIVE, "doc_id")
    # Bounded by MAX_POSITIVE and the spread of the hash over different ids, so it may be broadcast.
    positive = own.join(F.broadcast(toxic), "doc_id").select(F.lit(True).alias("is_p"), "text")
    unlabelled = _sampled(own, own.count(), MAX_UNLABELLED, "doc_id", "text").select(F.lit(False).alias("is_p"), "text")
    features = F.arrow_udf(_features, "array<int>")
    sample = written(positive.unionByName(unlabelled).select("is_p", features("text").alias("features")), "toxicity-sample")
    # Long texts, or rows that share id and text and so were all chosen, can make the sample large: then some of its rows are taken.
    total = sample.agg(F.sum(F.size("features").cast("bigint") + 1)).first()[0] or 0
    if total > MAX_PAIRS:
        sample = sample.filter(below_share(F.xxhash64(F.monotonically_increasing_id()), MAX_PAIRS / total))
    rows = sample.toArrow().combine_chunks()
    is_p, lists = rows["is_p"].to_numpy(), rows["features"].combine_chunks()
    if is_p.all() or not is_p.any():
        return None
    sizes = np.diff(lists.offsets.to_numpy())
    return fit_nnpu(lists.flatten().to_numpy(), sizes, is_p, min(max(n_toxic / n_marked, 1e-3), 0.9))


def score_column(spark: SparkSession, model: tuple[np.ndarray, float] | None, text: Column) -> Column:
    if model is None:
        return F.lit(0.0)
    sent = spark.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        weights, bias = sent.value
        parts = [np.zeros(0)]
        for _, raw, offsets in text_slices(texts):
            row, feature = word_features(raw, offsets)
            parts.append(np.bincount(row, weights[feature], minlength=len(offsets) - 1) + bias)
        return pa.array(logistic(np.concatenate(parts)))

    return score(text)


def score_toxicity(docs: DataFrame, labels: DataFrame, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """`docs` with the probability of toxicity in column `out`."""
    return docs.withColumn(out, score_column(docs.sparkSession, train(docs, labels, text_col), F.col(text_col)))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: whether its label was withheld, score, and the decision at THRESHOLD."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    df = score_toxicity(docs, table(spark, sf_dir, "labels"), out="score")
    held = fold_of(F.col("doc_id")) == HELD_FOLD
    return df.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
