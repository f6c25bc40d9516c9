"""Periodic runs of words: stretches that repeat a period of words several times over.

Sparse diagonal dynamic programming. A word equal to the one `lag` words before it adds one to the match length of the diagonal
`lag`; a diagonal that a word doesn't continue ends there, and gives a run if it was long enough. Taking every earlier
occurrence of every word would give a frequent word as many events as the square of its number, so events are kept sparse: a run of at least
four periods has, for a power of two `g` between 1.5 and 3 periods, blocks of `g` words that recur one period
later, and of each block only the nearest earlier occurrence counts. (A block recurring at a shorter lag
too would have both periods, and so a smaller one, by the theorem of Fine and Wilf; recurrences at longer lags in that range are multiples of
the nearest.) So a word has one event at most for each power of two, and the work is in proportion to n log n, however often words recur. Blocks are
named by doubling: the name of 2g words is the pair of the names of their halves, and only what occurs twice in a text goes on to the next power.
The events of many texts are taken together, in order of their words; each diagonal's match length is the count of its successive events.

Defined cases: a null or empty text has no words, no runs and an empty collapsed text; extra columns are kept, those named as the
results replaced; repeated rows get the same results; words are whole however long; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memoria.llm.arrays import numbered, slices_of, text_slices, words_of
from memoria.llm.common import table, unused

#: Words are what blanks (space, tab to carriage return) part.
WORDS = re.compile(r"[^\x20\x09-\x0D]+")
#: A run has this many words and this many times its period at least; fewer than four times can't be found by blocks.
MIN_LENGTH, MIN_TIMES = 6, 4
RUN = "struct<start:bigint,length:bigint,period:bigint>"
#: Bytes of texts taken together; a longer text comes alone.
SLICE = 1 << 21

_INSIDE = np.ones(256, bool)
_INSIDE[[0x20, *range(0x09, 0x0E)]] = False


def recurring(names: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the places `at` (ascending), whose names stand beside them: those whose name occurs twice, a number for each name, and the lag to its nearest earlier occurrence (0: none)."""
    order = np.argsort(names, kind="stable")
    ranked, place = names[order], at[order]
    same = ranked[1:] == ranked[:-1]
    again, before = np.zeros(len(at), bool), np.zeros(len(at), np.int64)
    again[1:] = same
    again[:-1] |= same
    before[1:] = np.where(same, place[1:] - place[:-1], 0)
    number = np.zeros(len(at), np.int64)
    number[1:] = np.cumsum(~same)
    back = np.empty(len(at), np.int64)
    back[order] = np.arange(len(at))
    back = back[again[back]]
    return place[back], number[back], before[back]


def runs_of(ids: np.ndarray, rows: np.ndarray, min_length: int = MIN_LENGTH, min_times: int = MIN_TIMES) -> np.ndarray:
    """(start, length, period) of every run in the words `ids` of the texts `rows`, by start, then period; starts are places in `ids`."""
    if min_times < 4:
        raise ValueError("runs of fewer than four periods may hold no block of 1.5 periods or more that recurs")
    found = []
    # A name stands for words of one text; so blocks over the border of two texts occur once.
    at, names, lags = recurring(rows.astype(np.int64) << 32 | ids, np.arange(len(ids)))
    block = 1
    while len(at):
        event = (3 * lags > block) & (3 * lags <= 2 * block)
        if event.any():
            place, lag = at[event], lags[event]
            # A diagonal goes on where the next word has an event of the same lag, and ends with its last one.
            new = np.ones(len(place) + 1, bool)
            new[1:-1] = (place[1:] != place[:-1] + 1) | (lag[1:] != lag[:-1])
            begins, ends = np.flatnonzero(new[:-1]), np.flatnonzero(new[1:])
            period = lag[begins]
            length = place[ends] + block - place[begins] + period
            enough = length >= np.maximum(min_length, min_times * period)
            found.append(np.stack([place[begins] - period, length, period], 1)[enough])
        # Names of blocks of twice the words: both halves occur twice.
        half = np.searchsorted(at, at + block)
        both = half < len(at)
        both[both] = at[half[both]] == at[both] + block
        at, names, lags = recurring(names[both] * (int(names.max()) + 1) + names[half[both]], at[both])
        block *= 2
    out = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def dropped(n: int, runs: np.ndarray) -> np.ndarray:
    """Which of n words stand in a run behind its first period."""
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, runs[:, 0] + runs[:, 2], 1)
    np.add.at(edge, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(edge[:-1]) > 0


def searched(raw: np.ndarray, offsets: np.ndarray, min_length: int, min_times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the texts in `raw`: runs (start in words of the text), runs of each text, bytes of the collapsed texts, their offsets."""
    starts, ends, rows = words_of(raw, offsets, _INSIDE)
    ids, _ = numbered(*slices_of(raw, starts, ends))
    runs = runs_of(ids, rows, min_length, min_times)
    kept = ~dropped(len(ids), runs)
    text, _ = slices_of(raw, starts[kept], ends[kept], b" ")
    size = np.bincount(rows[kept], ends[kept] - starts[kept] + 1, minlength=len(offsets) - 1).astype(np.int64)
    # The blank behind a text's last word isn't part of it.
    stay = np.ones(len(text), bool)
    stay[np.cumsum(size)[size > 0] - 1] = False
    borders = np.zeros(len(offsets), np.int64)
    np.cumsum(np.maximum(size - 1, 0), out=borders[1:])
    of = rows[runs[:, 0]]
    runs[:, 0] -= np.searchsorted(rows, of)
    return runs, np.bincount(of, minlength=len(offsets) - 1), text[stay], borders


def runs_column(text: Column, min_length: int = MIN_LENGTH, min_times: int = MIN_TIMES) -> Column:
    """runs (by start, then period) and the text without their repeats, its words joined by one blank."""

    @F.arrow_udf(f"struct<runs:array<{RUN}>,collapsed:string>")
    def search(texts: pa.Array) -> pa.Array:
        runs, counts, data, sizes = [np.zeros((0, 3), np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint8)], [np.zeros(0, np.int64)]
        for _, raw, offsets in text_slices(texts, SLICE):
            own, count, joined, borders = searched(raw, offsets, min_length, min_times)
            runs.append(own)
            counts.append(count)
            data.append(joined)
            sizes.append(np.diff(borders))
        starts, lengths, periods = (pa.array(x) for x in np.concatenate(runs).T.copy())
        fields = pa.StructArray.from_arrays([starts, lengths, periods], names=["start", "length", "period"])
        ends = lambda sizes: pa.array(np.concatenate([[0], np.cumsum(np.concatenate(sizes))]).astype(np.int32))
        collapsed = pa.StringArray.from_buffers(len(texts), ends(sizes).buffers()[1], pa.py_buffer(np.concatenate(data)))
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(ends(counts), fields), collapsed], names=["runs", "collapsed"])

    return search(text)


def with_runs(docs: DataFrame, text_col: str = "text", min_length: int = MIN_LENGTH, min_times: int = MIN_TIMES) -> DataFrame:
    """`docs` with runs (start and length in words, period) and collapsed, the text without what repeats a run's first period."""
    (name,) = unused(docs, "_runs")
    df = docs.drop("runs", "collapsed").withColumn(name, runs_column(F.col(text_col), min_length, min_times))
    return df.withColumns({c: F.col(name)[c] for c in ("runs", "collapsed")}).drop(name)


def turned(text: str, g: int) -> str:
    """The text from whose word a = g % n on the first p words repeat over and over, p being part of what is left."""
    words = WORDS.findall(text)
    n = len(words)
    if not n:
        return ""
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return " ".join(words[:a] + [words[a + i % p] for i in range(n - a)])


def looped(doc_id: Column, text: Column) -> Column:
    """The text that op11_runs searches: a tenth of the documents, by a hash of doc_id (null: of the empty text), are turned into loops."""

    @F.arrow_udf("string")
    def loop(hashes: pa.Array, texts: pa.Array) -> pa.Array:
        return pa.array((turned(t, h // 10) if t and h % 10 == 0 else t for h, t in zip(hashes.to_pylist(), (x.as_py() for x in texts))), pa.string(), size=len(texts))

    return loop(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), text)


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: number of runs, the longest one, digests of all runs and of the collapsed text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    df = with_runs(docs.select("doc_id", looped(F.col("doc_id"), F.col("text")).alias("text"))).drop("text")
    best = F.get(F.array_sort(F.transform("runs", lambda r: F.struct((-r["length"]).alias("a"), r["start"].alias("start"), r["period"].alias("period")))), F.lit(0))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return df.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        "best.start",
        (-F.col("best.a")).alias("length"),
        "best.period",
        F.floor(-1000 * F.col("best.a") / F.col("best.period")).cast("bigint").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
