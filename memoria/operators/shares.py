"""How much of each question's words one document has."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memoria.sources.shipping import ship_package

#: Bytes of questions' words that are sent to the tasks at once.
BLOCK_BYTES = 16 << 20


def _blocks(questions: DataFrame, key: str) -> Iterator[list]:
    block, size = [], 0
    for row in questions.filter(F.size("words") > 0).select(key, "words").toLocalIterator():
        more = sum(len(w) + 16 for w in row["words"])
        if block and size + more > BLOCK_BYTES:
            yield block
            block, size = [], 0
        block.append((row[key], row["words"]))
        size += more
    if block:
        yield block


def _best(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        questions = sent.value
        asked = defaultdict(list)
        for i, (_, words) in enumerate(questions):
            for w in words:
                asked[w].append(i)
        places = {w: np.array(own, np.int64) for w, own in asked.items()}
        size = np.array([len(words) for _, words in questions])
        best = np.zeros(len(questions), np.int64)
        for batch in batches:
            for words in batch.column("words"):
                own = [places[w] for w in words.as_py() or () if w in places]
                if own:
                    np.maximum(best, np.bincount(np.concatenate(own), minlength=len(questions)), out=best)
        hit = np.flatnonzero(best)
        yield pa.RecordBatch.from_arrays([pa.array([questions[i][0] for i in hit], pa.int64()), pa.array(best[hit] / size[hit])], names=["key", "share"])

    return run


def best_shares(docs: DataFrame, questions: DataFrame, key: str) -> DataFrame:
    """(key, best): of questions(key, words) the largest share of its different words that one of docs(words) has, rounded; none has no row.

    Questions go to the tasks in blocks of BLOCK_BYTES, and each task gives one row a question, so no pairs of question and document are made. Words are
    given once in each array; a key that several questions share takes the largest share of any.
    """
    ship_package(docs.sparkSession)
    parts = [docs.select("words").mapInArrow(_best(docs.sparkSession.sparkContext.broadcast(block)), "key bigint, share double") for block in _blocks(questions, key)]
    if not parts:
        return questions.select(key, F.lit(0.0).alias("best")).limit(0)
    return reduce(DataFrame.unionByName, parts).groupBy("key").agg(F.round(F.max("share"), 6).alias("best")).withColumnRenamed("key", key)
