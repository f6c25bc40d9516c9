"""Similarity of vectors and top-k search in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memoria.sources.shared import written
from memoria.sources.shipping import ship_package

#: Bytes of the vectors of a block: at 1,000 dimensions 128 of them.
BLOCK_BYTES = 1 << 20
#: Blocks of queries up to this size together are broadcast; more of them are dealt, with the vectors, to LANES lanes.
BROADCAST_BYTES, LANES = 64 << 20, 64
NONE = -(2**62)


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Null where a vector is zero."""
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def _unit(vectors: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0)


def matrix(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(places of the vectors of `size` numbers, those vectors); null ones, ones of another length and ones with null numbers are left out."""
    column = column.cast(pa.large_list(pa.float64()))
    values = column.flatten()
    sizes = np.asarray(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False), np.int64)
    right = (sizes == size) & np.asarray(column.is_valid())
    flat = values.to_numpy(zero_copy_only=False)[np.repeat(right, sizes)].reshape(-1, size) if size else np.zeros((int(right.sum()), 0))
    whole = ~np.isnan(flat).any(1)
    return np.flatnonzero(right)[whole], flat[whole]


def best_of(score: np.ndarray, ids: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the `keep` largest finite scores of each row, of equal ones those with the smallest ids."""
    keep = min(keep, score.shape[1])
    if not keep:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = np.partition(score, score.shape[1] - keep, axis=1)[:, score.shape[1] - keep]
    row, column = np.nonzero((score >= least[:, None]) & np.isfinite(score))
    order = np.lexsort((ids[column], -score[row, column], row))
    row, column = row[order], column[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < keep], column[place < keep]


PARTS = ("ids", "tags", "levels", "data")
BLOCK = "cell int, size int, ids binary, tags binary, levels binary, data binary"


def packed(rows: DataFrame) -> DataFrame:
    """rows(cell, id, tag, level, vector) in blocks of one cell and one length of vectors, as arrays of numbers and unit vectors.

    Null vectors and those with null numbers are left out; a null level is below every other. Blocks hold at most about BLOCK_BYTES.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = [batch.column(c).cast(pa.int64()).fill_null(NONE).to_numpy(zero_copy_only=False) for c in ("id", "tag", "level")]
            cells, out = batch.column("cell").to_numpy(zero_copy_only=False), []
            sizes = pc.fill_null(pc.list_value_length(batch.column("vector")), 0).to_numpy(zero_copy_only=False)
            for size in np.unique(sizes[sizes > 0]).tolist():
                at, data = matrix(batch.column("vector"), size)
                order = np.argsort(cells[at], kind="stable")
                at, data, most = at[order], _unit(data[order]), max(1, BLOCK_BYTES // (8 * size))
                own = cells[at]
                borders = np.flatnonzero(np.append(True, own[1:] != own[:-1])).tolist() + [len(own)] if len(own) else [0]
                for begin, end in zip(borders[:-1], borders[1:], strict=True):
                    for i in range(begin, end, most):
                        rows_ = slice(i, min(i + most, end))
                        out.append((int(own[i]), size, *(x[at[rows_]].tobytes() for x in numbers), data[rows_].tobytes()))
            if out:
                columns = list(zip(*out, strict=True))
                arrays = [pa.array(c, pa.int32()) for c in columns[:2]] + [pa.array(c, pa.binary()) for c in columns[2:]]
                yield pa.RecordBatch.from_arrays(arrays, names=["cell", "size", *PARTS])

    ship_package(rows.sparkSession)
    return rows.mapInArrow(pack, BLOCK)


FOUND = "asked bigint, query_id bigint, id bigint, score double"


def best_pairs(pairs: DataFrame, keep: int, ranked: bool) -> DataFrame:
    """(asked, query_id, id, score): of each pair of a block of queries (columns named q_...) and one of vectors the `keep` closest vectors of each query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                value = lambda c, kind=np.int64, i=i: np.frombuffer(batch.column(c)[i].as_buffer(), kind)
                size, ids = batch.column("size")[i].as_py(), value("ids")
                score = np.round(value("q_data", np.float64).reshape(-1, size) @ value("data", np.float64).reshape(-1, size).T, 6)
                score[:, ids == NONE] = -np.inf
                if ranked:
                    score[value("levels")[None, :] < value("q_levels")[:, None]] = -np.inf
                q, hit = best_of(score, ids, keep)
                yield pa.RecordBatch.from_arrays([pa.array(value("q_tags")[q]), pa.array(value("q_ids")[q]), pa.array(ids[hit]), pa.array(score[q, hit])], names=["asked", "query_id", "id", "score"])

    return pairs.select("size", *[f"q_{c}" for c in PARTS], *PARTS).mapInArrow(run, FOUND)


def as_queries(blocks: DataFrame) -> DataFrame:
    return blocks.withColumnsRenamed({c: f"q_{c}" for c in PARTS})


def nearest(vectors: DataFrame, queries: DataFrame, keep: int) -> DataFrame:
    """The `keep` rows of vectors(id, vector[, rank]) closest to each of queries(query_id, vector[, least_rank][, ...]), with the queries' other columns,
    id, score and place.

    Queries and vectors are packed in blocks, which meet in one pass over the vectors: the queries' blocks are broadcast if they are measured to be small, or else both
    sides are dealt to lanes. Each pair of blocks gives its own best rows, so what is shuffled then is a few rows for each query. A query with least_rank sees only
    rows of at least that rank. Null vectors, those of another length and those without an id match nothing.
    """
    others = [c for c in queries.columns if c not in ("query_id", "vector", "least_rank")]
    ranked = "least_rank" in queries.columns
    numbered = queries.filter("query_id is not null and vector is not null").select(F.xxhash64("query_id", *(["least_rank"] if ranked else []), *others).alias("asked"), "*")
    zero, level = F.lit(0).alias("cell"), lambda given, c: (F.col(c).cast("bigint") if given else F.lit(None).cast("bigint")).alias("level")
    few = numbered.repartition(1 + numbered.count() // 10_000)
    mine = written(packed(few.select(zero, F.col("query_id").alias("id"), F.col("asked").alias("tag"), level(ranked, "least_rank"), "vector")), "query-blocks")
    theirs = packed(vectors.filter("id is not null").select(zero, "id", F.lit(0).alias("tag"), level("rank" in vectors.columns, "rank"), "vector"))
    if (mine.agg(F.sum(F.octet_length("data").cast("bigint"))).first()[0] or 0) <= BROADCAST_BYTES:
        pairs = theirs.drop("cell").join(F.broadcast(as_queries(mine.drop("cell"))), "size")
    else:
        lane = F.pmod(F.xxhash64("data"), F.lit(LANES)).cast("int")
        lanes = F.explode(F.sequence(F.lit(0), F.lit(LANES - 1)))
        pairs = theirs.withColumn("cell", lane).join(as_queries(mine.withColumn("cell", lanes)), ["cell", "size"])
    found = best_pairs(pairs, keep, ranked)
    order = Window.partitionBy("asked").orderBy(F.desc("score"), "id")
    placed = found.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= keep)
    if others:
        placed = placed.join(numbered.select("asked", *others), "asked")
    return placed.select(*others, "query_id", "id", "score", "place")
