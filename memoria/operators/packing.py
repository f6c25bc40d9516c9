"""Blocks of words, made in the task that holds their documents and kept packed, on the way to their folders and in them.

A range's blocks of one folder are one row with three small Arrow tables, compressed: the range's documents, its words with what bounds their part of a score, and the places of
the words' documents, block after block. A posting so takes about two bytes instead of fifty.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memoria.sources.shipping import ship_package

#: Folders of words; one more has the block of no word, which lists all documents of a range.
PARTS, ALL, NO_WORD = 64, 64, ""
#: A range is closed at so many bytes of words, too.
RANGE_BYTES = 64 << 20
NONE = -(2**62)
TABLES = ("docs", "words", "places")
PACKED = "part int, range bigint, docs binary, words binary, places binary"
BOUNDS = "term string, n bigint, most bigint, shortest bigint, top_rank bigint"


def part_of(term: Column) -> Column:
    return F.when(term == NO_WORD, ALL).otherwise(F.crc32(term.cast("binary")) % PARTS).cast("int")


def docs_type(id_type: str) -> str:
    return f"array<struct<doc_id: {id_type}, tf: bigint, length: bigint, rank: bigint>>"


def _parts(terms: pa.Array) -> np.ndarray:
    """`part_of` of terms that are words."""
    raw = terms.cast(pa.binary()).to_numpy(zero_copy_only=False)
    return np.fromiter(map(zlib.crc32, raw), np.int64, len(raw)) % PARTS


def _small(values: np.ndarray) -> pa.Array:
    return pa.array(values.astype(np.min_scalar_type(int(values.max()))))


def _written(columns: dict[str, pa.Array]) -> bytes:
    batch, sink = pa.RecordBatch.from_pydict(columns), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _read(packed: pa.Scalar, *columns: str) -> list[pa.Array]:
    with pa.ipc.open_stream(packed.as_buffer()) as source:
        batch = source.read_next_batch()
    return [batch.column(c) for c in columns]


def _blocks(terms: pa.Array, starts: np.ndarray, doc: np.ndarray, tf: np.ndarray, length: np.ndarray, rank: np.ndarray) -> list[bytes]:
    """The tables of words and places: block i has the documents doc[starts[i]:starts[i + 1]]; length and rank are those of all documents of the range."""
    begin, top = starts[:-1], np.maximum.reduceat(rank[doc], starts[:-1])
    bounds = {"n": _small(np.diff(starts)), "most": _small(np.maximum.reduceat(tf, begin)), "shortest": _small(np.minimum.reduceat(length[doc], begin)), "top_rank": pa.array(top, mask=top == NONE)}
    return [_written({"term": terms} | bounds), _written({"doc": _small(doc), "tf": _small(tf)})]


def _ranked(rank: pa.Array) -> np.ndarray:
    return rank.cast(pa.int64()).fill_null(NONE).to_numpy(zero_copy_only=False)


def _rows(parts: list[int], number: int, docs: bytes, blocks: list[list[bytes]]) -> pa.RecordBatch:
    tables = [pa.array(c, pa.binary()) for c in ([docs] * len(parts), *zip(*blocks, strict=True))]
    return pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([number] * len(parts), pa.int64()), *tables], names=["part", "range", *TABLES])


def _packed(docs: pa.Table, number: int) -> pa.RecordBatch:
    """The rows of docs(doc_id, rank, words) as the range `number`."""
    n, words, (ids, rank) = len(docs), docs.column("words").combine_chunks(), (docs.column(c).combine_chunks() for c in ("doc_id", "rank"))
    length = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    named = words.flatten().dictionary_encode()
    # Terms are numbered in the order of their folders and themselves, so that sorted numbers of term and document are the blocks one by one.
    part = _parts(named.dictionary)
    order = pc.sort_indices(pa.table({"part": part, "term": named.dictionary}), [("part", "ascending"), ("term", "ascending")])
    at = order.to_numpy()
    terms, part, place = named.dictionary.take(order), part[at], np.empty(len(at), np.int64)
    place[at] = np.arange(len(at))
    pairs, tf = np.unique(place[named.indices.to_numpy()] * n + np.repeat(np.arange(n), length), return_counts=True)
    of, doc = np.divmod(pairs, n)
    starts, cuts, levels = np.searchsorted(of, np.arange(len(terms) + 1)), np.searchsorted(part, np.arange(PARTS + 1)), _ranked(rank)
    parts, blocks = [ALL], [_blocks(pa.array([NO_WORD]), np.array([0, n]), np.arange(n), np.zeros(n, np.int64), length, levels)]
    for p in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
        borders = starts[cuts[p] : cuts[p + 1] + 1]
        own = slice(borders[0], borders[-1])
        parts.append(p)
        blocks.append(_blocks(terms.slice(cuts[p], len(borders) - 1), borders - borders[0], doc[own], tf[own], length, levels))
    return _rows(parts, number, _written({"doc_id": ids, "rank": rank, "length": _small(length)}), blocks)


def packed(docs: DataFrame, per_range: int) -> DataFrame:
    """The packed blocks of docs(doc_id, rank, words) in ranges of about `per_range` documents of one task, which come out the same whenever its rows come in the same order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, held = TaskContext.get().partitionId() << 32, []

        def ranges() -> Iterator[pa.RecordBatch]:
            nonlocal number
            table, pieces = pa.Table.from_batches(held), max(1, round(sum(len(b) for b in held) / per_range), sum(b.nbytes for b in held) // RANGE_BYTES)
            borders = np.linspace(0, len(table), min(pieces, len(table)) + 1).astype(int).tolist()
            for begin, end in zip(borders[:-1], borders[1:], strict=True):
                yield _packed(table.slice(begin, end - begin), number)
                number += 1
            held.clear()

        for batch in batches:
            if len(batch):
                held.append(batch)
            if held and (sum(len(b) for b in held) >= per_range or sum(b.nbytes for b in held) >= RANGE_BYTES):
                yield from ranges()
        if held:
            yield from ranges()

    ship_package(docs.sparkSession)
    return docs.select("doc_id", "rank", "words").mapInArrow(run, PACKED)


def merged(rows: DataFrame) -> DataFrame:
    """Packed blocks of rows(part, range, old, dead, docs, words, places) with one row for each part and range, without the documents whose ids are in `dead`; `old` orders what becomes one."""

    def run(own: pa.Table) -> pa.Table:
        own = own.sort_by("old")
        ids, ranks, lengths, terms, sizes, doc, tf, first = [], [], [], [], [], [], [], 0
        for i in range(len(own)):
            value = {c: own.column(c)[i] for c in ("dead", *TABLES)}
            (doc_id, rank, length), (term, n), (at, times) = _read(value["docs"], "doc_id", "rank", "length"), _read(value["words"], "term", "n"), _read(value["places"], "doc", "tf")
            alive = ~pc.is_in(doc_id, value["dead"].values.cast(doc_id.type)).to_numpy(zero_copy_only=False) if value["dead"].is_valid else np.ones(len(doc_id), bool)
            at, kept = at.to_numpy().astype(np.int64), pa.array(alive)
            here = alive[at]
            ids, ranks, lengths = [*ids, doc_id.filter(kept)], [*ranks, rank.filter(kept)], [*lengths, length.to_numpy().astype(np.int64)[alive]]
            doc.append((np.cumsum(alive) - 1)[at[here]] + first)
            tf.append(times.to_numpy().astype(np.int64)[here])
            terms.append(term)
            sizes.append(np.bincount(np.repeat(np.arange(len(term)), n.to_numpy())[here], minlength=len(term)))
            first += int(alive.sum())
        doc, tf, length, rank = np.concatenate(doc), np.concatenate(tf), np.concatenate(lengths), pa.concat_arrays(ranks)
        if not len(doc):
            return pa.Table.from_batches([], pa.schema(empty))
        named = pa.concat_arrays(terms).dictionary_encode()
        order = pc.sort_indices(named.dictionary)
        place = np.empty(len(order), np.int64)
        place[order.to_numpy()] = np.arange(len(order))
        of = np.repeat(place[named.indices.to_numpy()], np.concatenate(sizes))
        sort = np.lexsort((doc, of))
        there, starts = np.unique(of[sort], return_index=True)
        blocks = _blocks(named.dictionary.take(order).take(pa.array(there)), np.append(starts, len(of)), doc[sort], tf[sort], length, _ranked(rank))
        return pa.Table.from_batches([_rows([own.column("part")[0].as_py()], own.column("range")[0].as_py(), _written({"doc_id": pa.concat_arrays(ids), "rank": rank, "length": _small(length)}), [blocks])])

    empty = [("part", pa.int32()), ("range", pa.int64()), *((c, pa.binary()) for c in TABLES)]
    ship_package(rows.sparkSession)
    return rows.groupBy("part", "range").applyInArrow(run, PACKED)


def _unpacked(kept: list[str], columns: Callable[[dict, pa.Array, pa.Array], dict]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                value = {c: batch.column(c)[i] for c in batch.schema.names}
                names = ["term", "n", "most", "shortest", "top_rank"]
                words = dict(zip(names, _read(value["words"], *names), strict=True))
                # Blocks of other words than those asked for are not unpacked.
                at = pa.array(np.flatnonzero(pc.is_in(words["term"], value["asked"].values).to_numpy(zero_copy_only=False)) if "asked" in value else np.arange(len(words["term"])))
                if len(at):
                    more = columns(value, words["n"], at)
                    numbers = {c: words[c].take(at).cast(pa.int64()) for c in names[1:]}
                    yield pa.RecordBatch.from_pydict({c: pa.array([value[c].as_py()] * len(at), batch.column(c).type) for c in kept} | {"term": words["term"].take(at)} | numbers | more)

    return run


def bounds(rows: DataFrame) -> DataFrame:
    """(segment, part, range, term, n, most, shortest, top_rank) of the blocks in rows(segment, part, range, words[, asked]), all or those of the words in `asked`."""
    kept = ["segment", "part", "range"]
    ship_package(rows.sparkSession)
    return rows.select(*kept, "words", *(["asked"] if "asked" in rows.columns else [])).mapInArrow(_unpacked(kept, lambda value, n, at: {}), f"segment string, part int, range bigint, {BOUNDS}")


def unpacked(rows: DataFrame, id_type: str) -> DataFrame:
    """The same with docs, the documents of each block."""

    def docs(value: dict, n: pa.Array, at: pa.Array) -> dict:
        (ids, rank, length), (doc, tf) = _read(value["docs"], "doc_id", "rank", "length"), _read(value["places"], "doc", "tf")
        sizes, ends = n.take(at).to_numpy().astype(np.int64), np.cumsum(n.to_numpy().astype(np.int64))[at.to_numpy()]
        offsets = np.append(0, np.cumsum(sizes))
        own = pa.array(np.arange(offsets[-1]) + np.repeat(ends - sizes - offsets[:-1], sizes))
        doc = doc.take(own)
        each = [ids.take(doc), *(a.cast(pa.int64()) for a in (tf.take(own), length.take(doc), rank.take(doc)))]
        return {"docs": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(each, names=["doc_id", "tf", "length", "rank"]))}

    kept = ["segment", "part", "range"]
    ship_package(rows.sparkSession)
    own = rows.select(*kept, *TABLES, *(["asked"] if "asked" in rows.columns else []))
    return own.mapInArrow(_unpacked(kept, docs), f"segment string, part int, range bigint, {BOUNDS}, docs {docs_type(id_type)}")
