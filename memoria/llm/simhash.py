"""SimHash near-duplicates by multi-index hashing.

A fingerprint has 64 bits. Two fingerprints within three bits have, in one of their two 32-bit halves, at
most one differing bit; so each distinct fingerprint is put into a table under either half, and looks up the
ball of radius one around each of its halves. Of two values one bit apart exactly one has a 0 there, so only
flips from 0 to 1 are enumerated. What the tables return is verified over all 64 bits.

Copies fall together before any search (one row per distinct fingerprint). A bucket never makes all its
pairs: it gives the links of a spanning forest of its verified links, which joins the same documents. A
bucket above BUCKET_ROWS isn't held in one task but dealt again by segments of the other half: of 3 + k segments two linked
fingerprints share k at least, so each row goes to every choice of k of them; groups that are still too large are dealt
by more segments. At the last level 52 of 64 bits are given, so a group has 4,096 fingerprints at most.
Components come from alternating star contraction, written each round.

Defined cases: a null or blank text has fingerprint zero, linked like any other; a null doc_id counts as the
smallest id and its rows come back as null; repeated rows share a fingerprint, so a component; extra columns
are kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memoria.llm.common import NULL_ID, joined_by_key, shuffle_width, table, unused, written

SHINGLE_WORDS = 3
SEED = 42
MAX_BITS = 3
#: Rows of one bucket that a task compares at once.
BUCKET_ROWS = 4096
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
CHUNK = 1 << 16


def fingerprint(text: str | None) -> int:
    """Bit by bit the majority over the hashes of all word shingles, repeats included."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    if len(words) < SHINGLE_WORDS:
        shingles = [b" ".join(words)]
    else:
        shingles = list(map(b" ".join, zip(*(words[i:] for i in range(SHINGLE_WORDS)), strict=False)))
    set_bits = np.zeros(64, np.int64)
    for at in range(0, len(shingles), CHUNK):
        hashes = np.array([xxhash.xxh64_intdigest(s, SEED) for s in shingles[at : at + CHUNK]], np.uint64)
        set_bits += np.unpackbits(hashes.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > len(shingles)).view(np.uint64)[0])


def _fingerprints(texts: pa.Array) -> pa.Array:
    return pa.array(np.array([fingerprint(t.as_py()) for t in texts], np.uint64).view(np.int64))


def fingerprint_column(text: Column) -> Column:
    """The fingerprint as a signed 64-bit integer."""
    return F.arrow_udf(_fingerprints, "bigint")(text)


def _forest(prints: np.ndarray, is_entry: np.ndarray) -> list[tuple[int, int]]:
    """Links within MAX_BITS between table entries and lookups of one bucket, without those that close a circle."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := parent.setdefault(x, x)) != x:
            parent[x] = parent[up] if up in parent else up
            x = up
        return x

    links = []
    entries = prints[is_entry]
    for at in range(0, len(prints), 1024):
        block = prints[at : at + 1024]
        for to in range(0, len(entries), 4096):
            a, b = np.nonzero(np.bitwise_count(block[:, None] ^ entries[None, to : to + 4096]) <= MAX_BITS)
            for x, y in zip(block[a].tolist(), entries[to : to + 4096][b].tolist(), strict=True):
                if x != y and (p := root(x)) != (q := root(y)):
                    parent[max(p, q)] = min(p, q)
                    links.append((min(x, y), max(x, y)))
    return links


ROW = ["place", "bucket", "segment", "print", "entry"]
FOUND = "a bigint, b bigint, place int, bucket bigint, segment bigint, print bigint, entry boolean"
#: Segments of the other half that large groups are dealt by, level after level: of so many, so many shared.
LEVELS = [(4, 1), (6, 3), (8, 5)]


def _search(limit: int):
    """Groups come sorted. Small ones give links (a, b); rows of larger ones are passed on."""

    def links_of(prints: np.ndarray, entry: np.ndarray) -> pa.RecordBatch | None:
        found = _forest(prints.view(np.uint64), entry)
        if not found:
            return None
        ab = np.array(found, np.uint64).view(np.int64)
        nulls = [pa.nulls(len(ab), t) for t in (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())]
        return pa.RecordBatch.from_arrays([pa.array(ab[:, 0].copy()), pa.array(ab[:, 1].copy()), *nulls], names=["a", "b", *ROW])

    def again(key: tuple, prints: np.ndarray, entry: np.ndarray) -> pa.RecordBatch:
        n = len(prints)
        place, bucket, segment = (pa.array(np.full(n, k, t)) for k, t in zip(key, (np.int32, np.int64, np.int64), strict=True))
        return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), place, bucket, segment, pa.array(prints), pa.array(entry)], names=["a", "b", *ROW])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, large = None, [], False

        def close():
            if key is None or large or not held:
                return None
            prints, entry = (np.concatenate(x) for x in zip(*held, strict=True))
            return links_of(prints, entry) if len(prints) > 1 and entry.any() else None

        for batch in batches:
            if not batch.num_rows:
                continue
            place, bucket, segment, prints = (batch.column(c).to_numpy() for c in ROW[:4])
            entry = batch.column("entry").to_numpy(zero_copy_only=False)
            differs = (bucket[1:] != bucket[:-1]) | (place[1:] != place[:-1]) | (segment[1:] != segment[:-1])
            starts = np.flatnonzero(np.r_[True, differs])
            ends = np.r_[starts[1:], len(bucket)]
            # Groups of one row that lie inside the batch can't link anything.
            real = np.flatnonzero((ends - starts > 1) | (starts == 0) | (ends == len(bucket)))
            for s, e in zip(starts[real].tolist(), ends[real].tolist(), strict=True):
                if (now := (place[s], bucket[s], segment[s])) != key:
                    if (out := close()) is not None:
                        yield out
                    key, held, large = now, [], False
                held.append((prints[s:e].copy(), entry[s:e].copy()))
                if large or sum(len(p) for p, _ in held) > limit:
                    large = True
                    for p, x in held:
                        yield again(key, p, x)
                    held = []
        if (out := close()) is not None:
            yield out

    return run


def _bucket_rows(prints: DataFrame) -> DataFrame:
    """Table entries under both halves, and lookups of the balls around them."""
    p = F.col("print")
    rows = []
    for place in (0, 1):
        half = F.shiftrightunsigned(p, 32) if place == 0 else p.bitwiseAND(F.lit(0xFFFFFFFF))
        near = F.transform(
            F.filter(F.sequence(F.lit(0), F.lit(31)), lambda i: F.expr("1L").bitwiseAND(F.call_function("shiftright", half, i)) == 0),
            lambda i: F.struct(F.lit(place).alias("place"), (half + F.call_function("shiftleft", F.expr("1L"), i)).alias("bucket"), F.lit(False).alias("entry")),
        )
        own = F.array(F.struct(F.lit(place).alias("place"), half.alias("bucket"), F.lit(True).alias("entry")))
        rows.append(F.concat(own, near))
    return prints.select("print", F.inline(F.concat(*rows))).select("place", "bucket", F.lit(0).cast("bigint").alias("segment"), "print", "entry")


def _dealt_again(rows: DataFrame, segments: int, shared: int) -> DataFrame:
    """Rows of large buckets, each under every choice of `shared` of the other half's segments; the bucket stays in the key."""
    other = F.when(F.col("place") == 0, F.col("print").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned("print", 32))
    cuts = [32 * i // segments for i in range(segments + 1)]
    masks = [sum((1 << cuts[i + 1]) - (1 << cuts[i]) for i in chosen) for chosen in combinations(range(segments), shared)]
    keys = F.array(*[other.bitwiseAND(F.lit(m)).cast("bigint") + F.lit(k << 32) for k, m in enumerate(masks)])
    return rows.select("place", "bucket", F.explode(keys).alias("segment"), "print", "entry")


def links(prints: DataFrame, limit: int = BUCKET_ROWS) -> DataFrame:
    """(a, b): enough links within MAX_BITS between distinct fingerprints to join all that are linked."""
    width = shuffle_width(prints.sparkSession)
    rows, parts = _bucket_rows(prints), []
    for level in (None, *LEVELS):
        last = level == LEVELS[-1]
        dealt = rows.repartition(width, *ROW[:3]).sortWithinPartitions(*ROW[:3])
        found = written(dealt.mapInArrow(_search(2**62 if last else limit), FOUND), "simhash-links")
        parts.append(found.filter("a is not null").select("a", "b"))
        large = found.filter("a is null").select("place", "bucket", "print", "entry")
        if last or large.isEmpty():
            break
        rows = _dealt_again(large.distinct(), *LEVELS[0 if level is None else LEVELS.index(level) + 1])
    return reduce(DataFrame.unionByName, parts).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge; root is the smallest node of its component.

    Alternating large-star and small-star contraction; each round is written, so no lineage grows.
    """

    def both_ways(e: DataFrame) -> DataFrame:
        return e.select("a", "b").union(e.select(F.col("b").alias("a"), F.col("a").alias("b")))

    def star(e: DataFrame, large: bool) -> DataFrame:
        around = both_ways(e) if large else e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = around.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        joined = around.join(least, "a")
        moved = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        if not large:
            moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        return moved.filter("a <> b").distinct()

    def state(e: DataFrame):
        return e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()

    edges = written(edges, "components")
    before = state(edges)
    while True:
        edges = written(star(star(edges, large=True), large=False), "components")
        now = state(edges)
        if now == before:
            break
        before = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def near_duplicates(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(doc_id, tag, print, root, component_id) for each row.

    tag is a hash that tells rows of one doc_id apart; root is the least fingerprint of the component, which names it even where
    null or repeated ids make component_id ambiguous.
    """
    doc_id = F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NULL_ID))
    prints = written(docs.select(doc_id.alias("doc_id"), F.xxhash64(text_col).alias("tag"), fingerprint_column(F.col(text_col)).alias("print")), "simhash-prints")
    classes = prints.groupBy("print").agg(F.min("doc_id").alias("first_doc"), F.count(F.lit(1)).alias("rows"))
    return labelled(prints, classes, components(links(classes.select("print"))))


def labelled(prints: DataFrame, classes: DataFrame, found: DataFrame) -> DataFrame:
    """`prints` with root and component_id, from classes (print, first_doc, rows) and components (node, root) of their prints."""
    grouped = classes.join(found, classes["print"] == found["node"]).select("print", "first_doc", "root")
    least = grouped.groupBy("root").agg(F.min("first_doc").alias("component_id"))
    linked = grouped.join(least, "root").select("print", "root", "component_id")
    whole = classes.join(linked, "print", "left").select("print", "rows", F.coalesce("root", "print").alias("root"), F.coalesce("component_id", "first_doc").alias("component_id"))
    return joined_by_key(prints, written(whole, "simhash-classes"), "print", "rows")


def keep_one(docs: DataFrame, text_col: str = "text", mark: Callable[[DataFrame, str], DataFrame] = near_duplicates) -> DataFrame:
    """`docs` with one row of each component that `mark` gives: that of the smallest doc_id (of several, the smallest tag).

    Only ids and tags are joined to the chosen ones; of rows that share both, a second pass drops all but one.
    """
    id_, tag = unused(docs, "_id", "_tag")
    marked = mark(docs, text_col)
    chosen = marked.groupBy("root").agg(F.min(F.struct("doc_id", "tag")).alias("c")).select(F.col("c.doc_id").alias(id_), F.col("c.tag").alias(tag))
    keyed = docs.withColumns({id_: F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NULL_ID)), tag: F.xxhash64(text_col)})
    return keyed.join(chosen, [id_, tag], "left_semi").dropDuplicates([id_, tag]).drop(id_, tag)


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its fingerprint in hex and its component's smallest doc_id."""
    marked = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    plain = lambda c: F.when(F.col(c) == NULL_ID, None).otherwise(F.col(c)).alias(c)
    return marked.select(plain("doc_id"), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), plain("component_id"))
