"""Near-duplicates by the Jaccard similarity of five-word shingles: SimHash and multi-index hashing find pairs, whole shingle sets decide.

Each distinct set of shingles is one class, so copies fall together before any search. A class has a fingerprint of
192 bits or more, each the majority over its shingles' hashes, in segments of `bits` bits; there is one table for each segment. A class
is put into a table under its own segment and under those one bit away at the WEAK places whose majorities are closest, where the fingerprint of
a similar set differs most likely; so the balls of two classes meet up to two bits apart. What shares a bucket is compared over
FILTER_WORDS words. Two sets of similarity 0.8 are within a cosine of 0.89, an angle of 27 degrees, 0.15 of the bits; TABLES has as many segments as let no such pair
of any size be missed more than 7 times in a million by simulated odds; segments grow with the rows, so that a bucket's chance members don't.

Of what is close in a bucket, few classes give their pairs and many a group. Both are verified over the whole sets, in
integers, which gives the links of a spanning forest of the verified links, which joins the same classes. Groups that have classes in common
are one group, where that is small or takes no more than they do apart, so that each set is sent once; of the others, those with the same members are searched
once. One with more than BLOCK_HASHES hashes is cut into blocks, each two of which are compared in a group of their own.

Defined cases: words are parted by blanks, ASCII letters in lower case; a text of fewer than five words is one shingle; null and
blank texts are one class; null and repeated ids are as in `simhash`; extra columns are kept, whatever their names; texts are whole however long, their shingle sets being
single values; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memoria.llm.common import NULL_ID, joined_by_key, perhaps_in, shuffle_width, written
from memoria.llm.simhash import LOWER, components, labelled

SHINGLE_WORDS = 5
#: Bits of a segment: number of tables for sets of any size, and for those of SMALL shingles at most, whose majorities are often ties.
TABLES = {8: (8, 10), 10: (11, 16), 12: (15, 24), 14: (21, 36), 16: (29, 56), 18: (40, 86), 20: (56, 130), 22: (77, 192), 24: (108, 288)}
SMALL = 20
#: Places of a segment whose bit is flipped in lookups.
WEAK = 3
#: Rows of the input for each value of a segment.
LOAD = 64
#: Words of the fingerprint that members of a bucket are compared over, and the bits that may differ in them: of two larger sets, and where one is of SMALL shingles at most.
FILTER_WORDS, FILTER_BITS = 3, (57, 62)
#: Different sets of fewer shingles are less similar than 0.8.
LEAST = 4
#: Close members of a bucket up to this many give pairs, more a group.
PAIRED = 8
#: Rows of a bucket that are compared all at once.
AT_ONCE = 1024
#: Classes times hashes of groups that are joined in any case.
JOINED_WORK = 1 << 30
#: Hashes of one block of a group.
BLOCK_HASHES = 1 << 20
#: Shingles that a byte counts.
CHUNK = 255
#: Bits of a key behind table and segment: five for the place that was flipped (NONE: none), the others for the set's size.
TAIL, SIZE, NONE = 24, (1 << 19) - 1, 31
_WORDS = max(-(-bits * most // 64) for bits, (_, most) in TABLES.items())
_SALT, _ODD, _ODD2 = np.random.default_rng(42).integers(0, 2**64, (3, _WORDS), np.uint64, endpoint=False) | np.uint64(1)
MARKS = "doc_id bigint, tag bigint, print bigint, size bigint, sketch binary"
ENTRIES = "key bigint, print bigint, " + ", ".join(f"w{i} bigint" for i in range(FILTER_WORDS))


def shingle_set(text: str | None) -> np.ndarray:
    """The distinct hashes of all word shingles, in order."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return np.zeros(0, np.uint64)
    n = min(SHINGLE_WORDS, len(words))
    shingles = set(map(b" ".join, zip(*(words[i:] for i in range(n)), strict=False)))
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, shingles), np.uint64, len(shingles)))


def segment_bits(rows: int) -> int:
    return next((bits for bits in TABLES if LOAD << bits >= rows), max(TABLES))


def fingerprint_words(bits: int, tables: int) -> int:
    return max(FILTER_WORDS, -(-bits * tables // 64))


def majorities(hashes: np.ndarray, words: int) -> np.ndarray:
    """Of each fingerprint bit, how many more of the hashes have it set than not."""
    ones = np.zeros(64 * words, np.int64)
    for at in range(0, len(hashes), CHUNK):
        x = (hashes[at : at + CHUNK, None] ^ _SALT[:words]) * _ODD[:words]
        x ^= x >> np.uint64(32)
        x *= _ODD2[:words]
        x ^= x >> np.uint64(29)
        ones += np.unpackbits(x.view(np.uint8), axis=1).sum(0, dtype=np.uint8)
    return 2 * ones - len(hashes)


def sketch(hashes: np.ndarray, bits: int) -> bytes:
    """The fingerprint's bytes, then each segment's weak places."""
    tables = TABLES[bits][len(hashes) <= SMALL]
    over = majorities(hashes, fingerprint_words(bits, tables))
    weak = np.argsort(np.abs(over[: bits * tables]).reshape(tables, bits), axis=1, kind="stable")[:, :WEAK]
    return np.packbits(over > 0).tobytes() + weak.astype(np.uint8).tobytes()


def segment_keys(sketches: np.ndarray, sizes: np.ndarray, bits: int, tables: int) -> np.ndarray:
    """For each sketch its keys: table, value of the segment, the place that was flipped and the size (SIZE at most)."""
    n, words = len(sketches), fingerprint_words(bits, tables)
    set_ = np.unpackbits(sketches[:, : 8 * words], axis=1)[:, : bits * tables].reshape(n, tables, bits)
    value = set_ @ (np.int64(1) << np.arange(bits))
    weak = sketches[:, 8 * words :].reshape(n, tables, WEAK).astype(np.int64)
    values = np.concatenate([value[:, :, None], value[:, :, None] ^ (1 << weak)], axis=2)
    places = np.concatenate([np.full((n, tables, 1), NONE), weak], axis=2)
    tail = places * (SIZE + 1) + np.minimum(sizes, SIZE)[:, None, None]
    keys = (((np.arange(tables)[None, :, None] << 24) | values) << TAIL) | tail
    return keys.reshape(n, -1)


def _signed(rows: list) -> pa.Array:
    return pa.array([np.array(r, np.uint64).view(np.int64) for r in rows], pa.list_(pa.int64()))


def _marks(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Class, number of shingles and sketch of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, sizes, sketches = [], [], []
            for text in batch.column("text"):
                hashes = shingle_set(text.as_py())
                prints.append(xxhash.xxh64_intdigest(hashes.tobytes()))
                sizes.append(len(hashes))
                sketches.append(sketch(hashes, bits))
            columns = [batch.column("doc_id"), batch.column("tag"), pa.array(np.array(prints, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "tag", "print", "size", "sketch"])

    return run


def _entries(bits: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Each class under all its keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, sizes = (batch.column(c).to_numpy() for c in ("print", "size"))
            sketches = batch.column("sketch").to_numpy(zero_copy_only=False)
            for tables, which in zip(TABLES[bits], (sizes > SMALL, sizes <= SMALL), strict=True):
                chosen = np.flatnonzero(which)
                for at in range(0, len(chosen), 256):
                    some = chosen[at : at + 256]
                    bytes_ = np.frombuffer(b"".join(sketches[some]), np.uint8).reshape(len(some), -1)
                    keys = segment_keys(bytes_, sizes[some], bits, tables)
                    words = bytes_[:, : 8 * FILTER_WORDS].copy().view(np.int64)
                    times = keys.shape[1]
                    columns = [pa.array(c) for c in (keys.ravel(), np.repeat(prints[some], times), *np.repeat(words, times, axis=0).T.copy())]
                    yield pa.RecordBatch.from_arrays(columns, names=["key", "print", *(f"w{i}" for i in range(FILTER_WORDS))])

    return run


class Bucket:
    """Classes under one value of a segment, by place."""

    def __init__(self, keys: np.ndarray, words: np.ndarray):
        place = (keys & ((1 << TAIL) - 1)) // (SIZE + 1)
        self.entry = place == NONE
        self.own = (keys >> TAIL) ^ np.where(self.entry, 0, 1 << place)
        self.sizes, self.words = keys & SIZE, words

    def close(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which of `a` (rows) and `b` (columns) are close and of like size; those of one own value meet under it alone."""
        differ = np.bitwise_count(self.words[0][a][:, None] ^ self.words[0][b])
        for w in self.words[1:]:
            differ += np.bitwise_count(w[a][:, None] ^ w[b])
        near = differ <= max(FILTER_BITS)
        x, y = np.nonzero(near)
        i, j = a[x], b[y]
        least, most = np.minimum(self.sizes[i], self.sizes[j]), np.maximum(self.sizes[i], self.sizes[j])
        alike = (differ[x, y] <= np.where(least > SMALL, *FILTER_BITS)) & (5 * least >= 4 * most)
        near[x, y] = alike & ((self.own[i] != self.own[j]) | (self.entry[i] & self.entry[j]))
        return near


def close_groups(keys: np.ndarray, prints: np.ndarray, words: np.ndarray) -> list[np.ndarray]:
    """Pairs or groups of one bucket's classes that are joined by closeness."""
    bucket = Bucket(keys, words)
    everything = np.arange(len(keys))
    if len(keys) <= AT_ONCE:
        near = bucket.close(everything, everything)
        np.fill_diagonal(near, False)
        left = np.flatnonzero(near.any(1))
    else:
        near, left = None, everything
    groups = []
    while len(left):
        joined, left = [left[0]], left[1:]
        for x in joined:
            if not len(left):
                break
            hit = near[x, left] if near is not None else bucket.close(np.array([x]), left)[0]
            joined += left[hit].tolist()
            left = left[~hit]
        if len(joined) == 1:
            continue
        members = np.array(joined)
        if len(members) > PAIRED:
            groups.append(np.sort(prints[members]))
        else:
            a, b = np.nonzero(np.triu(bucket.close(members, members), 1))
            groups += [np.sort(prints[[x, y]]) for x, y in zip(members[a].tolist(), members[b].tolist(), strict=True)]
    return groups


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entries come sorted by key; gives the members of groups, each under a hash of all of them."""
    held, bucket = [], None

    def close(parts: list[np.ndarray]) -> list[np.ndarray]:
        table = np.concatenate(parts, axis=1)
        return close_groups(table[0], table[1], table[2:].view(np.uint64)) if table.shape[1] > 1 else []

    def out(groups: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if groups:
            names = np.array([xxhash.xxh64_intdigest(g.tobytes()) for g in groups], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(names, [len(g) for g in groups])), pa.array(np.concatenate(groups))], names=["key", "print"])

    for batch in batches:
        if not batch.num_rows:
            continue
        table = np.stack([c.to_numpy() for c in batch.columns])
        buckets = table[0] >> TAIL
        starts = np.flatnonzero(np.r_[True, buckets[1:] != buckets[:-1]])
        groups = []
        for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(buckets)], strict=True):
            if buckets[s] != bucket:
                if held:
                    groups += close(held)
                held, bucket = [], buckets[s]
            held.append(table[:, s:e])
        held = [h.copy() for h in held]
        yield from out(groups)
    if held:
        yield from out(close(held))


def _sets(texts: pa.Array) -> pa.Array:
    return _signed([shingle_set(t.as_py()) for t in texts])


def forest(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links (by place) between sets of similarity 0.8 or more, without those that close a circle."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    ends = np.cumsum(sizes)
    starts = ends - sizes
    values, ids = np.unique(np.concatenate(sets), return_inverse=True)
    # What shares most comes first: it joins most of the others at once, and joined ones aren't compared any more.
    order = np.argsort(-np.add.reduceat(np.bincount(ids)[ids], starts) / sizes, kind="stable")
    part, left = np.arange(n), np.ones(n, bool)
    has = np.zeros(len(values), bool)
    links = []
    for x in order.tolist():
        left[x] = False
        to = np.flatnonzero(left & (part != part[x]) & (5 * np.minimum(sizes, sizes[x]) >= 4 * np.maximum(sizes, sizes[x])))
        if not len(to):
            continue
        mine = ids[starts[x] : ends[x]]
        has[mine] = True
        if len(to) > n // 8 + 1:
            both = np.add.reduceat(has[ids], starts, dtype=np.int64)[to]
        else:
            both = np.array([np.count_nonzero(has[ids[starts[y] : ends[y]]]) for y in to.tolist()])
        has[mine] = False
        near = to[9 * both >= 4 * (sizes[x] + sizes[to])]
        if len(near):
            parts, first = np.unique(part[near], return_index=True)
            links += [(x, y) for y in near[first].tolist()]
            part[np.isin(part, parts)] = part[x]
    return links


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Groups come sorted by key, low, high."""
    key, prints, sets = None, [], []

    def close() -> Iterator[pa.RecordBatch]:
        if len(prints) > 1 and (found := forest(sets)):
            a, b = np.array(prints, np.int64)[np.array(found)].T
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    for batch in batches:
        group = list(zip(*(batch.column(c).to_pylist() for c in ("key", "low", "high", "print")), strict=True))
        column = batch.column("hashes")
        for i, (*now, print_) in enumerate(group):
            if now != key:
                yield from close()
                key, prints, sets = now, [], []
            prints.append(print_)
            sets.append(column[i].values.to_numpy(zero_copy_only=False).view(np.uint64).copy())
    yield from close()


def candidates(classes: DataFrame, bits: int) -> DataFrame:
    """(key, print): groups of classes that share a bucket and are close there; `classes` are (print, size, sketch)."""
    width = shuffle_width(classes.sparkSession)
    entries = classes.filter(F.col("size") >= LEAST).select("print", "size", "sketch").mapInArrow(_entries(bits), ENTRIES)
    dealt = entries.repartition(width, F.shiftright("key", TAIL)).sortWithinPartitions("key")
    return dealt.mapInArrow(_candidates, "key bigint, print bigint").distinct()


def joined_groups(members: DataFrame, classes: DataFrame, block: int = BLOCK_HASHES, limit: int = JOINED_WORK) -> DataFrame:
    """(key, print): groups that have classes in common as one group, if it is one block of `limit` work at most or neither its work nor the hashes sent exceed theirs; the others as in `members`."""
    sizes = classes.select("print", "size")
    total, n = F.sum("size").alias("total"), F.count(F.lit(1)).alias("times")
    work = F.col("times") * F.col("total")
    sent = F.col("total") * F.greatest(F.lit(1), F.ceil(F.col("total") / F.lit(block)) - 1)
    groups = members.join(sizes, "print").groupBy("key").agg(F.min("print").alias("a"), total, n)
    edges = members.join(groups.select("key", "a"), "key").filter(F.col("print") > F.col("a")).select("a", F.col("print").alias("b")).distinct()
    found = components(edges).withColumnRenamed("node", "print")
    apart = groups.withColumnRenamed("a", "print").join(found, "print").groupBy("root").agg(F.sum(work).alias("works"), F.sum(sent).alias("sents"))
    joins = (F.col("total") <= block) & (work <= limit) | (work <= F.col("works")) & (sent <= F.col("sents"))
    roots = written(found.join(sizes, "print").groupBy("root").agg(total, n).join(apart, "root").select("root", "times", joins.alias("joins")), "jaccard-roots")
    joined = joined_by_key(found, roots, "root").filter("joins").select("print", "root")
    return members.join(joined, "print", "left").select(F.coalesce("root", "key").alias("key"), "print").distinct()


def links(classes: DataFrame, texts: DataFrame, bits: int, block: int = BLOCK_HASHES) -> DataFrame:
    """(a, b): enough links between classes to join all that are linked.

    `classes` are (print, doc_id, tag, size, sketch), the text of each being that of the row of `texts` (doc_id, tag, text).
    """
    spark = classes.sparkSession
    found = written(candidates(classes, bits), "jaccard-members")
    members = written(joined_groups(found, classes, block), "jaccard-groups").join(classes.select("print", "doc_id", "tag", "size"), "print")
    totals = members.groupBy("key").agg(F.sum("size").alias("total"))
    large = totals.filter(F.col("total") > block).select("key", F.ceil(F.col("total") / F.lit(block)).cast("int").alias("blocks"))
    members = members.join(large, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))

    wanted = written(members.select("doc_id", "tag").distinct(), "jaccard-wanted")
    chosen = perhaps_in(texts, wanted).join(wanted, ["doc_id", "tag"]).dropDuplicates(["doc_id", "tag"])
    sets = chosen.select("doc_id", "tag", F.arrow_udf(_sets, "array<bigint>")("text").alias("hashes"))
    own = F.pmod(F.xxhash64("print"), F.col("blocks")).cast("int")
    others = F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("blocks") - 1), F.col("own")))
    dealt = members.withColumn("own", own).withColumn("other", F.explode(others))
    dealt = dealt.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "print", "doc_id", "tag").join(sets, ["doc_id", "tag"])
    groups = dealt.repartition(shuffle_width(spark), "key", "low", "high").sortWithinPartitions("key", "low", "high")
    return groups.select("key", "low", "high", "print", "hashes").mapInArrow(_linked, "a bigint, b bigint").distinct()


def near_duplicates(docs: DataFrame, text_col: str = "text", block: int = BLOCK_HASHES) -> DataFrame:
    """(doc_id, tag, print, root, component_id) for each row, as `simhash.near_duplicates`; print is the hash of the shingle set."""
    texts = docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NULL_ID)).alias("doc_id"), F.xxhash64(text_col).alias("tag"), F.col(text_col).alias("text"))
    bits = segment_bits(texts.count())
    marked = written(texts.mapInArrow(_marks(bits), MARKS), "jaccard-marks")
    least = marked.groupBy("print").agg(F.min(F.struct("doc_id", "tag")).alias("c"), F.first("size").alias("size"), F.first("sketch").alias("sketch"), F.count(F.lit(1)).alias("rows"))
    classes = written(least.select("print", "c.doc_id", "c.tag", "size", "sketch", "rows"), "jaccard-classes")
    found = components(links(classes, texts, bits, block))
    return labelled(marked.select("doc_id", "tag", "print"), classes.select("print", F.col("doc_id").alias("first_doc"), "rows"), found)
