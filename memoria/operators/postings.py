"""A saved index over words: postings in blocks, with what a block can add to a score at most.

Documents that lie in one task make ranges of about RANGE documents; a block has the documents of one range that have one word. Blocks lie in
folders by segment and by the hash of the word, so a search reads the folders of its own words alone; the block of no word, in a folder of its own, has all documents of its range. Blocks
are made where the texts lie and packed (`packing`), so that neither texts nor a row a posting cross the network or are stored. Each block keeps the largest number of times its word
occurs in one of its documents and the shortest document's length, which bound the word's part of a score whatever the mean length comes to be, so
documents can be added without writing anything anew.

A search sums these bounds by range. The ranges that promise most are scored first and give the k-th best score so far; of the others only those
whose bound reaches it are read.

Documents that change or go are not cut out of their blocks: a row says that they are dead in their segment, and searches leave them out of scores, counts
and lengths, so ranks equal those of an index made anew. Bounds then stand a little high, which only costs reading. `compact` merges
segments of like size, and those with many dead documents, into new ones without these; `vacuum` deletes what no search reads any more.

What is added, replaced, removed or merged at once counts from the row in `segments` on, which is written last: what a lost driver left behind is never read. There
is one writer at a time, any number of searches beside it. Documents that are added have ids that differ; those with a null id are left out.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from math import log

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memoria.functions.text import tokens
from memoria.operators.lexical import B, K1
from memoria.operators.packing import ALL, NO_WORD, PARTS, TABLES, bounds, merged, packed, part_of, unpacked
from memoria.sources.shared import delete_folder, exists, folders, written

RANGE, GROUP = 2048, 64
#: Ranges of each query that are scored first.
FIRST = 2
#: Words asked for, up to so many bytes together, are broadcast.
ASKED_BYTES = 16 << 20
#: Scores are rounded to six digits, bounds are not.
SLACK = 1e-5
#: So many segments of like size (within this factor) are merged, and any of which one document in DEAD is dead.
FAN, DEAD = 4, 4
#: `replaces` are segments that this one stands for, `docs` and `words` count what it was written with, `batch` names the stream's batch it came by.
SEGMENTS = "segment string, docs bigint, words bigint, replaces array<string>, batch string"


@dataclass
class State:
    """What an index holds at a moment: its live segments, which no other replaces (`compact` bounds their number), and the names of all finished ones."""

    live: list[Row]
    done: list[str]

    @property
    def names(self) -> list[str]:
        return [r["segment"] for r in self.live]


def new_segment() -> str:
    return f"s{uuid.uuid4().hex}"  # never to be read as a number


@dataclass
class Postings:
    spark: SparkSession
    path: str

    def __post_init__(self) -> None:
        if exists(self.spark, f"{self.path}/documents"):
            raise ValueError(f"{self.path} was written when documents lay beside the blocks; it must be made anew")

    def add(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text", per_range: int = RANGE) -> None:
        """Adds documents (with their `rank`, if they have one) that the index doesn't have, as a segment of their own."""
        segment = new_segment()
        self._write(segment, docs, doc_id, text, per_range)
        self._commit(segment)

    def replace(self, docs: DataFrame, gone: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", per_range: int = RANGE, batch: str | None = None) -> None:
        """Puts documents in place of those of the same ids, new ones too, and takes out those of gone(doc_id); all of it counts at once.

        Of rows with one id that with the last text (then rank) by order counts. An id that is in both stays. With the name of a batch that has been put in before, nothing happens.
        """
        if batch is not None and not self.segments().filter(F.col("batch") == batch).isEmpty():
            return
        state, segment = self.state(), new_segment()
        self._write(segment, docs, doc_id, text, per_range)
        ids = self._listed(segment).select("doc_id")
        # Only where an id came twice are texts held against each other, and the segment made again.
        if not ids.groupBy("doc_id").count().filter("count > 1").isEmpty():
            delete_folder(self.spark, f"{self.path}/blocks/segment={segment}")
            ranked = ["rank"] if "rank" in docs.columns else []
            one = docs.filter(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(F.struct(F.col(text).alias("text"), *ranked)).alias("v"))
            segment = new_segment()
            self._write(segment, one.select("doc_id", "v.*"), "doc_id", "text", per_range)
            ids = self._listed(segment).select("doc_id")
        if gone is not None:
            ids = ids.unionByName(gone.select(F.col("doc_id").cast(self._id_type())).filter("doc_id is not null")).distinct()
        if state.live:
            dead = self.documents(state).join(ids, "doc_id", "left_semi").withColumn("by", F.lit(segment))
            dead.write.partitionBy("by").mode("append").parquet(f"{self.path}/dead")
        self._commit(segment, batch=batch)

    def remove(self, gone: DataFrame) -> None:
        """Takes out the documents of gone(doc_id)."""
        self.replace(gone.select("doc_id", F.lit("").alias("text")).limit(0), gone)

    def compact(self, per_range: int = RANGE) -> int:
        """Merges segments of like size where there are FAN of them, and those with many dead documents; gives the number of segments merged.

        Every document is so rewritten a number of times that grows with the logarithm of their number.
        """
        state = self.state()
        dead = {r["segment"]: r["n"] for r in self._dead(state).groupBy("segment").agg(F.count(F.lit(1)).alias("n")).collect()}
        tiers: dict[int, list[str]] = {}
        for r in state.live:
            tiers.setdefault(int(log(max(r["docs"] - dead.get(r["segment"], 0), 1), FAN)), []).append(r["segment"])
        old = {s for own in tiers.values() if len(own) >= FAN for s in own} | {r["segment"] for r in state.live if dead.get(r["segment"], 0) * DEAD >= max(r["docs"], 1)}
        if not old:
            return 0
        segment = new_segment()
        left = {r["segment"]: r["docs"] - dead.get(r["segment"], 0) for r in state.live if r["segment"] in old}
        # Segments of which no document is left are replaced without being read.
        if held := [s for s, n in left.items() if n]:
            # Ranges become one as long as they have `per_range` documents together; a row a range is ordered at once.
            listed = self._alive(self._listed(*held), state).groupBy("segment", "range").agg(F.count(F.lit(1)).alias("n"))
            so_far = F.sum("n").over(Window.orderBy("segment", "range"))
            new = listed.select("segment", "range", F.floor((so_far - 1) / per_range).cast("bigint").alias("new"))
            gone = self._dead(state).groupBy("segment", "range").agg(F.collect_list("doc_id").alias("dead"))
            rows = self._stored(held).join(F.broadcast(new), ["segment", "range"]).join(gone, ["segment", "range"], "left")
            old_range = F.struct("segment", "range").alias("old")
            self._store(segment, merged(rows.select("part", F.col("new").alias("range"), old_range, "dead", *TABLES)), sum(left.values()) // per_range + 1)
        self._commit(segment, replaces=sorted(old))
        return len(old)

    def vacuum(self) -> None:
        """Deletes what belongs to segments that others replace or that were never finished. Nothing may write or search beside it."""
        state = self.state()
        told = [r["by"] for r in self._dead(state, "by").select("by").distinct().collect()]
        for kind, key, kept in (("blocks", "segment", state.names), ("dead", "by", told)):
            for name in folders(self.spark, f"{self.path}/{kind}"):
                if name.startswith(f"{key}=") and name.removeprefix(f"{key}=") not in kept:
                    delete_folder(self.spark, f"{self.path}/{kind}/{name}")

    def segments(self) -> DataFrame:
        return self._rows("segments", SEGMENTS)

    def state(self) -> State:
        rows = self.segments().collect()
        replaced = {s for r in rows for s in r["replaces"]}
        return State([r for r in rows if r["segment"] not in replaced], [r["segment"] for r in rows])

    def documents(self, state: State | None = None) -> DataFrame:
        """(doc_id, length, range, segment) of the documents that the index has."""
        state = state or self.state()
        return self._alive(self._listed(*state.names), state)

    def blocks(self, state: State | None = None, parts: list[int] | None = None) -> DataFrame:
        """The blocks of live segments, all or those in some folders of words; dead documents are still in them."""
        return unpacked(self._stored((state or self.state()).names, parts), self._id_type())

    def own_blocks(self, asked: DataFrame, state: State | None = None) -> DataFrame:
        """The blocks that have one of the words of asked(term), read from the folders of these words alone."""
        return unpacked(self._own_rows(asked, state or self.state()), self._id_type())

    def _own_rows(self, asked: DataFrame, state: State) -> DataFrame:
        words = asked.filter(F.col("term") != NO_WORD).select("term", part_of(F.col("term")).alias("part")).distinct()
        sizes = {r["part"]: r["bytes"] for r in words.groupBy("part").agg(F.sum(F.octet_length("term") + 8).alias("bytes")).collect()}  # PARTS at most
        lists = words.groupBy("part").agg(F.collect_list("term").alias("asked"))
        return self._stored(state.names, list(sizes)).join(F.broadcast(lists) if sum(sizes.values()) <= ASKED_BYTES else lists, "part")

    def _stored(self, segments: list[str], parts: list[int] | None = None) -> DataFrame:
        """The rows of packed blocks of segments, all or those in some folders."""
        rows = self._rows("blocks", f"range bigint, {', '.join(f'{t} binary' for t in TABLES)}, segment string, part int")
        rows = rows if parts is None else rows.filter(F.col("part").isin(parts))
        return rows.filter(F.col("segment").isin(*segments))

    def _listed(self, *segments: str) -> DataFrame:
        """(doc_id, length, range, segment) of all documents that segments were written with."""
        return unpacked(self._stored(list(segments), [ALL]), self._id_type()).select("range", "segment", F.inline("docs")).select("doc_id", "length", "range", "segment")

    def _rows(self, kind: str, schema: str) -> DataFrame:
        path = f"{self.path}/{kind}"
        return self.spark.read.schema(schema).parquet(path) if exists(self.spark, path) else self.spark.createDataFrame([], schema)

    def _id_type(self) -> str:
        """The type of ids, which the first documents settle."""
        path = f"{self.path}/shape"
        return self.spark.read.parquet(path).schema["doc_id"].dataType.simpleString() if exists(self.spark, path) else "bigint"

    def _dead(self, state: State, *more: str) -> DataFrame:
        """(segment, range, doc_id, length): documents of live segments that are replaced or gone."""
        rows = self._rows("dead", f"doc_id {self._id_type()}, length bigint, range bigint, segment string, by string")
        return rows.filter(F.col("by").isin(*state.done) & F.col("segment").isin(*state.names)).select("segment", "range", "doc_id", "length", *more)

    def _alive(self, rows: DataFrame, state: State) -> DataFrame:
        """rows(segment, range, doc_id, ...) without the dead ones."""
        return rows.join(self._dead(state).drop("length"), ["segment", "range", "doc_id"], "left_anti")

    def _write(self, segment: str, docs: DataFrame, doc_id: str, text: str, per_range: int) -> None:
        own = docs.filter(F.col(doc_id).isNotNull())
        if not exists(self.spark, f"{self.path}/shape"):
            own.select(F.col(doc_id).alias("doc_id")).limit(0).write.parquet(f"{self.path}/shape")
        kind, ranges = self._id_type(), own.count() // per_range + 1
        rank = F.col("rank").cast("bigint") if "rank" in own.columns else F.lit(None).cast("bigint")
        named = own.select(F.col(doc_id).cast(kind).alias("doc_id"), rank.alias("rank"), F.col(text).alias("text"))
        # Few documents go to few tasks; in a task they are sorted, so that one that is run again makes the same ranges.
        lying = named.coalesce(ranges).sortWithinPartitions("doc_id").select("doc_id", "rank", tokens(F.col("text")).alias("words"))
        self._store(segment, packed(lying, per_range), ranges)

    def _store(self, segment: str, rows: DataFrame, ranges: int) -> None:
        """Writes packed blocks; a folder is dealt to about one file for GROUP ranges."""
        groups = ranges // GROUP + 1
        dealt = rows.repartition(min(ranges, PARTS) * groups, "part", F.pmod(F.xxhash64("range"), F.lit(groups))).sortWithinPartitions("part", "range")
        dealt.withColumn("segment", F.lit(segment)).write.partitionBy("segment", "part").mode("append").parquet(f"{self.path}/blocks")

    def _commit(self, segment: str, replaces: list[str] | None = None, batch: str | None = None) -> None:
        counts = self._listed(segment).agg(F.count(F.lit(1)).alias("docs"), F.coalesce(F.sum("length"), F.lit(0)).alias("words")).first()
        row = (segment, counts["docs"], counts["words"], replaces or [], batch)
        self.spark.createDataFrame([row], SEGMENTS).coalesce(1).write.mode("append").parquet(f"{self.path}/segments")

    def search(self, asked: DataFrame, keep: int) -> DataFrame:
        """(query_id, doc_id, [rank,] score, place): as `bm25` gives them, for asked(query_id, term[, least_rank])."""
        state = self.state()
        dead = self._dead(state).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("words")).first()
        n, all_words = sum(r["docs"] for r in state.live) - dead["n"], sum(r["words"] for r in state.live) - dead["words"]
        mean = (all_words / max(n, 1)) or 1.0
        asked = asked.distinct() if "least_rank" in asked.columns else asked.distinct().withColumn("least_rank", F.lit(None).cast("bigint"))
        packed_rows = self._own_rows(written(asked.select("term").distinct(), "asked-words"), state)
        own = written(bounds(packed_rows), "own-bounds")

        def of(ranges: DataFrame) -> DataFrame:
            return unpacked(packed_rows.join(F.broadcast(ranges.select("segment", "range").distinct()), ["segment", "range"], "left_semi"), self._id_type())

        df = own.select("term", "n")
        if dead["n"]:
            # Only blocks of ranges that have dead documents are counted document by document.
            touched = self._dead(state).select("segment", "range").distinct()
            lost = of(touched).select("term", "segment", "range", F.inline("docs"))
            lost = lost.join(self._dead(state).select("segment", "range", "doc_id"), ["segment", "range", "doc_id"], "left_semi")
            df = df.unionByName(lost.select("term", F.lit(-1).cast("bigint").alias("n")))
        df = df.groupBy("term").agg(F.sum("n").alias("df")).filter("df > 0")
        idf = F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
        words = written(asked.join(df, "term").select("query_id", "term", "least_rank", idf.alias("idf")), "asked")

        def gain(tf: Column, length: Column) -> Column:
            return F.col("idf") * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / F.lit(mean)))

        seen = F.col("least_rank").isNull() | (F.col("top_rank") >= F.col("least_rank"))
        reach = own.join(words, "term").filter(seen).groupBy("query_id", "segment", "range").agg(F.sum(gain(F.col("most"), F.col("shortest"))).alias("bound"))
        order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "segment", "range")
        reach = written(reach.withColumn("p", F.row_number().over(order)), "bounds")

        def scored(ranges: DataFrame) -> DataFrame:
            pairs = words.join(ranges.select("query_id", "segment", "range"), "query_id")
            docs = pairs.join(of(ranges), ["term", "segment", "range"]).select("segment", "range", "query_id", "least_rank", "idf", F.inline("docs"))
            docs = (self._alive(docs, state) if dead["n"] else docs).filter(F.col("least_rank").isNull() | (F.col("rank") >= F.col("least_rank")))
            return docs.groupBy("query_id", "doc_id", "rank").agg(F.round(F.sum(gain(F.col("tf"), F.col("length"))), 6).alias("score"))

        best = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
        ranked = lambda df: df.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= keep)
        first = written(ranked(scored(reach.filter(F.col("p") <= FIRST))), "first-ranges")
        least = first.filter(F.col("place") == keep).select("query_id", F.col("score").alias("least"))
        rest = reach.filter(F.col("p") > FIRST).join(least, "query_id", "left").filter(F.col("least").isNull() | (F.col("bound") + SLACK >= F.col("least")))
        return ranked(first.drop("place").unionByName(scored(rest)))
