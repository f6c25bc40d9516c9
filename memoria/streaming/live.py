"""Streams: file sources, deduplication, windows with late data, prospective rules with state.

Batch tables can be run as streams to their end (`drained`), which is how the queries and tests use these.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from memoria.operators.postings import Postings
from memoria.sources.shared import delete_folder, shared_folder, written
from memoria.sources.transcripts import split_speakers


def watch_text(spark: SparkSession, folder: str, max_files: int = 1000) -> DataFrame:
    """New files of an inbox, whole, at most `max_files` in a batch; a path is read once, and `changed_files` also gives those changed later."""
    raw = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", max_files).load(folder)
    return raw.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("changed"), F.col("value").alias("body"))


def table_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet table as a stream."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet*").parquet(folder)


STATE_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def drained(stream: DataFrame, mode: str = "append", each: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """All that the stream gives until its source is used up, written to the shared folder and read from there."""
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    before = spark.conf.get(STATE_PROVIDER)
    spark.conf.set(STATE_PROVIDER, ROCKS)  # state on disk, and the only store for processors with named state
    try:
        _run(stream, base, mode, each)
    finally:
        spark.conf.set(STATE_PROVIDER, before)
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def _run(stream: DataFrame, base: str, mode: str, each: Callable[[DataFrame], DataFrame] | None) -> None:
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{base}/checkpoint").outputMode(mode)
    if each is None:
        q = writer.format("parquet").option("path", f"{base}/out").start()
    else:

        def put(batch: DataFrame, batch_id: int) -> None:
            # In complete mode every batch gives all rows, so the last one stands for those before.
            each(batch).write.mode("overwrite").parquet(f"{base}/out/batch={0 if mode == 'complete' else batch_id}")

        q = writer.foreachBatch(put).start()
    q.awaitTermination()
    if q.exception():
        raise q.exception()


#: Files of the inbox are compiled to notes and then indexed; notes are indexed only, or each note would be compiled anew for ever.
#: Session transcripts are captured: split into turns.
INBOX, NOTES, SESSIONS = "raw", "wiki", "sessions"


def work_for(path: Column) -> Column:
    """`compile` for files of the inbox, `index` for notes, `capture` for sessions, null for what is none of them; by the last of these folders in the path."""
    last = F.try_element_at(F.filter(F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1), lambda p: p.isin(INBOX, NOTES, SESSIONS)), F.lit(-1))
    return F.when(last == INBOX, "compile").when(last == NOTES, "index").when(last == SESSIONS, "capture")


def kept_current(stream: DataFrame, table: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Runs a stream of changed files (path, changed[, gone], body) into `table`, batch by batch: until the source is used up, or with `every`
    (such as `10 seconds`) on and on, until the query that is given back is stopped.

    A batch that is run again after a failure writes over its own folder; `current` tells the latest version of each path.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        gone = F.col("gone") if "gone" in batch.columns else F.lit(False)
        rows = batch.select("path", "changed", gone.alias("gone"), work_for(F.col("path")).alias("work"), F.sha2("body", 256).alias("sha"), "body").filter("work is not null")
        rows.write.mode("overwrite").parquet(f"{table}/batch={batch_id}")

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put)
    if every is not None:
        return writer.trigger(processingTime=every).start()
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def current(spark: SparkSession, table: str) -> DataFrame:
    """(path, changed, work, sha, body): the latest version of each path that isn't gone; a later batch counts before a later time of change."""
    rows = spark.read.parquet(table)
    latest = rows.groupBy("path").agg(F.max_by(F.struct("changed", "gone", "work", "sha", "body"), F.struct("batch", "changed")).alias("v"))
    return latest.filter("not v.gone").select("path", "v.changed", "v.work", "v.sha", "v.body")


def kept_indexed(stream: DataFrame, index: Postings, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Runs a stream of changed files (path, changed[, gone], body) into a saved index by path, so that a search sees each file as it is now and nothing of files that are gone.

    A batch counts at once or not at all, and one that is run again after a failure changes nothing. Segments are merged as batches come in. `every` is as in `kept_current`.
    The stream must always come with the same checkpoint, which names its batches.
    """

    def put(batch: DataFrame, batch_id: int) -> None:
        rows = written(batch.select("path", "changed", (F.col("gone") if "gone" in batch.columns else F.lit(False)).alias("gone"), "body"), "changed")
        latest = rows.groupBy("path").agg(F.max_by(F.struct("gone", "body"), F.struct("changed", "gone", "body")).alias("v")).select(F.col("path").alias("doc_id"), "v.*")
        index.replace(latest.filter("not gone").select("doc_id", F.col("body").alias("text")), latest.filter("gone").select("doc_id"), batch=f"{checkpoint}#{batch_id}")
        index.compact()

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(put)
    if every is not None:
        return writer.trigger(processingTime=every).start()
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def captured_turns(spark: SparkSession, table: str) -> DataFrame:
    """(path, turn, role, text) of the session transcripts in `table`, each in its latest version: a session captured again, longer, counts once."""
    return split_speakers(current(spark, table).filter("work = 'capture'"), "path", "body")


def compacted(spark: SparkSession, table: str) -> None:
    """Brings the table's batches, but for the last, down to one with the latest version of each path, so that `current` reads no history.

    Older batches go only when the new one stands, and until then say nothing that it doesn't; a path that is gone keeps a row without a body.
    """
    rows = spark.read.parquet(table)
    batches = sorted(r["batch"] for r in rows.select("batch").distinct().collect())
    if len(batches) < 3:
        return
    old, into = batches[:-1], batches[-2]
    latest = rows.filter(F.col("batch").isin(old)).groupBy("path").agg(F.max_by(F.struct("changed", "gone", "work", "sha", "body"), F.struct("batch", "changed")).alias("v"))
    kept = written(latest.select("path", "v.*"), "compacted")
    kept.write.mode("overwrite").parquet(f"{table}/batch={into}")
    for batch in old[:-1]:
        delete_folder(spark, f"{table}/batch={batch}")


def deduplicated(stream: DataFrame, keys: list[str], time: str, lateness: str) -> DataFrame:
    """The first row of each key within the watermark: a session captured twice counts once."""
    return stream.withWatermark(time, lateness).dropDuplicatesWithinWatermark(keys)


def counted(stream: DataFrame, time: str, lateness: str, width: str, by: list[str], slide: str | None = None) -> DataFrame:
    """Rows in tumbling or sliding windows; windows close when the watermark passes their end."""
    window = F.window(time, width, slide) if slide else F.window(time, width)
    return stream.withWatermark(time, lateness).groupBy(window, *by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))


class WhenThen(StatefulProcessor):
    """Fires for a user's `then` event if a `when` event came before it; the rule is armed anew by the next `when`."""

    def __init__(self, when: str, then: str):
        self.when, self.then = when, then

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.armed = handle.getValueState("armed", "since bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(rows)).sort_values(["at", "event_id"])
        since = self.armed.get()[0] if self.armed.exists() else None
        fired = []
        for kind, at, event_id in zip(found["event_type"], found["at"], found["event_id"], strict=True):
            if kind == self.when:
                since = int(at)
            elif kind == self.then and since is not None:
                fired.append((key[0], int(event_id), (int(at) - since) // 1_000_000))
                since = None
        if since is None:
            self.armed.clear()
        else:
            self.armed.update((since,))
        yield pd.DataFrame(fired, columns=["user_id", "event_id", "waited_s"]).astype("int64")

    def close(self) -> None:
        pass


def when_then(stream: DataFrame, when: str, then: str) -> DataFrame:
    """(user_id, event_id, waited_s) of every firing; state is one value for each user."""
    rows = stream.select("user_id", "event_id", "event_type", F.unix_micros("at").alias("at"))
    return rows.groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=WhenThen(when, then), outputStructType="user_id bigint, event_id bigint, waited_s bigint", outputMode="append", timeMode="None"
    )


def closed_by(stream: DataFrame, row: DataFrame) -> DataFrame:
    """A stream with the rows of a written table at its end, such as one of a time beyond all others: with it the watermark passes the last real row."""
    spark, path = stream.sparkSession, f"{shared_folder(stream.sparkSession)}/end-{uuid.uuid4().hex}"
    row.select(*stream.columns).coalesce(1).write.parquet(path)
    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(path))


def sessions(stream: DataFrame, by: list[str], time: str, gap: str, lateness: str) -> DataFrame:
    """(by, started, ended, n) of each session: rows whose distance is below `gap`; a session is given when the watermark passes its end."""
    window = F.session_window(time, gap)
    counted_ = stream.withWatermark(time, lateness).groupBy(*by, window.alias("_w")).agg(F.min(time).alias("started"), F.max(time).alias("ended"), F.count(F.lit(1)).alias("n"))
    return counted_.select(*by, "started", "ended", "n")


def followed_by(drafts: DataFrame, feedback: DataFrame, by: str, within: str, lateness: str) -> DataFrame:
    """(by, draft_id, feedback_id, value): each draft with each feedback of the same `by` after it and within the interval, as a join of two streams.

    drafts(by, at, draft_id) and feedback(by, at, feedback_id, value) may be late by `lateness` and may repeat; each id counts once. Both watermarks bound what is kept: a draft until no
    feedback of its interval can come any more, feedback until no draft before it can.
    """
    a = deduplicated(drafts, ["draft_id"], "at", lateness).select(F.col(by).alias("_a"), F.col("at").alias("a_at"), "draft_id")
    b = deduplicated(feedback, ["feedback_id"], "at", lateness).select(F.col(by).alias("_b"), F.col("at").alias("b_at"), "feedback_id", "value")
    near = F.expr(f"_a = _b AND b_at > a_at AND b_at <= a_at + INTERVAL {within}")
    return a.join(b, near).select(F.col("_a").alias(by), "draft_id", "feedback_id", "value")


class WhenThenWithin(StatefulProcessor):
    """Fires for a user's first `then` event at most `within` microseconds behind a `when` event; the next `when` arms it anew, and any `then` disarms it.

    Events wait until the watermark has passed them and are then taken in order, so what a batch holds and in which order it comes changes nothing. A timer
    stands at the earliest waiting event, or where the rule would expire, when its state goes.
    """

    def __init__(self, when: str, then: str, within: int):
        self.when, self.then, self.within = when, then, within

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.armed = handle.getValueState("armed", "since bigint")
        self.waiting = handle.getListState("waiting", "at bigint, event_id bigint, kind string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:
        passed = timer_values.getCurrentWatermarkInMs()
        new = [(int(at), int(i), kind) for df in rows for at, i, kind in zip(df["at"], df["event_id"], df["event_type"], strict=True)]
        new = [e for e in new if e[0] // 1000 >= passed and e[2] in (self.when, self.then)]  # later ones are too late
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(min(new)[0] // 1000 + 1)
        yield self._frame([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N803
        passed = timerValues.getCurrentWatermarkInMs()
        waiting = sorted(set(tuple(e) for e in self.waiting.get()))
        due, left = [e for e in waiting if e[0] // 1000 < passed], [e for e in waiting if e[0] // 1000 >= passed]
        since = int(self.armed.get()[0]) if self.armed.exists() else None
        fired = []
        for at, event_id, kind in due:
            if kind == self.when:
                since = at
            else:
                if since is not None and at - since <= self.within:
                    fired.append((key[0], event_id, (at - since) // 1_000_000))
                since = None
        if since is not None and since + self.within < passed * 1000 and not left:
            since = None
        self.waiting.clear()
        if left:
            self.waiting.put(left)
            self.handle.registerTimer(left[0][0] // 1000 + 1)
        if since is None:
            self.armed.clear()
        else:
            self.armed.update((since,))
            self.handle.registerTimer((since + self.within) // 1000 + 2)
        yield self._frame(fired)

    @staticmethod
    def _frame(fired: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(fired, columns=["user_id", "event_id", "waited_s"]).astype("int64")

    def close(self) -> None:
        pass


def when_then_within(stream: DataFrame, when: str, then: str, within_s: int, lateness: str) -> DataFrame:
    """(user_id, event_id, waited_s) of every firing within `within_s` seconds, of a stream(user_id, event_id, event_type, at) that is late by `lateness` at most."""
    rows = stream.withWatermark("at", lateness).select("user_id", "event_id", "event_type", F.unix_micros("at").alias("at"), F.col("at").alias("_time"))
    return rows.groupBy("user_id").transformWithStateInPandas(
        statefulProcessor=WhenThenWithin(when, then, within_s * 1_000_000), outputStructType="user_id bigint, event_id bigint, waited_s bigint", outputMode="append", timeMode="EventTime"
    )
