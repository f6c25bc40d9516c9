"""Events by time: sessions, windows, prospective rules, look-backs; as batch and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memoria.plans.registry import Tables, query
from memoria.streaming import live

GAP_HOURS = 24


@query(f"""
WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w > INTERVAL {GAP_HOURS} HOUR THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
SELECT user_id, session::BIGINT AS session, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM s GROUP BY user_id, session
""")
def session_gaps(t: Tables) -> DataFrame:
    """Sessions of each user: a new one after a day's silence."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    fresh = F.when(F.col("ts") > F.lag("ts").over(order) + F.expr(f"INTERVAL {GAP_HOURS} HOURS"), 1).otherwise(0)
    s = t.events.select("user_id", "ts", "event_id", fresh.alias("fresh")).withColumn("session", F.sum("fresh").over(order))
    return s.groupBy("user_id", "session").agg(F.min("ts").alias("started"), F.max("ts").alias("ended"), F.count(F.lit(1)).alias("n"))


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') AS started, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2")
def tumbling_counts(t: Tables) -> DataFrame:
    """Counts by six-hour windows."""
    return t.events.groupBy(F.window("ts", "6 hours"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("total")).select(F.col("window.start").alias("started"), "event_type", "n", "total")


@query("""
WITH b AS (SELECT time_bucket(INTERVAL 12 HOUR, ts, TIMESTAMP '2024-01-01') AS b, event_type FROM events)
SELECT started, event_type, count(*) AS n FROM (SELECT b AS started, event_type FROM b UNION ALL SELECT b - INTERVAL 12 HOUR, event_type FROM b) GROUP BY 1, 2
""")
def sliding_counts(t: Tables) -> DataFrame:
    """Counts by windows of a day, every twelve hours."""
    return t.events.groupBy(F.window("ts", "24 hours", "12 hours"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("started"), "event_type", "n")


FIRE = """
WITH o AS (SELECT user_id, event_id, event_type, ts, last_value(CASE WHEN event_type IN ('view', 'purchase') THEN event_type END IGNORE NULLS) OVER w AS before_kind,
  last_value(CASE WHEN event_type = 'view' THEN ts END IGNORE NULLS) OVER w AS seen
  FROM events WHERE event_type IN ('view', 'purchase') WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT user_id, event_id, CAST(floor((epoch_us(ts) - epoch_us(seen)) / 1000000) AS BIGINT) AS waited_s FROM o WHERE event_type = 'purchase' AND before_kind = 'view'
"""


@query(FIRE)
def prospective_fire(t: Tables) -> DataFrame:
    """When a user views, then their next purchase fires the rule: batch form."""
    rows = t.events.filter(F.col("event_type").isin("view", "purchase"))
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    o = rows.withColumns({"before": F.lag("event_type").over(order), "seen": F.lag("ts").over(order)})
    fired = o.filter("event_type = 'purchase' and before = 'view'")
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return fired.select("user_id", "event_id", F.floor((micros("ts") - micros("seen")) / 1_000_000).alias("waited_s"))


@query(FIRE)
def prospective_fire_stream(t: Tables) -> DataFrame:
    """The same rule with state over a stream."""
    stream = live.table_stream(t.spark, t.folder, "events").withColumn("at", F.col("ts").cast("timestamp"))
    return live.drained(live.when_then(stream, "view", "purchase"))


@query("SELECT DISTINCT event_id, user_id, event_type FROM events")
def stream_dedup(t: Tables) -> DataFrame:
    """Events that arrive twice, kept once."""
    stream = live.table_stream(t.spark, t.folder, "events").select("event_id", "user_id", "event_type", F.col("ts").cast("timestamp").alias("at"))
    twice = stream.withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    return live.drained(live.deduplicated(twice, ["event_id"], "at", "40 days")).select("event_id", "user_id", "event_type")


@query("SELECT time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2024-01-01') AS started, event_type, count(*) AS n, round(sum(value), 3) AS total FROM events GROUP BY 1, 2")
def stream_windows(t: Tables) -> DataFrame:
    """Windowed counts as a stream in complete mode: all that came in time or late within the watermark."""
    stream = live.table_stream(t.spark, t.folder, "events").select("event_type", "value", F.col("ts").cast("timestamp").alias("at"))
    out = live.drained(live.counted(stream, "at", "2 days", "6 hours", ["event_type"]), "complete", each=lambda b: b)
    return out.select(F.col("window.start").cast("timestamp_ntz").alias("started"), "event_type", "n", F.round("total", 3).alias("total"))


@query("""
WITH m AS (SELECT max(ts) AS last_ts FROM events)
SELECT event_type, count(*) AS n, round(sum(value), 3) AS total FROM events, m WHERE ts > last_ts - INTERVAL 26 HOUR GROUP BY event_type
""")
def lookback(t: Tables) -> DataFrame:
    """Totals of the last 26 hours."""
    last = t.events.agg(F.max("ts")).first()[0]
    return t.events.filter(F.col("ts") > F.lit(last).cast("timestamp_ntz") - F.expr("INTERVAL 26 HOURS")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("total"))


@query("""
SELECT user_id, event_id, ts, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) // 60000000 AS gap_minutes, dayofweek(ts) = 0 AS on_sunday, strftime(ts, '%Y-%m-%d %H:%M') AS minute FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)
""")
def timeline(t: Tables) -> DataFrame:
    """Each user's events in order with the gaps between them."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    gap = F.floor((micros - F.lag(micros).over(order)) / 60_000_000)
    return t.events.select("user_id", "event_id", "ts", gap.alias("gap_minutes"), (F.dayofweek("ts") == 1).alias("on_sunday"), F.date_format("ts", "yyyy-MM-dd HH:mm").alias("minute"))


WITHIN_HOURS = 24


def event_stream(t: Tables) -> DataFrame:
    return live.table_stream(t.spark, t.folder, "events").select("user_id", "event_id", "event_type", "value", F.col("ts").cast("timestamp").alias("at"))


def with_end(t: Tables, stream: DataFrame) -> DataFrame:
    """The stream and behind it one event of nobody, a quarter after the last."""
    last = t.events.agg(F.max(F.col("ts").cast("timestamp")).alias("at"))
    none = last.select(F.lit(-1).cast("bigint").alias("user_id"), F.lit(-1).cast("bigint").alias("event_id"), F.lit("end").alias("event_type"), F.lit(0.0).alias("value"), (F.col("at") + F.expr("INTERVAL 90 DAYS")).alias("at"))
    return live.closed_by(stream, none.select(*[F.col(c).cast(k) for c, k in stream.dtypes]))


@query(f"SELECT * FROM ({FIRE}) WHERE waited_s < {WITHIN_HOURS * 3600}")
def prospective_fire_within(t: Tables) -> DataFrame:
    """The rule that expires a day after it was armed, over a stream with event-time timers."""
    return live.drained(live.when_then_within(with_end(t, event_stream(t)), "view", "purchase", WITHIN_HOURS * 3600, "40 days"))


@query("""
WITH a AS (SELECT user_id, event_id, ts FROM events WHERE event_type = 'view'), b AS (SELECT user_id, ts, value FROM events WHERE event_type = 'purchase')
SELECT a.event_id, count(b.ts) AS followed, round(coalesce(sum(b.value), 0e0), 4) AS worth FROM a JOIN b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 26 HOUR GROUP BY a.event_id
""")
def preference_stream(t: Tables) -> DataFrame:
    """Drafts with feedback within 26 hours, from a join of two streams in which every event comes twice."""
    twice = event_stream(t).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    again = event_stream(t).withColumn("copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("copy")
    drafts = twice.filter("event_type = 'view'").select("user_id", "at", F.col("event_id").alias("draft_id"))
    feedback = again.filter("event_type = 'purchase'").select("user_id", "at", F.col("event_id").alias("feedback_id"), "value")
    pairs = live.drained(live.followed_by(drafts, feedback, "user_id", "26 HOURS", "40 days"))
    return pairs.groupBy(F.col("draft_id").alias("event_id")).agg(F.count(F.lit(1)).alias("followed"), F.round(F.sum("value"), 4).alias("worth"))


@query(f"""
WITH g AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w > INTERVAL {GAP_HOURS} HOUR THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM g)
SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM s GROUP BY user_id, session
""")
def session_stream(t: Tables) -> DataFrame:
    """Each user's sessions, over a stream."""
    stream = with_end(t, event_stream(t))
    found = live.drained(live.sessions(stream, ["user_id"], "at", f"{GAP_HOURS} hours", "40 days"))
    return found.filter("user_id <> -1").select("user_id", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("started", "ended")], "n")
