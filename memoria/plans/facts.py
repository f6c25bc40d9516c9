"""Bi-temporal facts: events stand for fact versions keyed by user and kind."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memoria.operators.intervals import closed_intervals, reconciled, valid_at
from memoria.plans.registry import Tables, query

KEYS = ["user_id", "event_type"]


def versions(t: Tables) -> DataFrame:
    return closed_intervals(t.events.select("event_id", *KEYS, "ts", "value"), KEYS, "ts", "event_id")


V = "v AS (SELECT event_id, user_id, event_type, value, ts AS valid_from, lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS valid_to FROM events)"


@query(f"WITH {V} SELECT event_id, user_id, event_type, value, valid_from, valid_to FROM v")
def fact_intervals(t: Tables) -> DataFrame:
    """Every version with the time for which it holds."""
    return versions(t).select("event_id", *KEYS, "value", "valid_from", "valid_to")


@query(f"WITH {V} SELECT user_id, event_type, event_id, value, valid_from FROM v WHERE valid_to IS NULL")
def fact_current(t: Tables) -> DataFrame:
    """The version that holds now. One aggregate, no sort: the latest by time."""
    last = t.events.groupBy(*KEYS).agg(F.max_by(F.struct("event_id", "value", F.col("ts").alias("valid_from")), F.struct("ts", "event_id")).alias("x"))
    return last.select(*KEYS, "x.event_id", "x.value", "x.valid_from")


AS_OF = "2024-01-15 12:00:00"


@query(f"WITH {V} SELECT user_id, event_type, event_id, value FROM v WHERE valid_from <= TIMESTAMP '{AS_OF}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{AS_OF}')")
def fact_asof(t: Tables) -> DataFrame:
    """The version that held at a moment."""
    return versions(t).filter(valid_at(F.lit(AS_OF).cast("timestamp_ntz"))).select(*KEYS, "event_id", "value")


@query("""
WITH w AS (SELECT *, lag(value) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS before, lag(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS seen FROM events)
SELECT event_id, user_id, event_type, before, value FROM w WHERE before IS NOT NULL AND abs(value - before) > 50 AND ts - seen < INTERVAL 1 DAY
""")
def fact_conflicts(t: Tables) -> DataFrame:
    """Versions that contradict the one before within a day."""
    order = Window.partitionBy(*KEYS).orderBy("ts", "event_id")
    w = t.events.withColumns({"before": F.lag("value").over(order), "seen": F.lag("ts").over(order)})
    return w.filter((F.abs(F.col("value") - F.col("before")) > 50) & (F.col("ts") < F.col("seen") + F.expr("INTERVAL 1 DAY"))).select("event_id", *KEYS, "before", "value")


SLEEP = "2024-01-25 00:00:00"


@query(f"""
WITH a AS (SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS old FROM events WHERE ts < TIMESTAMP '{SLEEP}' GROUP BY ALL),
b AS (SELECT user_id, event_type, arg_max(value, (ts, event_id)) AS new FROM events WHERE ts >= TIMESTAMP '{SLEEP}' GROUP BY ALL)
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.event_type, b.event_type) AS event_type, old, new,
  CASE WHEN b.user_id IS NULL THEN 'kept' WHEN a.user_id IS NULL THEN 'new' WHEN old IS NOT DISTINCT FROM new THEN 'same' ELSE 'conflict' END AS status
FROM a FULL JOIN b ON a.user_id = b.user_id AND a.event_type = b.event_type
""")
def fact_reconcile(t: Tables) -> DataFrame:
    """New session facts against what was known: new, same, kept, or a conflict to flag."""
    latest = lambda rows: rows.groupBy(*KEYS).agg(F.max_by("value", F.struct("ts", "event_id")).alias("value"))
    moment = F.lit(SLEEP).cast("timestamp_ntz")
    return reconciled(latest(t.events.filter(F.col("ts") < moment)), latest(t.events.filter(F.col("ts") >= moment)), KEYS, "value")


@query(f"""
WITH {V} SELECT user_id, count(*) AS n_versions, count(*) FILTER (valid_to IS NULL) AS n_open, count(*) FILTER (valid_to < valid_from) AS n_crossed,
  count(DISTINCT event_type) AS n_facts FROM v GROUP BY user_id
""")
def fact_integrity(t: Tables) -> DataFrame:
    """One open version for each fact, no interval that ends before it starts."""
    return versions(t).groupBy("user_id").agg(
        F.count(F.lit(1)).alias("n_versions"), F.count_if(F.col("valid_to").isNull()).alias("n_open"),
        F.count_if(F.col("valid_to") < F.col("valid_from")).alias("n_crossed"), F.count_distinct("event_type").alias("n_facts"),
    )


@query(f"""
WITH {V}, p AS (SELECT user_id, ts FROM events WHERE event_type = 'purchase')
SELECT p.user_id, p.ts, v.value AS viewed FROM p LEFT JOIN v ON v.user_id = p.user_id AND v.event_type = 'view' AND v.valid_from <= p.ts AND (v.valid_to IS NULL OR v.valid_to > p.ts)
""")
def fact_asof_each(t: Tables) -> DataFrame:
    """For each purchase the view fact that held then: as-of join by carrying the last value forward in one sort."""
    rows = t.events.filter(F.col("event_type").isin("purchase", "view")).select("user_id", "ts", "event_id", "event_type", "value")
    is_view = F.col("event_type") == "view"
    order = Window.partitionBy("user_id").orderBy("ts", F.when(is_view, 0).otherwise(1), "event_id")
    carried = rows.withColumn("viewed", F.last(F.when(is_view, F.col("value")), ignorenulls=True).over(order))
    return carried.filter(~is_view).select("user_id", "ts", "viewed")
