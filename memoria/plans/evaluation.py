"""Evaluation: recall, abstention, temporal pairs, hindsight, restraint of the gate, preferences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memoria.functions.text import tokens
from memoria.operators.intervals import valid_at
from memoria.operators.shares import best_shares
from memoria.plans.facts import AS_OF, V, versions
from memoria.plans.registry import Tables, query


@query("""
SELECT source, count(*) AS graded, round(avg(quality), 6) AS helped, round(avg(toxic), 6) AS hurt FROM documents JOIN labels USING (doc_id) GROUP BY source
""")
def hindsight_grade(t: Tables) -> DataFrame:
    """Injections joined to their outcomes."""
    return t.documents.select("doc_id", "source").join(t.labels, "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("graded"), F.round(F.avg("quality"), 6).alias("helped"), F.round(F.avg("toxic"), 6).alias("hurt"))


EVAL = f"""
{V}, items AS (
  SELECT user_id, event_type, CASE user_id % 4 WHEN 0 THEN 'recall' WHEN 1 THEN 'abstain' WHEN 2 THEN 'temporal-current' ELSE 'temporal-past' END AS category,
    max(CASE WHEN valid_to IS NULL THEN value END) AS now_value,
    max(CASE WHEN valid_from <= TIMESTAMP '{AS_OF}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{AS_OF}') THEN value END) AS then_value,
    count(*) AS n FROM v GROUP BY user_id, event_type
), graded AS (
  SELECT category, CASE category WHEN 'recall' THEN n >= 2 WHEN 'abstain' THEN now_value < 95 WHEN 'temporal-current' THEN now_value IS NOT NULL ELSE coalesce(then_value <> now_value, false) END AS ok FROM items
)"""


def eval_items(t: Tables) -> DataFrame:
    v = versions(t)
    at = valid_at(F.lit(AS_OF).cast("timestamp_ntz"))
    return v.groupBy("user_id", "event_type").agg(
        F.max(F.when(F.col("valid_to").isNull(), F.col("value"))).alias("now_value"), F.max(F.when(at, F.col("value"))).alias("then_value"), F.count(F.lit(1)).alias("n")
    )


@query(f"WITH {EVAL} SELECT category, count(*) AS items, round(avg(CASE WHEN ok THEN 1e0 ELSE 0e0 END), 6) AS score FROM graded GROUP BY category")
def memory_eval(t: Tables) -> DataFrame:
    """Score of each category; the composite is their mean."""
    names = F.array(*map(F.lit, ["recall", "abstain", "temporal-current", "temporal-past"]))
    category = F.element_at(names, (F.pmod("user_id", F.lit(4)) + 1).cast("int"))
    ok = (
        F.when(F.col("category") == "recall", F.col("n") >= 2)
        .when(F.col("category") == "abstain", F.col("now_value") < 95)
        .when(F.col("category") == "temporal-current", F.col("now_value").isNotNull())
        .otherwise(F.coalesce(F.col("then_value") != F.col("now_value"), F.lit(False)))
    )
    graded = eval_items(t).withColumn("category", category).withColumn("ok", ok)
    return graded.groupBy("category").agg(F.count(F.lit(1)).alias("items"), F.round(F.avg(F.when(F.col("ok"), 1.0).otherwise(0.0)), 6).alias("score"))


@query(f"WITH {EVAL}, s AS (SELECT category, round(avg(CASE WHEN ok THEN 1e0 ELSE 0e0 END), 6) AS score FROM graded GROUP BY category) SELECT round(avg(score), 8) AS composite, count(*) AS categories FROM s")
def memory_eval_composite(t: Tables) -> DataFrame:
    """Mean of the categories' scores."""
    return memory_eval(t).agg(F.round(F.avg("score"), 8).alias("composite"), F.count(F.lit(1)).alias("categories"))


@query(f"""
WITH {V} SELECT user_id, event_type, max(CASE WHEN valid_to IS NULL THEN value END) AS now_value,
  max(CASE WHEN valid_from <= TIMESTAMP '{AS_OF}' AND (valid_to IS NULL OR valid_to > TIMESTAMP '{AS_OF}') THEN value END) AS then_value FROM v GROUP BY user_id, event_type
""")
def temporal_pairs(t: Tables) -> DataFrame:
    """The current and the past answer of each fact."""
    return eval_items(t).select("user_id", "event_type", "now_value", "then_value")


@query("""
WITH g AS (SELECT item_id, text, list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS words FROM benchmark),
w AS (SELECT item_id, len(words) AS n, unnest(words) AS word FROM g),
d AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) AS word FROM documents),
hits AS (SELECT item_id, doc_id, any_value(n) AS n, count(*) AS hit FROM w JOIN d USING (word) GROUP BY item_id, doc_id),
best AS (SELECT item_id, round(max(hit / n::DOUBLE), 6) AS best FROM hits GROUP BY item_id)
SELECT item_id, coalesce(best, 0e0) AS best, coalesce(best, 0e0) >= 0.9 AS inject FROM g LEFT JOIN best USING (item_id)
""")
def gate_restraint(t: Tables) -> DataFrame:
    """For each question the best share of its words that one document has, and whether the gate opens."""
    words = lambda df, key: df.select(key, F.array_distinct(tokens(F.col("text"))).alias("words"))
    g = words(t.benchmark, "item_id")
    best = best_shares(words(t.documents, "doc_id"), g, "item_id")
    b = F.coalesce("best", F.lit(0.0))
    return g.select("item_id").join(best, "item_id", "left").select("item_id", b.alias("best"), (b >= 0.9).alias("inject"))


@query("""
WITH a AS (SELECT user_id, event_id, ts, value FROM events WHERE event_type = 'view'), b AS (SELECT user_id, ts, value FROM events WHERE event_type = 'purchase')
SELECT a.event_id, count(b.ts) AS followed, round(coalesce(sum(b.value), 0e0), 4) AS worth FROM a LEFT JOIN b ON a.user_id = b.user_id AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 26 HOUR GROUP BY a.event_id
""")
def preference_mining(t: Tables) -> DataFrame:
    """Feedback within 26 hours behind each draft.

    Time is cut into stretches of 26 hours, so that a draft's window lies in its own stretch and the next one: what is left of its own behind the draft,
    and the next up to the window's end. Each is a running total in one stretch of one user, so a user of many events is dealt to many tasks.
    """
    width = 26 * 3600 * 1_000_000
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    rows = t.events.filter(F.col("event_type").isin("view", "purchase")).select("user_id", "event_id", at.alias("at"), (F.col("event_type") == "purchase").alias("is_b"), "value")
    begin = F.struct("at", F.lit(True).alias("begins"))
    end = F.struct((F.col("at") + width).alias("at"), F.lit(False).alias("begins"))
    drafts = rows.filter(~F.col("is_b")).select("user_id", "event_id", F.inline(F.array(begin, end)), F.lit(False).alias("is_b"), F.lit(None).cast("double").alias("value"))
    both = rows.filter("is_b").select("user_id", "event_id", "at", F.lit(False).alias("begins"), "is_b", "value").unionByName(drafts).withColumn("stretch", F.floor(F.col("at") / width))
    stretch = Window.partitionBy("user_id", "stretch")
    up_to = stretch.orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    n, worth = F.count_if("is_b"), F.sum(F.when(F.col("is_b"), F.col("value")).otherwise(0.0))
    seen = both.withColumns({"n": n.over(up_to), "all_n": n.over(stretch), "sum": worth.over(up_to), "all_sum": worth.over(stretch)})
    part = lambda whole, before: F.sum(F.when(F.col("begins"), F.col(whole) - F.col(before)).otherwise(F.col(before)))
    own = seen.filter(~F.col("is_b")).groupBy("user_id", "event_id").agg(part("all_n", "n").alias("followed"), part("all_sum", "sum").alias("worth"))
    return own.select("event_id", "followed", F.round("worth", 4).alias("worth"))


@query("""
WITH w AS (SELECT date_trunc('week', ts)::TIMESTAMP AS week, user_id, avg(value) AS v FROM events GROUP BY 1, 2), m AS (SELECT week, round(avg(v), 6) AS level FROM w GROUP BY week)
SELECT week, level, round(level - first_value(level) OVER (ORDER BY week), 6) AS learned FROM m
""")
def voice_curve(t: Tables) -> DataFrame:
    """Weekly level against the first week."""
    w = t.events.groupBy(F.date_trunc("week", "ts").cast("timestamp_ntz").alias("week"), "user_id").agg(F.avg("value").alias("v"))
    m = w.groupBy("week").agg(F.round(F.avg("v"), 6).alias("level"))
    return m.withColumn("learned", F.round(F.col("level") - F.first("level").over(Window.orderBy("week")), 6))


@query("""
WITH q AS (SELECT event_id, [event_type, CASE WHEN value > 50 THEN 'high' ELSE 'low' END] AS expect, [CASE WHEN user_id % 2 = 0 THEN 'click' ELSE 'view' END, 'high'] AS got FROM events)
SELECT event_id, list_has_any(expect, got) AS answered, len(list_intersect(expect, got))::BIGINT AS n_both FROM q
""")
def expected_keys(t: Tables) -> DataFrame:
    """Whether an answer has any of the expected keys."""
    expect = F.array("event_type", F.when(F.col("value") > 50, "high").otherwise("low"))
    got = F.array(F.when(F.col("user_id") % 2 == 0, "click").otherwise("view"), F.lit("high"))
    return t.events.select("event_id", F.arrays_overlap(expect, got).alias("answered"), F.size(F.array_intersect(expect, got)).cast("bigint").alias("n_both"))
