"""Roll-ups: cards, status, salience, reports, alarms, hygiene."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memoria.model import SCOPE_SQL, SETTINGS, derived_scope
from memoria.operators import sketches
from memoria.plans.registry import Tables, query
from memoria.sources.shared import written

NOW = "2024-01-31 00:00:00"
HALF_LIFE_DAYS = 7.0


@query("""
SELECT source AS project, count(*) AS items, sum(n_chars)::BIGINT AS chars, count(DISTINCT lang) AS langs, max(doc_id) AS latest_item,
  arg_max(md5(text), doc_id) AS latest_md5, array_to_string(list_sort(list(DISTINCT lang)), ',') AS lang_list FROM documents GROUP BY source
""")
def project_cards(t: Tables) -> DataFrame:
    """State of each project, with its latest item."""
    return t.documents.groupBy(F.col("source").alias("project")).agg(
        F.count(F.lit(1)).alias("items"), F.sum("n_chars").alias("chars"), F.count_distinct("lang").alias("langs"), F.max("doc_id").alias("latest_item"),
        F.max_by(F.md5(F.col("text").cast("binary")), "doc_id").alias("latest_md5"), F.array_join(F.array_sort(F.collect_set("lang")), ",").alias("lang_list"),
    )


@query("""
SELECT label AS theme, count(*) AS items, round(avg(list_sum(embedding::DOUBLE[])), 5) AS mean_sum, min(vec_id) AS first_item, max(len(embedding))::BIGINT AS dims FROM embeddings GROUP BY label
""")
def theme_cards(t: Tables) -> DataFrame:
    """Size and centre of each theme."""
    total = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double"))
    return t.embeddings.groupBy(F.col("label").alias("theme")).agg(
        F.count(F.lit(1)).alias("items"), F.round(F.avg(total), 5).alias("mean_sum"), F.min("vec_id").alias("first_item"), F.max(F.size("embedding")).cast("bigint").alias("dims")
    )


@query("""
SELECT layer, n, freshest FROM (
  SELECT 'documents' AS layer, count(*) AS n, max(doc_id) AS freshest FROM documents UNION ALL SELECT 'chunks', count(*), max(vec_id) FROM embeddings
  UNION ALL SELECT 'notes', count(*), max(page_id) FROM pages UNION ALL SELECT 'turns', count(*), max(conv_id) FROM conversations UNION ALL SELECT 'events', count(*), max(event_id) FROM events)
""")
def status_layers(t: Tables) -> DataFrame:
    """Rows and latest id of each layer; counts are partial aggregates of column-pruned scans."""
    parts = [t.documents.select(F.lit("documents").alias("layer"), F.col("doc_id").alias("id")), t.embeddings.select(F.lit("chunks"), "vec_id"), t.pages.select(F.lit("notes"), "page_id"), t.conversations.select(F.lit("turns"), "conv_id"), t.events.select(F.lit("events"), "event_id")]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.union(p)
    return whole.groupBy("layer").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("freshest"))


@query("""
SELECT split_part(split_part(url, '://', 2), '/', 1) AS host, split_part(split_part(url, '://', 2), '/', 2) AS area, count(*) AS notes, min(page_id) AS first_note FROM pages GROUP BY 1, 2
""")
def namespace_map(t: Tables) -> DataFrame:
    """The home map: notes by host and area."""
    rest = F.split_part("url", F.lit("://"), F.lit(2))
    return t.pages.groupBy(F.split_part(rest, F.lit("/"), F.lit(1)).alias("host"), F.split_part(rest, F.lit("/"), F.lit(2)).alias("area")).agg(F.count(F.lit(1)).alias("notes"), F.min("page_id").alias("first_note"))


@query(f"""
SELECT user_id, round(sum(value * exp(-ln(2e0) * (epoch(TIMESTAMP '{NOW}') - epoch(ts)) / 86400e0 / {HALF_LIFE_DAYS}e0)), 4) AS salience, count(*) AS n FROM events GROUP BY user_id
""")
def salience_decay(t: Tables) -> DataFrame:
    """Weight of each user's events, halved every week."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    age = (F.unix_micros(F.lit(NOW).cast("timestamp")) - micros) / 86400e6
    weight = F.exp(-F.log(F.lit(2.0)) * age / HALF_LIFE_DAYS)
    return t.events.groupBy("user_id").agg(F.round(F.sum(F.col("value") * weight), 4).alias("salience"), F.count(F.lit(1)).alias("n"))


@query("""
SELECT date_trunc('week', ts)::TIMESTAMP AS week, event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 3) AS total FROM events GROUP BY 1, 2
""")
def weekly_report(t: Tables) -> DataFrame:
    """Ledger totals by week and kind."""
    return t.events.groupBy(F.date_trunc("week", "ts").cast("timestamp_ntz").alias("week"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), F.round(F.sum("value"), 3).alias("total"))


DAILY = "d AS (SELECT ts::DATE AS day, round(avg(CASE WHEN event_type <> 'error' THEN 1e0 ELSE 0e0 END), 6) AS composite FROM events GROUP BY 1)"


def daily(t: Tables) -> DataFrame:
    return t.events.groupBy(F.to_date("ts").alias("day")).agg(F.round(F.avg(F.when(F.col("event_type") != "error", 1.0).otherwise(0.0)), 6).alias("composite"))


@query(f"WITH {DAILY}, w AS (SELECT *, lag(composite) OVER (ORDER BY day) AS before FROM d) SELECT day, composite, before, coalesce(before - composite > {SETTINGS.drift_alarm}, false) AS alarm FROM w")
def drift_alarm(t: Tables) -> DataFrame:
    """Days whose composite falls by more than the alarm allows. The window runs over one row a day."""
    before = F.lag("composite").over(Window.orderBy("day"))
    d = daily(t).withColumn("before", before)
    return d.withColumn("alarm", F.coalesce(F.col("before") - F.col("composite") > SETTINGS.drift_alarm, F.lit(False)))


@query(f"WITH {DAILY} SELECT day, composite, round(avg(composite) OVER (ORDER BY day ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), 8) AS trend FROM d")
def quality_trend(t: Tables) -> DataFrame:
    """Mean of the last four days."""
    return daily(t).withColumn("trend", F.round(F.avg("composite").over(Window.orderBy("day").rowsBetween(-3, 0)), 8))


@query("SELECT event_id, user_id, value FROM events WHERE event_type = 'purchase' ORDER BY value DESC, event_id LIMIT 3")
def brief_three(t: Tables) -> DataFrame:
    """The morning brief: three things."""
    return t.events.filter("event_type = 'purchase'").orderBy(F.desc("value"), "event_id").select("event_id", "user_id", "value").limit(3)


@query("""
SELECT user_id, arg_max(event_type, (ts, event_id)) AS state, max(ts) AS since, count(*) AS n, round(arg_max(value, (ts, event_id)), 6) AS last_value FROM events GROUP BY user_id
""")
def state_rollup(t: Tables) -> DataFrame:
    """Latest state of each user."""
    last = F.struct("ts", "event_id")
    return t.events.groupBy("user_id").agg(F.max_by("event_type", last).alias("state"), F.max("ts").alias("since"), F.count(F.lit(1)).alias("n"), F.round(F.max_by("value", last), 6).alias("last_value"))


@query("WITH r AS (SELECT event_type, event_id, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS place FROM events) SELECT event_type, place::BIGINT AS place, event_id, value FROM r WHERE place <= 5")
def lane_packs(t: Tables) -> DataFrame:
    """Rehearsal: the top five of each lane; each task drops all but five of a lane before the shuffle."""
    order = Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id")
    return t.events.withColumn("place", F.row_number().over(order)).filter("place <= 5").select("event_type", F.col("place").cast("bigint").alias("place"), "event_id", "value")


@query(f"""
SELECT tier, {SCOPE_SQL.replace('doc_id', 'bucket')} AS scope, count(*) AS n, sum(n_chars)::BIGINT AS chars FROM (
  SELECT doc_id % 5 AS bucket, n_chars, CASE WHEN doc_id < (SELECT avg(doc_id) FROM documents) THEN 'cold' ELSE 'hot' END AS tier FROM documents) GROUP BY ALL
""")
def tier_totals(t: Tables) -> DataFrame:
    """Older half retired to the cold tier; size of each tier by scope."""
    middle = t.documents.agg(F.avg("doc_id")).first()[0]
    tier = F.when(F.col("doc_id") < F.lit(middle), "cold").otherwise("hot")
    return t.documents.groupBy(tier.alias("tier"), derived_scope(F.col("doc_id")).alias("scope")).agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


HYGIENE = """
WITH c AS (
  SELECT 'documents without text' AS name, count(*) FILTER (text IS NULL OR text = '') AS bad, count(*) AS n FROM documents
  UNION ALL SELECT 'documents with wrong length', count(*) FILTER (n_chars <> length(text)), count(*) FROM documents
  UNION ALL SELECT 'duplicate document ids', count(*) - count(DISTINCT doc_id), count(*) FROM documents
  UNION ALL SELECT 'duplicate texts', count(*) - count(DISTINCT md5(text)), count(*) FROM documents
  UNION ALL SELECT 'vectors without document', count(*) FILTER (d.doc_id IS NULL), count(*) FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id
  UNION ALL SELECT 'labels without document', count(*) FILTER (d.doc_id IS NULL), count(*) FROM labels l LEFT JOIN documents d ON d.doc_id = l.doc_id)
SELECT name, bad, CASE WHEN bad = 0 THEN 'PASS' WHEN bad * 10 <= n THEN 'WARN' ELSE 'FAIL' END AS status FROM c
"""


@query(HYGIENE)
def hygiene_checks(t: Tables) -> DataFrame:
    """Integrity of the store: status of each check."""
    d = t.documents
    ids = d.select("doc_id").distinct()
    n = F.count(F.lit(1)).alias("n")
    check = lambda name, df, bad: df.agg(bad.cast("bigint").alias("bad"), n).select(F.lit(name).alias("name"), "bad", "n")
    orphans = lambda name, df, key: check(name, df.join(ids.withColumn("_found", F.lit(True)), df[key] == ids["doc_id"], "left"), F.count_if(F.col("_found").isNull()))
    parts = [
        check("documents without text", d, F.count_if(F.col("text").isNull() | (F.col("text") == ""))),
        check("documents with wrong length", d, F.count_if(F.col("n_chars") != F.length("text"))),
        check("duplicate document ids", d, F.count(F.lit(1)) - F.count_distinct("doc_id")),
        check("duplicate texts", d, F.count(F.lit(1)) - F.count_distinct(F.md5(F.col("text").cast("binary")))),
        orphans("vectors without document", t.embeddings, "vec_id"),
        orphans("labels without document", t.labels, "doc_id"),
    ]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.select("name", "bad", F.when(F.col("bad") == 0, "PASS").when(F.col("bad") * 10 <= F.col("n"), "WARN").otherwise("FAIL").alias("status"))


@query(f"WITH h AS ({HYGIENE}) SELECT count(*) FILTER (status = 'PASS') AS passed, count(*) FILTER (status = 'WARN') AS warned, count(*) FILTER (status = 'FAIL') AS failed, CASE WHEN count(*) FILTER (status = 'FAIL') > 0 THEN 1 ELSE 0 END AS exit_code FROM h")
def hygiene_summary(t: Tables) -> DataFrame:
    """Checks by status, and what the process would exit with."""
    n = lambda status, name: F.count_if(F.col("status") == status).alias(name)
    counts = hygiene_checks(t).agg(n("PASS", "passed"), n("WARN", "warned"), n("FAIL", "failed"))
    return counts.withColumn("exit_code", F.when(F.col("failed") > 0, 1).otherwise(0))


@query("""
WITH h AS (SELECT event_type, ts::DATE < DATE '2024-01-16' AS early, count(*) AS n FROM events GROUP BY 1, 2),
s AS (SELECT early, sum(n) AS total FROM h GROUP BY early)
SELECT event_type, round(max(CASE WHEN early THEN n / total::DOUBLE END), 6) AS before, round(max(CASE WHEN NOT early THEN n / total::DOUBLE END), 6) AS after,
  round(abs(max(CASE WHEN early THEN n / total::DOUBLE END) - max(CASE WHEN NOT early THEN n / total::DOUBLE END)), 6) AS shift
FROM h JOIN s USING (early) GROUP BY event_type
""")
def drift_shift(t: Tables) -> DataFrame:
    """Change of each kind's share from one half of the month to the other."""
    early = F.to_date("ts") < F.lit("2024-01-16").cast("date")
    h = t.events.groupBy("event_type", early.alias("early")).agg(F.count(F.lit(1)).alias("n"))
    h = h.join(h.groupBy("early").agg(F.sum("n").alias("total")), "early").withColumn("share", F.col("n") / F.col("total"))
    a, b = F.max(F.when(F.col("early"), F.col("share"))), F.max(F.when(~F.col("early"), F.col("share")))
    return h.groupBy("event_type").agg(F.round(a, 6).alias("before"), F.round(b, 6).alias("after"), F.round(F.abs(a - b), 6).alias("shift"))


@query("""
WITH r AS (SELECT c_nationkey, c_mktsegment, c_acctbal FROM customer)
SELECT c_nationkey, bool_and(c_acctbal > -900) AS all_solvent, bool_or(c_acctbal > 9900) AS some_rich, count(*) FILTER (c_acctbal < 0) AS in_debt,
  array_to_string(list_sort(list(DISTINCT c_mktsegment)), ',') AS segments FROM r GROUP BY c_nationkey
""")
def every_and_some(t: Tables) -> DataFrame:
    """Universal and existential checks by group."""
    return t.customer.groupBy("c_nationkey").agg(
        F.bool_and(F.col("c_acctbal") > -900).alias("all_solvent"), F.bool_or(F.col("c_acctbal") > 9900).alias("some_rich"),
        F.count_if(F.col("c_acctbal") < 0).alias("in_debt"), F.array_join(F.array_sort(F.collect_set("c_mktsegment")), ",").alias("segments"),
    )


DAY = "2024-01-30"


@query(f"""
WITH h AS ({HYGIENE}), e AS (SELECT event_type, count(*) AS n FROM events WHERE ts::DATE = DATE '{DAY}' GROUP BY 1),
b AS (SELECT event_id, row_number() OVER (ORDER BY value DESC, event_id) AS p FROM events WHERE ts::DATE = DATE '{DAY}')
SELECT 'events' AS section, event_type AS name, n FROM e UNION ALL SELECT 'brief', 'event ' || event_id, p FROM b WHERE p <= 3 UNION ALL SELECT 'alarms', name, bad FROM h WHERE status <> 'PASS'
""")
def daily_digest(t: Tables) -> DataFrame:
    """A day's digest: counts of its events, its three largest, and the store's alarms."""
    day = t.events.filter(F.col("ts").cast("date") == F.lit(DAY).cast("date"))
    counts = day.groupBy("event_type").agg(F.count(F.lit(1)).alias("n")).select(F.lit("events").alias("section"), F.col("event_type").alias("name"), "n")
    top = day.orderBy(F.desc("value"), "event_id").limit(3)
    brief = top.select(F.lit("brief").alias("section"), F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("name"), F.row_number().over(Window.orderBy(F.desc("value"), "event_id")).cast("bigint").alias("n"))
    alarms = hygiene_checks(t).filter("status <> 'PASS'").select(F.lit("alarms").alias("section"), "name", F.col("bad").alias("n"))
    return counts.unionByName(brief).unionByName(alarms)


@query("""
WITH e AS (SELECT date_trunc('week', ts)::TIMESTAMP AS week, user_id, value FROM events),
u AS (SELECT DISTINCT week, user_id FROM e),
b AS (SELECT a.week, count(*) AS shared FROM u a JOIN u p ON p.user_id = a.user_id AND p.week = a.week - INTERVAL 7 DAY GROUP BY a.week)
SELECT week, count(*) AS n, count(DISTINCT user_id) AS users, coalesce(any_value(shared), 0) AS shared, true AS users_close, true AS shared_close, true AS median_close FROM e LEFT JOIN b USING (week) GROUP BY week
""")
def sketched_weeks(t: Tables) -> DataFrame:
    """Weeks from the sketches of their days, beside exact counts: users, users that the week before had too, and the median, each within its sketch's bound."""
    e = t.events.withColumn("week", F.date_trunc("week", "ts").cast("timestamp_ntz"))
    days = written(sketches.daily(t.events, "ts", "user_id", "value"), "daily-sketches")
    weeks = sketches.merged(days, F.date_trunc("week", "day").cast("timestamp_ntz").alias("week"))
    before = weeks.select((F.col("week") + F.expr("INTERVAL 7 DAYS")).alias("week"), F.col("key_set").alias("last_set"))
    told = weeks.join(before, "week", "left").select("week", "n", sketches.n_keys().alias("users_about"), F.coalesce(sketches.n_shared("key_set", "last_set"), F.lit(0)).alias("shared_about"), "quantiles")
    users = e.select("week", "user_id").distinct()
    both = users.join(users.select((F.col("week") + F.expr("INTERVAL 7 DAYS")).alias("week"), "user_id"), ["week", "user_id"]).groupBy("week").agg(F.count(F.lit(1)).alias("shared"))
    exact = e.groupBy("week").agg(F.count_distinct("user_id").alias("users"), F.percentile("value", F.array(F.lit(0.5 - sketches.RANK_ERROR), F.lit(0.5 + sketches.RANK_ERROR))).alias("around"))
    x = told.join(exact, "week").join(both, "week", "left").withColumn("shared", F.coalesce("shared", F.lit(0)).cast("bigint"))
    near = lambda a, b, of: F.abs(F.col(a) - F.col(b)) <= sketches.COUNT_ERROR * F.col(of)
    median = sketches.quantile(0.5).between(F.get("around", 0), F.get("around", 1))
    return x.select("week", "n", "users", "shared", near("users_about", "users", "users").alias("users_close"), near("shared_about", "shared", "users").alias("shared_close"), median.alias("median_close"))


@query()
def sketched_drift(t: Tables) -> DataFrame:
    """How far the values of each kind moved from one half of the month to the other, from the days' sketches."""
    days = written(sketches.daily(t.events, "ts", "user_id", "value", ["event_type"]), "daily-sketches")
    halves = sketches.merged(days, "event_type", (F.col("day") < F.lit("2024-01-16").cast("date")).alias("early"))
    a = halves.filter("early").select("event_type", F.col("quantiles").alias("before"))
    b = halves.filter("not early").select("event_type", F.col("quantiles").alias("after"))
    return a.join(b, "event_type").select("event_type", F.round(sketches.drift("before", "after"), 6).alias("drift"))
