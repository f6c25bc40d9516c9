"""Streams whose files come late, out of order and twice, against the batch form."""

import random

import pytest
from pyspark.sql import functions as F

from memoria.functions.text import content_chunks
from memoria.operators import sketches
from memoria.sources.files import unseen
from memoria.streaming import live

HOUR = 3600


def written_in_pieces(spark, rows, schema, folder, rng, pieces=5, late_s=2 * HOUR):
    """Files whose rows are late by less than `late_s`, some of them twice; a last one lies far behind."""
    shuffled = sorted(rows, key=lambda r: r[-1] + rng.random() * late_s)
    size = len(shuffled) // pieces + 1
    for i in range(pieces):
        part = shuffled[i * size : (i + 1) * size]
        part += [r for r in shuffled[max(0, i * size - 5) : i * size] if rng.random() < 0.5]
        rng.shuffle(part)
        spark.createDataFrame([(*r[:-1], r[-1]) for r in part], schema).withColumn("at", F.timestamp_seconds("at")).coalesce(1).write.mode("append").parquet(folder)
    end = max(r[-1] for r in rows) + 400 * HOUR
    spark.createDataFrame([(-1, -1, "end", 0.0, end)], schema).withColumn("at", F.timestamp_seconds("at")).coalesce(1).write.mode("append").parquet(folder)


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    rng = random.Random(8)
    rows = [(rng.randint(1, 6), i, rng.choice(["view", "purchase", "click"]), float(rng.randint(1, 9)), 1_700_000_000 + rng.randint(0, 200 * HOUR)) for i in range(300)]
    folder = str(tmp_path_factory.mktemp("events") / "in")
    written_in_pieces(spark, rows, "user_id bigint, event_id bigint, event_type string, value double, at long", folder, rng)
    stream = lambda: spark.readStream.schema(spark.read.parquet(folder).schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return rows, stream


def by_user(rows):
    users = {}
    for r in sorted(rows, key=lambda r: (r[4], r[1])):
        users.setdefault(r[0], []).append(r)
    return users


def test_a_rule_that_expires(events):
    rows, stream = events
    want = set()
    for user, own in by_user(rows).items():
        since = None
        for _, event_id, kind, _, at in own:
            if kind == "view":
                since = at
            elif kind == "purchase":
                if since is not None and at - since <= 5 * HOUR:
                    want.add((user, event_id, at - since))
                since = None
    got = [tuple(r) for r in live.drained(live.when_then_within(stream(), "view", "purchase", 5 * HOUR, "2 hours")).collect()]
    assert sorted(got) == sorted(want) and got


def test_drafts_and_feedback_as_two_streams(events):
    rows, stream = events
    drafts = stream().filter("event_type = 'view'").select("user_id", "at", F.col("event_id").alias("draft_id"))
    feedback = stream().filter("event_type = 'purchase'").select("user_id", "at", F.col("event_id").alias("feedback_id"), "value")
    got = [tuple(r) for r in live.drained(live.followed_by(drafts, feedback, "user_id", "7 HOURS", "3 hours")).collect()]
    want = [(a[0], a[1], b[1], b[3]) for a in rows for b in rows if a[0] == b[0] and a[2] == "view" and b[2] == "purchase" and 0 < b[4] - a[4] <= 7 * HOUR]
    assert sorted(got) == sorted(want) and got


def test_sessions_close_behind_the_watermark(events):
    rows, stream = events
    want = []
    for user, own in by_user(rows).items():
        groups = [[own[0]]]
        for r in own[1:]:
            if r[4] - groups[-1][-1][4] < 3 * HOUR:
                groups[-1].append(r)
            else:
                groups.append([r])
        want += [(user, g[0][4], g[-1][4], len(g)) for g in groups]
    once = live.deduplicated(stream(), ["event_id"], "at", "3 hours")
    window = F.session_window("at", "3 hours")
    out = live.drained(once.groupBy("user_id", window.alias("_w")).agg(F.min("at").alias("started"), F.max("at").alias("ended"), F.count(F.lit(1)).alias("n")))
    got = [(r.user_id, int(r.started.timestamp()), int(r.ended.timestamp()), r.n) for r in out.collect() if r.user_id != -1]
    assert sorted(got) == sorted(want)


def test_complete_mode_counts_each_row_once(events):
    rows, stream = events
    out = live.drained(live.counted(stream().filter("user_id <> -1").dropDuplicates(["event_id"]), "at", "2 hours", "6 hours", ["event_type"]), "complete", each=lambda b: b)
    assert out.agg(F.sum("n")).first()[0] == len(rows)


def test_a_word_in_front_changes_two_chunks_at_most(spark):
    rng = random.Random(2)
    words = [f"w{rng.randint(0, 500)}" for _ in range(6000)]
    texts = [words, ["new", *words], words[:3000] + ["new"] + words[3000:], ["same"] * 5000, ["a"], [], None]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(texts)], "path int, w array<string>")
    chunks = df.select("path", F.posexplode(content_chunks(F.col("w"))).alias("chunk", "part")).select("path", "chunk", "part", F.sha2(F.array_join("part", " "), 256).alias("sha"))
    rows = chunks.orderBy("path", "chunk").collect()
    for i in range(6):
        assert [w for r in rows if r.path == i for w in r.part] == texts[i]
    keys = lambda i: {r.sha for r in rows if r.path == i}
    assert len(keys(0)) > 10 and len(keys(1) - keys(0)) <= 2 and len(keys(2) - keys(0)) <= 2
    assert max(len(r.part) for r in rows) <= 1024 and not keys(6)
    index = chunks.filter("path = 0").select(F.lit(1).alias("path"), "sha")
    assert unseen(chunks.filter("path = 1"), index).count() <= 2


def test_sketches_of_days_add_up(spark):
    rows = spark.range(60_000).select((F.col("id") % 7).alias("d"), (F.pmod(F.xxhash64("id"), F.lit(9000))).alias("key"), (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(1000))).cast("double").alias("v"))
    rows = rows.withColumn("ts", F.date_add(F.lit("2024-01-01").cast("date"), F.col("d").cast("int")).cast("timestamp")).withColumn("v", F.col("v") + F.when(F.col("d") > 3, 300).otherwise(0))
    days = sketches.daily(rows, "ts", "key", "v")
    assert days.count() == 7
    whole = sketches.merged(days, F.lit(1).alias("x")).select("n", sketches.n_keys().alias("keys"), sketches.quantile(0.5).alias("median")).first()
    exact = rows.agg(F.count_distinct("key").alias("keys"), F.percentile("v", F.array(F.lit(0.48), F.lit(0.52))).alias("m")).first()
    assert whole.n == 60_000 and abs(whole["keys"] - exact["keys"]) <= sketches.COUNT_ERROR * exact["keys"] and exact.m[0] <= whole.median <= exact.m[1]
    spans = sketches.merged(days, (F.col("day") > "2024-01-04").alias("late"))
    pair = spans.filter("not late").select(F.col("key_set").alias("a"), F.col("quantiles").alias("qa")).crossJoin(spans.filter("late").select(F.col("key_set").alias("b"), F.col("quantiles").alias("qb")))
    got = pair.select(sketches.n_shared("a", "b").alias("shared"), sketches.drift("qa", "qb").alias("moved"), sketches.drift("qa", "qa").alias("still")).first()
    early, late = (rows.filter(c).select("key").distinct() for c in ("d <= 3", "d > 3"))
    assert abs(got.shared - early.intersect(late).count()) <= sketches.COUNT_ERROR * exact["keys"]
    assert got.still == 0 and 0.25 < got.moved < 0.45
