"""Imports: chats to turns, batches and their manifest, format detection, incremental indexing, set maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memoria.plans.registry import Tables, query
from memoria.sources import files
from memoria.sources.transcripts import detected_format, split_speakers

BATCH = 6

TURNS = f"b AS (SELECT conv_id, turn, role, text, (row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) - 1) // {BATCH} AS batch FROM conversations)"


def batched(t: Tables) -> DataFrame:
    order = Window.partitionBy("conv_id").orderBy("turn", "role")
    return t.conversations.withColumn("batch", F.floor((F.row_number().over(order) - 1) / BATCH))


@query(f"WITH {TURNS} SELECT conv_id, turn, role, batch::BIGINT AS batch, md5(text) AS text_md5 FROM b")
def turn_batches(t: Tables) -> DataFrame:
    """Turns of each conversation in batches by time."""
    return batched(t).select("conv_id", "turn", "role", "batch", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query(f"WITH {TURNS} SELECT conv_id, batch::BIGINT AS batch, min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS turns, sum(length(text))::BIGINT AS chars FROM b GROUP BY conv_id, batch")
def batch_manifest(t: Tables) -> DataFrame:
    """One row for each batch."""
    return batched(t).groupBy("conv_id", "batch").agg(F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"), F.count(F.lit(1)).alias("turns"), F.sum(F.length("text").cast("bigint")).alias("chars"))


@query("""
WITH body AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'User: ' ELSE 'Assistant: ' END || text AS part FROM conversations),
l AS (SELECT conv_id, string_agg(part, chr(10) ORDER BY turn, part) AS body FROM body GROUP BY conv_id),
lines AS (SELECT conv_id, unnest(string_split(body, chr(10))) AS line, unnest(range(len(string_split(body, chr(10))))) AS i FROM l),
m AS (SELECT conv_id, i, line, regexp_matches(line, '^(User|Assistant):') AS starts, sum(CASE WHEN regexp_matches(line, '^(User|Assistant):') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY i) AS turn FROM lines)
SELECT conv_id, (turn - 1)::BIGINT AS turn, lower(any_value(regexp_extract(line, '^(User|Assistant):', 1)) FILTER (starts)) AS role,
  md5(string_agg(CASE WHEN starts THEN regexp_extract(line, '^(User|Assistant):[ ]?(.*)$', 2) ELSE line END, chr(10) ORDER BY i)) AS text_md5 FROM m WHERE turn > 0 GROUP BY conv_id, turn
""")
def speaker_split(t: Tables) -> DataFrame:
    """Transcripts put together from turns, and split at their speaker lines."""
    part = F.concat(F.when(F.col("role") == "user", "User: ").otherwise("Assistant: "), F.col("text"))
    parts = F.array_sort(F.collect_list(F.struct("turn", part.alias("part"))))
    body = t.conversations.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda x: x["part"]), "\n").alias("body"))
    return split_speakers(body, "conv_id", "body").select("conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("""
SELECT conv_id::VARCHAR AS origin, role AS kind, md5(text) AS text_md5, turn FROM conversations
UNION ALL SELECT source, lang, md5(text), NULL FROM documents
""")
def append_union(t: Tables) -> DataFrame:
    """Two providers' rows appended by name; missing columns are null."""
    md5 = F.md5(F.col("text").cast("binary")).alias("text_md5")
    a = t.conversations.select(F.col("conv_id").cast("string").alias("origin"), F.col("role").alias("kind"), md5, "turn")
    b = t.documents.select(F.col("source").alias("origin"), F.col("lang").alias("kind"), md5)
    return a.unionByName(b, allowMissingColumns=True)


@query("""
SELECT conv_id, turn, CASE conv_id % 4 WHEN 0 THEN 'export_a' WHEN 1 THEN 'export_b' WHEN 2 THEN 'takeout' ELSE CASE WHEN regexp_matches(text, '(?m)^(User|Assistant):') OR role = 'user' THEN 'transcript' ELSE 'unknown' END END AS format FROM conversations
""")
def format_detect(t: Tables) -> DataFrame:
    """Raw exports in several forms, told apart by their keys."""
    text = F.col("text")
    a = F.to_json(F.struct(F.array(F.struct(F.col("role").alias("sender"), text.alias("text"))).alias("chat_messages")))
    b = F.to_json(F.struct(F.array(F.struct(text.alias("content"))).alias("messages")))
    c = F.to_json(F.struct(F.array(F.struct(text.alias("body"))).alias("turns")))
    plain = F.concat(F.when(F.col("role") == "user", "User: ").otherwise("- "), text)
    k = F.col("conv_id") % 4
    raw = F.when(k == 0, a).when(k == 1, b).when(k == 2, c).otherwise(plain)
    return t.conversations.select("conv_id", "turn", raw.alias("raw")).select("conv_id", "turn", detected_format(F.col("raw")).alias("format"))


@query("""
SELECT conv_id, arg_max(turn, turn) AS last_turn, count(*) AS turns, count(DISTINCT md5(text)) AS distinct_texts FROM conversations GROUP BY conv_id
""")
def session_latest(t: Tables) -> DataFrame:
    """A session that arrives twice is kept once, in its longest form."""
    twice = t.conversations.unionByName(t.conversations.filter("turn >= 0"))
    once = twice.dropDuplicates(["conv_id", "turn", "role", "text"])
    own = t.conversations.groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"))
    kept = once.groupBy("conv_id").agg(F.max("turn").alias("last_turn"), F.count_distinct(F.md5(F.col("text").cast("binary"))).alias("distinct_texts"))
    return kept.join(own, "conv_id").select("conv_id", "last_turn", "turns", "distinct_texts")


def path_of(t: Tables) -> DataFrame:
    return t.documents.select(F.concat_ws("/", F.col("source"), F.col("lang"), F.col("doc_id").cast("string")).alias("path"), F.sha2("text", 256).alias("sha"), "doc_id", "n_chars")


@query("""
WITH i AS (SELECT source || '/' || lang || '/' || doc_id AS path, sha256(CASE WHEN n_chars % 3 = 0 THEN text || '!' ELSE text END) AS sha FROM documents WHERE n_chars % 5 <> 0),
n AS (SELECT doc_id, source || '/' || lang || '/' || doc_id AS path, sha256(text) AS sha FROM documents)
SELECT doc_id, path FROM n WHERE NOT EXISTS (SELECT 1 FROM i WHERE i.path = n.path AND i.sha = n.sha)
""")
def incremental_skip(t: Tables) -> DataFrame:
    """Documents to index: those whose path and content an earlier index (some missing, some changed) doesn't have."""
    changed = F.when(F.col("n_chars") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    index = t.documents.filter(F.col("n_chars") % 5 != 0).select(F.concat_ws("/", F.col("source"), F.col("lang"), F.col("doc_id").cast("string")).alias("path"), F.sha2(changed, 256).alias("sha"))
    return files.unseen(path_of(t), index).select("doc_id", "path")


@query("""
WITH i AS (SELECT vec_id FROM embeddings), d AS (SELECT doc_id FROM documents WHERE n_chars >= 400)
SELECT vec_id FROM i WHERE vec_id NOT IN (SELECT doc_id FROM d)
""")
def stale_prune(t: Tables) -> DataFrame:
    """Vectors whose document is gone (here: is short) and that are to be pruned."""
    present = t.documents.filter("n_chars >= 400").select(F.col("doc_id").alias("vec_id"))
    return files.stale(t.embeddings.select("vec_id"), present, "vec_id")


@query("""
SELECT s_suppkey AS id, s_name AS name FROM supplier UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_custkey NOT IN (SELECT s_suppkey FROM supplier)
""")
def add_if_absent(t: Tables) -> DataFrame:
    """Rows added only where their key is absent; doing so again changes nothing."""
    base = t.supplier.select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    more = t.customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    once = base.unionByName(more.join(base.select("id"), "id", "left_anti"))
    return once.unionByName(more.join(once.select("id"), "id", "left_anti"))


@query("""
WITH w AS (SELECT user_id, list_sort(list(DISTINCT event_type)) AS types FROM events GROUP BY user_id)
SELECT user_id, array_to_string(list_filter(types, lambda x: x <> 'error'), ',') AS kept, len(types)::BIGINT AS n_before FROM w WHERE len(list_filter(types, lambda x: x <> 'error')) > 0
""")
def remove_matching(t: Tables) -> DataFrame:
    """Entries of one kind taken out of each key's list; empty keys go."""
    w = t.events.groupBy("user_id").agg(F.array_sort(F.collect_set("event_type")).alias("types"))
    kept = F.filter("types", lambda x: x != "error")
    return w.filter(F.size(kept) > 0).select("user_id", F.array_join(kept, ",").alias("kept"), F.size("types").cast("bigint").alias("n_before"))


@query("""
SELECT n_nationkey AS nation, 'no supplier' AS lacks FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)
UNION ALL SELECT p_partkey, 'never ordered' FROM (SELECT p_partkey FROM part EXCEPT SELECT l_partkey FROM lineitem)
UNION ALL SELECT k, 'both' FROM (SELECT p_partkey AS k FROM part INTERSECT SELECT s_suppkey FROM supplier)
""")
def required_and_present(t: Tables) -> DataFrame:
    """Differences and intersections of required and present keys."""
    a = t.nation.select(F.col("n_nationkey").cast("bigint").alias("nation")).join(t.supplier.select(F.col("s_nationkey").cast("bigint").alias("nation")), "nation", "left_anti").select("nation", F.lit("no supplier").alias("lacks"))
    b = t.part.select(F.col("p_partkey").alias("nation")).subtract(t.lineitem.select(F.col("l_partkey"))).select("nation", F.lit("never ordered").alias("lacks"))
    c = t.part.select(F.col("p_partkey").alias("nation")).intersect(t.supplier.select(F.col("s_suppkey"))).select("nation", F.lit("both").alias("lacks"))
    return a.unionByName(b).unionByName(c)


@query("""
WITH p AS (SELECT page_id, CASE page_id % 7 WHEN 0 THEN '/env' WHEN 1 THEN '/notes/.obsidian' WHEN 2 THEN '/docs' WHEN 3 THEN '/wandb' ELSE '' END || regexp_extract(url, '://[^/]*(/[^?#]*)', 1)
  || CASE page_id % 5 WHEN 0 THEN ' - Copy' WHEN 1 THEN '.bak' WHEN 2 THEN ' (OLD)' ELSE '' END AS path FROM pages)
SELECT page_id, path, len(list_intersect(string_split(path, '/'), ['node_modules', '.git', '.venv', 'venv', 'env', '__pycache__', '.mypy_cache', '.pytest_cache', 'dist', 'build', 'out', '.next',
  '.cache', 'target', '.obsidian', '.idea', '.vscode', 'checkpoints', 'wandb', '.ipynb_checkpoints', 'site-packages'])) = 0
  AND NOT contains(lower(path), '- copy') AND NOT contains(lower(path), 'copy (') AND NOT contains(lower(path), '_copy') AND NOT contains(lower(path), 'backup')
  AND NOT contains(lower(path), '.bak') AND NOT contains(lower(path), ' - bak') AND NOT contains(lower(path), ' - old') AND NOT contains(lower(path), '(old)') AS readable FROM p
""")
def path_excludes(t: Tables) -> DataFrame:
    """Paths outside excluded folders and without marks of copies."""
    k = F.col("page_id")
    before = F.when(k % 7 == 0, "/env").when(k % 7 == 1, "/notes/.obsidian").when(k % 7 == 2, "/docs").when(k % 7 == 3, "/wandb").otherwise("")
    behind = F.when(k % 5 == 0, " - Copy").when(k % 5 == 1, ".bak").when(k % 5 == 2, " (OLD)").otherwise("")
    p = t.pages.select("page_id", F.concat(before, F.regexp_extract("url", "://[^/]*(/[^?#]*)", 1), behind).alias("path"))
    return p.withColumn("readable", files.is_readable(F.col("path")))


@query("""
WITH base AS (SELECT user_id, max(value) AS threshold, count(*) AS top_k FROM events WHERE event_type = 'view' GROUP BY user_id),
over_ AS (SELECT user_id, max(value) AS threshold FROM events WHERE event_type = 'purchase' GROUP BY user_id)
SELECT b.user_id, coalesce(o.threshold, b.threshold) AS threshold, b.top_k FROM base b LEFT JOIN over_ o USING (user_id)
""")
def config_overlay(t: Tables) -> DataFrame:
    """Base settings with an overlay whose keys win, merged as maps."""
    e = t.events
    base = e.filter("event_type = 'view'").groupBy("user_id").agg(F.create_map(F.lit("threshold"), F.max("value"), F.lit("top_k"), F.count(F.lit(1)).cast("double")).alias("m"))
    over = e.filter("event_type = 'purchase'").groupBy("user_id").agg(F.create_map(F.lit("threshold"), F.max("value")).alias("o"))
    x = base.join(over, "user_id", "left").withColumn("o", F.coalesce("o", F.create_map().cast("map<string,double>")))
    merged = F.map_concat(F.map_filter("m", lambda k, _: ~F.map_contains_key(F.col("o"), k)), F.col("o"))
    return x.select("user_id", merged.alias("c")).select("user_id", F.col("c")["threshold"].alias("threshold"), F.col("c")["top_k"].cast("bigint").alias("top_k"))
