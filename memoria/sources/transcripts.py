"""Sources of conversations: chat exports of several providers, transcript files, format detection.

Every reader takes any path that Spark can read and gives (conv_id, turn, role, text).
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memoria.functions.text import trimmed
from memoria.sources.shipping import ship_package

#: Explicit schemas: unknown keys are dropped, nothing is inferred.
#: A: the account export of claude.ai, conversations.json: a list of conversations with `chat_messages` in order; projects/*.json: a project with its `docs`.
ASSISTANT_A = "uuid string, name string, chat_messages array<struct<sender:string,text:string,created_at:string>>"
PROJECT_A = "uuid string, name string, description string, docs array<struct<uuid:string,filename:string,content:string>>"
#: B: the data export of chatgpt.com, conversations.json: a list of conversations whose messages are a tree, `mapping` from node id to message, parent and children, with the
#: leaf that was last open in `current_node`. A message's parts that aren't text (images) are objects, which are kept as their JSON.
NODE_B = "struct<message:struct<author:struct<role:string>,content:struct<content_type:string,parts:array<string>>>,parent:string>"
#: Where a conversation has a plain list of such messages instead, each is taken to follow the one before.
ASSISTANT_B = f"conversation_id string, id string, title string, current_node string, mapping map<string,{NODE_B}>, messages array<struct<author:struct<role:string>,content:struct<content_type:string,parts:array<string>>>>"
#: The activity file of a takeout (My Activity, as JSON): one entry a prompt, the prompt in `title` behind the word for it, the answer as HTML. No schema of it is published; these are the keys that its
#: entries have.
ACTIVITY = "header string, title string, time string, safeHtmlItem array<struct<html:string>>"
PROMPTED = "Prompted "
#: A plain list of turns, for other takeouts.
TAKEOUT = "id string, turns array<struct<speaker:string,body:string>>"
SPEAKER_LINE = r"^(User|Assistant):[ ]?(.*)$"


def read_export_a(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(ASSISTANT_A).json(path, multiLine=True)
    return raw.select(F.col("uuid").alias("conv_id"), F.posexplode("chat_messages").alias("turn", "m")).select("conv_id", "turn", F.when(F.col("m.sender") == "human", "user").otherwise("assistant").alias("role"), F.col("m.text").alias("text"))


def read_projects_a(spark: SparkSession, path: str) -> DataFrame:
    """(project, name, file, text): the documents of the export's projects."""
    raw = spark.read.schema(PROJECT_A).json(path, multiLine=True)
    return raw.select(F.col("uuid").alias("project"), "name", F.explode("docs").alias("d")).select("project", "name", F.col("d.filename").alias("file"), F.col("d.content").alias("text"))


def branch_turns(ids: list[str], parents: list[str | None], current: str | None) -> list[tuple[int, int, int]]:
    """(branch, depth, place of the node) of a tree of messages: branch 0 goes from the root to `current` (null or unknown: the last leaf).

    Each other leaf, in the order of nodes, makes a branch of the nodes above it that no branch has yet. Nodes whose parent is missing are roots; a ring of parents ends where it closes.
    """
    place = {node: i for i, node in enumerate(ids)}
    inner = {p for p in parents if p is not None}
    leaves = [node for node in ids if node not in inner]
    if current not in place:
        current = leaves[-1] if leaves else (ids[-1] if ids else None)
    depth: dict[str, int] = {}
    out = []
    for branch, leaf in enumerate([current, *(x for x in leaves if x != current)] if current is not None else []):
        way = []
        own: set[str] = set()
        node = leaf
        while node in place and node not in depth and node not in own:
            way.append(node)
            own.add(node)
            node = parents[place[node]]
        above = depth.get(node, -1)
        for node in reversed(way):
            above += 1
            depth[node] = above
            out.append((branch, above, place[node]))
    return out


def read_export_b(spark: SparkSession, path: str, branches: bool = False) -> DataFrame:
    """Turns of the branch that was last open; with `branches` also those of the others, told apart by a column of that name.

    A node without a message (the root is one) is no turn; turns count from 0 along a branch, those of another branch from where it leaves the ones before.
    """

    ship_package(spark)

    @F.arrow_udf("array<struct<branch:bigint,depth:bigint,place:int>>")
    def walked(ids: pa.Array, parents: pa.Array, current: pa.Array) -> pa.Array:
        rows = zip(ids.to_pylist(), parents.to_pylist(), current.to_pylist(), strict=True)
        turns = [[dict(zip(("branch", "depth", "place"), t, strict=True)) for t in branch_turns(i or [], p or [], c)] for i, p, c in rows]
        return pa.array(turns, pa.list_(pa.struct([("branch", pa.int64()), ("depth", pa.int64()), ("place", pa.int32())])))

    raw = spark.read.schema(ASSISTANT_B).json(path, multiLine=True)
    listed = F.transform("messages", lambda m, i: F.struct(m.alias("message"), F.when(i > 0, (i - 1).cast("string")).alias("parent")))
    ids = F.coalesce(F.map_keys("mapping"), F.transform("messages", lambda m, i: i.cast("string")))
    nodes = raw.select(F.coalesce("conversation_id", "id").alias("conv_id"), ids.alias("ids"), F.coalesce(F.map_values("mapping"), listed).alias("nodes"), "current_node")
    nodes = nodes.withColumn("parents", F.col("nodes.parent")).withColumn("turns", walked("ids", "parents", "current_node"))
    flat = nodes.select("conv_id", "nodes", F.explode("turns").alias("t")).select("conv_id", "t.branch", "t.depth", F.get("nodes", F.col("t.place"))["message"].alias("m"))
    flat = flat.filter(F.col("m").isNotNull() if branches else F.col("m").isNotNull() & (F.col("branch") == 0))
    turn = F.row_number().over(Window.partitionBy("conv_id", "branch").orderBy("depth")) - 1
    return flat.select("conv_id", *(["branch"] if branches else []), turn.alias("turn"), F.col("m.author.role").alias("role"), F.coalesce(F.array_join("m.content.parts", "\n"), F.lit("")).alias("text"))


def read_takeout(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(TAKEOUT).json(path, multiLine=True)
    return raw.select(F.col("id").alias("conv_id"), F.posexplode("turns").alias("turn", "m")).select("conv_id", "turn", F.lower("m.speaker").alias("role"), F.col("m.body").alias("text"))


def read_activity(spark: SparkSession, path: str) -> DataFrame:
    """Turns of an activity file: each entry is a conversation, named by its time, of a prompt and, where there is one, its answer without its tags. Entries that aren't prompts are left out."""
    raw = spark.read.schema(ACTIVITY).json(path, multiLine=True).filter(F.startswith("title", F.lit(PROMPTED)))
    html = F.array_join(F.transform("safeHtmlItem", lambda x: x["html"]), "\n")
    plain = trimmed(F.regexp_replace(F.regexp_replace(html, r"(?i)<(?:br|/p|/li|/h[1-6])[^>]{0,200}>", "\n"), "<[^<>]*>", ""))
    for mark, character in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        plain = F.replace(plain, F.lit(mark), F.lit(character))
    turn = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("text"))
    asked = turn("user", F.substring("title", len(PROMPTED) + 1, F.length("title")))
    turns = F.when(F.nullif(plain, F.lit("")).isNotNull(), F.array(asked, turn("assistant", plain))).otherwise(F.array(asked))
    return raw.select(F.col("time").alias("conv_id"), F.posexplode(turns).alias("turn", "t")).select("conv_id", "turn", "t.role", "t.text")


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files with speaker lines."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("conv_id"), F.col("value").alias("body"))
    return split_speakers(files, "conv_id", "body")


def split_speakers(df: DataFrame, key: str, body: str) -> DataFrame:
    """(key, turn, role, text): a speaker line starts a turn, the lines behind it go on with it; what comes before the first goes.

    The body is split where a line begins with a speaker; no shuffle, and work grows with the body's length.
    """
    parts = F.filter(F.split(F.col(body), r"(?<=\A|\n)(?=(?:User|Assistant):)"), lambda p: p.rlike(r"\A(?:User|Assistant):"))

    def turns(all_: Column) -> Column:
        # The line break before the next speaker belongs to neither.
        own = lambda p, i: F.when(i < F.size(all_) - 1, F.substring(p, F.lit(1), F.length(p) - 1)).otherwise(p)
        return F.transform(all_, lambda p, i: F.struct(F.lower(F.split_part(p, F.lit(":"), F.lit(1))).alias("role"), F.regexp_replace(own(p, i), r"\A(?:User|Assistant):[ ]?", "").alias("text")))

    # As an element of an array the parts are made once, not for each turn.
    once = F.get(F.transform(F.array(parts), turns), F.lit(0))
    return df.select(key, F.posexplode(once).alias("turn", "t")).select(key, F.col("turn").cast("bigint").alias("turn"), "t.role", "t.text")


#: What each export is told by: a key that holds an array, or for the tree of messages an object.
EXPORT_KEYS = {"export_a": "chat_messages", "export_b": "messages", "takeout": "turns"}
TREE_KEY = "mapping"
ACTIVITY_KEYS = ("header", "title", "time")


def detected_format(raw: Column) -> Column:
    """Which export a raw text is, by the arrays (or the tree) that it or the first element of an array has."""
    v = F.try_parse_json(raw)
    held = lambda key: F.coalesce(F.try_variant_get(v, f"$.{key}", "variant"), F.try_variant_get(v, f"$[0].{key}", "variant"))
    is_kind = lambda key, kind: F.schema_of_variant(held(key)).startswith(kind)
    found = F.when(v.isNull(), F.when(raw.rlike(r"(?m)^(User|Assistant):"), "transcript").otherwise("unknown"))
    found = found.when(is_kind(TREE_KEY, "OBJECT"), "export_b")
    activity = F.lit(True)
    for key in ACTIVITY_KEYS:
        activity = activity & F.coalesce(F.schema_of_variant(F.try_variant_get(v, f"$[0].{key}", "variant")) == "STRING", F.lit(False))
    found = found.when(activity, "activity")
    for name, key in EXPORT_KEYS.items():
        found = found.when(is_kind(key, "ARRAY"), name)
    return found.otherwise("json")


#: Explicit schemas of what evaluations read, one JSON object a line.
PROBES = "id string, profile string, class string, prompt string"
QUESTIONS = "id string, category string, question string, expect array<string>"
FACTS = "key string, statement string, evidence string, date string, bucket string, scope string"


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines by a fixed schema: unknown keys are dropped, lines that can't be read too."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
