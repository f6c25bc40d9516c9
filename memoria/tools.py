"""What a session calls: search, gate, project state, timeline, related notes, exploration, profile and persona.

Each takes tables and parameters and gives a DataFrame. Every search holds the audience ceiling before it ranks.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from memoria.functions.text import is_clinical, tokens
from memoria.functions.vectors import nearest
from memoria.model import PROFILES, SCOPES, SETTINGS, scope_rank
from memoria.operators.cells import Cells
from memoria.operators.lexical import Terms, bm25
from memoria.operators.postings import Postings
from memoria.sources.shared import shared_folder


def least_rank(profile: str) -> int:
    """The lowest rank that a profile may see; an unknown profile may see nothing."""
    return SCOPES.index(PROFILES[profile]) + 1 if profile in PROFILES else len(SCOPES) + 1


def search_memory(items: DataFrame | Terms | Postings, prompt: str, profile: str = "work", k: int = SETTINGS.top_k) -> DataFrame:
    """(doc_id, score, place): the k best of items(doc_id, text, scope) for a prompt's words that the profile may see.

    Terms made before (of items with their rank) can be given instead of the items, so that many prompts share them, or a saved index of them,
    of which only the folders of the prompt's words are read.
    """
    if isinstance(items, Postings):
        asked = items.spark.range(1).select(F.lit(0).alias("query_id"), F.lit(least_rank(profile)).alias("least_rank"), F.explode(tokens(F.lit(prompt))).alias("term"))
        return items.search(asked, k).select("doc_id", "score", F.col("place").cast("bigint").alias("place"))
    one = (items.rows if isinstance(items, Terms) else items).sparkSession.range(1)
    asked = one.select(F.lit(0).alias("query_id"), F.lit(least_rank(profile)).alias("least_rank"), F.explode(tokens(F.lit(prompt))).alias("term"))
    terms = items if isinstance(items, Terms) else Terms(items.select("doc_id", "text", scope_rank(F.col("scope")).alias("rank")), asked=asked)
    return bm25(terms, asked, k).select("doc_id", "score", F.col("place").cast("bigint").alias("place"))


def search_vectors(vectors: DataFrame | Cells, vector: list[float], profile: str = "work", k: int = SETTINGS.top_k, threshold: float = SETTINGS.threshold) -> DataFrame:
    """(id, score, place): the k of vectors(id, vector, scope) closest to a vector that the profile may see and that reach the threshold.

    A saved index of vectors with their rank can be given instead, of which only the cells around the vector are read; of the k it may miss some.
    """
    spark = SparkSession.active() if isinstance(vectors, Cells) else vectors.sparkSession
    asked = spark.createDataFrame([(0, [float(x) for x in vector], least_rank(profile))], "query_id bigint, vector array<double>, least_rank bigint")
    if isinstance(vectors, Cells):
        found = vectors.search(asked, k)
    else:
        found = nearest(vectors.select("id", "vector", scope_rank(F.col("scope")).cast("bigint").alias("rank")), asked, k)
    found = found.filter(F.col("score") >= threshold)
    return found.select("id", "score", F.col("place").cast("bigint").alias("place"))


def gate(found: DataFrame, keys: list[str], threshold: float = SETTINGS.threshold) -> DataFrame:
    """(keys, inject, hits, best) of results with a score: inject where one reaches the threshold, or else stay silent."""
    by = found.groupBy(*keys).agg(F.count_if(F.col("score") >= threshold).alias("hits"), F.max("score").alias("best"))
    return by.select(*keys, (F.col("hits") > 0).alias("inject"), "hits", "best")


def gate_prompt(items: DataFrame | Terms, prompt: str, threshold: float, profile: str = "work", k: int = SETTINGS.top_k) -> DataFrame:
    """One row (inject, hits): whether a prompt gets memories, and the doc_ids of those that reach the threshold, best first."""
    hits = F.transform(F.array_sort(F.collect_list(F.when(F.col("score") >= threshold, F.struct("place", "doc_id")))), lambda h: h["doc_id"])
    return search_memory(items, prompt, profile, k).agg(hits.alias("hits")).select((F.size("hits") > 0).alias("inject"), "hits")


def health(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, n, ok) of the store's tables; ok where there are rows."""
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n", (F.col("n") > 0).alias("ok")) for name, df in tables.items()]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


def project_state(items: DataFrame, project: str | None = None, latest: int = SETTINGS.top_k) -> DataFrame:
    """(project, items, chars, latest): of one project or all, its size and newest items, by doc_id."""
    own = items if project is None else items.filter(F.col("source") == project)
    order = Window.partitionBy("source").orderBy(F.desc("doc_id"))
    newest = own.select("source", "doc_id").withColumn("p", F.row_number().over(order)).filter(F.col("p") <= latest)
    newest = newest.groupBy("source").agg(F.reverse(F.array_sort(F.collect_list("doc_id"))).alias("latest"))
    sizes = own.groupBy("source").agg(F.count(F.lit(1)).alias("items"), F.sum("n_chars").alias("chars"))
    return sizes.join(newest, "source").select(F.col("source").alias("project"), "items", "chars", "latest")


def timeline(events: DataFrame, start: str | None = None, end: str | None = None, by: str = "user_id", time: str = "ts", tie: str = "event_id") -> DataFrame:
    """Events from `start` up to `end` (exclusive), each with the minutes since the one before of its `by`."""
    own = events
    if start is not None:
        own = own.filter(F.col(time) >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        own = own.filter(F.col(time) < F.lit(end).cast("timestamp_ntz"))
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    order = Window.partitionBy(by).orderBy(time, tie)
    return own.withColumn("gap_minutes", F.floor((micros - F.lag(micros).over(order)) / 60_000_000))


def related(links: DataFrame, note: int) -> DataFrame:
    """(page_id, links): notes that link to a note or that it links to, of links(page_id, dst)."""
    out = links.filter(F.col("page_id") == note).select(F.col("dst").alias("page_id"))
    back = links.filter(F.col("dst") == note).select("page_id")
    return out.unionByName(back).filter(F.col("page_id") != note).groupBy("page_id").agg(F.count(F.lit(1)).alias("links"))


def explore(links: DataFrame, starts: DataFrame, depth: int = 2) -> DataFrame:
    """(start, page_id, hops) of the notes within `depth` hops of each of starts(start), along links either way.

    Each round joins what is new with the links and is written, so the plan doesn't grow with the depth.
    """
    spark, base = links.sparkSession, f"{shared_folder(links.sparkSession)}/explore-{uuid.uuid4().hex}"
    both = links.select("page_id", "dst").unionByName(links.select(F.col("dst").alias("page_id"), F.col("page_id").alias("dst"))).distinct()
    starts.select("start", F.col("start").alias("page_id"), F.lit(0).cast("bigint").alias("hops")).distinct().write.parquet(f"{base}/hops=0")
    reached = spark.read.parquet(f"{base}/hops=0")
    for hop in range(1, depth + 1):
        edge = reached.filter(F.col("hops") == hop - 1).join(both, "page_id").select("start", F.col("dst").alias("page_id")).distinct()
        new = edge.join(reached, ["start", "page_id"], "left_anti").withColumn("hops", F.lit(hop).cast("bigint"))
        new.select("start", "page_id", "hops").write.parquet(f"{base}/hops={hop}")
        reached = reached.unionByName(spark.read.parquet(f"{base}/hops={hop}"))
    return reached.filter("hops > 0")


def facet_is_open(statement: Column, bucket: Column, quarantined: list[str], words: list[str] | None = None) -> Column:
    """Whether a facet may be told without being asked for: neither its bucket nor its words are clinical."""
    clinical = is_clinical(statement, words) if words else is_clinical(statement)
    return ~F.coalesce(bucket.isin(quarantined) | clinical, F.lit(True))


def user_profile(facets: DataFrame, per_bucket: int = SETTINGS.top_k, quarantined: list[str] | None = None, words: list[str] | None = None) -> DataFrame:
    """(bucket, statements): of facets(bucket, statement, weight) the heaviest open ones of each bucket, ties by statement."""
    own = facets.filter(facet_is_open(F.col("statement"), F.col("bucket"), quarantined or ["health_wellbeing"], words))
    order = Window.partitionBy("bucket").orderBy(F.desc("weight"), "statement")
    best = own.select("bucket", "statement", "weight").distinct().withColumn("p", F.row_number().over(order)).filter(F.col("p") <= per_bucket)
    return best.groupBy("bucket").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "statement"))), lambda x: x["statement"]).alias("statements"))


def recall_persona(facets: DataFrame, prompt: str, k: int = SETTINGS.top_k, direct: bool = False, quarantined: list[str] | None = None, words: list[str] | None = None) -> DataFrame:
    """(facet_id, score, place): facets(facet_id, bucket, statement) for a prompt; clinical ones only if it asks for them directly."""
    own = facets if direct else facets.filter(facet_is_open(F.col("statement"), F.col("bucket"), quarantined or ["health_wellbeing"], words))
    asked = facets.sparkSession.range(1).select(F.lit(0).alias("query_id"), F.explode(tokens(F.lit(prompt))).alias("term"))
    terms = Terms(own.select(F.col("facet_id").alias("doc_id"), F.col("statement").alias("text")), asked=asked)
    return bm25(terms, asked, k).select(F.col("doc_id").alias("facet_id"), "score", F.col("place").cast("bigint").alias("place"))
